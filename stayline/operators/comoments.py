"""Correlations of many columns from one pass: mergeable co-moments, block by block of columns.

A built-in aggregate per pair of columns is fine for a few of them; hundreds make an expression that no longer compiles. Here
each task multiplies matrices. Its state for a pair of columns, over the rows that have both, is their number, both means,
both sums of squared deviations and the sum of products of deviations; states of two tasks merge without the rows (Chan, Golub,
LeVeque 1979). A state is cut into blocks of BLOCK columns by BLOCK, and each pair of blocks is merged in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: What a state holds of each pair (i, j), in this order.
STATE = ("n", "mean_i", "mean_j", "square_i", "square_j", "product")


class Sums:
    """Sums of a task's rows around the first value of each column, so that a constant column deviates by nothing at all."""

    def __init__(self, columns: int):
        self.shift = np.full(columns, np.nan)
        self.n, self.s, self.q, self.p = (np.zeros((columns, columns)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Rows by columns; what is missing is not a number."""
        there = ~np.isnan(x)
        unset = np.isnan(self.shift) & there.any(0)
        self.shift[unset] = x[there.argmax(0)[unset], np.flatnonzero(unset)]
        z = np.where(there, x - np.where(np.isnan(self.shift), 0.0, self.shift), 0.0)
        m = there.astype(float)
        self.n += m.T @ m
        self.s += z.T @ m
        self.q += (z * z).T @ m
        self.p += z.T @ z

    def state(self) -> np.ndarray:
        """One matrix per entry of STATE."""
        n = np.maximum(self.n, 1.0)
        shift = np.nan_to_num(self.shift)
        mean = shift[:, None] + self.s / n
        square = np.maximum(self.q - self.s**2 / n, 0.0)
        return np.stack([self.n, mean, mean.T, square, square.T, self.p - self.s * self.s.T / n])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of both tasks' rows."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    i, j, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    # an empty side's means say nothing
    some = (a[0] > 0) & (b[0] > 0)
    i, j = np.where(some, i, 0.0), np.where(some, j, 0.0)
    mean_i, mean_j = (np.where(a[0] > 0, a[k] + d * share, b[k]) for k, d in ((1, i), (2, j)))
    return np.stack([n, mean_i, mean_j, a[3] + b[3] + i * i * weight, a[4] + b[4] + j * j * weight, a[5] + b[5] + i * j * weight])


def correlation(state: np.ndarray) -> np.ndarray:
    """Pearson's coefficient; not a number for pairs without rows, or with a constant column."""
    spread = np.sqrt(state[3]) * np.sqrt(state[4])
    return np.divide(state[5], spread, out=np.full_like(spread, np.nan), where=spread > 0)


def correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(x, y, r) for every pair of columns, both ways round; r is NULL where there is none. Values that are no numbers count as
    missing."""
    columns, blocks = list(columns), -(-len(columns) // block)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(len(columns))
        for batch in batches:
            if batch.num_rows:
                sums.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        state = sums.state()
        for i in range(blocks):
            for j in range(i, blocks):
                part = state[:, i * block : (i + 1) * block, j * block : (j + 1) * block]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], ["i", "j", "state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, state in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(state).reshape(len(STATE), min(block, len(columns) - i * block), -1)
                found[i, j] = merged(found[i, j], part) if (i, j) in found else part
        for (i, j), state in found.items():
            r = correlation(state)
            x = np.repeat(np.arange(r.shape[0]) + i * block, r.shape[1])
            y = np.tile(np.arange(r.shape[1]) + j * block, r.shape[0])
            if i < j:  # the other way round too
                x, y, r = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([r.ravel(), r.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([columns[k] for k in x]), pa.array([columns[k] for k in y]), pa.array(r.ravel(), from_pandas=True)], ["x", "y", "r"])

    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    states = rows.mapInArrow(fold, "i int, j int, state binary")
    return states.repartition(blocks * (blocks + 1) // 2, "i", "j").mapInArrow(merge, "x string, y string, r double")
