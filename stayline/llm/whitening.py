"""Whitening of vectors by the leading components of their covariance, found by spectrum slicing (Parlett 1980, ch. 3 and 4).

The entries are brought to whole numbers; every distinct vector counts once. Two passes over these give the count, the sums
and the covariance, centred before multiplying; what reaches the driver are sums over all rows, one number per pair of
dimensions. There the spectrum is sliced: the factors L D L' of the covariance less a shift say by their signs how many
eigenvalues lie above it (Sylvester), so halving finds for each number an interval that holds that eigenvalue alone. A
Rayleigh quotient iteration converges to it cubically; a step that leaves the interval is thrown away and the interval is
halved again. At the end counts just below and above each value certify its number. Values that cannot be told apart at
double precision share an interval; their components are made orthogonal to each other, in an order of their own.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; vectors of different lengths are
different spaces, each with a fit of its own; repeated rows give a row each and count once in the fit; a null id stays null;
a space has as many components as eigenvalues above rounding (TINY of the trace), so a single distinct vector, equal
vectors and empty ones have none and give no rows; entries beyond a long are cut to it and a deviation beyond a long is null;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import written

COMPONENTS, SCALE = 4, 256
#: Share of the trace below which an eigenvalue is rounding; share of the largest at which two are told apart.
TINY, APART = 1e-12, 1e-14
#: A pivot smaller than this share of its column is taken two by two (Bunch and Kaufman 1977).
PIVOT = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are larger than a shift: the positive ones of D in L D L' = matrix - shift."""
    a = matrix - shift * np.eye(len(matrix))
    found, k, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        largest = below[r - k - 1] if len(below) else 0.0
        single = abs(a[k, k]) >= PIVOT * largest
        if not single:
            off = np.abs(a[k:, r])
            off[r - k] = 0.0
            if abs(a[k, k]) * off.max() >= PIVOT * largest**2:
                single = True
            elif abs(a[r, r]) >= PIVOT * off.max():
                single = True
                swap(k, r)
            else:
                swap(k + 1, r)
        if single:
            d = a[k, k]
            found += d > 0
            if d != 0:
                column = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(column, column / d)
            k += 1
        else:  # an indefinite pair: one eigenvalue on either side
            found += 1
            pair, columns = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(pair, columns.T)
            k += 2
    return int(found)


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray | None:
    try:
        x = np.linalg.solve(matrix - shift * np.eye(len(matrix)), v)
    except np.linalg.LinAlgError:
        return None
    length = np.linalg.norm(x)
    return x / length if np.isfinite(length) and length else None


def _refined(matrix: np.ndarray, low: float, high: float, others: list[np.ndarray], apart: float, seed: int) -> tuple[float, np.ndarray]:
    """Value and unit vector of an eigenvalue in (low, high], by Rayleigh quotient iteration kept inside the interval."""

    def cleared(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for other in others:
                v = v - (v @ other) * other
        return v / max(np.linalg.norm(v), 1e-300)

    v = cleared(np.random.default_rng(seed).standard_normal(len(matrix)))
    shift = (low + high) / 2
    for _ in range(3):  # inverse iteration leads to the vector of the interval
        x = _solved(matrix, shift, v)
        v = cleared(x) if x is not None else v
    value, best, found = v @ matrix @ v, np.inf, v
    for _ in range(60):
        if not low - apart <= value <= high + apart:
            value = shift
        x = _solved(matrix, value, v)
        if x is None:  # the shift is the eigenvalue to the last digit
            x = _solved(matrix, value + apart, v)
        v = cleared(x if x is not None else v)
        value = v @ matrix @ v
        rest = np.linalg.norm(matrix @ v - value * v)
        if low - apart <= value <= high + apart:
            if rest >= best:
                break
            best, found = rest, v
    return float(found @ matrix @ found), found


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors as columns, their largest entry positive."""
    trace, values, vectors = float(np.trace(matrix)), [], []
    # rows bound the spectrum (Gershgorin)
    top = float(np.abs(matrix).sum(1).max(initial=0.0)) * (1 + 1e-9)
    apart = APART * max(top, 1e-300)
    wanted = min(components, above(matrix, TINY * trace)) if trace > 0 else 0
    known: dict[float, int] = {top: 0, TINY * trace: wanted}

    def count(shift: float) -> int:
        if shift not in known:
            known[shift] = above(matrix, shift)
        return known[shift]

    for k in range(1, wanted + 1):
        low = max(s for s, n in known.items() if n >= k)
        high = min(s for s, n in known.items() if n < k)
        while high - low > apart and (count(low) > k or count(high) < k - 1):
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        value, vector = _refined(matrix, low, high, vectors, apart, k)
        # certified by counts on both sides; while they differ, the interval is halved and the iteration begins again
        near = max(64 * apart, 1e-10 * abs(value))
        while high - low > near and not (count(value - near) >= k > count(value + near)):
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
            value, vector = _refined(matrix, low, high, vectors, apart, k)
        if not (above(matrix, value - near) >= k > above(matrix, value + near)):
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
        values.append(value)
        vectors.append(vector * np.sign(vector[np.abs(vector).argmax()]))
    return np.array(values), np.array(vectors).T.reshape(len(matrix), wanted)


@dataclass(frozen=True)
class Fit:
    """One space: the rows and sums of the fit list, and its leading components."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def sound(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector holds finite numbers only."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", whole(F.col("vector")).alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length of a batch; whole numbers."""
    column = batch.column("x")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)


def _totals(fit_list: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Count and sums of the fit list by length; the sums are whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at, x in _by_length(batch):
                was = total.setdefault(x.shape[1], [0, 0])
                was[0] += len(at)
                # halves, so that no sum of a batch leaves a long
                was[1] = was[1] + ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        rows = [(d, n, j, str(s)) for d, (n, sums) in total.items() for j, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int64(), pa.int32(), pa.string()))], ["d", "n", "j", "s"])

    parts = fit_list.mapInArrow(run, "d int, n long, j int, s string")
    found: dict[int, tuple[int, dict]] = {}
    for row in parts.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(row["d"], (row["n"], {}))[1][row["j"]] = int(row["s"])
    return {d: (n, tuple(s[j] for j in range(d))) for d, (n, s) in found.items()}


def _summed(fit_list: DataFrame, points, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """By length, the sum over the fit list of the outer products of points(length, rows); one number per cell to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros((k, k)) for d, k in sizes.items()}
        for batch in batches:
            for _, x in _by_length(batch):
                if x.shape[1] in total:
                    z = points(x.shape[1], x)
                    total[x.shape[1]] += z.T @ z
        for d, m in total.items():
            cells = m.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, d, np.int32)), pa.array(np.arange(cells)), pa.array(m.ravel())], ["d", "cell", "v"])

    out = {d: np.zeros((k, k)) for d, k in sizes.items()}
    for row in fit_list.mapInArrow(run, "d int, cell long, v double").groupBy("d", "cell").agg(F.sum("v").alias("v")).collect():
        out[row["d"]].flat[row["cell"]] = row["v"]
    return out


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The spaces of a list of distinct whole vectors (x), by their length."""
    totals = {d: t for d, t in _totals(fit_list).items() if d}
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in totals.items()}
    matrices = _summed(fit_list, lambda d, x: x - means[d], {d: d for d in totals})
    fits = {}
    for d, (n, sums) in totals.items():
        matrix = (matrices[d] + matrices[d].T) / (2 * n)
        values, vectors = leading(matrix, components)
        fits[d] = Fit(n, sums, values, vectors, float(np.trace(matrix)), 0.0)
    # the covariance of the whitened fit list, measured on its rows: these are centred by the mean already
    scaled = {d: f.vectors / np.sqrt(f.values) for d, f in fits.items() if len(f.values)}
    products = _summed(fit_list, lambda d, x: (x - means[d]) @ scaled[d], {d: s.shape[1] for d, s in scaled.items()})
    for d, total in products.items():
        f = fits[d]
        error = float(np.abs(total / f.n - np.eye(len(total))).max())
        fits[d] = Fit(f.n, f.sums, f.values, f.vectors, f.trace, error)
    return fits


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; None beyond a long."""
    about = ((x.astype(float) * fit.n - np.array(fit.sums, float)) ** 2).sum(1)
    if about.max(initial=0.0) < 2.0**62 and np.abs(x).max(initial=0) * float(fit.n) < 2.0**62 and max(map(abs, fit.sums)) < 2**62:
        off = x * np.int64(fit.n) - np.array(fit.sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((fit.n * int(a) - s) ** 2 for a, s in zip(row, fit.sums)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whitened(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row of (vec_id, x) and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch):
                fit = fits.get(x.shape[1])
                k = len(fit.values) if fit else 0
                if not k:
                    continue
                z = (x - fit.mean) @ (fit.vectors / np.sqrt(fit.values))
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, fit.n, np.int64)),
                    pa.array([v for v in _deviations(x, fit) for _ in range(k)], pa.int64()),
                    pa.array(z.ravel()),
                    pa.array(np.tile(fit.values / fit.trace, len(at))),
                    pa.array(np.full(len(at) * k, fit.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Fit on the distinct vectors of a table and whiten all its rows."""
    rows = sound(vectors, vec_id, embedding)
    return whitened(rows, fitted(written(rows.select("x").distinct()), components))
