"""Near-duplicate vectors by spherical-cap filters from random product codes (Becker, Ducas, Gama, Laarhoven 2016).

A filter is a direction, and a vector passes it if their inner product reaches a limit, so that one random vector in
1 / PASS does. The directions are structured: in each of SETS random rotations, the dimensions are cut into two halves,
each with a random code, and every combination of a word of either code is a filter. Each vector is list-decoded to all
filters it passes without trying them one by one: only words that can still reach the limit with the best word of the
other half are combined. Vectors that share a filter are compared exactly.

Equal vectors are one class with a count. Filters that one class alone passes are dropped before vectors are fetched.
Long filters are split into blocks and each pair of blocks is compared in a task of its own, which returns a spanning
forest of the links it finds. As links stay within the components of these forests, the links of a vector are then
counted inside its component, again by pairs of blocks, each pair of vectors exactly once.

A vector passes about PASSED filters. Of these, a pair at a cosine of 0.9 shares five or so and a closer pair more;
recall against brute force is measured in the tests (over 0.95 at the limit itself). In low dimensions caps that narrow
would part near vectors, so there the limit is WIDEST and fewer filters do. PASS times the number of vectors should stay
small; it is a parameter of the index, not of the result's meaning.

Defined results: vectors that are null, empty or zero, or that hold a null or non-finite component, link with nothing;
vectors of different lengths never link; equal rows are linked like any equal vectors; a null id stays null, has its
links counted, and is kept only if it links with nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import components, paired_blocks, spanning, streamed, written

COSINE = 0.9
PASS, PASSED, SETS, WIDEST, SEED = 6e-7, 40, 64, 0.6, 5
BLOCK = 256


def _cap(dim: int, limit: float) -> float:
    """Share of the sphere within an inner product of `limit` or more of a direction."""
    if dim < 2:
        return 0.5
    angle = np.linspace(0.0, np.pi, 200_001)
    density = np.sin(angle) ** (dim - 2)
    return float(density[angle <= np.arccos(limit)].sum() / density.sum())


@lru_cache(maxsize=8)
def filters(dim: int, seed: int = SEED) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The limit and, per set, the rotation and the two codes, scaled so that a combination has length 1."""
    low, high = 0.0, WIDEST
    if _cap(dim, high) < PASS:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if _cap(dim, middle) > PASS else (low, middle)
    needed = PASSED / _cap(dim, high)
    sets = int(min(SETS, np.ceil(needed)))
    words, half = int(np.ceil(np.sqrt(needed / sets))), dim // 2
    draw, out = np.random.default_rng([seed, dim]), []
    for _ in range(sets):
        turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
        codes = []
        for size in (half, dim - half):
            c = draw.standard_normal((words, size))
            codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) * np.sqrt(0.5 if half else 1.0))
        out.append((turn, *codes))
    return high, out


def decoded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters that the rows of a matrix of unit vectors pass."""
    limit, sets = filters(units.shape[1])
    half, rows, found = units.shape[1] // 2, [], []
    for number, (turn, left, right) in enumerate(sets):
        z = units @ turn
        a, b = z[:, :half] @ left.T, z[:, half:] @ right.T
        best_a, best_b = a.max(1), b.max(1)
        can = np.flatnonzero(best_a + best_b >= limit)
        ra, ca = np.nonzero(a[can] >= (limit - best_b[can])[:, None])
        rb, cb = np.nonzero(b[can] >= (limit - best_a[can])[:, None])
        each = np.bincount(rb, minlength=len(can))
        first = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(can) else each
        times = each[ra]
        i = np.repeat(np.arange(len(ra)), times)
        j = first[ra[i]] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        row = can[ra[i]]
        hit = a[row, ca[i]] + b[row, cb[j]] >= limit
        rows.append(row[hit])
        found.append(((number * len(left) + ca[i]) * len(right) + cb[j])[hit])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision, one per row."""
    rows = np.array([np.asarray(v, np.float64) for v in column.to_pylist()])
    rows = rows / np.abs(rows).max(1, keepdims=True)  # lengths of very small and large vectors stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def posted(classes: DataFrame) -> DataFrame:
    """(rep, dim, filter) for each filter a class passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                reps, vectors = np.array(part.column(0).to_pylist(), np.int64), part.column(1)
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    row, number = decoded(_matrix(vectors.take(pa.array(at))))
                    columns = [reps[at[row]], np.full(len(row), dim, np.int32), number]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rep", "dim", "filter"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, dim int, filter long")


def _forests(cosine: float):
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        ids, x = group["rep"].to_pylist(), _matrix(group["vector"])
        yield from spanning(ids, x @ x.T >= cosine, np.array(group["own"].to_pylist()), group["low"][0].as_py(), group["high"][0].as_py())

    return run


def _counts(cosine: float):
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x = group["rep"].to_pylist(), _matrix(group["vector"])
        copies, own = np.array(group["copies"].to_pylist()), np.array(group["own"].to_pylist())
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if group["low"][0].as_py() != group["high"][0].as_py():
            linked &= own[:, None] != own[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(linked @ copies, pa.int64())], ["rep", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a class of null ids only, or several vectors under one id, would share a name: classes are named by number
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), F.col("rep").alias("least"), "copies", "vector"))
    named = classes.select(F.col("class").alias("rep"), "vector", "copies")

    passed = written(posted(named))
    shared = passed.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    lists = passed.join(shared, ["dim", "filter"]).join(named.select("rep", "vector"), "rep")
    met = paired_blocks(lists, "rep", F.ceil(F.col("n") / BLOCK)).select("dim", "filter", "low", "high", "own", "rep", "vector")
    found = written(components(streamed(met, ["dim", "filter", "low", "high"], _forests(cosine), "u long, v long")))

    members = named.join(found, F.col("rep") == F.col("node")).select("rep", "vector", "copies", "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    pairs = paired_blocks(members.join(sizes, "component"), "rep", F.ceil(F.col("n") / BLOCK), within=True)
    counted = streamed(pairs.drop("n"), ["component", "low", "high"], _counts(cosine), "rep long, links long")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    part = classes.select("class", "least").join(found, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("part"))
    lowest = part.groupBy("part").agg(F.min("least").alias("component_id"))
    told = part.join(lowest, "part").join(links, F.col("class") == F.col("rep"), "left").select("class", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    known = classes.join(told.withColumnRenamed("class", "of"), F.col("class") == F.col("of")).select(F.col("vector").alias("same"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))

    out = rows.join(known, F.col("vector") == F.col("same"), "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))
