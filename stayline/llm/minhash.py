"""Near-duplicate texts by an inverted join of MinHash coordinates.

A text is the set of its word shingles. Its signature is posted under each (coordinate, value) pair; two texts are
candidates if enough of the COORDINATES collide. Counting is kept small by two rules that lose none of them:

* skip: a pair that one text alone is posted under cannot collide and is left out; a text with too few pairs
  left can have no partner and is left out whole;
* prefix: of the c pairs that a text has left, ordered from the rarest to the most common, any partner shares one of
  the first c - enough + 1. Only those lists are merged.

Within a list the collisions of full signatures are counted; texts that collide enough, directly or through others,
form a candidate group. The groups' full shingle sets are then compared exactly. Long lists and large groups are split
into blocks and every pair of blocks is compared in a task of its own; from each comparison only a spanning forest is
returned, so no group is gathered and its pairs are never written out. Texts of equal sets are one class throughout.

`enough` is set so that a link at the limit itself is missed with a probability of MISSED at most, and ever more rarely
above it.

Defined results: null texts and texts without words have an empty set, link with nothing and are kept; rows repeated
under one id share its component and are kept or dropped together; a row with a null id is kept only if no other text
is equal to it; an empty table gives an empty table; other columns than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import components, paired_blocks, spanning, streamed, words, written

SHINGLE, PERCENT = 5, 80
COORDINATES = 64
#: How often a link at the limit itself may fail to collide enough.
MISSED = 1 / 4000
#: Words a worker remembers the hash of; texts it takes from a batch at once.
REMEMBERED, TEXTS = 200_000, 256
#: Texts of a block of a posting list, and of a group; shingles of a block of a group.
LIST, BLOCK, SHINGLES = 256, 128, 500_000

_DRAW = np.random.default_rng(20)
_PLACE = _DRAW.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _DRAW.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, 1024, dtype=np.uint64)


def enough(percent: int, coordinates: int) -> int:
    """The most collisions that two sets of the similarity `percent` fall short of with a probability of MISSED at most."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > MISSED:
            return max(1, k)
    return coordinates


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, memory: dict, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; of fewer words than `width`, one of the whole sequence."""
    of = words(text)
    if not of:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, of), np.uint64, len(of))
    n = min(width, len(of))
    total = np.full(len(of) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total + h[k : len(h) - n + 1 + k] * _PLACE[k % 64])
    return np.unique(total)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        part = found[start : start + 2048, None] * _FACTOR[:coordinates] + _SHIFT[:coordinates]
        np.minimum(least, part.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _fingerprint(found: np.ndarray) -> str:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def signed(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, print, signature) per row; print identifies the set, null if it is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in (b.slice(low, TEXTS) for b in batches for low in range(0, b.num_rows, TEXTS)):
            found = [shingles(t.as_py(), memory, width) for t in batch.column(1)]
            signatures = np.concatenate([signature(s, coordinates) for s in found]) if found else np.empty(0, np.int32)
            ends = np.arange(0, len(signatures) + 1, coordinates, dtype=np.int32)
            columns = [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([_fingerprint(s) if len(s) else None for s in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signatures))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, print string, signature array<int>")


def _pair(group: pa.Table) -> tuple[np.ndarray, int, int]:
    return np.array(group["own"].to_pylist()), group["low"][0].as_py(), group["high"][0].as_py()


def candidates(classes: DataFrame, matches: int, block: int = LIST) -> DataFrame:
    """Spanning forests (u, v) of the classes (rep, signature) that collide in at least `matches` coordinates."""
    pairs = classes.select("rep", F.posexplode("signature").alias("at", "value"))
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = pairs.select("rep", token.alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    left = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("all"))
    prefix = left.where(F.size("all") >= matches).select("rep", F.explode(F.slice("all", F.lit(1), F.size("all") - matches + 1)).alias("of"))
    lists = written(prefix.select("rep", "of.token").join(classes.select("rep", "signature"), "rep"))
    sizes = lists.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    members = paired_blocks(lists.join(sizes, "token"), "rep", F.ceil(F.col("n") / block)).drop("n")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        ids = group["rep"].to_pylist()
        marks = np.array(group["signature"].combine_chunks().flatten()).reshape(len(ids), -1)
        linked = np.zeros((len(ids), len(ids)), bool)
        for i in range(len(ids)):
            linked[i] = (marks == marks[i]).sum(1) >= matches
        yield from spanning(ids, linked, *_pair(group))

    return streamed(members, ["token", "low", "high"], run, "u long, v long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets without repeats, by a product of incidence matrices in column blocks."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
    met = times[inverse] > 1  # what one set alone holds meets nothing
    column = np.cumsum(times > 1) - 1
    inverse, owner = column[inverse[met]], owner[met]
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    found = np.zeros((n, n), np.float64)
    width = 4096
    for low in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        a, b = np.searchsorted(inverse, [low, low + width])
        held = np.zeros((n, width), np.float32)
        held[owner[a:b], inverse[a:b] - low] = 1
        found += held @ held.T
    return found


def verified(docs: DataFrame, groups: DataFrame, width: int, percent: int, block: int = BLOCK, room: int = SHINGLES) -> DataFrame:
    """Spanning forests (u, v) of the links within groups (rep, print, component), on full sets."""
    wanted = groups.select(F.col("rep"), F.col("print").alias("of"), "component")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "of", "component", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in (b.slice(low, TEXTS) for b in batches for low in range(0, b.num_rows, TEXTS)):
            rows = []
            for rep, of, component, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, memory, width)
                if _fingerprint(found) == of:  # else another text under the same id
                    rows.append((rep, of, component, len(found), found.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, kinds)], ["rep", "of", "component", "n", "held"])

    held = texts.mapInArrow(sets, "rep long, of string, component long, n long, held binary")
    held = written(held.dropDuplicates(["rep", "of"]))  # a row may be repeated
    sizes = held.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("sum"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("sum") / room))
    met = paired_blocks(held.join(sizes, "component"), "rep", blocks).drop("members", "sum")

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        ids = group["rep"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in group["held"].to_pylist()]
        both = overlaps(sets)
        n = np.array([len(s) for s in sets], np.float64)
        yield from spanning(ids, 100 * both >= percent * (n[:, None] + n[None, :] - both), *_pair(group))

    return streamed(met, ["component", "low", "high"], run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of (doc_id, text); doc_id is a long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signed(docs, width, coordinates))
    classes = rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = written(classes)
    named = classes.where("rep is not null")
    groups = components(candidates(named, enough(percent, coordinates)))
    found = components(verified(docs, named.join(groups, F.col("rep") == F.col("node")).select("rep", "print", "component"), width, percent))
    merged = classes.select("print", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("print").alias("of"), F.coalesce("component", "rep").alias("component"))
    told = rows.select("doc_id", "n_shingles", "print").join(merged, F.col("print") == F.col("of"), "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = told.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def filtered(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns they came with."""
    gone = near_duplicates(docs, percent=percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
