"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken 2003).

Texts are words. A window is `span` consecutive words of an item; an item of fewer words is one window. Of each window's
k-grams the one with the smallest hash is its fingerprint, the last of equal ones. It depends on the window alone, so every
window that a document shares with an item puts the same fingerprint into both: with k-grams of half a window none is
missed. Of a document, most neighbouring windows have the same one, so about two of seven words start a fingerprint.

Documents and windows are joined on fingerprints; a hit is extended by the words around it, as many as the windows it was
chosen for reach, and holds if they are a window's words, compared as they are, not by hash. Before the join fingerprints
that no item has are dropped by a Bloom filter of the items' ones: what is sent to the tasks is bounded by FILTER bits,
however many items there are, and a fuller filter only lets more rows reach the join.

A hit's row has a window, never an item: windows that the same items have are one set, found by sums of hashes over the items,
and documents with equal sets of sets share one list of items. So a passage that is common in documents and items is not
multiplied out.

Defined results: null, empty and blank texts have no words and no hits; rows repeated or without an id give a row each; items
without an id mark words but are not listed, items repeated under one id are listed once; empty documents give an empty table,
without items nothing is hit; other columns than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import written

SPAN = 10
#: Most bits of the filter, as a power of two, and bits for each fingerprint while there is room.
FILTER, BITS = 25, 16
#: Words a worker remembers the hash of; texts taken from a batch at once; words looked at together.
REMEMBERED, TEXTS, TOGETHER = 200_000, 256, 200_000
#: Everything but 0-9, a-z and the bytes of longer code points parts words; A-Z is lowered first.
_APART = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ODD = [np.uint64(2 * x + 1) for x in np.random.default_rng(11).integers(1, 1 << 62, 64)]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_APART).split() if text else []


def lengths(span: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window."""
    k = (span + 1) // 2
    return k, span - k + 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chosen(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first window, last window) for each k-gram that some windows of a row of words choose.

    Windows are numbered by their first word; a k-gram is chosen by neighbouring windows.
    """
    k, w = lengths(span)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = np.full(n + w - 1, span, np.uint64)
    for i in range(k):
        gram = _mixed(gram + hashes[i : i + n + w - 1] * _ODD[i % 64])
    least, at = gram[:n].copy(), np.arange(n)
    for i in range(1, w):
        later = gram[i : i + n]
        smaller = later <= least
        least[smaller] = later[smaller]
        at[smaller] = np.flatnonzero(smaller) + i
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return least[first], first, np.append(first[1:], n) - 1


def _places(found: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for shift in (0, 27):
        yield (found >> np.uint64(shift)) & np.uint64(bits - 1)


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, words, print, text) of the windows of (item_id, text); text: the window's words, parted by blanks."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                of = words(text)
                if not of:
                    continue
                size = min(span, len(of))
                prints, first, last = chosen(np.fromiter(map(memory.__getitem__, of), np.uint64, len(of)), size)
                each = np.repeat(prints.view(np.int64), last - first + 1)
                for low in range(0, len(each), 10_000):
                    part = each[low : low + 10_000]
                    texts = [b" ".join(of[s : s + size]) for s in range(low, low + len(part))]
                    ids = batch.column("item_id").take(pa.array(np.full(len(part), i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(part), size, np.int32)), pa.array(part), pa.array(texts, pa.binary())], ["item_id", "words", "print", "window"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words int, print long, window binary")


def bloom(prints: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits (a power of two) of the fingerprints; eight bytes of it for each row that reaches the driver."""
    both = F.explode(F.array(*[F.expr(f"shiftrightunsigned(print, {s}) & {bits - 1}L") for s in (0, 27)]))
    cells = prints.select(both.alias("bit")).select(F.shiftright("bit", 6).alias("cell"), F.expr("shiftleft(1L, cast(bit & 63L as int))").alias("mask"))
    found = np.zeros(max(bits >> 6, 1), np.uint64)
    for row in cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).collect():
        found[row["cell"]] = np.uint64(row["mask"] & 0xFFFFFFFFFFFFFFFF)
    return found


def suspects(docs: DataFrame, spans: list[int], sieve: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, at, words, print, around) for fingerprints that the filter lets through, and one row with null in
    the last four for each document.

    at: the first window that chose it; around: the words of all windows that did.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = len(sieve) << 6

    def passing(found: np.ndarray) -> np.ndarray:
        at = np.ones(len(found), bool)
        for place in _places(found, bits):
            at &= (sieve[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return np.flatnonzero(at)

    def told(batch: pa.RecordBatch, counts: list[int], rows: list[tuple], start: int) -> pa.RecordBatch:
        """rows: (document of this batch, at, words, print, around)."""
        own = pa.array([*range(start, start + len(counts)), *(r[0] for r in rows)], pa.int64())
        n = np.zeros(batch.num_rows, np.int64)
        n[start : start + len(counts)] = counts
        blank = [None] * len(counts)
        columns = [batch.column("row").take(own), batch.column("doc_id").take(own), pa.array(n).take(own)]
        columns += [pa.array([*blank, *(r[i] for r in rows)], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "at", "words", "print", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()

        def found(of: list[bytes], ends: np.ndarray, first_doc: int) -> Iterator[tuple]:
            """Rows of texts laid end to end; windows that reach over an end are none."""
            hashes = np.fromiter(map(memory.__getitem__, of), np.uint64, len(of))
            starts = np.concatenate([[0], ends[:-1]])
            for span in spans:
                prints, low, high = chosen(hashes, span)
                kept = passing(prints)
                for p, a, b in zip(prints[kept].view(np.int64).tolist(), low[kept].tolist(), high[kept].tolist()):
                    doc = int(np.searchsorted(ends, a, "right"))
                    while a <= b and doc < len(ends):  # the windows of each text that chose it
                        a = max(a, int(starts[doc]))
                        z = min(b, int(ends[doc]) - span)
                        if a <= z:
                            yield first_doc + doc, a - int(starts[doc]), span, p, b" ".join(of[a : z + span])
                        a, doc = int(ends[doc]), doc + 1

        for batch in (b.slice(low, TEXTS) for b in batches for low in range(0, b.num_rows, TEXTS)):
            of, ends, start = [], [], 0
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                of += words(text.as_py())
                ends.append(len(of))
                if len(of) >= TOGETHER or i + 1 == batch.num_rows:
                    limits = np.array(ends)
                    yield told(batch, np.diff(limits, prepend=0).tolist(), list(found(of, limits, start)), start)
                    of, ends, start = [], [], i + 1

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, at long, words int, print long, around binary")


def matched(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, runs, items) per row of (doc_id, text): runs are the numbers of the first and last word of each stretch
    of words that windows of items cover; items are the ids of those that have a window there, sorted as text."""
    each = written(windows(items, span))
    print_of = F.expr("xxhash64(item_id)").cast("decimal(20,0)"), F.expr("xxhash64(item_id, 7)").cast("decimal(20,0)")
    # items of equal windows: number and two sums of hashes of their ids
    listed = each.select("window", "words", "print", "item_id").distinct().groupBy("window", "words", "print")
    spread = written(listed.agg(F.count("item_id").alias("n"), *[F.coalesce(F.sum(F.when(F.col("item_id").isNotNull(), p)).cast("string"), F.lit("")).alias(f"s{i}") for i, p in enumerate(print_of)]))
    alike = F.concat_ws("/", "n", "s0", "s1")
    held = written(spread.select("window", "words", "print", F.sha2(alike, 256).alias("set")))
    first = spread.where("n > 0").groupBy(F.sha2(alike, 256).alias("set")).agg(F.min("window").alias("window"))
    members = each.where("item_id is not null").join(first, "window").select("set", "item_id").distinct()

    sizes = sorted(r["words"] for r in held.select("words").distinct().collect())
    prints = held.select("print").distinct()
    bits = 1 << min(FILTER, max(10, (prints.count() * BITS).bit_length()))
    rows = written(suspects(docs, sizes, bloom(prints, bits)))

    # a shared fingerprint, extended to each window it was chosen for
    part = F.split(F.col("around").cast("string"), " ")
    wide = rows.where("print is not null").select("row", "at", "words", "print", part.alias("around"))
    one = wide.select("row", "at", "words", "print", "around", F.explode(F.sequence(F.lit(0), F.size("around") - F.col("words"))).alias("next"))
    looked = one.select("row", (F.col("at") + F.col("next")).alias("at"), "words", "print", F.array_join(F.slice("around", F.col("next") + 1, F.col("words")), " ").cast("binary").alias("window"))
    hits = looked.join(held, ["print", "words", "window"]).select("row", "at", "words", "set")

    by_row = Window.partitionBy("row").orderBy("at", "words")
    reach = F.max(F.col("at") + F.col("words")).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.select("row", "at", "words", "set", F.when(F.col("at") <= reach, 0).otherwise(1).alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("at").alias("first"), (F.max(F.col("at") + F.col("words")) - 1).alias("last"), F.collect_set("set").alias("sets"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    runs = written(runs.withColumn("lists", F.sha2(F.array_join("sets", ""), 256)))

    lists = runs.groupBy("lists").agg(F.first("sets").alias("sets")).select("lists", F.explode("sets").alias("set"))
    named = lists.join(members, "set").groupBy("lists").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    known = runs.join(named, "lists", "left").select(F.col("row").alias("of"), "runs", "items")
    out = rows.where("print is null").join(known, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "n_words", F.coalesce("runs", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")).alias("runs"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, share: float = 0.0) -> DataFrame:
    """The documents, with the columns they came with, of whose words at most a share lies in stretches that items cover."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    numbered = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    return matched(numbered, items, span).where(hit <= share * F.col("n_words")).select("doc_id.*")
