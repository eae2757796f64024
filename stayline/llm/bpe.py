"""Byte-level BPE by overlapping chunks.

Texts are cut into chunks that overlap, and the chunks are split by the vocabulary's pattern in parallel, each as if it
were a text of its own. The pattern looks ahead but never back, so once a boundary of one chunk is also a boundary of the
next, both agree from there on: neighbours are stitched at the first such place. The stitched pieces are then encoded
chunk by chunk. Decoding concatenates the bytes of the ids.

A text of one chunk needs no stitching and no shuffle. A text whose chunks nowhere agree within an overlap (one piece
longer than that) is split as a whole.

Defined results: null and empty texts have no ids; repeated rows stay as many rows; rows with a null id are encoded like
others; an empty table gives an empty table; other columns than the id and the text are not read.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import written

#: Code points of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 65_536, 1_024
#: Boundaries closer than this to the end of a chunk are not trusted: an alternative of the pattern may be cut there.
MARGIN = 8
#: Pieces whose ids a worker remembers.
REMEMBERED = 150_000


class Pieces(dict):
    """Ids of a piece by the piece; emptied when full."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoding.encode_ordinary(piece)
        self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def loaded(ranks: str, pattern: str):
    """The encoding, its splitter and its memory, once per Python worker."""
    import regex
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return encoding, regex.compile(pattern), Pieces(encoding)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def _ids(pieces: list[str], memory: Pieces) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(map(memory.__getitem__, pieces)), np.int32)


def _encoder(ranks: str, pattern: str):
    """Batches of (key, text) to (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, splitter, memory = loaded(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [_ids(splitter.findall(t or ""), memory) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["doc_id", "ids"])

    return run


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    final = F.floor((F.length("text") - 1) / chunk).cast("int")
    rows = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", final.alias("final"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("final"))).alias("chunk"))
    part: Column = F.substring(F.col("text"), F.col("chunk") * chunk + 1, F.lit(chunk + overlap))
    return rows.select("doc_id", "row", "chunk", (F.col("chunk") == F.col("final")).alias("last"), part.alias("part"))


def _boundaries(pattern: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, splitter, _ = loaded(ranks, pattern)
        for batch in batches:
            starts = [np.fromiter((m.start() for m in splitter.finditer(t)), np.int32) for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(starts)], [*batch.schema.names, "starts"])

    return run


def _cut_encoder(ranks: str, pattern: str):
    """Encode the pieces of a chunk from its cut to the cut it shares with the next chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, memory = loaded(ranks, pattern)
        for batch in batches:
            ids = []
            for row in batch.select(["part", "starts", "from", "to"]).to_pylist():
                end = len(row["part"]) if row["to"] is None else row["to"]
                own = [s for s in row["starts"] if row["from"] <= s < end]
                ids.append(_ids([row["part"][a:b] for a, b in zip(own, [*own[1:], end])], memory))
            keys = [batch.column(n) for n in ("doc_id", "row", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, _lists(ids)], ["doc_id", "row", "chunk", "ids"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) per row of (doc_id, text); ranks: path of the rank file, on every machine."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.where(F.length("text") <= chunk).mapInArrow(_encoder(ranks, pattern), f"doc_id {kind}, ids array<int>")

    # the chunks of long texts are written with their boundaries, so that nothing is split twice and row numbers stay
    parts = _chunks(docs.where(F.length("text") > chunk), chunk, overlap).repartition("row", "chunk")
    split = written(parts.mapInArrow(_boundaries(pattern, ranks), f"doc_id {kind}, row long, chunk int, last boolean, part string, starts array<int>"))
    tail = F.transform(F.filter("starts", lambda s: (s >= chunk) & (s <= chunk + overlap - MARGIN)), lambda s: s - chunk)
    tails = split.where("not last").select("row", (F.col("chunk") + 1).alias("chunk"), tail.alias("tail"))
    heads = split.where("chunk > 0").select("row", "chunk", F.filter("starts", lambda s: s <= overlap - MARGIN).alias("head"))
    met = written(tails.join(heads, ["row", "chunk"]).select("row", "chunk", F.array_min(F.array_intersect("tail", "head")).alias("cut")))
    lost = met.where("cut is null").select("row").distinct()

    begin = met.select("row", "chunk", F.col("cut").alias("from"))
    end = met.select("row", (F.col("chunk") - 1).alias("chunk"), (F.col("cut") + chunk).alias("to"))
    own = split.join(begin, ["row", "chunk"], "left").join(end, ["row", "chunk"], "left").join(lost, "row", "left_anti")
    own = own.select("doc_id", "row", "chunk", "part", "starts", F.coalesce("from", F.lit(0)).alias("from"), "to")
    ready = own.mapInArrow(_cut_encoder(ranks, pattern), f"doc_id {kind}, row long, chunk int, ids array<int>")
    stitched = ready.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
    # no common boundary within an overlap: the text is put together again and split as a whole
    again = split.join(lost, "row").select("row", "doc_id", "chunk", F.when(F.col("last"), F.col("part")).otherwise(F.substring("part", 1, chunk)).alias("part"))
    again = again.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "part"))).getField("part"), "").alias("text"))
    whole = again.select("doc_id", "text").mapInArrow(_encoder(ranks, pattern), f"doc_id {kind}, ids array<int>")
    return short.union(stitched.select("doc_id", F.flatten(F.col("all.ids")).alias("ids"))).union(whole)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows with `bytes`: the bytes of all ids, concatenated."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _, _ = loaded(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = [encoding.decode_bytes(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "bytes"])

    return encoded.mapInArrow(run, f"{kinds}, bytes binary")
