"""What several operators share: words, shared folders, written tables, group streams, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.sources.tables import new_path

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lowered; bytes.split() parts at exactly the six characters WORD leaves out."""
    return (text or "").encode("utf-8", "replace").lower().split()


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same as `written`, dealt into buckets by a key: a join on it leaves these rows where they are."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "llm")
    name = f"llm_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffled(spark), key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def streamed(df: DataFrame, keys: list[str], function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function to each group of equal keys, many small groups to a task without a call into Spark for each.

    Rows are dealt by the keys and sorted in each partition; a group is handed over as one Arrow table, so callers keep
    groups bounded by splitting large ones into numbered blocks.
    """
    dealt = df.repartition(shuffled(df.sparkSession), *keys).sortWithinPartitions(*keys)
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in places]
            start = 0
            for i, key in enumerate(zip(*columns)):
                if key != last:
                    if i > start:
                        kept.append(batch.slice(start, i - start))
                    if kept:
                        yield from function(pa.Table.from_batches(kept))
                    kept, start, last = [], i, key
            if batch.num_rows > start:
                kept.append(batch.slice(start))
        if kept:
            yield from function(pa.Table.from_batches(kept))

    return dealt.mapInArrow(run, schema)


def paired_blocks(members: DataFrame, member: str, blocks: Column, within: bool = False) -> DataFrame:
    """Split groups into numbered blocks and hand every pair of blocks to one task: adds `own`, the member's block, and
    `low` and `high`, the pair.

    `blocks` is a column with the group's number of blocks. A group of one block stays as it is; in a larger one each
    member goes to every pair its block is part of, so any two members meet in some pair. With `within`, the pairs of a
    block with itself are tasks too, so members of one block need not be compared in the others.
    """
    own = F.pmod(F.xxhash64(member, F.lit(17)), blocks)
    every = F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))
    others = every if within else F.when(blocks == 1, every).otherwise(F.filter(every, lambda x: x != F.col("own")))
    met = members.withColumn("own", own.cast("long")).withColumn("other", F.explode(others))
    return met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row it is connected with (itself, if it is the first)."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i] = True
            front = reached
            while front.any():
                front = linked[front].any(0) & ~reached
                reached |= front
            root[reached & (root < 0)] = i
    return root


def spanning(ids: list[int], linked: np.ndarray, own: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect what a pair of blocks connects, as few as it takes.

    The links inside a block show in every pair it is part of; they are returned by one pair only, block 0's by (0, 1) and
    any other's by (0, block). Every pair returns what joins the parts that its blocks are in already.
    """
    place = np.arange(len(ids))
    root = forest(linked)
    at, to = np.flatnonzero(root != place), root
    if low != high:
        inside = forest(linked & (own[:, None] == own[None, :]))
        first = inside == place
        told = ~first & (low == 0) & ((own == high) | (high == 1))
        at = np.flatnonzero(told | (first & (root != place)))
        to = np.where(first, root, inside)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([ids[to[i]] for i in at], pa.int64())], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u, v): one row (node, component) per node that has an edge to another.

    Alternating star contraction: every node hands its larger neighbours to its smallest one, then its smaller
    neighbours likewise, until nothing changes. The smallest neighbour is an aggregate with map-side combine and comes
    back by a join, so a node with very many edges is never gathered; each round is written to the shared folder.
    """

    def stars(small: DataFrame, lowest: DataFrame) -> DataFrame:
        return written(small.union(lowest).where("u <> v").distinct())

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    none = edges.select("u", "v").limit(0)
    now = stars(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), none)
    seen = print_of(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stars(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), low.select("u", "m"))
        after = print_of(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("c")), F.struct(F.col("v").alias("node"), F.col("v").alias("c")))).alias("e"))
    return ends.groupBy("e.node").agg(F.min("e.c").alias("component"))
