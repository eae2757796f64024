"""Mixing sources to target weights with built-in functions only.

All words of a source, its documents in a pseudorandom order, are packed into blocks of a fixed length. The output is made
of shards of a fixed number of block slots; for each shard, the number of slots per source is a multinomial draw by the
targets. A source's slots are numbered through the shards; each number is mapped to a block by a pseudorandom permutation
of the source's block indexes, another one for each pass over the source, and slots and blocks are joined by index.

A draw alone would miss the targets by its variance and could pass over a source a fourth time, so slots drawn beyond a
source's quota are handed on to the sources that fell short; every quota is then met exactly.

Targets: sources by code point, null last, take the weights in turn and share all words; a target stops at `most` times
its source's size, and the excess is shared again by weight until none is above.

Defined results: null and empty texts have size 0 and none of them is taken; equal rows are told apart by number; reruns
agree, whatever the partitioning; an empty table gives an empty table; other columns are carried by `mixed` only.
The number of distinct sources is bounded: more than SOURCES raise an error, as their totals pass through the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import WORD, shuffled, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK, SLOTS, RUN = 64, 16_384, 2_048
ROUNDS = 24
SOURCES = 10_000
#: Documents to a bucket of the two-level running sum.
BUCKET = 1_024


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    quota: int


def water_filled(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of the total by weight, none above `most` times its size."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = total, sum(weights)
    for k, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * weight:  # this one and all after it fit
            for j in order[k:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = float(most * sizes[i])
        left -= targets[i]
        weight -= weights[i]
    return targets


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, print, size, copy): size in words, copy: number among equal rows. Written, as it is read often."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("print"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    equal = Window.partitionBy("doc_id", "source", "print", "size").orderBy("doc_id")
    return written(rows.withColumn("copy", F.row_number().over(equal)))


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> list[Source]:
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = water_filled([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    found = []
    for row, target in zip(totals, targets):
        blocks = math.ceil(row["size"] / block)
        quota = min(most * blocks, round(target * blocks / row["size"])) if row["size"] else 0
        found.append(Source(row["source"], row["size"], target, blocks, quota))
    return found


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """The rows that have words, with `start`, their first word's index in their source.

    Documents follow each other by a hash of their id. The running sum is taken within buckets of consecutive hashes and
    over the buckets' sums, so no task holds a whole source.
    """
    count = rows.count()
    buckets = 1 + count // BUCKET
    mixed = F.xxhash64("doc_id", "print", F.lit(seed))
    rows = rows.where("size > 0").withColumn("hash", mixed).withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 16), F.lit(buckets)))
    each = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "print", "copy").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum")).select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("base"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    start = (F.col("base") + F.coalesce(F.sum("size").over(each), F.lit(0))).alias("start")
    return rows.join(sums, same).select("doc_id", "source", "print", "copy", "size", start)


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key, for any n: swap-or-not rounds (Hoang, Morris, Rogaway 2012)."""

    def step(now: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - now, n)
        swap = F.xxhash64(key, i, F.greatest(now, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def slots(spark, found: list[Source], seed: int, slots_per_shard: int = SLOTS) -> DataFrame:
    """(shard, source, number, pass, block) for every slot of the output; source is the place in the list."""
    total = sum(s.quota for s in found)
    live = [i for i, s in enumerate(found) if s.quota]
    empty = spark.range(0).select(*[F.lit(0).cast("long").alias(c) for c in ("shard", "source", "number", "pass", "block")])
    if not live:
        return empty
    ends, at = [], 0
    for i in live:
        at += found[i].quota
        ends.append(at / total)
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]), lambda e: e <= u))
    draw = F.element_at(F.array(*[F.lit(i) for i in live]), place + 1)
    drawn = spark.range(total).select(F.floor(F.col("id") / slots_per_shard).alias("shard"), draw.cast("long").alias("source")).groupBy("shard", "source").agg(F.count("*").alias("n"))

    quota = F.element_at(F.array(*[F.lit(s.quota) for s in found]), (F.col("source") + 1).cast("int")).cast("long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = drawn.select("shard", "source", "n", before.alias("first")).withColumn("last", F.least(F.col("first") + F.col("n"), quota))
    # the few spans are cut into runs and dealt out before they become slots: Spark would take them for little work
    run = spans.where("last > first").select("shard", "source", "last", F.explode(F.sequence(F.col("first"), F.col("last") - 1, F.lit(RUN).cast("long"))).alias("low"))
    run = run.repartition(shuffled(spark), "shard", "source", "low")
    own = run.select("shard", "source", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + RUN, F.col("last")) - 1)).alias("number"))

    # slots beyond a quota, numbered through the shards, go to the numbers that the other sources still lack
    lost = spans.where("first + n > last").groupBy("shard").agg(F.sum(F.col("first") + F.col("n") - F.greatest("last", "first")).alias("free"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    lost = lost.select("shard", "free", F.coalesce(F.sum("free").over(upto), F.lit(0)).alias("base"))
    lost = lost.select("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("free") - 1)).alias("j"))
    all_sources = spark.createDataFrame([(i, found[i].quota) for i in live], "source long, quota long")
    had = drawn.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("had"))
    short = all_sources.join(had, F.col("source") == F.col("of"), "left").select("source", "quota", F.coalesce("had", F.lit(0)).alias("had")).where("had < quota")
    upto = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    short = short.select("source", "had", "quota", F.coalesce(F.sum(F.expr("quota - had")).over(upto), F.lit(0)).alias("base"))
    short = short.select("source", "had", "base", F.explode(F.sequence(F.col("had"), F.col("quota") - 1)).alias("number"))
    topped = lost.join(short.withColumn("j", F.expr("base + number - had")), "j").select("shard", "source", "number")

    both = own.union(topped)
    n = F.element_at(F.array(*[F.lit(s.blocks) for s in found]), (F.col("source") + 1).cast("int")).cast("long")
    turn = F.floor(F.col("number") / n)
    key = F.xxhash64(F.lit(seed), F.lit("order"), F.col("source"), turn)
    return both.select("shard", "source", "number", turn.alias("pass"), permuted(F.pmod("number", n), n, key).alias("block"))


def _named(source: Column, found: list[Source]) -> Column:
    """The place of a source in the list."""
    pairs = [F.lit(x) for i, s in enumerate(found) if s.name is not None for x in (s.name, i)]
    null = next((i for i, s in enumerate(found) if s.name is None), None)
    at = F.try_element_at(F.create_map(*pairs), source) if pairs else F.lit(None).cast("int")
    return F.when(source.isNull(), F.lit(null)).otherwise(at).cast("long")


def pieces(rows: DataFrame, found: list[Source], seed: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, print, copy, size, first, words, times) for each stretch of a document in one block; times: how often the mix takes the block."""
    at = placed(rows, seed).withColumn("s", _named(F.col("source"), found))
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    cut = at.withColumn("b", F.explode(span))
    low = F.greatest(F.col("start"), F.col("b") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block)
    cut = cut.select("doc_id", "source", "print", "copy", "size", "s", "b", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    taken = slots(rows.sparkSession, found, seed).groupBy(F.col("source").alias("of"), F.col("block").alias("k")).agg(F.count("*").alias("times"))
    # both sides grow with the words, though Spark would expect the slots to be few: no broadcast
    return cut.join(taken.hint("merge"), (F.col("s") == F.col("of")) & (F.col("b") == F.col("k"))).drop("s", "b", "of", "k")


KEY = ("doc_id", "source", "print", "copy", "size")


def _keyed(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the key of a row, nulls equal."""
    right = right.select(*[F.col(c).alias(f"_{c}") if c in KEY else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right.hint("merge"), same, how).drop(*[f"_{c}" for c in KEY])


def report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of documents."""
    rows = sized(docs)
    found = sources(rows)
    taken = pieces(rows, found, seed).groupBy(*KEY).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    s = (_named(F.col("source"), found) + 1).cast("int")
    sizes, targets = F.array(*[F.lit(x.size).cast("long") for x in found] or [F.lit(0)]), F.array(*[F.lit(x.target) for x in found] or [F.lit(0.0)])
    full = _keyed(rows, taken, "left")
    return full.select("doc_id", "source", "size", F.element_at(sizes, s).alias("source_size"), F.element_at(targets, s).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents: for every pass, each document with the words of it that were taken, in order and with the
    white space before them; a document taken whole keeps its text. `n_chars`, if there, is counted anew."""
    rows = sized(docs)
    found = sources(rows)
    taken = pieces(rows, found, seed).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    parts = taken.groupBy(*KEY, "pass").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("first", F.col("words").alias("n")))).alias("parts"))
    equal = Window.partitionBy("doc_id", "source", "print", "size").orderBy("doc_id")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("print"), size.alias("size"), F.struct(*docs.columns).alias("row"))
    joined = _keyed(own.withColumn("copy", F.row_number().over(equal)), parts, "inner")
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("spaced"), (p["first"] + 1).cast("int"), p["n"].cast("int")))), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(some)
    out = joined.withColumn("spaced", F.when(F.col("words") < F.col("size"), spaced)).select("row", text.alias("mixed"))
    counted = {"text": F.col("mixed")} | ({"n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[counted.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
