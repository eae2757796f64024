"""Joins that stay balanced when a few keys hold most of the rows."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 1000
LANES = 256


def heaviest(counts: DataFrame, keys: Sequence[str], weight: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold more than `share` of the total weight each: fewer than 1 / share rows, none without skew."""
    total = counts.agg(F.sum(weight)).scalar()
    return counts.where(F.col(weight) > total * F.lit(share)).select(*keys)


def common_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that more than `share` of the rows bear each, in one aggregate over the rows.

    A sketch of fixed size counts them; it is off by less than a quarter of `share`, so a key just around it may be
    listed or not. That decides how rows travel, never which.
    """
    most = int(1 / share)
    top = df.agg(F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(16 * most)).alias("top"), F.count(F.lit(1)).alias("n"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("n") * share).select(F.col("t.item").alias(key))


def look_up(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    heavy: DataFrame,
    spread_by: Sequence[str],
    nulls_match: bool = False,
) -> DataFrame:
    """Left join that splits the heaviest keys of `left` over many tasks.

    `heavy` lists those keys (see `heaviest`, `common_keys`). Their left rows are dealt by
    `spread_by` into lanes, and their right rows are copied into every lane, so
    the join meets on key and lane. All other keys use lane 0 and are not
    copied. No row of either side is left out.

    `heavy` holds fewer than 1 / HEAVY_SHARE rows, so its broadcast and, for a right
    side with one row per key, the copies stay the same however large the data.
    """
    values = [c for c in right.columns if c not in keys]

    def same(a: str, b: str):
        return F.col(a).eqNullSafe(F.col(b)) if nulls_match else F.col(a) == F.col(b)

    def matched(prefix: str, other: str):
        return reduce(lambda x, y: x & y, [same(f"{prefix}{k}", f"{other}{k}") for k in keys])

    marks = F.broadcast(heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))
    marked_names = [f"__h_{k}" for k in keys]
    dealt = F.pmod(F.hash(*spread_by), F.lit(LANES))
    lane = F.when(F.col("__hot"), dealt)
    if not nulls_match:  # a missing key matches nothing, so it may go anywhere
        lane = lane.when(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]), dealt)
    spread = left.join(marks, matched("", "__h_"), "left").withColumn("__lane", lane.otherwise(F.lit(0)))

    lanes = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(LANES - 1))).otherwise(F.array(F.lit(0)))
    copied = (
        right.join(marks, matched("", "__h_"), "left")
        .drop(*marked_names)
        .withColumn("__r_lane", F.explode(lanes))
        .drop("__hot")
        .withColumnsRenamed({k: f"__r_{k}" for k in keys})
    )
    joined = spread.join(copied, matched("", "__r_") & (F.col("__lane") == F.col("__r_lane")), "left")
    return joined.select(*left.columns, *values)
