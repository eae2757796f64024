"""Consecutive numbers of rows in a total order, without a window over all rows.

Ranges of the order are found from a fixed number of rows, the ones whose hashes are smallest, so they depend on the rows
alone, whatever task reads them in whatever order. Rows are counted by range, numbered inside their range, and shifted by
the counts of the ranges before. What one task holds is one range; the counts are RANGES numbers.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and rows they are taken from.
RANGES, SAMPLE = 64, 1024


def range_limits(keyed: DataFrame, key: str, mark: str, ranges: int = RANGES, sample: int = SAMPLE) -> Column:
    """An array of less than `ranges` keys, rising, that part the rows into ranges of about equal size; a scalar."""
    drawn = keyed.select(key, mark).orderBy(mark, key).limit(sample).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    steps = F.sequence(F.lit(1), F.lit(ranges - 1))
    limits = F.transform(steps, lambda i: F.get("keys", F.floor(i * F.size("keys") / ranges).cast("int")))
    return drawn.select(F.array_distinct(F.when(F.size("keys") > 0, limits).otherwise(F.slice("keys", 1, 0)))).scalar()


def numbered(df: DataFrame, by: Sequence[Column], name: str = "order", ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """The rows with their place in the order, from 1 on. `by`: expressions that rise, missing ones first; where they do not
    tell rows apart, the columns do, in the order they stand in."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    ties = [c for c, (_, kind) in zip(columns, df.dtypes) if not kind.startswith("map")]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*by, *ties])])
    # the mark reads every column: so all three uses of the rows ask for the same ones, and they are made once
    keyed = df.withColumns({"__key": key, "__mark": F.xxhash64(*ties)})
    limits = range_limits(keyed, "__key", "__mark", ranges, sample)
    ranged = keyed.withColumn("__limits", limits).withColumn("__range", F.size(F.filter("__limits", lambda low: low <= F.col("__key"))))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("__mark").alias("mark")).where("mark is not null")
    sizes = counts.agg(F.collect_list(F.struct(F.col("__range").alias("range"), "n"))).scalar()
    before = F.aggregate(F.filter("__sizes", lambda s: s["range"] < F.col("__range")), F.lit(0).cast("bigint"), lambda n, s: n + s["n"])
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__key"))
    return ranged.withColumns({"__place": place, "__sizes": sizes}).select(*columns, (before + F.col("__place")).alias(name))
