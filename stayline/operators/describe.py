"""Descriptive statistics: describe, means, histograms, correlations."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.operators import comoments

QUARTILES = (0.25, 0.5, 0.75)
#: Columns whose correlations are built-in aggregates, one per pair.
FEW = 16
#: Size of a quantile sketch, and how many times its error (at 99 % confidence) a bracket reaches to either side.
SKETCH, SLACK = 4096, 5
#: Error of a rank, as a share of the values, that a sketch of that size keeps to in 99 of 100 cases.
RANK_ERROR = 2.296 / SKETCH**0.9723


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per present value: (by…, column, value)."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*by, F.explode(cells).alias("cell"))
        .select(*by, "cell.*")
        .where(F.col("value").isNotNull())
    )


def _same(keys: Sequence[str], prefix: str):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


# --- quantiles ---------------------------------------------------------------
def _sound(value: Column) -> Column:
    """The value, unless it is none that a sketch takes (NaN sorts behind all others)."""
    return F.when(~F.isnan(value), value)


def _span(value: Column) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(_sound(value)).alias("sketched"),
        F.kll_sketch_agg_double(_sound(value), SKETCH).alias("sketch"),
    ]


def value_spans(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, ends and mergeable sketch of the values per key group."""
    return long.groupBy(*keys).agg(*_span(F.col("value")))


def column_spans(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """`value_spans` of several columns at once, with mean and deviation, one aggregate over the rows as they are."""

    def spans(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *_span(value))

    wide = df.groupBy(*by).agg(*[spans(c).alias(f"__{i}") for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(F.array(*[f"__{i}" for i in range(len(columns))])).alias("span")).select(*by, "span.*")


def exact_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float] = QUARTILES, spans: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation of `value` per key group: one column `q0`, `q1`, … for each of `probs`.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer. Here a mergeable sketch of fixed size (`value_spans`, or the given
    `spans`) encloses each quantile in a bracket, SLACK times as wide as the
    sketch's error. One pass then counts all values: those in a bracket one by
    one, the others by the gap they fall in, and the running count over that
    small table finds the exact ranks. A rank that falls into a gap, which a
    bracket as wide as that does not allow, is an error, never a wrong value.

    Sketches are random, so what they say is used in one place only: the counts
    carry their order (`cell`) and their group's exact count with them.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    spans = value_spans(long, keys) if spans is None else spans
    n, value = F.col("count"), F.col("value")
    rank = [F.floor((n - 1) * p) for p in probs]

    reach = SLACK * RANK_ERROR + 2 / SKETCH

    def edge(share: float, end: str) -> Column:
        """The sketch's value at a share of the values; the end of them for few values, and where some are not in the sketch."""
        if not 0 < share < 1:
            return F.col(end)
        within = F.kll_sketch_get_quantile_double("sketch", F.lit(share))
        return F.when((n > SKETCH) & (n == F.col("sketched")), within).otherwise(F.col(end))

    brackets = spans.where("count > 0").select(
        *[F.col(k).alias(f"t_{k}") for k in keys],
        "count",
        F.array(*[edge(p - reach, "min") for p in probs]).alias("lows"),
        F.array(*[edge(p + reach, "max") for p in probs]).alias("highs"),
    )
    # a group per numeric column is a few rows; with other keys too, Spark measures the size itself
    met = long.join(F.broadcast(brackets) if keys == ["column"] else brackets, _same(keys, "t_"))
    passed = F.size(F.filter("lows", lambda low: low <= value)), F.size(F.filter("highs", lambda high: high < value))
    within = passed[0] > passed[1]
    counts = met.groupBy(*keys, "count", (passed[0] + passed[1]).alias("cell"), F.when(within, value).alias("at"), within.alias("told")).agg(F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy(*keys).orderBy("cell", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("last", F.sum("copies").over(upto))

    def at(rank: Column) -> Column:
        holds = (F.col("last") - F.col("copies") <= rank) & (rank < F.col("last"))
        missed = F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")
        return F.max(F.when(holds, F.when(F.col("told"), F.col("at")).otherwise(missed)))

    ends = placed.groupBy(*keys, "count").agg(*[at(r + shift).alias(f"{side}{i}") for i, r in enumerate(rank) for side, shift in (("a", 0), ("b", 1))])

    def exact(i: int, p: float) -> Column:
        a, b, part = F.col(f"a{i}"), F.col(f"b{i}"), (n - 1) * p - rank[i]
        return F.when(part > 0, a + (b - a) * part).otherwise(a)

    return ends.select(*keys, *[exact(i, p).alias(f"q{i}") for i, p in enumerate(probs)])


# --- tables ------------------------------------------------------------------
def describe(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column (and group)."""
    by = list(by)
    columns = list(columns or [c for c in numeric_columns(df) if c not in by])
    keys = [*by, "column"]
    # both uses of the first pass ask for all it has, so it is made once
    basic = column_spans(df, columns, by).where("count = 0 OR mean IS NOT NULL AND sketch IS NOT NULL AND (count = 1 OR std IS NOT NULL)")
    found = exact_quantiles(long_form(df, columns, by), keys, QUARTILES, basic).withColumnsRenamed({k: f"q_{k}" for k in keys})
    names = [F.col(f"q{i}").alias(f"p{int(p * 100)}") for i, p in enumerate(QUARTILES)]
    return basic.join(found, _same(keys, "q_"), "left").select(*keys, "count", "mean", "std", "min", *names, "max")


def grouped_means(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column per group."""
    columns = list(columns or [c for c in numeric_columns(df) if c != by])
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in long form.

    Each pair uses the rows where both are present. A constant column has no
    correlation (NULL) rather than a division by zero. Up to FEW columns are
    one built-in aggregate; more go by `comoments`, in one pass too.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) > FEW:
        return comoments.correlations(df, columns)
    x = {c: F.col(c).cast("double") for c in columns}

    def pair(a: str, b: str):
        both_a = F.when(x[b].isNotNull(), x[a])
        both_b = F.when(x[a].isNotNull(), x[b])
        return F.try_divide(F.covar_pop(x[a], x[b]), F.stddev_pop(both_a) * F.stddev_pop(both_b))

    # one aggregate per unordered pair; both orders are read from it
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[pair(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entry = {}
    for i, (a, b) in enumerate(pairs):
        entry[(a, b)] = entry[(b, a)] = F.col(f"r{i}")
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), entry[(a, b)].alias("r"))
        for a in columns
        for b in columns
    ]
    return one.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins per numeric column; the last bin is closed.

    The ends of all columns are one row, which goes to the second pass as a
    scalar: no join. A constant column is spread over one unit around its value.
    """
    columns = list(columns or numeric_columns(df))
    value = [F.col(c).cast("double") for c in columns]
    ends = df.agg(F.struct(*[f(v).alias(f"{name}{i}") for i, v in enumerate(value) for name, f in (("a", F.min), ("b", F.max))]).alias("ends"))

    def cell(i: int) -> Column:
        a, b = F.col(f"__ends.a{i}"), F.col(f"__ends.b{i}")
        lo, hi = F.when(a == b, a - 0.5).otherwise(a), F.when(a == b, b + 0.5).otherwise(b)
        place = F.least(F.width_bucket(value[i], lo, hi, F.lit(bins)), F.lit(bins))
        return F.struct(F.lit(columns[i]).alias("column"), lo.alias("lo"), hi.alias("hi"), place.alias("bin"))

    cells = F.explode(F.array(*[F.when(v.isNotNull(), cell(i)) for i, v in enumerate(value)])).alias("cell")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (
        df.withColumn("__ends", ends.scalar())
        .select(cells)
        .where("cell IS NOT NULL")
        .groupBy("cell.column", "cell.lo", "cell.hi", "cell.bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column",
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * width).alias("from"),
            (F.col("lo") + F.col("bin") * width).alias("to"),
            "n",
        )
    )
