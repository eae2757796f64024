"""Who drove with whom: legs, pairs, and each person's co-driver history."""

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline import constants as K
from stayline.functions import scalars as S
from stayline.operators.joins import heaviest, look_up

EXCLUDED_CLASS = "SOLU"
UNKNOWN = "UNKNOWN"
UNKNOWN_PART = "UNK"
EAST_COAST_SHIFT = -4
PAIR = ["lgh_driver1", "lgh_driver2"]
LEG_TEXT = [
    "ord_hdrnumber", "lgh_number", "lgh_driver1", "lgh_driver2", "lgh_class1",
    "trc_division", "lgh_startcity", "lgh_endcity",
]


# --- legs --------------------------------------------------------------------
def clean_legs(legs: DataFrame, first_day: date, last_day: date) -> DataFrame:
    """Legs that start between two days (both whole), with trimmed codes.

    The upper day is compared as a timestamp below the following midnight
    rather than by casting the column, so both bounds reach the scan. Legs of
    the excluded class, without a class, without a number, or with an unknown
    first driver are dropped; a missing first driver stays.
    """
    start = F.col("lgh_startdate")
    kept = legs.where(
        (start >= S.ntz(first_day))
        & (start < S.ntz(last_day + timedelta(days=1)))
        & (S.code(S.trim_ws(F.col("lgh_class1").cast("string"))) != EXCLUDED_CLASS)
        & F.col("ord_hdrnumber").isNotNull()
        & F.col("lgh_number").isNotNull()
    )
    trimmed = kept.select(
        *[S.trim_ws(F.col(c).cast("string")).alias(c) for c in LEG_TEXT],
        F.col("lgh_startdate").cast("timestamp_ntz").alias("lgh_startdate"),
        F.col("lgh_enddate").cast("timestamp_ntz").alias("lgh_enddate"),
    )
    return trimmed.where(S.lacks(F.col("lgh_driver1"), UNKNOWN_PART))


def shift_legs(legs: DataFrame, city: DataFrame) -> DataFrame:
    """Leg times in GMT and on the fixed east-coast clock (GMT less four hours,
    all year). A leg whose start or end city is not listed is dropped."""
    hours = F.col("cty_GMTDelta").cast("int")
    code = F.col("cty_code").cast("string")
    start_city = city.select(code.alias("s_code"), hours.alias("s_delta"))
    end_city = city.select(code.alias("t_code"), hours.alias("t_delta"))
    start, end = F.col("lgh_startdate"), F.col("lgh_enddate")
    shifted = (
        legs.join(start_city, F.col("lgh_startcity") == F.col("s_code"))
        .join(end_city, F.col("lgh_endcity") == F.col("t_code"))
        .withColumns(
            {
                "lgh_startdateGMT": S.shift_hours(start, F.col("s_delta")),
                "lgh_enddateGMT": S.shift_hours(end, F.col("t_delta")),
                "lgh_startdateEST": S.shift_hours(start, F.col("s_delta") + EAST_COAST_SHIFT),
                "lgh_enddateEST": S.shift_hours(end, F.col("t_delta") + EAST_COAST_SHIFT),
            }
        )
    )
    return shifted.withColumn(
        "lgh_hours", S.hours_between(F.col("lgh_startdateGMT"), F.col("lgh_enddateGMT"))
    ).select(
        "ord_hdrnumber", "lgh_number", *PAIR,
        "lgh_startdateGMT", "lgh_enddateGMT", "lgh_startdateEST", "lgh_enddateEST", "lgh_hours",
        "lgh_class1", "trc_division",
    )


# --- pairs -------------------------------------------------------------------
def pair_counts(legs: DataFrame) -> DataFrame:
    """Legs per ordered pair."""
    return legs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("leg_count"))


def with_leg_count(legs: DataFrame) -> DataFrame:
    """Every leg with the number of legs of its pair.

    A pair may hold a large share of all legs, so this is neither a window nor
    a plain join on the pair: the heaviest pairs are served by broadcast.
    """
    counts = pair_counts(legs)
    return look_up(
        legs,
        counts,
        PAIR,
        heaviest(counts, PAIR, "leg_count"),
        spread_by=["ord_hdrnumber", "lgh_number"],
        nulls_match=True,
    )


def _in_order(*moments):
    """Struct that sorts by the moments with missing ones last."""
    fields = []
    for name in moments:
        fields += [F.col(name).isNull().alias(f"{name}_gone"), F.col(name)]
    return fields


def pair_legs(legs: DataFrame, mode: str = "as_written", keep_last: bool = False) -> DataFrame:
    """First leg of every pair seen from each side, with the pair's leg count.

    Reduced to one row per pair before the sides are swapped and stacked, so
    what is shuffled grows with the pairs rather than the legs, and no task
    holds the legs of a pair. Equal start times are decided by end time and
    count, which are all the values that remain.

    As written, A-B and B-A keep separate counts and the direction with the
    first leg decides. As intended, both directions are counted together.
    With keep_last the last leg of each pair is kept too.
    """
    leg = F.struct(*_in_order("lgh_startdateEST", "lgh_enddateEST"))
    if not S.as_written(mode):
        a, b = F.col("lgh_driver1"), F.col("lgh_driver2")
        flip = a.isNotNull() & b.isNotNull() & (a > b)
        legs = legs.withColumns(
            {"lgh_driver1": F.when(flip, b).otherwise(a), "lgh_driver2": F.when(flip, a).otherwise(b)}
        )
    ends = {"first": F.min, "last": F.max} if keep_last else {"first": F.min}
    pairs = legs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("leg_count"), *[pick(leg).alias(name) for name, pick in ends.items()]
    )
    # both sides come from the one pair row, so the legs are read once
    one, two, rest = F.col("lgh_driver1"), F.col("lgh_driver2"), ["leg_count", *ends]
    sides = F.array(
        F.struct(one.alias("lgh_driver1"), two.alias("lgh_driver2"), *rest),
        F.struct(two.alias("lgh_driver1"), one.alias("lgh_driver2"), *rest),
    )
    rows = (
        pairs.select(F.explode(sides).alias("side"))
        .select("side.*")
        .groupBy(*PAIR)
        .agg(
            F.sum("leg_count").alias("legs"),
            *[pick(F.struct(name, "leg_count")).alias(name) for name, pick in ends.items()],
        )
    )

    def values(name: str):
        return [
            F.col(f"{name}.leg_count").alias("leg_count"),
            F.col(f"{name}.{name}.lgh_startdateEST").alias("lgh_startdateEST"),
            F.col(f"{name}.{name}.lgh_enddateEST").alias("lgh_enddateEST"),
        ]

    if not keep_last:
        return rows.select(*PAIR, *values("first"))
    first, last = (F.struct(F.lit(name).alias("which"), *values(name)) for name in ends)
    # a pair with a single leg has that one row only
    kept = F.when(F.col("legs") > 1, F.array(first, last)).otherwise(F.array(first))
    return rows.select(*PAIR, F.explode(kept).alias("end")).select(*PAIR, "end.*")


def team_history(pairs: DataFrame) -> DataFrame:
    """Co-driver table: one row per person and partner.

    Partner UNKNOWN means the person drove alone; any other partner, known by
    name or not, is a team. `rownames` numbers nothing but is unique per row.
    """
    one, two = F.col("lgh_driver1"), F.col("lgh_driver2")
    alone = F.when(two == UNKNOWN, 0.0).when(two.isNotNull(), 1.0)
    return pairs.where(one != UNKNOWN).select(
        F.concat(one, F.when(two.isNull(), "").otherwise(F.concat(F.lit("|"), two))).alias("rownames"),
        one.alias("DriverID"),
        alone.alias("team_binary"),
        "leg_count",
        "lgh_enddateEST",
    )


# --- people ------------------------------------------------------------------
def history_stats(teaming: DataFrame) -> DataFrame:
    """Co-driver statistics per person, as one aggregate instead of windows.

    The highest dense rank of the row names is the number of different ones.
    """
    missing_name = F.max(F.col("rownames").isNull().cast("int"))
    return teaming.groupBy(F.col("DriverID").alias("t_id")).agg(
        F.count("team_binary").alias("teams"),
        F.sum("team_binary").alias("shared"),
        S.int_avg(F.col("leg_count")).alias("avgtenure"),
        F.count("leg_count").alias("tenures"),
        F.var_pop("leg_count").alias("spread"),
        F.stddev_samp("leg_count").alias("stdev"),
        (F.count_distinct("rownames") + missing_name).alias("names"),
    )


def with_team_stats(
    added: DataFrame, teaming: DataFrame, fanout: str = "as_intended", integers: str = "as_written"
) -> DataFrame:
    """Monthly safety ratios, tenure band and co-driver statistics per person.

    With fanout as written, a person may have several rows here; each repeats
    the whole history in the person's window, which multiplies the count and
    the sum and changes the sample deviation, but neither mean nor rank.
    """
    multiplied, months, whole = S.as_written(fanout), F.col("seniority"), S.as_written(integers)
    divide = S.wide_div if multiplied else S.int_div
    rows = added.where(~F.col("Drivertype").isin(K.NOT_TEAMED_CLASSES)).withColumns(
        {
            "CSA_month": S.ratio_if_positive(F.col("CSA"), months),
            "Vio_month": S.ratio_if_positive(F.col("Violations"), months, divide if whole else None),
        }
    )
    rows = rows.join(history_stats(teaming), F.col("mpp_id") == F.col("t_id"), "left")
    if multiplied:
        # a person's rows differ only in the number of accidents on one date
        copies = F.count(F.lit(1)).over(Window.partitionBy("mpp_id"))
    else:
        copies = F.lit(1).cast("bigint")
    rows = rows.withColumn("copies", copies)
    n = F.col("copies") * F.col("tenures")
    stdev = F.when(F.col("copies") == 1, F.col("stdev")).when(
        n > 1, F.sqrt(F.col("spread") * n / (n - 1))
    )
    rows = rows.withColumns(
        {
            "numteams": F.coalesce(F.col("teams") * F.col("copies"), F.lit(0)),
            "partsolo": F.col("shared") * F.col("copies"),
            "stdevtenure": F.coalesce(stdev, F.lit(0.0)),
            "maxrank": F.coalesce("names", F.lit(1)),
            "seniority": S.profile_tenure(months),
        }
    )
    gone = ["CSA", "Violations", "copies", "t_id", "teams", "shared", "tenures", "spread", "stdev", "names"]
    rows = rows.drop(*gone)
    return rows.distinct() if multiplied else rows


SUMMARY_ORDER = ["Drivertype", "seniority", "stayed"]


def cohort_summary(people: DataFrame, integers: str = "as_written") -> DataFrame:
    """The cohorts side by side, by class and tenure band, in the order of these."""
    return cohort_means(people, integers).orderBy(*SUMMARY_ORDER)


def numbered_summary(people: DataFrame, integers: str = "as_written") -> DataFrame:
    """The same with the place of each row (`order`).

    There is at most a row per cohort, class and band, all of them fixed lists: a few dozens, which are numbered as one
    array.
    """
    means = cohort_means(people, integers)
    rows = F.sort_array(F.collect_list(F.struct(*SUMMARY_ORDER, *[c for c in means.columns if c not in SUMMARY_ORDER])))
    placed = means.agg(rows.alias("rows")).select(F.posexplode("rows").alias("place", "row"))
    return placed.select((F.col("place") + 1).alias("order"), *[F.col("row")[c].alias(c) for c in means.columns])


def cohort_means(people: DataFrame, integers: str = "as_written") -> DataFrame:
    """Counts and means by cohort, class and tenure band.

    Measures that are whole numbers have whole averages, as the integer
    dialect computes them, unless integers is as_intended.
    """
    col, truncated = F.col, S.as_written(integers)

    def whole(column: str):
        if not truncated:
            return F.avg(column)
        wide = isinstance(people.schema[column].dataType, T.DecimalType)
        return S.int_avg(col(column), S.wide_div if wide else S.int_div)

    return (
        people.groupBy("stayed", "Drivertype", "seniority")
        .agg(
            whole("Critical").alias("Critical"),
            F.avg("endorsecount").alias("endorse"),
            F.avg("chargebackcount").alias("chargeback"),
            F.avg("safetycount").alias("safety"),
            F.avg("correctioncount").alias("correction"),
            F.avg("latehomecount").alias("latehome"),
            F.avg("layoverbinary").alias("layover"),
            F.avg("paydetails").alias("paydetails"),
            F.avg("groupavgpay").alias("avgpay"),
            F.count(F.lit(1)).alias("count"),
            F.avg("CSA_month").alias("CSA"),
            whole("Vio_month").alias("Vio"),
            whole("numteams").alias("numteams"),
            F.avg(col("numteams") - col("partsolo")).alias("solo"),
            whole("avgtenure").alias("avgtenure"),
            F.avg("stdevtenure").alias("stdevtenure"),
        )
    )


def with_expirations(people: DataFrame, expirations: DataFrame) -> DataFrame:
    """People whose id is on the expiration list, with the list's columns."""
    listed = expirations.withColumnsRenamed({c: f"eto_{c}" for c in expirations.columns if c in people.columns})
    return people.join(listed, F.col("mpp_id") == F.col("DriverID"))
