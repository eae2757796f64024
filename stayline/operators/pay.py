"""Pay history of the people who left and the people who stayed.

Both groups go through one plan: the cohort label `stayed` is put on the small
person side, so the pay fact is read, aggregated and shuffled once for both.
"""

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.functions import scalars as S

WINDOW_MONTHS = 6
# Money has four decimals. Once lines are summed, amounts go on as whole
# numbers of 1/10000, which add and hash much faster than wide decimals and
# raise on overflow, and come back as decimals where they are given out.
UNITS = 10000
# totals have two decimals; ten digits would do for one person's usual half
# year but not for a person with a large share of all lines
TOTAL = "DECIMAL(18,2)"


def money(units: str) -> str:
    """SQL for an amount in 1/10000 as a decimal."""
    return f"CAST({units} AS DECIMAL(20,0)) * CAST(0.0001 AS DECIMAL(5,4))"


PERSON = ["stayed", "mpp_id"]
WEEK = [*PERSON, "Drivertype", "mpp_type1", "pyh_payperiod"]
FLAGS = [name for name, _, _ in K.WEEK_FLAGS]
WEEK_FACTS = [*FLAGS, "termedbinary", "count", "latehomebinary", "layoverbinary"]


# --- cohorts -----------------------------------------------------------------
def _left(cutoff: date) -> Column:
    """Employment ended on or after the cutoff."""
    return (S.code(F.col("mpp_status")) == "OUT") & (F.col("mpp_terminationdt") >= S.ntz(cutoff))


def _active() -> Column:
    """Employment is open-ended."""
    return F.col("mpp_terminationdt") == S.ntz(K.ACTIVE_UNTIL)


def _cohort(profile: DataFrame, start: Column, stayed: Column) -> DataFrame:
    return profile.select(
        stayed.alias("stayed"),
        "mpp_id",
        start.alias("StartDate"),
        "mpp_terminationdt",
        "mpp_state",
        "mpp_type2",
        # grouped by from here on
        S.code_key(F.col("mpp_type1")).alias("mpp_type1"),
        S.driver_class("mpp_type2").alias("Drivertype"),
    )


def select_cohorts(
    profile: DataFrame, cutoff: date, as_of: date | datetime | None = None, mode: str = "as_intended"
) -> DataFrame:
    """Both cohorts, labelled. As written, leavers are kept only when their id
    reads 'company', which no id does; the intended test is on the type and
    comes later, for both cohorts alike."""
    gone, there = _left(cutoff), _active()
    if S.as_written(mode):
        gone = gone & (F.col("mpp_id") == K.COMPANY)
    # one read for both; somebody marked as gone without an end is in both
    ends = [(gone, F.col("mpp_terminationdt")), (there, S.moment_or_now(as_of))]
    found = F.array(*[F.when(test, F.struct(F.lit(i).alias("stayed"), S.months_before(end, WINDOW_MONTHS).alias("start"))) for i, (test, end) in enumerate(ends)])
    rows = profile.where(gone | there).withColumn("__in", F.explode(F.array_compact(found)))
    return _cohort(rows, F.col("__in.start"), F.col("__in.stayed"))


def earliest_period(cutoff: date, as_of: date | datetime) -> date:
    """First day that any cohort's pay window can reach back to.

    A literal bound on the pay fact that the scan can use; the per-person
    windows themselves are no scan predicate.
    """
    first = min(cutoff, as_of.date() if isinstance(as_of, datetime) else as_of)
    months = first.year * 12 + first.month - 1 - WINDOW_MONTHS
    # day 1 lies on or before any clamped day of that month
    return date(months // 12, months % 12 + 1, 1)


# --- interval join -----------------------------------------------------------
def in_window(pay: DataFrame, cohorts: DataFrame, earliest: date | None = None) -> DataFrame:
    """Pay rows of each person inside that person's half-open window.

    `pay` may hold pay lines or totals of them: the condition reads only the
    assignee, the period and the assignment type.
    """
    if "asgn_type" in pay.columns:
        pay = pay.where(S.code(F.col("asgn_type")) == "DRV").drop("asgn_type")
    if earliest is not None:
        pay = pay.where(F.col("pyh_payperiod") >= S.ntz(earliest))
    period = F.col("pyh_payperiod")
    return pay.join(
        cohorts,
        (F.col("asgn_id") == F.col("mpp_id"))
        & (period >= F.col("StartDate"))
        & (period < F.col("mpp_terminationdt")),
        "inner",
    ).drop("asgn_id")


def pay_totals(pay: DataFrame, earliest: date | None = None) -> DataFrame:
    """Pay lines summed per assignee, period and code, before any join.

    The window test needs nothing finer, so the sum can go below the join: a
    person with a third of all lines shrinks to a few rows on the map side.
    Codes are summed in one spelling, which afterwards compares as codes do.
    """
    pay = pay.where(S.code(F.col("asgn_type")) == "DRV")
    if earliest is not None:
        pay = pay.where(F.col("pyh_payperiod") >= S.ntz(earliest))
    totals = pay.groupBy("asgn_id", "pyh_payperiod", S.code_key(F.col("pyt_itemcode")).alias("pyt_itemcode")).agg(
        F.sum(F.col("pyd_amount").cast("decimal(19,4)")).alias("amount"), F.count("pyd_amount").alias("lines")
    )
    return totals.withColumn("pyt_itemcode", S.code(F.col("pyt_itemcode")))


# --- buckets -----------------------------------------------------------------
def _coded(pay: DataFrame, cohorts: DataFrame, earliest: date | None) -> DataFrame:
    """One row per person, period and pay code, with its bucket and counts.

    Placed on mpp_id once: every later grouping includes that column, so none
    of them shuffles again.
    """
    rows = in_window(pay_totals(pay, earliest), cohorts).repartition("mpp_id")
    return rows.select(
        *PERSON,
        "pyh_payperiod",
        "mpp_terminationdt",
        "StartDate",
        "mpp_state",
        "mpp_type1",
        "Drivertype",
        S.pay_bucket("pyt_itemcode").alias("bucket"),
        F.expr(f"CASE WHEN pyt_itemcode IS NOT NULL THEN CAST(amount * {UNITS} AS BIGINT) ELSE 0 END AS amount"),
        F.expr(f"CASE WHEN NOT {S.in_list('pyt_itemcode', K.UNCOUNTED_CODES)} THEN lines ELSE 0 END AS count"),
        F.expr(f"CASE WHEN pyt_itemcode = '{K.LATE_HOME_CODE}' THEN lines ELSE 0 END AS latehome"),
        F.expr(f"CASE WHEN pyt_itemcode = '{K.LAYOVER_CODE}' THEN lines ELSE 0 END AS layover"),
    )


def code_rows(
    pay: DataFrame, cohorts: DataFrame, earliest: date | None = None, mode: str = "as_written"
) -> DataFrame:
    """Bucketed rows in narrow form: one bucket name and amount (in 1/10000) per row.

    As written, two codes of one bucket that agree in amount and count within a
    week collapse into one row. A zero amount looks the same in every bucket,
    so it is compared without its bucket.
    """
    rows = _coded(pay, cohorts, earliest)
    if S.as_written(mode):
        blank = F.when(F.col("amount") == 0, F.lit(None)).otherwise(F.col("bucket"))
        rows = rows.withColumn("bucket", blank).distinct()
    return rows


# one SQL expression per bucket column of the wide form
BUCKET_AMOUNTS = {name: f"CASE WHEN bucket = '{name}' THEN amount ELSE 0 END" for name in K.BUCKET_NAMES}


def pay_code_buckets(
    pay: DataFrame, cohorts: DataFrame, earliest: date | None = None, mode: str = "as_written"
) -> DataFrame:
    """Twelve bucket sums and three counts.

    As written: one row per person, week and pay code, duplicates dropped.
    As intended: one row per person and week.
    """
    rows = code_rows(pay, cohorts, earliest, mode)
    keys = [*PERSON, "pyh_payperiod", "mpp_terminationdt", "StartDate", "mpp_state", "mpp_type1", "Drivertype"]
    counts = ["count", "latehome", "layover"]
    if S.as_written(mode):
        return rows.selectExpr(*keys, *[f"{money(text)} AS {name}" for name, text in BUCKET_AMOUNTS.items()], *counts)
    return rows.groupBy(*keys).agg(
        *[F.expr(f"{money(f'sum({text})')} AS {name}") for name, text in BUCKET_AMOUNTS.items()],
        *[F.sum(c).alias(c) for c in counts],
    )


# --- weeks -------------------------------------------------------------------
def weekly_totals(rows: DataFrame) -> DataFrame:
    """Week pay, flags and counts per person and week, from `code_rows`."""
    sums = {**BUCKET_AMOUNTS, "count": "count", "latehome": "latehome", "layover": "layover"}
    week = rows.groupBy(*WEEK).agg(*[F.expr(f"sum({text}) AS sum_{name}") for name, text in sums.items()])

    def raised(total: str, sign: int, flag: str) -> str:
        return f"CASE WHEN sum_{total} {'<' if sign < 0 else '>'} 0 THEN 1 ELSE 0 END AS {flag}"

    return week.selectExpr(
        *WEEK,
        money("(" + " + ".join(f"sum_{b}" for b in K.BUCKET_NAMES) + ")") + " AS weekpay",
        *[raised(b, sign, flag) for flag, b, sign in K.WEEK_FLAGS],
        "1 AS termedbinary",
        "sum_count AS count",
        raised("latehome", 1, "latehomebinary"),
        raised("layover", 1, "layoverbinary"),
    )


def weekly_rollup(rows: DataFrame) -> DataFrame:
    """Weekly totals with the weeks of each person ranked, newest first.

    The window holds one person's weeks, at most half a year of them.
    """
    newest = Window.partitionBy(*PERSON).orderBy(F.desc("pyh_payperiod"))
    return weekly_totals(rows).withColumn("ranking", F.dense_rank().over(newest))


# --- people ------------------------------------------------------------------
def counted_weeks(weeks: DataFrame, mode: str = "as_written") -> DataFrame:
    """Weeks that enter the personal statistics: pay above the minimum.

    As written, weeks of one person that agree in pay, flags and count weigh
    once. As intended, each week weighs.
    """
    kept = weeks.where(F.col("weekpay") > K.MIN_WEEK_PAY)
    if S.as_written(mode):
        kept = kept.select(*PERSON, "Drivertype", "mpp_type1", "weekpay", *WEEK_FACTS).distinct()
    return kept


def driver_pay_stats(weeks: DataFrame, mode: str = "as_written") -> DataFrame:
    """One row per person: totals of the weekly flags, pay mean, and the lowest
    and highest distance of a week's pay from that mean."""
    person = [*PERSON, "Drivertype", "mpp_type1"]
    stats = (
        counted_weeks(weeks, mode)
        .groupBy(*person)
        .agg(
            *[F.expr(f"CAST(sum({src}) AS {TOTAL}) AS {name}") for name, src in K.DRIVER_TOTALS],
            F.max("termedbinary").alias("termedbinary"),
            F.avg("weekpay").alias("avgdriverpay"),
            F.min("weekpay").alias("low"),
            F.max("weekpay").alias("high"),
            F.sum("weekpay").alias("pay_sum"),
            F.count("weekpay").alias("pay_weeks"),
        )
    )
    # mean - week is smallest for the highest week and largest for the lowest
    return stats.withColumns(
        {
            "mindridiff": (F.col("avgdriverpay") - F.col("high")).cast(TOTAL),
            "maxdridiff": (F.col("avgdriverpay") - F.col("low")).cast(TOTAL),
        }
    ).drop("low", "high")


def with_group_pay(stats: DataFrame) -> DataFrame:
    """Add the mean week pay of the person's cohort, class and type.

    Summed from the personal sums, so the group mean is one small aggregate and
    no window gathers a whole class in one task.
    """
    group = ["stayed", "Drivertype", "mpp_type1"]
    means = (
        stats.groupBy(*group)
        .agg((F.sum("pay_sum") / F.sum("pay_weeks")).alias("groupavgpay"))
        .withColumnsRenamed({c: f"g_{c}" for c in group})
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group])
    return stats.join(means, same, "left").drop(*[f"g_{c}" for c in group], "pay_sum", "pay_weeks")


def cohort_model(stats: DataFrame, profile: DataFrame) -> DataFrame:
    """Company people of both cohorts with name, phone, hire date and the mean
    of the personal means of their class.

    After the company filter the group key takes at most one value per class
    (there are five), so the table of means is broadcast: its size is fixed.
    """
    company = stats.where(S.code(F.col("mpp_type1")) == K.COMPANY)
    means = company.groupBy(F.col("Drivertype").alias("g_class")).agg(
        F.avg("avgdriverpay").alias("groupavgpay")
    )
    person = profile.select(
        F.col("mpp_id").alias("p_id"),
        S.joined_name(F.col("mpp_firstname"), F.col("mpp_lastname")).alias("p_name"),
        F.col("mpp_currentphone").alias("phone"),
        "mpp_hiredate",
    )
    return (
        company.drop("pay_sum", "pay_weeks", "termedbinary", "mindridiff", "maxdridiff")
        .join(F.broadcast(means), F.col("Drivertype") == F.col("g_class"), "left")
        .join(person, F.col("mpp_id") == F.col("p_id"), "left")
        .withColumn("DriverName", F.coalesce("p_name", F.lit("UNKNOWN")))
        .drop("g_class", "p_id", "p_name")
    )


def group_profile(stats: DataFrame) -> DataFrame:
    """Means of the personal measures by class and type within one cohort.

    The group's mean week pay is the same for all its people, so it is taken
    from the group's own sums and needs no join.
    """
    means = {
        "FINESavg": "finescount",
        "DETavg": "detentioncount",
        "DRVSLYavg": "DRVSLYcount",
        "endorseavg": "endorsecount",
        "chargebackavg": "chargebackcount",
        "safetyavg": "safetycount",
        "correctionavg": "correctioncount",
        "payavg": "paydetails",
        "mindriavg": "mindridiff",
        "maxdiravg": "maxdridiff",
        "avgdripayavg": "avgdriverpay",
    }
    return stats.groupBy("stayed", "Drivertype", "mpp_type1").agg(
        *[F.expr(f"avg({column}) AS {name}") for name, column in means.items()],
        (F.sum("pay_sum") / F.sum("pay_weeks")).alias("groupavgpayavg"),
    )
