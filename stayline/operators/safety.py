"""Safety record per person: events, accidents and violations.

Each satellite is summed to one row per key before it is joined, so a join
never multiplies rows and a person with very many events is summed on the map
side first.
"""

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators.joins import common_keys, look_up

NO_ACCIDENT_DAYS = 10000
IGNORED_EVENTS = "%lane_departure%"
COUNTED_ACCIDENTS = "Chargeable"
COUNT, PRODUCT = "decimal(19,0)", "decimal(38,0)"


def event_counts(events: DataFrame) -> DataFrame:
    """Counted events per person, by triggers of any case; a missing one is not counted."""
    return (
        events.where(~F.lower(F.col("EventTrigger").cast("string")).like(IGNORED_EVENTS))
        .groupBy(F.col("DriverID").alias("e_id"))
        .agg(F.count("EventTrigger").alias("events"))
    )


def _accidents(accidents: DataFrame) -> DataFrame:
    return accidents.where(S.code(F.col("SPECIAL23")) == COUNTED_ACCIDENTS)


def last_accidents(accidents: DataFrame) -> DataFrame:
    """Date of the latest counted accident per person."""
    return (
        _accidents(accidents)
        .groupBy(F.col("MISC2_NM").alias("a_id"))
        .agg(F.max("REPORT_DT").alias("last_accident"))
    )


def accident_multiples(accidents: DataFrame) -> DataFrame:
    """The different numbers of accidents a person had on one date."""
    return (
        _accidents(accidents)
        .groupBy(F.col("MISC2_NM").alias("n_id"), "REPORT_DT")
        .agg(F.count(F.lit(1)).alias("same_date"))
        .select("n_id", "same_date")
        .distinct()
    )


def violation_totals(violations: DataFrame, key: str = "DriverName") -> DataFrame:
    value = F.col("ViolationValue").cast("double")
    return (
        violations.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("vio_rows"),
            F.count(value).alias("vio_values"),
            F.sum(value).alias("vio_sum"),
        )
    )


def violations_by_person(people: DataFrame, violations: DataFrame, key: str = "DriverName") -> DataFrame:
    """Violations of everybody who bears the name they were filed under.

    Namesakes share their violations, and so do all people whose name is
    unknown, which makes some names very common: the rows of the heaviest names
    are split over many tasks. Where the violations carry a person id, pass its
    column as `key` and nothing is shared.
    """
    people = people.select("mpp_id", key) if key != "mpp_id" else people.select("mpp_id")
    found = look_up(people, violation_totals(violations, key), [key], common_keys(people, key), spread_by=["mpp_id"])
    return found.where(F.col("vio_rows").isNotNull()).select(
        F.col("mpp_id").alias("v_id"), "vio_rows", "vio_values", "vio_sum"
    )


def safety_star(
    model: DataFrame,
    events: DataFrame,
    accidents: DataFrame,
    violations: DataFrame,
    as_of: date | datetime | None = None,
    people: DataFrame | None = None,
    mode: str = "as_intended",
    violation_key: str = "DriverName",
) -> DataFrame:
    """Add events, tenure, days since the last accident and violations.

    As written, events, violations and accidents of a person were joined row by
    row before counting, so each count is multiplied by the numbers of the
    others, and a person shows once per distinct number of accidents on a date.
    Those products are computed here as products of the counts.

    `people` (mpp_id, DriverName; one row per id) must cover the model; by
    default the model's own columns are used.
    """
    now = S.moment_or_now(as_of)
    id_ = F.col("mpp_id")
    if people is None:
        people = model.select("mpp_id", "DriverName").distinct()
    found = violations_by_person(people, violations, violation_key)
    rows = (
        model.join(event_counts(events), id_ == F.col("e_id"), "left")
        .join(last_accidents(accidents), id_ == F.col("a_id"), "left")
        .join(found, id_ == F.col("v_id"), "left")
    )
    events_n = F.coalesce("events", F.lit(0))
    vio_n = F.coalesce("vio_values", F.lit(0))
    vio_sum = F.coalesce("vio_sum", F.lit(0.0))
    if S.as_written(mode):
        rows = rows.join(accident_multiples(accidents), id_ == F.col("n_id"), "left")
        same_date = F.coalesce("same_date", F.lit(1))
        event_rows = F.greatest(events_n, F.lit(1))
        vio_rows = F.greatest(F.coalesce("vio_rows", F.lit(0)), F.lit(1))
        # the products of three counts can outgrow a BIGINT
        events_n = (events_n.cast(COUNT) * vio_rows * same_date).cast(PRODUCT)
        vio_n = (vio_n.cast(COUNT) * event_rows * same_date).cast(PRODUCT)
        vio_sum = vio_sum * event_rows * same_date
    days = S.day_boundaries(F.col("last_accident"), now)
    rows = rows.select(
        *[c for c in model.columns if c != "mpp_hiredate"],
        events_n.alias("Critical"),
        S.month_boundaries(F.col("mpp_hiredate"), now).alias("seniority"),
        S.if_null(days, NO_ACCIDENT_DAYS, "int").alias("daystoacc"),
        vio_sum.alias("CSA"),
        vio_n.alias("Violations"),
    )
    return rows.distinct() if S.as_written(mode) else rows
