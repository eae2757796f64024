"""Pay, safety and tenure profile of those who stayed and those who left."""

from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import scalars as S
from stayline.operators import pay as P
from stayline.operators import safety, teaming
from stayline.sources.handover import Handover


@dataclass(frozen=True)
class Workforce:
    """Input tables and the two dates that fix the cohorts.

    The pay steps need the profile and the pay lines only. `master` is the
    profile that names, phones and hire dates come from, by default the one
    the cohorts are taken from.
    """

    profile: DataFrame
    pay: DataFrame
    cutoff: date
    as_of: date | datetime | None = None
    events: DataFrame | None = None
    accidents: DataFrame | None = None
    violations: DataFrame | None = None
    teaming: DataFrame | None = None
    master: DataFrame | None = None


@dataclass(frozen=True)
class Modes:
    """How to treat the oddities of the original definitions.

    Each is as_written (the letter) or as_intended (the evident meaning); the
    defaults are the ones whose results are meant to be used.

    cohort    leavers by an id that reads 'company', or by status and date only
    rows      equal pay codes of a bucket collapse within a week, or all count
    dedupe    equal weeks of a person weigh once, or each weighs
    fanout    safety counts multiply each other, or are taken one by one
    integers  averages and ratios of whole numbers are truncated, or not
    """

    cohort: str = "as_intended"
    rows: str = "as_written"
    dedupe: str = "as_written"
    fanout: str = "as_intended"
    integers: str = "as_written"


def cohorts(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    w = resolved(w)
    return P.select_cohorts(w.profile, w.cutoff, w.as_of, modes.cohort)


def resolved(w: Workforce) -> Workforce:
    """With the moment that bounds and windows share: the session's now, asked once, where none is given."""
    return w if w.as_of is not None else replace(w, as_of=w.profile.sparkSession.range(1).select(F.localtimestamp()).first()[0])


def weeks(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    w = resolved(w)
    earliest = P.earliest_period(w.cutoff, w.as_of)
    return P.weekly_totals(P.code_rows(w.pay, cohorts(w, modes), earliest, modes.rows))


def driver_stats(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    return P.driver_pay_stats(weeks(w, modes), modes.dedupe)


def model(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    return P.cohort_model(driver_stats(w, modes), w.profile if w.master is None else w.master)


def safety_profile(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    """The company people of both cohorts with their safety record."""
    w, people = resolved(w), None
    if w.master is None:  # the cohorts' own profile covers the model
        name = S.joined_name(F.col("mpp_firstname"), F.col("mpp_lastname"))
        people = w.profile.select("mpp_id", name.alias("DriverName"))
    return safety.safety_star(
        model(w, modes), w.events, w.accidents, w.violations, w.as_of, people=people, mode=modes.fanout
    )


def people(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    """One row per person of the teamed classes, all measures together."""
    return teaming.with_team_stats(safety_profile(w, modes), w.teaming, modes.fanout, modes.integers)


def summary(w: Workforce, modes: Modes = Modes()) -> DataFrame:
    return teaming.cohort_summary(people(w, modes), modes.integers)


def expiring(w: Workforce, expirations: DataFrame, modes: Modes = Modes()) -> DataFrame:
    return teaming.with_expirations(people(w, modes), expirations)


def results(w: Workforce, expirations: DataFrame, handover: Handover, modes: Modes = Modes()) -> tuple[DataFrame, DataFrame]:
    """Both results of a run, the summary and the expiration list, of the same person rows: these are made once and stored
    until the hand-over is closed."""
    stored = handover.stored(people(w, modes), "people")
    return teaming.cohort_summary(stored, modes.integers), teaming.with_expirations(stored, expirations)
