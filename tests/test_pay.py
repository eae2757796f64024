import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.operators import pay as P
from stayline.plans import pay_profile
from stayline.sources import schemas

CUTOFF, AS_OF = date(2018, 1, 1), datetime(2018, 9, 15, 10, 30)
PERSON = dict(
    mpp_state="TX", mpp_type1="company", mpp_type2="TD1", mpp_status="OUT", mpp_firstname="A", mpp_lastname="B",
    mpp_currentphone="1", mpp_hiredate=datetime(2015, 1, 31),
)


def profile(spark, *people):
    names = schemas.PROFILE.fieldNames()
    return spark.createDataFrame([tuple({**PERSON, **p}[n] for n in names) for p in people], schemas.PROFILE)


def pay(spark, *lines):
    """(id, period, code, amount[, type])"""
    data = [
        (line[4] if len(line) > 4 else "DRV", line[0], line[1], line[2], None if line[3] is None else Decimal(str(line[3])))
        for line in lines
    ]
    return spark.createDataFrame(
        data, "asgn_type STRING, asgn_id STRING, pyh_payperiod TIMESTAMP_NTZ, pyt_itemcode STRING, pyd_amount DECIMAL(19,4)"
    )


LEAVER = dict(mpp_id="L", mpp_terminationdt=datetime(2018, 8, 31, 13, 45))
WEEK = datetime(2018, 6, 4)


@pytest.fixture
def leaver(spark):
    return P.select_cohorts(profile(spark, LEAVER), CUTOFF, AS_OF)


def week_of(spark, leaver, *lines, mode="as_written"):
    return P.weekly_totals(P.code_rows(pay(spark, *lines), leaver, mode=mode))


# --- cohorts -----------------------------------------------------------------
def test_cohorts(spark, rows):
    people = profile(
        spark,
        LEAVER,
        dict(mpp_id="early", mpp_terminationdt=datetime(2017, 12, 31)),
        dict(mpp_id="S", mpp_status="ACT", mpp_terminationdt=K.ACTIVE_UNTIL, mpp_type2=None),
        dict(mpp_id="odd", mpp_status="ACT", mpp_terminationdt=datetime(2018, 5, 1), mpp_type2="??"),
    )
    got = rows(P.select_cohorts(people, CUTOFF, AS_OF), "stayed", "mpp_id", "StartDate", "Drivertype")
    assert got == [
        (0, "L", datetime(2018, 2, 28, 13, 45), "Team Driver_Student"),
        (1, "S", datetime(2018, 3, 15, 10, 30), "OTR"),
    ]


def test_cohorts_as_written_keep_no_leaver(spark, rows):
    people = profile(spark, LEAVER, dict(mpp_id="company", mpp_terminationdt=datetime(2018, 5, 1)))
    got = P.select_cohorts(people, CUTOFF, AS_OF, mode="as_written")
    assert rows(got, "mpp_id") == [("company",)]


def test_every_class_code(spark):
    from stayline.functions import scalars as S

    codes = [(c, name) for name, cs in K.DRIVER_CLASSES.items() for c in cs] + [(None, "OTR"), ("new", "OTR")]
    df = spark.createDataFrame(codes, "code STRING, want STRING")
    assert df.where(~S.driver_class("code").eqNullSafe(F.col("want"))).count() == 0


# --- interval join -----------------------------------------------------------
def test_window_is_half_open(spark, leaver, rows):
    start, end = datetime(2018, 2, 28, 13, 45), datetime(2018, 8, 31, 13, 45)
    lines = [
        ("L", start, "MILES", 1),
        ("L", start - timedelta(seconds=1), "MILES", 2),
        ("L", end, "MILES", 3),
        ("L", end - timedelta(seconds=1), "MILES", 4),
        ("L", WEEK, "MILES", 5, "TRC"),
        ("other", WEEK, "MILES", 6),
    ]
    assert [r[0] for r in rows(P.in_window(pay(spark, *lines), leaver), "pyd_amount")] == [Decimal(1), Decimal(4)]


@pytest.mark.parametrize("cutoff, as_of", [(date(2018, 1, 1), date(2018, 9, 15)), (date(2018, 8, 31), date(2018, 3, 1))])
def test_scan_bound_is_not_after_any_window(spark, cutoff, as_of):
    bound = P.earliest_period(cutoff, as_of)
    people = [dict(mpp_id="S", mpp_terminationdt=K.ACTIVE_UNTIL)] + [
        dict(mpp_id=str(d), mpp_terminationdt=datetime(cutoff.year, cutoff.month, cutoff.day) + timedelta(days=d, hours=h))
        for d in range(0, 70, 3)
        for h in (0, 23)
    ]
    starts = P.select_cohorts(profile(spark, *people), cutoff, as_of).agg(F.min("StartDate")).first()[0]
    assert datetime(bound.year, bound.month, bound.day) <= starts


# --- buckets -----------------------------------------------------------------
def test_every_pay_code_has_its_bucket(spark, leaver):
    wanted = {code: name for name, codes in K.PAY_BUCKETS.items() for code in codes}
    wanted |= {"HMETME": "other", "LAY": "other", "new": "other"}
    lines = [("L", WEEK, code, 10 + i) for i, code in enumerate(wanted)]
    got = {}
    for r in P.pay_code_buckets(pay(spark, *lines), leaver).collect():
        amounts = {b: r[b] for b in K.BUCKET_NAMES if r[b] != 0}
        assert len(amounts) == 1
        (bucket, amount), = amounts.items()
        code = list(wanted)[int(amount) - 10]
        got[code] = bucket
        assert r["count"] == (0 if code in ("PDIEM", "MILES") else 1)
        assert r["latehome"] == (code == "HMETME") and r["layover"] == (code == "LAY")
    assert got == wanted


def test_missing_code_is_in_no_bucket(spark, leaver):
    (r,) = P.pay_code_buckets(pay(spark, ("L", WEEK, None, 50)), leaver).collect()
    assert all(r[b] == 0 for b in K.BUCKET_NAMES) and r["count"] == 0


def test_equal_codes_of_a_bucket_collapse_as_written(spark, leaver):
    lines = [("L", WEEK, "HOTEL", 25), ("L", WEEK, "SCALE", 25), ("L", WEEK, "MILES", 300)]
    written = week_of(spark, leaver, *lines).first()
    intended = week_of(spark, leaver, *lines, mode="as_intended").first()
    assert (written["weekpay"], intended["weekpay"]) == (325, 350)
    assert (written["count"], intended["count"]) == (1, 2)


def test_zero_amounts_collapse_across_buckets_as_written(spark, leaver):
    lines = [("L", WEEK, "HOTEL", 0), ("L", WEEK, "GRNT", 0), ("L", WEEK, "MILES", 300)]
    assert week_of(spark, leaver, *lines).first()["count"] == 1
    assert week_of(spark, leaver, *lines, mode="as_intended").first()["count"] == 2


def test_missing_amounts(spark, leaver):
    # a sum over missing amounts only is missing, and so is the week's pay
    assert week_of(spark, leaver, ("L", WEEK, "MILES", None)).first()["weekpay"] is None
    week = week_of(spark, leaver, ("L", WEEK, "MILES", None), ("L", WEEK, "PDIEM", 7)).first()
    assert week["weekpay"] == 7


# --- weeks -------------------------------------------------------------------
def test_flags_and_rank(spark, leaver):
    later = WEEK + timedelta(days=7)
    lines = [
        ("L", WEEK, "FINES", -5), ("L", WEEK, "DETPAY", 5), ("L", WEEK, "HMETME", 1), ("L", WEEK, "MILES", 1),
        ("L", later, "FINES", 5), ("L", later, "LAY", 1),
    ]
    old, new = sorted(
        P.weekly_rollup(P.code_rows(pay(spark, *lines), leaver)).collect(), key=lambda r: r["pyh_payperiod"]
    )
    assert (old["ranking"], new["ranking"]) == (2, 1)
    assert (old["finesbinary"], old["detentionbinary"], old["latehomebinary"], old["layoverbinary"]) == (1, 1, 1, 0)
    assert (new["finesbinary"], new["detentionbinary"], new["latehomebinary"], new["layoverbinary"]) == (0, 0, 0, 1)
    assert (old["weekpay"], old["termedbinary"], old["count"]) == (2, 1, 3)


# --- people ------------------------------------------------------------------
def weeks_of_pay(*amounts):
    return [("L", WEEK + timedelta(days=7 * i), "MILES", a) for i, a in enumerate(amounts)]


def test_weeks_at_the_minimum_do_not_count(spark, leaver):
    stats = P.driver_pay_stats(week_of(spark, leaver, *weeks_of_pay(200, "200.01", 400))).first()
    assert stats["avgdriverpay"] == Decimal("300.005")
    assert (stats["mindridiff"], stats["maxdridiff"]) == (Decimal("-100.00"), Decimal("100.00"))


def test_equal_weeks_weigh_once_as_written(spark, leaver):
    weeks = week_of(spark, leaver, *weeks_of_pay(300, 300, 600))
    assert P.driver_pay_stats(weeks).first()["avgdriverpay"] == 450
    assert P.driver_pay_stats(weeks, mode="as_intended").first()["avgdriverpay"] == 400


def test_buckets_add_up_to_the_pay_as_intended(spark, leaver):
    rnd = random.Random(3)
    codes = [*K.BUCKETED_CODES, "HMETME", "LAY", "MISC"]
    lines = [("L", WEEK + timedelta(days=7 * rnd.randrange(5)), rnd.choice(codes), rnd.randrange(-20, 90)) for _ in range(300)]
    total = sum(line[3] for line in lines)
    weeks = week_of(spark, leaver, *lines, mode="as_intended")
    assert weeks.agg(F.sum("weekpay")).first()[0] == total


def test_one_person_with_a_third_of_the_lines(spark):
    """A hot person goes through the same plan and keeps every line."""
    people = [dict(mpp_id=str(i), mpp_terminationdt=datetime(2018, 8, 1)) for i in range(20)]
    lines = [("0", WEEK, "MILES", 1)] * 1000 + [(str(i % 19 + 1), WEEK, "MILES", 1) for i in range(2000)]
    cohorts = P.select_cohorts(profile(spark, *people), CUTOFF, AS_OF)
    weeks = P.weekly_totals(P.code_rows(pay(spark, *lines), cohorts))
    got = {r["mpp_id"]: r["weekpay"] for r in weeks.collect()}
    assert got["0"] == 1000 and sum(got.values()) == 3000


def test_model_takes_group_mean_of_company_people(spark):
    people = [
        dict(mpp_id="a", mpp_terminationdt=datetime(2018, 8, 1)),
        dict(mpp_id="b", mpp_terminationdt=K.ACTIVE_UNTIL, mpp_firstname=None),
        dict(mpp_id="c", mpp_terminationdt=datetime(2018, 8, 1), mpp_type1="lease"),
    ]
    lines = [("a", WEEK, "MILES", 300), ("b", WEEK, "MILES", 500), ("c", WEEK, "MILES", 900)]
    w = pay_profile.Workforce(profile(spark, *people), pay(spark, *lines), CUTOFF, AS_OF)
    got = {r["mpp_id"]: r for r in pay_profile.model(w).collect()}
    assert set(got) == {"a", "b"}
    assert {r["groupavgpay"] for r in got.values()} == {Decimal(400)}
    assert (got["a"]["DriverName"], got["b"]["DriverName"]) == ("A B", "UNKNOWN")
    assert (got["a"]["stayed"], got["b"]["stayed"]) == (0, 1)
