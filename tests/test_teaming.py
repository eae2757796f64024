import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.operators import teaming as T
from stayline.plans import team_history
from stayline.sources import schemas, tables

T0 = datetime(2017, 8, 1, 6)
FIRST, LAST = date(2017, 8, 1), date(2018, 1, 31)


def legs(spark, *items):
    """(driver1, driver2, start[, class, start city, end city, number])"""
    data = []
    for i, item in enumerate(items):
        one, two, start, cls, s, e, number = (*item, *(None,) * (7 - len(item)))
        data.append(
            ("o", number or str(i), one, two, start, start + timedelta(hours=5) if start else None,
             "TM" if cls is None else cls, "d", s or "1", e or "2", "t")
        )
    return spark.createDataFrame(data, schemas.LEGS)


@pytest.fixture
def city(spark):
    return spark.createDataFrame([("1", "z", 6), ("2", "z", 5)], schemas.CITY)


def history(spark, city, *items, mode="as_written"):
    return team_history.history(legs(spark, *items), city, FIRST, LAST, mode)


# --- legs --------------------------------------------------------------------
def test_clean_legs(spark, rows):
    items = [
        ("\tA ", " B\r\n", T0),
        ("xUNKx", "B", T0),
        ("UNKNOWN", "B", T0),
        (None, "B", T0),
        ("C", "B", datetime(2018, 1, 31, 23, 59)),
        ("D", "B", datetime(2018, 2, 1)),
        ("E", "B", datetime(2017, 7, 31, 23, 59)),
        ("F", "B", T0, "SOLU"),
    ]
    df = legs(spark, *items)
    df = df.unionByName(legs(spark, ("G", "B", T0)).withColumn("lgh_class1", F.lit(None).cast(schemas.TYPES["CODE"])))
    df = df.unionByName(legs(spark, ("H", "B", T0)).withColumn("lgh_number", F.lit(None).cast("string")))
    df = df.unionByName(legs(spark, ("I", "B", T0)).withColumn("ord_hdrnumber", F.lit(None).cast("string")))
    assert rows(T.clean_legs(df, FIRST, LAST), *T.PAIR) == [("A", "B"), ("C", "B"), (None, "B")]


def test_shift_uses_each_city_and_drops_unlisted(spark, city):
    df = legs(spark, ("A", "B", T0), ("A", "B", T0, "TM", "1", "9"), ("A", "B", T0, "TM", "9", "2"))
    (r,) = T.shift_legs(df, city).collect()
    assert r["lgh_startdateGMT"] == T0 + timedelta(hours=6)
    assert r["lgh_startdateEST"] == T0 + timedelta(hours=2)
    assert r["lgh_enddateEST"] == T0 + timedelta(hours=5 + 5 - 4)
    assert r["lgh_hours"] == 4.0


def test_leg_count_on_every_leg(spark, city):
    items = [("A", "B", T0)] * 5 + [("B", "A", T0)] + [(None, "B", T0)] * 2 + [("A", None, T0)] * 3
    shifted = T.shift_legs(legs(spark, *items), city)
    got = sorted((str(r[0]), str(r[1]), r[2]) for r in T.with_leg_count(shifted).select(*T.PAIR, "leg_count").collect())
    assert got == sorted(
        [("A", "B", 5)] * 5 + [("B", "A", 1)] + [("None", "B", 2)] * 2 + [("A", "None", 3)] * 3
    )


# --- pairs -------------------------------------------------------------------
def test_directions_count_apart_as_written_and_together_as_intended(spark, city, rows):
    items = [("A", "B", T0 + timedelta(days=1))] * 3 + [("B", "A", T0)] * 2
    got = rows(history(spark, city, *items), "DriverID", "team_binary", "leg_count")
    assert got == [("A", 1.0, 2), ("B", 1.0, 2)]
    got = rows(history(spark, city, *items, mode="as_intended"), "DriverID", "team_binary", "leg_count")
    assert got == [("A", 1.0, 5), ("B", 1.0, 5)]


def test_unknown_and_missing_partners(spark, city, rows):
    items = [("A", "UNKNOWN", T0), ("A", "UNK7", T0), ("A", None, T0)]
    got = rows(history(spark, city, *items), "DriverID", "team_binary")
    # UNKNOWN never becomes a person; a missing partner is no person either
    assert got == [("A", 0.0), ("A", 1.0), ("A", None), ("UNK7", 1.0)]


def test_row_names_are_unique(spark, city):
    items = [("A", "B", T0), ("A", "UNKNOWN", T0), ("A", None, T0), ("A", "", T0), ("B", "C", T0)]
    df = history(spark, city, *items)
    assert df.select("rownames").distinct().count() == df.count()


def test_equal_starts_are_decided_by_end(spark, city):
    early, late = legs(spark, ("A", "B", T0)), legs(spark, ("A", "B", T0))
    late = late.withColumn("lgh_enddate", F.col("lgh_enddate") + F.expr("INTERVAL '1' HOUR"))
    for df in (early.unionByName(late), late.unionByName(early)):
        got = team_history.history(df, city, FIRST, LAST).where("DriverID = 'A'").first()
        assert got["lgh_enddateEST"] == T0 + timedelta(hours=6)


def brute_force_pairs(items, keep_last):
    """Count, swap, stack, sort, keep the first (and last) row of each pair."""
    counts = {}
    for one, two, *_ in items:
        counts[one, two] = counts.get((one, two), 0) + 1
    stacked = {}
    for one, two, start in items:
        row = (start + timedelta(hours=2), start + timedelta(hours=6), counts[one, two])
        stacked.setdefault((one, two), []).append(row)
        stacked.setdefault((two, one), []).append(row)
    out = []
    for pair, found in stacked.items():
        found.sort()
        out.append((*pair, "first", *found[0]))
        if keep_last and len(found) > 1:
            out.append((*pair, "last", *found[-1]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, city, seed):
    rnd = random.Random(seed)
    people = ["A", "B", "C", "D"]
    items = [(rnd.choice(people), rnd.choice([*people, "UNKNOWN"]), T0 + timedelta(days=rnd.randrange(9))) for _ in range(25)]
    items += [("A", "UNKNOWN", T0 + timedelta(days=3))] * 20
    shifted = T.shift_legs(legs(spark, *items), city)
    cols = [*T.PAIR, "which", "lgh_startdateEST", "lgh_enddateEST", "leg_count"]
    both = sorted(tuple(r) for r in T.pair_legs(shifted, keep_last=True).select(cols).collect())
    assert both == brute_force_pairs(items, True)
    first = T.pair_legs(shifted).withColumn("which", F.lit("first"))
    assert sorted(tuple(r) for r in first.select(cols).collect()) == brute_force_pairs(items, False)


def test_swapping_all_legs_changes_no_pair(spark, city, rows):
    items = [("A", "B", T0), ("B", "C", T0), ("C", "A", T0 + timedelta(days=1)), ("A", "B", T0 + timedelta(days=2))]
    mirrored = [(two, one, start) for one, two, start in items]
    cols = ["DriverID", "team_binary", "leg_count", "lgh_enddateEST"]
    assert rows(history(spark, city, *items), *cols) == rows(history(spark, city, *mirrored), *cols)


# --- people ------------------------------------------------------------------
def teaming_rows(spark, *items):
    return spark.createDataFrame([(n, d, b, c, None) for n, d, b, c in items], schemas.TEAMING)


def added(spark, *people):
    return spark.createDataFrame(
        list(people), "mpp_id STRING, Drivertype STRING, seniority INT, CSA DOUBLE, Violations BIGINT, Critical BIGINT"
    )


HISTORY = [("9", "a", 1.0, 1), ("10", "a", 0.0, 2), ("10", "a", None, 4), ("7", "b", 0.0, 5)]


def test_team_statistics(spark):
    people = added(
        spark, ("a", "OTR", 4, 6.0, 9, 1), ("b", "OTR", 0, 6.0, 9, 1), ("c", "OTR", 61, 0.0, 0, 1), ("x", "Trainer", 5, 0.0, 0, 1)
    )
    got = {r["mpp_id"]: r for r in T.with_team_stats(people, teaming_rows(spark, *HISTORY)).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["numteams"], a["partsolo"], a["avgtenure"], a["maxrank"]) == (2, 1.0, 2, 2)
    assert a["stdevtenure"] == pytest.approx(statistics.stdev([1, 2, 4]))
    assert (a["CSA_month"], a["Vio_month"], a["seniority"]) == (1.5, 2, "6 months")
    assert (b["numteams"], b["stdevtenure"], b["CSA_month"], b["Vio_month"]) == (1, 0.0, 0.0, 0)
    assert (c["numteams"], c["partsolo"], c["avgtenure"], c["stdevtenure"], c["maxrank"]) == (0, None, None, 0.0, 1)


def test_whole_averages_can_be_switched_off(spark):
    people = added(spark, ("a", "OTR", 4, 6.0, 9, 1))
    got = T.with_team_stats(people, teaming_rows(spark, *HISTORY), integers="as_intended").first()
    assert got["Vio_month"] == 2.25


def test_repeated_people_as_written(spark):
    people = added(spark, ("a", "OTR", 4, 6.0, 9, 1), ("a", "OTR", 4, 6.0, 9, 2))
    got = T.with_team_stats(people, teaming_rows(spark, *HISTORY), fanout="as_written").collect()
    assert len(got) == 2
    for r in got:
        assert (r["numteams"], r["partsolo"], r["avgtenure"], r["maxrank"]) == (4, 2.0, 2, 2)
        assert r["stdevtenure"] == pytest.approx(statistics.stdev([1, 2, 4] * 2))


def test_expirations_keep_all_columns(spark, rows):
    people = added(spark, ("a", "OTR", 4, 6.0, 9, 1), ("b", "OTR", 4, 6.0, 9, 1))
    listed = spark.createDataFrame([("a", "x"), ("a", "y"), ("q", "z")], "DriverID STRING, seniority STRING")
    got = T.with_expirations(people, listed)
    assert rows(got, "mpp_id", "seniority", "eto_seniority") == [("a", 4, "x"), ("a", 4, "y")]


# --- sink --------------------------------------------------------------------
def test_history_table_is_created_once_and_appended(spark, city, tmp_path):
    name = f"teaming_{abs(hash(str(tmp_path)))}"
    df = history(spark, city, ("A", "B", T0))
    df.write.format("parquet").option("path", str(tmp_path / "t")).saveAsTable(name)
    try:
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            team_history.save(df, name)
        team_history.save(history(spark, city, ("C", "D", T0)).select("leg_count", "rownames", "DriverID", "lgh_enddateEST", "team_binary"), name, append=True)
        assert sorted(r["DriverID"] for r in spark.table(name).collect()) == ["A", "B", "C", "D"]
        assert tables.preview(spark.table(name), 1, ["DriverID"]).first()["DriverID"] == "A"
    finally:
        spark.sql(f"DROP TABLE {name}")
