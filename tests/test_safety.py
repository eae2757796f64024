import random
from datetime import datetime
from itertools import product

import pytest

from stayline.operators import safety

AS_OF = datetime(2018, 2, 1)
DAY1, DAY2 = datetime(2018, 1, 10), datetime(2018, 1, 20)


def tables(spark, events=(), accidents=(), violations=()):
    return (
        spark.createDataFrame(list(events), "DriverID STRING, EventTrigger STRING"),
        spark.createDataFrame(list(accidents), "MISC2_NM STRING, REPORT_DT TIMESTAMP_NTZ, SPECIAL23 STRING"),
        spark.createDataFrame(list(violations), "DriverName STRING, ViolationValue STRING"),
    )


def model(spark, *people):
    return spark.createDataFrame(
        [(i, name, datetime(2018, 1, 31)) for i, name in people], "mpp_id STRING, DriverName STRING, mpp_hiredate TIMESTAMP_NTZ"
    )


EVENTS = [("a", "brake"), ("a", "speed"), ("a", None), ("a", "Lane-Departure"), ("a", "xLane_Departurex"), ("z", "brake")]
ACCIDENTS = [("a", DAY1, "Chargeable"), ("a", DAY1, "Chargeable"), ("a", DAY2, "Chargeable"), ("a", DAY2, "Other")]
VIOLATIONS = [("A A", "2"), ("A A", "3.5"), ("A A", None), ("UNKNOWN", "1")]
STAR = ["mpp_id", "Critical", "seniority", "daystoacc", "CSA", "Violations"]


def test_star_counts_each_table_once(spark, rows):
    people = model(spark, ("a", "A A"), ("b", "A A"), ("c", "UNKNOWN"), ("d", "UNKNOWN"), ("e", "E"))
    got = rows(safety.safety_star(people, *tables(spark, EVENTS, ACCIDENTS, VIOLATIONS), AS_OF).select(STAR))
    assert got == [
        ("a", 2, 1, 12, 5.5, 2),
        ("b", 0, 1, 10000, 5.5, 2),
        ("c", 0, 1, 10000, 1.0, 1),
        ("d", 0, 1, 10000, 1.0, 1),
        ("e", 0, 1, 10000, 0.0, 0),
    ]


def test_lane_departure_pattern_matches_any_character(spark, rows):
    # the underscore of the pattern stands for any one character
    counted = safety.event_counts(tables(spark, EVENTS)[0])
    assert rows(counted) == [("a", 2), ("z", 1)]


def test_star_as_written_multiplies(spark, rows):
    people = model(spark, ("a", "A A"))
    got = rows(safety.safety_star(people, *tables(spark, EVENTS, ACCIDENTS, VIOLATIONS), AS_OF, mode="as_written").select(STAR))
    # 2 events x 3 violation rows x 2 or 1 accidents on one date
    assert got == [("a", 12, 1, 12, 22.0, 8), ("a", 6, 1, 12, 11.0, 4)]


def brute_force_as_written(people, events, accidents, violations):
    """Join row by row, group, drop duplicates."""
    out = set()
    for id_, name in people:
        e = [t for d, t in events if d == id_ and t is not None and "Lane_Departure" not in t] or [None]
        a = [d for m, d, kind in accidents if m == id_ and kind == "Chargeable"] or [None]
        v = [x for n, x in violations if n == name] or [None]
        groups = {}
        for trigger, day, value in product(e, a, v):
            groups.setdefault(day, []).append((trigger, value))
        days = [(AS_OF - d).days for d in a if d is not None]
        for joined in groups.values():
            values = [float(x) for _, x in joined if x is not None]
            out.add((id_, sum(t is not None for t, _ in joined), min(days, default=10000), sum(values), len(values)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_written_equals_row_by_row(spark, seed):
    rnd = random.Random(seed)
    people = [(f"p{i}", rnd.choice(["A", "B", "UNKNOWN", f"N{i}"])) for i in range(8)]
    ids = [p for p, _ in people]
    events = [(rnd.choice(ids), rnd.choice(["x", "y", None])) for _ in range(20)]
    accidents = [(rnd.choice(ids), rnd.choice([DAY1, DAY2]), rnd.choice(["Chargeable", "Other"])) for _ in range(14)]
    violations = [(rnd.choice(["A", "B", "UNKNOWN", "N1"]), rnd.choice(["1", "2.5", None])) for _ in range(12)]
    got = safety.safety_star(model(spark, *people), *tables(spark, events, accidents, violations), AS_OF, mode="as_written")
    got = sorted(tuple(r) for r in got.select("mpp_id", "Critical", "daystoacc", "CSA", "Violations").collect())
    assert got == brute_force_as_written(people, events, accidents, violations)


def test_violations_by_id_are_not_shared(spark, rows):
    people = model(spark, ("a", "A A"), ("b", "A A"))
    filed = spark.createDataFrame([("a", "2"), ("a", "1")], "mpp_id STRING, ViolationValue STRING")
    events, accidents, _ = tables(spark)
    got = safety.safety_star(people, events, accidents, filed, AS_OF, violation_key="mpp_id")
    assert rows(got, "mpp_id", "CSA", "Violations") == [("a", 3.0, 2), ("b", 0.0, 0)]


def test_bad_violation_value_is_an_error(spark):
    people = model(spark, ("a", "A A"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        safety.safety_star(people, *tables(spark, violations=[("A A", "n/a")]), AS_OF).collect()
