import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import describe as N


@pytest.fixture(scope="module")
def numbers():
    rnd = random.Random(7)
    n = 3000
    return pd.DataFrame(
        {
            "g": [rnd.choice(["x", "y", "y"]) for _ in range(n)],
            "smooth": [rnd.gauss(0, 100) for _ in range(n)],
            "ties": [rnd.choice([0.0, 0.0, 0.0, 1.0, 5.0]) for _ in range(n)],
            "heavy": [-3.0 if rnd.random() < 0.4 else rnd.random() for _ in range(n)],
            "gaps": [None if rnd.random() < 0.3 else float(rnd.randrange(40)) for _ in range(n)],
            "flat": [2.0] * n,
            "binary": [float(rnd.random() < 0.7) for _ in range(n)],
        }
    )


@pytest.fixture
def df(spark, numbers):
    data = [tuple(None if pd.isna(x) else x for x in r) for r in numbers.itertuples(index=False)]
    return spark.createDataFrame(data, "g STRING, smooth DOUBLE, ties DOUBLE, heavy DOUBLE, gaps DOUBLE, flat DOUBLE, binary DOUBLE")


COLUMNS = ["smooth", "ties", "heavy", "gaps", "flat", "binary"]


def check_described(got, frame):
    want = frame.describe()
    for r in got:
        c = want[r["column"]]
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%")]:
            assert r[ours] == pytest.approx(c[theirs], abs=1e-9), (r["column"], ours)


def test_describe_equals_pandas(df, numbers):
    got = N.describe(df).collect()
    assert len(got) == len(COLUMNS)
    check_described(got, numbers[COLUMNS])


def test_describe_by_group_equals_pandas(df, numbers):
    got = N.describe(df, by=["g"]).collect()
    assert len(got) == 2 * len(COLUMNS)
    for g in ("x", "y"):
        check_described([r for r in got if r["g"] == g], numbers[numbers["g"] == g][COLUMNS])


@pytest.mark.parametrize("sketch, probs", [(4096, (0.25, 0.5)), (8, (0.0, 0.001, 0.25, 0.4, 0.5)), (64, (0.41, 0.75, 0.999, 1.0)), (200, (0.5,))])
def test_bracketed_quantiles_are_exact(df, numbers, monkeypatch, sketch, probs):
    """Small sketches make brackets that hold a part of the values."""
    monkeypatch.setattr(N, "SKETCH", sketch)
    monkeypatch.setattr(N, "RANK_ERROR", 2.296 / sketch**0.9723)
    got = N.exact_quantiles(N.long_form(df, COLUMNS, ["g"]), ["g", "column"], probs).collect()
    assert len(got) == 2 * len(COLUMNS)
    for r in got:
        values = numbers[numbers["g"] == r["g"]][r["column"]].dropna()
        for i, p in enumerate(probs):
            assert r[f"q{i}"] == pytest.approx(np.quantile(values, p), abs=1e-9), (r, p)


def test_a_missed_bracket_is_an_error(spark, df, monkeypatch):
    monkeypatch.setattr(N, "SLACK", -90)  # brackets turned inside out hold nothing
    monkeypatch.setattr(N, "SKETCH", 64)
    with pytest.raises(Exception, match="outside of its bracket"):
        N.exact_quantiles(N.long_form(df, ["smooth"]), ["column"]).collect()


def test_not_a_number_sorts_last(spark):
    nan = float("nan")
    long = spark.createDataFrame([("c", v) for v in (1.0, 2.0, 3.0, nan, nan)] + [("n", nan)], "column STRING, value DOUBLE")
    got = {r["column"]: (r["q0"], r["q1"], r["q2"]) for r in N.exact_quantiles(long, ["column"]).collect()}
    assert got["c"][:2] == (2.0, 3.0) and all(np.isnan(x) for x in (got["c"][2], *got["n"]))


def test_empty_table(spark):
    got = N.describe(spark.createDataFrame([], "a DOUBLE, g STRING")).collect()
    assert [(r["column"], r["count"], r["p50"]) for r in got] == [("a", 0, None)]
    assert N.describe(spark.createDataFrame([], "a DOUBLE, g STRING"), by=["g"]).collect() == []


def test_quantile_of_few_values(spark):
    long = spark.createDataFrame([("c", float(v)) for v in (4, 1, 3, 2)] + [("one", 9.0)], "column STRING, value DOUBLE")
    got = {r["column"]: (r["q0"], r["q1"], r["q2"]) for r in N.exact_quantiles(long, ["column"]).collect()}
    assert got == {"c": (1.75, 2.5, 3.25), "one": (9.0, 9.0, 9.0)}


def test_nothing_runs_before_it_is_asked_for(spark, df):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    N.describe(df)
    assert set(tracker.getJobIdsForGroup()) == before


def test_grouped_means_equal_pandas(df, numbers):
    want = numbers.groupby("g").mean()
    for r in N.grouped_means(df, "g").collect():
        for c in COLUMNS:
            assert r[c] == pytest.approx(want.loc[r["g"], c])


def test_correlations_equal_pandas(df, numbers):
    want = numbers[COLUMNS].corr()
    got = N.correlations(df, COLUMNS).collect()
    assert len(got) == len(COLUMNS) ** 2
    for r in got:
        cell = want.loc[r["x"], r["y"]]
        assert r["r"] is None if pd.isna(cell) else r["r"] == pytest.approx(cell, abs=1e-9)


def test_histogram_equals_numpy(df, numbers):
    got = {}
    for r in N.histogram(df, COLUMNS).collect():
        got.setdefault(r["column"], [0] * 10)[r["bin"] - 1] = r["n"]
    for c in COLUMNS:
        counts, _ = np.histogram(numbers[c].dropna(), bins=10)
        assert got[c] == counts.tolist(), c


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a DOUBLE, b DOUBLE")
    got = {r["column"]: (r["count"], r["std"], r["p50"]) for r in N.describe(df).collect()}
    assert got == {"a": (1, None, 2.0), "b": (1, None, 1.0)}
    assert N.numeric_columns(df.withColumn("s", F.lit("x"))) == ["a", "b"]
