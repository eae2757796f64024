import numpy as np
import pandas as pd
import pytest

from stayline.operators import comoments
from stayline.operators import describe as N


@pytest.fixture(scope="module")
def numbers():
    r = np.random.default_rng(4)
    base = r.standard_normal((4000, 9))
    x = base @ r.standard_normal((9, 30)) + 1e6 * r.standard_normal(30)
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4], x[:, 5] = 0.1, np.nan, np.where(np.isnan(x[:, 6]), x[:, 7], np.nan)  # constant, missing, never together with 6
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(30)])


def test_merged_states_are_those_of_all_rows(numbers):
    x = numbers.to_numpy()
    states = []
    for part in (x[:10], x[10:11], x[11:2000], x[2000:2000], x[2000:]):
        sums = comoments.Sums(30)
        if len(part):
            sums.add(part)
        states.append(sums.state())
    left = states[0]
    for s in states[1:]:
        left = comoments.merged(left, s)
    right = states[-1]
    for s in states[-2::-1]:
        right = comoments.merged(s, right)
    want = numbers.corr().to_numpy()
    for got in (comoments.correlation(left), comoments.correlation(right)):
        assert (np.isnan(got) == np.isnan(want)).all()
        assert np.nanmax(np.abs(got - want)) < 1e-9


@pytest.mark.parametrize("block", [64, 7])
def test_equals_pandas(spark, numbers, block):
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in numbers.to_numpy()], ", ".join(f"{c} DOUBLE" for c in numbers)).repartition(5)
    got = comoments.correlations(df, list(numbers), block).collect()
    assert len(got) == 900
    want = numbers.corr()
    for r in got:
        cell = want.loc[r["x"], r["y"]]
        assert r["r"] is None if np.isnan(cell) else r["r"] == pytest.approx(cell, abs=1e-9), r


def test_two_hundred_columns_in_one_pass(spark):
    df = spark.range(500).selectExpr(*[f"CAST((id * {i + 3}) % {i + 11} AS DOUBLE) AS v{i}" for i in range(200)])
    rows = N.correlations(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 1
    got = {(r["x"], r["y"]): r["r"] for r in rows.collect()}
    assert len(got) == 40_000
    frame = df.toPandas().to_numpy()
    for a, b in ((0, 0), (3, 150), (199, 70)):
        assert got[f"v{a}", f"v{b}"] == pytest.approx(np.corrcoef(frame[:, a], frame[:, b])[0, 1], abs=1e-9)


def test_no_rows(spark):
    got = comoments.correlations(spark.createDataFrame([], "a DOUBLE, b INT"), ["a", "b"]).collect()
    assert all(r["r"] is None for r in got)
