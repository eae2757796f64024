import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import crosstab as C
from stayline.operators import demographics as D
from stayline.plans import demographics
from stayline.sources import schemas


@pytest.fixture(scope="module")
def people():
    rnd = random.Random(5)
    return pd.DataFrame(
        {
            "stayed": [rnd.choice(["Left", "Stayed", None]) for _ in range(200)],
            "m": [rnd.choice(["MARRIED", "SINGLE", "UNKNOWN", None]) for _ in range(200)],
            "d": [rnd.choice(["none", "1", "2+"]) for _ in range(200)],
            "v": [rnd.choice([None, 1.0, 2.5, 7.0]) for _ in range(200)],
        }
    )


@pytest.fixture
def df(spark, people):
    return spark.createDataFrame(
        [tuple(None if pd.isna(x) else x for x in r) for r in people.itertuples(index=False)],
        "stayed STRING, m STRING, d STRING, v DOUBLE",
    )


def test_crosstab_equals_pandas(df, people):
    want = pd.crosstab(people["stayed"], people["m"], margins=True)
    got = {(r["stayed"], r["m"]): r["n"] for r in C.crosstab(df, "stayed", "m").collect()}
    assert got == {(i, c): want.loc[i, c] for i in want.index for c in want.columns}


def test_crosstab_with_two_columns_equals_pandas(df, people):
    want = pd.crosstab(people["stayed"], [people["m"], people["d"]], margins=True)
    got = {(r["stayed"], (r["m"], r["d"])): r["n"] for r in C.crosstab(df, "stayed", ["m", "d"]).collect()}
    assert got == {(i, c): want.loc[i, c] for i in want.index for c in want.columns if want.loc[i, c]}


def test_shares_equal_pandas(df, people):
    table = pd.crosstab(people["stayed"], people["m"], margins=True)
    want = table / table.loc["All"]
    for r in C.with_share(C.crosstab(df, "stayed", "m"), "stayed", "m").collect():
        assert r["share"] == pytest.approx(want.loc[r["stayed"], r["m"]])


def test_wide_fills_empty_cells(spark, rows):
    df = spark.createDataFrame([("Left", "a"), ("Stayed", "b")], "stayed STRING, x STRING")
    assert rows(C.wide(C.crosstab(df, "stayed", "x"), "stayed", "x", ["a", "b", "All"])) == [
        ("All", 1, 1, 2), ("Left", 1, 0, 1), ("Stayed", 0, 1, 1),
    ]


def test_pivot_means_equal_pandas(df, people):
    want = pd.pivot_table(people, values="v", index=["stayed", "d"], columns="m")
    for labels in (["MARRIED", "SINGLE", "UNKNOWN"], None):
        for r in C.pivot_means(df, "v", ["stayed", "d"], "m", labels).collect():
            for m in want.columns:
                cell = want.loc[(r["stayed"], r["d"]), m]
                assert r[m] is None if pd.isna(cell) else r[m] == pytest.approx(cell)


# --- people ------------------------------------------------------------------
HR = [("1", 1, 8, 1), ("2", 3, 9, 0), ("3", None, None, None), ("4", 2, 7, 9), ("5", 1, 1, 2)]
DEPENDENTS = (
    [("1", str(i)) for i in range(9)]
    + [("2", str(i)) for i in range(11)]
    + [("3", None), ("3", None)]
    + [(None, "x")]
    + [("5", "a"), ("5", None), ("5", "b")]
)


@pytest.fixture
def hr_people(spark):
    return D.hr_people(spark.createDataFrame(HR, schemas.HR), spark.createDataFrame(DEPENDENTS, schemas.DEPENDENTS))


def test_dependents_are_counted_per_employee(hr_people, rows):
    assert rows(hr_people, "mpp_id", "DEPENDENTSSN") == [("1", 9), ("2", 11), ("3", 0), ("4", None), ("5", 2)]


def retention(spark, id_type="STRING", ids=("1", "2", "3", "4", "5", "6")):
    df = spark.createDataFrame([(i, k % 2, 1.5) for k, i in enumerate(ids)], f"mpp_id {id_type}, stayed INT, dayshome DOUBLE")
    return df.withColumns({"phone": F.lit("secret"), "CSA_month": F.lit(1.0)})


def test_people_are_labelled(spark, hr_people, rows):
    got = demographics.people(
        retention(spark), spark.createDataFrame(HR, schemas.HR), spark.createDataFrame(DEPENDENTS, schemas.DEPENDENTS)
    )
    assert "phone" not in got.columns and "CSA_month" not in got.columns
    assert rows(got, "mpp_id", "stayed", "GENDER", "MARITALSTATUS", "ETHNORGN", "DEPENDENTSSN") == [
        ("1", "Left", "MALE", "MARRIED", "Pacific Islander", "2+"),
        ("2", "Stayed", "UNKNOWN", "UNKNOWN", "9", "2+"),
        ("3", "Left", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
        ("4", "Stayed", "FEMALE", "9", "UNKNOWN", "UNKNOWN"),
        ("5", "Left", "MALE", "SINGLE", "WHITE", "1"),
        ("6", "Stayed", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
    ]


def test_numeric_ids_match_text_ids(spark, hr_people):
    got = D.retention_people(retention(spark, "DOUBLE", (1.0, 2.0)), hr_people)
    assert {r["mpp_id"]: r["GENDER"] for r in got.collect()} == {"1": 1, "2": 3}


def test_duplicate_employee_gives_two_rows(spark):
    hr = spark.createDataFrame([("1", 1, 1, 1), ("1", 2, 1, 1)], schemas.HR)
    people = D.hr_people(hr, spark.createDataFrame(DEPENDENTS, schemas.DEPENDENTS))
    assert D.retention_people(retention(spark, ids=("1",)), people).count() == 2


def test_cohort_split_covers_everybody(spark):
    got = demographics.people(
        retention(spark), spark.createDataFrame(HR, schemas.HR), spark.createDataFrame(DEPENDENTS, schemas.DEPENDENTS)
    )
    parts = [demographics.cohort(got, label).count() for label in demographics.STAYED]
    assert sum(parts) == got.count()


def test_labels_that_read_like_margins(spark):
    df = spark.createDataFrame([("Left", "All"), ("Left", "M"), ("Stayed", "M"), ("Left", "")], "stayed STRING, x STRING")
    got = {(r["stayed"], r["x"], r[C.ROW_TOTAL], r[C.COLUMN_TOTAL]): r["n"] for r in C.crosstab(df, "stayed", "x", keep_levels=True).collect()}
    assert got["Left", "All", 0, 0] == 1 and got["Left", "All", 0, 1] == 3
    assert got["All", "All", 1, 0] == 1 and got["All", "All", 1, 1] == 4 and got["All", "", 1, 0] == 1
    shares = {(r["stayed"], r["x"], r[C.COLUMN_TOTAL]): r["share"] for r in C.with_share(C.crosstab(df, "stayed", "x", keep_levels=True), "stayed", "x").collect() if r[C.ROW_TOTAL] == 0}
    assert shares["Left", "All", 0] == 1.0 and shares["Left", "All", 1] == 0.75


def test_several_crosstabs_in_one_pass(spark, rows):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", "p"), ("b", "x", "p"), (None, "x", "p")], "s STRING, u STRING, v STRING")
    want = [("u", *r) for r in rows(C.crosstab(df, "s", "u"))] + [("v", *r) for r in rows(C.crosstab(df, "s", "v"))]
    assert rows(C.crosstab_each(df, "s", ["u", "v"])) == sorted(want)
