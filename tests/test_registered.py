"""Every registered query against its reference SQL, and the shape of key plans."""

import re

import pytest

import __spark_entry__ as entry
from stayline.analogue.catalog import QUERIES
from tools.compare import connect, oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
RUNS = {name: query.run for name, query in QUERIES.items()}


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(RUNS))
def test_query_agrees_with_sql(spark, oracle, name):
    df = RUNS[name](spark, FOLDER)
    got = spark_rows(df)
    want, names = oracle_rows(oracle, QUERIES[name].reference())
    assert sorted(df.columns) == sorted(names)
    assert got == want
    assert got


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def outer_plan(text):
    """The plan that ran, with its subqueries' plans as they ran; the initial plans, of subqueries too, are left out.

    Plans are nested by indentation: an initial plan goes on until a line that stands left of its mark.
    """
    kept, skipped = [], None
    for line in text.replace("\t\r\n", "").split("\n"):  # trimmed characters are shown as they are
        place = re.search(r"[^\s:|+-]", line)
        place = place.start() if place else len(line)
        if skipped is not None and (place >= skipped or not line.strip()):
            continue
        skipped = None
        if "== Initial Plan ==" in line:
            skipped = line.index("==")
            continue
        kept.append(line)
    return "\n".join(kept)


def final_plan(df):
    df.collect()
    return outer_plan(df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast by size."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def test_pay_fact_is_read_once(spark, no_broadcast):
    plan = final_plan(RUNS["cohort_union"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert "ReusedExchange" in plan


def test_summary_reads_pay_and_legs_once_each(spark, no_broadcast):
    plan = final_plan(RUNS["cohort_summary"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2
    assert "Window" not in plan


def test_summary_reads_few_profiles(spark, no_broadcast):
    plan = final_plan(RUNS["cohort_summary"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[c_", plan)) <= 5
    assert plan.count("partial_avg(endorsecount") == 1


def test_describe_reads_its_table_twice(spark):
    df = RUNS["describe_numeric"](spark, FOLDER)
    plan = final_plan(df)
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 60_000 and len(plan) < 30_000


def test_codes_are_hashed_not_sorted(spark, no_broadcast):
    plan = final_plan(RUNS["pay_code_buckets"](spark, FOLDER))
    assert "SortAggregate" not in plan and "UTF8_LCASE_RTRIM" in plan


def test_inner_orders_are_not_sorted(spark):
    plan = final_plan(RUNS["top_terms_liked"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_pay_chain_shuffles_once_after_the_join(spark, no_broadcast):
    plan = final_plan(RUNS["weekly_rollup"](spark, FOLDER))
    exchanges = re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", plan)
    # two for the analogue join, one for the totals, one per side of the interval join
    assert len(exchanges) == 5, exchanges


def test_legs_are_read_once(spark, no_broadcast):
    plan = final_plan(RUNS["team_first_leg"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert "Window" not in plan


#: Queries whose operator multiplies matrices in Python.
MATRICES = {"corr_matrix_many"}


@pytest.mark.parametrize("name", sorted(set(RUNS) - MATRICES))
def test_no_cross_join_and_no_python(spark, name):
    plan = RUNS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan


def test_bounds_reach_the_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = RUNS["pay_code_buckets"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(o_orderdate", plan)
    plan = RUNS["leg_clean"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(l_shipdate", plan) and re.search(r"LessThan\(l_shipdate", plan)
