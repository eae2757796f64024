import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import joins as J


@pytest.fixture
def skewed(spark):
    rnd = random.Random(1)
    keys = ["hot"] * 300 + [None] * 50 + ["gone"] * 100 + [f"k{rnd.randrange(80)}" for _ in range(500)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id INT, k STRING")
    right = spark.createDataFrame(
        [("hot", 1), (None, 2)] + [(f"k{i}", i) for i in range(0, 80, 2)], "k STRING, v INT"
    )
    return left, right


@pytest.mark.parametrize("nulls_match", [False, True])
@pytest.mark.parametrize("share", [0.2, 0.05, 0.001])
def test_look_up_equals_left_join(skewed, rows, share, nulls_match):
    left, right = skewed
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = J.heaviest(counts, ["k"], "n", share)
    got = J.look_up(left, right, ["k"], heavy, ["id"], nulls_match)
    other = right.withColumnRenamed("k", "rk")
    same = F.col("k").eqNullSafe(F.col("rk")) if nulls_match else F.col("k") == F.col("rk")
    want = left.join(other, same, "left").select("id", "k", "v")
    assert rows(got) == rows(want)
    assert got.count() == left.count()


def test_common_keys_need_no_counts(skewed):
    left, right = skewed
    assert {r["k"] for r in J.common_keys(left, "k", 0.08).collect()} == {"hot", "gone"}
    assert J.common_keys(left.where("k LIKE 'k%'"), "k", 0.1).collect() == []
    assert J.common_keys(left.limit(0), "k").collect() == []


def test_heavy_rows_are_spread(skewed):
    left, right = skewed
    heavy = J.heaviest(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n", 0.1)
    plan = J.look_up(left, right, ["k"], heavy, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__lane" in plan


def test_only_keys_above_the_share_are_heavy(skewed):
    left, _ = skewed
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {r["k"] for r in J.heaviest(counts, ["k"], "n", 0.1).collect()} == {"hot", "gone"}
    assert J.heaviest(counts.where("k LIKE 'k%'"), ["k"], "n", 0.1).collect() == []
