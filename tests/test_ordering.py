import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import text as X
from stayline.operators.ordering import numbered


@pytest.fixture(scope="module")
def words(spark):
    r = random.Random(3)
    rows = [(f"w{i:05d}"[: r.randrange(2, 7)] + str(i), r.choice([1, 1, 1, 1, 2, 3, 50])) for i in range(5000)] + [(None, 4), ("x", None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "word STRING, n BIGINT").repartition(7)


@pytest.mark.parametrize("ranges, sample", [(64, 1024), (5, 40), (1, 1), (64, 3)])
def test_places_are_those_of_a_sort(words, ranges, sample):
    got = sorted(numbered(words, [-F.col("n"), F.col("word")], ranges=ranges, sample=sample).collect(), key=lambda r: r["order"])
    assert [r["order"] for r in got] == list(range(1, words.count() + 1))
    want = sorted(words.collect(), key=lambda r: (r["n"] is not None, -(r["n"] or 0), r["word"] is not None, r["word"] or ""))
    assert [(r["word"], r["n"]) for r in got] == [tuple(r) for r in want]


def test_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "a")] * 300 + [(0, "b")], "k INT, v STRING").repartition(4)
    got = sorted(numbered(same, [F.col("k")]).collect(), key=lambda r: r["order"])
    assert [r["order"] for r in got] == list(range(1, 302)) and got[0]["v"] == "b"
    assert numbered(same.limit(0), [F.col("k")]).collect() == []


def test_rows_are_made_once_and_no_window_holds_all(spark, words):
    from tests.test_registered import final_plan

    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    plan = final_plan(X.numbered_by_frequency(counts))
    assert "Window [row_number" in plan and "Window [row_number() windowspecdefinition(__key" not in plan
    assert "__range" in plan.split("Window [row_number")[1].split("\n")[0]


def test_order_says_when_rows_are_not_sorted(words):
    counts = words.where("word IS NOT NULL AND n IS NOT NULL")
    by_count = {r["word"]: r["order"] for r in X.numbered_by_frequency(counts).collect()}
    by_word = {r["word"]: r["order"] for r in numbered(counts, [F.col("word")]).collect()}
    assert by_count != by_word and sorted(by_count.values()) == sorted(by_word.values())
