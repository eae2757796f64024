from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stayline import constants as K
from stayline.operators import pay as P
from stayline.sources import schemas, tables


def test_csv_with_declared_schema(spark, tmp_path, rows):
    (tmp_path / "hr.csv").write_text("EMPLOYID,GENDER,ETHNORGN,MARITALSTATUS\n12,1,,2\n13,,5,\n")
    df = tables.read_csv(spark, str(tmp_path / "hr.csv"), schemas.HR)
    assert df.schema == schemas.HR
    assert rows(df) == [("12", 1, None, 2), ("13", None, 5, None)]


def test_csv_columns_are_found_by_name(spark, tmp_path, rows):
    (tmp_path / "hr.csv").write_text("Plant,MARITALSTATUS,ethnorgn,EMPLOYID,GENDER,Note\nx,2,1,12,0,y\n")
    df = tables.read_csv(spark, str(tmp_path / "hr.csv"), schemas.HR)
    assert df.schema == schemas.HR
    assert rows(df) == [("12", 0, 1, 2)]


def test_csv_without_a_declared_column_is_refused(spark, tmp_path):
    (tmp_path / "hr.csv").write_text("EMPLOYID,ETHNORGN,GENDER\n12,1,2\n")
    with pytest.raises(ValueError, match="maritalstatus"):
        tables.read_csv(spark, str(tmp_path / "hr.csv"), schemas.HR)


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "p"), ("b", "n")], schemas.LEXICON)
    tables.write_csv(df, str(tmp_path / "out"))
    assert rows(tables.read_csv(spark, str(tmp_path / "out"), schemas.LEXICON)) == [("a", "p"), ("b", "n")]


def test_parquet_sink_does_not_overwrite(spark, tmp_path, rows):
    df = spark.createDataFrame([("a",)], schemas.WORDS)
    tables.create_parquet(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.create_parquet(df, str(tmp_path / "t"))
    assert rows(tables.read_parquet(spark, str(tmp_path / "t"), schemas.WORDS)) == [("a",)]


def test_parquet_read_prunes_and_pushes(spark, tmp_path):
    df = spark.createDataFrame([("x", datetime(2018, 1, 1), "DRV")], "id STRING, period TIMESTAMP_NTZ, kind STRING")
    tables.create_parquet(df, str(tmp_path / "p"))
    from stayline.functions import scalars as S

    plan = tables.read_parquet(spark, str(tmp_path / "p")).where(F.col("period") >= S.ntz(datetime(2017, 1, 1))).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(period" in text and "kind" not in text.split("ReadSchema")[1]


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark) == folder
    one, two = tables.new_path(spark, "t"), tables.new_path(spark, "t")
    assert one != two and one.startswith(folder)


def test_one_spelling(spark, rows):
    df = spark.createDataFrame([("Company ", "hotel"), ("COMPANY", "Hotel "), ("Lease", "new"), (None, "NEW ")], "t STRING, c STRING")
    got = tables.one_spelling(df, {"t": [K.COMPANY], "c": K.BUCKETED_CODES})
    assert rows(got) == [("LEASE", "NEW"), ("company", "HOTEL"), ("company", "HOTEL"), (None, "NEW")]
    assert rows(tables.one_spelling(df, {"t": []}), "t")[0] == ("COMPANY",)


def test_one_spelling_feeds_the_class_codes(spark, rows):
    df = spark.createDataFrame([("td1 ",), ("Tr40fl",)], "mpp_type2 STRING")
    known = [c for codes in K.DRIVER_CLASSES.values() for c in codes]
    got = tables.one_spelling(df, {"mpp_type2": known}).select(P.S.driver_class("mpp_type2").alias("d"))
    assert rows(got) == [("Team Driver_Student",), ("Trainer",)]


def test_preview_needs_an_order_to_repeat(spark):
    df = spark.range(100).repartition(7)
    assert [r[0] for r in tables.preview(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert tables.preview(df, 3).count() == 3


def test_handover_is_made_once_and_removed(spark, tmp_path):
    import os

    from stayline.sources.handover import Handover

    rows = spark.range(50).select("id", (F.col("id") % 3).alias("k"))
    with Handover(spark) as kept:
        stored = kept.stored(rows, "rows")
        folder = kept.paths[0].removeprefix("file:")
        assert stored.groupBy("k").count().count() == 3 and stored.where("k = 1").count() == 17
        assert stored.dtypes == rows.dtypes and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.paths == []


def test_a_run_may_be_repeated(spark, tmp_path):
    from stayline.sources import tables

    path, rows = str(tmp_path / "runs"), spark.range(5)
    for run, n in (("a", 5), ("b", 2), ("a", 4)):  # the second try of a run gives other rows
        tables.append_run(rows.limit(n), path, run)
    got = tables.read_runs(spark, path, rows.schema)
    assert got.columns == ["id", tables.RUN]
    assert {r[tables.RUN]: r["count"] for r in got.groupBy(tables.RUN).count().collect()} == {"a": 4, "b": 2}


def test_tables_are_created_once_and_appended_to(spark):
    import uuid

    from stayline.sources import tables

    name = f"teaming_{uuid.uuid4().hex}"
    try:
        tables.create_table(spark.range(3).select("id", F.lit("x").alias("v")), name)
        with pytest.raises(Exception, match="already exists"):
            tables.create_table(spark.range(3).select("id", F.lit("x").alias("v")), name)
        tables.append_table(spark.range(2).select(F.lit("y").alias("v"), "id"), name)  # columns are found by name
        assert sorted(tuple(r) for r in spark.table(name).collect()) == [(0, "x"), (0, "y"), (1, "x"), (1, "y"), (2, "x")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
