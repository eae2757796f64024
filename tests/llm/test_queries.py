"""Every query against its SQL on the smallest tables, and the pipeline's stages against plain versions."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stayline.llm import queries
from tests.llm.samples import documents, empty
from tools.compare import connect, oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want, names = oracle_rows(connect(FOLDER), queries.SQL[name])
    assert sorted(names) == sorted(df.columns)
    assert spark_rows(df) == want


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_stages_keep_columns_and_bear_anything(spark):
    for start in (documents(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns == ["doc_id", "ids"]


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "ids"] and rows.count() > 0
