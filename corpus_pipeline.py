"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.

1. toxicity: the grammar's model is learned from `labels` of `sf_dir`; documents at or above the threshold go.
2. quality: the cascade of rules; documents that a rule rejects go.
3. minhash: of documents linked at a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays.
4. mixture: sources are taken by their target weights; a document comes once per pass over its source, with the words that
   the mix takes of it in that pass, so documents of lightly weighted sources may be missing and others repeated.
5. bpe: (doc_id, ids) per row of the mix.

Nulls, empty and repeated rows, and empty tables are treated as each operator's docstring says: empty texts are not toxic
and fail the quality rules. Other columns are carried to the fourth stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import bpe, minhash, mixing, quality, toxicity
from stayline.llm.common import written
from stayline.llm.queries import bpe_parameters


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filtered(docs, toxicity.fitted(docs, labels))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.filtered(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe_parameters())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("minhash", without_near_duplicates),
    ("mixture", mixture),
    ("bpe", tokens),
]
#: SQL has no way to say the learned, pseudorandom and tokenising stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
