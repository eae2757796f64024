"""Readers and sinks.

Readers return lazy DataFrames; filters and column choices made later reach
the scan. Code columns can be brought to one spelling once, at load, because
the systems these tables come from compare text without case or end blanks.
"""

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Column that tells which run a stored row is of.
RUN = "run_key"


# --- readers -----------------------------------------------------------------
def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with a declared schema; blank cells become NULL.

    With a header, columns are found by name (case matters not), whatever their
    order and however many others the file has; a declared column that the file
    lacks is an error. The header line alone is read to learn the names; types
    are never inferred. Without a header, columns are matched by position.
    """
    reader = spark.read.option("header", header).option("mode", "FAILFAST")
    if not header:
        return reader.schema(schema).csv(path)
    declared = {f.name.lower(): f for f in schema.fields}
    names = reader.csv(path).columns  # no inference: every column is text
    missing = set(declared) - {n.lower() for n in names}
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    found = [declared.get(n.lower(), T.StructField(n, T.StringType())) for n in names]
    whole = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, found)])
    return reader.schema(whole).csv(path).select(*[F.col(f"`{n}`").alias(f.name) for f in schema.fields for n in names if n.lower() == f.name.lower()])


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_on: str,
    lower,
    upper,
    parts: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A server table read by `parts` range queries on a numeric or date column."""
    return spark.read.jdbc(
        url,
        table,
        column=split_on,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=parts,
        properties=dict(properties or {}),
    )


def one_spelling(df: DataFrame, known: Mapping[str, Iterable[str]]) -> DataFrame:
    """Bring code columns to one spelling.

    `known` maps a column to the codes that have a fixed spelling. A value equal
    to one of them but for case and end blanks takes that spelling; any other
    value loses its end blanks and is upper-cased, so equal codes group together.
    """
    changed = {}
    for column, codes in known.items():
        bare = F.rtrim(F.col(column))
        spelling = {code.lower(): code for code in codes}
        lookup = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair]) if spelling else None
        found = F.try_element_at(lookup, F.lower(bare)) if spelling else F.lit(None).cast("string")
        changed[column] = F.coalesce(found, F.upper(bare))
    return df.withColumns(changed)


def small_table(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A word list or lexicon held in the program, as literal rows: Spark knows
    its size and broadcasts it only when that is below its threshold."""
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns.items()}))


# --- previews ----------------------------------------------------------------
def preview(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """First n rows; repeatable when an order is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


# --- sinks -------------------------------------------------------------------
def create_table(df: DataFrame, name: str) -> None:
    """Write a new table; fails when it exists."""
    df.write.mode("errorifexists").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Append by column name to an existing table."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).write.mode("append").saveAsTable(name)


def create_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append to the rows under a path, new or not."""
    df.write.mode("append").parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Append the rows of a run, which may be repeated: they take the place of what an earlier try of that run left, other
    runs' rows stay. The run is a column, and a folder of its own."""
    rows = df.withColumn(RUN, F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all runs, the run being the last column."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach.

    Taken from spark.checkpoint.dir. Only a local-mode session, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="stayline-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
