"""Rows that several results of one run read, stored once and removed when the run is over."""

from __future__ import annotations

import atexit
from contextlib import suppress
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from stayline.sources.tables import new_path


class Handover:
    """Stores rows in the shared folder, under paths of its own, and removes them on `close` or at the end of its block.

    What is stored is written once and read by whoever wants it, so the plan behind it runs once, a lost executor costs a
    re-read, and several results are of the same rows. Results must be read before the rows are removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        """A new path that is removed with the rest."""
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str = "rows") -> DataFrame:
        path = self.path(name)
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> Handover:
        return self

    def __exit__(self, *_) -> None:
        self.close()


_OF_SESSION: WeakKeyDictionary[SparkSession, Handover] = WeakKeyDictionary()


def of_session(spark: SparkSession) -> Handover:
    """A hand-over for results that are read after the call that makes them: removed when the program ends."""
    if spark not in _OF_SESSION:
        _OF_SESSION[spark] = found = Handover(spark)

        def close() -> None:
            with suppress(Exception):  # the session may be gone, or the store out of reach
                found.close()

        atexit.register(close)
    return _OF_SESSION[spark]
