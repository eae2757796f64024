"""Write a larger, skewed copy of a folder of the generated tables.

python tools/skew.py <folder> <new folder> [copies]

Orders and order lines are copied with shifted keys. In every copy a third of the orders fall to one customer and a third
of the lines to one part and one supplier, so each fact has a key with a third of its rows. All other tables are copied as
they are.
"""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tests.session import make_session  # noqa: E402
from tools.compare import TABLES  # noqa: E402


def main() -> None:
    folder, target = sys.argv[1:3]
    copies = int(sys.argv[3]) if len(sys.argv) > 3 else 20
    spark = make_session()
    for name in TABLES:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name in ("orders", "lineitem"):
            key = "o_orderkey" if name == "orders" else "l_orderkey"
            heavy = ["o_custkey"] if name == "orders" else ["l_partkey", "l_suppkey"]
            span = df.agg(F.max(key)).scalar() + 1
            df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            df = df.withColumn(key, (F.col(key) + F.col("copy") * span).cast(df.schema[key].dataType)).drop("copy")
            row = F.xxhash64(*[c for c in df.columns if c not in heavy])
            df = df.withColumns({c: F.when(F.pmod(row, F.lit(3)) == 0, F.lit(1).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in heavy})
        df.write.parquet(f"{target}/{name}.parquet")


if __name__ == "__main__":
    main()
