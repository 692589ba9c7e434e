"""Written tables that cut lineage, in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one, as in tests, gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Stage:
    """A folder of tables of one call; each is read back after it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one task of an exchange that parted deals.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, n: int, rows: int = TASK_ROWS) -> int:
    """How many tasks n rows are dealt over."""
    return max(math.ceil(n / rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / 10_000)), 1)


def parted(df: DataFrame, *keys: str, rows: int = TASK_ROWS, count: int | None = None) -> DataFrame:
    """df dealt by keys over so many partitions that a task has about so many rows, however large the table is.

    What is grouped by keys, or by more columns, then needs no exchange of its own. Without its count df is counted first, so it should be cheap to read.
    """
    return df.repartition(tasks(df.sparkSession, df.count() if count is None else count, rows), *keys)
