"""Written tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs
a re-read and never a re-computation of the steps before.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one, as in tests, gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cinnabar-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session; they may not share the driver's path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = __name__.split(".")[0]
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name), "zip", root, name)
        context.addPyFile(made)


class Store:
    """A folder of tables of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the frame that reads it back; shuffle files that led to it go at once."""
        schema, to, conf = df.schema, f"{self.path}/{name}", self.spark.conf
        before = conf.get(CLEAN, None)
        conf.set(CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(to)
        finally:
            conf.set(CLEAN, before) if before is not None else conf.unset(CLEAN)
        return self.spark.read.schema(schema).parquet(to)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
