"""Places and running sums over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import Stage


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted by range over partitions, written, with each row's partition and place in it."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    return Stage(df.sparkSession, "order").put(tagged, "ranged")


def placed(df: DataFrame, order: list[Column], name: str = "place", first: int = 0) -> DataFrame:
    """df with the place of each row in the order (from first on), which must leave no ties to be stable."""
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = ranged.join(F.broadcast(starts), "_part")  # a row a partition
    return out.withColumn(name, (F.col("_start") + F.col("_row") - F.col("_from") + first).cast("long")).select(*df.columns, name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each, in the order."""
    ranged = _ranged(df, order)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.sum(value).over(within)).select(*df.columns, name)
