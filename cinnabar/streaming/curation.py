"""Curation of a stream of record files: the first row of each key, and statistics that grow by batches.

Files that arrive in a folder are read in batches (Structured Streaming). A batch costs its own rows, however many came before: it
leaves one folder of rows, one for each of its keys, with the batch's first row of the key and how many rows it has there. The folder bears
the batch's number and is written whole, so a batch that is repeated after a stop replaces its own rows: nothing is lost or counted twice.
Kept rows and statistics are views of those folders; which batch had a key first is found when they are read, by one aggregation over
the folders' rows, so nothing about keys is held in memory between batches.

A batch is aggregated by Spark, in each task before rows are shuffled, so that a key with a third of all rows sends as few rows as others.

Defined cases: first is by batch, then by the order column, so the rows are those of a batch job over all files if later files
hold later rows (``statistics``, merged, has the first by the order column alone, in whatever order files come); of rows of a batch with the
same key and order one stays; a row with a null key or order is an error: it is counted under no key and never kept; an empty folder gives no
rows; repeated files are new rows of known keys; columns named like this module's own (``_key``, ``_order``, ``_row``, ``_n``) are not
allowed. Folders of versions that kept keys in the state store are not read on; begin a new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

OWN = ("_key", "_order", "_row", "_n")
#: Time stamps keep their microseconds on the way through text.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
#: Bytes of files of a batch, for streams that are dealt by size.
BATCH_BYTES = 256 << 20


def record_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = 1, format: str = "parquet", bytes_per_batch: int | None = None) -> DataFrame:
    """Rows of the files of a folder, and of those that come later; oldest files first.

    A batch has at most files_per_batch files or, if bytes_per_batch is given, files of about so many bytes (a larger file is a batch of its
    own), so that what a batch costs besides its rows doesn't grow with the number of files.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(schema).format(format).option(*limit).load(folder)


def first_rows(stream: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """(_key, _order, _row, _n): the stream's rows as first_of_batch takes them; _key is a JSON text, empty for an error, _row a struct."""
    if clash := sorted({*OWN, "_new"} & set(stream.columns)):
        raise ValueError(f"columns {clash} are this module's own")
    bad = F.col(order).isNull()
    for k in key:
        bad = bad | F.col(k).isNull()
    return stream.select(F.when(bad, "").otherwise(F.to_json(F.struct(*key), JSON)).alias("_key"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("_order"), F.struct(*stream.columns).alias("_row"), F.lit(1).cast("long").alias("_n"))


def first_of_batch(batch: DataFrame) -> DataFrame:
    """Of each key in a batch of first_rows the first row, and how many there are."""
    return batch.groupBy("_key").agg(F.min("_order").alias("_order"), F.min_by("_row", "_order").alias("_row"), F.sum("_n").alias("_n"))


def curate(stream: DataFrame, key: Sequence[str], order: str, out: str, once: bool = True) -> StreamingQuery:
    """Starts (or resumes) the curation of a stream into the folder out; once: stops when all files there are have been read."""

    def write(batch: DataFrame, number: int) -> None:
        first_of_batch(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    writer = first_rows(stream, key, order).writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _rows(spark: SparkSession, out: str, schema: StructType | str | None = None) -> DataFrame:
    """(_key, _order, _n, batch, and _row if its schema is given) of all batches."""
    own = StructType([StructField("_key", StringType()), StructField("_order", LongType()), StructField("_n", LongType()), StructField("batch", LongType())])
    if schema is not None:
        own = own.add("_row", _parse_datatype_string(schema) if isinstance(schema, str) else schema)
    try:
        return spark.read.schema(own).parquet(f"{out}/rows")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], own)


def kept(spark: SparkSession, out: str, schema: StructType | str, ordered: bool = False) -> DataFrame:
    """The first row of each key so far; ordered: by batch and order, otherwise as they come."""
    first = _rows(spark, out, schema).where("_key <> ''").groupBy("_key").agg(F.min_by(F.struct("batch", "_order", "_row"), "batch").alias("f")).select("f.*")
    return (first.orderBy("batch", "_order") if ordered else first).select("_row.*")


def statistics(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """A row a batch and key, to be merged: the columns of the batch's first row, its rows as popularity, its order as first_idx."""
    rows = _rows(spark, out, schema).where("_key <> ''")
    return rows.select("_row.*", F.col("_n").alias("popularity"), F.col("_order").alias("first_idx"))


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, read, kept, repeated, errors): how many rows each batch had, and what became of them."""
    rows, of = _rows(spark, out), F.col("_key") == ""
    counted = rows.groupBy("batch").agg(F.sum("_n").alias("read"), F.coalesce(F.sum(F.when(of, F.col("_n"))), F.lit(0)).alias("errors"))
    new = rows.where(~of).groupBy("_key").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new"))
    kept = F.coalesce("new", F.lit(0)).alias("kept")
    return counted.join(new, "batch", "left").select("batch", "read", kept, (F.col("read") - kept - F.col("errors")).alias("repeated"), "errors").orderBy("batch")
