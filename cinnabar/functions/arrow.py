"""Row kernels over Arrow batches: a function of some columns adds columns, or turns each row into several."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session; they may not share the driver's path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        name = __name__.split(".")[0]
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix=f"{name}-kernels-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, f"{name}_kernels"), "zip", root, name))


#: Results a task keeps for texts that come again: their weight at most, and that of one.
MEMO, MEMO_ONE = 2_000_000, 4_096
#: About how many rows of a batch expand gives, and how many bytes of copied results add gives, before they begin another.
BATCH_ROWS, PART_BYTES = 65_536, 1 << 22


class _Memo:
    """Results of a task by input, emptied when full; so a text that comes often is worked on once a task, whatever its share of the rows."""

    def __init__(self):
        self.made: dict = {}
        self.weight = 0

    def put(self, row: tuple, result, weight: int) -> None:
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes))) // 8 + 8
        if weight <= MEMO_ONE:
            if self.weight + weight > MEMO:
                self.made.clear()
                self.weight = 0
            self.made[row] = result
            self.weight += weight


def _spread(df: DataFrame, wanted: bool) -> DataFrame:
    """df over enough tasks for work in Python: files are split by bytes, and a small one, read as one partition, may hold hours of it."""
    if not wanted or df.isStreaming or not df.inputFiles():
        return df
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _coded(batch: pa.RecordBatch, n: int) -> tuple[list[tuple], np.ndarray]:
    """Distinct rows of the inputs, by first appearance, and which of them each row of the batch has."""
    columns = [batch.column(batch.schema.get_field_index(f"_in_{i}")) for i in range(n)]
    if not all(pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_integer(c.type) for c in columns):
        return list(zip(*(c.to_pylist() for c in columns), strict=True)), np.arange(len(batch))
    if n == 1:
        coded = columns[0].dictionary_encode(null_encoding="encode")
        return [(x,) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False)
    at: dict[tuple, int] = {}
    codes = [at.setdefault(row, len(at)) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
    return list(at), np.array(codes, np.int64)


def _hashable(row: tuple) -> bool:
    return all(x is None or isinstance(x, (str, int, bytes)) for x in row)


def add(df: DataFrame, inputs: list[str], added: str, f: Callable[..., tuple], spread: bool = True) -> DataFrame:
    """df with the columns of the DDL text added, which f gives for the values of inputs; columns so named are replaced.

    f depends on its arguments only: equal inputs are worked on once a task, as long as their results fit its memory.
    spread: deal rows that come from files over many tasks first; not for whole files or rows that an exchange has dealt.
    """
    ship(df.sparkSession)
    new = _parse_datatype_string(added)
    kept = [c for c in df.columns if c not in new.names]
    # inputs that are replaced come along under names of their own
    source = _spread(df.select(*kept, *(df[c].alias(f"_in_{i}") for i, c in enumerate(inputs))), spread)
    out = StructType([*(df.schema[c] for c in kept), *new.fields])
    schema = to_arrow_schema(out)

    def run(batches):
        memo = _Memo()

        def made(row):
            if not _hashable(row):
                return f(*row)
            result = memo.made.get(row)
            if result is None:
                result = f(*row)
                memo.put(row, result, _weight(result))
            return result

        for batch in batches:
            rows, codes = _coded(batch, len(inputs))
            results = [made(row) for row in rows]
            own = [batch.column(i) for i in range(len(kept))]
            fresh = [pa.array([m[i] for m in results], schema.field(len(kept) + i).type) for i in range(len(new.names))]
            size = len(codes)
            if len(rows) < size:  # in parts, so that copies of long results aren't all held at once
                size = max(1, PART_BYTES * len(rows) // max(1, *(c.nbytes for c in fresh)))
            for start in range(0, len(codes), max(1, size)):
                at = pa.array(codes[start : start + size])
                part = [c.slice(start, size) for c in own] + (fresh if len(rows) == len(codes) else [c.take(at) for c in fresh])
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(part)], schema=schema)

    return source.mapInArrow(run, out)


def _weight(x) -> int:
    """About how much memory a result takes, in units of 8 bytes and more."""
    if isinstance(x, (str, bytes)):
        return len(x) // 8 + 8
    if isinstance(x, dict):
        return 8 + sum(map(_weight, x.values()))
    return 8 + sum(map(_weight, x)) if isinstance(x, (list, tuple)) else 4


def expand(df: DataFrame, inputs: list[str], kept: list[str], added: str, f: Callable[..., Iterable[tuple]], rows: int = 4096, spread: bool = True) -> DataFrame:
    """For each row of df as many rows as f yields for inputs: the kept columns beside those of the DDL text.

    f depends on its arguments only: equal inputs are worked on once a task, as long as their results fit its memory. Of what one
    input yields, and of all that is turned into columns at once, at most ``rows`` are held. spread: as in add.
    """
    ship(df.sparkSession)
    new = _parse_datatype_string(added)
    source = _spread(df.select(*kept, *(df[c].alias(f"_in_{i}") for i, c in enumerate(inputs))), spread)
    out = StructType([*(df.schema[c] for c in kept), *new.fields])
    schema = to_arrow_schema(out)

    def run(batches):
        memo = _Memo()

        def yielded(row):
            known = memo.made.get(row) if _hashable(row) else None
            if known is not None:
                yield from known
                return
            kept_items, weight = [], 0
            for item in f(*row):
                if kept_items is not None:
                    kept_items.append(item)
                    weight += _weight(item)
                    if weight > MEMO_ONE:  # too long to be kept
                        kept_items = None
                yield item
            if kept_items is not None and _hashable(row):
                memo.put(row, kept_items, weight)

        for batch in batches:
            distinct, codes = _coded(batch, len(inputs))
            own = [batch.column(i) for i in range(len(kept))]
            order = np.argsort(codes, kind="stable")
            first = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
            made: list[tuple] = []
            of: list[int] = []

            def flush(batch=batch, own=own, order=order, first=first, made=made, of=of):
                """Rows of the items made, each as often as its input is in the batch."""
                fresh = [pa.array([m[i] for m in made], schema.field(len(kept) + i).type) for i in range(len(new.names))]
                owners, starts, counts = np.unique(np.array(of), return_index=True, return_counts=True)
                often = first[owners + 1] - first[owners]
                source_rows = np.concatenate([order[first[u] : first[u + 1]] for u in owners])
                begin, length = np.repeat(starts, often), np.repeat(counts, often)
                upto = np.cumsum(length)
                at = 0
                while at < len(upto):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_ROWS, "right")))
                    n = length[at:end]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    items = pa.array(np.repeat(begin[at:end], n) + inner)
                    places = pa.array(np.repeat(source_rows[at:end], n))
                    columns = [c.take(places) for c in own] + [c.take(items) for c in fresh]
                    yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(columns)], schema=schema)
                    at = end
                made.clear()
                of.clear()

            for u, row in enumerate(distinct):
                for item in yielded(row):
                    made.append(item)
                    of.append(u)
                    if len(made) >= rows:
                        yield from flush()
            if made:
                yield from flush()

    return source.mapInArrow(run, out)


#: What may be collected to the driver and sent to every task.
BROADCAST_ROWS = 1_000_000


def small_list(df: DataFrame, limit: int = BROADCAST_ROWS) -> list:
    """The rows of a table that every task gets; a larger one is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows to send to every task")
    return rows
