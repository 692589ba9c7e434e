"""Line deduplication with two Bloom filters.

One pass gathers a filter of line hashes seen once and one of hashes seen twice;
filters of tasks are merged slice by slice (a bit that is set in two tasks' once-filters
is set in the merged twice-filter); a task sends the bytes it has set. Only lines that the
twice-filter suspects are shuffled, as counts pre-added in each task, for exact confirmation.
The filters have eight bits a line, counted first, up to ``most_bits``, which bounds what is
broadcast; with more lines than that more are suspected, and the result stays exact.

Defined cases: a null or empty text is one empty line and is never changed; empty keys
(shorter than min_chars) are never dropped; a row is a document, so repeated rows count
each; rows without doc_id take part like others; an empty table gives no rows; columns of
the input named like the added ones are replaced. With keep_first one row alone keeps a line:
that with the smallest doc_id, rows without one last, the first of rows that repeat it.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, partitions
from .text import chunks

HASHES = 2


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip().lower()


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.split(b"\n")}
    if min_chars <= 1:
        keys.discard(b"")
        return keys
    return {k for k in keys if len(k.decode("utf-8", "replace")) >= min_chars}


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash its HASHES bit positions."""
    return np.stack([(hashes >> np.uint64(32 * i)) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def filter_bits(docs: DataFrame, most_bits: int, slices: int) -> int:
    """Eight bits a line of docs, a power of two, of which the slices are whole bytes; at most most_bits."""
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(F.coalesce(feeds, F.lit(1)))).first()[0] or 0
    return max(8 * slices, min(most_bits, 1 << (8 * int(lines)).bit_length()))


def _gather(bits: int, slices: int, min_chars: int):
    size = bits // 8 // slices

    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, texts in chunks(batches, limit=4 << 20):
            own = [xxhash.xxh3_64_intdigest(k) for t in texts for k in _keys(t, min_chars)]
            if not own:
                continue
            hashes, counts = np.unique(np.array(own, dtype=np.uint64), return_counts=True)
            at = _positions(hashes, bits)
            again = (counts > 1) | _has(once, at)
            _set(twice, at[:, again].ravel())
            _set(once, at.ravel())
        for i in range(slices):
            a, b = once[i * size : (i + 1) * size], twice[i * size : (i + 1) * size]
            at = np.flatnonzero(a)
            if len(at):
                packed = [zlib.compress(x.tobytes(), 1) for x in (np.diff(at, prepend=0).astype("<u4"), a[at], b[at])]
                yield pa.record_batch([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["slice", "gaps", "once", "twice"])

    return run


def _merge(size: int):
    """Merges the rows of each slice; rows sorted by slice."""

    def run(batches):
        now, once, twice = None, None, None

        def out():
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["slice", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != now:
                    if now is not None:
                        yield out()
                    now, once, twice = row["slice"], np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                at = np.cumsum(np.frombuffer(zlib.decompress(row["gaps"]), "<u4"), dtype=np.int64)
                a, b = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
                twice[at] |= b | (once[at] & a)
                once[at] |= a
        if now is not None:
            yield out()

    return run


def repeated_filter(docs: DataFrame, bits: int, slices: int = 64, min_chars: int = 1) -> bytes:
    """The merged filter of line hashes that two documents or more may hold; bits / 8 bytes."""
    size = bits // 8 // slices
    parts = docs.select("text").mapInArrow(_gather(bits, slices, min_chars), "slice int, gaps binary, once binary, twice binary")
    rows = parts.repartition(min(slices, partitions(docs.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(_merge(size), "slice int, twice binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out.tobytes()


def _suspects(shared, bits: int, min_chars: int, by_doc: bool):
    def run(batches):
        filter_ = np.frombuffer(shared.value, np.uint8)
        counts: Counter = Counter()
        least: dict[bytes, tuple[int, int]] = {}

        def out():
            keys = list(counts)
            rows = pa.record_batch([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()), *(pa.array([least[k][i] for k in keys], pa.int64()) for i in (0, 1))], ["digest", "n", "doc", "row"])
            counts.clear()
            least.clear()
            return rows

        for batch, texts in chunks(batches, limit=4 << 20):
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys = [list(_keys(t, min_chars)) for t in texts]
            flat = [k for own in keys for k in own]
            if not flat:
                continue
            hit = _has(filter_, _positions(np.array([xxhash.xxh3_64_intdigest(k) for k in flat], dtype=np.uint64), bits))
            owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            chosen = np.flatnonzero(hit)
            found = [(ids[owner[i]], xxhash.xxh3_128_digest(flat[i])) for i in chosen]
            if by_doc:
                yield pa.record_batch([pa.array([row for (_, row), _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["_line_row", "digest"])
                continue
            for place, digest in found:
                counts[digest] += 1
                if digest not in least or place < least[digest]:
                    least[digest] = place
            if len(counts) > 300_000:
                yield out()
        if counts and not by_doc:
            yield out()

    return run


def _strip(text: bytes, row: int, frequent, min_chars: int, keep_first: bool, seen: set) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = []
    for line in lines:
        key = line_key(line)
        if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
            digest = xxhash.xxh3_128_digest(key)
            if digest in frequent:
                if not keep_first or frequent[digest] != row or digest in seen:
                    continue
                seen.add(digest)
        kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _drop(shared, names: list[str], schema: pa.Schema, min_chars: int, keep_first: bool, joined: bool):
    def run(batches):
        frequent = None if joined else shared.value
        for batch, texts in chunks(batches):
            held = batch.column(0).to_pylist() if joined else None
            at = batch.schema.get_field_index("text")
            rows = batch.column(batch.schema.get_field_index("_line_row")).to_pylist() if keep_first or joined else [0] * len(texts)
            valid = batch.column(at).is_valid().to_pylist()
            done = [_strip(t, d, ({x["digest"]: x["row"] for x in held[i] or ()} if joined else frequent), min_chars, keep_first, set()) for i, (t, d) in enumerate(zip(texts, rows, strict=True))]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            columns["text"] = pa.array([x[0] if x[0] or ok else None for x, ok in zip(done, valid, strict=True)], pa.binary()).cast(pa.string())
            columns |= {"n_lines": pa.array([x[1] for x in done], pa.int64()), "n_dropped": pa.array([x[2] for x in done], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, most_bits: int = 1 << 30, broadcast_keys: int = 200_000, slices: int = 64) -> DataFrame:
    """docs with frequent lines taken out of text, and n_lines (before) and n_dropped.

    A line whose key is found in at least min_docs documents goes everywhere; with keep_first its
    first occurrence stays, in the row with the smallest doc_id. most_bits bounds each filter;
    up to broadcast_keys frequent lines are sent to all tasks, more are joined by row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    store = Store(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    bits = filter_bits(docs, most_bits, slices)
    shared = spark.sparkContext.broadcast(repeated_filter(docs, bits, slices, min_chars))
    # rows that repeat a doc_id are told apart by numbers, which hold only for a written table
    rows = store.put(docs.withColumn("_line_row", F.monotonically_increasing_id()), "rows") if keep_first else docs.withColumn("_line_row", F.lit(0).cast("long"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_doc")
    counts = rows.select(place, "_line_row", "text").mapInArrow(_suspects(shared, bits, min_chars, False), "digest binary, n long, doc long, row long")
    frequent = store.put(counts.groupBy("digest").agg(F.sum("n").alias("n"), F.min_by("row", F.struct("doc", "row")).alias("row")).where(F.col("n") >= min_docs), "frequent")
    # long strings of one batch may pass 2 GB only with texts far beyond what a row can hold
    out = docs.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    schema = to_arrow_schema(out)
    if frequent.count() <= broadcast_keys:
        known = spark.sparkContext.broadcast({bytes(r["digest"]): r["row"] for r in frequent.collect()})
        return rows.mapInArrow(_drop(known, names, schema, min_chars, keep_first, False), out)
    if not keep_first:
        rows = store.put(docs.withColumn("_line_row", F.monotonically_increasing_id()), "rows")
    by_row = rows.select(place, "_line_row", "text").mapInArrow(_suspects(shared, bits, min_chars, True), "_line_row long, digest binary")
    held = by_row.join(frequent.select("digest", "row"), "digest").groupBy("_line_row").agg(F.collect_list(F.struct("digest", "row")).alias("_held"))  # a row's own lines
    joined = rows.join(held, "_line_row", "left").select("_held", "_line_row", *names)
    return joined.mapInArrow(_drop(None, names, schema, min_chars, keep_first, True), out)
