"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A text's paragraphs (lines) are hashed, and each distinct hash goes to three of 24 cells of (count,
xor of hashes, xor of check hashes). Cells of two versions subtract cell by cell; peeling cells that
hold one hash recovers the hashes of the paragraphs that differ; likeness is the share of common ones among all.
If peeling gets stuck, the hashes are cut into 16 segments with 24 cells each, and those that are
stuck are cut again; differences that a sketch can't hold by their sizes aren't tried. Segments that are stuck
after five cuts are compared outright. A hash is looked at as often as its segment is cut, so a text of many
lines takes time in proportion to them (and to the logarithm of those that differ).

Defined cases: a null or empty text is one empty paragraph; equal texts have equal fingerprints and
likeness 1; alike rows (doc_id and text) are one document, and each gets its result; rows without
doc_id come last; rows of one doc_id follow each other by the digest of their texts; one document
alone is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store, partitions

TABLE, TABLES = 8, 3
CELLS = TABLE * TABLES
LEVELS = 5
NONE_YET = "CAST(array() AS ARRAY<BIGINT>)"
NIL = "named_struct('cnt', 0L, 'key', 0L, 'chk', 0L)"


def digests(text: str) -> str:
    """SQL: distinct hashes of the text's paragraphs, in order."""
    return f"array_sort(array_distinct(transform(split({text}, '\\n', -1), p -> xxhash64(p))))"


#: SQL: of each cell, which bits of a hash choose it, and their value; each table looks at three bits of its own.
CHOICE = "array(" + ", ".join(f"named_struct('mask', {7 << 3 * j}L, 'value', {v << 3 * j}L)" for j in range(TABLES) for v in range(TABLE)) + ")"


def cells(values: str) -> str:
    """SQL: the cells of an array of hashes."""
    add = "(s, d) -> named_struct('cnt', s.cnt + 1L, 'key', s.key ^ d, 'chk', s.chk ^ xxhash64(d))"
    tables = [f"transform(sequence(0L, {7 << 3 * j}L, {1 << 3 * j}L), v -> aggregate(filter({values}, d -> (d & {7 << 3 * j}L) = v), {NIL}, {add}))" for j in range(TABLES)]
    return f"concat({', '.join(tables)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (a, b) -> named_struct('cnt', a.cnt - b.cnt, 'key', a.key ^ b.key, 'chk', a.chk ^ b.chk))"


def peel(difference: str) -> str:
    """SQL: (ok, got) for cells of a difference: whether all of it was recovered, and its hashes."""
    pure = "transform(filter(st.cells, c -> abs(c.cnt) = 1L AND c.chk = xxhash64(c.key)), c -> named_struct('key', c.key, 'cnt', c.cnt))"
    take = "(s, q) -> named_struct('cnt', s.cnt - q.cnt, 'key', s.key ^ q.key, 'chk', s.chk ^ xxhash64(q.key))"
    new = f"zip_with(w.cells, {CHOICE}, (c, m) -> aggregate(filter(pure, q -> (q.key & m.mask) = m.value), c, {take}))"
    step = f"aggregate(array(array_distinct({pure})), st, (w, pure) -> named_struct('cells', {new}, 'got', concat(w.got, transform(pure, q -> q.key)), 'on', size(pure) > 0))"
    start = f"named_struct('cells', {difference}, 'got', {NONE_YET}, 'on', true)"
    done = "st -> named_struct('ok', forall(st.cells, c -> c.cnt = 0L AND c.key = 0L), 'got', st.got)"
    return f"aggregate(sequence(1, {2 * CELLS}), {start}, (st, r) -> if(st.on, {step}, st), {done})"


def attempt(pair: str, cells_a: str, cells_b: str) -> str:
    """SQL: (ok, got) of peeling one sketch of a pair; differences that it can't hold by the arrays' sizes are not tried."""
    return f"if(abs(size({pair}.a) - size({pair}.b)) <= {CELLS}, {peel(subtract(cells_a, cells_b))}, named_struct('ok', false, 'got', {NONE_YET}))"


def recovered_from(pair: str, tried: str, level: int = 1) -> str:
    """SQL: the hashes that only one array of a pair has; tried: the sketch's (ok, got). If stuck, each of 16 segments of the hashes has a sketch of its own."""
    if level > LEVELS:
        return f"concat(array_except({pair}.a, {pair}.b), array_except({pair}.b, {pair}.a))"
    segment = ", ".join(f"'{x}', filter({pair}.{x}, d -> (shiftrightunsigned(d, {20 + 4 * level}) & 15L) = h)" for x in "ab")
    part = f"part{level}"
    below = recovered_from(part, attempt(part, cells(f"{part}.a"), cells(f"{part}.b")), level + 1)
    segments = f"flatten(transform(transform(sequence(0L, 15L), h -> named_struct({segment})), {part} -> {below}))"
    return f"aggregate(array({tried}), {NONE_YET}, (none, try{level}) -> if(try{level}.ok, try{level}.got, {segments}))"


def differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: the hashes that only one of the arrays has, by peeling; only segments that are stuck are sketched anew, so work grows with the hashes."""
    whole = recovered_from("whole", attempt("whole", cells_a, cells_b))
    return f"aggregate(array(named_struct('a', {a}, 'b', {b})), {NONE_YET}, (nothing, whole) -> {whole})"


def shown(cells_: str) -> str:
    """SQL: cells as hexadecimal digits."""
    return f"array_join(transform({cells_}, c -> concat(lpad(hex(c.cnt & 65535L), 4, '0'), lpad(hex(c.key), 16, '0'), lpad(hex(c.chk & 4294967295L), 8, '0'))), '')"


def following(keys: DataFrame, store: Store) -> DataFrame:
    """Distinct keys (k, g, n) with the next key (k2, g2), k descending, then g; after the last the first."""
    order = [F.col("k").desc(), F.col("g")]
    n = 4 * partitions(keys.sparkSession)
    dealt = store.put(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "keys")
    within = Window.partitionBy("part").orderBy(*order)
    # one row a partition, so the window over all of them is bounded by their number
    heads = dealt.groupBy("part").agg(F.max_by(F.struct("k", "g"), F.struct("k", F.expr("translate(g, '0123456789abcdef', 'fedcba9876543210')"))).alias("head"))
    heads = store.put(heads, "heads")
    ring = Window.orderBy("part")
    first = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(ring), first).alias("after"))
    out = dealt.withColumn("own", F.lead(F.struct("k", "g")).over(within)).join(F.broadcast(heads), "part")
    out = out.withColumn("to", F.coalesce("own", "after"))
    return store.put(out.select("k", "g", "n", F.col("to.k").alias("k2"), F.col("to.g").alias("g2")), "order")


def fingerprints(docs: DataFrame, recovered: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by as many from the start of the next document.
    recovered: also differ_edited and differ_next, the hashes of the paragraphs that only one of both texts has.
    """
    store = Store(docs.sparkSession, "sketch")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("k", F.md5("text").alias("g"), "text")
    keys = own.select("k", "g", F.length("text").cast("long").alias("n"))
    distinct = keys.distinct()
    order = following(distinct, store)
    alike = keys.count() > order.count()
    source = own.dropDuplicates(["k", "g"]) if alike else own
    to_next = order.withColumnsRenamed({"k": "k1", "g": "g1", "k2": "k", "g2": "g"})
    half = F.expr("CAST(n DIV 2 AS INT)")
    gifts = source.join(to_next, ["k", "g"]).select(F.col("k1").alias("k"), F.col("g1").alias("g"), "n", F.substring("text", F.lit(1), half).alias("gift"), F.expr(digests("text")).alias("c"))
    both = own.join(gifts, ["k", "g"])
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.expr("CAST(n - n DIV 2 AS INT)")), "gift"))
    both = both.select("k", "n", F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("b"), "c")
    both = both.withColumns({f"cells_{x}": F.expr(cells(x)) for x in "abc"})
    for x, name in (("b", "near_edited"), ("c", "near_next")):
        both = both.withColumn(f"d_{x}", F.expr(differing("a", x, "cells_a", f"cells_{x}")))
        both = both.withColumn(name, F.expr(f"CAST(size(a) + size({x}) - size(d_{x}) AS DOUBLE) / CAST(size(a) + size({x}) + size(d_{x}) AS DOUBLE)"))
    return both.select(F.expr(f"if(k = {-(2**63) + 1}L - 1L, NULL, k)").alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", F.expr(shown("cells_a")).alias("fingerprint"), F.expr(shown("cells_b")).alias("edited_fingerprint"), "near_edited", "near_next", *([F.col("d_b").alias("differ_edited"), F.col("d_c").alias("differ_next")] if recovered else []))
