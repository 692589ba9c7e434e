"""What joins over sets of shingles share: sets, classes of equal sets, cells of buckets, confirmation, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .store import Store, partitions
from .text import NOT_SPACE, join_texts, windows, words


def node_of():
    """doc_id; for a row without one, a negative number that its text gives, so copies share it and other texts don't."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(2**63))))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data, offsets = join_texts([t.lower() for t in texts])
    hashes, _, _, first = words(data, offsets, NOT_SPACE)
    whole = windows(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(whole[a : b - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def rows_of(**columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def by_cell(batches, read):
    """(cell, what read gives for its rows) of batches sorted by their first three columns."""
    of, held = None, []
    for batch in batches:
        cells = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for cell, row in zip(cells, read(batch), strict=True):
            if cell != of:
                if len(held) > 1:
                    yield of, held
                of, held = cell, []
            held.append(row)
    if len(held) > 1:
        yield of, held


def meeting(cell_of):
    """Rows (key, lo, hi, block, root, node, n, and two columns of cell_of): those nodes of each cell that may link with another of it.

    cell_of(cell, rows) gives an object with the columns as arrays, whose fits() yields (i, partners of row i).
    """

    def read(batch):
        return zip(*(batch.column(i).to_pylist() for i in range(3, 9)), strict=True)

    def run(batches):
        for of, rows in by_cell(batches, read):
            if len({r[1] for r in rows}) > 1:
                cell = cell_of(of, rows)
                met = np.zeros(len(rows), bool)
                for i, fit in cell.fits():
                    met[i] = met[fit] = True
                if k := int(met.sum()):
                    yield rows_of(key=[of[0]] * k, lo=[of[1]] * k, hi=[of[2]] * k, block=cell.block[met], root=cell.root[met], node=cell.node[met])

    return run


def linked(size: int, similarity: int, cell_of):
    """Rows (key, lo, hi, block, root, node, two columns of cell_of, text): links between nodes of a cell, found on their full sets."""

    def read(batch):
        columns, texts = [batch.column(i).to_pylist() for i in range(3, 8)], batch.column(8)
        for i in range(0, batch.num_rows, 64):
            sets = shingle_sets([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts.slice(i, 64)], size)
            for j, own in enumerate(sets, i):
                block, root, node, sig, bands = (c[j] for c in columns)
                yield block, root, node, len(own), sig, bands, own

    def run(batches):
        for of, rows in by_cell(batches, read):
            cell = cell_of(of, rows)
            for i, fit in cell.fits():
                own, others = rows[i][6], [rows[j][6] for j in fit]
                starts = np.cumsum([0, *map(len, others[:-1])])
                all_ = np.concatenate(others)
                at = np.minimum(np.searchsorted(own, all_), len(own) - 1)
                both = np.add.reduceat((own[at] == all_).astype(np.int64), starts)
                fit = fit[100 * both >= similarity * (len(own) + cell.n[fit] - both)]
                if len(fit):
                    yield rows_of(a=np.minimum(cell.node[i], cell.node[fit]), b=np.maximum(cell.node[i], cell.node[fit]))

    return run


def cells(rest: DataFrame, store: Store, block: int, shingles: int) -> DataFrame:
    """Rows (key, root, node, n) dealt to the cells of their buckets: (key, lo, hi, block, root, node).

    A bucket is cut into blocks of about so many rows and shingles, and each two blocks make a cell. A
    component with more than a block of a bucket has blocks of its own, which never meet each other: a
    bucket that is one component but for a few rows costs a copy of those few for each of its blocks.
    """
    need = F.ceil(F.greatest(F.sum("rows") / block, F.sum("n") / shingles)).cast("int")
    counts = rest.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    counts = store.put(counts.withColumn("own", F.expr(f"rows > {block} or n > {shingles}")), "counts")
    layout = counts.withColumn("part", F.when(F.col("own"), F.col("root")).otherwise(0)).groupBy("key", "own", "part").agg(need.alias("blocks"))
    of = Window.partitionBy("key")
    layout = layout.select("*", (F.sum("blocks").over(of.orderBy("own", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")).alias("from"), F.sum("blocks").over(of).alias("total"))
    large = counts.where("own").select("key", "root", "own")
    dealt = rest.join(large, ["key", "root"], "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn("part", F.when(F.col("own"), F.col("root")).otherwise(0))
    dealt = dealt.join(store.put(layout, "layout"), ["key", "own", "part"]).withColumn("block", F.col("from") + F.pmod(F.xxhash64("node"), "blocks"))
    met = F.explode(F.expr("filter(sequence(0L, total - 1), j -> not own or j < `from` or j >= `from` + blocks)"))
    dealt = dealt.select("key", "block", "root", "node", met.alias("j"))
    return dealt.select("key", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "block", "root", "node")


def _confirm(size: int, similarity: int):
    def run(batches):
        block = center = None
        for batch in batches:
            blocks, lead = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            nodes, texts = batch.column(3).to_pylist(), batch.column(4)
            sets = []
            for i in range(0, len(nodes), 64):
                sets += shingle_sets([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts.slice(i, 64)], size)
            found = []
            for k, (of, node, own) in enumerate(zip(blocks, nodes, sets, strict=True)):
                if lead[k] == 0:
                    block, center = (of, batch.column(1)[k].as_py()), (node, own)
                elif block and block[0] == of and len(center[1]) and len(own):
                    both = np.isin(own, center[1], assume_unique=True).sum() if len(own) < 1 << 20 else len(np.intersect1d(own, center[1], assume_unique=True))
                    if 100 * both >= similarity * (len(own) + len(center[1]) - both):
                        found.append((center[0], node))
            if found:
                yield rows_of(a=[x for x, _ in found], b=[y for _, y in found])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, store: Store, name: str, size: int, similarity: int, block: int = 256) -> DataFrame:
    """Of the distinct pairs (a, b) those whose sets are similar enough; texts: (node, text).

    Pairs of one a are cut into blocks, so that a's set comes once a block and no task gets all of a hub's pairs.
    """
    pairs = store.put(pairs.distinct(), f"{name}-pairs")
    salts = store.put(pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("salts")), f"{name}-salts")
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    dealt = store.put(dealt, f"{name}-dealt")
    block_of = F.xxhash64("a", "salt")
    members = dealt.select(block_of.alias("block"), "a", F.lit(1).alias("lead"), F.col("b").alias("node"))
    members = members.unionByName(dealt.select(block_of.alias("block"), "a", F.lit(0).alias("lead"), F.col("a").alias("node")).distinct())
    full = members.join(texts, "node").select("block", "a", "lead", "node", "text")
    n = partitions(pairs.sparkSession)
    sets = full.repartition(n, "block").sortWithinPartitions("block", "a", "lead").select("block", "a", "lead", "node", "text")
    return sets.mapInArrow(_confirm(size, similarity), "a long, b long")


def members(signed: DataFrame, store: Store, payload: list[str]) -> tuple[DataFrame, bool]:
    """(node, lost, stands, n, rep, payload) of rows (node, lost, n, d1, d2, payload), and whether any row is lost, that is without doc_id.

    rep: the least node with an equal set (d1, d2); only where it is the node itself is the payload left. Of copies
    without doc_id the first row stands for the node; a document's rows may differ and all do.
    """
    signed = store.put(signed.withColumn("row", F.when(F.col("lost"), F.monotonically_increasing_id())), "signed")
    some_lost = bool(signed.where("lost").head(1))
    signed = signed.withColumn("stands", F.lit(True))
    if some_lost:
        firsts = store.put(signed.where("lost").groupBy("node").agg(F.min("row").alias("first")), "firsts")
        signed = signed.where("not lost").unionByName(signed.where("lost").join(firsts, "node").withColumn("stands", F.col("row") == F.col("first")).drop("first"))
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.count("*").alias("copies"))
    classes = store.put(classes.where("copies > 1").drop("copies"), "classes")
    own = (F.coalesce("rep", "node") == F.col("node")) & F.col("stands")
    member = signed.join(classes, ["d1", "d2"], "left").select("node", "lost", "stands", "n", F.coalesce("rep", "node").alias("rep"), *(F.when(own, F.col(c)).alias(c) for c in payload))
    return store.put(member, "member"), some_lost


def settled(member: DataFrame, links: DataFrame, some_lost: bool, store: Store) -> DataFrame:
    """A row per row of member: node, lost, n, component, kept, by links (a, b) between representatives."""
    copies = member.where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    roots = connected_components(links.unionByName(copies.distinct()), store, "all")
    out = member.join(roots, "node", "left").select("node", "lost", "stands", "n", F.coalesce("root", "node").alias("root"))
    if not some_lost:
        return out.select("node", "lost", "n", F.col("root").alias("component"), (F.col("node") == F.col("root")).alias("kept"))
    # the least id of each component that the number of a row without one leads
    led = store.put(out.select("root", "node", "lost").distinct(), "led")
    least = led.groupBy("root").agg(F.min(F.when(~F.col("lost"), F.col("node"))).alias("least"), F.bool_or("lost").alias("mixed")).where("mixed").drop("mixed")
    out = out.join(store.put(least, "least"), "root", "left")
    kept = F.when(F.col("lost") & (F.col("n") == 0), True).when(F.col("least").isNotNull(), F.col("node") == F.col("least")).otherwise((F.col("node") == F.col("root")) & F.col("stands"))
    component = F.coalesce("least", F.when(~F.col("lost"), F.col("root")))
    return out.select("node", "lost", "n", component.alias("component"), kept.alias("kept"))


def texts_of(source: DataFrame, nodes: DataFrame, some_lost: bool) -> DataFrame:
    """(node, text) of source (node, text, lost) for the nodes; copies without doc_id once."""
    texts = source.join(nodes, "node").select("node", "text", "lost")
    if some_lost:
        texts = texts.where("not lost").unionByName(texts.where("lost").dropDuplicates(["node"]))
    return texts.drop("lost")
