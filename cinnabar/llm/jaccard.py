"""Exact Jaccard join of shingle sets by R-trees over count vectors.

A set's elements are hashed into groups, and the numbers of its elements in each group are a point. The sum of the
smaller coordinates of two points is no less than what their sets have in common; the same sum with the
largest coordinates below a node of an R-tree bounds the overlap with any set below it. A search goes down only where
that bound and the sizes still allow a link; what survives is confirmed on the full sets. A point has as many groups as
half its elements (a power of two), and points of twice as many groups are folded to meet those of fewer.

Trees are built where sets that may link meet. All elements have one order, by how many texts share an element's slot
(counted over all texts in a table of ``SLOTS`` slots, so that rare elements come first and passages that texts share last), then by hash. Two similar sets
have one of their first n - ceil(similarity * n) + 1 elements in common, so those are a set's buckets. Buckets with
the same sets are one bucket. Sets are searched in two rounds: first each in a block of its largest bucket, where it keeps
the first partner that the tree finds, and these pairs are confirmed; then, in the buckets that components still
cut, blocks are paired to cells, trees leave out nodes of the searching set's own component, and all partners
are confirmed inside the task, each in the least bucket it shares. Only links leave a task, never candidate pairs; sets with equal
elements are one class, of which one is searched. The order of elements steers how much meets, never what is found.

Defined cases: null or empty texts, and texts of white space only, have no elements and link with nothing; rows that repeat a
doc_id are versions of one document and share its component; rows without doc_id take part, but never lend their id, so
a component without any id has a null component_id; an empty table gives no rows; a very long text is one set, held whole by a task; only doc_id and text are read of docs.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .shingles import by_cell, cells, confirmed, linked, meeting, members, node_of, rows_of, settled, shingle_sets, texts_of
from .store import Store, partitions
from .text import chunks

SLOTS, SLICES = 1 << 21, 16
LEAST, MOST = 64, 8192
FANOUT = 8
POINT = "node long, lost boolean, n long, d1 long, d2 long, prefix array<long>, counts binary"


# --- points ---------------------------------------------------------------------------------


def groups_of(n: int) -> int:
    """How many groups a set of n elements has: the power of two from half its elements on."""
    return min(MOST, max(LEAST, 1 << (n // 2 - 1).bit_length())) if n > 2 * LEAST else LEAST


def point(own: np.ndarray, groups: int) -> np.ndarray:
    """How many elements fall into each group; groups: a power of two."""
    return np.bincount((own >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)


def stored(counts: np.ndarray) -> bytes:
    """A point as bytes; half a byte or one byte a group where that suffices."""
    if counts.max(initial=0) < 16:
        return b"\x00" + (counts[0::2] | counts[1::2] << 4).astype("u1").tobytes()
    return b"\x01" + counts.astype("u1").tobytes() if counts.max() < 256 else b"\x04" + counts.astype("<u4").tobytes()


def loaded(value: bytes) -> np.ndarray:
    own = np.frombuffer(value, "<u4" if value[0] == 4 else "u1", offset=1).astype(np.uint32)
    return own if value[0] else np.stack((own & 15, own >> 4), axis=1).ravel()


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


# --- the order of elements ------------------------------------------------------------------


def _slots(size: int):
    """Per task, how many sets have an element in each slot: compressed slices."""

    def run(batches):
        counts = np.zeros(SLOTS, "<u4")
        for _, texts in chunks(batches):
            for own in shingle_sets(texts, size):
                np.add.at(counts, (own & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return run


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(counts.as_buffer()), "<u4")
            sums[i] = sums.get(i, np.int64(0)) + own
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()], pa.binary())], ["slice", "counts"])


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """A byte for each slot, larger where more sets share it: sixteenths of the logarithm of its count over the mean."""
    return np.clip(np.round(16 * np.log2(np.maximum(counts, 1) / max(1.0, counts.mean()))) + 64, 0, 255).astype(np.uint8)


def slot_ranks(texts: DataFrame, size: int) -> np.ndarray:
    """For each slot how many sets have its elements, as ranks_of says; SLOTS bytes."""
    n = min(SLICES, partitions(texts.sparkSession))
    rows = texts.select("text").mapInArrow(_slots(size), "slice int, counts binary").repartition(n, "slice").mapInArrow(_summed, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in rows:  # at most SLICES rows
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return ranks_of(counts.ravel())


def prefix_of(own: np.ndarray, similarity: int, ranks: np.ndarray | None) -> np.ndarray:
    """Those elements, of which a similar set has one among its own: the first in the order by rank, then hash. own: sorted."""
    keep = len(own) - (similarity * len(own) + 99) // 100 + 1
    if ranks is None:
        return own[:keep]
    rank = ranks[(own & np.uint64(len(ranks) - 1)).astype(np.int64)]
    return own[np.argsort(rank, kind="stable")[:keep]]


def _points(size: int, similarity: int, shared):
    """Rows (node, text, lost) as POINT."""

    def run(batches):
        ranks = shared.value
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = [[int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests] for i in (0, 8)]
            prefixes = [prefix_of(s, similarity, ranks).view(np.int64) if len(s) else None for s in sets]
            counts = [stored(point(s, groups_of(len(s)))) if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(h, pa.int64()) for h in halves), pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.binary())], ["node", "lost", "n", "d1", "d2", "prefix", "counts"])

    return run


# --- trees ----------------------------------------------------------------------------------


class CountTree:
    """R-tree over points of as many groups, with sizes and components; FANOUT children a node."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        order = np.array(self._packed(counts, sizes, np.arange(len(sizes))), np.int64)
        self.order = order
        # a level: largest coordinates, least and largest size, least and largest component
        self.levels = [(counts[order], sizes[order], sizes[order], roots[order], roots[order])]
        while len(self.levels[-1][1]) > 1:
            most, least, largest, low, high = self.levels[-1]
            at = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(most, at), np.minimum.reduceat(least, at), np.maximum.reduceat(largest, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _packed(self, counts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> list[int]:
        """Rows in an order that puts like beside like: split by sizes, then by the coordinate that differs most."""
        if len(rows) <= FANOUT:
            return rows.tolist()
        spread = counts[rows].astype(np.float32).std(axis=0)
        by = sizes[rows] if 5 * sizes[rows].min() < 4 * sizes[rows].max() else counts[rows, int(spread.argmax())]
        rows = rows[np.argsort(by, kind="stable")]
        half = FANOUT * max(1, len(rows) // (2 * FANOUT))
        return self._packed(counts, sizes, rows[:half]) + self._packed(counts, sizes, rows[half:])

    def search(self, counts: np.ndarray, size: int, root: int, similarity: int) -> np.ndarray:
        """Rows that may link with a set of these counts and this size, of another component."""
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            most, least, largest, low, high = (x[at] for x in self.levels[depth])
            fits = (100 * largest >= similarity * size) & (100 * size >= similarity * least) & ((low != root) | (high != root))
            at, most, least = at[fits], most[fits], least[fits]
            # similarity * (size + other) <= (100 + similarity) * overlap, for the least size that may link
            other = np.maximum(least, (similarity * size + 99) // 100)
            at = at[(100 + similarity) * np.minimum(most, counts).sum(axis=1, dtype=np.int64) >= similarity * (size + other)]
            if not len(at):
                return at
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


class TreeCell:
    """Rows of one cell: two blocks of a bucket, or one block with itself; a tree for each number of groups."""

    def __init__(self, similarity: int, once: bool, of: tuple, rows: list[tuple]):
        self.similarity, self.once, (self.key, self.lo, self.hi) = similarity, once, of
        self.block, self.root, self.node, self.n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        self.counts, self.prefix = [loaded(r[4]) for r in rows], [r[5] for r in rows]

    def fits(self):
        """(i, other rows) that may link: other components and blocks, bounds that allow it, and, if once, no lesser bucket in common; each pair once."""
        groups = np.array([len(c) for c in self.counts])
        earlier: dict[int, set] = {}
        for g in np.unique(groups):
            rows = np.flatnonzero((groups == g) | (groups == 2 * g))
            if len(rows) < 2:
                continue
            tree = CountTree(np.array([folded(self.counts[i], g) for i in rows]), self.n[rows], self.root[rows])
            for i in np.flatnonzero(groups == g).tolist():
                fit = rows[tree.search(self.counts[i], int(self.n[i]), int(self.root[i]), self.similarity)]
                fit = fit[(self.root[fit] != self.root[i]) & ((fit > i) | (groups[fit] > g))]
                if self.lo != self.hi:
                    fit = fit[self.block[fit] != self.block[i]]
                if len(fit) and self.once:
                    if i not in earlier:
                        earlier[i] = {k for k in self.prefix[i] if k < self.key}
                    fit = np.sort(fit[[earlier[i].isdisjoint(self.prefix[j]) for j in fit]])
                if len(fit):
                    yield i, fit


def _first_partners(cell_of):
    """Rows (key, block, block, block, node, node, n, counts, prefix) of blocks: (a, b), of each b the first partner a that its tree finds."""

    def read(batch):
        return zip(*(batch.column(i).to_pylist() for i in range(3, 9)), strict=True)

    def run(batches):
        for of, rows in by_cell(batches, read):
            cell = cell_of(of, rows)
            lead = np.arange(len(rows))
            for i, fit in cell.fits():
                np.minimum.at(lead, np.maximum(i, fit), np.minimum(i, fit))
            b = np.flatnonzero(lead < np.arange(len(rows)))
            b = b[cell.node[lead[b]] != cell.node[b]]
            if len(b):
                yield rows_of(a=cell.node[lead[b]], b=cell.node[b])

    return run


def tree_links(points: DataFrame, source: DataFrame, some_lost: bool, store: Store, size: int, similarity: int, block: int = 256, shingles: int = 1 << 21, name: str = "tree") -> DataFrame:
    """Links (a, b) that join all nodes of points (node, n, prefix, counts) whose sets are similar enough; source: (node, text, lost).

    Not every link is given, but no two linked nodes are in different components of those given. block, shingles: about the most
    rows and shingles of a block; they bound a task's memory, not what is found.
    """
    n, of = partitions(points.sparkSession), lambda x: f"{name}-{x}"
    keys = points.select("node", "n", F.explode("prefix").alias("key"))
    # most elements are of one set; the others are told by their neighbours in one sort
    beside = Window.partitionBy("key").orderBy("node")
    keys = keys.withColumn("before", F.lag("node").over(beside)).withColumn("after", F.lead("node").over(beside))
    # versions of a document that share an element are one row, or their hashes would cancel out
    keys = store.put(keys.where("before is not null or after is not null").groupBy("key", "node").agg(F.max("n").alias("n")), of("keys"))
    met = keys.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y")).where("rows > 1")
    # buckets of the same sets are one
    buckets = store.put(met.groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key", "rows"), of("buckets"))
    shared = store.put(keys.join(buckets, "key"), of("shared"))

    # of its elements a set keeps those whose buckets are left; they have the least that it shares with another
    left = store.put(shared.groupBy("node").agg(F.collect_set("key").alias("left"), F.max(F.struct("rows", "key")).alias("most")), of("left"))
    points = store.put(points.join(left, "node").select("node", "n", F.array_intersect("prefix", "left").alias("prefix"), "counts", "most"), of("points"))

    order = ["key", "lo", "hi", "node"]
    blocks = points.where("array_contains(prefix, most.key)").select(F.col("most.key").alias("key"), F.pmod(F.xxhash64("node"), F.ceil(F.col("most.rows") / block)).alias("lo"), "node", "n", "counts")
    blocks = blocks.select("key", "lo", F.col("lo").alias("hi"), F.col("lo").alias("block"), F.col("node").alias("root"), "node", "n", "counts", F.array().cast("array<long>").alias("prefix"))
    blocks = blocks.repartition(n, "key", "lo").sortWithinPartitions(*order)
    cell_of = partial(TreeCell, similarity, False)
    first = store.put(blocks.mapInArrow(_first_partners(cell_of), "a long, b long").distinct(), of("first"))
    suspects = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    texts = store.put(texts_of(source, suspects, some_lost), of("texts"))
    links = store.put(confirmed(first, texts, store, of("first"), size, similarity), of("links"))
    roots = connected_components(links, store, of("one"))

    open_ = shared.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "key")
    cut = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = store.put(open_.join(store.put(cut, of("cut")), "key").groupBy("key", "root", "node").agg(F.max("n").alias("n")), of("rest"))
    cell_of, points = partial(TreeCell, similarity, True), points.drop("most")
    dealt = cells(rest, store, block, shingles).join(points, "node").where("array_contains(prefix, key)")
    dealt = dealt.select("key", "lo", "hi", "block", "root", "node", "n", "counts", "prefix").repartition(n, *order[:3]).sortWithinPartitions(*order)
    meet = store.put(dealt.mapInArrow(meeting(cell_of), "key long, lo long, hi long, block long, root long, node long").distinct(), of("meeting"))
    texts = store.put(texts_of(source, meet.select("node").distinct(), some_lost), of("met"))
    full = meet.join(points, "node").where("array_contains(prefix, key)").join(texts, "node")
    full = full.select("key", "lo", "hi", "block", "root", "node", "counts", "prefix", "text").repartition(n, *order[:3]).sortWithinPartitions(*order)
    more = store.put(full.mapInArrow(linked(size, similarity, cell_of), "a long, b long").distinct(), of("more"))
    return links.unionByName(more)


def jaccard_classes(docs: DataFrame, size: int = 4, similarity: int = 85, block: int = 256, shingles: int = 1 << 21) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id; size: words of a shingle, similarity: per cent of the union."""
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    source = docs.select(node_of().alias("node"), "text", F.col("doc_id").isNull().alias("lost"))
    ranks = spark.sparkContext.broadcast(slot_ranks(source, size))  # SLOTS bytes
    member, some_lost = members(source.mapInArrow(_points(size, similarity, ranks), POINT), store, ["prefix", "counts"])
    points = member.where("prefix is not null and n > 0").select("node", "n", "prefix", "counts")
    links = tree_links(points, source, some_lost, store, size, similarity, block, shingles)
    out = settled(member, links, some_lost, store)
    return out.select(F.when(~F.col("lost"), F.col("node")).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
