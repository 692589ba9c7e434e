"""Near-duplicates by min-max hashing, banding, and confirmation on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum, so half as many hashes
are evaluated. A band holds both values of two permutations: 40 bands of 80 permutations miss a
pair at similarity 0.75 about once in 4 million, if minima and maxima are independent. They aren't in small sets, so
sets of fewer than ``SHORT`` shingles, and those large enough to link with them, are also joined exactly by the trees of ``jaccard``. Documents with equal sets are one class and only
its representative is banded. Every candidate is confirmed on the sets themselves, in two rounds:
first each member of a bucket against its most central one, which shares most buckets with
others; then, in the buckets that components still cut, members of different components whose sizes
allow a link and whose 160 signature values agree to within 0.2 of the similarity (a true pair falls
short of that once in a hundred million). These are compared inside tasks, block by block of a bucket,
each pair in the first bucket it shares; only links leave the task, never candidate pairs.

Defined cases: null or empty texts, and texts of white space only, have no shingles, link with
nothing and stay; rows that repeat a doc_id are versions of one document and always share its
component; rows without doc_id take part, each text as a node of its own, but never lend their id: a
component with an id has the least of its ids, and its rows without one go; a component without any
has a null component_id and keeps one row; an empty table gives no rows; of extra columns, those
named like the added ones are replaced.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .jaccard import groups_of, point, prefix_of, stored, tree_links
from .shingles import cells, confirmed, linked, meeting, members, node_of, settled, shingle_sets, texts_of
from .store import Store, partitions
from .text import chunks, mix

#: Sets of fewer shingles than this are joined exactly.
SHORT = 32


def permutations(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    a = random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 2**63, n, dtype=np.uint64)


def min_max(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimum and the maximum of the set under each permutation."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(own), 512):
        # the product's high bits depend on all of the value only after a shift has mixed it
        values = np.multiply.outer(a, own[i : i + 512])
        values += b[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of rows permutations, both of whose values count."""
    key = np.arange(len(low) // rows, dtype=np.uint64)
    for values in (low.reshape(-1, rows), high.reshape(-1, rows)):
        for i in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return key


def _sign(size: int, similarity: int, bands: int, rows: int):
    def is_short(s):
        return 0 < len(s) <= SHORT * 100 // similarity

    def run(batches):
        a, b = permutations(bands * rows)
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            signed = [min_max(s, a, b) if len(s) else None for s in sets]
            keys = [band_keys(*x, rows).view(np.int64) if x else None for x in signed]
            short = [np.concatenate(x).astype("<u2").tobytes() if x else None for x in signed]
            first = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            second = [int.from_bytes(d[8:], "little", signed=True) for d in digests]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array([prefix_of(s, similarity, None).view(np.int64) if is_short(s) else None for s in sets], pa.list_(pa.int64())), pa.array([stored(point(s, groups_of(len(s)))) if is_short(s) else None for s in sets], pa.binary())], ["node", "lost", "n", "d1", "d2", "bands", "sig", "prefix", "counts"])

    return run


class _Cell:
    """Rows of one cell: two blocks of a bucket, or one block with itself."""

    def __init__(self, similarity: int, agree: float, of: tuple, rows: list[tuple]):
        self.similarity, self.agree = similarity, agree
        self.key, self.lo, self.hi = of
        self.block, self.root, self.node, self.n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        self.sig = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(len(rows), -1)
        self.bands = np.array([r[5] for r in rows], dtype=np.int64)

    def fits(self):
        """(i, later rows) that may link: other roots, fitting sizes, agreeing signatures, no earlier bucket in common."""
        for i in range(len(self.node) - 1):
            n, m = self.n[i], self.n[i + 1 :]
            ok = (self.root[i + 1 :] != self.root[i]) & (100 * np.minimum(m, n) >= self.similarity * np.maximum(m, n))
            if self.lo != self.hi:
                ok &= self.block[i + 1 :] != self.block[i]
            fit = i + 1 + np.flatnonzero(ok)
            fit = fit[(self.sig[fit] == self.sig[i]).mean(axis=1) >= self.agree] if len(fit) else fit
            if len(fit):
                earlier = int(np.argmax(self.bands[i] == self.key))
                fit = fit[~(self.bands[fit, :earlier] == self.bands[i, :earlier]).any(axis=1)]
            if len(fit):
                yield i, fit


def _components(docs: DataFrame, size: int = 5, similarity: int = 75, bands: int = 40, rows: int = 2, block: int = 256, shingles: int = 1 << 21) -> tuple[DataFrame, bool]:
    """A row per row of docs: node, lost (without doc_id), n, component, kept; and whether any row is lost.

    block, shingles: about the most rows and shingles of a block of a bucket; they bound a task's memory, not what is found.
    """
    store = Store(docs.sparkSession, "minhash")
    source = docs.select(node_of().alias("node"), "text", F.col("doc_id").isNull().alias("lost"))
    signed = source.mapInArrow(_sign(size, similarity, bands, rows), "node long, lost boolean, n long, d1 long, d2 long, bands array<long>, sig binary, prefix array<long>, counts binary")
    member, some_lost = members(signed, store, ["bands", "sig", "prefix", "counts"])
    banded = member.where("bands is not null and n > 0")

    n = partitions(docs.sparkSession)
    keys = banded.select("node", "n", F.explode("bands").alias("key"))
    sizes = store.put(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = store.put(keys.join(sizes, "key"), "shared")
    # a group's centre shares most buckets with the others; as centre of its buckets it links what links at all
    central = store.put(shared.groupBy("node").agg(F.sum("size").alias("pull")), "central")
    centers = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("pull", "node")).alias("c")).select("key", F.col("c.node").alias("center"))
    star = shared.join(store.put(centers, "centers"), "key").where("center <> node")
    first = store.put(star.select(F.least("center", "node").alias("low"), F.greatest("center", "node").alias("high"), F.col("center").alias("a"), F.col("node").alias("b")).dropDuplicates(["low", "high"]).select("a", "b"), "first")

    suspects = store.put(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct(), "suspects")
    texts = store.put(texts_of(source, suspects, some_lost), "texts")
    links = store.put(confirmed(first, texts, store, "first", size, similarity), "links")
    roots = connected_components(links, store, "one")

    open_ = shared.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "key")
    cut = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = store.put(open_.join(store.put(cut, "cut"), "key").groupBy("key", "root", "node").agg(F.max("n").alias("n")), "rest")
    cell_of, order = partial(_Cell, similarity, similarity / 100 - 0.2), ["key", "lo", "hi", "node"]
    signatures = member.where("sig is not null and n > 0").select("node", "n", "sig", "bands")
    dealt = cells(rest, store, block, shingles).join(signatures, "node").where("array_contains(bands, key)")
    dealt = dealt.select("key", "lo", "hi", "block", "root", "node", "n", "sig", "bands").repartition(n, *order[:3]).sortWithinPartitions(*order)
    met = store.put(dealt.mapInArrow(meeting(cell_of), "key long, lo long, hi long, block long, root long, node long").distinct(), "meeting")
    full = met.join(signatures, "node").where("array_contains(bands, key)").join(texts, "node")
    full = full.select("key", "lo", "hi", "block", "root", "node", "sig", "bands", "text").repartition(n, *order[:3]).sortWithinPartitions(*order)
    more = store.put(full.mapInArrow(linked(size, similarity, cell_of), "a long, b long").distinct(), "more")

    links, small = links.unionByName(more), member.where("prefix is not null").select("node", "n", "prefix", "counts")
    if small.head(1):
        links = links.unionByName(tree_links(small, source, some_lost, store, size, similarity, block, shingles, "short"))
    return settled(member, links, some_lost, store), some_lost


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept; similarity in per cent of the union."""
    out, _ = _components(docs, **options)
    return out.select(F.when(~F.col("lost"), F.col("node")).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, all its rows; one row where no doc_id is."""
    out, some_lost = _components(docs, **options)
    named = docs.where("doc_id is not null").withColumn("_node", node_of())
    rest = named.join(out.where("kept and not lost").select(F.col("node").alias("_node")).distinct(), "_node", "left_semi").select(*docs.columns)
    if not some_lost:
        return rest
    lost = docs.where("doc_id is null").withColumn("_node", node_of())
    kept = lost.join(out.where("kept and lost").groupBy(F.col("node").alias("_node")).agg((F.max("n") > 0).alias("_one")), "_node")
    return rest.unionByName(kept.where("not _one").select(*docs.columns)).unionByName(kept.where("_one").dropDuplicates(["_node"]).select(*docs.columns))
