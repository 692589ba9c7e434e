"""Benchmark decontamination with suffix arrays of the training shards.

Each shard (a block of whole documents) gets the array of all its suffixes, as word sequences, in
lexicographic order of word hashes, whole to the end of their texts. Every suffix of every benchmark item
that holds a window is looked up by binary search, one word deeper a step, until no suffix of the shard is
left; the last interval gives its longest verbatim matches and their places. The benchmark goes to the tasks
in blocks of a bounded size; a shard meets one block after the other and a task holds one at a time.

Defined cases: null and empty texts have no words and are never contaminated; items without
words have no window; an item shorter than the window is one window; repeated items with one
id count once, null item ids count as none but their windows hit; an empty benchmark leaves
all documents clean; an empty table gives no rows; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .text import ALNUM, chunks, join_texts, words

ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, matches array<struct<item_id:long,item_start:long,start:long,length:long>>"
MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word (one more than texts)."""
    hashes, _, _, first = words(*join_texts([t.lower() for t in texts]), ALNUM)
    return hashes, first


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


class Shard:
    """Words of whole texts and the array of their suffixes."""

    def __init__(self, texts: list[bytes]):
        self.hashes, self.first = _words(texts)
        self.sizes = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.ends = self.first[1:][self.owner]
        self.array = self._sorted()

    def _sorted(self) -> np.ndarray:
        """Suffixes in order, by doubling the sorted depth; only those that still tie are sorted again."""
        n = len(self.hashes)
        array = np.argsort(self.hashes)
        new = np.ones(n, bool)
        new[1:] = self.hashes[array[1:]] != self.hashes[array[:-1]]
        rank = np.empty(n, np.int64)  # the place in the array where a suffix's ties start
        rank[array] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        # suffixes that have ended tie for good: they are equal
        slots = np.flatnonzero(~new | ~np.append(new[1:], True))
        depth = 1
        while len(slots):
            at = array[slots]
            beyond = at + depth
            ended = beyond >= self.ends[at]
            key = rank[at] << 32 | np.where(ended, 0, rank[np.minimum(beyond, n - 1)] + 1)
            order = np.argsort(key)
            at, key = at[order], key[order]
            array[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            depth *= 2
            slots = slots[(~new | ~np.append(new[1:], True)) & ~ended[order]]
        return array

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals of suffixes with depth equal words, those whose next word is word: two binary searches."""
        out = []
        for after in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) >> 1
                at = self.array[mid]
                own = self.hashes[np.minimum(at + depth, len(self.hashes) - 1)]
                less = (at + depth >= self.ends[at]) | (own < word[open_]) | (own == word[open_] if after else False)
                a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            out.append(a)
        return out[0], out[1]


class Queries:
    """The suffixes of a block of benchmark items that hold a window."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.hashes, self.first = _words([t for _, t in items])
        size = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(items)), size)
        self.ends = self.first[1:][self.owner]
        self.need = np.minimum(window, size)[self.owner]
        self.at = np.flatnonzero(np.arange(len(self.hashes)) + self.need <= self.ends)


class Found:
    """What a shard's search has found: at each word the longest match that starts there, and items by text."""

    def __init__(self, shard: Shard):
        n = len(shard.hashes)
        self.length, self.item_start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.item: list[int | None] = []
        self.number = np.full(n, -1, np.int64)
        self.pairs: set[tuple[int, int | None]] = set()

    def add(self, shard: Shard, queries: Queries) -> None:
        """Looks all of the block's suffixes up."""
        if not len(queries.at) or not len(shard.hashes):
            return
        base = len(self.item)
        self.item += queries.ids
        sorted_ = shard.hashes[shard.array]
        at, depth = queries.at, 1
        lo, hi = np.searchsorted(sorted_, queries.hashes[at], "left"), np.searchsorted(sorted_, queries.hashes[at], "right")
        while True:
            left = hi > lo
            at, lo, hi = at[left], lo[left], hi[left]
            if not len(at):
                return
            full = np.flatnonzero(depth >= queries.need[at])
            if len(full):
                self._note(shard, queries, base, at[full], lo[full], hi[full], depth)
            more = at + depth < queries.ends[at]
            at, lo, hi = at[more], lo[more], hi[more]
            lo, hi = shard.narrow(lo, hi, depth, queries.hashes[at + depth])
            depth += 1

    def _note(self, shard: Shard, queries: Queries, base: int, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> None:
        order = np.lexsort((at, lo))
        at, lo, hi = at[order], lo[order], hi[order]
        # intervals of one depth are equal or apart, so each place is met once
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] != lo[:-1]
        starts = np.flatnonzero(new)
        places = shard.array[_ranges(lo[starts], hi[starts])]
        of = np.repeat(at[starts], (hi - lo)[starts])
        better = self.length[places] < depth
        places, of = places[better], of[better]
        self.length[places] = depth
        self.number[places] = base + queries.owner[of]
        self.item_start[places] = of - queries.first[queries.owner[of]]
        for i, j in zip(starts, [*starts[1:], len(lo)], strict=True):
            items = {queries.ids[k] for k in queries.owner[at[i:j][depth == queries.need[at[i:j]]]]}
            if items:
                for text in np.unique(shard.owner[shard.array[lo[i] : hi[i]]]).tolist():
                    self.pairs.update((text, item) for item in items)

    def rows(self, shard: Shard, share: int) -> dict[str, list]:
        """The added columns, a value a text."""
        n = len(shard.sizes)
        at = np.flatnonzero(self.length)
        edge = np.zeros(len(shard.hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.length[at], -1)
        hit = np.bincount(shard.owner[np.cumsum(edge[:-1]) > 0], minlength=n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, shard.owner[at], self.length[at])
        matches: list[list] = [[] for _ in range(n)]
        for p in at.tolist():
            text = int(shard.owner[p])
            # a start whose left neighbour starts the same match one word longer is no match of its own
            if p == shard.first[text] or self.length[p - 1] <= self.length[p]:
                matches[text].append({"item_id": self.item[self.number[p]], "item_start": int(self.item_start[p]), "start": int(p - shard.first[text]), "length": int(self.length[p])})
        items: list[set] = [set() for _ in range(n)]
        for text, item in self.pairs:
            items[text].add(item)
        return {
            "n_words": shard.sizes,
            "n_hit": hit,
            "n_items": [len(x - {None}) for x in items],
            "items_sha256": [_digest(x) for x in items],
            "contaminated": (hit > 0) & (share * hit >= shard.sizes),
            "longest": longest,
            "matches": matches,
        }


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


def _scan(blocks: list, schema: pa.Schema, names: list[str], share: int, shard_bytes: int):
    def run(batches):
        for batch, texts in chunks(batches, limit=shard_bytes):
            shard = Shard(texts)
            found = Found(shard)
            for block in blocks:
                found.add(shard, block.value)
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # read again from the worker's own disk for the next shard
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            columns |= {n: pa.array(v, MATCH if n == "matches" else schema.field(n).type) for n, v in found.rows(shard, share).items()}
            yield pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's items, hash-dealt over as many blocks as keep each near block_bytes."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    for i in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, longest, and matches.

    A document is contaminated if a word is hit and share * n_hit >= n_words. matches: the longest verbatim runs
    as (item_id, item_start, start, length) in words; of several items with a run as long that of the first in the
    block. longest: the length of the longest of them, 0 if none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark = docs.sparkSession
    ship(spark)
    added = _parse_datatype_string(ADDED)
    docs = docs.drop(*added.names)
    out = StructType([*docs.schema.fields, *added.fields])
    blocks = [spark.sparkContext.broadcast(Queries(items, window)) for items in _blocks(benchmark, block_bytes)]
    return docs.mapInArrow(_scan(blocks, to_arrow_schema(out), docs.columns, share, shard_bytes), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, **options) -> DataFrame:
    """docs without the affected ones, their columns unchanged.

    Affected is a document with window words of an item in a row, however long it is, and one whose hits by
    shorter items make it contaminated.
    """
    marked = contamination(docs, benchmark, window, **options)
    return marked.where(~F.col("contaminated") & (F.col("longest") < window)).select(*docs.columns)
