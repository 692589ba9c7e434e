"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Documents are dealt into batches in doc_id order. The suffixes of a batch, bytes and all, are put into a suffix array, which is
merge-scanned against those of all earlier batches for matches of ``length`` bytes; arrays of like size merge geometrically,
so each suffix is merged a logarithmic number of times. A match ends at ``length`` bytes, so suffixes are ordered by that many.
Strings are cut into shards and those into parts of a bounded size; each part has its family, one at a time in a task.

Sending every suffix would cost many times the text. So a sketch of anchors goes first: each string of ``length`` bytes is
named by the least hash of its inner ``anchor``-byte strings; equal strings have equal names, and only strings whose name is in
two batches, or in two documents of a batch, are looked at further. Neighbours with one name go as one segment of text to the
shard of the name, about as many bytes as half a fingerprint each; names of more than ``common`` batches are split, each of
their strings going to the shard of its own fingerprint, so that no shard holds all that stands around a frequent passage.
Hashes only ever send strings somewhere: equal bytes decide. Exact copies of a text are settled by digest: all but the smallest
doc_id are removed whole.

Defined cases: null and empty texts have no bytes; a text shorter than length keeps all; rows that
repeat a doc_id never match each other, but rows of larger doc_ids match any of them; rows without
doc_id count as the largest id; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .text import BASE, distinct, mix, powers

NONE = 2**63 - 1
STEP = 1 << 16
_inverse = np.full(STEP + 1, pow(int(BASE), -1, 2**64), dtype=np.uint64)
_inverse[0] = 1
_inverse = np.multiply.accumulate(_inverse)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit fingerprints of all substrings of size bytes, in order."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    power = powers(STEP + size)
    for at in range(0, n, STEP):
        own = data[at : at + STEP + size - 1].astype(np.uint64)
        own += np.uint64(1)
        own *= power[: len(own)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
        m = min(STEP, n - at)
        out[at : at + m] = (sums[size : size + m] - sums[:m]) * _inverse[:m]
    return mix(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each size values that follow each other."""
    n = len(values) - size + 1
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[size - span : size - span + n])


def names(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The name of each substring of length bytes: the least hash of its substrings of anchor bytes.

    The least of many hashes is a small number; it is mixed once more, so that the highest bits deal names evenly.
    """
    return mix(sliding_min(rolling(data, anchor), length - anchor + 1)) if len(data) >= length else np.zeros(0, np.uint64)


_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _small(data: bytes) -> bytes:
    return _compressor.compress(data)


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct values as differences, byte planes apart, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _small(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressor.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(values):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def windows(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The strings of size bytes at the places, as fixed-width keys that sort and compare by bytes."""
    if not len(at):
        return np.zeros(0, f"S{size}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)[at]).view(f"S{size}").ravel()


def by_bytes(keys: np.ndarray) -> np.ndarray:
    """The stable order of fixed-width keys: by their first 8 bytes as numbers, then by all of them where those tie."""
    if not len(keys) or keys.itemsize < 8:
        return np.argsort(keys, kind="stable")
    first = np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1)[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    slots = np.flatnonzero(np.append(same, False) | np.concatenate((np.zeros(1, bool), same)))
    tied = order[slots]
    order[slots] = tied[np.argsort(keys[tied], kind="stable")]
    return order


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from lo with n numbers, one range after the other."""
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


class Levels:
    """Suffix arrays of geometrically growing size: sorted distinct strings, each with the least document that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def earliest(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted distinct strings the least document with it, NONE if there is none."""
        out = np.full(len(keys), NONE, np.int64)
        for level, docs in self.levels:
            if len(level) <= 8 * len(keys):  # like sizes: one scan over both
                both = np.concatenate((level, keys))
                order = np.argsort(both, kind="stable")  # two sorted runs, which are only merged
                same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
                at, hit = order[same], order[same + 1] - len(level)
            else:
                place = np.minimum(np.searchsorted(level, keys), len(level) - 1)
                hit = np.flatnonzero(level[place] == keys)
                at = place[hit]
            out[hit] = np.minimum(out[hit], docs[at])
        return out

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Adds sorted distinct strings that no level holds."""
        if len(keys):
            self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            two, one = self.levels.pop(), self.levels.pop()
            keys, docs = (np.concatenate(x) for x in zip(one, two, strict=True))
            order = np.argsort(keys, kind="stable")
            self.levels.append((keys[order], docs[order]))


def _batches(limit: int):
    """Whole documents as rows (batch, docs, texts) of about limit bytes.

    Rows (doc, digest, kind, text) are sorted; one of kind 0 says that those with its doc and digest, which follow, go.
    """

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        texts: list[bytes] = []
        size, gone = 0, None

        def out():
            return pa.record_batch([pa.array([part << 24 | seq], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], ["batch", "docs", "texts"])

        for batch in batches:
            for doc, digest, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if not kind:
                    gone = doc, digest
                if gone == (doc, digest):
                    continue
                own = text.as_buffer().to_pybytes() if text.is_valid else b""
                if docs and size + len(own) > limit:
                    yield out()
                    seq, docs, texts, size = seq + 1, [], [], 0
                docs.append(doc)
                texts.append(own)
                size += len(own)
        if docs:
            yield out()

    return run


def _cells(values: np.ndarray, bits: int):
    """(shard, values) of sorted distinct values, cut by their highest bits."""
    if not bits:
        return [(0, values)] if len(values) else []
    cuts = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return [(i, values[a:b]) for i, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(values)), strict=True)) if b > a]


#: Bits of a name that are compared; others are cut off, which only lets more strings through.
KEPT = np.uint64(0xFFFFFFFFFF000000)


def _all_names(texts: list[bytes], length: int, anchor: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each text the names of its strings as runs (name, how many strings), and all names, sorted."""
    per = []
    for t in texts:
        v = names(np.frombuffer(t, np.uint8), length, anchor) & KEPT
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
        per.append((v[starts], np.diff(starts, append=len(v))))
    return per, distinct(np.concatenate([v for v, _ in per])) if per else np.zeros(0, np.uint64)


def _sketch(length: int, anchor: int, bits: int):
    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                _, own = _all_names(b.column(2)[row].as_py(), length, anchor)
                cells = _cells(own, bits)
                yield pa.record_batch([pa.array([i for i, _ in cells], pa.int32()), pa.array([b.column(0)[row].as_py()] * len(cells), pa.int64()), pa.array([packed(v) for _, v in cells], pa.binary())], ["shard", "batch", "keys"])

    return run


def _by_shard(batches, read):
    """Rows sorted by shard, then batch, as (shard, iterator of (batch, read of the others)) without holding a shard's rows."""
    import itertools

    rows = (row for x in batches for row in zip(*(x.column(i).to_pylist() for i in range(x.num_columns)), strict=True))
    for shard, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield shard, ((b, read(*rest)) for _, b, *rest in own)


def _mask(bits: np.ndarray) -> bytes:
    return _small(np.packbits(bits).tobytes())


def _bits(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_decompressor.decompress(mask), np.uint8), count=n).astype(bool)


def _replies(shard: int, batches: list[int], masks: list[np.ndarray], often: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(batches, pa.int64()), pa.array([shard] * len(batches), pa.int32()), *(pa.array([_mask(x) for x in own], pa.binary()) for own in (masks, often))]
    return pa.record_batch(columns, ["batch", "shard", "mask", "often"])


def _shared_names(common: int):
    """Which names of each batch other batches have too, and which more than common batches have.

    A shard's names are held at once, and there are enough shards for that.
    """

    def run(batches):
        for shard, rows in _by_shard(batches, unpacked):
            held = list(rows)
            values, counts = np.unique(np.concatenate([k for _, k in held]), return_counts=True)
            shared, often = values[counts > 1], values[counts > common]
            yield _replies(shard, [batch for batch, _ in held], [member(shared, keys) for _, keys in held], [member(often, keys) for _, keys in held])

    return run


def _segments(parts: bytes, counts: bytes, docs: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(parts, "<u4"), *(np.frombuffer(_decompressor.decompress(x), t) for x, t in ((counts, "<u4"), (docs, "<i8"), (data, np.uint8)))


def _earlier(length: int, block: int):
    """Which strings of each batch a smaller doc_id of another batch has: one logarithmic family after the other for the parts of a shard.

    Segments that follow each other and have about block strings make a block, whose suffix array is the family's smallest.
    """

    def scan(levels: Levels, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        order = by_bytes(keys)  # the block's suffix array; of equal strings the least document's is first
        keys = keys[order]
        new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        keys, docs = keys[new], docs[order]
        least, before = docs[new], levels.earliest(keys)
        found = np.zeros(len(docs), bool)
        found[order] = np.minimum(least, before)[np.cumsum(new) - 1] < docs
        fresh = (before == NONE) & (least != NONE)  # what only rows without doc_id have is before nothing
        levels.add(keys[fresh], least[fresh])
        return found

    def run(batches):
        for shard, rows in _by_shard(batches, _segments):
            held = list(rows)
            names_, ends = [batch for batch, _ in held], np.cumsum([int(own[1].sum()) for _, own in held])
            part = np.concatenate([np.repeat(np.arange(len(own[0]), dtype=np.int32), own[0]) for _, own in held])
            counts, docs, data = (np.concatenate([own[i] for _, own in held]) for i in (1, 2, 3))
            del held
            counts = counts.astype(np.int64)
            sizes = counts + length - 1
            first, starts = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
            found = np.zeros(ends[-1], bool)
            for segments in (np.flatnonzero(part == i) for i in range(part.max(initial=0) + 1)):
                levels = Levels()
                for own in np.split(segments, np.flatnonzero(np.diff(np.cumsum(counts[segments]) // block)) + 1):
                    n = counts[own]
                    found[ranges(first[own], n)] = scan(levels, windows(data, ranges(starts[own], n), length), np.repeat(docs[own], n))
            yield _replies(shard, names_, np.split(found, ends[:-1]), [found[:0]] * len(names_))

    return run


def _told(replies, values: np.ndarray, bits: int, field: str = "mask") -> np.ndarray:
    """The mask over the sorted values that the shards' replies put together."""
    masks = {r["shard"]: r[field] for r in replies or ()}
    out = np.zeros(len(values), bool)
    at = 0
    for i, own in _cells(values, bits):
        if i in masks:
            out[at : at + len(own)] = _bits(masks[i], len(own))
        at += len(own)
    return out


class Strings:
    """The strings of a batch that may repeat, as distinct segments of text by shard, cut into 2^fine parts; docs ascend."""

    def __init__(self, docs: list[int], texts: list[bytes], replies, length: int, anchor: int, bits: int, fine: int = 0):
        self.length, self.docs = length, np.array(docs, np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        per, all_ = _all_names(texts, length, anchor)
        runs = np.array([len(v) for v, _ in per], np.int64)
        names_ = np.concatenate([v for v, _ in per]) if per else all_
        counts = np.concatenate([c for _, c in per]) if per else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), runs)
        del per
        first = np.cumsum(counts) - counts
        own = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))[np.cumsum(runs) - runs] if len(runs) else first
        at = first - np.repeat(own, runs)
        # a name that two different doc_ids of the batch share; of repeated places the last assignment holds
        order = np.argsort(names_)
        flat = np.empty(len(names_), np.int64)
        flat[order] = np.cumsum(np.diff(names_[order], prepend=names_[order[:1]]) != 0)
        ids = self.docs[text]
        low, high = np.zeros(len(all_), np.int64), np.zeros(len(all_), np.int64)
        high[flat], low[flat[::-1]] = ids, ids[::-1]
        wanted = (_told(replies, all_, bits) | (low < high))[flat]
        often = _told(replies, all_, bits, "often")[flat][wanted]
        text, at, counts, route = text[wanted], at[wanted], counts[wanted], names_[wanted]
        del first, own, order, flat, ids, low, high, wanted, names_
        if often.any():
            # strings of common names go one by one, by their own fingerprints
            places = ranges((self.starts[text] + at)[often], counts[often])
            one = np.repeat(text[often], counts[often])
            prints = rolling(self.data, length)[places]
            text, at = np.concatenate((text[~often], one)), np.concatenate((at[~often], places - self.starts[one]))
            counts, route = np.concatenate((counts[~often], np.ones(len(one), np.int64))), np.concatenate((route[~often], prints))
            order = np.lexsort((at, text))
            text, at, counts, route = text[order], at[order], counts[order], route[order]
        self.text, self.at, self.counts = text, at.astype(np.int32), counts
        # equal segments once, in the order of the least document that has them
        whole, seen = self.data.tobytes(), {}
        places = (self.starts[text] + at).tolist()
        self.segment = np.array([seen.setdefault(whole[p : p + n], len(seen)) for p, n in zip(places, (counts + length - 1).tolist(), strict=True)], np.int64)
        self.bytes = list(seen)
        fresh = np.zeros(len(seen), np.int64)
        fresh[self.segment[::-1]] = np.arange(len(self.segment))[::-1]
        self.least, self.size = self.docs[text[fresh]], counts[fresh]
        part = (route[fresh] >> np.uint64(64 - bits - fine)).astype(np.int64) if bits + fine else np.zeros(len(seen), np.int64)
        self.fine, self.part, shard = fine, part & (1 << fine) - 1, part >> fine
        self.order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[self.order], prepend=-1))
        self.cells = [(int(shard[self.order[a]]), self.order[a:b]) for a, b in zip(cuts, np.append(cuts, len(self.order))[1:], strict=True)]

    def sent(self) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """(shard, how many segments of each part, their counts of strings, documents, text) of each shard."""
        return [(shard, np.bincount(self.part[own], minlength=1 << self.fine).astype("<u4").tobytes(), _small(self.size[own].astype("<u4").tobytes()), _small(self.least[own].astype("<i8").tobytes()), _small(b"".join(self.bytes[i] for i in own))) for shard, own in self.cells]

    def covered(self, replies) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the strings that a smaller doc_id has, in this batch or, as the replies say, in another."""
        masks = {r["shard"]: r["mask"] for r in replies or ()}
        parts = [_bits(masks[shard], int(self.size[own].sum())) if shard in masks else np.zeros(int(self.size[own].sum()), bool) for shard, own in self.cells]
        told = np.concatenate(parts) if parts else np.zeros(0, bool)
        base = np.zeros(len(self.size), np.int64)
        base[self.order] = np.cumsum(self.size[self.order]) - self.size[self.order]
        out = told[ranges(base[self.segment], self.counts)]
        text = np.repeat(self.text, self.counts)
        at = ranges(self.at.astype(np.int64), self.counts).astype(np.int32)
        return text, at, out | self._before(text, (self.starts[text] + at).astype(np.int32 if len(self.data) < NONE >> 32 else np.int64))

    def _before(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which strings a smaller doc_id of this batch has; fingerprints group them, bytes decide."""
        prints = rolling(self.data, self.length)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(prints, kind="stable").astype(np.int32)
        new = np.concatenate((np.ones(min(1, len(prints)), bool), prints[order[1:]] != prints[order[:-1]]))
        source = np.empty(len(prints), np.int32)
        source[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(prints))))
        del order, new
        ids = self.docs
        out = ids[text[source]] < ids[text]
        hit = np.flatnonzero(out)
        differ = np.zeros(len(out), bool)
        for i in range(0, len(hit), STEP):
            own = hit[i : i + STEP]
            differ[own] = windows(self.data, place[own], self.length) != windows(self.data, place[source[own]], self.length)
        if differ.any():  # fingerprints that two strings share: those groups go by bytes alone
            least: dict[bytes, int] = {}
            for i in np.flatnonzero(np.isin(prints, prints[differ])).tolist():
                key = self.data[place[i] : place[i] + self.length].tobytes()
                own = int(ids[text[i]])
                out[i] = least.setdefault(key, own) < own
        return out


def _index(length: int, anchor: int, bits: int, fine: int):
    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                cells = Strings(row["docs"], row["texts"], row["names"], length, anchor, bits, fine).sent()
                columns = [pa.array([c[0] for c in cells], pa.int32()), pa.array([row["batch"]] * len(cells), pa.int64()), *(pa.array([c[i] for c in cells], pa.binary()) for i in (1, 2, 3, 4))]
                yield pa.record_batch(columns, ["shard", "batch", "parts", "counts", "docs", "data"])

    return run


def _cut(text: bytes, starts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left, if all strings at starts go."""
    if not len(starts):
        return 0, 0, text
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _apply(length: int, anchor: int, bits: int, fine: int, texts: bool):
    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                text, at, hit = Strings(row["docs"], row["texts"], row["names"], length, anchor, bits, fine).covered(row["strings"])
                text, at = text[hit], at[hit]
                cuts = np.searchsorted(text, np.arange(len(row["texts"]) + 1))
                done = [_cut(t, at[x:y], length) for t, x, y in zip(row["texts"], cuts[:-1], cuts[1:], strict=True)]
                columns = [pa.array(row["docs"], pa.int64()), pa.array([len(t) for t in row["texts"]], pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done]), pa.array([d[2] if texts else None for d in done], pa.binary())]
                yield pa.record_batch(columns, ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, anchor: int = 30, batch_bytes: int = 3 << 20, shard_bytes: int = 8 << 20, broadcast_bytes: int = 32 << 20, common: int = 16, block: int = 1 << 18, texts: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left, if texts)."""
    spark = docs.sparkSession
    store = Store(spark, "suffixes")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    digests = store.put(own.select("doc", F.md5("text").alias("digest"), F.octet_length("text").alias("n")), "digests")
    classes = store.put(digests.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("copies")).where("copies > 1").select("digest", "least"), "classes")
    # of a text's rows with its least doc_id all stay; a row without doc_id never yields to another such row
    copies = store.put(digests.join(classes, "digest").where("doc > least").select("doc", "digest", "n"), "copies")
    total = digests.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // (5 * batch_bytes)))
    # a sketch entry of 8 bytes for a dozen bytes of text, an indexed string of length bytes for every few; a shard's text is
    # held at once, but one family at a time, of a part of about shard_bytes, so that a batch sends fewer rows
    bits = max(4, int(total // (4 * shard_bytes)).bit_length())
    fine = max(0, int(total // shard_bytes).bit_length() - bits)
    # texts move once: what is to be left out travels along as marks, where a join would deal out the texts once more
    marks = copies.select("doc", F.unhex("digest").alias("digest"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("text")).distinct()
    keyed = own.select("doc", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("kind"), "text").unionByName(marks)
    dealt = keyed.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "digest", "kind").mapInArrow(_batches(batch_bytes), "batch long, docs array<long>, texts array<binary>")
    dealt = store.put(dealt, "batches")

    def exchange(frame: DataFrame, answer, name: str) -> DataFrame:
        shards = frame.repartitionById(1 << bits, "shard").sortWithinPartitions("shard", "batch")  # hashing would put several into one task
        replies = store.put(shards.mapInArrow(answer, "batch long, shard int, mask binary, often binary"), name)
        small = (replies.agg(F.sum(F.octet_length("mask") + F.octet_length("often"))).first()[0] or 0) <= broadcast_bytes
        own = replies.groupBy("batch").agg(F.collect_list(F.struct("shard", "mask", "often")).alias(name))
        return F.broadcast(own) if small else own  # else the join deals the batches out once more

    shared = exchange(dealt.mapInArrow(_sketch(length, anchor, bits), "shard int, batch long, keys binary"), _shared_names(common), "names")
    told = dealt.join(shared, "batch", "left").select("batch", "docs", "texts", "names")
    earlier = exchange(told.mapInArrow(_index(length, anchor, bits, fine), "shard int, batch long, parts binary, counts binary, docs binary, data binary"), _earlier(length, block), "strings")
    both = told.join(earlier, "batch", "left").select("batch", "docs", "texts", "names", "strings")
    kept = both.mapInArrow(_apply(length, anchor, bits, fine, texts), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = F.col("n") >= length
    # a copy too short for any string keeps its bytes; the text is needed only then
    short = own.where(F.octet_length("text") < length).withColumn("digest", F.md5("text")).select("digest", "text").distinct()
    whole = copies.join(short, "digest", "left").select(
        "doc", F.col("n").cast("long").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(gone, F.lit("").cast("binary")).otherwise(F.col("text")), 256).alias("kept_sha256"), (F.when(gone, F.lit("").cast("binary")).otherwise(F.col("text")) if texts else F.lit(None).cast("binary")).alias("kept"),
    )
    out = kept.unionByName(whole)
    return out.select(F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))
