"""Best-fit-decreasing packing of token pieces into sequences.

Every document becomes token ids plus the end id; only documents longer than a sequence are
cut. Best fit decreasing depends on lengths alone, and there are at most ``capacity`` lengths,
so the driver packs the histogram of lengths: a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and equal pieces that would meet equal bins move as one
step. The plan has a size bounded by the capacity, not by the documents; tasks look their pieces
up in it by (length, rank).

Defined cases: null and empty texts are one piece with the end id alone; rows are packed one by
one, so repeated rows keep their own places; an empty table packs nothing; extra columns are not
carried.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store
from .text import chunks


class Cache:
    """Ids by word in two generations: the older goes when the newer is full, so frequent words stay and memory is bounded."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        self.most, self.make, self.new, self.old = most, make, {}, {}

    def look(self, words: list[str]) -> list[bytes]:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for word in words:
            ids = new.get(word)
            if ids is None:
                ids = old.get(word)
                new[word] = ids = self.make(word) if ids is None else ids
            out.append(ids)
        return out


#: Words of letters whose lower case and composition are themselves one to one, and trailing punctuation.
SIMPLE = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"


class Ragged:
    """Rows of ids, one after the other in flat; take gives rows in another order or again."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths, self.ends = flat, lengths, np.cumsum(lengths)

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(rows), dtype="<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)

    def take(self, rows: np.ndarray) -> Ragged:
        lengths = self.lengths[rows]
        starts = self.ends[rows] - lengths
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return Ragged(self.flat[at], lengths)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


#: What a tokenizer that works on words alone may be made of; it must also give the same ids for PROBES in whole and by words.
NORMALIZERS, SPLITTERS = {"NFC", "Replace", "Lowercase"}, {"Split", "ByteLevel"}
PROBES = (
    "The QUICK brown fox, it's 12.5 km (or 3) away: don't stop!!", "  two  spaces\n\nlines \t tab\r\n end ", "Ünïted ÀÉÎ straße naïve coöperate ÿ Þorn", "a,b;c x-y_z a.b.c 'quoted' \"said\" #tag $5 50% A&B",
    "e\u0301 cafe\u0301 \u00a0nbsp\u00a0 \u2028 line \u3000 wide", "日本語 текст עברית 🙂🙂 İstanbul ﬁne", "supercalifragilistic" * 4, "", " ", "\n", "we're WE'LL they've I'd i'm", "\x00 \x1f \x7f \x85 x",
)


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, without its truncation and padding.

    Most vocabularies' tokens never cross white space, which they drop, and letters are lower-cased; whether
    that is so is read from the file and tried on PROBES, and any other tokenizer is given whole texts. For these the distinct words between spaces and line feeds of many texts are found at once. A word of plain
    letters is given to the tokenizer's model in the model's byte letters; marks behind it and every other
    word go to the tokenizer whole. Bounded caches keep both.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stems, self.words = Cache(most, self._letters), Cache(most // 2, self._whole)
        letters = byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.by_words = self._splits(path) and all(np.array_equal(a, b) for a, b in zip(self._by_words(pa.array(PROBES)), map(self._ids, PROBES), strict=True))

    @staticmethod
    def _splits(path: str) -> bool:
        """Whether the file describes byte-level pairs without chance over lower-cased words, and no added token holds white space."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)

        def parts(step: dict | None) -> list[dict]:
            inner = (step or {}).get("normalizers") or (step or {}).get("pretokenizers")
            return [q for p in inner for q in parts(p)] if inner else [step] if step else []

        normalizers, splitters, model = parts(spec["normalizer"]), parts(spec["pre_tokenizer"]), spec["model"]
        known = {p["type"] for p in normalizers} <= NORMALIZERS and {p["type"] for p in splitters} == SPLITTERS
        return (
            known and "Lowercase" in {p["type"] for p in normalizers} and all(p["content"] == " " for p in normalizers if p["type"] == "Replace")
            and all(p["behavior"] == "Removed" for p in splitters if p["type"] == "Split") and not any(p["add_prefix_space"] for p in splitters if p["type"] == "ByteLevel")
            and model.get("type") == "BPE" and not model.get("dropout") and not any(set(t["content"]) & set(" \n") for t in spec["added_tokens"])
        )

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _letters(self, stem: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(stem if stem.isascii() else stem.translate(self.table))])

    def _distinct(self, words: pa.Array) -> Ragged:
        parts = pc.extract_regex(words, SIMPLE)
        simple = parts.is_valid()
        stems = pc.utf8_lower(parts.field("stem").filter(simple)).dictionary_encode()
        marks = parts.field("marks").filter(simple).dictionary_encode()
        listed = [x.to_numpy(zero_copy_only=False).tolist() for x in (stems.dictionary, marks.dictionary, words.filter(pc.invert(simple)))]
        known = Ragged.of([b"", *self.stems.look(listed[0]), *self.words.look(listed[1]), *self.words.look(listed[2])])
        rows, of = np.zeros((len(words), 2), np.int64), simple.to_numpy(zero_copy_only=False)
        rows[of, 0] = 1 + stems.indices.to_numpy()
        rows[of, 1] = 1 + len(listed[0]) + marks.indices.to_numpy()
        rows[~of, 0] = 1 + len(listed[0]) + len(listed[1]) + np.arange(len(listed[2]))
        both = known.take(rows.ravel())
        return Ragged(both.flat, both.lengths.reshape(-1, 2).sum(axis=1))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        return self._by_words(texts) if self.by_words else [self._ids(t or "") for t in texts.to_pylist()]

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        out = self._distinct(words.dictionary).take(words.indices.to_numpy())
        ends = np.concatenate(([0], out.ends))[np.cumsum(split.value_lengths().to_numpy())]
        return np.split(out.flat, ends[:-1])


#: About so many bytes of text are encoded at once: enough that most words repeat, and little beside a task's memory.
CHUNK = 1 << 22

_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, so that tasks after the first find words known."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder = encoder_for(path)
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, _ in chunks(batches, limit=CHUNK):
            rows: list[list] = [[] for _ in range(7)]
            for doc, own in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    for column, value in zip(rows, (doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), part, int(ranks[len(cut)])), strict=True):
                        column.append(value)
                    ranks[len(cut)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


class CapacityTree:
    """Segment tree over remaining capacities; a leaf tells whether a bin of that capacity is open."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.n)

    def set(self, at: int, value: bool) -> None:
        at += self.n
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least least."""
        at = least + self.n
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.n:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.n


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over a histogram of lengths: steps (length, first rank, pieces a bin, first bin, offset), and the number of bins.

    The piece of rank r of a step goes to bin first + (r - first rank) // pieces at offset + length * ((r - first rank) % pieces).
    """
    tree = CapacityTree(capacity)
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first bin, bins)
    steps, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
                room = capacity
            else:
                first, n = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
                each = room // length
            steps.append((length, rank, each, first, capacity - room))
            full = min(n, left // each)
            put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n:
                part = min(left, each - 1)
                if part:
                    put(room - part * length, first + full, 1)
                    rank, left, full = rank + part, left - part, full + 1
                put(room, first + full, n - full)
    return steps, bins


def _place(shared):
    def run(batches):
        lengths, ranks, each, bins, offsets = shared.value
        keys = (lengths << np.int64(42)) + ranks
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = column["length"].to_numpy(), column["rank"].to_numpy(zero_copy_only=False)
            step = np.searchsorted(keys, (length << np.int64(42)) + rank, side="right") - 1
            within = rank - ranks[step]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(column[n] for n in names), pa.array(bins[step] + within // each[step]), pa.array(offsets[step] + length * (within % each[step]))], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset; tokenizer is a file of the tokenizers library."""
    spark = docs.sparkSession
    store = Store(spark, "packing")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    pieces = store.put(pieces, "pieces")
    counts = store.put(pieces.groupBy("part", "length").count(), "counts")
    steps, _ = plan({int(r["length"]): r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    steps.sort()
    columns = tuple(np.array(c, dtype=np.int64) for c in zip(*steps, strict=True)) if steps else tuple(np.zeros(0, np.int64) for _ in range(5))
    shared = spark.sparkContext.broadcast(columns)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    return ranked.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
