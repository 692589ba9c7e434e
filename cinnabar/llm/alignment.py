"""Alignment of two tokenizers' tokens over a corpus, worked out once for each distinct segment.

Tokenizer A is a byte-level BPE that encodes a space and the text, tokenizer B a sentencepiece model that adds that space
itself. Texts are cut before white space runs, but only where neither vocabulary can merge across: ``cut_characters``
reads both vocabularies and keeps the white space characters that no entry has behind another kind of character. A
run's first character must be one of them, and the character before it a letter, a digit or printable ASCII, which
no tokenizer takes for white space. Documents stand in blocks of up to ``block_bytes`` (a longer one is a
block of its own), each one compressed row; a block sends each of its segments once, with how often it occurs. Each distinct
segment of the corpus is then encoded by both tokenizers and aligned once; pairs of linked ids are counted from segments and
their numbers; and alignments go back to the blocks, packed to a row for each block and task, where documents are composed of them. What is shuffled is a block's distinct
segments, not their occurrences. Pairs of ids that are in more than a thousandth of all links of distinct segments (fewer
than a thousand pairs, so their size is bounded) are broadcast to be looked up, others are joined.

A segment whose tokens don't give back its bytes makes its documents documents without tokens; what such documents
add to the numbers of their other segments is taken off again before pairs are counted.

Defined cases: null and empty texts have no tokens, and all their numbers are 0; rows without doc_id and rows that repeat one are
rows like others and count each; only doc_id and text are read of docs, whatever else it has; an empty table gives no rows; a text without
white space is one segment however long, and a task needs the memory of its longest text.
"""

from __future__ import annotations

import operator
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_letters
from .store import Store, partitions

SPACES = " \t\n\x0b\x0c\r"
META = "▁"
#: A word before a segment that has no space of its own; its tokens are taken off again.
GUARD = "a"
#: Texts whose tokens must be those of their segments, or else no text is cut.
PROBES = ("two words", "line\none  more\n\n last.\t tab", " lead and trail ", "don't 'll 12 3.5% (x) été 世界   … end", "a\r\nb", "\n")
ADDED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Pair:
    """Both tokenizers, with the bytes of every entry."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in byte_letters().items()}
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(META, " ").encode()

    def ids_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """B adds a space: a segment's own is left to it, and one without gets a word in front."""
        spaced = [len(s) > 1 and s[0] == " " for s in segments]
        off = len(self.b.encode(GUARD))
        given = self.b.encode([s[1:] if own else GUARD + s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        return [ids if own else ids[off:] for ids, own in zip(given, spaced, strict=True)]

    def cut_characters(self) -> str:
        """White space before which both vocabularies part, wherever it follows a character of another kind."""
        crossing = set()
        for entry in [*self.bytes_a.values(), *self.bytes_b]:
            try:
                crossing |= set(re.findall(rf"[!-~\w]([{SPACES}])", entry.decode()))
            except UnicodeDecodeError:  # a part of a character may be that of a letter
                crossing |= {chr(y) for x, y in zip(entry, entry[1:]) if chr(y) in SPACES and chr(x) not in SPACES}
        cut = "".join(c for c in SPACES if c not in crossing)
        if " " not in cut:
            return ""
        for text in PROBES:
            parts = segments(" " + text, cut)
            if sum(self.ids_a(parts), []) != self.ids_a([" " + text])[0] or sum(self.ids_b(parts), []) != self.b.encode(text):
                return ""
        return cut


_pairs: dict[tuple[str, str], Pair] = {}


def pair_for(path_a: str, path_b: str) -> Pair:
    """One pair a process."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def segments(text: str, cut: str) -> list[str]:
    """The text cut before runs of the characters of cut, where what stands before is no white space for certain."""
    if not cut:
        return [text]
    # the compiled patterns are kept by re itself
    own = re.escape(cut)
    parts = re.findall(f"[{own}]*[^{own}]+|[{own}]+", text)
    if re.search(rf"[^!-~\w{own}][{own}]", text):
        joined = parts[:1]
        for part in parts[1:]:
            if re.match(r"[!-~\w]", joined[-1][-1]):
                joined.append(part)
            else:
                joined[-1] += part
        parts = joined
    return parts


def aligned(pair: Pair, parts: list[str]) -> list[tuple]:
    """Of each segment (ok, n_a, n_b, groups, linked ids of A, linked ids of B)."""
    out = []
    bytes_a, bytes_b = pair.bytes_a, pair.bytes_b
    for part, ids_a, ids_b in zip(parts, pair.ids_a(parts), pair.ids_b(parts), strict=True):
        own, tokens_a, tokens_b = part.encode(), [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
        if b"".join(tokens_a) != own or b"".join(tokens_b) != own:
            out.append((False, 0, 0, "", [], []))
            continue
        groups, linked_a, linked_b, i, j, from_i, from_j, end_a, end_b = [], [], [], 0, 0, 0, 0, 0, 0
        while i < len(ids_a):
            if end_a <= end_b:
                end_a += len(tokens_a[i])
                i += 1
            while end_b < end_a:
                end_b += len(tokens_b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, ids_a[from_i:i])) + "|" + ",".join(map(str, ids_b[from_j:j])))
                linked_a.append(ids_a[i - 1])
                linked_b.append(ids_b[j - 1])
                from_i, from_j = i, j
        out.append((True, len(ids_a), len(ids_b), ";".join(groups), linked_a, linked_b))
    return out


def pack(batches: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed binary value, so that shuffles move a few large rows in place of many small ones."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _blocks(block_bytes: int):
    """Rows (doc_id, text) as blocks (block, rows), in the order of a task's rows."""

    def out(block, held):
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([pack(held)], pa.binary())], ["block", "rows"])

    def run(batches):
        block, size, held = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            start = 0
            for i, x in enumerate(batch.column(1)):
                n = len(x.as_buffer()) if x.is_valid else 0
                if size and size + n > block_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield out(block, held)
                    block, size, held, start = block + 1, 0, [], i
                size += n
            held.append(batch.slice(start))
        if held:
            yield out(block, held)

    return run


def _packed(batches):
    """Rows sorted by block, their first column, as (block, rows)."""
    now, held = None, []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > a:
                if held and int(blocks[a]) != now:
                    yield pa.record_batch([pa.array([now], pa.int64()), pa.array([pack(held)], pa.binary())], ["block", "rows"])
                    held = []
                now = int(blocks[a])
                held.append(batch.slice(a, z - a).select(batch.schema.names[1:]))
    if held:
        yield pa.record_batch([pa.array([now], pa.int64()), pa.array([pack(held)], pa.binary())], ["block", "rows"])


def _occurrences(cut: str):
    """(block, segment, n): how often a block has each of its segments."""

    def run(batches):
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter()
                for text in unpack(rows).column("text").to_pylist():
                    if text:
                        counts.update(segments(" " + text, cut))
                if counts:
                    yield pa.record_batch([pa.array([block] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["block", "segment", "n"])

    return run


def _align(path_a: str, path_b: str):
    def run(batches):
        pair = pair_for(path_a, path_b)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = batch.slice(i, 1024)
                found = list(zip(*aligned(pair, rows.column(0).to_pylist()), strict=True))
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.record_batch([*rows.columns, *(pa.array(list(c), k) for c, k in zip(found, kinds, strict=True))], ["segment", "n", "ok", "n_a", "n_b", "groups", "linked_a", "linked_b"])

    return run


def _taken_off(cut: str):
    """Rows (block, kind, rows), a block's bad segments (kind 0) before its documents: (segment, n) of documents that have a bad one."""

    def run(batches):
        now, bad = None, set()
        for batch in batches:
            for block, kind, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    now, bad = block, set()
                if kind == 0:
                    bad.update(unpack(rows).column("segment").to_pylist())
                    continue
                off = Counter()
                for text in unpack(rows).column("text").to_pylist():
                    own = segments(" " + text, cut) if text else []
                    if not bad.isdisjoint(own):
                        off.update(own)
                if off:
                    yield pa.record_batch([pa.array(list(off), pa.string()), pa.array([-n for n in off.values()], pa.int64())], ["segment", "n"])

    return run


def _compose(cut: str):
    """Rows (block, kind, rows): what is known of a block's segments (kind 0) before its documents (kind 1); gives a row a document."""
    fields = ("n_a", "n_b", "n_links", "n_best", "count_sum")

    def composed(known: list[pa.Table], rows: pa.Table):
        known = pa.concat_tables(known) if known else pa.table({n: [] for n in ("segment", "ok", "groups", *fields)})
        place = {s: i for i, s in enumerate(known.column("segment").to_pylist())}
        texts, ok = known.column("groups").to_pylist(), known.column("ok").to_numpy()
        numbers = np.array([known.column(f).to_numpy() for f in fields], np.int64)
        for batch in rows.to_batches(max_chunksize=1024):
            sums, groups = [], []
            for text in batch.column(1).to_pylist():
                own = list(map(place.__getitem__, segments(" " + text, cut))) if text else []
                at = np.array(own, np.int64)
                if own and not ok[at].all():
                    own, at = [], at[:0]
                sums.append(numbers[:, at].sum(axis=1))
                groups.append(";".join(operator.itemgetter(*own)(texts)) if len(own) > 1 else texts[own[0]] if own else "")
            n_a, n_b, n_links, n_best, count_sum = (pa.array(c) for c in np.array(sums, np.int64).T)
            # each group ends where one token of either side does
            yield pa.record_batch([batch.column(0), n_a, n_b, n_links, n_links, n_best, count_sum, pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    def run(batches):
        now, known = None, []
        for batch in batches:
            for block, kind, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    now, known = block, []
                if kind == 0:
                    known.append(unpack(rows))
                else:
                    yield from composed(known, unpack(rows))

    return run


def _counted(done: DataFrame, store: Store) -> DataFrame:
    """Segments of done with n_best and count_sum, from the corpus-wide counts of their linked pairs."""
    links = done.where("ok and n > 0").select("sid", "n", F.explode(F.arrays_zip("linked_a", "linked_b")).alias("l")).select("sid", "n", F.col("l.linked_a").alias("a"), F.col("l.linked_b").alias("b"))
    pairs = store.put(links.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("links")), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    pairs = store.put(pairs.join(most, "b").select("a", "b", "count", "links", (F.col("count") == F.col("most")).alias("best")), "best")
    total = pairs.agg(F.sum("links")).first()[0] or 0
    often = F.col("links") * 1000 > total
    hot, cold = (pairs.where(x).select("a", "b", "count", "best") for x in (often, ~often))
    looked = links.select("sid", "a", "b").join(F.broadcast(hot), ["a", "b"], "left")  # fewer than 1,000 rows
    rest = looked.where("count is null").select("sid", "a", "b").join(cold, ["a", "b"])
    known = looked.where("count is not null").unionByName(rest)
    sums = store.put(known.groupBy("sid").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum")), "sums")
    return done.join(sums, "sid", "left")


def _with_rows(first: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(block, kind, rows): the rows of first (kind 0) before the documents of their block."""
    both = first.select("block", F.lit(0).alias("kind"), "rows").unionByName(blocks.select("block", F.lit(1).alias("kind"), "rows"))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, block_bytes: int = 16 << 20) -> DataFrame:
    """A row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    tokenizer_a: the file of a byte-level BPE of tokenizers; tokenizer_b: a sentencepiece model. groups: the groups of tokens between
    common byte ends, as a1,a2|b1;a3|b2,b3. A link is a pair of tokens that end together; its count is how often the pair of ids is
    linked in the corpus; n_best: links whose count is the highest of their B id; count_sum: the sum of counts over links.
    """
    spark = docs.sparkSession
    store, n = Store(spark, "alignment"), partitions(docs.sparkSession)
    cut = pair_for(tokenizer_a, tokenizer_b).cut_characters()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = store.put(source.mapInArrow(_blocks(block_bytes), "block long, rows binary"), "blocks")
    seen = store.put(blocks.mapInArrow(_occurrences(cut), "block long, segment string, n long"), "seen")
    distinct = seen.groupBy("segment").agg(F.sum("n").alias("n"))
    done = distinct.mapInArrow(_align(tokenizer_a, tokenizer_b), "segment string, n long, ok boolean, n_a long, n_b long, groups string, linked_a array<int>, linked_b array<int>")
    done = store.put(done.withColumn("sid", F.monotonically_increasing_id()), "done")
    bad = done.where("not ok").select("segment")
    if bad.head(1):
        held = seen.join(bad, "segment").select("block", "segment").sortWithinPartitions("block")
        held = store.put(held.mapInArrow(_packed, "block long, rows binary"), "bad")
        theirs = blocks.join(held.select("block").distinct(), "block", "left_semi")
        off = _with_rows(held, theirs, n).mapInArrow(_taken_off(cut), "segment string, n long")
        off = store.put(off.groupBy("segment").agg(F.sum("n").alias("off")), "off")
        done = store.put(done.join(off, "segment", "left").withColumn("n", F.col("n") + F.coalesce("off", F.lit(0))).drop("off"), "settled")
        store.drop("bad", "off", "done")
    known = _counted(done, store)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")}
    known = store.put(known.select("segment", "ok", "n_a", "n_b", F.size("linked_a").cast("long").alias("n_links"), "groups", *zero.values()), "known")
    store.drop("done", "settled", "pairs", "best", "sums")
    lookup = seen.select("block", "segment").join(known, "segment").select("block", *known.columns).sortWithinPartitions("block")
    lookup = store.put(lookup.mapInArrow(_packed, "block long, rows binary"), "lookup")
    store.drop("seen", "known")
    return _with_rows(lookup, blocks, n).mapInArrow(_compose(cut), f"doc_id long, {ADDED}")
