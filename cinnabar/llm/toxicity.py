"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first five bytes, which stand for inflected forms. Labels are fitted on a bounded
sample of labelled rows (at most ``train_rows`` rows of ``train_bytes`` bytes, the smallest hashes of doc_id; texts of more than a
sixteenth of those bytes are passed over, so that no long text ends the sample); a fifth
of it calibrates, and all other rows with all their terms stand in the index. A term weighs
(1 + log tf) * idf * (floor + association): document frequencies are counted over all documents, and the
association is how far the term's rows move the share of toxic ones (the divergence of the smoothed share from that of
all rows), so that telling terms decide and no term is left out. The inverted index is cut into blocks of examples
with each term's largest weight. A query adds up postings by falling largest contribution until the terms left can't
lift an unseen example among its k nearest; examples that the block bounds still allow are then scored in full, so the
neighbours are exact. Votes count with the square of the cosine, beside a small vote of the share of toxic examples;
isotonic regression on the calibration rows maps the votes' share to a probability.

Defined cases: null and empty texts, and texts without any term of the index, get that share as votes; labels without
doc_id or toxic are no examples, of repeated labels of a document the largest counts; without examples of both labels
the score is their share (0 without any); if all labelled texts are too long for the sample, it is the share of their labels;
very long texts are scored whole; rows without doc_id are scored and not held out; columns of the input
named like the added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, partitions
from .text import ALNUM, chunks, distinct, join_texts, mix, powers, words

ADDED = "score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
PREFIX = 5
BLOCK = 64
SLICES = 32
#: A labelled text of more than this part of the sample's bytes is no example.
LONG = 16


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and the text of each."""
    data, offsets = join_texts([t.lower() for t in texts])
    hashes, starts, lengths, first = words(data, offsets, ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.flatnonzero(lengths > PREFIX)
    sums = np.zeros(len(at), np.uint64)
    for i in range(PREFIX):
        sums += (data[starts[at] + i].astype(np.uint64) + np.uint64(1)) * powers(PREFIX)[i]
    return np.concatenate((hashes, mix(sums + np.uint64(PREFIX)))), np.concatenate((owner, owner[at]))


def counted(texts: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, how often) of the known terms, sorted by text and number; known: sorted hashes."""
    hashes, owners = terms(texts)
    if not len(known) or not len(hashes):
        return (np.zeros(0, np.int64),) * 3
    values, number = np.unique(hashes, return_inverse=True)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    place[known[place] != values] = -1
    place = place[number]
    good = place >= 0
    keys, tf = np.unique(owners[good] * len(known) + place[good], return_counts=True)
    return keys // len(known), keys % len(known), tf


def _vocabulary(batches):
    """Per task the distinct terms of its texts."""
    held: list[np.ndarray] = []
    for _, texts in chunks(batches):
        held.append(distinct(terms(texts)[0]))
        if sum(map(len, held)) > 4_000_000:
            held = [distinct(np.concatenate(held))]
    if held:
        yield pa.record_batch([pa.array(distinct(np.concatenate(held)).view(np.int64))], ["term"])


def _frequencies(shared):
    """Per task, in how many texts each known term is: compressed slices of counts, and how many texts as slice -1."""

    def run(batches):
        known = shared.value
        counts, n = np.zeros(len(known), "<u4"), 0
        for _, texts in chunks(batches, limit=1 << 20):
            n += len(texts)
            _, number, _ = counted(texts, known)
            counts += np.bincount(number, minlength=len(known)).astype("<u4")
        parts = [zlib.compress(x.tobytes(), 1) for x in np.array_split(counts, SLICES)]
        yield pa.record_batch([pa.array([-1, *range(SLICES)], pa.int32()), pa.array([n, *[0] * SLICES], pa.int64()), pa.array([b"", *parts], pa.binary())], ["slice", "texts", "counts"])

    return run


def _added(batches):
    """Sums of the counts of each slice; rows sorted by slice."""
    now, texts, counts = None, 0, None

    def out():
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([texts], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["slice", "texts", "counts"])

    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(zlib.decompress(row["counts"]) if row["counts"] else b"", "<u4").astype("<i8")
            if row["slice"] != now:
                if now is not None:
                    yield out()
                now, texts, counts = row["slice"], row["texts"], own
            else:
                texts, counts = texts + row["texts"], counts + own
    if now is not None:
        yield out()


def frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of docs each term is, and how many docs there are."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    parts = docs.select("text").mapInArrow(_frequencies(shared), "slice int, texts long, counts binary")
    rows = parts.repartition(min(SLICES, partitions(spark)), "slice").sortWithinPartitions("slice").mapInArrow(_added, "slice int, texts long, counts binary").collect()
    by = {r["slice"]: r for r in rows}
    if not by:
        return np.zeros(len(known), np.int64), 0
    return np.concatenate([np.frombuffer(by[i]["counts"], "<i8") for i in range(SLICES)]), by[-1]["texts"]


def association(n: np.ndarray, toxic: np.ndarray, share: float, smooth: float) -> np.ndarray:
    """Divergence of the smoothed share of toxic rows with a term from that of all rows; n: rows with it, toxic: those of them."""
    p = (toxic + smooth * share) / (n + smooth)
    return p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from lo with n numbers, one range after the other."""
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


class Index:
    """Block-max inverted index over example vectors."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, doc: np.ndarray, number: np.ndarray, tf: np.ndarray, prior: float, k: int = 16, prior_votes: float = 0.25):
        """known: sorted term hashes with their weights; ids, labels: examples; (doc, number, tf) of their terms; prior: the share of toxic ones."""
        self.known, self.weights, self.prior, self.k, self.prior_votes = known, weights, prior, k, prior_votes
        n, doc, number = len(ids), doc.astype(np.int32), number.astype(np.int32)
        weight = unit(doc, number, tf, weights, n).astype(np.float32)
        # like beside like, for tight bounds: by the example's heaviest term
        top = np.zeros(n, np.int64)
        order = np.lexsort((weight, doc))
        top[doc[order]] = number[order]
        old = np.lexsort((ids, top))
        new = np.empty(n, np.int32)
        new[old] = np.arange(n, dtype=np.int32)
        self.ids, self.labels, doc = ids[old], labels[old], new[doc]
        order = np.lexsort((number, doc))
        self.first = np.searchsorted(doc[order], np.arange(n + 1))
        self.number, self.weight = number[order], weight[order]
        order = np.lexsort((doc, number))
        number, self.doc, self.posting = number[order], doc[order], weight[order]
        del order, doc, weight
        self.start = np.searchsorted(number, np.arange(len(known) + 1))
        # the largest weight of each term in each block of examples, and in all
        block = number.astype(np.int64) * (n // BLOCK + 1) + self.doc // BLOCK
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(block)), bool), block[1:] != block[:-1])))
        self.block = (block[starts] % (n // BLOCK + 1)).astype(np.int32)
        self.block_most = np.maximum.reduceat(self.posting, starts) if len(starts) else self.posting
        self.block_start = np.searchsorted(block[starts] // (n // BLOCK + 1), np.arange(len(known) + 1))
        self.most = np.zeros(len(known), np.float32)
        np.maximum.at(self.most, number, self.posting)
        self.seen: dict[bytes, tuple] = {}
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def nearest(self, number: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0, by falling cosine, then place in the index."""
        n = len(self.ids)
        if not len(number) or not n:
            return np.zeros(0, np.int64), np.zeros(0)
        reach = weight * self.most[number]
        order = np.argsort(-reach, kind="stable")
        number, weight = number[order], weight[order]
        left = np.append(np.cumsum(reach[order][::-1])[::-1], 0.0)  # what terms from here on can add at most
        lists = self.start[number + 1] - self.start[number]
        work = np.cumsum(lists)
        sums, kth, at, step = np.zeros(n), 0.0, 0, 8 * n

        def add(to: int) -> None:
            own = ranges(self.start[number[at:to]], lists[at:to])
            sums[:] += np.bincount(self.doc[own], self.posting[own] * np.repeat(weight[at:to], lists[at:to]), n)

        while at < len(number) and left[at] >= kth - 1e-6:
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + step, "right")))
            add(to)
            at = to
            if n > self.k:
                kth = np.partition(sums, -self.k)[-self.k]
        hit = np.flatnonzero(sums > 0)
        if at < len(number):
            hit = hit[sums[hit] + left[at] >= kth - 1e-6]
            rest = number[at:]
            blocks = self.block_start[rest + 1] - self.block_start[rest]
            own = ranges(self.block_start[rest], blocks)
            bound = np.bincount(self.block[own], self.block_most[own] * np.repeat(weight[at:], blocks), n // BLOCK + 1)
            hit = hit[sums[hit] + bound[hit // BLOCK] >= kth - 1e-6]
            sizes = self.first[hit + 1] - self.first[hit]
            if sizes.sum() > work[-1] - work[at - 1]:
                add(len(number))  # the postings left are fewer than the examples' own terms
            else:
                order = np.argsort(rest)
                table, value = rest[order], weight[at:][order]
                own = ranges(self.first[hit], sizes)
                place = np.minimum(np.searchsorted(table, self.number[own]), len(table) - 1)
                more = np.where(table[place] == self.number[own], value[place], 0.0) * self.weight[own]
                sums[hit] += np.bincount(np.repeat(np.arange(len(hit)), sizes), more, len(hit))
        order = np.lexsort((hit, -np.round(sums[hit], 7)))[: self.k]
        return hit[order], np.minimum(sums[hit[order]], 1.0)

    def votes(self, number: np.ndarray, weight: np.ndarray) -> tuple[float, list[dict]]:
        """The votes' share for toxic, and the three nearest examples."""
        key = number.tobytes() + weight.tobytes()
        if key not in self.seen:
            docs, near = self.nearest(number, weight)
            count = near**2
            value = (count @ self.labels[docs] + self.prior_votes * self.prior) / (count.sum() + self.prior_votes)
            found = [{"doc_id": int(self.ids[d]), "similarity": float(s), "toxic": int(self.labels[d])} for d, s in zip(docs[:3], near[:3], strict=True)]
            if len(self.seen) > 5_000:
                self.seen.clear()
            self.seen[key] = float(min(1, max(0, value))), found
        return self.seen[key]

    def score(self, texts: list[bytes]) -> list[tuple[float, list[dict]]]:
        """Of each text the calibrated probability, and the three nearest examples."""
        doc, number, tf = counted(texts, self.known)
        weight = unit(doc, number, tf, self.weights, len(texts))
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = [self.votes(number[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return own if self.knots is None else [(float(np.interp(v, *self.knots)), found) for v, found in own]

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fits the map from votes to probabilities: isotonic regression, its steps joined by lines."""
        if not len(votes) or toxic.all() or not toxic.any():
            return
        blocks: list[list[float]] = []  # rows, toxic rows, votes
        for v, t in sorted(zip(votes.tolist(), toxic.tolist(), strict=True)):
            blocks.append([1.0, float(t), v])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                a, b = blocks.pop(), blocks.pop()
                blocks.append([x + y for x, y in zip(a, b, strict=True)])
        # a row of the prior in each step keeps 0 and 1 out of reach of a few rows
        level = np.maximum.accumulate([(t + self.prior) / (n + 1) for n, t, _ in blocks])
        self.knots = np.array([v / n for n, _, v in blocks]), level


def unit(doc: np.ndarray, number: np.ndarray, tf: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(1 + log tf) * weight of the terms, of length 1 for each of n texts."""
    value = (1 + np.log(tf)) * weights[number]
    length = np.sqrt(np.bincount(doc, value * value, n))
    return value / np.where(length > 0, length, 1.0)[doc]


def _counts(shared):
    """Labelled rows with the numbers and counts of their terms."""

    def run(batches):
        known = shared.value
        for batch, texts in chunks(batches):
            doc, number, tf = counted(texts, known)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, pa.int32())) for x in (number, tf)]
            yield pa.record_batch([batch.column(0), batch.column(1), *lists], ["doc_id", "toxic", "number", "tf"])

    return run


def _scores(shared, schema: pa.Schema, names: list[str]):
    def run(batches):
        index = shared.value
        for batch, texts in chunks(batches):
            own = index.score(texts)
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            columns |= {"score": pa.array([s for s, _ in own], pa.float64()), "predicted": pa.array([int(s >= 0.5) for s, _ in own], pa.int32()), "evidence": pa.array([e for _, e in own], EVIDENCE)}
            yield pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """docs with what the index says of each text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(ADDED)
    docs = docs.drop(*added.names)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    out = StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(_scores(shared, to_arrow_schema(out), docs.columns), out)


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int, train_bytes: int, store: Store) -> tuple[DataFrame, float]:
    """Labelled rows that aren't held out, with their texts: those with the smallest hashes up to both bounds. And the share of toxic ones."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    sample = store.put(marked.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "sample")
    # at most train_rows pairs of numbers are broadcast
    train = store.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), "train")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = sorted(tuple(r) for r in train.select(F.xxhash64("doc_id"), size, "toxic").collect())  # three numbers a row, at most train_rows ids
    longest = train_bytes // LONG
    short = [r for r in rows if r[1] <= longest]
    within = int((np.cumsum([n for _, n, _ in short]) <= train_bytes).sum())
    if within < len(rows):
        train = train.where(size <= longest)
        if within < len(short):
            short = [r for r in short if r[0] < short[within][0]]  # rows of one doc_id are all in or all out
            last = short[-1][0] if short else -(2**63)
            train = train.where(F.xxhash64("doc_id") <= last)
    counted_ = short or rows
    return train, sum(t for *_, t in counted_) / max(1, len(counted_))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, train_bytes: int = 8 << 20, smooth: float = 8.0, floor: float = 0.02, k: int = 16, prior_votes: float = 0.25) -> Index:
    """The index of a bounded sample of labelled rows, of which every fifth doc_id (crc32) is held out.

    What comes to the driver is the sample's terms, so train_rows and train_bytes bound it.
    """
    spark = docs.sparkSession
    store = Store(spark, "toxicity")
    train, share = _sample(docs, labels, train_rows, train_bytes, store)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    fitted = train.where(~part)
    found = fitted.select("text").mapInArrow(_vocabulary, "term long").distinct().toArrow().column(0).to_numpy()
    known = np.sort(found.view(np.uint64))
    rows = fitted.mapInArrow(_counts(spark.sparkContext.broadcast(known)), "doc_id long, toxic int, number array<int>, tf array<int>").toArrow().combine_chunks()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    number, tf = (rows.column(c).combine_chunks() for c in ("number", "tf"))
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), number.value_lengths().to_numpy()) if len(ids) else np.zeros(0, np.int32)
    number, tf = (x.flatten().to_numpy() for x in (number, tf))
    del rows
    if 0 < share < 1:
        df, total = frequencies(docs, known)
        n, with_ = np.bincount(number, minlength=len(known)), np.bincount(number, toxic[doc], len(known))
        weights = np.log((1 + total) / (1 + np.minimum(df, total))) * (floor + association(n, with_, share, smooth))
        index = Index(known, weights, ids, toxic, doc, number, tf, share, k, prior_votes)
        held = scored(train.where(part), index).select("score", "toxic").collect()
        index.calibrate(np.array([r["score"] for r in held]), np.array([r["toxic"] for r in held], dtype=bool))
    else:
        none = np.zeros(0, np.int64)
        index = Index(none.view(np.uint64), np.zeros(0), none, none, none, none, none, share, k, prior_votes)
    store.drop("train", "sample")
    return index


def held_out(column: str):
    """Whether the crc32 of the id as text is divisible by 5; false for a missing id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and evidence (the three nearest examples)."""
    return scored(docs, fit(docs, labels, **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that aren't predicted to be toxic, their columns unchanged."""
    return toxicity(docs, labels, **options).where("predicted = 0").select(*docs.columns)
