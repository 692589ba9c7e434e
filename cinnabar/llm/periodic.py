"""Runs of repeated phrases in texts, by suffix automata with small-to-large merging of end positions.

A run is a stretch of words with a smallest period q, at least ``min_exponent`` periods and ``min_length``
words long, that no neighbouring word extends. Each stretch of a text that may hold runs gets a suffix
automaton over its words. Going from long states to short ones, the ordered end positions of a state are
merged into those of its suffix link, the smaller set into the larger; each time two ends become neighbours
at a distance d that the state's length holds often enough (for squares: once), the text repeats with period d
there. Such seeds are extended to both sides as far as the period lasts; a stretch found with several
periods has the least of them. Every run is found: the ends of its longest repeated part are neighbours in the
state where they first meet, and that state is at least as long as the part.

Stretches: every three words of a run occur at least ``min_exponent`` - 1 times in it, so a text is cut where three
words occur less often, and the pieces again. This leaves nothing of most texts and loses no run. With fewer than four
periods whole texts are stretches.

Memory is that of one document: an automaton's states are arrays of numbers, with a dictionary only where a
state has several transitions; large sets of ends are kept in blocks, so that a text of one word repeated a million
times takes no longer for each end than others.

Defined cases: null and empty texts, and texts of white space only, have no words and no runs; rows are independent, so repeated
ids, ties and rows without doc_id are rows like others; columns of the input named like the added ones are replaced;
an empty table gives no rows. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_SPACE, chunks, join_texts, windows, words

ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
GRAM, ROUNDS, BLOCK = 3, 8, 1024


class Automaton:
    """Suffix automaton of a sequence of numbers; ``prefix`` has the state of each prefix."""

    def __init__(self, sequence: list[int]):
        self.length, self.link = array("q", [0]), array("q", [-1])
        self.word, self.to = array("q", [-1]), array("q", [-1])  # a state's first transition
        self.more: dict[int, dict[int, int]] = {}  # and its others
        self.prefix = array("q")
        last = 0
        for w in sequence:
            last = self._extend(last, w)
            self.prefix.append(last)

    def _state(self, length: int, link: int, word: int, to: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(word)
        self.to.append(to)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        new, p, q = self._state(length[last] + 1, 0, -1, -1), last, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            own = more.get(p)
            if own is not None and w in own:
                q = own[w]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            elif own is None:
                more[p] = {w: new}
            else:
                own[w] = new
            p = link[p]
        if q < 0:
            return new
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        twin = self._state(length[p] + 1, link[q], word[q], to[q])
        if q in more:
            more[twin] = dict(more[q])
        while p >= 0:
            if word[p] == w and to[p] == q:
                to[p] = twin
            elif p in more and more[p].get(w) == q:
                more[p][w] = twin
            else:
                break
            p = link[p]
        link[q] = link[new] = twin
        return new


class Ends:
    """An ordered set of positions in blocks."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Adds a new x; its neighbours, -1 where there is none."""
        blocks = self.blocks
        i = max(0, bisect_right(self.heads, x) - 1)
        block = blocks[i]
        j = bisect_right(block, x)
        before = block[j - 1] if j else -1
        after = block[j] if j < len(block) else blocks[i + 1][0] if i + 1 < len(blocks) else -1
        block.insert(j, x)
        self.heads[i] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks.insert(i + 1, block[half:])
            del block[half:]
            self.heads.insert(i + 1, blocks[i + 1][0])
        return before, after


def seeds(sequence: list[int], fits):
    """(end, distance) of neighbouring ends of a state; fits(distance, length) tells which are wanted."""
    made = Automaton(sequence)
    ends: dict[int, Ends] = {state: Ends(i) for i, state in enumerate(made.prefix)}
    for state in np.argsort(-np.frombuffer(made.length, np.int64), kind="stable")[:-1].tolist():  # the empty state comes last
        small, to = ends.pop(state), made.link[state]
        if not to:
            continue
        large = ends.get(to)
        if large is None:
            ends[to] = small
            continue
        if large.size < small.size:
            small, large = large, small
            ends[to] = large
        length = made.length[to]
        for x in small:
            before, after = large.add(x)
            if before >= 0 and fits(x - before, length):
                yield x, x - before
            if after >= 0 and fits(after - x, length):
                yield after, after - x


def _reach(own: np.ndarray, at: int, d: int, step: int) -> int:
    """How many positions from at on, in direction step, have the same word as the position d further right."""
    n, size = 0, 64
    while True:
        lo, hi = (at + n, min(at + n + size, len(own) - d)) if step > 0 else (max(0, at - n - size + 1), at - n + 1)
        if lo >= hi:
            return n
        same = own[lo:hi] == own[lo + d : hi + d]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return n + int(np.argmin(same))
        n, size = n + len(same), 2 * size


def runs_of(own: np.ndarray, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of a sequence of hashes."""
    numbers = np.unique(own, return_inverse=True)[1]
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}

    def fits(d: int, length: int) -> bool:
        return d * (min_exponent - 1) <= length and d + length >= min_length

    for end, d in seeds(numbers.tolist(), fits):
        spans = known.setdefault(d, [])
        i = bisect_right(spans, (end, len(own)))
        # spans of one period overlap by less than it, so only the last ones that start before can hold the seed
        if any(a <= end - 2 * d + 1 and end < z for a, z in spans[max(0, i - 3) : i]):
            continue
        right = _reach(numbers, end - d + 1, d, 1)
        left = _reach(numbers, end - d, d, -1)
        span = (end - d - left + 1, end + right + 1)
        insort(spans, span)
        if span[1] - span[0] >= max(min_length, min_exponent * d):
            found[span] = min(d, found.get(span, d))
    return found


def stretches(hashes: np.ndarray, owner: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of the words of many texts (owner: the text of each word) that may hold runs."""
    need = min_exponent - 1 if min_length > min_exponent else min_exponent - 2
    least = max(min_length, min_exponent)
    if need < 2 or least < GRAM:
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
        return list(zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True))
    if len(hashes) < least:
        return []
    grams = windows(hashes, GRAM)
    inside = owner[: len(grams)] == owner[GRAM - 1 :]
    at = np.flatnonzero(inside)
    piece = owner[at]
    for _ in range(ROUNDS):
        if not len(at):
            break
        order = np.lexsort((grams[at], piece))
        g, p = grams[at][order], piece[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))
        number = np.cumsum(new) - 1
        often = np.empty(len(at), bool)
        often[order] = (np.bincount(number) >= need)[number]
        at, before = at[often], len(at)
        if not len(at):
            break
        piece = np.cumsum(np.concatenate(([True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))))
        long = (np.bincount(piece) >= least - GRAM + 1)[piece]
        at, piece = at[long], piece[long]
        if len(at) == before:
            break
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
    first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
    return [(a, z) for a, z in zip(first.tolist(), (last + GRAM).tolist(), strict=True) if z - a >= least]


def runs_of_texts(texts: list[bytes], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Of each text its runs (start, length, period), by start, then period."""
    data, offsets = join_texts(texts)
    hashes, _, _, first = words(data, offsets, NOT_SPACE)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, z in stretches(hashes, owner, min_length, min_exponent):
        text = int(owner[a])
        shift = a - int(first[text])
        out[text] += [(s + shift, e - s, q) for (s, e), q in runs_of(hashes[a:z], min_length, min_exponent).items()]
    return [sorted(set(own), key=lambda r: (r[0], r[2])) for own in out]


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> tuple[int, str]:
    """How many words the text has, and those joined by one space that no run holds after its first period."""
    own = text.split()
    n = len(own)
    if runs:
        change = np.zeros(n + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        own = [w for w, covered in zip(own, np.cumsum(change)[:n].tolist(), strict=True) if not covered]
    return n, b" ".join(own).decode()


def _runs(schema: pa.Schema, names: list[str], min_length: int, min_exponent: int):
    def run(batches):
        for batch, texts in chunks(batches):
            found = runs_of_texts(texts, min_length, min_exponent)
            left = [collapse(t, own) for t, own in zip(texts, found, strict=True)]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            columns["n_words"] = pa.array([n for n, _ in left], pa.int64())
            columns["runs"] = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found], RUNS)
            columns["collapsed"] = pa.array([t for _, t in left], pa.string())
            yield pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """docs with n_words, runs (by start, then period) and collapsed, the text without the repetitions of runs.

    min_length: fewest words of a run; min_exponent: fewest periods of a run, at least 2.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has at least 2 periods and a word")
    added = _parse_datatype_string(ADDED)
    docs = docs.drop(*added.names)
    out = StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(_runs(to_arrow_schema(out), docs.columns, min_length, min_exponent), out)


def longest(runs: str = "runs") -> str:
    """SQL: the run with the greatest length / period, the first of equal ones; null without runs."""
    return f"aggregate({runs}, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of docs, by crc32 of the id, from a place on repeats what follows it; words joined by a space there."""
    w = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), x -> x <> '')"
    p = "1 + (size(w) - CAST(g % size(w) AS INT)) DIV CAST(3 + g % 8 AS INT)"
    a = "CAST(g % size(w) AS INT)"
    again = f"transform(array(named_struct('w', {w}, 'g', crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) DIV 10)), s -> transform(array(named_struct('w', s.w, 'a', {a.replace('g %', 's.g %').replace('size(w)', 'size(s.w)')}, 'p', {p.replace('g %', 's.g %').replace('size(w)', 'size(s.w)')})), r -> array_join(transform(r.w, (x, i) -> if(i < r.a, x, r.w[r.a + (i - r.a) % CAST(r.p AS INT)])), ' '))[0])[0]"
    chosen = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0 AND text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"
    return docs.select("doc_id", F.expr(f"if({chosen}, {again}, text)").alias("text"))
