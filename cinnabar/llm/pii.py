"""Personal data: base patterns, and what bootstrapped contextual patterns add to them.

Base matches are the seeds. Candidates are what no base match covers: numbers of several groups,
which may stand apart, addresses with an @ or (at), and other tokens with digits. Each has the kinds
whose loose form it fits, or none. Around candidates and base matches stand lexical patterns: the
word before, the word after, and both. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the share of its instances that are believed (smoothed), an instance as good
as its patterns together make it. Patterns over the threshold discover candidates of their kind,
however these are written, if they fit its loose form; tokens that fit none only count against
patterns; base matches always stay. All of this works on counts, never on pairs of instances.

Defined cases: null and empty texts have no spans; repeated rows are documents of their own; rows
without doc_id take part; an empty table gives no rows; of overlapping added spans the most
believed stays, then the longest, and none overlaps a base span of its kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .text import chunks

KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits never finds more than the run's start, so runs are looked at once
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile("[0-9@]")
PART = re.compile(r"[^\s,;:!?\"'|<>]+")
WORD = re.compile(r"\S+")
NEAR = 64
#: Loose forms. A number is digits with up to three separators between them; it is taken whole, so runs are looked at once.
BETWEEN = r"[ \t\u00a0.()\[\]/_\u00b7\u2010-\u2015-]"
NUMBER = re.compile(rf"(?<![\w@.\-/+])(?:\(?\+|\()?[0-9](?:{BETWEEN}{{0,3}}[0-9])*+")
PIECE = re.compile(r"\S*[0-9]")
DOTTED = re.compile(r"[0-9]{1,6}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,6}){3}")
COLONS = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*(?:::|[A-Fa-f]))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![\w:])")
GROUPED = re.compile(r"[0-9]+(?:[ \t\u00a0./_\u00b7\u2010-\u2015-][0-9]+)*")
AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]| at (?=[\w-]+ dot [\w-])", re.I)
HOST = re.compile(r"\s?([\w-]++(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?| dot )[\w-]++)*+)", re.I)
LONGEST = 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the local part before each @ that a domain follows, cut where the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at >= last else None
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL_PART:
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                last = domain.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order; code points, end exclusive."""
    ips = [m.span() for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))] if "." in text else []
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


def fits(text: str) -> int:
    """The kinds, as bits by their place in KINDS, whose loose form a number has."""
    n = sum(c.isdigit() for c in text)
    card = 12 <= n <= LONGEST and GROUPED.fullmatch(text)
    return 2 * bool(DOTTED.fullmatch(text)) + 4 * bool(card) + 8 * (7 <= n <= 18)


def _numbers(text: str, free) -> list[tuple[int, int]]:
    """Spans of numbers: whole runs of groups, or of what is too long each group and what starts or ends the run."""
    out = []
    for m in NUMBER.finditer(text):
        runs, end = [[]], m.end()
        for p in PIECE.finditer(text, m.start(), end):
            # a word or host that goes on isn't part of the number
            if not free(*p.span()) or (p.end() == end and re.match(r"\w|[@/+-]\w|\.[^\W\d]", text[end : end + 2])):
                runs.append([])
            else:
                runs[-1].append((p.start(), p.end(), sum(c.isdigit() for c in p[0])))
        for own in filter(None, runs):
            if sum(n for *_, n in own) <= LONGEST:
                spans = {(own[0][0], own[-1][1])}
            else:
                spans = {(a, b) for a, b, _ in own}
                for line, first in ((own, True), (own[::-1], False)):
                    total = 0
                    for a, b, n in line:
                        total += n
                        if total > LONGEST:
                            break
                        spans.add((own[0][0], b) if first else (a, own[-1][1]))
            for a, b in sorted(spans):
                a += text[a] == "(" and ")" not in text[a:b]
                out.append((a, b))
    return out


def _addresses(text: str, free) -> list[tuple[int, int]]:
    """Spans of addresses: what stands before and after each @ or (at)."""
    out, last = [], 0
    for m in AT.finditer(text):
        host, end = HOST.match(text, m.end()), m.start()
        if end > last and text[end - 1] == " ":
            end -= 1
        start = end
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if host and start < end and free(start, host.end()):
            out.append((start, host.end()))
            last = host.end()
    return out


def _candidates(text: str, base: dict[str, list[tuple[int, int]]]):
    """(start, end, kind or None, bits of fitting kinds) of base spans and of candidates that overlap none, in order."""
    taken = sorted((a, b) for own in base.values() for a, b in own)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = [(a, b, k, 0) for k, own in base.items() for a, b in own]

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or ends[i - 1] <= a

    found = dict.fromkeys(_addresses(text, free), 1)
    for a, b in _numbers(text, free):
        if kinds := fits(text[a:b]):
            found[a, b] = kinds
    for m in COLONS.finditer(text) if ":" in text else ():
        if free(*m.span()):
            found[m.span()] = 2
    covered = sorted(found)
    i = last = reach = 0
    while m := MARK.search(text, last):
        a, b = m.start(), PART.match(text, m.start()).end()
        while a > last and PART.match(text[a - 1]):
            a -= 1
        last = b
        while b > a and text[b - 1] in ".)":
            b -= 1
        while b > a and text[a] in ".(":
            a += 1
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if b - a >= 6 and reach <= a and free(a, b):
            found[a, b] = 0
    return sorted([*out, *((a, b, None, kinds) for (a, b), kinds in found.items())], key=lambda x: x[:2])


class Context:
    """The words of a text; of what has no white space for longer than NEAR characters, the NEAR nearest count as the word."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def patterns(self, a: int, b: int) -> list[str]:
        """The word before, the word after, and both."""
        i, j = bisect_left(self.starts, a) - 1, bisect_right(self.ends, b)
        left = self.text[max(self.starts[i], a - NEAR) : min(self.ends[i], a)].lower() if i >= 0 else "^"
        right = self.text[max(self.starts[j], b) : min(self.ends[j], b + NEAR)].lower() if j < len(self.ends) else "$"
        return [f"l\t{left}", f"r\t{right}", f"b\t{left}\t{right}"]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("kinds", pa.int32()), ("patterns", pa.list_(pa.int64()))]))
ADDED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:long,end:long,instance:long,kinds:int,patterns:array<long>>>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _find(batches):
    for batch, texts in chunks(batches):
        rows = []
        for raw in texts:
            text = raw.decode()
            base, context = base_spans(text), None
            if MARK.search(text) or AT.search(text) or ":" in text:
                context = Context(text)
            found = [{"kind": k, "start": a, "end": b, "instance": _hash(text[a:b].lower()), "kinds": kinds, "patterns": [_hash(p) for p in context.patterns(a, b)]} for a, b, k, kinds in _candidates(text, base)] if context else []
            rows.append(found)
        yield pa.record_batch([batch.column(0), pa.array(rows, SPAN)], ["doc_id", "found"])


def _apart(batches):
    """Rows (row, added): of overlapping spans that believed most, then the longest, then the first."""
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            kept: list[tuple[int, int, dict]] = []
            for s in sorted(spans, key=lambda s: (-round(s["belief"], 9), s["start"] - s["end"], s["start"])):
                i = bisect_left(kept, (s["start"],))
                if (not i or kept[i - 1][1] <= s["start"]) and (i == len(kept) or kept[i][0] >= s["end"]):
                    kept.insert(i, (s["start"], s["end"], {k: s[k] for k in ("kind", "start", "end")}))
            out.append(sorted((s for *_, s in kept), key=lambda s: tuple(s.values())))
        yield pa.record_batch([batch.column(0), pa.array(out, ADDED)], ["row", "added"])


def bootstrap(found: DataFrame, store: Store, rounds: int, threshold: float, least_seeds: int) -> DataFrame:
    """(instance, kind, belief) of candidates that patterns over the threshold discover. found: rows of spans.

    The graph is kept as counts of (pattern, instance, kind); each round is two aggregations.
    """
    one = found.select(F.explode("found").alias("s")).select("s.kind", "s.instance", "s.kinds", F.explode("s.patterns").alias("pattern"))
    edges = store.put(one.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("kinds").alias("kinds")), "edges")
    # patterns that never meet a seed can't induce anything, nor can candidates of such patterns alone
    seeded = store.put(edges.where("kind is not null").groupBy("pattern").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= least_seeds).select("pattern"), "seeded")
    edges = store.put(edges.join(seeded, "pattern"), "live")
    bit = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(1 << i))])[F.col("kind")]
    known = store.put(edges.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"), F.lit(True).alias("seed")), "belief-0")
    for i in range(rounds):
        # an instance is counted once a pattern; unknown ones count against every kind
        sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("all"))
        believed = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("b"))
        strength = store.put(believed.join(sizes, "pattern").select("pattern", "kind", (F.col("b") / (F.col("all") + 1)).alias("strength")), f"strength-{i}")
        good = strength.where(F.col("strength") >= threshold)
        reached = edges.where("kind is null and kinds > 0").select("pattern", "instance", "kinds").join(good, "pattern").where(F.col("kinds").bitwiseAND(bit) > 0).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("strength"), F.lit(1e-6)))))).alias("belief"))
        best = reached.groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("m")).select("instance", "m.kind", "m.belief", F.lit(False).alias("seed"))
        seeds = edges.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"), F.lit(True).alias("seed"))
        known = store.put(seeds.unionByName(best.join(seeds.select("instance").distinct(), "instance", "left_anti")), f"belief-{i + 1}")
    # a discovery's belief may round to 1.0 as well
    return store.put(known.where(~F.col("seed") & (F.col("belief") >= threshold)).select("instance", "kind", "belief"), "discovered")


def personal_data(docs: DataFrame, rounds: int = 2, threshold: float = 0.7, least_seeds: int = 3) -> DataFrame:
    """A row per row of docs: doc_id, base and added, arrays of (kind, start, end)."""
    store = Store(docs.sparkSession, "pii")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, f"doc_id long, found {SPANS}")
    found = store.put(found.withColumn("row", F.monotonically_increasing_id()), "found")
    discovered = bootstrap(found, store, rounds, threshold, least_seeds)
    new = found.select("row", F.explode(F.filter("found", lambda s: s.kind.isNull())).alias("s")).select("row", "s.instance", "s.start", "s.end").join(discovered, "instance")
    new = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "belief")).alias("added"))
    new = store.put(new.mapInArrow(_apart, "row long, added array<struct<kind:string,start:long,end:long>>"), "added")
    base = F.transform(F.filter("found", lambda s: s.kind.isNotNull()), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return found.join(new, "row", "left").select("doc_id", base.alias("base"), F.coalesce("added", none).alias("added"))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of an array of spans, by kind as listed, then start, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s.kind].alias("k"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
