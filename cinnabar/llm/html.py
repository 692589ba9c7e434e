"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Words score positive and tags negative. All weights are log-odds learned from labelled pages, those whose
markup names the article (``<article>`` or ``<main>``), of which a bounded sample is fitted on; the labels'
own tags weigh nothing, so pages without them are read by the same weights. An element is known by its tag
and by the words of its class, id and role. What the labels show beside the article (the largest elements that
hold none of it) against what they show within it says which elements are no article: menus, footers, adverts and
the like. Names that the sample lacks start from a small prior count, which a few labelled elements outweigh.
One linear scan over a page's tokens finds the contiguous region with the largest sum; elements that are no article
score nothing there, so none parts an article in two, and are left out of its text. Blocks that the region
covers for the most part are kept whole. Scripts, styles and forms are never text.

Defined cases: null, empty and tag-only pages have an empty text; tags without an end run to the
end of what holds them, comments and declarations without one to the end of the page; a page without any
positive region has no text; broken references stay as they are; rows are pages, so repeated rows repeat; an
empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .text import chunks

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<'\">]++)*+)>", re.S)
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
#: Never text, whatever the labels say.
FIXED = RAW | frozenset("form button select".split())
BLOCKS = frozenset("address article blockquote body br dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LABELS = frozenset(("article", "main"))
#: Names that are taken to be outside, or inside, as if PRIOR labelled elements had shown it.
OUTSIDE = frozenset("nav footer header aside menu dialog .ad .ads .advert .advertisement .banner .breadcrumb .comment .comments .complementary .consent .contentinfo .cookie .cookies .disclaimer .disqus .footer .masthead .menu .nav .navbar .navigation .newsletter .notice .popup .promo .promoted .related .search .share .sharing .sidebar .social .sponsor .sponsored .subscribe .toolbar .widget".split())
INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
PRIOR = 4.0
VALUES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def names(tag: str, attributes: str, within: bool) -> tuple[str, ...]:
    """What an element is known by: its tag, unless that is a label, and .word for the words of class, id and role.

    Headers and footers within an article or section are its own, and another name than the page's.
    """
    own = () if tag in LABELS else (tag + "@" if within and tag in ("header", "footer") else tag,)
    if not attributes:
        return own
    return own + tuple("." + w for v in VALUES.findall(attributes) for w in dict.fromkeys(re.split(r"[\s_-]+", "".join(v).lower())) if w)


def odds(name: str, inside: dict[str, int], outside: dict[str, int]) -> float:
    """Smoothed log-odds that an element of this name is inside; 0 for a name that nothing is known of."""
    return float(np.log(inside.get(name, 0) + 0.5 + PRIOR * (name in INSIDE)) - np.log(outside.get(name, 0) + 0.5 + PRIOR * (name in OUTSIDE)))


class Elements:
    """Which elements are no article, by the summed odds of their names."""

    def __init__(self, inside: dict[str, int], outside: dict[str, int]):
        self.odds = {n: odds(n, inside, outside) for n in {*inside, *outside, *INSIDE, *OUTSIDE}}

    def off(self, own: tuple[str, ...]) -> bool:
        return sum(self.odds.get(n, 0.0) for n in own) < -1e-9


def tokens(page: str, elements: Elements):
    """(kind, value, skipped, label) in page order: kind text or tag; skipped: inside what is no article; label: inside article or main."""
    for kind, value, _, skip, label, _ in _walk(page, elements):
        if kind != "end":
            yield kind, value, skip, label


def _walk(page: str, elements: Elements):
    """As tokens, with an element's names at its start tag, and (end, ...) once an element is closed; the last item numbers open elements."""
    open_: list[tuple[str, bool, bool, bool]] = []
    held: Counter = Counter()
    at = skip = label = sections = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], (), skip > 0, label > 0, len(open_)
            break
        if m.start() > at:
            yield "text", page[at : m.start()], (), skip > 0, label > 0, len(open_)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "tag", "/" + tag, (), skip > 0, label > 0, len(open_)
            if held[tag]:
                while open_:
                    own, bad, good, section = open_.pop()
                    held[own] -= 1
                    skip, label, sections = skip - bad, label - good, sections - section
                    yield "end", own, (), skip > 0, label > 0, len(open_)
                    if own == tag:
                        break
            continue
        known = names(tag, m[3], sections > 0)
        bad = tag in FIXED or (tag not in ("html", "body") and elements.off(known))
        good = tag in LABELS and not bad
        section = tag in LABELS or tag == "section"
        yield "tag", tag, known, skip > 0 or bad, label > 0 or good, len(open_)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append((tag, bad, good, section))
            held[tag] += 1
            skip, label, sections = skip + bad, label + good, sections + section
    while open_:
        own, *_ = open_.pop()
        yield "end", own, (), False, False, len(open_)


def count_elements(page: str, elements: Elements, inside: Counter, outside: Counter) -> None:
    """Adds a labelled page's elements: those within the article, and the largest that hold none of it.

    What lies within the latter is explained by them and says nothing of its own, and the words of an element
    explain it before its tag does.
    """

    def shown(known: tuple[str, ...]) -> list[str]:
        return [n for n in known if n[0] == "."] or list(known)

    # of each open element whether a label is inside, its names, and those of its closed children without label
    stack: list[list] = [[False, (), []]]
    for kind, value, known, _, label, depth in _walk(page, elements):
        if kind == "tag" and known and not value.startswith("/"):
            if label:
                inside.update(shown(known))
            if value in VOID or value in RAW:
                continue
            while len(stack) > depth + 1:
                stack.pop()
            stack.append([label, known, []])
        elif kind == "tag" and value in LABELS:
            while len(stack) > depth + 1:
                stack.pop()
            stack.append([label, (), []])
        elif kind == "end" and len(stack) > depth + 1:
            has, known, children = stack.pop()
            if has:
                stack[-1][0] = True
                for own in children:
                    outside.update(shown(own))
            elif not label:
                stack[-1][2].append(known)
    has, _, children = stack[0]
    if has:
        for own in children:
            outside.update(shown(own))


def _state(kind: str, value: str) -> str:
    """What a weight of the scan is learned for: a word in running text, or a tag."""
    return "word" if kind == "text" else f"<{value}>"


def count(page: str, elements: Elements, inside: Counter, outside: Counter) -> None:
    """Adds a labelled page's tokens to the counts, but for those of elements that are no article; words of a text count each."""
    for kind, value, skipped, label in tokens(page, elements):
        n = 0 if skipped else len(value.split()) if kind == "text" else 1
        if n:
            (inside if label else outside)[_state(kind, value)] += n


def weigh(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Smoothed log-odds; words never below a small gain, tags never above a small loss."""
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    out = {}
    for state in {*inside, *outside, "word"}:
        own = float(np.log((inside.get(state, 0) + 0.5) / a) - np.log((outside.get(state, 0) + 0.5) / b))
        out[state] = max(0.5, own) if state == "word" else min(-0.1, own)
    return out


class Weights:
    """What is learned: elements that are no article, and the scan's weights."""

    def __init__(self, elements: Elements, scan: dict[str, float]):
        self.elements, self.scan = elements, scan


def learned(pages: list[str]) -> Weights:
    """Weights of a few labelled pages, without Spark."""
    a, b, c, d = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        count_elements(page, Elements({}, {}), a, b)
    elements = Elements(a, b)
    for page in pages:
        count(page, elements, c, d)
    return Weights(elements, weigh(c, d))


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the largest sum; (0, 0) if none is positive. The first of equals."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, start, end = total, first, i + 1
    return start, end


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region, joined by line feeds."""
    whole = list(tokens(page, weights.elements))
    scores = []
    for kind, value, skipped, _ in whole:
        n = len(value.split()) if kind == "text" else 1
        # what is left out anyway never parts an article in two
        scores.append(0.0 if skipped else n * weights.scan.get(_state(kind, value), -0.1))
    start, end = region(scores)
    if end <= start:
        return ""
    blocks: list[list[tuple[str, bool]]] = [[]]
    for i, (kind, value, skipped, _) in enumerate(whole):
        if kind == "text":
            if not skipped:
                blocks[-1].append((value, start <= i < end))
        elif value.lstrip("/") in BLOCKS:
            blocks.append([])
    out = []
    for own in blocks:
        # a block belongs to the region if most of its characters do
        if sum(len(t) if hit else -len(t) for t, hit in own) > 0:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in own))).strip()
            if text:
                out.append(text)
    return "\n".join(out)


def _counts(add, elements):
    """Per task the counts of add over labelled pages."""

    def run(batches):
        inside, outside = Counter(), Counter()
        for _, pages in chunks(batches, "html"):
            for page in pages:
                add(page.decode(), elements, inside, outside)
        names_ = sorted({*inside, *outside})
        yield pa.record_batch([pa.array(names_, pa.string()), pa.array([inside[s] for s in names_], pa.int64()), pa.array([outside[s] for s in names_], pa.int64())], ["name", "inside", "outside"])

    return run


def learn(pages: DataFrame, most_pages: int = 4000) -> Weights:
    """Weights from at most most_pages pages whose markup names the article, those with the smallest hashes.

    What is collected is as many names as those pages have, so the bound on pages bounds it.
    """
    labelled = pages.where(F.lower("html").contains("<article") | F.lower("html").contains("<main")).select(F.xxhash64("html").alias("h"), "html")
    cut = labelled.select("h").orderBy("h").limit(most_pages).agg(F.max("h")).first()[0]
    if cut is None:
        return Weights(Elements({}, {}), weigh({}, {}))
    sample = labelled.where(F.col("h") <= cut).select("html")

    def counted(add, elements):
        rows = sample.mapInArrow(_counts(add, elements), "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
        return {r["name"]: r["i"] for r in rows}, {r["name"]: r["o"] for r in rows}

    elements = Elements(*counted(count_elements, Elements({}, {})))
    return Weights(elements, weigh(*counted(count, elements)))


def _extract(shared):
    def run(batches):
        weights = shared.value
        for batch, pages in chunks(batches, "html"):
            texts = [main_text(p.decode(), weights) for p in pages]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, **options) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(learn(pages, **options))
    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract(shared), f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
