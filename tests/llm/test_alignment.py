"""Alignment against whole texts encoded one by one, and the defined cases."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from cinnabar.llm.alignment import Pair, align, segments
from cinnabar.llm.queries import op11_alignment

A, B = (str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string"
ODD = ["", " ", "\n", "two words", "  lead  and trail \n\n", "a\r\nb\tc", "x▁y", "don't 'll 1234.5 (x);\r\n été 世界 ", "\xa0 \xa0 a\xa0 b", "<|endoftext|> <s> <0x41>", "é ​ 　word   x", "\x00 \x1f\x85 ", "👩‍👩‍👧 \U0001f600", "﻿ bom", "word" * 3000, " " * 5000 + "x" + "\n" * 999]


@pytest.fixture(scope="module")
def pair():
    return Pair(A, B)


def ends(tokens):
    out, n = [], 0
    for t in tokens:
        n += len(t)
        out.append(n)
    return out


def plain(pair, texts):
    """Of each text the groups and linked pairs, from the tokens of the whole text."""
    out = []
    for text in texts:
        ids_a, ids_b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [pair.bytes_a[i] for i in ids_a], [pair.bytes_b[i] for i in ids_b]
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, [], []))
            continue
        at_a, at_b = ({e: i for i, e in enumerate(ends(x))} for x in (bytes_a, bytes_b))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(at_a) & set(at_b)):
            groups.append(",".join(map(str, ids_a[i : at_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : at_b[e] + 1])))
            links.append((ids_a[at_a[e]], ids_b[at_b[e]]))
            i, j = at_a[e] + 1, at_b[e] + 1
        out.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(x for *_, links in out for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(na, nb, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g)) for na, nb, g, x in out]


def test_cuts_are_verified(pair):
    cut = pair.cut_characters()
    assert " " in cut and "\n" in cut and "\r" not in cut  # B merges ; and a carriage return
    for text in ODD:
        own = segments(" " + text, cut)
        assert "".join(own) == " " + text
        if text:
            assert sum(pair.ids_a(own), []) == pair.ids_a([" " + text])[0] and sum(pair.ids_b(own), []) == pair.b.encode(text)
    assert segments("a b", "") == ["a b"]


def test_rows_are_those_of_whole_texts(spark, pair):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(None, "two words"), (3, "two words"), (3, "other two words ▁ here"), (50, "word " * 20_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_a", "'x' AS block", "2 AS segment")
    want = sorted((i or -1, *x) for (i, _), x in zip(rows, plain(pair, [t for _, t in rows]), strict=True))
    for size in (1, 1 << 21):
        got = [tuple(r) for r in align(docs, A, B, block_bytes=size).collect()]
        assert sorted((i or -1, *x) for i, *x in got) == want
    assert align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert any(x[1] == 0 and x[0] == 6 for x in want)


def test_query_on_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(docs, plain(pair, [r["text"] for r in docs]), strict=True)}
    got = op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) > 0
    for r in got:
        *numbers, groups = want[r["doc_id"]]
        assert [r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == numbers
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
