"""Suffix arrays and longest matches against brute force; what the filtering stage lets through."""

import random
import re

import pytest

from cinnabar.llm import decontam


def split(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]


def test_suffix_array_is_sorted():
    r = random.Random(1)
    for _ in range(200):
        letters = "abcd"[: r.randint(1, 4)]
        shard = decontam.Shard([" ".join(r.choice(letters) for _ in range(r.randint(0, 40))).encode() for _ in range(r.randint(0, 8))])
        suffixes = [shard.hashes[p : shard.ends[p]].tolist() for p in shard.array]
        assert suffixes == sorted(suffixes) and sorted(shard.array.tolist()) == list(range(len(shard.hashes)))


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 40, "shard_bytes": 200}])
def test_longest_matches(spark, limits):
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 12)))) for i in range(12)] + [(None, "a b c a"), (20, None)]
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(40)] + [(None, None), (None, "a b c a b")]
    window = 4
    split_items = [(i, split(t)) for i, t in items]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), window, **limits).collect()
    assert len(got) == len(rows)
    for row in got:
        w = split(row.text)
        best = []
        for p in range(len(w)):
            most = 0
            for _, v in split_items:
                for s in range(len(v)):
                    n = 0
                    while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                        n += 1
                    if v and n >= min(window, len(v)):
                        most = max(most, n)
            best.append(most)
        want = [(p, n) for p, n in enumerate(best) if n and (p == 0 or best[p - 1] <= n)]
        assert [(m.start, m.length) for m in row.matches] == want
        assert row.longest == max(best, default=0)
        by_id = {}
        for i, v in split_items:
            by_id.setdefault(i, []).append(v)
        for m in row.matches:
            assert any(v[m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length] for v in by_id[m.item_id])


def test_no_affected_document_stays(spark):
    r = random.Random(2)
    item = [f"b{i}" for i in range(30)]
    filler = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    rows = [(i, " ".join([*filler(2000), *item[i : i + 13], *filler(2000)])) for i in range(17)]  # far below a twentieth
    clean = [(100 + i, " ".join([*filler(50), *item[:12], *filler(50)])) for i in range(10)] + [(200, " ".join([*filler(400), "two", "words"])), (201, None), (None, ""), (None, " ".join(filler(30)))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "two words"), (3, None)], "item_id long, text string")
    kept = decontam.decontaminate(spark.createDataFrame(rows + clean, "doc_id long, text string"), bench).collect()
    assert sorted((tuple(x) for x in kept), key=repr) == sorted(clean, key=repr)
    assert decontam.decontaminate(spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0), bench).count() == 0
