"""Tanimoto search against all pairs, and message passing against numpy."""

import io
import random
from collections import defaultdict
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinnabar.operators import embedding, learning, tanimoto
from cinnabar.plans.bindings import RULES


def sets_of(rnd, n):
    base = [rnd.sample(range(400), rnd.randint(3, 40)) for _ in range(12)]
    out = {}
    for i in range(n):
        own = set(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            own.discard(rnd.choice(sorted(own)) if own else 0)
            own.add(rnd.randint(0, 500))
        out[i] = own | {9999}  # one element that all have
    return out


@pytest.mark.parametrize("per_cent, block", [(30, 4096), (70, 8), (100, 8)])
def test_links_are_those_of_all_pairs(spark, per_cent, block):
    rnd = random.Random(per_cent)
    sets = sets_of(rnd, 160)
    rows = [(i, e) for i, s in sets.items() for e in s]
    df = spark.createDataFrame(rows + rows[:20] + [(3, None), (None, 5)], "id long, element long").selectExpr("*", "1 AS n", "2 AS place")
    queries = spark.createDataFrame([(i,) for i in range(0, 160, 5)] + [(0,), (None,), (777,)], "id long")
    got = tanimoto.similar(df, queries, per_cent, block).collect()
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in range(0, 160, 5) for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])}
    assert len(got) == len(want) and set(map(tuple, got)) == want and (want or per_cent == 100)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "id long, element long")
    assert tanimoto.similar(none, none, 50).collect() == []
    with pytest.raises(ValueError):
        tanimoto.similar(none, none, 0)


def test_index_grows_with_the_sets_not_with_pairs(spark):
    """A thousand sets around one common element: a set is indexed by its rare elements first."""
    rows = [(i, e) for i in range(1000) for e in (-1, -2, *range(10 * i, 10 * i + 8))]
    index = tanimoto.indexed(spark.createDataFrame(rows, "id long, element long"), 80)
    assert index.count() == 3000 and index.where("element < 0").count() == 0


def test_pairs_that_meet_are_not_shuffled(spark, monkeypatch):
    """Sets in many blocks, with elements that share their first hashes: only similar pairs leave a task."""
    plain, seeds = tanimoto._hash, []

    def shared(element, seed):
        seeds.append(seed)
        return F.pmod(plain(element, seed), F.lit(50)) if seed == 0 else plain(element, seed)

    monkeypatch.setattr(tanimoto, "_hash", shared)
    sets = sets_of(random.Random(1), 120)
    rows = [(i, [*s, None, *list(s)[:2]], i % 4 == 0) for i, s in sets.items()] + [(900, [], True), (901, None, True), (None, [1], True)]
    got = tanimoto.similar_sets(spark.createDataFrame(rows, "id long, elements array<long>, asked boolean"), 50, block=10)
    text = io.StringIO()
    with redirect_stdout(text):
        got.explain()
    assert "Exchange" not in text.getvalue() and "Join" not in text.getvalue() and 2 in seeds
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in range(0, 120, 4) for b in sets if a != b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want and want


def test_pairs_of_all_vectors_of_a_label(spark, tmp_path):
    """No id is divisible by 20, so there would be no pair if only such vectors were compared."""
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5]) for _ in range(64)], rnd.choice([0, 0, 0, 1, 2, None])) for i in range(1, 80) if i % 20]
    signs = {i: {k for k, x in enumerate(v) if x > 0} for i, v, _ in rows}
    spark.createDataFrame([*rows, (None, [1.0] * 64, 0), (200, [1.0] * 64, 9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.a, r.b, r.tanimoto) for r in RULES["tanimoto_pairs"](spark, str(tmp_path)).collect()]
    want = {(a, b, round(len(signs[a] & signs[b]) / len(signs[a] | signs[b]), 6)) for a, _, x in rows for b, _, y in rows if a < b and x == y and x is not None}
    assert len(got) == len(want) > 500 and set(got) == want


def test_pairs_of_a_label_in_many_blocks(spark):
    """Each pair comes once, however a label falls into blocks, and a group has the rows of two blocks, not of a label."""
    rows = [(i, "many", i) for i in range(200)] + [(i, "few", i) for i in range(200, 203)] + [(300, "one", 0), (7, "many", 900), (None, "many", 0), (400, None, 0)]
    df = spark.createDataFrame(rows, "id long, label string, w long")
    got = [tuple(r) for r in learning.label_pairs(df, ["w"], block=9).collect()]
    known = [r for r in rows if None not in r]
    want = sorted((a, b, *sorted((v, w))) for a, x, v in known for b, y, w in known if a < b and x == y)
    assert sorted((a, b, *sorted(w)) for a, b, *w in got) == want
    text = io.StringIO()
    with redirect_stdout(text):
        learning.label_pairs(df, ["w"], block=9).explain()
    assert "SortMergeJoin [label#" in text.getvalue() and "BroadcastNestedLoop" not in text.getvalue() and "Cartesian" not in text.getvalue()
    assert learning.label_pairs(df.limit(0), ["w"]).collect() == []


def test_rounded_shares_of_bits(spark):
    """Half up to six digits, as F.round, also where sets have more bits than fit a word, and 0 for two empty sets."""
    df = spark.createDataFrame([(list(range(1, b + 1)), list(range(1, t + 1))) for t in (0, 1, 3, 7, 64, 128, 640, 2000) for b in {0, 1, t // 3, t // 2 + 1, t} if b <= t], "x array<int>, y array<int>")
    x, y = ([w.alias(f"{c}{k}") for k, w in enumerate(learning.bit_words(F.col(c), 2000))] for c in "xy")
    words = df.select(*x, *y)
    x, y = ([F.col(f"{c}{k}") for k in range(len(x))] for c in "xy")
    got = words.select(learning.word_tanimoto(x, y, 6).alias("new"), F.round(learning.word_tanimoto(x, y), 6).alias("old")).collect()
    assert all(r.new == r.old for r in got) and {0.0, 1.0, 0.007813, 0.001563} <= {r.new for r in got}


def plain_embedding(atoms, bonds, layers, concat):
    out = {}
    graphs = defaultdict(dict)
    for g, n, *x in atoms:
        graphs[g].setdefault(n, x)
    for g, nodes in graphs.items():
        place = {n: i for i, n in enumerate(nodes)}
        adjacent = np.eye(len(nodes))
        for q, a, b in bonds:
            if q == g and a != b and a in place and b in place:
                adjacent[place[a], place[b]] = adjacent[place[b], place[a]] = 1
        d = adjacent.sum(axis=1) ** -0.5
        h, pooled = np.log1p(np.array([[v or 0 for v in x] for x in nodes.values()], float)), []
        for weights, bias in layers:
            h = np.maximum(0, (d[:, None] * adjacent * d) @ h @ np.array(weights) + np.array(bias))
            pooled.append(h.sum(axis=0))
        out[g] = np.concatenate(pooled) if concat else pooled[-1]
    return out


@pytest.mark.parametrize("concat", [False, True])
def test_embeddings_are_those_of_numpy(spark, concat):
    rnd = random.Random(11)
    atoms = [(g, n, rnd.randint(0, 9), rnd.choice([None, 0.5, 3.0])) for g in range(1000) for n in range(rnd.randint(1, 5))]
    bonds = [(g, rnd.randint(0, 5), rnd.randint(0, 5)) for g in range(1000) for _ in range(5)]
    first, second = embedding.even_weights(2, 3), embedding.even_weights(3, 2, 4)
    layers = [(first[0], [0.1, -0.2, 0.3]), second]
    a = spark.createDataFrame(atoms, "graph long, node int, p int, q double")
    b = spark.createDataFrame(bonds + bonds[:9], "graph long, a int, b int")
    got = {r[0]: np.array(r[1:]) for r in embedding.embed(a, b, ["p", "q"], layers, concat).collect()}
    want = plain_embedding(atoms, bonds, layers, concat)
    assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=1e-9) for g in want)
    assert embedding.embed(a.limit(0), b.limit(0), ["p", "q"], layers, concat).collect() == []


def test_a_layer_is_one_join_and_the_fewer_columns_are_sent(spark):
    atoms = spark.createDataFrame([(g, n, 1.0, 2.0, 3.0, 0.5) for g in range(9) for n in range(3)], "graph long, node long, x0 double, x1 double, x2 double, scale double")
    both = spark.createDataFrame([(g, 0, 1) for g in range(9)] + [(g, 1, 0) for g in range(9)], "graph long, a long, b long")
    out = embedding.convolve(atoms, both, *embedding.even_weights(3, 1))
    text = io.StringIO()
    with redirect_stdout(text):
        out.explain()
    assert text.getvalue().count("Join ") == 1 and text.getvalue().count("sum(") == text.getvalue().count("sum(x0") > 0
    (weights, _) = embedding.even_weights(3, 1)
    own = 0.25 * sum(x * w[0] for x, w in zip((1.0, 2.0, 3.0), weights, strict=True))
    assert {(r.node, round(r.x0, 9)) for r in out.collect()} == {(n, round(max(0, own * (2 if n < 2 else 1)), 9)) for n in range(3)}
