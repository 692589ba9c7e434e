"""Exact graph keys against renumbering, against all graphs of five atoms, and on graphs that refinement can't part."""

import itertools
import random
from collections import defaultdict

from cinnabar.operators import refinement


def keys(spark, graphs, labels=None):
    """graphs: name -> (n, [(a, b, kind)]); labels: name -> a label for each atom."""
    atoms = [(g, v, labels[g][v] if labels else 0) for g, (n, _) in graphs.items() for v in range(n)]
    bonds = [(g, a, b, k) for g, (_, own) in graphs.items() for a, b, k in own]
    a = spark.createDataFrame(atoms, "graph string, node int, label int")
    b = spark.createDataFrame(bonds, "graph string, a int, b int, kind int")
    return dict(map(tuple, refinement.graph_keys(a, b, ["label"], "kind").collect()))


def turned(rnd, n, bonds):
    p = rnd.sample(range(n), n)
    return n, [(p[b], p[a], k) if rnd.random() < 0.5 else (p[a], p[b], k) for a, b, k in bonds]


def ring(n, first=0):
    return [(first + i, first + (i + 1) % n, 1) for i in range(n)]


def test_regular_graphs_that_refinement_cannot_part(spark):
    rook = [(4 * r + c, 4 * x + y, 1) for r in range(4) for c in range(4) for x in range(4) for y in range(4) if (r, c) < (x, y) and (r == x) != (c == y)]
    steps = {(0, 1), (1, 0), (1, 1), (0, 3), (3, 0), (3, 3)}
    shrikhande = [(4 * r + c, 4 * x + y, 1) for r in range(4) for c in range(4) for x in range(4) for y in range(4) if (r, c) < (x, y) and ((x - r) % 4, (y - c) % 4) in steps]
    fused = [(i, (i + 1) % 10, 1) for i in range(10)] + [(0, 5, 1)]  # two rings of six that share a bond
    linked = ring(5) + ring(5, 5) + [(0, 5, 1)]  # two rings of five joined by a bond
    plain = {"rook": (16, rook), "shrikhande": (16, shrikhande), "six": (6, ring(6)), "threes": (6, ring(3) + ring(3, 3)), "fused": (10, fused), "linked": (10, linked)}
    plain |= {"k5": (5, [(a, b, 1) for a in range(5) for b in range(a)]), "rings": (60, [e for i in range(10) for e in ring(6, 6 * i)]), "lone": (5, [])}
    rnd = random.Random(3)
    got = keys(spark, plain | {f"{g}-{i}": turned(rnd, *own) for g, own in plain.items() for i in range(2)})
    assert len(got) == 3 * len(plain) and len(set(got.values())) == len(plain)
    assert all(got[g] == got[f"{g}-{i}"] for g in plain for i in range(2))


def test_all_graphs_of_five_atoms(spark):
    pairs = list(itertools.combinations(range(5), 2))
    graphs, want = {}, defaultdict(set)
    for m in range(1 << len(pairs)):
        own = [p for i, p in enumerate(pairs) if m >> i & 1]
        graphs[str(m)] = (5, [(a, b, 1) for a, b in own])
        want[min(tuple(sorted(tuple(sorted((p[a], p[b]))) for a, b in own)) for p in itertools.permutations(range(5)))].add(str(m))
    got = defaultdict(set)
    for g, k in keys(spark, graphs).items():
        got[k].add(g)
    assert len(want) == 34 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_labels_and_kinds_of_random_graphs(spark):
    rnd, graphs, labels, canon = random.Random(5), {}, {}, {}
    for g in map(str, range(150)):
        n = rnd.randint(1, 5)
        own = [(a, b, rnd.randint(1, 2)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]
        graphs[g], labels[g] = (n, own), [rnd.choice([None, 6]) for _ in range(n)]
        named = lambda p: (tuple(sorted((p[v], str(x)) for v, x in enumerate(labels[g]))), tuple(sorted((*sorted((p[a], p[b])), k) for a, b, k in own)))  # noqa: B023, E731
        canon[g] = min(named(p) for p in itertools.permutations(range(n)))
    got = keys(spark, graphs, labels)
    assert all((got[a] == got[b]) == (canon[a] == canon[b]) for a, b in itertools.combinations(got, 2))


def test_a_key_does_not_depend_on_other_graphs(spark):
    chain = (40, [(i, i + 1, 1) for i in range(39)])
    own = (4, ring(4))
    assert keys(spark, {"x": own})["x"] == keys(spark, {"x": own, "chain": chain, "k": (6, ring(6))})["x"]


def test_odd_rows(spark):
    atoms = spark.createDataFrame([("x", 0, 1), ("x", 0, 1), ("x", 1, 1), ("y", 4, 1), ("y", 7, 1), (None, 1, 1), ("x", None, 1), ("z", 0, 1)], "graph string, node int, label int").selectExpr("*", "1 AS task", "2 AS colour")
    bonds = spark.createDataFrame([("x", 0, 1), ("x", 1, 0), ("x", 0, 0), ("x", 0, 9), ("y", 7, 4), (None, 1, 2), ("x", None, 1)], "graph string, a int, b int").selectExpr("*", "1 AS piece", "2 AS task")
    got = dict(map(tuple, refinement.graph_keys(atoms, bonds, ["label"]).collect()))
    assert set(got) == {"x", "y", "z"} and got["x"] == got["y"] != got["z"]
    assert refinement.graph_keys(atoms.limit(0), bonds, ["label"]).collect() == []


def test_equal_graphs_are_worked_on_once(spark, monkeypatch):
    """Two hundred copies of a chain and of a ring, and a chain that is numbered otherwise: three graphs are refined."""
    seen, plain = [], refinement.refined
    monkeypatch.setattr(refinement, "refined", lambda stage, nodes, edges, name: seen.append(nodes.count()) or plain(stage, nodes, edges, name))
    atoms = [(g, n, "c") for g in range(401) for n in range(4)]
    ends = lambda g: [(0, 2), (2, 1), (1, 3)] if g == 400 else [(0, 1), (1, 2), (2, 3)] + ([(3, 0)] if g % 2 else [])
    bonds = [(g, *e) for g in range(401) for e in ends(g)]
    keys = refinement.graph_keys(spark.createDataFrame(atoms, "graph long, node long, l string"), spark.createDataFrame(bonds, "graph long, a long, b long"), ["l"])
    got = {tuple(r) for r in refinement.classes(keys).collect()}
    assert got == {(g, g % 2, 200 if g % 2 else 201) for g in range(401)} and seen[0] == 12
