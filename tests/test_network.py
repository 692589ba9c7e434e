"""The network fixpoint, routes out of it, components, and numbers for all atoms of a route, against plain versions."""

import random
from collections import defaultdict

from cinnabar.operators import network, numbering


def plain_solve(products, parts, stock):
    depth, by = {m: 0 for m in stock}, defaultdict(set)
    for r, p in parts:
        by[r].add(p)
    chosen, d = {}, 0
    while True:
        d += 1
        new = {}
        for r, p in sorted(products):
            if p not in depth and by[r] and by[r] <= set(depth):
                new.setdefault(p, r)
        if not new:
            return {m: (depth[m], chosen.get(m)) for m in depth}
        chosen |= new
        depth |= {p: d for p in new}


def tables(spark, products, parts, stock):
    return spark.createDataFrame(products, "reaction long, product string"), spark.createDataFrame(parts, "reaction long, part string"), spark.createDataFrame([(m,) for m in stock], "molecule string")


def test_network_with_cycles_is_that_of_the_plain_search(spark):
    rnd = random.Random(7)
    for n in (12, 40):
        names = [f"m{i}" for i in range(n)]
        products = [(r, rnd.choice(names)) for r in range(3 * n)]
        parts = [(r, rnd.choice(names)) for r in range(3 * n) for _ in range(rnd.randint(0, 3))]
        stock = rnd.sample(names, n // 6)
        want = plain_solve(products, parts, stock)
        p, q, s = tables(spark, products + products[:3], parts + parts[:3] + [(0, None)], stock)
        solved = network.solve(p, q, s)
        assert {r.molecule: (r.depth, r.reaction) for r in solved.collect()} == want
        targets = spark.createDataFrame([(m,) for m in names] + [(None,)], "target string")
        got = defaultdict(set)
        for r in network.routes(targets, solved, q).collect():
            assert (r.depth, r.reaction) == want[r.molecule] and r.molecule not in got[r.target]
            got[r.target].add(r.molecule)
        below = defaultdict(set)
        for r, m in parts:
            below[r].add(m)
        for m in names:
            way, todo = set(), [m] if m in want else []
            while todo:
                x = todo.pop()
                if x not in way:
                    way.add(x)
                    todo += below[want[x][1]] if want[x][1] is not None else []
            assert got.get(m, set()) == way
        assert {(r.target, r.solved, r.depth) for r in network.summary(targets, solved).where("target is not null").collect()} == {(m, m in want, want[m][0] if m in want else None) for m in names}


def test_a_long_chain_and_a_closed_cycle(spark):
    chain = [(i, f"m{i + 1}") for i in range(20)] + [(100, "a"), (101, "b")]
    parts = [(i, f"m{i}") for i in range(20)] + [(100, "b"), (101, "a")]
    p, q, s = tables(spark, chain, parts, ["m0"])
    got = {r.molecule: r.depth for r in network.solve(p, q, s).collect()}
    assert got == {f"m{i}": i for i in range(21)}
    assert {r.molecule for r in network.solve(p, q, s, max_depth=3).collect()} == {"m0", "m1", "m2", "m3"}
    assert network.solve(p.limit(0), q, s.limit(0)).count() == 0


def plain_roots(nodes, pairs):
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_numbers_have_no_gaps_within_a_route(spark):
    rnd = random.Random(1)
    atoms = [(r, s, a) for r in range(4) for s in range(5) for a in range(6)]
    same = [(r, rnd.randrange(5), rnd.randrange(6), rnd.randrange(5), rnd.randrange(6)) for r in range(4) for _ in range(14)]
    want = {}
    for r in range(4):
        root = plain_roots([(s, a) for q, s, a in atoms if q == r], [((x[1], x[2]), (x[3], x[4])) for x in same if x[0] == r])
        number = {x: i + 1 for i, x in enumerate(sorted(set(root.values())))}
        want |= {(r, *x): number[root[x]] for x in root}
    a = spark.createDataFrame(atoms + atoms[:4] + [(9, 0, None)], "route long, step int, atom int")
    b = spark.createDataFrame(same + [(1, 0, None, 0, 1)], "route long, step_a int, atom_a int, step_b int, atom_b int")
    got = numbering.route_numbers(a, b).collect()
    assert len(got) == len(want) and {(r.route, r.step, r.atom): r.number for r in got} == want
    assert numbering.route_numbers(a.limit(0), b).where("route = 9").count() == 0


def test_a_hub_has_no_hot_task(spark):
    n = 100_000
    hub = spark.range(1, n + 1).selectExpr("0 AS g", "0L AS a", "id AS b").unionByName(spark.range(n, n + 500).selectExpr("0 AS g", "id AS a", "id + 1 AS b"))
    got = numbering.components(hub, "g", "a", "b")
    assert got.count() == n + 501 and [r.root for r in got.select("root").distinct().collect()] == [0]


def test_leaving_groups(spark):
    # a chain 1-2-3-4, a ring 5-6-7 on 4, and a lone pair 8-9
    bonds = [(1, 1, 2), (1, 3, 2), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 6, 7), (1, 7, 5), (1, 8, 9)]
    cut = [(1, 1, 3, 4), (1, 2, 5, 6), (1, 3, 9, 8), (2, 1, 1, 2)]
    got = numbering.leaving_groups(spark.createDataFrame(bonds, "route int, a int, b int"), spark.createDataFrame(cut, "route int, mark int, inner int, outer int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 4, 4), (1, 2, 4, 4, 4), (1, 3, 9, 8, 1), (2, 1, 1, 2, 1)]


def test_groups_split_among_tasks_or_not(spark):
    """Chains of structs and texts: a group that one task takes is joined there, a larger one by stars; numbers are the same."""
    rnd = random.Random(5)
    atoms = [(f"r{r}", s, a) for r in range(6) for s in range(4) for a in range(1 + 3 * r)]
    same = [(f"r{r}", s, a, t, b) for r in range(6) for s, a, t, b in ((rnd.randrange(4), rnd.randrange(1 + 3 * r), rnd.randrange(4), rnd.randrange(1 + 3 * r)) for _ in range(8))]
    a, p = spark.createDataFrame(atoms, "route string, step int, atom long"), spark.createDataFrame(same, "route string, step_a int, atom_a long, step_b int, atom_b long")
    root = {x: x for x in atoms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r, *ends in same:
        x, y = find((r, *ends[:2])), find((r, *ends[2:]))
        root[max(x, y)] = min(x, y)
    want = {}
    for r in {x[0] for x in atoms}:
        roots = sorted({find(x) for x in atoms if x[0] == r})
        want |= {x: roots.index(find(x)) + 1 for x in atoms if x[0] == r}
    for most in (1_000, 30, 1):
        got = numbering.route_numbers(a, p, most).collect()
        assert len(got) == len(want) and {tuple(x[:3]): x.number for x in got} == want


def test_routes_work_out_the_parts_once(spark, monkeypatch):
    """A chain of six reactions: parts are written once, those of chosen reactions only, and rounds read them."""
    seen, plain = [], network.Stage.put
    monkeypatch.setattr(network.Stage, "put", lambda stage, df, name: seen.append((name, plain(stage, df, name).count())) or plain(stage, df, name))
    products, parts = [(i, f"m{i}") for i in range(1, 7)] + [(9, "m3")], [(i, f"m{i - 1}") for i in range(1, 7)] + [(9, "none")]
    p, q, s = tables(spark, products, parts, ["m0"])
    solved = network.solve(p, q, s)
    del seen[:]
    got = {tuple(r) for r in network.routes(spark.createDataFrame([("m6",)], "target string"), solved, q).collect()}
    assert got == {("m6", f"m{i}", i, i or None) for i in range(7)} and [n for k, n in seen if k == "parts"] == [6]
