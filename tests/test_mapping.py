"""Atom mapping from scores against a plain loop over one reaction, ties, stops, and odd rows."""

import io
import random
from contextlib import redirect_stdout

import pytest

from cinnabar.operators import mapping

ATOMS, SCORES, BONDS = "reaction long, atom long, side string, element string", "reaction long, p long, r long, score double", "reaction long, a long, b long"


def plain(score, p_atoms, bonds, factor=1.75):
    """{p: r} of one reaction: score {(p, r): value}, bonds a set of pairs both ways."""
    score, found = {k: v for k, v in score.items() if v > 0}, {}
    while len(found) < len(p_atoms):
        scope = {p for p in p_atoms if p not in found and any((p, q) in bonds for q in found)}
        choice = [(-v, p, r) for (p, r), v in score.items() if not scope or p in scope]
        if not choice or -min(choice)[0] <= 1e-8:
            break
        _, p, r = min(choice)
        found[p] = r
        score = {(a, b): v * factor if (a, p) in bonds and (b, r) in bonds else v for (a, b), v in score.items() if a != p and b != r}
    return found


def test_random_reactions_equal_the_plain_loop(spark):
    dice, atoms, scores, bonds, want = random.Random(5), [], [], [], {}
    for x in range(150):
        ps, rs = range(dice.randint(1, 14)), range(100, 100 + dice.randint(1, 14))
        element = {a: dice.choice("CCNO") for a in [*ps, *rs]}
        own = {(p, r): dice.choice([0.0, 0.25, 0.5, dice.random()]) for p in ps for r in rs if element[p] == element[r]}
        tied = {tuple(dice.sample(side, 2)) for side in (ps, rs) if len(side) > 1 for _ in range(len(side))}
        atoms += [(x, a, "product" if a < 100 else "reactant", e) for a, e in element.items()]
        scores += [(x, p, r, v) for (p, r), v in own.items()]
        bonds += [(x, a, b) for a, b in tied]
        found = plain(own, ps, tied | {(b, a) for a, b in tied})
        want |= {(x, p): found.get(p) for p in ps}
    args = spark.createDataFrame(scores, SCORES), spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)
    got = {(r.reaction, r.atom): r.mapped for r in mapping.map_atoms(*args, rounds=3).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 300 and None in want.values()


def test_stop_in_scope_ties_and_neighbours(spark):
    atoms = [(1, a, "product", "C") for a in (1, 2, 3)] + [(1, a, "reactant", "C") for a in (11, 12, 13)]
    atoms += [(x, a, side, "C") for x in (2, 3) for side, own in (("product", (1, 2)), ("reactant", (11, 12))) for a in own]
    scores = [(1, 1, 11, 0.9), (1, 3, 13, 0.8)]  # atom 2 comes next and has no score, so atom 3 is not reached
    scores += [(2, p, r, 0.5) for p in (1, 2) for r in (11, 12)]  # all tie
    scores += [(3, 1, 11, 0.9), (3, 2, 12, 0.3), (3, 2, 11, 0.95), (3, 1, 12, 0.3)]
    bonds = [(1, 1, 2), (1, 2, 3), (3, 1, 2), (3, 12, 11)]
    out = mapping.map_atoms(spark.createDataFrame(scores, SCORES), spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS))
    assert {(r.reaction, r.atom): r.mapped for r in out.collect()} == {(1, 1): 11, (1, 2): None, (1, 3): None, (2, 1): 11, (2, 2): 12, (3, 2): 11, (3, 1): 12}


def test_attention_is_added_both_ways_under_the_element_mask(spark):
    atoms = spark.createDataFrame([(1, 1, "product", "C"), (1, 2, "product", "N"), (1, 11, "reactant", "C"), (1, 12, "reactant", "N"), (1, 13, "reagent", "C"), (1, 14, "reactant", None)], ATOMS)
    nan = float("nan")
    rows = [(1, 1, 11, 0.25), (1, 11, 1, 0.5), (1, 1, 11, 0.125), (1, 1, 12, 1.0), (1, 1, 13, 1.0), (1, 1, 14, 1.0), (1, 1, 2, 1.0), (1, 2, 12, nan), (1, 12, 2, None), (2, 1, 11, 1.0), (None, 1, 11, 1.0)]
    got = mapping.pair_scores(spark.createDataFrame(rows, "reaction long, a long, b long, value double"), atoms).collect()
    assert [tuple(r) for r in got] == [(1, 1, 11, 0.75)]


def test_numbers_and_odd_rows(spark):
    atoms = spark.createDataFrame([(1, 1, "product", "C"), (1, 2, "product", "C"), (1, 3, "product", "C"), (1, 11, "reactant", "C"), (1, 11, "reactant", "C"), (1, 12, "reactant", "C"), (2, 1, "product", "C"), (None, 1, "product", "C")], ATOMS)
    scores = spark.createDataFrame([(1, 3, 11, 0.5), (1, 3, 11, 0.1), (1, 1, 11, None), (1, 2, 12, -1.0), (1, 2, 12, float("nan")), (1, 9, 12, 3.0), (1, 2, 99, 3.0), (None, 1, 11, 1.0)], SCORES)
    bonds = spark.createDataFrame([(1, 3, 3), (1, None, 2), (5, 1, 2)], BONDS)
    mapped = mapping.map_atoms(scores, atoms.selectExpr("*", "1 AS score", "2 AS taken"), bonds)
    assert sorted((r.reaction, r.atom, r.mapped) for r in mapped.collect()) == [(1, 1, None), (1, 2, None), (1, 3, 11), (2, 1, None)]
    numbers = sorted(tuple(r) for r in mapping.numbered(mapped, atoms).collect())
    assert numbers == [(1, 1, "product", 3), (1, 2, "product", 4), (1, 3, "product", 1), (1, 11, "reactant", 1), (1, 12, "reactant", 2), (2, 1, "product", 1)]
    assert mapping.map_atoms(scores.limit(0), atoms.limit(0), bonds.limit(0)).count() == 0
    with pytest.raises(Exception, match="bonds"):
        mapping.map_atoms(scores, atoms, spark.createDataFrame([(1, 3, k) for k in range(5)], BONDS), most_bonds=3).count()


def test_attention_is_dealt_twice(spark):
    n = 30_000_000  # only planned, and counted
    attention = spark.range(n).selectExpr("id % 1000 AS reaction", "id % 50 AS a", "id % 49 AS b", "id / 7 AS value")
    atoms = spark.range(n).selectExpr("id AS reaction", "id % 50 AS atom", "'product' AS side", "'C' AS element")
    text = io.StringIO()
    with redirect_stdout(text):
        mapping.pair_scores(attention, atoms).explain()
    assert text.getvalue().count("Exchange ") == 4  # one for each side of two joins; rows are added up in the first
    assert ", 60)" in text.getvalue()  # tasks grow with the rows


def test_query_writes_its_atoms_once(spark, monkeypatch):
    from cinnabar.plans.bindings import RULES

    seen = []
    monkeypatch.setattr(mapping, "map_atoms", lambda *tables: seen.extend(tables) or tables[0])
    RULES["mapped_atoms"](spark, "/root/testdata/sf0.001")
    _, atoms, bonds = seen
    assert not [f for f in [*atoms.inputFiles(), *bonds.inputFiles()] if "lineitem" in f]
