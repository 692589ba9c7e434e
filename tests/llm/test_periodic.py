"""Periodic runs against a plain search of every period, and the defined cases."""

import hashlib
import random
import zlib

import pytest

from cinnabar.llm.periodic import Automaton, collapse, periodic_runs, runs_of_texts, with_repeats
from cinnabar.llm.queries import op12_periodic_runs

SCHEMA = "doc_id long, text string"


def plain(words, min_length=6, min_exponent=4):
    """Every period's maximal stretches; of one stretch the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        size = rnd.randint(0, 60)
        own = [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 3, 5])]) for _ in range(size)]
        if own and rnd.random() < 0.7:
            a, p = rnd.randrange(size), rnd.randint(1, 6)
            own = [own[a + (i - a) % p] if i >= a and a + (i - a) % p < size else own[i] for i in range(size)]
        yield own


@pytest.mark.parametrize("length, exponent", [(6, 4), (4, 2), (6, 3), (4, 4), (1, 2), (9, 3)])
def test_runs_are_those_of_the_plain_search(length, exponent):
    for own in sequences(400, length * 10 + exponent):
        assert runs_of_texts([b"x y x y", " ".join(own).encode()], length, exponent)[1] == plain(own, length, exponent)


def test_automaton_has_every_substring_and_no_other():
    for own in sequences(60, 3):
        numbers = [ord(c) for c in own][:20]
        made = Automaton(numbers)
        reached, states = {()}, {(): 0}
        while states:
            more = {}
            for text, s in states.items():
                steps = dict(made.more.get(s, {})) | ({made.word[s]: made.to[s]} if made.word[s] >= 0 else {})
                more |= {(*text, w): t for w, t in steps.items()}
            reached |= set(more)
            states = more
        assert reached == {tuple(numbers[i:j]) for i in range(len(numbers) + 1) for j in range(i, len(numbers) + 1)}


def test_very_long_texts():
    assert runs_of_texts([b"na " * 100_000], 6, 4)[0] == [(0, 100_000, 1)]
    phrase = " ".join(f"w{i}" for i in range(5_000))
    assert runs_of_texts([" ".join([phrase] * 12).encode()], 6, 4)[0] == [(0, 60_000, 5_000)]
    assert runs_of_texts([" ".join([phrase] * 3).encode()], 6, 4)[0] == []


def test_collapse_keeps_the_first_period():
    text = b" go\tnow go now  go now go now then stop"
    (found,) = runs_of_texts([text], 6, 4)
    assert found == [(0, 8, 2)] and collapse(text, found) == (10, "go now then stop")


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "ha " * 7), (4, "ha " * 7), (4, "ha " * 7), (5, "é " * 6 + "É"), (6, "one word less " + "ha " * 5)]
    out = {}
    for r in periodic_runs(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS runs", "1 AS extra")).collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["extra"]))
    assert out[1] == out[2] == out[3] == [(0, [], "", 1)]
    assert out[None] == out[4][:1] == out[4][1:] == [(7, [(0, 7, 1)], "ha", 1)]
    assert out[5] == [(7, [(0, 6, 1)], "é É", 1)] and out[6][0][1] == []
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], SCHEMA), min_exponent=1)


def edited(doc_id, text):
    own = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and own:
        n, g = len(own), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    return own


def test_query_on_documents_of_every_kind(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["a", "b", "lot", "né"]) for _ in range(rnd.randint(0, 70)))) for i in range(400)] + [(400, None), (401, " \n")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)
    for i, text in rows:
        own = edited(i, text)
        found = plain(own)
        covered = {j for s, n, q in found for j in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        want = (len(found), *best, None if not found else 1000 * best[1] // best[2])
        assert tuple(got[i][c] for c in ("n_runs", "start", "length", "period", "exponent_milli")) == want
        assert got[i]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert got[i]["collapsed_sha256"] == hashlib.sha256(b" ".join(w for j, w in enumerate(own) if j not in covered)).hexdigest()


def test_rows_without_id_are_not_edited(spark):
    got = with_repeats(spark.createDataFrame([(None, "a  b"), (3, None)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a  b"), (3, None)]
