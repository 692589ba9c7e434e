"""Each corpus operator against brute force on small tables with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import html as htmllib
import io
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cinnabar.llm import decontam, html, linededup, minhash, packing, pii, queries, sketch, store, suffixes, toxicity, warc

WORDS = ["alpha", "beta", "Gamma", "délta", "eps", "zeta", "eta", "theta"]


def texts(n, seed, sep=" "):
    r = random.Random(seed)
    return [sep.join(r.choice(WORDS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_lines long, score string").repartition(3)


def order(rows):
    return sorted(rows, key=repr)


EDGE = [(None, None), (None, "alpha beta"), (3, ""), (3, None), (4, "  \n\t "), (4, "  \n\t ")]


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "u", "x" * 200), (2, None, "x" * 200), (2, "v", "x" * 200), (9, "w\n", "é" * 60), (1, "a", "short"), (8, "b", "short"), (None, "c", "x" * 200), (7, "d", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for zip64 in (False, True):
        out = warc.read_archives(warc.write_archives(df, store.Store(spark, "t"), package_bytes=300, zip64=zip64)).collect()
        assert len(out) == len(pages)
        for r in out:
            assert r.record_type == ("revisit" if r.payload is None else "response")
            if r.payload is not None:
                assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        assert sorted((r.page_id or 0, r.refers_to) for r in out if r.record_type == "revisit") == [(0, 2), (5, 2)]
    empty = warc.read_archives(warc.write_archives(df.limit(0), store.Store(spark, "t")))
    assert empty.count() == 0


def test_zip_is_readable_by_others():
    import zipfile

    for zip64 in (False, True):
        out = io.BytesIO()
        w = warc.ZipWriter(out, zip64)
        for name, data in (("a/b", b"one"), ("c", b"")):
            w.add(name, iter([data]), zlib.crc32(data), len(data))
        w.close()
        assert zipfile.ZipFile(out).read("a/b") == b"one"
        assert warc.ZipReader(out).read("a/b", 1, 1) == b"n"


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_base_spans():
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice(r.choice(["ab.@-", "0123456789", "1.", "+( )-.1", " é@a.", "4 -"])) for _ in range(r.randint(0, 45)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000)["email"] == []
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.2.3.4")["ip"] == [(0, 5007)] and pii.base_spans(f"{zeros}.{zeros}.1.{zeros}7")["ip"] == [(0, 15005)] and pii.base_spans(zeros + "256.2.3.4")["ip"] == []


def test_contexts_are_whole_words():
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice("ab =\n") for _ in range(r.randint(0, 30)))
        a = r.randint(0, len(t))
        b = r.randint(a, len(t))
        before, after = t[:a].split(), t[b:].split()
        left, right = before[-1] if before else "^", after[0] if after else "$"
        assert pii.Context(t).patterns(a, b) == [f"l\t{left}", f"r\t{right}", f"b\t{left}\t{right}"]
    long_ = "x" * 50 + "="
    assert pii.Context(f"{long_} 12 {long_}").patterns(52, 54)[2] == f"b\t{long_}\t{long_}"


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(100 + i, f"reach me at phone: +1 (555) 010-10{i:02d} today") for i in range(20)] + [(250, "reach me at phone: 555-010-1099 today"), (251, "item 555-010-1099x sold"), *EDGE]
    out = {r.doc_id: r for r in pii.personal_data(docs(spark, [(i, t) for i, t in rows if i is not None])).collect()}
    assert all(len(out[i].base) == 1 and not out[i].added for i in range(100, 120))
    assert all(s.end > s.start for r in out.values() for s in r.added)
    assert pii.personal_data(docs(spark, rows).limit(0)).count() == 0


def test_bootstrap_finds_other_spellings(spark):
    cards = [f"{n} 1111 1111" for n in range(4000_0000, 4000_2000) if pii.luhn(f"{n}11111111")][:15]
    rows = [f"reach me at phone: +91 (93) 93-94{i:03d} today" for i in range(30)] + [f"write to mail= user{i}@host.org soon" for i in range(15)] + [f"pay by card# {c[:4]} {c[4:]} please" for c in cards] + [f"login from ip= 10.0.0.{i} again" for i in range(15)]
    planted = {"phone": ("phone: {} today", "555-010-1099", "555 010 1099", "(555) 010 1098", "5550101097", "0044 555 010 10 96"), "email": ("mail= {} soon", "root@localhost", "jane.doe (at) host.org", "joe[at]host[dot]org", "ann at host dot org", "bob @ host.org"), "card": ("card# {} please", "4111.1111.1111.1112", "4111 1111 1111 1113"), "ip": ("ip= {} again", "10.0.0.300", "10 . 0 . 0 . 77", "10[.]0[.]0[.]78", "fe80::1")}
    want = {}
    for kind, (frame, *forms) in planted.items():
        for form in forms:
            text = "x " + frame.format(form)
            want[len(rows)] = (text, [(kind, text.index(form), text.index(form) + len(form))])
            rows.append(text)
    for text in ("item 555-010-1099x sold", "size 555 010 1234 cm", "phone: abc1234 today", "meet me (at) home"):
        want[len(rows)] = (text, [])
        rows.append(text)
    out = {r.doc_id: r for r in pii.personal_data(docs(spark, [*enumerate(rows)])).collect()}
    assert {i: (rows[i], [tuple(s) for s in out[i].added]) for i in want} == want
    assert all(len(r.base) == 1 and not r.added for i, r in out.items() if i not in want)
    for hard in ("1 " * 100_000 + "x", "1." * 100_000, "(at) " * 50_000, "a:" * 100_000, "@" * 100_000, "1-1 " * 50_000, "a" * 200_000 + "@" + "b." * 50_000):
        pii._candidates(hard, pii.base_spans(hard))


def test_bootstrap_keeps_the_best_supported(spark):
    # 20 contexts of 30 seeds each: the belief of what stands in all of them rounds to 1
    seeds = [("phone", 0, 5, 1000 + i, 0, list(range(20))) for i in range(30)]
    found = spark.createDataFrame([([*seeds, (None, 0, 5, 1, 8, list(range(20))), (None, 0, 5, 2, 8, [3]), (None, 0, 5, 3, 8, [77])],)], f"found {pii.SPANS}")
    assert order(map(tuple, pii.bootstrap(found, store.Store(spark, "t"), 2, 0.7, 3).select("instance", "kind").collect())) == [(1, "phone"), (2, "phone")]


def test_packing(spark):
    path = queries.word_tokenizer()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = [*enumerate(texts(40, 1)), *EDGE, (7, "<|endoftext|> É's ﬁ\x1c1234 " * 3)]
    out = packing.pack(docs(spark, rows), path, capacity=32).collect()
    assert sum(r.length for r in out) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32
    want = tokenizer.encode(rows[0][1], add_special_tokens=False).ids + [0]
    assert next(r.ids_crc32 for r in out if r.doc_id == 0 and r.piece == 0) == zlib.crc32(np.array(want[:32], "<u4").tobytes())
    assert packing.pack(docs(spark, rows).limit(0), path).count() == 0


def test_words_of_many_texts_are_encoded_once():
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    odd = ["", None, " \n ", "Straße, ÉTÉ!! it's x1y2", "a\u0301\u00a0b\x1cc\r\n\x85d", "ẞİ ÿŸ ß×÷ \U0001f600!?", "中文 words\ttab", "don't...", "!!! (a) a) [é]{É}"]
    own = [*odd, *texts(60, 9), *texts(60, 10, "\n")]
    encoder = packing.Encoder(path, most=2)  # caches that forget all words from one call to the next
    seen, letters = [], encoder.stems.make
    encoder.stems.make = lambda stem: (seen.append(stem), letters(stem))[1]
    got = encoder.ids(pa.array(own))
    tokenizer = Tokenizer.from_file(path)
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in own]
    assert len(seen) == len(set(seen)) and {w.lower() for w in WORDS} <= set(seen)
    assert [x.tolist() for x in encoder.ids(pa.array(own).slice(3, 2))] == [x.tolist() for x in got[3:5]]
    assert [len(x) for x in encoder.ids(pa.array([None, ""], pa.string()))] == [0, 0]


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([8, 16, 50])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= n]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= n
            else:
                bins.append(capacity - n)
        assert packing.plan({n: lengths.count(n) for n in lengths}, capacity)[1] == len(bins)


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, block):
    r = random.Random(9)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        own = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            own[r.randrange(60)] = f"q{r.randint(0, 9)}"
        rows.append((100 + i, " ".join(own)))
    for i in range(30):  # many just below or at the threshold, of one group
        own = list(base[0])
        for j in r.sample(range(4, 56), 2):
            own[j] = f"z{i}"
        rows.append((300 + i, " ".join(own)))
    rows += [(90, rows[0][1]), (91, rows[0][1].upper()), (92, "one two"), (93, "ONE\ttwo"), *EDGE]
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", (t or "").lower()) if x]
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {i: i for i in sets if i is not None}
    for _ in range(len(root)):
        for a in root:
            for b in root:
                if any(100 * len(x & y) >= 75 * len(x | y) and x and y for x in sets[a] for y in sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.near_duplicates(docs(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert (g.component_id, g.kept) == (root[g.doc_id], root[g.doc_id] == g.doc_id)
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates_without_ids(spark, block):
    r = random.Random(4)
    long_ = lambda: [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    near = lambda own, x: " ".join([*own[:-1], x])
    five, nine, own, pair = long_(), long_(), long_(), long_()
    rows = [(5, " ".join(five)), (None, near(five, "x")), (None, near(five, "x")), (9, " ".join(nine)), (None, near(nine, "y"))]
    rows += [(None, " ".join(own))] * 4 + [(None, " ".join(pair)), (None, near(pair, "z")), (12, " ".join(long_()))]
    # many near copies, so that buckets are cut
    rows += [(None if i % 2 else 100 + i, near(five, f"v{i}")) for i in range(12)] + [(None, None), (None, ""), (None, " "), (7, None)]
    got = minhash.near_duplicates(docs(spark, rows), block=block).collect()
    assert order((g.doc_id, g.component_id, g.kept) for g in got if g.n_shingles) == order([(5, 5, True), (None, 5, False), (None, 5, False), (9, 9, True), (None, 9, False), (12, 12, True), (None, None, True), *[(None, None, False)] * 3, (None, None, True), (None, None, False), *[(None if i % 2 else 100 + i, 5, False) for i in range(12)]])
    assert order((g.doc_id, g.component_id, g.kept) for g in got if not g.n_shingles) == order([(None, None, True)] * 3 + [(7, 7, True)])
    kept = order((x.doc_id, x.text) for x in minhash.drop_near_duplicates(docs(spark, rows), block=block).collect())
    one = next(x for x in kept if x[0] is None and x[1] and x[1].startswith(pair[0] + " "))
    assert one[1] in (" ".join(pair), near(pair, "z"))
    assert kept == order([rows[0], rows[3], rows[5], one, (12, rows[11][1]), (None, None), (None, ""), (None, " "), (7, None)])


def test_sketches(spark):
    rows = [(None, None), (None, ""), (5, "a\nb"), (5, "a\nb"), (5, "c"), (1, "\n".join(map(str, range(300)))), (2, "\n".join(map(str, range(150, 300)))), (9, "é"), (None, "a")]
    key = lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashlib.md5((r[1] or "").encode()).hexdigest())
    one = sorted({(d, t or "") for d, t in rows}, key=key)
    want = []
    for d, t in rows:
        t = t or ""
        x = one[(one.index((d, t)) + 1) % len(one)][1]
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        a, b, c = (set(y.split("\n")) for y in (t, e, x))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
    out = sketch.fingerprints(docs(spark, rows)).collect()
    assert order((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == order(want)
    assert len({r.fingerprint for r in out if r.doc_id == 5}) == 2


def test_sketches_recover_what_differs(spark):
    from pyspark.sql import functions as F

    rows = [(9, "\n".join(f"p{i}" for i in range(40))), (7, "\n".join(f"p{i}" for i in range(3, 44))), (5, "\n".join(f"x{i}" for i in range(300))), (3, ""), (1, "p1")]
    of = lambda t: {r[0] for r in spark.createDataFrame([(x,) for x in t.split("\n")], "p string").select(F.xxhash64("p")).collect()}
    out = {r.doc_id: r for r in sketch.fingerprints(docs(spark, rows), recovered=True).collect()}
    for i, (d, t) in enumerate(rows):
        x = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert sorted(out[d].differ_next) == sorted(of(t) ^ of(x)) and sorted(out[d].differ_edited) == sorted(of(t) ^ of(e))
    assert sketch.fingerprints(docs(spark, rows).limit(0)).count() == 0


def test_sketches_of_many_lines(spark):
    """20,000 lines: all that differ are recovered, also without a common line, in time that grows with the lines."""
    own = [f"a {j}" for j in range(20_000)]
    near = [f"b {j}" if j % 4 == 0 else x for j, x in enumerate(own)]
    rows = [(3, "\n".join(own)), (2, "\n".join(near)), (1, "\n".join(f"c {j}" for j in range(20_000)))]
    start = time.monotonic()
    out = {r.doc_id: r for r in sketch.fingerprints(docs(spark, rows), recovered=True).collect()}
    assert [len(set(out[i].differ_next)) for i in (3, 2, 1)] == [10_000, 40_000, 40_000]
    assert out[3].near_next == 30_000 / 50_000 and out[2].near_next == out[1].near_next == 0
    assert time.monotonic() - start < 120


def test_block_max_index_is_exact():
    r = np.random.default_rng(4)
    known = np.unique(r.integers(1, 2**63, 40, dtype=np.uint64))
    # some terms are in nearly all examples, most in few, as words are
    rows = [(i, t, int(r.integers(1, 4))) for i in range(500) for t in range(40) if r.random() < 3 / (t + 3) ** 1.2]
    doc, number, tf = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    ids, labels, weights = np.arange(500) + 1000, r.integers(0, 2, 500), r.random(40) * np.arange(1, 41)
    index = toxicity.Index(known, weights, ids, labels, doc, number, tf, 0.5, 16, 0.25)
    dense = np.zeros((500, 40))
    dense[doc, number] = toxicity.unit(doc, number, tf, weights, 500)
    for i in range(500):
        cosine = dense @ dense[i]
        at, near = index.nearest(np.flatnonzero(dense[i]), dense[i][dense[i] > 0])
        want = np.sort(cosine[cosine > 0])[::-1][:16]
        assert len(near) == len(want) and np.allclose(near, want, atol=1e-6)
        assert np.allclose(cosine[index.ids[at] - 1000], near, atol=1e-6) and (index.labels[at] == labels[index.ids[at] - 1000]).all()


def test_toxicity_is_calibrated(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(df, labels)
    rows = df.join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("text", "toxic").collect()
    score, toxic = np.array([s for s, _ in index.score([(r.text or "").encode() for r in rows])]), np.array([r.toxic for r in rows])
    assert (score >= 0.5)[toxic == 1].mean() >= 0.85 and (score >= 0.5)[toxic == 0].mean() <= 0.01
    for low in np.arange(0, 1, 0.2):
        own = (score >= low) & (score < low + 0.2)
        if own.sum() >= 30:
            assert abs(score[own].mean() - toxic[own].mean()) <= 0.1


def test_toxicity_without_examples_of_both_labels(spark):
    for toxic, want in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(4, toxic), (5, None), (None, 1)], "doc_id long, toxic int")
        out = toxicity.toxicity(docs(spark, [(4, "a b"), (4, "c"), *EDGE]), labels)
        assert out.columns == ["doc_id", "text", "n_lines", "score", "predicted", "evidence"] and {(r.score, r.predicted) for r in out.collect()} == {(want, toxic)}
    assert toxicity.toxicity(docs(spark, EDGE).limit(0), labels).count() == 0


def test_toxicity_on_held_out(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(df, labels).withColumn("held", toxicity.held_out("doc_id")).join(labels, "doc_id").where("held").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.93 * len(out)
    assert toxicity.toxicity(docs(spark, EDGE), labels.limit(0)).where("score = 0").count() == len(EDGE)


@pytest.mark.parametrize("anchor", [6, 15])
def test_repeats(spark, anchor):
    r = random.Random(5)
    rows = [(r.choice([None, *range(30)]), "".join(r.choice(["ab", "cd", "é", "x" * 10, "hello world "]) for _ in range(r.randint(0, 60)))) for _ in range(60)] + EDGE
    first = {}
    top = lambda d: 2**63 - 1 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 19):
            first[b[p : p + 20]] = min(first.get(b[p : p + 20], 2**63), top(d))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 19):
            if first[b[p : p + 20]] < top(d):
                gone[p : p + 20] = b"\1" * 20
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    for broadcast, common in ((1 << 20, 16), (0, 0)):
        got = suffixes.remove_repeats(docs(spark, rows), length=20, anchor=anchor, batch_bytes=300, shard_bytes=64, broadcast_bytes=broadcast, common=common).collect()
        assert order(map(tuple, got)) == order(want)


def test_equal_bytes_decide_not_equal_fingerprints(monkeypatch):
    r = random.Random(8)
    made = suffixes.rolling
    monkeypatch.setattr(suffixes, "rolling", lambda data, size: made(data, size) & np.uint64(7) << np.uint64(61))
    for i in range(40):
        texts_ = ["".join(r.choice("ab") for _ in range(r.randint(0, 40) if i % 2 else 9 * (i == 2))).encode() for _ in range(8)]
        ids = sorted(r.choices(range(6), k=8))
        text, at, hit = suffixes.Strings(ids, texts_, None, 8, 3, 2).covered(None)
        got = {(int(t), int(a)) for t, a, h in zip(text, at, hit, strict=True) if h}
        assert got == {(i, p) for i, t in enumerate(texts_) for p in range(len(t) - 7) if any(ids[j] < ids[i] and t[p : p + 8] in texts_[j] for j in range(8))}


def test_order_by_bytes_is_stable():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 500):
        keys = np.array([bytes(r.integers(0, 3, 12, dtype=np.uint8)) if r.random() < 0.5 else b"same8byt" + bytes(r.integers(0, 2, 4, dtype=np.uint8)) for _ in range(n)], dtype="S12")
        assert suffixes.by_bytes(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_levels_keep_the_least_document():
    r = np.random.default_rng(3)
    levels, least = suffixes.Levels(), {}
    for doc in range(60):
        keys = np.unique(np.array([bytes(r.integers(97, 100, 5, dtype=np.uint8)) for _ in range(r.integers(1, 9))], dtype="S5"))
        before = levels.earliest(keys)
        assert before.tolist() == [least.get(k, suffixes.NONE) for k in keys.tolist()]
        levels.add(keys[before == suffixes.NONE], np.full(int((before == suffixes.NONE).sum()), doc, np.int64))
        for k in keys.tolist():
            least.setdefault(k, doc)
        sizes = [len(k) for k, _ in levels.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and all((np.sort(k) == k).all() for k, _ in levels.levels)


def test_shards_hold_like_shares_of_names():
    data = np.random.default_rng(7).integers(97, 123, 200_000, dtype=np.uint8)
    cells = suffixes._cells(np.unique(suffixes.names(data, 50, 30)), 4)
    sizes = [len(own) for _, own in cells]
    assert len(cells) == 16 and max(sizes) <= 1.2 * min(sizes)


def shard_rows(rows, length, fine=0):
    """Rows of a shard as the operator sends them, of (batch, [(doc, segment)]), whose parts are made of the first bytes."""
    for batch, own in rows:
        own.sort(key=lambda x: x[1][0] % (1 << fine))
        parts = np.bincount([t[0] % (1 << fine) for _, t in own], minlength=1 << fine).astype("<u4").tobytes()
        sent = (np.array([len(t) - length + 1 for _, t in own], "<u4"), np.array([d for d, _ in own], "<i8"), np.frombuffer(b"".join(t for _, t in own), np.uint8))
        yield pa.record_batch([pa.array([3]), pa.array([batch]), *(pa.array([x], pa.binary()) for x in (parts, *(suffixes._small(x.tobytes()) for x in sent)))], ["shard", "batch", "parts", "counts", "docs", "data"])


@pytest.mark.parametrize("fine", [0, 1, 2])
@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_a_shard_says_which_strings_are_earlier(block, fine):
    r = random.Random(block)
    ids = sorted(r.choices([*range(40), *[suffixes.NONE] * 30], k=120))
    # equal strings are in one part; here that of their first byte, so that segments are single strings if there are parts
    rows = [(b, [(d, bytes(r.choices(b"abc", k=5 if fine else r.randint(5, 9)))) for d in ids[8 * b : 8 * b + 8]]) for b in range(15)]
    got = [x for batch in suffixes._earlier(5, block)(shard_rows(rows, 5, fine)) for x in batch.to_pylist()]
    assert [x["batch"] for x in got] == list(range(15)) and {x["shard"] for x in got} == {3}
    seen = {}
    for _, own in rows:
        for d, t in own:
            for p in range(len(t) - 4):
                seen[t[p : p + 5]] = min(d, seen.get(t[p : p + 5], d))
    for (batch, own), x in zip(rows, got, strict=True):
        places = [(d, t[p : p + 5]) for d, t in own for p in range(len(t) - 4)]
        told = suffixes._bits(x["mask"], len(places))
        before = {t for b, o in rows[:batch] for _, text in o for t in (text[p : p + 5] for p in range(len(text) - 4))}
        # repeats within a batch are found by the batch itself
        assert [bool(v) for v, (_, t) in zip(told, places, strict=True) if t in before] == [seen[t] < d for d, t in places if t in before]
        assert not any(v and seen[t] >= d for v, (d, t) in zip(told, places, strict=True))


@pytest.mark.parametrize("block", [1, 40])
def test_many_rows_without_doc_id_in_a_shard(block):
    r = random.Random(block)
    rows = [(b, [(suffixes.NONE, bytes(r.choices(b"abcd", k=r.randint(5, 9)))) for _ in range(r.choice([1, 8, 30]))]) for b in range(60)]
    got = [x for batch in suffixes._earlier(5, block)(shard_rows(rows, 5)) for x in batch.to_pylist()]
    assert len(got) == 60 and not any(suffixes._bits(x["mask"], sum(len(t) - 4 for _, t in own)).any() for (_, own), x in zip(rows, got, strict=True))


@pytest.mark.parametrize("fine", [0, 3])
def test_parts_change_no_answer_and_send_no_more_rows(fine):
    r = random.Random(4)
    passages = ["".join(r.choices("abcdef", k=60)).encode() for _ in range(20)]
    batches = [(list(range(9 * b, 9 * b + 9)), [b"".join(r.choices(passages, k=3)) for _ in range(9)]) for b in range(12)]
    every = [[{"shard": i, "mask": suffixes._mask(np.ones(len(own), bool)), "often": suffixes._mask(np.zeros(len(own), bool))} for i, own in suffixes._cells(suffixes._all_names(t, 20, 12)[1], 2)] for _, t in batches]
    made = [suffixes.Strings(d, t, names, 20, 12, 2, fine) for (d, t), names in zip(batches, every, strict=True)]
    sent = sorted((c[0], b, *c[1:]) for b, x in enumerate(made) for c in x.sent())
    assert len(sent) == sum(len(names) for names in every)
    columns = [pa.array(c, pa.binary() if i > 1 else pa.int64()) for i, c in enumerate(zip(*sent, strict=True))]
    told = [x for a in suffixes._earlier(20, 50)([pa.record_batch(columns, list("abcdef"))]) for x in a.to_pylist()]
    first = {}
    for d, t in ((d, t) for ds, ts in batches for d, t in zip(ds, ts, strict=True)):
        for p in range(len(t) - 19):
            first.setdefault(t[p : p + 20], d)
    for b, (x, (ds, ts)) in enumerate(zip(made, batches, strict=True)):
        text, at, hit = x.covered([y for y in told if y["batch"] == b])
        got = {(int(i), int(p)) for i, p, h in zip(text, at, hit, strict=True) if h}
        assert got == {(i, p) for i, t in enumerate(ts) for p in range(len(t) - 19) if first[t[p : p + 20]] < ds[i]}


def test_repeats_equal_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op7_suffixes"])
    got = queries.QUERIES["op7_suffixes"](spark, d).select(*want.columns).collect()
    assert order(map(tuple, got)) == order(want.fetchall())


def test_html():
    page = '<html><head><title>t</title></head><body><nav><a>x y z</a></nav><div class="ad">buy now</div><article><h1>A &amp; B</h1><p>one two<br><p>three <b>four</b>  five</p><aside>side</aside></article><div class="comments">bad words here</div><footer>f f</footer></body></html>'
    weights = html.learned([page])
    assert html.main_text(page, weights) == "A & B\none two\nthree four five"
    for odd in ("", "<p>", "<a " * 1000, "<<>>", "&amp;&#x41;&bogus;"):
        assert html.main_text(odd, weights) in ("", htmllib.unescape(odd), odd.strip())
    assert html.region([-1, 2, -1, 3, -5, 4]) == (1, 4)


def test_html_blocks_inside_the_article():
    tail = " ".join(f"word{i}" for i in range(30))
    for block in (f'<div class="advert"><p>{"buy now " * 60}</p></div>', f"<form><label>{'your name ' * 60}</label></form>", f"<aside>{'<p>see also</p>' * 60}</aside>"):
        page = f"<html><body><nav><a>x y z</a></nav><article><p>short first one</p>{block}<p>{tail}</p>{block}<p>short last one</p></article><footer>f f</footer></body></html>"
        for weights in (html.learned(["<html><body><nav><a>x y z</a></nav><article><p>one two</p></article><div>out side</div><footer>f f</footer></body></html>"]), html.learned([])):
            assert html.main_text(page, weights) == f"short first one\n{tail}\nshort last one"


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>hello big world</p></article>")], "page_id long, url string, html string")
    assert order(map(tuple, html.extract(df).collect())) == order([(1, "u", "", 0), (None, None, "hello big world", 15)])


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup(spark, broadcast):
    rows = [*enumerate(texts(40, 2, "\n")), *EDGE, (77, " ALPHA \nkeep\n\n")]
    counts = {}
    for _, t in rows:
        for k in {linededup.line_key(x) for x in (t or "").encode().split(b"\n")} - {b""}:
            counts[k] = counts.get(k, 0) + 1
    want = []
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if counts.get(linededup.line_key(x), 0) < 10]
        want.append((d, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    out = linededup.line_dedup(docs(spark, rows), most_bits=1 << 12, broadcast_keys=broadcast)
    assert order((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == order(want)
    assert out.columns == ["doc_id", "text", "score", "n_lines", "n_dropped"]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup_keeps_one_first(spark, broadcast):
    rows = [(5, "alpha\nown"), (5, "alpha\nown"), (5, "Alpha\nalpha"), (3, "beta"), (None, "beta\ngamma"), (None, "gamma"), *[(i, "alpha\nbeta") for i in range(10, 14)], (None, "gamma"), (None, None)]
    out = linededup.line_dedup(docs(spark, rows), min_docs=3, keep_first=True, broadcast_keys=broadcast, most_bits=1 << 12).collect()
    kept = [(r.doc_id, x.lower()) for r in out for x in (r.text or "").split("\n") if x.lower() in ("alpha", "beta", "gamma")]
    assert order(kept) == order([(5, "alpha"), (3, "beta"), (None, "gamma")])
    assert len(out) == len(rows) and sum((r.text or "").count("own") for r in out) == 2


def test_filters_grow_with_lines(spark):
    few, many = docs(spark, [(1, "a\nb"), (2, None)]), docs(spark, [(i, "a\nb\nc") for i in range(3000)])
    assert linededup.filter_bits(few, 1 << 30, 64) == 512 and linededup.filter_bits(many, 1 << 30, 64) == 1 << 17 and linededup.filter_bits(many, 1 << 12, 64) == 1 << 12
    assert linededup.line_dedup(few.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    items = [(1, " ".join(WORDS * 3)), (2, "zeta eta"), (3, ""), (4, None), (None, "eps eps"), (10, "theta, theta"), (10, "theta, theta")]
    rows = [*enumerate(texts(40, 8)), *EDGE, (88, "x " + " ".join(WORDS * 2) + " y")]
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    want = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            k = min(13, len(v))
            for i in range(len(w) - k + 1 if k else 0):
                if any(w[i : i + k] == v[j : j + k] for j in range(len(v) - k + 1)):
                    hit |= set(range(i, i + k))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
        want.append((d, len(w), len(hit), len(found - {None}), digest, bool(hit) and 20 * len(hit) >= len(w)))
    out = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert order((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()) == order(want)
