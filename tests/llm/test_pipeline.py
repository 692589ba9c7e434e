"""The pipeline's stages and run() against plain versions, on a small corpus with rows without doc_id."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cinnabar.llm import queries

TOXIC = "grunk slarp vomp"
FREQUENT = [" ".join(f"site{i}{j}" for j in range(20)) for i in range(3)]


def corpus():
    r = random.Random(2)
    body = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    rows = [(100 + i, f"{body()} {TOXIC}") for i in range(30)] + [(200 + i, body()) for i in range(60)]
    one, two, three, item = body(), body(), body(), body()
    rows += [(1, f"{one} {TOXIC}"), (30, one)]  # the smaller id goes as toxic, so its near copy stays
    rows += [(5, two), (8, "\n".join([two, *FREQUENT]))]  # near copies only once frequent lines are gone
    rows += [(None, two), (None, three), (None, three), (None, f"{body()} {TOXIC}"), (None, body()), (None, ""), (None, None)]
    rows += [(300 + i, "\n".join([*FREQUENT, body()])) for i in range(11)]
    rows += [(40, f"{body()} {item}"), (None, f"{item} {body()}"), (41, None)]
    labels = [(i, int(TOXIC in t)) for i, t in rows if i is not None and i >= 100 and i < 300]
    return rows, labels, [(1, item), (2, None)]


def plain(rows, items):
    """What is left after each of the first four stages."""
    rows = [(i, t or "") for i, t in rows]
    out = [rows := [x for x in rows if TOXIC not in x[1]]]
    counts = {}
    for _, t in rows:
        for line in set(t.split("\n")) - {""}:
            counts[line] = counts.get(line, 0) + 1
    out.append(rows := [(i, "\n".join(x for x in t.split("\n") if counts.get(x, 0) < 10)) for i, t in rows])
    grams = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    group = list(range(len(rows)))
    own = [grams(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for k, (i, _) in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (2**63, k)), (2**63 if i is None else i, k))
    out.append(rows := [rows[k] for _, k in sorted(best.values(), key=lambda x: x[1])])
    windows = {tuple(w[j : j + 13]) for _, t in items for w in [re.findall("[a-z0-9]+", t or "")] for j in range(len(w) - 12)}

    def hit(t):
        w = t.split()
        return len({j + k for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for k in range(13)})

    out.append([(i, t) for i, t in rows if not hit(t) or 20 * hit(t) < len(t.split())])
    return out


def test_stages_and_run(spark, tmp_path):
    rows, labels, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    order = lambda x: sorted(x, key=repr)
    want = plain(rows, items)
    assert [len(x) for x in want] == [len(rows) - 32, len(rows) - 32, len(rows) - 35, len(rows) - 37]
    before = rows
    for (_, stage), after in zip(corpus_pipeline.STAGES, want, strict=False):
        got = stage(spark, spark.createDataFrame(before, "doc_id long, text string").repartition(3), d).collect()
        assert order((r.doc_id, r.text or "") for r in got) == order(after)
        before = after
    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    ids = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in before]
    got = corpus_pipeline.run(spark, d).collect()
    assert order((r.doc_id, r.length, r.ids_crc32) for r in got) == order((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
