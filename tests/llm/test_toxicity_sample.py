"""The sample of labelled rows goes on past long texts."""

import random

import pytest
from pyspark.sql import functions as F

from cinnabar.llm.toxicity import drop_toxic, toxicity

SCHEMA = "doc_id long, text string"
BYTES = 64 << 10


def table_of(n=240):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        own = [f"w{rnd.randrange(300)}" for _ in range(20)] + (["vile", "nasty", f"slur{rnd.randrange(4)}"] if bad else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.mark.parametrize("place", ["first", "middle", "all"])
def test_long_texts_do_not_end_the_sample(spark, place):
    rows, labels = table_of()
    by_hash = [r[0] for r in spark.createDataFrame(labels, "doc_id long, toxic int").select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    long_ = {"first": by_hash[:3], "middle": by_hash[40:60:7], "all": by_hash}[place]
    rows = [(i, t + " w1 w2 w3" * (BYTES // 8 if i in long_ else 0)) for i, t in rows] if place != "all" else [(i, t + " w1" * BYTES) for i, t in rows[:6]]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[: len(rows)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(docs, marks, train_bytes=BYTES).collect()}
    assert len(got) == len(rows)
    if place == "all":
        assert len({r.score for r in toxicity(docs, marks, train_bytes=BYTES).collect()}) == 1
    else:
        usual = [i for i, _ in rows if i not in long_]
        assert sum(got[i] == (i % 3 == 0) for i in usual) > 0.97 * len(usual)
        kept = {r.doc_id for r in drop_toxic(docs, marks, train_bytes=BYTES).collect()}
        assert len([i for i in usual if i % 3 == 0 and i in kept]) <= 2 and len([i for i in usual if i % 3 and i not in kept]) <= 2


def test_byte_bound_still_holds(spark):
    rows, labels = table_of()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    from cinnabar.llm.store import Store
    from cinnabar.llm.toxicity import _sample

    train, share = _sample(docs, marks, 20_000, 4096, Store(spark, "test"))
    own = train.selectExpr("sum(octet_length(text)) AS n", "avg(toxic) AS share").first()
    assert 2048 < own.n <= 4096 and abs(own.share - share) < 1e-9
    few, _ = _sample(docs, marks, 20_000, 10, Store(spark, "test"))
    assert few.count() == 0
