"""Training on sharded gradients against full-batch numpy, killed and resumed, and its schedule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinnabar.operators import training

DATA = "/root/testdata/sf0.001"


def plain(x, y, val, classes, epochs, rate, patience=3, factor=0.8, clip=1.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = m = s = np.zeros((classes, x.shape[1]))
    best, wait, history, chosen = np.inf, 0, [], w
    for t in range(epochs + 1):
        e = np.exp(x @ w.T)
        p = e / e.sum(axis=1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y])
        seen = loss[val].mean()
        if not history or seen < min(h[1] for h in history):
            chosen = w
        history.append((loss[~val].mean(), seen, rate))
        if t:
            best, wait = (seen, 0) if seen < best * (1 - 1e-4) else (best, wait + 1)
            if wait > patience:
                rate, wait = max(rate * factor, 5e-5), 0
        if t == epochs:
            return chosen, history
        g = (p - np.eye(classes)[y])[~val].T @ x[~val] / (~val).sum()
        g = g * min(1, clip / np.linalg.norm(g))
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * (g - m) ** 2 + 1e-8
        w = w - rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(s / (1 - 0.999 ** (t + 1))) + 1e-8)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("val", F.col("vec_id") % 5 == 0).withColumn("x", F.lit("clash")).repartition(5, "vec_id").cache()


def matrix(model, classes, size):
    w = np.full((classes, size), np.nan)
    for c, f, v in model.collect():
        w[c, f] = v
    return w


def test_weights_are_those_of_full_batch_numpy(spark, vectors):
    rows = vectors.collect()
    x, y, val = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]), np.array([r.val for r in rows])
    model, history = training.train(vectors, "embedding", "label", "val", 10, 64, 12, rate=0.3, patience=1)
    want, losses = plain(x, y, val, 10, 12, 0.3, patience=1)
    got = [tuple(r) for r in history.orderBy("epoch").collect()]
    assert np.abs(matrix(model, 10, 65) - want).max() < 1e-6
    assert np.allclose([(a, b, r) for _, a, b, _, r in got], losses, atol=1e-8) and got[-1][1] < got[0][1]
    assert got[-1][4] < 0.3  # the schedule took part


def test_killed_and_resumed(spark, vectors, tmp_path, monkeypatch):
    whole, _ = training.train(vectors, "embedding", "label", "val", 10, 64, 5, path=f"file://{tmp_path}/a")
    step, calls = training._step, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        step(*args)

    monkeypatch.setattr(training, "_step", killed)
    with pytest.raises(KeyboardInterrupt):
        training.train(vectors, "embedding", "label", "val", 10, 64, 5, path=f"file://{tmp_path}/b")
    again, history = training.train(vectors, "embedding", "label", "val", 10, 64, 5, path=f"file://{tmp_path}/b")
    assert len(calls) == 4 + 2 and history.count() == 6  # three steps were kept, two were left
    assert np.abs(matrix(again, 10, 65) - matrix(whole, 10, 65)).max() < 1e-12
    with pytest.raises(ValueError, match="settings"):
        training.train(vectors, "embedding", "label", "val", 10, 64, 5, path=f"file://{tmp_path}/b", rate=0.5)


def test_odd_rows(spark):
    rows = [([1.0, None], 0, None), ([0.0, 2.0], 1, False), (None, 1, False), ([1.0, 1.0], None, True)]
    df = spark.createDataFrame(rows, "f array<double>, l int, v boolean")
    model, history = training.train(df, "f", "l", "v", 2, 2, 3)
    w = matrix(model, 2, 3)
    assert w[0, 0] > 0 > w[1, 0] and history.where("val_loss is not null").count() == 0
    none, history = training.train(df.limit(0), "f", "l", "v", 2, 2, 3)
    assert (matrix(none, 2, 3) == 0).all() and history.count() == 0
    with pytest.raises(ValueError):
        training.train(df, "f", "l", "v", 3000, 3000, 1)
    with pytest.raises(Exception, match="features"):
        training.train(df, "f", "l", "v", 2, 3, 1)
