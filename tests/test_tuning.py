"""Value tuning in rounds: a crash between, rounds run twice, warm starts, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cinnabar.operators import training, tuning

DATA = "/root/testdata/sf0.001"


def weights(model):
    w = np.full((2, 4), np.nan)
    for c, f, v in model.select("class", "feature", "weight").collect():
        w[c, f] = v
    return w


@pytest.fixture(scope="module")
def bound(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    calls = []

    def plan(batch, value):
        """The customers' orders, of which the three of highest value are tried; at says which came last."""
        calls.append(sorted(r[0] for r in batch.select("round").distinct().collect()))
        own = orders.join(batch.select("o_custkey"), "o_custkey")
        own = own.withColumn("features", F.array(F.log("o_totalprice") / 10, F.month("o_orderdate") / 12, F.lit(None)))
        place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(value(F.col("features"))), "o_orderkey"))
        own = own.withColumn("place", place).where("place <= 3")
        return own.select(F.col("o_orderkey").alias("key"), "features", (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("place").alias("at"), F.lit("clash").alias("round"))

    customers = orders.select("o_custkey").union(orders.select("o_custkey"))
    return tuning.batches(customers, "o_custkey", 60).cache(), plan, calls


def test_batches_hold_each_target_once(spark, bound):
    rounds = bound[0].groupBy("round").agg(F.count("*").alias("n"), F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).orderBy("round").collect()
    assert [r.n for r in rounds[:-1]] == [60] * (len(rounds) - 1) and 0 < rounds[-1].n <= 60
    assert all(x.b < y.a for x, y in zip(rounds, rounds[1:]))
    assert tuning.batches(spark.createDataFrame([(None,), (3,), (3,)], "k int"), "k", 5).select("k", "round").collect() == [(3, 1)]


def test_a_crash_between_rounds_changes_nothing(spark, bound, tmp_path, monkeypatch):
    targets, plan, calls = bound
    own = targets.where("round <= 3")
    whole, figures = tuning.tune(own, plan, 3, f"file://{tmp_path}/a", epochs=2, rate=0.05)
    rows = figures.orderBy("round").collect()
    assert [r["round"] for r in rows] == [1, 2, 3] and calls == [[1], [2], [3]] and rows[0].positives * 2 >= rows[0].examples > 0 < rows[0].balanced_accuracy <= 1
    step, steps = training._step, []

    def killed(*args):
        steps.append(1)
        if len(steps) == 4:  # in the second round, after a step of it
            raise KeyboardInterrupt
        step(*args)

    calls.clear()
    monkeypatch.setattr(training, "_step", killed)
    with pytest.raises(KeyboardInterrupt):
        tuning.tune(own, plan, 3, f"file://{tmp_path}/b", epochs=2, rate=0.05)
    again, more = tuning.tune(own, plan, 3, f"file://{tmp_path}/b", epochs=2, rate=0.05)
    assert calls == [[1], [2], [3]]  # the second round's examples were kept, no round was planned twice
    assert np.array_equal(weights(again), weights(whole)) and more.orderBy("round").collect() == rows
    third, same = tuning.tune(own, plan, 3, f"file://{tmp_path}/b", epochs=2, rate=0.05)
    assert calls == [[1], [2], [3]] and same.count() == 3 and np.array_equal(weights(third), weights(whole))


def test_rounds_begin_with_the_weights_before(spark, bound):
    x = spark.createDataFrame([([1.0, 0.0, 0.0], i % 2, i % 3 == 0) for i in range(30)], "x array<double>, y int, val boolean")
    start = np.arange(8.0).reshape(2, 4) / 10
    model, history = training.train(x, "x", "y", "val", 2, 3, 0, start=start)
    assert np.allclose(weights(model), start) and history.count() == 1
    p = spark.range(1).select(tuning.value_of(start)(F.array(F.lit(1.0), F.lit(None), F.lit(2.0))).alias("p")).first().p
    assert abs(p - 1 / (1 + np.exp(-(0.4 + 0.8 + 0.4)))) < 1e-12


def test_odd_examples(spark):
    targets = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "t int, round int")
    rows = [(1, "a", [1.0], 0, 1), (1, "a", [1.0], 1, 2), (1, "b", [1.0], 1, 1), (1, "c", None, 1, 1), (1, None, [1.0], 1, 1), (1, "d", [1.0], None, 1), (3, "e", [1.0], 1, 1)]
    found = spark.createDataFrame(rows, "t int, key string, features array<double>, label int, at int")
    model, figures = tuning.tune(targets, lambda batch, value: found.join(batch.select("t"), "t"), 1, epochs=2, ratio=None, val_share=0.0)
    one, two = figures.orderBy("round").collect()
    assert (one.examples, one.positives, two.examples, two.loss) == (2, 2, 0, None)  # the later label of a; the second round has none
    assert model.where("class = 1 and feature = 0").first().weight > 0
    none, figures = tuning.tune(targets.limit(0), lambda batch, value: found, 1)
    assert figures.count() == 0 and none.count() == 4 and none.where("weight <> 0").count() == 0
    with pytest.raises(Exception, match="features"):
        tuning.tune(targets, lambda batch, value: found, 2, epochs=1)
