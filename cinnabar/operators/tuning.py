"""Tuning of a value function in rounds over tables of versioned states: plan a batch of targets, keep what the plans teach, train on.

Round r is three tables below one shared folder: its examples, its weights and its figures. Each is written once, when what it builds on is there, and a table
that a killed job left unfinished is written anew; so a call with the folder of a killed one goes on where that stood and gives the same weights, and a
round that ends twice is there once. Plans and training are Spark jobs; the driver holds the weights alone, whose size `training.train` checks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import placed
from ..plans.stage import Stage
from . import learning, training
from .tree import sigmoid

FIGURES = "round int, targets long, examples long, positives long, loss double, val_loss double, accuracy double, balanced_accuracy double"


def batches(targets: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct targets with round, from 1: size of them a round in the order of key, the last may have fewer. Null keys are no targets."""
    own = targets.where(F.col(key).isNotNull()).dropDuplicates([key])
    return placed(own, [F.col(key)], "_place").withColumn("round", (F.floor(F.col("_place") / size) + 1).cast("int")).drop("_place")


def value_of(weights: np.ndarray) -> Callable[[Column], Column]:
    """A column function: the value (0 to 1) that two rows of weights, the last the bias, give to an array of features; a null number counts 0."""
    own = (weights[1] - weights[0]).tolist()

    def value(features: Column) -> Column:
        terms = F.zip_with(features, F.array(*map(F.lit, own[:-1])), lambda x, w: F.coalesce(x.cast("double"), F.lit(0.0)) * w)
        return sigmoid(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + F.lit(own[-1]))

    return value


def _done(stage: Stage, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The named table, which make gives unless it is there whole."""
    path = f"{stage.path}/{name}"
    return stage.spark.read.parquet(path) if training.exists(stage.spark, path) else stage.put(make(), name)


def tune(
    targets: DataFrame, plan: Callable[[DataFrame, Callable[[Column], Column]], DataFrame], size: int, path: str | None = None, epochs: int = 10, ratio: float | None = 1.0, val_share: float = 0.4,
    **schedule,
) -> tuple[DataFrame, DataFrame]:
    """((class, feature, weight), figures of each round): class 1 is solved, feature `size` is the bias; weights are those of the last round.

    targets: with a column round (see batches); rounds go in its order. plan(batch, value) plans the targets of a round, led by value, and
    gives examples: key, features (an array of `size` numbers), label (1: on a way that was solved), and val if it settles itself what validates.
    Of repeated keys the last label by column `at` counts, if there is one, else the greatest. ratio: about so many negatives as positives are
    kept, by hash of the key (None: all). Each round trains from the weights before it, which stay if nothing is better; schedule goes to training.train.
    path: a shared folder; rounds that are there are not run again.

    Defined cases: examples without key, features or label are none; other lengths and labels are errors; a round without examples keeps the weights;
    targets without a round are left out; no targets give weights of 0 and no figures; extra columns reach plan and don't matter.
    """
    spark, stage = targets.sparkSession, Stage(targets.sparkSession, "tuning")
    stage.path = path or stage.path
    dealt = _done(stage, "targets", lambda: targets.where(F.col("round").isNotNull()))
    sizes = {r["round"]: r["n"] for r in dealt.groupBy("round").agg(F.count("*").alias("n")).collect()}  # a row a round
    weights, figures, model = np.zeros((2, size + 1)), [], None

    def examples(batch: DataFrame) -> DataFrame:
        found = plan(batch, value_of(weights))
        at = F.col("at") if "at" in found.columns else F.col("label")
        own = F.col("val") if "val" in found.columns else F.lit(None)
        found = found.select("key", "features", F.col("label").cast("int").alias("label"), at.alias("at"), own.cast("boolean").alias("val")).where("key is not null and features is not null and label is not null")
        last = found.groupBy("key").agg(F.max_by(F.struct("features", "label", "val"), F.struct("at", "label", "features", "val")).alias("last")).select("key", "last.*")
        split = learning.random_split(last, "key", val_share).withColumn("val", F.coalesce("val", F.col("part") == "val")).drop("part")
        return split

    def counted(kept: DataFrame, r: int) -> DataFrame:
        """One row of figures by the round's weights."""
        scored = kept.withColumn("p", value_of(weights)(F.col("features"))).withColumn("guess", (F.col("p") >= 0.5).cast("int"))
        losses = [learning.binary_cross_entropy(F.when(where, F.col("p")), F.col("label")) for where in (~F.col("val"), F.col("val"))]
        row = scored.agg(F.count("*"), F.count_if(F.col("label") == 1), *losses).first()
        metrics = learning.class_metrics(scored.where("val"), "label", "guess").first()
        return spark.createDataFrame([(r, sizes[r], *row, metrics["accuracy"], metrics["balanced_accuracy"])], FIGURES).coalesce(1)

    for r in sorted(sizes):
        found = _done(stage, f"examples-{r}", lambda r=r: examples(dealt.where(F.col("round") == r)))
        kept = found if ratio is None else learning.balanced(found, "label", "key", ratio)
        start = weights
        model = _done(stage, f"weights-{r}", lambda r=r, start=start, kept=kept: training.train(
            kept, "features", "label", "val", 2, size, epochs, path=f"{stage.path}/training-{r}", start=start, **schedule)[0].coalesce(1))
        weights = np.zeros((2, size + 1))
        for row in model.collect():  # two rows of weights
            weights[row["class"], row["feature"]] = row["weight"]
        figures.append(_done(stage, f"figures-{r}", lambda r=r, kept=kept: counted(kept, r)))
    if model is None:
        return spark.createDataFrame([(c, f, 0.0) for c in range(2) for f in range(size + 1)], "class int, feature int, weight double"), spark.createDataFrame([], FIGURES)
    out = figures[0]
    for f in figures[1:]:
        out = out.unionByName(f)
    return model, out
