"""Training of a softmax policy over whole tables: gradients of shards added up by a tree of tasks, a plateau schedule, states to resume from.

Examples are written once; an epoch reads them, each Arrow batch adds to its partition's gradient, and partitions' gradients are rows of (class,
feature, value) that are added up in two hops. Values are fixed-point numbers, so their sum doesn't depend on the order in which tasks end, and a
job that was killed gives the same weights when it is called again with the same folder. The driver holds the model alone, whose size is checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import Stage

SCALE = 2.0**50  # of sums of shares; a total beyond 2^13 overflows, which is an error
STATE = "epoch int, rate double, best double, wait int, weights array<double>, mean array<double>, spread array<double>, chosen array<double>, history array<struct<epoch:int,loss:double,val_loss:double,val_accuracy:double,rate:double>>, settings string"
LOSS, VAL_LOSS, VAL_HITS = -1, -2, -3  # classes of sums that belong to no class


def _sums(weights, n_train: int, n_val: int, fan_in: int):
    """A function of batches of (x, y, val): (class, feature, branch, value) of the partition, values as fixed-point shares."""
    classes, size = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gradient, loss, val_loss, hits, seen = np.zeros_like(weights), 0.0, 0.0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            lists = batch.column(0)
            if set(np.diff(lists.offsets.to_numpy())) != {size - 1}:
                raise ValueError(f"each example needs {size - 1} features")
            x = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, size - 1)
            x = np.hstack([x, np.ones((len(x), 1))])
            y, val = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if y.min() < 0 or y.max() >= classes:
                raise ValueError(f"labels must lie in 0 to {classes - 1}")
            z = x @ weights.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            own = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))
            loss, val_loss = loss + own[~val].sum(), val_loss + own[val].sum()
            hits += int((p[val].argmax(axis=1) == y[val]).sum())
            p[np.arange(len(y)), y] -= 1
            gradient += p[~val].T @ x[~val]
        if not seen:
            return
        c, f = np.indices(weights.shape).reshape(2, -1)
        values = np.concatenate([gradient.ravel() / max(n_train, 1), [loss / max(n_train, 1), val_loss / max(n_val, 1), hits / max(n_val, 1)]])
        if not np.isfinite(values).all() or np.abs(values).max() >= 2.0**12:
            raise ValueError("a partition's sum of gradients is no number or too large; scale the features")
        branch = TaskContext.get().partitionId() // fan_in
        columns = [np.concatenate([c, [LOSS, VAL_LOSS, VAL_HITS]]), np.concatenate([f, [0, 0, 0]]), np.full(len(values), branch), np.rint(values * SCALE)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(t)) for a, t in zip(columns, ("int32", "int32", "int32", "int64"), strict=True)], ["class", "feature", "branch", "value"])

    return run


def gradient(examples: DataFrame, weights: np.ndarray, n_train: int, n_val: int, fan_in: int = 64) -> DataFrame:
    """(class, feature, value): the mean gradient at weights (the last feature is the bias), and rows of LOSS, VAL_LOSS and VAL_HITS."""
    parts = examples.mapInArrow(_sums(weights, n_train, n_val, fan_in), "class int, feature int, branch int, value long")
    hop = parts.groupBy("class", "feature", "branch").agg(F.sum("value").alias("value"))
    return hop.groupBy("class", "feature").agg((F.sum("value") / F.lit(SCALE)).alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the table at path was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _step(state: dict, g: np.ndarray, clip: float, betas: tuple[float, float], eps: float) -> None:
    """One step of belief-adapted moments: the spread is that of gradients about their running mean."""
    norm = float(np.sqrt((g * g).sum()))
    if norm > clip:
        g = g * (clip / norm)
    state["epoch"] += 1
    state["mean"] = betas[0] * state["mean"] + (1 - betas[0]) * g
    state["spread"] = betas[1] * state["spread"] + (1 - betas[1]) * (g - state["mean"]) ** 2 + eps
    mean, spread = state["mean"] / (1 - betas[0] ** state["epoch"]), state["spread"] / (1 - betas[1] ** state["epoch"])
    state["weights"] = state["weights"] - state["rate"] * mean / (np.sqrt(spread) + eps)


def train(
    rows: DataFrame, features: str, label: str, val: str, classes: int, size: int, epochs: int, path: str | None = None, rate: float = 0.01,
    patience: int = 3, factor: float = 0.8, min_rate: float = 5e-5, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, most_values: int = 4_000_000, start: np.ndarray | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((class, feature, weight), (epoch, loss, val_loss, val_accuracy, rate)): the weights of least validation loss (of training loss if no row
    validates), feature `size` being the bias, and the losses before each step and after the last.

    rows: features an array of `size` numbers, label 0 to classes - 1, val whether the row validates (null: it trains). path: a shared folder; a call
    that finds states of the same settings there goes on after the last, and doesn't read rows again. The rate falls by factor when the
    loss hasn't fallen by a ten-thousandth for more than patience epochs. A model of more than most_values weights is an error, since every task gets it.
    start: weights of classes rows and size + 1 columns to begin with, else zeros.

    Defined cases: rows without features or label are no rows, a null number counts 0; other lengths or labels are errors; repeated rows
    count as often; extra columns don't matter; without rows that train, weights stay those at the start.
    """
    if classes * (size + 1) > most_values:
        raise ValueError(f"{classes * (size + 1)} weights, at most {most_values} are sent to each task")
    spark, stage = rows.sparkSession, Stage(rows.sparkSession, "training")
    stage.path = path or stage.path
    settings = repr((classes, size, rate, patience, factor, min_rate, clip, betas, eps))
    wanted = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    wanted = wanted.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), F.coalesce(F.col(val).cast("boolean"), F.lit(False)).alias("val"))
    if not exists(spark, f"{stage.path}/examples"):
        stage.put(wanted, "examples")
    examples = spark.read.schema(T.StructType(wanted.schema.fields)).parquet(f"{stage.path}/examples")
    n_train, n_val = examples.agg(F.count_if(~F.col("val")), F.count_if("val")).first()

    zeros = np.zeros((classes, size + 1))
    first = zeros if start is None else np.asarray(start, float).reshape(zeros.shape)
    if first.any():
        settings += f" from {hashlib.sha256(first.tobytes()).hexdigest()}"
    state = {"epoch": 0, "rate": rate, "best": float("inf"), "wait": 0, "weights": first, "mean": zeros, "spread": zeros, "chosen": first, "history": []}
    last = max((e for e in range(1, epochs + 1) if exists(spark, f"{stage.path}/epoch-{e}")), default=0)
    if last:
        state = spark.read.parquet(f"{stage.path}/epoch-{last}").first().asDict()
        if state.pop("settings") != settings:
            raise ValueError(f"{stage.path} holds states of other settings")
        state |= {k: np.array(state[k]).reshape(zeros.shape) for k in ("weights", "mean", "spread", "chosen")}
        state["history"] = [tuple(h) for h in state["history"]]
    while n_train:
        found = {(r["class"], r["feature"]): r["value"] for r in gradient(examples, state["weights"], n_train, n_val).collect()}  # as many as weights
        loss, val_loss, hits = (found.pop((c, 0)) for c in (LOSS, VAL_LOSS, VAL_HITS))
        state["history"].append((state["epoch"], loss, val_loss if n_val else None, hits if n_val else None, state["rate"]))
        seen = val_loss if n_val else loss
        if seen < min((h[2] if n_val else h[1] for h in state["history"][:-1]), default=float("inf")):
            state["chosen"] = state["weights"]
        if state["epoch"]:  # the schedule looks at what a step led to
            if seen < state["best"] * (1 - 1e-4):
                state["best"], state["wait"] = seen, 0
            else:
                state["wait"] += 1
            if state["wait"] > patience:
                state["rate"], state["wait"] = max(state["rate"] * factor, min_rate), 0
        if state["epoch"] >= epochs:
            break
        g = np.zeros_like(zeros)
        for (c, f), v in found.items():
            g[c, f] = v
        _step(state, g, clip, betas, eps)
        row = {**state, **{k: state[k].ravel().tolist() for k in ("weights", "mean", "spread", "chosen")}, "settings": settings}
        stage.put(spark.createDataFrame([tuple(row[f.split()[0]] for f in STATE.split(", "))], STATE).coalesce(1), f"epoch-{state['epoch']}")
        if state["epoch"] > 2:
            stage.drop(f"epoch-{state['epoch'] - 2}")
    weights = [(c, f, float(state["chosen"][c, f])) for c in range(classes) for f in range(size + 1)]
    model = spark.createDataFrame(weights, "class int, feature int, weight double")
    return model, spark.createDataFrame(state["history"], "epoch int, loss double, val_loss double, val_accuracy double, rate double")
