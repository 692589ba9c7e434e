"""Graph embeddings by message passing over atom and bond tables: a vertex program of send, add up, update and pool.

A layer joins bonds with the features of their ends, adds up what each atom is sent together with its own row, and applies given weights; all
graphs at once, one join and one aggregation a layer, nothing collected. Features are columns, so sums stay in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import Stage

Matrix = Sequence[Sequence[float]]


def _names(n: int, of: str = "x") -> list[str]:
    return [f"{of}{i}" for i in range(n)]


def _times(weights: Matrix, columns: list[Column], bias: Sequence[float]) -> list[Column]:
    """columns · weights + bias; weights: a row for each column."""
    return [sum((c * F.lit(float(row[j])) for c, row in zip(columns, weights, strict=True)), F.lit(float(bias[j]))) for j in range(len(bias))]


def _relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def features(atoms: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(graph, node, x0, ...): log(x + 1) of the columns; nulls count as 0."""
    return atoms.select("graph", "node", *(F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(n) for c, n in zip(columns, _names(len(columns)), strict=True)))


def _received(nodes: DataFrame, both: DataFrame, own: list[str], sent: list[str], *sums: Column) -> DataFrame:
    """(graph, node, own, sums) over the sent columns of each listed atom's neighbours; own columns are those of the atom, whose row is marked."""
    names = ["graph", "node", *own, *sent]
    given = nodes.select("graph", F.col("node").alias("b"), *sent)
    around = both.join(given, ["graph", "b"]).select("graph", F.col("a").alias("node"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in own), *sent, F.lit(False).alias("_listed"))
    rows = nodes.select(*names, F.lit(True).alias("_listed")).unionByName(around)
    return rows.groupBy("graph", "node").agg(F.max("_listed").alias("_listed"), *(F.max(c).alias(c) for c in own), *sums).where("_listed").drop("_listed")


def scaled(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """nodes with scale: 1 / sqrt(1 + bonds) of each atom, of bonds between listed atoms."""
    counted = _received(nodes, both, [c for c in nodes.columns if c not in ("graph", "node")], [], F.count("*").alias("_d"))
    return counted.withColumn("scale", 1 / F.sqrt(F.col("_d").cast("double"))).drop("_d")  # the atom's own row is the one that is added


def convolve(nodes: DataFrame, both: DataFrame, weights: Matrix, bias: Sequence[float]) -> DataFrame:
    """One layer over (graph, node, x0, ..., scale): relu of (normalised sum over neighbours and the atom itself) · weights + bias."""
    names, made = _names(len(weights)), _names(len(bias))
    inner = [F.col(n) * F.col("scale") for n in names]
    early = len(made) < len(names)  # sums of products are products of sums: the fewer columns are sent
    sent = _times(weights, inner, [0.0] * len(made)) if early else inner
    own = nodes.select("graph", "node", *(c.alias(n) for c, n in zip(sent, made if early else names, strict=True)), "scale")
    summed = _received(own, both, ["scale"], made if early else names, *(F.sum(n).alias(n) for n in (made if early else names)))
    if early:
        out = [F.col(n) * F.col("scale") + F.lit(float(x)) for n, x in zip(made, bias, strict=True)]
    else:
        out = _times(weights, [F.col(n) * F.col("scale") for n in names], bias)
    return summed.select("graph", "node", *(_relu(c).alias(n) for c, n in zip(out, made, strict=True)), "scale")


def embed(atoms: DataFrame, bonds: DataFrame, columns: Sequence[str], layers: Sequence[tuple[Matrix, Sequence[float]]], concat: bool = False) -> DataFrame:
    """(graph, x0, ...): the sum over a graph's atoms of the last layer's features, or of all layers' side by side if concat.

    atoms: (graph, node, columns); bonds: (graph, a, b), undirected. layers: (weights, bias) of each, weights with a row an input.

    Defined cases: repeated atoms or bonds and loops count once or not at all; bonds to atoms that aren't listed are no bonds; an atom
    without bonds keeps its own features; empty tables give no rows.
    """
    stage = Stage(atoms.sparkSession, "embedding")
    nodes = stage.put(features(atoms.dropDuplicates(["graph", "node"]), columns), "atoms")
    ends = bonds.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stage.put(ends.unionByName(ends.select("graph", F.col("b").alias("a"), F.col("a").alias("b"))), "bonds")
    nodes = stage.put(scaled(nodes, both), "0")
    seen = []
    for i, (weights, bias) in enumerate(layers, 1):
        nodes = stage.put(convolve(nodes, both, weights, bias), str(i))
        seen.append(nodes.groupBy("graph").agg(*(F.sum(n).alias(n) for n in _names(len(bias)))))
    if not concat or len(seen) < 2:
        return seen[-1] if seen else nodes.groupBy("graph").agg(*(F.sum(n).alias(n) for n in _names(len(columns))))
    out, at = None, 0
    for pooled, (_, bias) in zip(seen, layers, strict=True):
        pooled = pooled.select("graph", *(F.col(n).alias(f"x{at + i}") for i, n in enumerate(_names(len(bias)))))
        out, at = pooled if out is None else out.join(pooled, "graph"), at + len(bias)
    return out


def even_weights(inputs: int, outputs: int, seed: int = 0) -> tuple[list[list[float]], list[float]]:
    """Reproducible weights for trials: cosines of growing angles, scaled by the number of inputs, and no bias."""
    return [[math.cos(seed + 1.7 * i + 0.9 * j) / math.sqrt(inputs) for j in range(outputs)] for i in range(inputs)], [0.0] * outputs
