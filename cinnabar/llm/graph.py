"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, store: Store, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the smallest node reachable.

    A star step replaces edges by edges to the least neighbour, so hubs never multiply edges; minima
    are pre-added before each shuffle and written, which lets the join that follows split hot hubs.
    Loops and repeated edges are fine; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = store.put(e, f"{name}-0")
    mark, i = _mark(e), 0
    while mark[0]:
        i += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.put(_least(both).select("u", F.least("u", "m").alias("m")), f"{name}-{i}-large")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.put(large, f"{name}-{i}-star")
        least = store.put(_least(large), f"{name}-{i}-small")
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = store.put(small, f"{name}-{i}")
        store.drop(f"{name}-{i - 1}", f"{name}-{i}-large", f"{name}-{i}-star", f"{name}-{i}-small")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return store.put(roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), f"{name}-roots")
