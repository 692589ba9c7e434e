"""Building-block stock, severities of competing sites, and route scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import placed

PENALTY = {"compatible": 0.0, "competing": 0.5, "incompatible": 1.0}


def in_stock(molecules: DataFrame, stock: DataFrame, key: str, size: str, min_size: int) -> DataFrame:
    """Adds in_stock: small enough or in the stock; Spark broadcasts the stock if its size allows."""
    marked = molecules.join(stock.select(key).distinct().withColumn("_s", F.lit(True)), key, "left")
    return marked.withColumn("in_stock", (F.col(size) <= min_size) | F.col("_s").isNotNull()).drop("_s")


def solved(parts: DataFrame, target: str) -> DataFrame:
    """Targets all of whose parts are in stock."""
    return parts.groupBy(target).agg(F.bool_and("in_stock").alias("solved"), F.count("*").alias("parts"))


def severity(level: Column) -> Column:
    return F.when(level == 2, "incompatible").when(level == 1, "competing").otherwise("compatible")


def penalty(label: Column) -> Column:
    return F.when(label == "incompatible", PENALTY["incompatible"]).when(label == "competing", PENALTY["competing"]).otherwise(PENALTY["compatible"])


def lookup(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Severity of (competing_fg, reacting_fg); a pair the matrix lacks is compatible."""
    return pairs.join(matrix, ["competing_fg", "reacting_fg"], "left").withColumn("severity", severity(F.coalesce("level", F.lit(0)))).drop("level")


def competing_sites(routes: DataFrame, interactions: DataFrame, halogens: DataFrame) -> DataFrame:
    """max(1 - (sum of each step's worst penalty + halogens) / max(steps, 1), 0) of each of routes (route_id, n_steps).

    All steps count, those without interactions too; a route without any keeps its halogens' penalty.
    """
    worst = interactions.groupBy("route_id", "step_id").agg(F.max(penalty(F.col("severity"))).alias("_w"))
    sums = worst.groupBy("route_id").agg(F.sum("_w").alias("_w"))
    both = routes.select("route_id", "n_steps").join(sums, "route_id", "left").join(halogens.select("route_id", F.col("halogens").alias("_h")), "route_id", "left")
    lost = F.coalesce("_w", F.lit(0.0)) + F.coalesce("_h", F.lit(0.0))
    return both.select("route_id", F.round(F.greatest(1 - lost / F.greatest("n_steps", F.lit(1)), F.lit(0.0)), 6).alias("score"))


def rank_routes(routes: DataFrame, scores: DataFrame, weight: float) -> DataFrame:
    """(route_id, original, site_score, combined, place): (1 - weight) * normalised original + weight * site score, best first, equal
    ones in the order of route_id; missing scores are 0, a top score of 0 or less normalises by 1.

    Places come from a range sort and a count per partition, so no task sees all routes.
    """
    top = routes.agg(F.max("original").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("m"))
    both = routes.select("route_id", "original").join(scores.select("route_id", F.col("score").alias("_s")), "route_id", "left").crossJoin(F.broadcast(top))  # one row
    site = F.coalesce("_s", F.lit(0.0))
    mixed = both.select("route_id", "original", site.alias("site_score"), F.round((1 - weight) * F.col("original") / F.col("m") + weight * site, 6).alias("combined"))
    return placed(mixed, [F.desc("combined"), F.asc("route_id")], "place", 1)


def rescored(original: Column, site: Column, weight: float | None = None) -> Column:
    """original * site, or original * ((1 - weight) + weight * site)."""
    return original * site if weight is None else original * ((1 - weight) + weight * site)


def kinds(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("route_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in PENALTY))


def reacting_group(matches: DataFrame) -> DataFrame:
    """Of each step the group that overlaps the centre most; of equals the first."""
    return matches.groupBy("step_id").agg(F.max_by("name", F.struct("overlap", -F.col("place"))).alias("reacting_fg"), F.max("overlap").alias("overlap"))
