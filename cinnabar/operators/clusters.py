"""Route clusters and sequences of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusters(routes: DataFrame, key: str, n_bonds: str) -> DataFrame:
    """Routes of equal key; numbered within each bond count by key length, then key."""
    grouped = routes.groupBy(n_bonds, key).agg(F.sort_array(F.collect_list("route_id")).alias("ids"), F.count("*").alias("group_size"))
    order = Window.partitionBy(n_bonds).orderBy(F.length(key), key)
    named = F.concat_ws(".", F.col(n_bonds).cast("string"), F.row_number().over(order).cast("string"))
    return grouped.select(named.alias("cluster_key"), F.col(key), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("route_ids"), "group_size")


def subclusters(routes: DataFrame, cluster: str, signature: str) -> DataFrame:
    """Within a cluster, routes of equal signature, numbered by falling size, then least route."""
    grouped = routes.groupBy(cluster, signature).agg(F.count("*").alias("group_size"), F.min("route_id").alias("first_route"))
    order = Window.partitionBy(cluster).orderBy(F.desc("group_size"), "first_route")
    return grouped.withColumn("sub_id", F.row_number().over(order).cast("long"))


def step_pairs(steps: DataFrame, route: str, step: str, value: str) -> DataFrame:
    """Each step beside the next of its route."""
    w = Window.partitionBy(route).orderBy(step)
    return steps.select(route, step, F.col(value).alias("from_value"), F.lead(value).over(w).alias("to_value")).where(F.col("to_value").isNotNull())


def prior_step(steps: DataFrame, key: str, order: str) -> DataFrame:
    """The latest earlier step with the same key; null at first."""
    return steps.withColumn("prior", F.max(order).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow - 1)))


# --- leaving groups: rows (route_id, mark, lg), a group's mark on a route ----------------------


def distinct_groups(lgs: DataFrame) -> DataFrame:
    """(mark, lg, first_route): each leaving group of a mark once, with the first route that has it."""
    return lgs.groupBy("mark", "lg").agg(F.min("route_id").alias("first_route"))


def signatures(lgs: DataFrame) -> DataFrame:
    """(route_id, signature): a route's marks and groups as one text; a route's groups are few by nature."""
    pairs = F.sort_array(F.collect_list(F.struct("mark", "lg")))
    return lgs.groupBy("route_id").agg(pairs.alias("_p")).select("route_id", F.array_join(F.transform("_p", lambda x: F.concat_ws("=", x.mark.cast("string"), x.lg)), ";").alias("signature"))


def identical(lgs: DataFrame) -> DataFrame:
    """(signature, group_size, first_route): routes with the same groups, largest first."""
    return signatures(lgs).groupBy("signature").agg(F.count("*").alias("group_size"), F.min("route_id").alias("first_route")).orderBy(F.desc("group_size"), "first_route")


def without_constant(lgs: DataFrame) -> DataFrame:
    """lgs without marks whose group is the same on all routes; the marks left are numbered from 1 in their order."""
    constant = lgs.groupBy("mark").agg(F.min("lg").alias("_a"), F.max("lg").alias("_b"))
    kept = constant.where("_a <> _b").select("mark", F.row_number().over(Window.orderBy("mark")).alias("_new"))  # a row a mark
    return lgs.join(F.broadcast(kept), "mark").select("route_id", F.col("_new").cast("long").alias("mark"), "lg")


def numbered_subclusters(routes: DataFrame, key: list[str], count: str) -> DataFrame:
    """(sub_id, key..., group_size, first_route): routes of equal key; numbered within each count of leaving groups by their first route."""
    grouped = routes.groupBy(*key, count).agg(F.count("*").alias("group_size"), F.min("route_id").alias("first_route"))
    place = F.row_number().over(Window.partitionBy(count).orderBy("first_route"))
    return grouped.select(F.concat_ws("_", F.col(count).cast("string"), place.cast("string")).alias("sub_id"), *key, "group_size", "first_route")


def without_routes(members: DataFrame, skip: DataFrame) -> DataFrame:
    """(cluster_key, route_id, group_size) of (cluster_key, route_id) less the routes of skip; clusters without a route vanish."""
    left = members.join(skip.select("route_id").distinct(), "route_id", "left_anti")
    return left.join(left.groupBy("cluster_key").agg(F.count("*").alias("group_size")), "cluster_key").select("cluster_key", "route_id", "group_size")


def membership(routes: DataFrame, key: str, n_bonds: str) -> DataFrame:
    """(route_id, cluster_key): as clusters, a row a route, so that no list grows with a cluster."""
    groups = routes.select(n_bonds, key).distinct()
    place = F.row_number().over(Window.partitionBy(n_bonds).orderBy(F.length(key), key))
    named = groups.withColumn("cluster_key", F.concat_ws(".", F.col(n_bonds).cast("string"), place.cast("string")))
    return routes.select("route_id", n_bonds, key).join(named, [n_bonds, key]).select("route_id", "cluster_key")
