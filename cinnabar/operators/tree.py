"""Analytics of search trees: nodes (node_id, parent_id, prob, visits, total_value, solved); the root's parent is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import Stage


def _split(stage: Stage, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that have children, and of leaves; the rounds need the first only, which are few in a tree that branches."""
    parents = own.select(F.col("parent_id").alias("node_id")).distinct().withColumn("_inner", F.lit(True))
    own = stage.put(own.join(parents, "node_id", "left"), "own")
    return own.where("_inner").drop("_inner"), own.where("_inner IS NULL").drop("_inner")


def along(nodes: DataFrame, value: Column | None = None) -> DataFrame:
    """(node_id, depth, length, total): of each node its distance to the root, and over the way from the root to it, both included,
    the number of nodes and the sum of value.

    Ways double in each round, so a tree of depth d takes about log d rounds of one row a node with children; leaves take theirs from
    their parents in the end. A node whose parent isn't in the table is a root. Each round is written, which cuts the lineage.
    """
    stage = Stage(nodes.sparkSession, "along")
    own, leaves = _split(stage, nodes.select("node_id", "parent_id", (F.lit(0.0) if value is None else value).cast("double").alias("total")))
    known = own.select(F.col("node_id").alias("parent_id"), F.col("node_id").alias("up"))
    # up: the node above the part of the way that total and length cover
    state = stage.put(own.join(known, "parent_id", "left").select("node_id", "up", F.lit(1).cast("long").alias("length"), "total"), "0")
    i = 0
    while state.where("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("length").alias("_length"), F.col("total").alias("_total"))
        done = state.where("up IS NULL")
        more = state.where("up IS NOT NULL").join(above, "up").select("node_id", F.col("_up").alias("up"), (F.col("length") + F.col("_length")).alias("length"), (F.col("total") + F.col("_total")).alias("total"))
        state = stage.put(done.unionByName(more), str(i + 1))
        stage.drop(str(i))
        i += 1
    above = state.select(F.col("node_id").alias("parent_id"), F.col("length").alias("_length"), F.col("total").alias("_total"))
    last = leaves.join(above, "parent_id", "left").select("node_id", (F.coalesce("_length", F.lit(0)) + 1).alias("length"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"))
    return state.select("node_id", "length", "total").unionByName(last).select("node_id", (F.col("length") - 1).alias("depth"), "length", "total")


def below(nodes: DataFrame, value: Column) -> DataFrame:
    """(node_id, total): the sum of value over each node and all nodes below it, by rounds as in along; leaves are added to their parents first."""
    stage = Stage(nodes.sparkSession, "below")
    own, leaves = _split(stage, nodes.select("node_id", "parent_id", value.cast("long").alias("total")))
    known = own.select(F.col("node_id").alias("parent_id"), F.col("node_id").alias("up"))
    ends = leaves.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("total").alias("_ends"))
    first = own.join(ends, "node_id", "left").withColumn("total", F.col("total") + F.coalesce("_ends", F.lit(0)))
    state = stage.put(first.join(known, "parent_id", "left").select("node_id", "up", "total"), "0")
    i = 0
    while state.where("up IS NOT NULL").limit(1).count():
        # total covers the nodes up to 2^i - 1 steps below; those of the nodes 2^i steps below are added
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node_id")).agg(F.sum("total").alias("_given"))
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"))
        open_ = state.where("up IS NOT NULL").join(above, "up").select("node_id", "_up", "total")
        moved = open_.unionByName(state.where("up IS NULL").select("node_id", F.col("up").alias("_up"), "total")).join(given, "node_id", "left")
        state = stage.put(moved.select("node_id", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_given", F.lit(0))).alias("total")), str(i + 1))
        stage.drop(str(i))
        i += 1
    return state.select("node_id", "total").unionByName(leaves.select("node_id", "total"))


def walks(nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(leaf, node_id, hop): every node on the way from each start node (all by default) to the root; as many rounds as ways are long."""
    stage = Stage(nodes.sparkSession, "walks")
    own = nodes.select("node_id", "parent_id")
    front = stage.put((nodes if start is None else start).select(F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("hop")).join(own, "node_id"), "0")
    out, i = front, 0
    while front.limit(1).count():
        i += 1
        step = front.select("leaf", F.col("parent_id").alias("node_id"), (F.col("hop") + 1).alias("hop")).join(own, "node_id")
        front = stage.put(step, str(i))
        out = out.unionByName(front)
    return out.select("leaf", "node_id", "hop")


def depths(nodes: DataFrame) -> DataFrame:
    return along(nodes).select("node_id", "depth")


def route_scores(nodes: DataFrame) -> DataFrame:
    """Of each solved node the sum of values on its path over the squared length."""
    way = along(nodes, F.col("total_value")).join(nodes.where("solved").select("node_id"), "node_id")
    return way.select("node_id", F.round(F.col("total") / F.pow(F.col("length"), F.lit(2)), 9).alias("score"), "length")


def selection_scores(nodes: DataFrame, c: float) -> DataFrame:
    """Upper confidence scores of all nodes below a parent: uct and puct."""
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("pv"))
    explore = c * F.sqrt("pv") / (F.col("visits") + 1)
    return nodes.join(parent, "parent_id").select("parent_id", "node_id", F.round(F.col("total_value") + explore, 9).alias("uct"), F.round(F.col("total_value") + F.col("prob") * explore, 9).alias("puct"))


def select_child(scores: DataFrame, score: str = "uct") -> DataFrame:
    """The best child of each parent; of equals the smallest id."""
    return scores.groupBy("parent_id").agg(F.max_by("node_id", F.struct(F.col(score), -F.col("node_id"))).alias("child"), F.max(score).alias("best"))


def rule_ranks(nodes: DataFrame) -> DataFrame:
    """1 + the number of siblings with a strictly higher probability."""
    return nodes.select("node_id", "parent_id", F.rank().over(Window.partitionBy("parent_id").orderBy(F.desc("prob"))).cast("long").alias("rule_rank"))


def branching(nodes: DataFrame) -> DataFrame:
    """By depth, expanded nodes and their mean number of children."""
    children = nodes.groupBy("parent_id").agg(F.count("*").alias("k")).withColumnRenamed("parent_id", "node_id")
    return depths(nodes).join(children, "node_id").groupBy("depth").agg(F.count("*").alias("nodes"), F.round(F.avg("k"), 2).alias("mean_children"))


def visit_backup(nodes: DataFrame) -> DataFrame:
    """How many walks from leaves pass each node."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).distinct().withColumn("_p", F.lit(True))
    marked = nodes.join(parents, "node_id", "left")
    return below(marked, F.when(F.col("_p").isNull(), 1).otherwise(0)).withColumnRenamed("total", "walks")


def percentile_keep(nodes: DataFrame, ratio: float) -> DataFrame:
    """Children whose value reaches the element int(ratio * (n - 1)) of their siblings' ascending values."""
    by = Window.partitionBy("parent_id")
    placed = nodes.select("parent_id", "node_id", "total_value", (F.row_number().over(by.orderBy("total_value", "node_id")) - 1).alias("_at"), F.count("*").over(by).alias("_n"))
    cut = F.max(F.when(F.col("_at") == F.floor(F.lit(ratio) * (F.col("_n") - 1)), F.col("total_value"))).over(by)
    return placed.withColumn("cut", cut).where("total_value >= cut").select("parent_id", "node_id", "total_value", "cut")


def beam(frontier: DataFrame, by: str, score: str, width: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "node_id")
    return frontier.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= width)


# --- values, selection and statistics -------------------------------------------------------


def rescaled(value: Column, low: float, high: float) -> Column:
    """value's place between low and high, held within 0 and 1; 0 if they are equal."""
    return F.lit(0.0) if low == high else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def value_rule(nodes: DataFrame) -> DataFrame:
    """The selection score that looks at first values only: init_value / (visits + 1)."""
    return nodes.withColumn("score", F.col("init_value") / (F.col("visits") + 1))


def mean_backup(total: Column, visits: Column, value: Column) -> Column:
    """A node's running mean after one more value."""
    return (total * visits + value) / (visits + 1)


def running_values(updates: DataFrame, start: float = 0.0) -> DataFrame:
    """Of ordered updates (node_id, seq, value) the running mean and sum after each; the mean starts from no visits."""
    w = Window.partitionBy("node_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return updates.select("node_id", "seq", F.avg("value").over(w).alias("mean"), (F.lit(start) + F.sum("value").over(w)).alias("cumulative"))


def child_values(nodes: DataFrame, kind: str = "max") -> DataFrame:
    """(parent_id, value): the largest or mean first value of a node's children."""
    if kind not in ("max", "average"):
        raise ValueError("kind is max or average")
    return nodes.groupBy("parent_id").agg((F.max if kind == "max" else F.avg)("init_value").alias("value"))


def part_value(values: Column) -> Column:
    """A node's value over its open parts: the least, 1 if there is none."""
    return F.coalesce(F.array_min(values), F.lit(1.0))


def scaled_prior(prob: Column, sizes: Column, min_mol_size: int = 6) -> Column:
    """prob times the number of parts above a size."""
    return prob * F.size(F.filter(sizes, lambda s: s > min_mol_size))


def mixed_priority(prob: Column, priority: Column, fraction: float) -> Column:
    return (1 - fraction) * prob + fraction * priority


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def frontier(nodes: DataFrame, by: str, score: str) -> DataFrame:
    """Open nodes with their place: highest score first, then smallest id."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "node_id")).cast("long"))


def applicability(stats: DataFrame) -> DataFrame:
    """Rules that worked over rules tried, 0 if none was tried."""
    rate = F.coalesce(F.col("total_rules_succeeded") / F.when(F.col("total_rules_tried") != 0, F.col("total_rules_tried")), F.lit(0.0))
    return stats.withColumn("rule_applicability_rate", F.round(rate, 4))


def new_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes (node_id, seq, product) that have a product no earlier outcome of the node had; products one a row."""
    first = outcomes.groupBy("node_id", "product").agg(F.min("seq").alias("_first"))
    return outcomes.join(first, ["node_id", "product"]).groupBy("node_id", "seq").agg(F.bool_or(F.col("seq") == F.col("_first")).alias("_new")).where("_new").select("node_id", "seq")


def without_cycles(outcomes: DataFrame, products: str, ancestors: str) -> DataFrame:
    """Outcomes none of whose products is an ancestor."""
    return outcomes.where(~F.coalesce(F.arrays_overlap(products, ancestors), F.lit(False)))


def redundant(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with same_as: the first node with the same open parts, null for that one itself and for nodes without any."""
    first = nodes.where(F.col(key) != "").groupBy(key).agg(F.min("node_id").alias("_first"))
    return nodes.join(first, key, "left").withColumn("same_as", F.when(F.col("_first") != F.col("node_id"), F.col("_first"))).drop("_first")


def found_by_quarter(found: DataFrame, iterations: str = "iterations", at: str = "iteration") -> DataFrame:
    """(target_id, q1..q4): routes found in each quarter of the iterations."""
    quarter = F.least(F.floor((F.col(at) - 1) * 4 / F.col(iterations)), F.lit(3))
    return found.groupBy("target_id").agg(*(F.count_if(quarter == i).alias(f"q{i + 1}") for i in range(4)))


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """(target_id, num_nodes, num_routes, solved, tree_depth, max_branching_factor, mean_branching_factor) of node tables
    (target_id, node_id, parent_id, depth, is_expanded, is_solved); expanded nodes without children count as 0."""
    children = nodes.groupBy("target_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_k"))
    own = nodes.join(children, ["target_id", "node_id"], "left")
    k = F.when(F.col("is_expanded"), F.coalesce("_k", F.lit(0)))
    return own.groupBy("target_id").agg(
        F.count("*").alias("num_nodes"), F.count_if("is_solved").alias("num_routes"), F.coalesce(F.bool_or("is_solved"), F.lit(False)).alias("solved"), F.max("depth").alias("tree_depth"),
        F.coalesce(F.max(k), F.lit(0)).alias("max_branching_factor"), F.coalesce(F.round(F.avg(k), 2), F.lit(0.0)).alias("mean_branching_factor"),
    )


def winning_summary(nodes: DataFrame) -> DataFrame:
    """(best_score, mean_rank) over all solved nodes: the best route score, and the mean rank of the rules on their ways."""
    nodes = nodes.select("node_id", "parent_id", "total_value", "solved", F.rank().over(Window.partitionBy("parent_id").orderBy(F.desc("prob"))).cast("long").alias("rule_rank"))
    nodes = Stage(nodes.sparkSession, "winning").put(nodes, "nodes")
    # each solved node counts every node on its way once, so a node counts as often as solved nodes lie at or below it
    passes = below(nodes, F.col("solved").cast("int")).where("total > 0")
    below_root = nodes.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id", "rule_rank")
    mean = below_root.join(passes, "node_id").agg((F.sum(F.col("rule_rank") * F.col("total")) / F.sum("total")).alias("m"))
    best = route_scores(nodes).agg(F.max("score").alias("b"))
    return best.crossJoin(mean).select(F.round("b", 6).alias("best_score"), F.round("m", 2).alias("mean_rank"))  # one row each
