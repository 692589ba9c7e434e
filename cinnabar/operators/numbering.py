"""One numbering for all atoms of a route, and the groups that are left when bonds are cut, by components of edge tables.

A route's steps number their atoms on their own; pairs of atoms that are the same (a product's in one step, a reactant's in another) join
them. Edges are dealt by group over tasks that grow with the edges; a task joins the nodes of those it has, so a group that one task takes is done.
Groups of more than ``most`` edges are split among tasks, and what these leave is joined by alternating stars: an edge is replaced by edges to the
least neighbour, so edges never multiply at a hub, and least neighbours are added up before rows are shuffled. All routes are worked on at once; a
component never spans two routes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import arrow
from ..plans.order import placed
from ..plans.stage import Stage, parted, tasks


#: Edges of a group that one task takes at most, about.
GROUP_EDGES = 200_000


def _rank(column: pa.Array) -> np.ndarray:
    """Numbers from 0 without gaps that order and equal each other as the values do; nulls first."""
    if pa.types.is_struct(column.type):
        out = np.zeros(len(column), np.int64)
        for field in column.flatten():
            code = _rank(field)
            out = np.unique(out * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
        return out
    coded = column.dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(place) + 1)
    return np.unique(np.append(place, 0)[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)], return_inverse=True)[1]


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of n nodes the least that each is joined to by edges (u, v)."""
    root = np.arange(n)
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _contracted(batches):
    """Of a task's edges (g, a, b, whole) its nodes: (g, node, root, number, whole), root and number (of roots, from 1) within the task's edges of g."""
    parts = list(batches)
    if not parts:
        return
    g, a, b, whole = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(4))
    groups, nodes, whole = pa.concat_arrays([g, g]), pa.concat_arrays([a, b]), pa.concat_arrays([whole, whole])
    rank, code = _rank(groups), _rank(nodes)
    _, at, of = np.unique(rank * (code.max(initial=0) + 1) + code, return_index=True, return_inverse=True)
    root, own = _least(len(at), of[: len(a)], of[len(a) :]), rank[at]
    roots = np.cumsum(root == np.arange(len(at)))
    number = roots[root] - roots[np.searchsorted(own, own)] + 1  # a group's least node is a root
    for i in range(0, len(at), arrow.BATCH_ROWS):
        cut = slice(i, i + arrow.BATCH_ROWS)
        take = pa.array(at[cut])
        yield pa.RecordBatch.from_arrays([groups.take(take), nodes.take(take), nodes.take(pa.array(at[root[cut]])), pa.array(number[cut]), whole.take(take)], names=["g", "node", "root", "number", "whole"])


def _joined(stage: Stage, edges: DataFrame, group: str, a: str, b: str, most: int) -> tuple[DataFrame, bool]:
    """(g, node, root, number, whole) by _contracted, over tasks that grow with the edges, and whether groups of more than so many edges were split among tasks."""
    arrow.ship(stage.spark)
    e = stage.put(edges.select(F.col(group).alias("g"), F.col(a).alias("a"), F.col(b).alias("b")).dropna(), "edges")
    salts = stage.put(e.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("salts")).where("salts > 1"), "salts")
    split = salts.head(1) != []
    if split:
        e = e.join(F.broadcast(salts), "g", "left")  # one row for so many edges
        e = e.withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1)))).withColumn("whole", F.col("salts").isNull())
    else:
        e = e.withColumn("whole", F.lit(True))
    dealt = parted(e, "g", *(["salt"] if split else []), count=e.count()).select("g", "a", "b", "whole")
    schema = StructType([StructField("g", e.schema["g"].dataType), StructField("node", e.schema["a"].dataType), StructField("root", e.schema["a"].dataType), StructField("number", LongType()), StructField("whole", BooleanType())])
    return stage.put(dealt.mapInArrow(_contracted, schema), "joined"), split


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("g", "u", "v"))).first())


def _starred(stage: Stage, clean: DataFrame) -> DataFrame:
    """(g, u, root) for all nodes of edges (g, a, b), by alternating stars."""
    nodes = stage.put(clean.select("g", F.explode(F.array("a", "b")).alias("u")).distinct(), "nodes")
    e = stage.put(clean.where("a <> b").select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0")
    mark, i = _sum(e), 0
    while mark[0]:
        i += 1
        deal = lambda df, n=tasks(stage.spark, 2 * mark[0]): df.repartition(n, "g", "u")
        both = e.unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.put(deal(both).groupBy("g", "u").agg(F.min("v").alias("m")).select("g", "u", F.least("u", "m").alias("m")), f"{i}-large")
        star = stage.put(deal(both.where("v > u")).join(deal(least), ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{i}-star")
        least = stage.put(deal(star).groupBy("g", "u").agg(F.min("v").alias("m")), f"{i}-small")
        rest = deal(star).join(deal(least), ["g", "u"]).where("v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage.put(rest.unionByName(least.select("g", "u", F.col("m").alias("v"))).where("u <> v").select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), str(i))
        for done in (f"{i - 1}", f"{i}-large", f"{i}-star", f"{i}-small"):
            stage.drop(done)
        now = _sum(e)
        if now == mark:
            break
        mark = now
    root = e.groupBy("g", "u").agg(F.min("v").alias("root"))
    return nodes.join(root, ["g", "u"], "left").select("g", "u", F.coalesce("root", "u").alias("root"))


def _named(df: DataFrame, group: str, node: str = "node", *more: str) -> DataFrame:
    return df.select(F.col("g").alias(group), F.col(node).alias("node"), "root", *more)


def components(edges: DataFrame, group: str, a: str, b: str, most: int = GROUP_EDGES) -> DataFrame:
    """(group, node, root): for every node of edges within a group the least node that it is joined to, itself included.

    Nodes are of any type that has an order, structs too. Loops and repeated edges are fine, rows with a null are no edges; no edges give no rows.
    """
    stage = Stage(edges.sparkSession, "components")
    joined, split = _joined(stage, edges, group, a, b, most)
    if not split:
        return _named(joined, group)
    rest = _starred(stage, joined.where("not whole").select("g", F.col("node").alias("a"), F.col("root").alias("b")))
    return _named(joined.where("whole"), group).unionByName(_named(rest, group, "u"))


def numbered(joined: DataFrame, group: str) -> DataFrame:
    """(group, node, root, number) of (group, node, root): roots numbered from 1 without gaps within each group, in their order.

    Places come from a range sort over all groups and the least place of each, so a group of any size has no task of its own.
    """
    roots = placed(joined.select(group, "root").distinct(), [F.asc(group), F.asc("root")], "_place")
    first = roots.groupBy(group).agg(F.min("_place").alias("_first"))
    numbers = roots.join(first, group).select(group, "root", (F.col("_place") - F.col("_first") + 1).alias("number"))
    return joined.join(numbers, [group, "root"]).select(group, "node", "root", "number")


def route_numbers(atoms: DataFrame, same: DataFrame, most: int = GROUP_EDGES) -> DataFrame:
    """(route, step, atom, number): one number for all atoms of a route that are the same atom, from 1 in order of step, then atom.

    atoms: (route, step, atom), all of them; same: (route, step_a, atom_a, step_b, atom_b), pairs that are one atom.
    """
    node = lambda s, a: F.struct(F.col(s).alias("step"), F.col(a).alias("atom"))
    own = atoms.select("route", node("step", "atom").alias("x")).select("route", "x", F.col("x").alias("y"))
    pairs = same.dropna().select("route", node("step_a", "atom_a").alias("x"), node("step_b", "atom_b").alias("y"))
    stage = Stage(atoms.sparkSession, "numbers")
    joined, split = _joined(stage, own.where("x.step is not null and x.atom is not null").unionByName(pairs), "route", "x", "y", most)
    # a route that one task has is numbered there
    out = _named(joined.where("whole"), "route", "node", "number")
    if split:
        rest = stage.put(_starred(stage, joined.where("not whole").select("g", F.col("node").alias("a"), F.col("root").alias("b"))), "rest")
        out = out.unionByName(numbered(_named(rest, "route", "u"), "route").select(*out.columns))
    return out.select("route", "node.step", "node.atom", "number")


def leaving_groups(bonds: DataFrame, cut: DataFrame) -> DataFrame:
    """(route, mark, inner, outer, size): for each cut bond its ends' groups, named by their least atoms; size: atoms of the outer one.

    bonds: (route, a, b), all bonds of a route; cut: (route, mark, inner, outer), bonds to be cut, whose outer atom's group leaves.
    The groups are the components left when those bonds are gone; an atom that all its bonds leave is a group of its own, and
    a bond within a ring that is cut once leaves both ends in one group.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    gone = cut.select("route", *ends("inner", "outer")).distinct()
    left = bonds.select("route", *ends("a", "b")).dropna().distinct().join(gone, ["route", "a", "b"], "left_anti")
    alone = cut.select("route", F.explode(F.array("inner", "outer")).alias("a")).select("route", "a", F.col("a").alias("b"))
    named = Stage(bonds.sparkSession, "groups").put(components(left.unionByName(alone), "route", "a", "b"), "named")
    sizes = named.groupBy("route", F.col("root").alias("outer")).agg(F.count("*").alias("size"))
    of = lambda end: named.select("route", F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    both = cut.join(of("inner"), ["route", "inner"]).join(of("outer"), ["route", "outer"]).select("route", "mark", F.col("inner_root").alias("inner"), F.col("outer_root").alias("outer"))
    return both.join(sizes, ["route", "outer"]).select("route", "mark", "inner", "outer", "size")
