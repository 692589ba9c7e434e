"""Exact keys of labelled graphs by colour refinement on atom and bond tables: graphs have equal keys if and only if they are isomorphic.

Refinement hashes an atom's colour with the multiset of its neighbours' (order, colour) until a graph has no more colours than before; all
graphs are worked on at once, and a graph that stands still leaves the rounds, so its key doesn't depend on the others. If all colours
of a graph differ, they determine it. Ties are settled by splitting and trial: bonds that join all of one colour with all of another say no more than
the colours do and go; what is left falls apart into pieces that are keyed apart, so symmetric parts don't multiply. In a piece that still
has ties each atom of its smallest tied colour is marked in a copy of its own, and the copies are refined in turn; a piece's key is made of
those of all its copies. Copies are rows, not states of a task; a piece of n atoms has at most n copies a level, and each level parts further.

Graphs that have the same rows, numbers of atoms included, are worked on once. Multisets are hashed by sums of 32-bit halves, so partial sums are added up before the shuffle and no row grows with an atom's bonds.
Equality is up to hashes: colours of 64 bits within a graph, forms and keys of 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import Stage
from .numbering import components

HALF = (1 << 32) - 1


def _multiset(*parts: Column, seeds: int = 1) -> list[Column]:
    """Aggregates that say which multiset of parts a group has: sums of halves of as many hashes as seeds."""
    out = []
    for seed in range(seeds):
        h = F.xxhash64(F.lit(seed), *parts)
        out += [F.sum(h.bitwiseAND(HALF)).alias(f"m{2 * seed}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"m{2 * seed + 1}")]
    return out


def _key(kind: str, *more: str) -> Column:
    """Key of a group with columns m0 to m3 of _multiset and the named ones."""
    return F.md5(F.concat_ws(",", F.lit(kind), *(F.col(c).cast("string") for c in ("m0", "m1", "m2", "m3", *more))).cast("binary")).alias("key")


def _colours(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("task", "colour").agg(F.count("*").alias("size")).groupBy("task").agg(F.count("*").alias("colours"), F.sum("size").alias("atoms"))


def refined(stage: Stage, nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(task, node, colour) with the coarsest stable colours that refine those given, and (task, colours, atoms)."""
    counts = stage.put(_colours(nodes), f"{name}-counts-0")
    live, still, counted, i = nodes, None, None, 0
    while live is not None:
        i += 1
        around = edges.join(live.select("task", F.col("node").alias("b"), F.col("colour").alias("other")), ["task", "b"])
        sums = around.groupBy("task", F.col("a").alias("node")).agg(*_multiset(F.col("bond"), F.col("other")), F.count("*").alias("n"))
        new = live.join(sums, ["task", "node"], "left").select("task", "node", F.xxhash64("colour", "m0", "m1", "n").alias("colour"))
        new = stage.put(new, f"{name}-{i}")
        now = _colours(new).join(counts.select("task", F.col("colours").alias("before")), "task")
        now = stage.put(now, f"{name}-counts-{i}")
        # colours hold what neighbours were a round ago, so the round after the last split is needed, also where all colours differ
        ended = now.where("colours = before")
        done = stage.put(new.join(ended.select("task"), "task", "left_semi"), f"{name}-done-{i}")
        still = done if still is None else still.unionByName(done)
        part = ended.select("task", "colours", "atoms")
        counted = part if counted is None else counted.unionByName(part)
        counts = now.where("colours <> before").drop("before")
        live = new.join(counts.select("task"), "task", "left_semi") if counts.head(1) else None
        if i % 16 == 0:  # a plan of many small files is read again as one table
            still, counted = stage.put(still, f"{name}-all-{i}"), stage.put(counted, f"{name}-all-counts-{i}")
    return still, counted


def _untied(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges without those between two colours that are joined throughout by one kind of bond."""
    size = nodes.groupBy("task", "colour").agg(F.count("*").alias("size"))
    end = lambda x: nodes.select("task", F.col("node").alias(x), F.col("colour").alias(f"c{x}"))
    both = edges.join(end("a"), ["task", "a"]).join(end("b"), ["task", "b"])
    kinds = both.groupBy("task", "ca", "cb", "bond").agg(F.count("*").alias("n"))
    of = lambda x: size.select("task", F.col("colour").alias(f"c{x}"), F.col("size").alias(f"s{x}"))
    partly = kinds.join(of("a"), ["task", "ca"]).join(of("b"), ["task", "cb"]).where("n < sa * (sb - if(ca = cb, 1, 0))")
    return both.join(partly.select("task", "ca", "cb", "bond"), ["task", "ca", "cb", "bond"], "left_semi").select("task", "a", "b", "bond")


def _pieces(stage: Stage, nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with the piece (its least atom) that each belongs to once _untied bonds are gone."""
    left = stage.put(_untied(nodes, edges), f"{name}-left")
    root = components(left, "task", "a", "b").withColumnRenamed("root", "piece")
    parts = stage.put(nodes.join(root, ["task", "node"], "left").withColumn("piece", F.coalesce("piece", "node")), f"{name}-pieces")
    return parts, left.join(parts.select("task", F.col("node").alias("a"), "piece"), ["task", "a"])


def _forms(atoms: DataFrame, bonds: DataFrame, labels: list[str], kind: str | None) -> DataFrame:
    """(graph, form) of graphs that have atoms: of equal form are graphs with the same rows, by their numbers of atoms too."""
    marks = lambda *names: [x for c in names for x in (F.col(c).isNull(), F.col(c))]
    hashes = lambda *x: [F.xxhash64(F.lit(seed), *x).alias(f"h{seed}") for seed in (0, 1)]
    own = atoms.dropna(subset=["graph", "node"]).select("graph", F.lit(1).alias("atom"), *hashes(F.lit("atom"), F.col("node"), *marks(*labels)))
    ends = bonds.dropna(subset=["graph"]).where("a <> b").select("graph", F.lit(0).alias("atom"), *hashes(F.lit("bond"), F.least("a", "b"), F.greatest("a", "b"), *marks(*([kind] if kind else []))))
    rows = own.unionByName(ends).groupBy("graph").agg(*_multiset(F.col("h0"), F.col("h1"), seeds=2), F.count("*").alias("n"), F.sum("atom").alias("atoms"))
    return rows.where("atoms > 0").select("graph", _key("form", "n", "atoms").alias("form"))


def graph_keys(atoms: DataFrame, bonds: DataFrame, labels: list[str], kind: str | None = None) -> DataFrame:
    """(graph, key): a text of 32 hexadecimal digits, equal for graphs that differ by the numbers of their atoms only.

    atoms: (graph, node, labels); bonds: (graph, a, b[, kind]), undirected. Atoms can match if all their labels are equal, bonds if their kinds are.

    Defined cases: a null label or kind is a value like any other; repeated atoms count once, with the least labels; repeated bonds, bonds
    in both directions and loops count once or not at all, two kinds between two atoms are two bonds; bonds to atoms that aren't listed are
    no bonds; rows without graph or node are no rows; empty tables give no rows.
    """
    stage = Stage(atoms.sparkSession, "refinement")
    task = F.col("graph").cast("string").alias("task")
    label = F.struct(*(F.col(c) for c in labels)) if labels else F.struct(F.lit(0))
    # graphs with the same rows have the same key, so one of each form is worked on
    forms = stage.put(_forms(atoms, bonds, labels, kind), "forms")
    chosen = stage.put(forms.groupBy("form").agg(F.min("graph").alias("graph")), "chosen")
    atoms, bonds = (df.join(chosen.select("graph"), "graph", "left_semi") for df in (atoms, bonds))
    listed = atoms.dropna(subset=["graph", "node"]).groupBy("graph", "node").agg(F.min(label).alias("l"))
    # nulls are told from values by their own mark, since hashes pass over them
    marks = [x for c in labels for x in (F.col(f"l.{c}").isNull(), F.col(f"l.{c}"))]
    nodes = stage.put(listed.select(task, "node", F.xxhash64(F.lit(7), *marks).alias("colour")), "atoms")
    bond = F.xxhash64(F.col(kind).isNull(), F.col(kind)) if kind else F.lit(0).cast("long")
    ends = bonds.where("a <> b").select(task, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bond.alias("bond")).distinct()
    for x in ("a", "b"):
        ends = ends.join(nodes.select("task", F.col("node").alias(x)), ["task", x], "left_semi")
    edges = stage.put(ends.select("task", "a", "b", "bond").unionByName(ends.select("task", F.col("b").alias("a"), F.col("a").alias("b"), "bond")), "bonds")

    levels, level = [], 0
    while nodes.head(1):
        nodes, counts = refined(stage, nodes, edges, f"{level}-refined")
        plain = counts.where("colours = atoms").select("task")
        told = nodes.join(plain, "task", "left_semi").groupBy("task").agg(*_multiset(F.col("colour"), seeds=2), F.count("*").alias("n"))
        told = stage.put(told.select("task", _key("told", "n")), f"{level}-told")
        tied = counts.where("colours < atoms").select("task")
        if not tied.head(1):
            levels.append((told, None, None))
            break
        parts, between = _pieces(stage, nodes.join(tied, "task", "left_semi"), edges.join(tied, "task", "left_semi"), f"{level}")
        sizes = parts.groupBy("task", "piece", "colour").agg(F.count("*").alias("size"))
        least = F.min(F.when(F.col("size") > 1, F.struct("size", "colour"))).alias("least")
        # one row a colour: its hash with its size says the same as that of all its atoms
        state = sizes.groupBy("task", "piece").agg(*_multiset(F.col("colour"), F.col("size"), seeds=2), F.sum("size").alias("n"), least)
        state = stage.put(state.select("task", "piece", _key("piece", "n"), F.col("least.colour").alias("colour")), f"{level}-state")
        marked = parts.join(state.where("colour is not null").select("task", "piece", "colour"), ["task", "piece", "colour"])
        copies = stage.put(marked.select("task", "piece", F.col("node").alias("mark"), F.concat_ws("/", "task", F.col("node").cast("string")).alias("copy")), f"{level}-copies")
        levels.append((told, state, copies))
        of = parts.join(copies, ["task", "piece"])
        nodes = stage.put(of.select(F.col("copy").alias("task"), "node", F.when(F.col("node") == F.col("mark"), F.xxhash64(F.lit("mark"), "colour")).otherwise(F.col("colour")).alias("colour")), f"{level}-next")
        edges = stage.put(between.join(copies, ["task", "piece"]).select(F.col("copy").alias("task"), "a", "b", "bond"), f"{level}-next-bonds")
        level += 1

    keys = None  # (task, key) of the copies below, from the deepest level up
    for level in reversed(range(len(levels))):
        told, state, copies = levels[level]
        if state is None:
            keys = told
            continue
        own = state.where("colour is null").select("task", "key")
        if keys is not None:
            tries = copies.join(keys.withColumnRenamed("task", "copy"), "copy").groupBy("task", "piece").agg(*_multiset(F.col("key"), seeds=2), F.count("*").alias("n"))
            open_ = tries.select("task", "piece", _key("copies", "n").alias("below")).join(state.select("task", "piece", "key"), ["task", "piece"])
            own = own.unionByName(open_.select("task", F.md5(F.concat("key", "below").cast("binary")).alias("key")))
        joined = own.groupBy("task").agg(*_multiset(F.col("key"), seeds=2), F.count("*").alias("n")).select("task", _key("pieces", "n"))
        keys = stage.put(told.unionByName(joined), f"{level}-keys")
    if keys is None:
        keys = nodes.select("task", F.lit("").alias("key"))
    return forms.join(chosen.select("form", task).join(keys, "task").select("form", "key"), "form").select("graph", "key")


def classes(keys: DataFrame) -> DataFrame:
    """(graph, first, size) of (graph, key): the least graph that has the same key, and how many have it."""
    groups = keys.groupBy("key").agg(F.min("graph").alias("first"), F.count("*").alias("size"))
    return keys.join(groups, "key").select("graph", "first", "size")
