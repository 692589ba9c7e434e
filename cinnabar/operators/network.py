"""Search of a whole reaction network as a fixpoint of tables: which products can be made from stock, how deep, and how.

A network is an AND-OR graph: a product can be made if all parts of one of its reactions can. Breadth first, all
targets at once: a round joins the molecules that became new in the round before with the reactions that use them; those
of which every part can now be made give their products, unless these were known. So each molecule has its least depth, each
reaction fires once, and cycles end by themselves. A round reads the reactions that new molecules touch, not the network; no
tree is held in a task, and only how many molecules are new comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import Stage


def solve(products: DataFrame, parts: DataFrame, stock: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(molecule, depth, reaction) of all molecules that can be made: stock has depth 0 and no reaction.

    products: (reaction, product), a reaction's single product; parts: (reaction, part); stock: (molecule). Of several reactions that give
    a product at its least depth the least counts. max_depth: rounds at most; what is deeper is not given.

    Defined cases: repeated rows count once; rows with a null are no rows; a reaction without parts never fires; a product
    among its own parts needs another reaction; empty tables give the stock.
    """
    stage = Stage(products.sparkSession, "network")
    products = stage.put(products.select("reaction", F.col("product").alias("molecule")).dropna().distinct(), "products")
    parts = stage.put(parts.select("reaction", F.col("part").alias("molecule")).dropna().distinct(), "parts")
    new = stage.put(stock.select("molecule").dropna().distinct().select("molecule", F.lit(0).alias("depth"), F.lit(None).cast(products.schema["reaction"].dataType).alias("reaction")), "solved-0")
    solved = new
    for depth in range(1, max_depth + 1):
        touched = parts.join(new.select("molecule"), "molecule").select("reaction").distinct()
        known = solved.select("molecule", F.lit(True).alias("made"))
        fired = parts.join(touched, "reaction").join(known, "molecule", "left").groupBy("reaction").agg(F.count_if(F.col("made").isNull()).alias("open")).where("open = 0")
        made = products.join(fired.select("reaction"), "reaction").groupBy("molecule").agg(F.min("reaction").alias("reaction"))
        made = made.join(solved.select("molecule"), "molecule", "left_anti")
        new = stage.put(made.select("molecule", F.lit(depth).alias("depth"), "reaction"), f"solved-{depth}")
        if not new.head(1):
            break
        solved = solved.unionByName(new)
        if depth % 16 == 0:  # a plan of many small files is read again as one table
            solved = stage.put(solved, f"all-{depth}")
    return solved


def routes(targets: DataFrame, solved: DataFrame, parts: DataFrame) -> DataFrame:
    """(target, molecule, depth, reaction): what each solved target is made of, down to stock, by the reactions that solve chose.

    targets: (target). A molecule that a target needs several times comes once. Depth falls along each step, so rounds end; a round
    joins what the round before added. Targets that can't be made give no rows.
    """
    stage = Stage(solved.sparkSession, "routes")
    # both are read once a round, so what they are made of is worked out once
    solved = stage.put(solved, "solved")
    chosen = solved.where("reaction is not null").select("reaction").distinct()
    parts = stage.put(parts.select("reaction", F.col("part").alias("molecule")).dropna().join(chosen, "reaction", "left_semi").distinct(), "parts")
    new = targets.select("target").dropna().distinct().join(solved, F.col("target") == F.col("molecule")).select("target", "molecule", "depth", "reaction")
    new = stage.put(new, "0")
    found, level = new, 0
    while new.head(1):
        level += 1
        below = new.where("reaction is not null").select("target", "reaction").join(parts, "reaction").select("target", "molecule").distinct()
        below = below.join(found.select("target", "molecule"), ["target", "molecule"], "left_anti").join(solved, "molecule")
        new = stage.put(below.select("target", "molecule", "depth", "reaction"), str(level))
        found = found.unionByName(new)
    return found


def summary(targets: DataFrame, solved: DataFrame) -> DataFrame:
    """(target, solved, depth): whether each target can be made, and how deep; null where it can't."""
    own = solved.select(F.col("molecule").alias("target"), "depth")
    return targets.select("target").distinct().join(own, "target", "left").select("target", F.col("depth").isNotNull().alias("solved"), "depth")
