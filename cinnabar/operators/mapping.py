"""Atom mapping of reactions from scores between their atoms, all reactions a round, as rows of (reaction, product atom, reactant atom, score).

A round gives each reaction the pair of its greatest score; pairs at its neighbours gain, and atoms next to a mapped product atom come before all others. What
a round needs is within a reaction, so rounds are windows over one exchange, a few of them between two written tables; reactions that
have ended leave the rounds. No matrix is held in a task: a window's rows spill. Pairs and rounds are dealt over tasks that grow with the rows. The atoms
are read several times; write them first if they are dear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import Stage, parted

NOTHING = 1e-8  # a score up to this is none


def pair_scores(attention: DataFrame, atoms: DataFrame) -> DataFrame:
    """(reaction, p, r, score): for product atom p and reactant atom r of the same element what the two attend to each other, added up.

    attention: (reaction, a, b, value), from a to b; of repeated pairs the greatest value counts. atoms: (reaction, atom, side, element), side being
    product or reactant, atoms numbered over both sides. Rows with a null or no number, and of atoms that aren't listed, are none.
    """
    own = atoms.select("reaction", F.col("atom").cast("long").alias("atom"), "side", "element").dropna().dropDuplicates(["reaction", "atom"]).where("side in ('product', 'reactant')")
    rows = attention.select("reaction", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("value").cast("double").alias("value")).dropna().where("not isnan(value) and a <> b")
    # both directions of a pair become one row in the exchange of the first join
    rows = parted(rows.select("reaction", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") < F.col("b")).alias("up"), "value"), "reaction", "x", count=attention.count())
    one, other = (F.coalesce(F.max(F.when(F.col("up") == f, F.col("value"))), F.lit(0.0)) for f in (True, False))
    rows = rows.groupBy("reaction", "x", "y").agg((one + other).alias("score"))
    for c in "xy":
        rows = rows.join(own.select("reaction", F.col("atom").alias(c), F.col("side").alias(f"side_{c}"), F.col("element").alias(f"element_{c}")), ["reaction", c])
    forth = F.col("side_x") == "product"
    return rows.where("side_x <> side_y and element_x = element_y").select("reaction", F.when(forth, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(forth, F.col("y")).otherwise(F.col("x")).alias("r"), "score")


def _around(bonds: DataFrame, atom: str, name: str, most: int) -> DataFrame:
    both = bonds.select("reaction", "a", "b").union(bonds.select("reaction", "b", "a")).dropna().select("reaction", F.col("a").cast("long").alias(atom), F.col("b").cast("long").alias("b"))
    found = both.groupBy("reaction", atom).agg(F.collect_set("b").alias(name))
    return found.select("reaction", atom, F.when(F.size(name) > most, F.raise_error(F.lit(f"an atom has more than {most} bonds"))).otherwise(F.col(name)).alias(name))


def _best():
    open_ = F.when(~F.col("taken"), F.struct("scope", "score", (-F.col("p")).alias("p"), (-F.col("r")).alias("r")))
    return F.max(open_).over(Window.partitionBy("reaction"))


def _round(rows: DataFrame, multiplier: float) -> DataFrame:
    """Rows after each reaction has taken its best pair; a reaction whose best score is none stays as it is."""
    on = F.coalesce(F.col("best.score") > NOTHING, F.lit(False))
    same_p, same_r = F.col("p") == -F.col("best.p"), F.col("r").eqNullSafe(-F.col("best.r"))
    near = on & F.coalesce(F.array_contains("p_around", -F.col("best.p")), F.lit(False))
    both = near & F.coalesce(F.array_contains("r_around", -F.col("best.r")), F.lit(False))
    kept = rows.withColumn("best", _best()).where(F.col("taken") | ~on | (same_p == same_r))
    return kept.select(
        "reaction", "p", "r", F.when(both, F.col("score") * multiplier).otherwise(F.col("score")).alias("score"),
        (F.col("scope") | near).alias("scope"), (F.col("taken") | (on & same_p & same_r)).alias("taken"), "p_around", "r_around",
    )


def map_atoms(scores: DataFrame, atoms: DataFrame, bonds: DataFrame, multiplier: float = 1.75, rounds: int = 8, most_bonds: int = 1000) -> DataFrame:
    """(reaction, atom, mapped) for each product atom: the reactant atom it came from, or null.

    scores: (reaction, p, r, score), see pair_scores; atoms: (reaction, atom, side, element); bonds: (reaction, a, b), of either side. A
    reaction takes the pair of greatest score, multiplies the scores of pairs of their neighbours, and goes on among the atoms next to mapped ones; among all if
    there are none such. It ends if the best score there is no more than NOTHING, also if atoms elsewhere have one. Of equal scores that
    of the least product atom, then of the least reactant atom, counts. rounds: how many lie between two written tables; there are as
    many as the largest product has atoms. An atom of more than most_bonds bonds is an error, since neighbours travel with each score.

    Defined cases: of repeated pairs the greatest score counts; null, negative and other scores than numbers are none; scores of atoms that aren't
    listed are left out; reactions without scores map nothing; empty tables give no rows; extra columns don't matter.
    """
    stage = Stage(scores.sparkSession, "mapping")
    listed = atoms.select("reaction", F.col("atom").cast("long").alias("atom"), "side").dropna().distinct()
    around = {c: listed.where(F.col("side") == side).select("reaction", F.col("atom").alias(c)).join(_around(bonds, c, f"{c}_around", most_bonds), ["reaction", c], "left") for c, side in (("p", "product"), ("r", "reactant"))}
    own = scores.select("reaction", F.col("p").cast("long").alias("p"), F.col("r").cast("long").alias("r"), F.col("score").cast("double").alias("score")).dropna()
    own = own.where((F.col("score") > 0) & ~F.isnan("score")).repartition("reaction", "p").groupBy("reaction", "p", "r").agg(F.max("score").alias("score"))
    own = own.join(around["p"], ["reaction", "p"]).join(around["r"], ["reaction", "r"])
    own = own.unionByName(around["p"].withColumn("r", F.lit(None).cast("long")).withColumn("score", F.lit(0.0)), allowMissingColumns=True)
    rows = stage.put(own.select("reaction", "p", "r", "score", F.lit(False).alias("scope"), F.lit(False).alias("taken"), "p_around", "r_around"), "0")
    ended, i = None, 0
    while (count := rows.count()) or ended is None:
        rows = parted(rows, "reaction", count=count)
        for _ in range(rounds):
            rows = _round(rows, multiplier)
        i += 1
        written = stage.put(rows.withColumn("live", F.coalesce(_best()["score"] > NOTHING, F.lit(False))), str(i))
        done = written.where("not live").select("reaction", "p", "r", "taken")
        ended, rows = done if ended is None else ended.unionByName(done), written.where("live").drop("live")
    return ended.groupBy("reaction", F.col("p").alias("atom")).agg(F.max(F.when(F.col("taken"), F.col("r"))).alias("mapped"))


def numbered(mapped: DataFrame, atoms: DataFrame) -> DataFrame:
    """(reaction, atom, side, number): reactant atoms get numbers from 1 in their order, product atoms that of their reactant atom, unmapped ones the next, in their order."""
    listed = atoms.select("reaction", F.col("atom").cast("long").alias("atom"), "side").dropna().distinct()
    place = F.row_number().over(Window.partitionBy("reaction").orderBy("atom"))
    reactants = listed.where("side = 'reactant'").withColumn("number", place)
    products = mapped.join(reactants.select("reaction", F.col("atom").alias("mapped"), "number"), ["reaction", "mapped"], "left")
    new = products.where("number is null").select("reaction", "atom", place.alias("place"))
    most = reactants.groupBy("reaction").agg(F.count("*").alias("most"))
    new = new.join(most, "reaction", "left").select("reaction", "atom", (F.col("place") + F.coalesce("most", F.lit(0))).alias("number"))
    known = products.where("number is not null").select("reaction", "atom", "number")
    return reactants.unionByName(known.unionByName(new).select("reaction", "atom", F.lit("product").alias("side"), "number"))
