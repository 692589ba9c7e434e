"""Condensed graphs of reactions as bond tables (rxn_idx, a, b, ord, p_ord); null: no such bond on that side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import parted

KEY = ["rxn_idx", "a", "b"]


def compose(reactants: DataFrame, products: DataFrame) -> DataFrame:
    """Full outer join of the sides' bonds (rxn_idx, a, b, ord), made unique by their least order, as one aggregation of both.

    Bonds are dealt by reaction, over more tasks the more there are; what is grouped by reaction afterwards stays where it is.
    """
    none = F.lit(None).cast(reactants.schema["ord"].dataType)
    both = reactants.select(*KEY, "ord", none.alias("p_ord")).unionByName(products.select(*KEY, none.alias("ord"), F.col("ord").alias("p_ord")))
    return parted(both, "rxn_idx").groupBy(*KEY).agg(F.min("ord").alias("ord"), F.min("p_ord").alias("p_ord"))


def changed():
    return ~F.col("ord").eqNullSafe(F.col("p_ord"))


def center_atoms(bonds: DataFrame) -> DataFrame:
    """Distinct atoms of changed bonds."""
    return bonds.where(changed()).select("rxn_idx", F.explode(F.array("a", "b")).alias("atom")).distinct()


def bond_changes(bonds: DataFrame) -> DataFrame:
    o, p = F.col("ord"), F.col("p_ord")
    return bonds.groupBy("rxn_idx").agg(
        F.count_if(o.isNull()).alias("formed"), F.count_if(p.isNull()).alias("broken"), F.count_if(o.isNotNull() & p.isNotNull() & (o != p)).alias("changed"), F.count_if(o == p).alias("kept")
    )


def dynamic_bonds_reject(low: int, high: int):
    """The filter on the number of changed bonds."""
    return ~(F.col("formed") + F.col("broken") + F.col("changed")).between(low, high)


def broad_class():
    """other without a change; formation or breaking if nothing else changes; substitution else."""
    formed, broken, changed = F.col("formed") > 0, F.col("broken") > 0, F.col("changed") > 0
    return F.when(~formed & ~broken & ~changed, "other").when(~broken & ~changed, "bond_formation").when(~formed & ~changed, "bond_breaking").otherwise("substitution")


def change_pairs(bonds: DataFrame) -> DataFrame:
    """Formed, broken and changed bonds of each reaction as sorted arrays of (a, b); a reaction's bonds are few by nature."""
    o, p = F.col("ord"), F.col("p_ord")
    pair = F.struct("a", "b")
    kind = {"formed_pairs": o.isNull(), "broken_pairs": p.isNull(), "changed_pairs": o.isNotNull() & p.isNotNull() & (o != p)}
    return bonds.where(changed()).groupBy("rxn_idx").agg(*(F.sort_array(F.collect_list(F.when(c, pair))).alias(n) for n, c in kind.items()))


def center_with_charges(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distinct centre atoms: of changed bonds, and those of atoms (rxn_idx, atom, charge, p_charge) whose charge changes."""
    charged = atoms.where("charge IS NOT NULL AND p_charge IS NOT NULL AND charge <> p_charge").select("rxn_idx", "atom")
    return center_atoms(bonds).unionByName(charged).distinct()


def components(bonds: DataFrame) -> DataFrame:
    """(rxn_idx, parts): connected parts of each reaction's bonds, by an Arrow kernel over its pairs."""
    from ..functions import arrow
    from ..functions.molecules import components as parts

    def count(pairs) -> tuple:
        near: dict[int, dict] = {}
        for x in pairs:
            near.setdefault(x["a"], {})[x["b"]] = 1
            near.setdefault(x["b"], {})[x["a"]] = 1
        return (len(parts(near)),)

    own = bonds.groupBy("rxn_idx").agg(F.collect_list(F.struct("a", "b")).alias("_pairs"))
    return arrow.add(own, ["_pairs"], "parts long", count, spread=False).drop("_pairs")


def strategic_graph(bonds: DataFrame) -> DataFrame:
    """Bonds of the strategic-bond graph: those that are there afterwards, with their order then on both sides where it was another."""
    return bonds.where("p_ord IS NOT NULL").withColumn("ord", F.when(F.col("ord").isNotNull(), F.col("p_ord")))


def environment(bonds: DataFrame, atoms: DataFrame, hops: int) -> DataFrame:
    """(rxn_idx, atom) within hops of atoms; each hop is one join on the reaction and the atom."""
    both = bonds.select("rxn_idx", F.col("a").alias("atom"), F.col("b").alias("near")).unionByName(bonds.select("rxn_idx", F.col("b").alias("atom"), F.col("a").alias("near")))
    out = atoms.select("rxn_idx", "atom")
    for _ in range(hops):
        out = out.unionByName(both.join(out, ["rxn_idx", "atom"]).select("rxn_idx", F.col("near").alias("atom"))).distinct()
    return out


def center_environment(bonds: DataFrame, hops: int) -> DataFrame:
    """(rxn_idx, atom) within hops of the changed bonds; one aggregation, since a reaction's bonds are few by nature."""
    own = bonds.groupBy("rxn_idx").agg(F.collect_list(F.struct("a", "b")).alias("_bonds"), F.flatten(F.collect_list(F.when(changed(), F.array("a", "b")))).alias("_atoms"))

    def meets(x):
        return F.array_contains(F.col("_atoms"), x.a) | F.array_contains(F.col("_atoms"), x.b)

    for _ in range(hops):
        near = F.transform(F.filter("_bonds", meets), lambda x: F.array(x.a, x.b))
        own = own.withColumn("_atoms", F.array_distinct(F.concat("_atoms", F.flatten(near))))
    return own.select("rxn_idx", F.explode(F.array_distinct("_atoms")).alias("atom"))


def leaving_incoming(bonds: DataFrame) -> DataFrame:
    """Atoms that only one side has: leaving (reactants) or incoming (products); one aggregation stands for both anti joins."""
    sides = F.when(F.col("ord").isNotNull(), 1).otherwise(0) + F.when(F.col("p_ord").isNotNull(), 2).otherwise(0)
    atoms = bonds.select("rxn_idx", F.explode(F.array("a", "b")).alias("atom"), sides.alias("s")).groupBy("rxn_idx", "atom").agg(F.bit_or("s").alias("s"))
    return atoms.where("s < 3").select("rxn_idx", "atom", F.when(F.col("s") == 1, "leaving").otherwise("incoming").alias("kind"))


def strategic(bonds: DataFrame) -> DataFrame:
    """A reaction's formed bonds as sorted text a-b."""
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    formed = bonds.where("ord IS NULL AND p_ord IS NOT NULL").groupBy("rxn_idx").agg(F.sort_array(F.collect_set(pair)).alias("pairs"))
    text = F.transform("pairs", lambda x: F.concat_ws("-", x.a.cast("string"), x.b.cast("string")))
    return formed.select("rxn_idx", F.array_join(text, ",").alias("bonds"), F.size("pairs").cast("long").alias("n_bonds"))


def fold(steps: DataFrame) -> DataFrame:
    """Route graph of (route_id, step, a, b, ord, p_ord): each bond's order before its first step and after its last."""
    return steps.groupBy("route_id", "a", "b").agg(F.min_by("ord", "step").alias("ord"), F.max_by("p_ord", "step").alias("p_ord"))
