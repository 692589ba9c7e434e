"""Rule mining: popularity, ranking, reaction-to-rule map, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import placed, running_sum


def popularity(pairs: DataFrame) -> DataFrame:
    """Rules of (rxn_idx, cgr_key, rule_smarts, validation): the first record stands for the key; indices in order."""
    return pairs.groupBy("cgr_key").agg(
        F.sort_array(F.collect_list("rxn_idx")).alias("reaction_indices"),
        F.min_by("rule_smarts", F.struct("rxn_idx", "rule_smarts")).alias("rule_smarts"),
        F.min_by("validation", F.struct("rxn_idx", "rule_smarts")).alias("validation"),
        F.count("*").alias("popularity"),
        F.min("rxn_idx").alias("first_idx"),
    )


def key_statistics(pairs: DataFrame) -> DataFrame:
    """As popularity without the indices, so that no row grows with the reactions of a rule."""
    return pairs.groupBy("cgr_key").agg(
        F.min_by("rule_smarts", F.struct("rxn_idx", "rule_smarts")).alias("rule_smarts"),
        F.min_by("validation", F.struct("rxn_idx", "rule_smarts")).alias("validation"),
        F.count("*").alias("popularity"),
        F.min("rxn_idx").alias("first_idx"),
    )


def merge_statistics(parts: DataFrame) -> DataFrame:
    """One row a key of the stored statistics of several batches of reactions."""
    first = F.struct("first_idx", "rule_smarts")
    return parts.groupBy("cgr_key").agg(F.min_by("rule_smarts", first).alias("rule_smarts"), F.min_by("validation", first).alias("validation"), F.sum("popularity").alias("popularity"), F.min("first_idx").alias("first_idx"))


def ranked(rules: DataFrame, min_popularity: int) -> DataFrame:
    """Valid, popular rules with rule_id by falling popularity, then first appearance; numbered without a task that sees all."""
    kept = rules.where((F.col("validation") == "passed") & (F.col("popularity") >= min_popularity))
    return placed(kept, [F.desc("popularity"), F.asc("first_idx"), F.asc("cgr_key")], "rule_id")


def reactions_of(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(rxn_idx, rule_id) of the pairs whose key has a rule: of several rules of a reaction the largest; rows, not lists."""
    return pairs.join(rules.select("cgr_key", "rule_id"), "cgr_key").groupBy("rxn_idx").agg(F.max("rule_id").alias("rule_id"))


def policy_rows(products: DataFrame, mapping: DataFrame) -> DataFrame:
    """(rxn_idx, product_smiles, rule_id): reactions without a rule are dropped; write_policy puts them in the order of rxn_idx."""
    return products.join(mapping, "rxn_idx")


def covered_share(rules_covered: DataFrame, total: int) -> DataFrame:
    """coverage with percent, the share of all reactions that a rule covers."""
    return rules_covered.withColumn("percent", F.round(100 * F.col("covered") / F.lit(total), 2) if total else F.lit(0.0))


def popularity_profile(rules: DataFrame, share: float = 0.8) -> DataFrame:
    """(rules, p25, p50, p75, p90, top, n_share): percentiles of popularity, and how many of the most popular rules hold the share."""
    total = rules.agg(F.sum("popularity")).first()[0] or 0
    upto = running_sum(rules.select("popularity", "rule_id"), [F.desc("popularity"), F.asc("rule_id")], "popularity", "_upto")
    return upto.agg(F.count("*").alias("rules"), *(F.percentile("popularity", p / 100).alias(f"p{p}") for p in (25, 50, 75, 90)), F.max("popularity").alias("top"), (F.count_if(F.col("_upto") < share * total) + (1 if total else 0)).alias("n_share"))


def statistics(rules: DataFrame, min_popularity: int) -> DataFrame:
    passed = F.col("validation") == "passed"
    popular = F.col("popularity") >= min_popularity
    return rules.agg(F.count("*").alias("total"), F.count_if(~passed).alias("rejected_validation"), F.count_if(passed & ~popular).alias("rejected_popularity"), F.count_if(passed & popular).alias("passed"))


def coverage(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(rules, covered): how many rules there are, and how many reactions have one of them."""
    own = pairs.join(rules.select("cgr_key", "rule_id"), "cgr_key")
    return own.groupBy("rxn_idx").agg(F.lit(1).alias("_one")).agg(F.count("*").alias("covered")).crossJoin(own.agg(F.countDistinct("rule_id").alias("rules"))).select("rules", "covered")  # one row each


def pareto(rules: DataFrame) -> DataFrame:
    """Running share of all popularity, by rule_id; sums by ranges, without a task that sees all."""
    own = rules.select("rule_id", "popularity")
    total = own.agg(F.sum("popularity").alias("_total"))
    return running_sum(own, [F.asc("rule_id")], "popularity", "cumulative").crossJoin(F.broadcast(total)).select("rule_id", "popularity", "cumulative", F.round(F.col("cumulative") / F.col("_total"), 6).alias("share"))  # one row


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of either set with its side: only_a, only_b or shared; one shuffle, no join."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    return both.groupBy(key).agg(F.bit_or("s").alias("s")).select(key, F.when(F.col("s") == 1, "only_a").when(F.col("s") == 2, "only_b").otherwise("shared").alias("side"))
