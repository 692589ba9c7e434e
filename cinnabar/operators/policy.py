"""Rule probabilities of a molecule: softmax, cut-offs, combined policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logit: Column, by: str) -> Column:
    """Stable softmax over the rows of by."""
    w = Window.partitionBy(by)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def top(df: DataFrame, by: str, value: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the largest value; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ranking(logits: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Softmax over all rules, then the k best above the threshold."""
    return top(logits.withColumn("prob", softmax(F.col("f"), "mol_id")), "mol_id", "prob", "rule_id", k).where(F.col("prob") > threshold)


def filtering(logits: DataFrame, k: int) -> DataFrame:
    """The k best logits, then softmax over those."""
    return top(logits, "mol_id", "f", "rule_id", k).withColumn("prob", softmax(F.col("f"), "mol_id"))


def combined(logits: DataFrame, weight: float, temperature: float, k: int) -> DataFrame:
    """Softmax of (f + weight * r) / temperature, then the k best."""
    mixed = logits.withColumn("prob", softmax((F.col("f") + weight * F.col("r")) / temperature, "mol_id"))
    return top(mixed, "mol_id", "prob", "rule_id", k)


def joined_logits(filtering_: DataFrame, ranking_: DataFrame) -> DataFrame:
    """(mol_id, rule_id, f, r): the logits of two networks side by side, rule by rule; both must know the same rules."""
    return filtering_.select("mol_id", "rule_id", "f").join(ranking_.select("mol_id", "rule_id", "r"), ["mol_id", "rule_id"])
