"""Data for training: splits, labels, metrics, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import tasks

#: Rows of a block of label_pairs, and pairs of a task, about.
BLOCK_ROWS, TASK_PAIRS = 1000, 2_000_000


def stratified_split(df: DataFrame, product: str, rule: str, key: str, small: int = 20, share: float = 0.1) -> DataFrame:
    """Train or val: repeated products and rules of up to small single products train; else max(1, int(share * n)) of a rule's single products, by md5 of key, validate."""
    counted = df.withColumn("copies", F.count("*").over(Window.partitionBy(product)))
    single = F.col("copies") == 1
    by_rule = Window.partitionBy(rule, single)
    n = F.count("*").over(by_rule)
    place = F.row_number().over(by_rule.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    val = single & (n > small) & (place <= F.greatest(F.lit(1), F.floor(n * share)))
    return counted.withColumn("part", F.when(val, "val").otherwise("train")).drop("copies")


def last_label(rows: DataFrame, key: str, order: str, label: Column) -> DataFrame:
    """The label written last for each key."""
    return rows.groupBy(key).agg(F.max_by(label, F.col(order)).alias("label"))


def multi_hot(pairs: DataFrame, row: str, label: str) -> DataFrame:
    """Set positions of each row's labels, sorted, as text."""
    sets = pairs.groupBy(row).agg(F.sort_array(F.collect_set(label)).alias("s"))
    return sets.select(row, F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("labels"))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all of two sets of positions; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.when(union > 0, union), F.lit(0.0))


def bit_words(bits: Column, size: int) -> list[Column]:
    """An array of numbers from 1 to size as a set in columns of 63 bits, which one instruction compares."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter(bits, lambda i: F.floor((i - 1) / 63) == w), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", one, ((i - 1) % 63).cast("int"))))
    return [word(w) for w in range(max(1, -(-size // 63)))]


def word_tanimoto(a: list[Column], b: list[Column], digits: int | None = None) -> Column:
    """As tanimoto, of sets in bit_words; rounded half up to so many digits, by whole numbers: F.round takes longer than all the rest."""
    both = sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    total = sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    if digits is None:
        return F.coalesce(both / F.when(total > 0, total), F.lit(0.0))
    unit = 10**digits
    return F.coalesce(F.floor((both.cast("long") * (2 * unit) + total) / F.when(total > 0, total.cast("long") * 2)) / float(unit), F.lit(0.0))


def label_pairs(rows: DataFrame, columns: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, x and y with each of columns): every two rows of (id, label, columns) that have one label, once, with a < b.

    x and y are the columns of the two rows in either order. Rows of a label are dealt over blocks by id, and each two blocks meet in a group of their
    own, so groups are bounded and a label with many rows has many. There are as many pairs as the result has, by nature the square of a label's rows.
    rows are read three times. Rows without id or label are in no pair, nor are two rows of one id.
    """
    rows = rows.dropna(subset=["id", "label"])
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    pairs, copies = sizes.agg(F.sum(F.col("n") * F.col("n")) / 2, F.sum(F.col("n") * (F.col("blocks") + 1))).first()
    own = rows.join(sizes.drop("n"), "label").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    first, last = F.col("block").alias("i"), F.col("block").alias("j")
    x = own.select("label", first, F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("id").alias("x"), *(F.col(c).alias(f"x{c}") for c in columns))
    y = own.select("label", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), last, F.col("id").alias("y"), *(F.col(c).alias(f"y{c}") for c in columns))
    spark, group = rows.sparkSession, ["label", "i", "j"]
    n = max(tasks(spark, pairs or 0, TASK_PAIRS), tasks(spark, copies or 0))
    both = x.repartition(n, *group).join(y.repartition(n, *group).hint("merge"), group).where("i < j OR x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *(f"{side}{c}" for side in "xy" for c in columns))


def tanimoto_vectors(a: Column, b: Column) -> Column:
    """dot / (x squared + y squared - dot); 0 if that is 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    below = dot(a, a) + dot(b, b) - dot(a, b)
    return F.coalesce(dot(a, b) / F.when(below != 0, below), F.lit(0.0))


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with part: val for about the share of keys, by a seeded hash, train for the others; the same on every run."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000), "val").otherwise("train"))


def path_labels(nodes: DataFrame, smiles: str = "smiles") -> DataFrame:
    """(smiles, label): 1 if the last node with the molecule, in the order of nodes, lies on the way to a solved node; the root is left out."""
    from .tree import below

    on_way = below(nodes, F.col("solved").cast("int"))
    own = nodes.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id", smiles)
    return last_label(own.join(on_way, "node_id"), smiles, "node_id", (F.col("total") > 0).cast("long"))


def balanced(df: DataFrame, label: str, key: str, ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """All positives, and negatives by a seeded hash so that there are about ratio times as many as positives (none by default)."""
    positive = F.col(label) == 1
    if not ratio:
        return df.where(positive)
    n = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    share = min(1.0, ratio * n["p"] / n["n"]) if n["n"] else 0.0
    return df.where(positive | (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)))


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(accuracy, balanced_accuracy, f1): the latter two as means over the classes of label; classes are few."""
    counts = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0))
    rows = counts.groupBy(F.col("l").alias("c")).agg(same.alias("hit"), F.sum("n").alias("true"))
    given = counts.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("given"))
    per = rows.join(given, "c", "left")
    recall, f1 = F.col("hit") / F.col("true"), 2 * F.col("hit") / (F.col("true") + F.coalesce("given", F.lit(0)))
    return per.agg((F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("f1"))


def cross_entropy(prob: Column) -> Column:
    """Mean of minus the logarithm of the true class's probability."""
    return F.avg(-F.log(F.greatest(prob, F.lit(1e-12))))


def binary_cross_entropy(prob: Column, label: Column) -> Column:
    p = F.greatest(F.lit(1e-12), F.least(prob, F.lit(1 - 1e-12)))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))


def rank_accuracy(logits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: the share of molecules whose true rule is among the k most likely; logits (mol_id, rule_id, f), truth (mol_id, rule_id)."""
    own = logits.join(truth, ["mol_id", "rule_id"]).select("mol_id", F.col("f").alias("_t"))
    rank = logits.join(own, "mol_id").groupBy("mol_id").agg((F.count_if(F.col("f") > F.col("_t")) + 1).alias("_r"))
    return rank.agg(*(F.round(F.avg((F.col("_r") <= k).cast("double")), 6).alias(f"top{k}") for k in ks))
