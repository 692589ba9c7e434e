"""Cases of the operators that the tables don't have."""

from pyspark.sql import functions as F

from cinnabar.operators import curation, learning, policy, tree


def test_split_record(spark):
    df = spark.createDataFrame([("CC>>CO\tx\t y ",), ("CC>>CO name of it",), ("CC",), (None,)], "raw string").select(curation.split_record(F.col("raw")).alias("s")).select("s.*")
    assert [(r.smiles, r.fields) for r in df.collect()] == [("CC>>CO", ["x", "y"]), ("CC>>CO", ["name of it"]), ("CC", []), (None, None)]


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a", "z"), (1, "a", None), (2, None, "q"), (5, None, "r")], "idx int, key string, v string")
    assert sorted((r.key or "", r.idx, r.v) for r in curation.keep_first(df, ["key"], "idx").collect()) == [("", 2, "q"), ("a", 1, None)]


def test_ties_take_the_smallest_rule(spark):
    df = spark.createDataFrame([(1, r, 0.5) for r in (3, 1, 2)], "mol_id long, rule_id long, f double")
    assert [r.rule_id for r in policy.ranking(df, 1).collect()] == [1]


def test_walks_of_an_empty_tree(spark):
    df = spark.createDataFrame([], "node_id long, parent_id long")
    assert tree.walks(df).count() == 0


def test_tanimoto_of_empty_sets(spark):
    empty, one = F.array().cast("array<int>"), F.array(F.lit(1))
    row = spark.range(1).select(learning.tanimoto(empty, empty).alias("a"), learning.tanimoto(one, one).alias("b")).first()
    assert (row.a, row.b) == (0.0, 1.0)
