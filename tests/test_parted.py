"""Tables dealt over more tasks the larger they are, and condensed graphs that are dealt once."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cinnabar.operators import cgr, learning
from cinnabar.plans.stage import parted


def test_tasks_grow_with_the_rows(spark):
    sizes = {}
    for n in (1000, 4000):
        df = parted(spark.range(n).withColumn("g", F.col("id") % 100), "g", rows=100)
        sizes[n] = df.rdd.getNumPartitions()
        assert df.count() == n and df.select("g", F.spark_partition_id().alias("p")).distinct().count() == 100
    assert sizes == {1000: 10, 4000: 40}
    assert parted(spark.range(0), "id").count() == 0


def test_bonds_are_dealt_once(spark):
    side = spark.range(100).select((F.col("id") % 10).alias("rxn_idx"), F.col("id").alias("a"), (F.col("id") + 1000).alias("b"), F.lit(1).cast("long").alias("ord"))
    bonds = cgr.compose(side.where("id < 60"), side.where("id >= 40"))
    for df, n in ((cgr.center_atoms(bonds), 160), (cgr.leaving_incoming(bonds), 160)):
        text = io.StringIO()
        with redirect_stdout(text):
            df.explain()
        assert text.getvalue().count("Exchange ") == 1
        assert df.count() == n


def test_sets_in_words(spark):
    sets = [[], [1], [63], [64], [1, 63, 64, 126, 127], list(range(1, 131)), [2, 64, 130]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<int>")
    words = df.select("i", "s", *(w.alias(f"w{k}") for k, w in enumerate(learning.bit_words(F.col("s"), 130))))
    both = words.alias("x").crossJoin(words.alias("y"))
    cols = lambda t: [F.col(f"{t}.w{k}") for k in range(3)]
    got = both.select(learning.word_tanimoto(cols("x"), cols("y")).alias("new"), learning.tanimoto(F.col("x.s"), F.col("y.s")).alias("old")).collect()
    assert len(got) == 49 and all(r.new == r.old for r in got) and any(0 < r.new < 1 for r in got)
