"""Row kernels: rows over many tasks, equal inputs worked on once a task, results as row by row."""

from pyspark.sql import functions as F

from cinnabar.functions import arrow


def counted(spark):
    calls = spark.sparkContext.accumulator(0)
    return calls, lambda: calls.add(1)


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(2000).coalesce(1).select("id", F.concat(F.lit("t"), "id").alias("text")).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    added = arrow.add(df, ["text"], "n int", lambda s: (len(s),)).withColumn("task", F.spark_partition_id())
    assert added.select("task").distinct().count() > 1
    out = arrow.expand(df, ["text"], ["id"], "n int", lambda s: ((i,) for i in range(2))).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 1 and out.count() == 4000


def test_equal_inputs_are_worked_on_once_a_task(spark):
    df = spark.range(30000).select("id", (F.col("id") % 3).cast("string").alias("text"))
    calls, call = counted(spark)
    tasks = max(4, 4 * spark.sparkContext.defaultParallelism)

    def one(s):
        call()
        return (s * 2,)

    assert {tuple(r) for r in arrow.add(df, ["text"], "twice string", one).groupBy("twice").count().collect()} == {(s, 10000) for s in ("00", "11", "22")}
    assert calls.value <= 3 * tasks

    def many(s):
        call()
        yield from ((s, i) for i in range(int(s)))

    before = calls.value
    got = arrow.expand(df, ["text"], ["id"], "own string, i int", many).groupBy("own", "i").agg(F.count("*"), F.count_distinct("id"), F.bool_and(F.col("id") % 3 == F.col("own"))).collect()
    assert {tuple(r) for r in got} == {("1", 0, 10000, 10000, True), ("2", 0, 10000, 10000, True), ("2", 1, 10000, 10000, True)}
    assert calls.value - before <= 3 * tasks


def test_long_results_nulls_and_pairs_of_inputs(spark):
    rows = [(i, [None, "a", "b", "c" * 50000, ""][i % 5], i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, text string, k int")
    got = arrow.add(df, ["text", "k"], "k int, out array<string>", lambda s, k: (k + 10, None if s is None else [s] * 3)).collect()
    assert sorted((r.id, r.text, r.k, r.out) for r in got) == sorted(((i, s, k + 10, None if s is None else [s] * 3) for i, s, k in rows), key=lambda r: r[0])
    # more items than a flush, more copies than a batch
    out = arrow.expand(df, ["text"], ["id"], "n int", lambda s: () if s is None else ((i,) for i in range(len(s))), rows=1000)
    want = {(i, len(s), sum(range(len(s)))) for i, s, _ in rows if s}
    assert {tuple(r) for r in out.groupBy("id").agg(F.count("*"), F.sum("n")).collect()} == want
    big = arrow.expand(spark.range(5000).select("id", F.lit("x").alias("text")), ["text"], ["id"], "n int", lambda s: ((i,) for i in range(90)))
    assert [tuple(r) for r in big.agg(F.count("*"), F.count_distinct("id", "n")).collect()] == [(450000, 450000)]


def test_inputs_that_are_no_texts(spark):
    df = spark.range(10).select("id", F.array("id", F.col("id") + 1).alias("pair"))
    assert sorted(tuple(r) for r in arrow.add(df, ["pair"], "s long", lambda p: (sum(p),)).select("id", "s").collect()) == [(i, 2 * i + 1) for i in range(10)]
    assert arrow.expand(df, ["pair"], ["id"], "x long", lambda p: ((x,) for x in p)).count() == 20
    assert arrow.add(df.limit(0), ["pair"], "s long", lambda p: (0,)).count() == 0
