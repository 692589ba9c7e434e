"""A stream of record files gives the rows of the batch job, whatever is repeated or stopped in between."""

import pytest

from cinnabar.operators import curation, mining
from cinnabar.streaming.curation import curate, first_rows, kept, progress, record_stream, statistics

SCHEMA = "rxn_idx long, cgr_key string, rule_smarts string, validation string, seen timestamp, score double"


def drop(spark, folder, lo, hi):
    rows = spark.range(lo, hi).selectExpr("id AS rxn_idx", "if(id % 3 = 0, 'hot', concat('k', id % 7)) AS cgr_key", "concat('s', id % 5) AS rule_smarts", "if(id % 2 = 0, 'passed', 'failed') AS validation", "timestamp_micros(id * 1000003) AS seen", "if(id % 11 = 0, NULL, id / 7) AS score")
    rows.coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out):
    query = curate(record_stream(spark, folder, SCHEMA), ["cgr_key"], "rxn_idx", out)
    query.awaitTermination()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_with_a_restart_give_the_rows_of_the_batch_job(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo, hi in ((0, 40), (40, 45), (45, 200)):
        drop(spark, folder, lo, hi)
        run(spark, folder, out)  # each call is a restart from the checkpoint
    all_ = spark.read.schema(SCHEMA).parquet(folder)
    assert rows(kept(spark, out, SCHEMA)) == rows(curation.keep_first(all_, ["cgr_key"], "rxn_idx"))
    order = [r.rxn_idx for r in kept(spark, out, SCHEMA, ordered=True).collect()]
    assert order == sorted(order)
    merged = mining.merge_statistics(statistics(spark, out, SCHEMA))
    want = mining.key_statistics(all_)
    assert rows(merged.select(*sorted(merged.columns))) == rows(want.select(*sorted(want.columns)))
    assert [r.read for r in progress(spark, out).collect()] == [40, 5, 155]


def test_a_batch_that_is_written_twice_counts_once(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    drop(spark, folder, 0, 60)
    stream = record_stream(spark, folder, SCHEMA)
    seen = []

    def stops(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        seen.append(number)
        raise RuntimeError("stopped after the write, before the commit")

    query = first_rows(stream, ["cgr_key"], "rxn_idx").writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(stops).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    run(spark, folder, out)
    assert seen == [0] and [tuple(r) for r in progress(spark, out).collect()] == [(0, 60, 8, 52, 0)]
    assert sum(r.popularity for r in statistics(spark, out, SCHEMA).collect()) == 60


def test_null_keys_are_errors_and_an_empty_folder_gives_nothing(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, None, "a", "passed", None, None), (None, "k", "a", "passed", None, None), (3, "k", None, None, None, float("nan"))], SCHEMA).coalesce(1).write.parquet(folder)
    assert kept(spark, out, SCHEMA).collect() == []
    run(spark, folder, out)
    assert [tuple(r) for r in progress(spark, out).collect()] == [(0, 3, 1, 0, 2)]
    (row,) = kept(spark, out, SCHEMA).collect()
    assert row[:5] == (3, "k", None, None, None) and row.score != row.score
    with pytest.raises(ValueError):
        first_rows(spark.readStream.schema("_key string, n long").parquet(folder), ["_key"], "n")


def test_files_that_come_in_any_order_give_the_rows_of_the_table(spark, tmp_path):
    from cinnabar.plans.bindings import RULES

    folder = f"{tmp_path}/events.parquet"
    for lo in (200, 100, 0):  # later files hold earlier rows of the same keys
        spark.range(lo, lo + 100).selectExpr("id AS event_id", "timestamp_micros(id) AS ts", "id % 9 AS user_id", "if(id % 2 = 0, 'view', 'click') AS event_type", "id / 8 AS value", "'' AS props").coalesce(1).write.mode("append").parquet(folder)
    want = [(k % 9, "view" if k % 2 == 0 else "click", k, k / 8, len(range(k, 300, 18))) for k in range(18)]
    assert sorted(map(tuple, RULES["streamed_curation"](spark, str(tmp_path)).collect())) == sorted(want)


def test_batches_by_size_hold_no_state(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo in range(0, 60, 10):
        drop(spark, folder, lo, lo + 10)
    query = curate(record_stream(spark, folder, SCHEMA, bytes_per_batch=1 << 20), ["cgr_key"], "rxn_idx", out)
    query.awaitTermination()
    assert [p.stateOperators for p in query.recentProgress if p.numInputRows] == [[]]
    drop(spark, folder, 60, 63)  # hot and two known keys
    run(spark, folder, out)
    assert [tuple(r) for r in progress(spark, out).collect()] == [(0, 60, 8, 52, 0), (1, 3, 0, 3, 0)]
    assert len(kept(spark, out, SCHEMA).collect()) == 8
