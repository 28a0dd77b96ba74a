import datetime as dt

from pyspark.sql import functions as F

from studyloom.session import scratch_dir
from studyloom.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1, 12, 0)


def _write(spark, path, rows):
    spark.createDataFrame(rows, "id long, k string, ts timestamp, body string").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_do_not_reopen_closed_windows(spark):
    src, out, state = (scratch_dir(spark, n) for n in ("late-in", "late-out", "late-state"))
    schema = "id long, k string, ts timestamp, body string"

    def step():
        s = J.windowed_volume(J.file_stream(spark, src, schema), "ts", ["k"], "10 minutes", delay="5 minutes")
        J.run_once(s, out, state)
        return s.schema

    _write(spark, src, [(1, "a", T0, "x"), (2, "a", T0 + dt.timedelta(minutes=1), "x"), (3, "a", T0 + dt.timedelta(minutes=40), "x")])
    step()
    _write(spark, src, [(4, "a", T0 + dt.timedelta(minutes=2), "late"), (5, "a", T0 + dt.timedelta(minutes=90), "x")])
    schema2 = step()
    got = {(r["window_start"], r["n"]) for r in spark.read.schema(schema2).parquet(out).collect()}
    assert (T0, 2) in got and (T0 + dt.timedelta(minutes=40), 1) in got and len(got) == 2


def test_restart_does_not_ingest_twice(spark):
    """Known content stays out over restarts, late content that was never seen comes in."""
    src, store, state = (scratch_dir(spark, n) for n in ("in", "out", "state"))
    schema = "id long, k string, ts timestamp, body string"

    def step():
        J.ingest_unseen(J.file_stream(spark, src, schema), F.col("body"), store, state, "id")

    _write(spark, src, [(1, "a", T0, "same"), (2, "a", T0, "same"), (3, "a", T0, None)])
    step()
    _write(spark, src, [(4, "a", T0 + dt.timedelta(days=90), "same"), (5, "a", T0 + dt.timedelta(days=90), "new")])
    step()
    _write(spark, src, [(6, "a", T0 - dt.timedelta(days=900), "late"), (7, "a", T0 + dt.timedelta(days=900), "same")])
    step()
    assert sorted((r["id"], r["body"]) for r in spark.read.parquet(store).collect()) == [(1, "same"), (5, "new"), (6, "late")]


def test_freshness_timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, J.ROCKSDB)
    try:
        src, out, state = (scratch_dir(spark, n) for n in ("f-in", "f-out", "f-state"))
        schema = "id long, k string, ts timestamp, body string"
        for rows in ([(1, "a", T0, ""), (2, "b", T0, "")], [(3, "b", T0 + dt.timedelta(minutes=30), "")], [(4, "c", T0 + dt.timedelta(hours=3), "")]):
            _write(spark, src, rows)
            J.run_once(J.freshness_monitor(J.file_stream(spark, src, schema), "k", "ts"), out, state)
        got = {(r["source"], r["state"]) for r in spark.read.parquet(out).collect()}
        assert {("a", "fresh"), ("a", "stale"), ("a", "expired"), ("b", "expired"), ("c", "fresh")} <= got and ("c", "stale") not in got
    finally:
        spark.conf.set(key, before)
