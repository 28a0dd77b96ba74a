"""Queries that run a stream over the tables to its end and read what it wrote (inventory 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..streaming import jobs as J
from .registry import query


def _events(t):
    e = J.file_stream(t.spark, t.glob("events"), t.events.schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts", "value")


def _run(t, out, label):
    path = scratch_dir(t.spark, label)
    J.run_once(out, path, scratch_dir(t.spark, f"{label}-state"))
    return t.spark.read.schema(out.schema).parquet(path)


@query("t1_streaming_inbox", "select min(doc_id) as doc_id, sha256(text) as content_hash from documents where text is not null group by 2")
def t1(t):
    d = J.file_stream(t.spark, t.glob("documents"), t.documents.schema).select("doc_id", "text")
    store = scratch_dir(t.spark, "inbox")
    J.ingest_unseen(d, F.col("text"), store, scratch_dir(t.spark, "inbox-state"), "doc_id")
    return J.stored(t.spark, store, d.withColumn("content_hash", F.lit("")).schema).select("doc_id", "content_hash")


@query("t2_windowed_volume", """
with w as (select time_bucket(interval 1 hour, ts) s, event_type, count(*) n from events group by 1, 2)
select epoch_us(s) as window_start_us, event_type, n from w where s + interval 1 hour <= (select date_trunc('millisecond', max(ts)) - interval 10 minute from events)
""")
def t2(t):
    out = _run(t, J.windowed_volume(_events(t), "ts", ["event_type"], "1 hour"), "volume")
    return out.select(F.unix_micros("window_start").alias("window_start_us"), "event_type", "n")


@query("t2_sliding_volume", """
with w as (select time_bucket(interval 1 hour, ts) - k * interval 1 hour s, count(*) n from events cross join (select unnest([0, 1, 2, 3, 4, 5]) k) group by 1)
select epoch_us(s) as window_start_us, n from w where s + interval 6 hour <= (select date_trunc('millisecond', max(ts)) - interval 10 minute from events)
""")
def t2b(t):
    out = _run(t, J.windowed_volume(_events(t), "ts", [], "6 hours", "1 hour"), "sliding")
    return out.select(F.unix_micros("window_start").alias("window_start_us"), "n")


@query("t3_session_bursts", """
with g as (select user_id, ts, case when ts < lag(ts) over w + interval 2 hour then 0 else 1 end nw from events window w as (partition by user_id order by ts)),
 i as (select user_id, ts, sum(nw) over (partition by user_id order by ts rows unbounded preceding) isl from g), s as (select user_id, isl, min(ts) a, max(ts) b, count(*) n from i group by 1, 2)
select user_id, epoch_us(a) as session_start_us, epoch_us(b) + 7200000000 as session_end_us, n from s where n >= 2 and b + interval 2 hour <= (select date_trunc('millisecond', max(ts)) - interval 10 minute from events)
""")
def t3(t):
    out = _run(t, J.session_bursts(_events(t), "ts", ["user_id"], "2 hours", 2), "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start_us"), F.unix_micros("session_end").alias("session_end_us"), "n")


@query("t4_streaming_tally", "select event_type, user_id % 4 as status, count(*) as n from events group by 1, 2")
def t4(t):
    out = scratch_dir(t.spark, "tally")
    J.tally_upserts(_events(t).withColumn("status", F.col("user_id") % 4), ["event_type", "status"], out, scratch_dir(t.spark, "tally-state"))
    return J.latest_tally(t.spark, out, ["event_type", "status"])


@query("t5_freshness_monitor")
def t5(t):
    spark = t.spark
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, J.ROCKSDB)
    try:
        out = _run(t, J.freshness_monitor(_events(t), "user_id", "ts"), "freshness")
    finally:
        spark.conf.set(key, before)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
