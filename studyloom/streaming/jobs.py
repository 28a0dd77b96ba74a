"""Structured Streaming jobs (inventory T1-T5). Each has a batch twin among the operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scoring import DEFAULT


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Read what is there, write parquet, stop. The checkpoint folder makes a restart continue."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def ingest_unseen(stream: DataFrame, content: Column, store: str, checkpoint: str, ident: str) -> StreamingQuery:
    """Keep the first row of every content hash ever seen, however late it comes; rows without content are left out.

    The store is its own record of what is known: one folder per query, batch and first digit of the hash. A query's id lives in its checkpoint, so a batch repeated
    after a failure writes over its own folder, while a query with a new or lost checkpoint has a folder of its own and can write over nobody's rows.
    Every batch, the first one too, is compared with all the store holds but its own folder; only the hashes are read, and only
    those of the digits that the batch has. In a batch the least ``ident`` wins.
    """
    spark = stream.sparkSession
    rows = stream.where(content.isNotNull()).withColumn("content_hash", F.sha2(content, 256))
    schema = rows.schema
    # an empty folder, so that there is something to read from the start
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/query=none/batch=-1/bucket=0")
    own: list[str] = []

    def add(batch: DataFrame, number: int) -> None:
        if not own:
            own.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        cols = batch.columns
        first = batch.groupBy("content_hash").agg(F.min_by(F.struct(*cols), ident).alias("r")).select("r.*").withColumn("bucket", F.substr("content_hash", F.lit(1), F.lit(1)))
        first = first.persist()
        try:
            digits = [r["bucket"] for r in first.select("bucket").distinct().collect()]
            known = stored(spark, store, schema).where(F.col("bucket").isin(digits) & ~((F.col("query") == own[0]) & (F.col("batch") == number))).select("content_hash")
            first.join(known, "content_hash", "left_anti").select(*cols, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/query={own[0]}/batch={number}")
        finally:
            first.unpersist()

    q = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stored(spark: SparkSession, store: str, schema) -> DataFrame:
    """Rows of an inbox store with the id of the query, the batch number and the hash's first digit."""
    own = [T.StructField("query", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.StringType())]
    return spark.read.schema(T.StructType([*schema.fields, *own])).option("basePath", store).parquet(store)


def windowed_volume(stream: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows per event-time window, emitted once a window is closed by the watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_bursts(stream: DataFrame, at: str, keys: list[str], gap: str, minimum: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions without a gap longer than ``gap`` that hold at least ``minimum`` rows."""
    g = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= minimum).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def tally_upserts(stream: DataFrame, keys: list[str], out: str, checkpoint: str, files_per_batch: str | None = None) -> StreamingQuery:
    """T4: running counts per key in update mode; each batch writes its changed counts under its number.

    Reading back takes the newest batch per key, so a batch written twice after a failure does no harm.
    """
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def upsert(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    q = counts.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_tally(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """T4: the present counts."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


class FreshnessMonitor(StatefulProcessor):
    """T5: last event per source; event-time timers report it stale and then expired.

    Limits in milliseconds. A new event of the source cancels the timers of the former one.
    """

    def __init__(self, hard_ms: int, soft_ms: int):
        self.hard_ms, self.soft_ms = hard_ms, soft_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["at_ms"].max()) for pdf in rows)
        old = self.last.get()[0] if self.last.exists() else None
        if old is None or newest > old:
            if old is not None:
                for limit in (self.hard_ms, self.soft_ms):
                    self.handle.deleteTimer(old + limit)
            self.last.update((newest,))
            for limit in (self.hard_ms, self.soft_ms):
                self.handle.registerTimer(newest + limit)
            yield self._row(key, "fresh", newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        fired = expiredTimerInfo.getExpiryTimeInMs()
        yield self._row(key, "expired" if fired >= last + self.soft_ms else "stale", last)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, state: str, last: int) -> pd.DataFrame:
        return pd.DataFrame({"source": [str(key[0])], "state": [state], "last_ms": [last]})


def freshness_monitor(stream: DataFrame, key: str, at: str, delay: str = "1 minute", horizon: int = 0) -> DataFrame:
    """T5: one row whenever a source becomes fresh, stale or expired. Needs the RocksDB state store."""
    _, hard, soft = DEFAULT.freshness[horizon]
    s = stream.withWatermark(at, delay).withColumn("at_ms", F.unix_millis(F.col(at))).select(F.col(key).cast("string").alias("source"), at, "at_ms")
    return s.groupBy("source").transformWithStateInPandas(
        FreshnessMonitor(hard * 1000, soft * 1000), "source string, state string, last_ms long", "append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
