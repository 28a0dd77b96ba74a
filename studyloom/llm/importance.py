"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's importance is the log ratio of two bags of hashed words and word pairs: one of target texts (labelled good), one of all texts.
Adding Gumbel noise to the log weights and keeping the largest k draws k texts without replacement in proportion to their weights. Noise is a hash of the
id, so a rerun draws the same. The k-th largest key is found by counting keys in ever finer ranges, never by sorting all in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .jaccard import mix, words_of

BUCKETS = 10_000


def buckets_of(text: str | None) -> np.ndarray:
    """Bucket numbers of the words and word pairs of a text."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    a = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = mix(a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:])
    return (np.concatenate([a, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def log_ratio(docs: DataFrame, target: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Per bucket, the log of its share in target texts over its share in all. docs: (doc_id, text); target: (doc_id), sent to all tasks."""
    marked = docs.join(F.broadcast(target.select("doc_id").distinct().withColumn("_good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(buckets_of(text.as_py()), minlength=BUCKETS)
                totals[0] += n
                if good:
                    totals[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(totals[0]), pa.array(totals[1])], ["bucket", "raw", "good"])

    sums = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(BUCKETS)  # nothing to prefer
    return np.log((good + smooth) / (good + smooth).sum()) - np.log((raw + smooth) / (raw + smooth).sum())


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Rows (doc_id, n_grams, log_weight); a text without words has weight 0, that of an average one."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = [], []
            for text in b.column(1):
                at = buckets_of(text.as_py())
                n.append(len(at))
                w.append(float(held.value[at].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int, ranges: int = 1024, rounds: int = 12) -> float:
    """The k-th largest value of a finite column, exactly: each round counts the values in equal ranges and goes on in the one that holds it."""
    lo, hi, above = *df.agg(F.min(col), F.max(col)).first(), 0
    for _ in range(rounds):
        if lo == hi:
            return lo
        width = (hi - lo) / ranges
        at = F.least(F.lit(ranges - 1), F.floor((F.col(col) - lo) / width).cast("int")) if width > 0 else F.lit(0)
        counts = df.where(F.col(col).between(lo, hi)).groupBy(at.alias("r")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("r")).collect()
        for c in counts:
            if above + c["n"] >= k:
                lo, hi = c["lo"], c["hi"]
                break
            above += c["n"]
    if lo != hi:
        raise RuntimeError("keys too close to tell apart")
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, doc_id: str = "doc_id", text: str = "text", target_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight, gumbel_key, kept. Of all rows the best ``share`` are kept.

    The target model is fitted on at most about ``target_rows`` rows labelled good and not toxic, chosen by a hash of the id; the raw model
    counts every text. Without ``share``, it is the good rows' share among those labelled. Equal keys (repeated rows) are kept or
    dropped together. Null text has no n-grams; rows without an id get the noise of a null. An empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    good = F.coalesce((F.col("quality") == 1) & ~(F.coalesce(F.col("toxic"), F.lit(0)) == 1), F.lit(False))
    known = labels.where("doc_id is not null and quality is not null")
    total, n_good = known.agg(F.count("*"), F.count_if(good)).first()
    part = min(1.0, target_rows / max(1, n_good))
    target = known.where(good & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))).select("doc_id")
    ratio = log_ratio(docs, target)
    keyed = written(log_weights(docs, ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "importance")
    n = keyed.count()
    share = (n_good / total if total else 1.0) if share is None else share
    k = round(share * n)
    if n == 0 or k == 0 or k >= n:
        return keyed.withColumn("kept", F.lit(k > 0))
    return keyed.withColumn("kept", F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))
