"""Weights, draws and the exact k-th key."""

import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import importance as I
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_weights_against_a_plain_count(spark):
    docs = spark.createDataFrame([(1, "good good words"), (2, "bad stuff here"), (3, None), (4, "good words")], "doc_id long, text string")
    ratio = I.log_ratio(docs, docs.where("doc_id in (1, 4)").select("doc_id"))
    raw, good = np.ones(I.BUCKETS), np.ones(I.BUCKETS)
    for i, t in docs.collect():
        for b in I.buckets_of(t):
            raw[b] += 1
            good[b] += i in (1, 4)
    assert np.allclose(ratio, np.log(good / good.sum()) - np.log(raw / raw.sum()))
    got = {r.doc_id: r for r in I.log_weights(docs, ratio).collect()}
    assert got[1].n_grams == 5 and got[3].log_weight == 0 and got[1].log_weight > 0 > got[2].log_weight


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) * 10 ** rng.randint(-3, 5) for _ in range(500)] + [7.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 17, 260, 519, 520):
        assert I.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_rows(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b"), (2, " \t\n")], "doc_id long, text string").selectExpr("*", "1 as log_weight", "2 as good")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = I.resample(docs, labels).collect()
    assert len(got) == len(texts) + 2 and sum(r.kept for r in got) in (6, 7, 8)
    assert all(r.kept for r in I.resample(docs, labels.where("false")).collect())
    assert I.resample(docs.where("false"), labels).collect() == []


def test_draw_follows_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), (F.when(F.col("id") % 4 == 0, np.log(3.0)).otherwise(0.0) + I.gumbel(F.col("id"), 1)).alias("key"))
    top = df.orderBy(F.desc("key")).limit(1000).where("doc_id % 4 = 0").count()
    assert 440 < top < 560  # a half, since a quarter of the rows weigh three times as much


def test_query_parts_good_from_junk(spark):
    got = QUERIES["op7_importance"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    kept = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.85 > 0.5 > kept[0]
