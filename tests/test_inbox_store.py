"""The inbox store outlives its checkpoint; Poisson quantiles beyond 32 bits."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from studyloom.operators import series as S
from studyloom.session import scratch_dir
from studyloom.streaming import jobs as J

SCHEMA = "id long, body string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, src, store, state):
    J.ingest_unseen(J.file_stream(spark, src, SCHEMA), F.col("body"), store, state, "id")
    return sorted((r["id"], r["body"]) for r in spark.read.parquet(store).collect())


def test_new_checkpoint_over_an_old_store(spark):
    src, store = scratch_dir(spark, "box-in"), scratch_dir(spark, "box")
    put(spark, src, [(1, "x"), (2, "y")])
    first = scratch_dir(spark, "box-state")
    ingest(spark, src, store, first)
    put(spark, src, [(3, "z")])
    assert ingest(spark, src, store, first) == [(1, "x"), (2, "y"), (3, "z")]
    # a new checkpoint reads all files again: nothing twice, nothing lost
    assert ingest(spark, src, store, scratch_dir(spark, "box-state")) == [(1, "x"), (2, "y"), (3, "z")]
    # the files are gone, other content comes, the checkpoint is new once more: what was there stays
    other = scratch_dir(spark, "box-in")
    put(spark, other, [(9, "y"), (4, "w")])
    again = scratch_dir(spark, "box-state")
    assert ingest(spark, other, store, again) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    put(spark, other, [(5, "v"), (6, "x")])
    assert ingest(spark, other, store, again) == [(1, "x"), (2, "y"), (3, "z"), (4, "w"), (5, "v")]


def test_repeated_batch_writes_over_itself(spark):
    """A commit that is lost after the rows were written: the same batch runs again under the same id."""
    src, store, state = (scratch_dir(spark, n) for n in ("rep-in", "rep", "rep-state"))
    put(spark, src, [(1, "x"), (2, "y")])
    ingest(spark, src, store, state)
    shutil.rmtree(state.removeprefix("file:") + "/commits")
    assert ingest(spark, src, store, state) == [(1, "x"), (2, "y")]
    rows = J.stored(spark, store, spark.createDataFrame([], SCHEMA + ", content_hash string").schema)
    assert {(r.batch, r.bucket) for r in rows.collect()} <= {(0, d) for d in "0123456789abcdef"} and rows.select("query").distinct().count() == 1


def plain(rate, p):
    total, term, k = 0.0, math.exp(-rate), 0
    while True:
        total += term
        if total >= p:
            return k
        k += 1
        term *= rate / k


def test_poisson_quantiles_at_every_size(spark):
    small = [0.0, 1e-9, 0.1, 1.0, 3.7, 25.0, 400.0]
    odd = [None, -1.0, float("nan"), float("inf"), 1e30]
    large = [5e9, 2.0**31 * 1.5, 1e10, 1.0001e10, 1e15]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(small + odd + large)], "i long, x double")
    got = {r.i: r for r in df.select("i", S.poisson_quantile(F.col("x"), 0.1).alias("lo"), S.poisson_quantile(F.col("x"), 0.9).alias("hi")).collect()}
    for i, x in enumerate(small):
        assert (got[i].lo, got[i].hi) == (plain(x, 0.1), plain(x, 0.9))
    assert all(got[len(small) + i].lo is None for i in range(len(odd)))
    for i, x in enumerate(large):
        r = got[len(small) + len(odd) + i]
        for v, z in ((r.lo, -1.2815515655446004), (r.hi, 1.2815515655446004)):
            assert v == pytest.approx(x + z * math.sqrt(x) + (z * z - 1) / 6 - 0.5, abs=1.01)
    # both rules agree where they meet
    near = spark.range(40).selectExpr("1e6 + id * 0.37 x")
    both = near.select(S.poisson_quantile(F.col("x"), 0.9).alias("a"), S.poisson_quantile(F.col("x"), 0.9, 1.0).alias("b")).collect()
    assert all(abs(r.a - r.b) <= 1 for r in both) and sum(r.a == r.b for r in both) >= 38
