"""Gates and readers that must not let anything through unseen."""

import pytest
from pyspark.sql import functions as F

from studyloom.functions import text as X
from studyloom.operators import models, series, stats
from studyloom.operators.audit import poisson_one
from studyloom.session import scratch_dir
from studyloom.sources import readers as R


def test_every_cached_file_must_agree(spark):
    path = scratch_dir(spark, "cache")
    spark.range(1000).selectExpr("id % 7 as a", "id as b").repartition(3).write.parquet(path)
    side = scratch_dir(spark, "side")
    R.parquet_fingerprints(spark, [path]).write.parquet(side)
    said = spark.read.parquet(side)
    assert R.verified_parquet(spark, [path], said).count() == 1000 and said.count() == 3
    one = said.limit(1)
    for wrong in (said.where("false"), said.join(one.select("path"), "path", "left_anti"), said.unionByName(one), said.withColumn("row_hash", F.lit("1")), said.withColumn("rows", F.col("rows") + 1)):
        with pytest.raises(ValueError):
            R.verified_parquet(spark, [path], wrong)


def test_equal_rows_do_not_cancel_out(spark):
    hashes = []
    for pair in ((1, 1), (2, 2), (1, 2)):
        path = scratch_dir(spark, "pair")
        spark.createDataFrame([(x,) for x in pair], "a int").coalesce(1).write.parquet(path)
        hashes.append(R.parquet_fingerprints(spark, [path]).agg(F.max("row_hash")).first()[0])
    assert len(set(hashes)) == 3


def test_poisson_quantiles_at_every_rate(spark):
    from math import exp, lgamma, log

    rates = [0.0, 0.3, 4.0, 57.5, 499.0, 501.0, 900.5, 12345.0, None, -1.0]
    df = spark.createDataFrame([(r,) for r in rates], "rate double")
    for p in (0.1, 0.5, 0.9, 0.999):
        for r in df.select("rate", series.poisson_quantile(F.col("rate"), p).alias("q")).collect():
            if r.rate is None or r.rate < 0:
                assert r.q is None
                continue
            cdf, k = exp(-r.rate) if r.rate < 700 else 0.0, 0
            while cdf < p:
                k += 1
                cdf += exp(k * log(r.rate) - r.rate - lgamma(k + 1)) if r.rate else 0
            assert r.q == k, (r, p)


def test_tipping_point_walks_every_split(spark):
    df = spark.createDataFrame([("x", 30, 40, 20, 50, 25)], "k string, success_a int, total_a int, success_b int, total_b int, excluded int")
    for rows in (10_000, 4):
        got = {r.added_a: r for r in stats.tipping_point(df, ["k"], rows).collect()}
        assert sorted(got) == list(range(26)) and all(r.added_a + r.added_b == 25 for r in got.values())
        assert abs(got[0].gap - (75 - 20 / 75 * 100)) < 1e-9 and abs(got[25].gap - (30 / 65 * 100 - 40)) < 1e-9


def test_comparison_keys_decode_every_entity(spark):
    df = spark.createDataFrame([("Caf&eacute; &#233; &#xE9;",), ("CAFÉ é É",), (None,), ("a & b",)], "t string")
    got = [r.k for r in df.select(X.comparison_key(F.col("t")).alias("k")).collect()]
    assert got[0] == got[1] == "café é é" and got[2] in (None, "") and got[3] == "a & b"


def test_exact_auc(spark):
    rows = [(i % 2, (i * 37 % 101) / 101 + 0.1 * (i % 2)) for i in range(600)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(models.auc(spark.createDataFrame(rows, "label int, score double")) - want) < 1e-12


def test_poisson_draws_reach_the_tail(spark):
    from math import exp, factorial

    cdf = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(16)]
    df = spark.createDataFrame([(c - 1e-15 if k < 15 else 1 - 1e-15, k) for k, c in enumerate(cdf) if k < 14], "u double, k int")
    assert all(r.d == r.k for r in df.select("k", poisson_one(F.col("u")).alias("d")).collect())


def test_alignment_gates(spark):
    from studyloom.operators import alignment as A

    a = spark.createDataFrame([("r", 0, 1), ("r", 40, 2), ("r", 80, 3)], "k string, at long, i long")
    b = a.select("k", (F.col("at") + 1).alias("at"), F.col("i").alias("j"))
    A.assert_unique_times(a, ["k"], "at")
    A.assert_overlap(a, b, ["k"], "at")
    for twice in (a.unionByName(a.limit(1)), a.withColumn("at", F.when(F.col("i") > 1, F.col("at")))):
        with pytest.raises(ValueError):
            A.assert_unique_times(twice, ["k"], "at")
    for other in (b.withColumn("at", F.col("at") + 1000), b.where("false")):
        with pytest.raises(ValueError):
            A.assert_overlap(a, other, ["k"], "at")
    whole = A.coverage(A.nearest_join(a, b, ["k"], "at", "i", "j", 5), a, b, ["k"], "j")
    A.assert_coverage(whole)
    with pytest.raises(ValueError):
        A.assert_coverage(A.coverage(A.nearest_join(a, b.where("j < 3"), ["k"], "at", "i", "j", 5), a, b.where("j < 3"), ["k"], "j"))


def test_safe_csv_treats_names_like_cells(spark, tmp_path):
    from studyloom.sources import sinks

    df = spark.createDataFrame([("x", "y", "z", 1)], "`=SUM(A1)` string, `API Token` string, `Bearer abcdefghijklmnop` string, `plain` int")
    sinks.write_safe_csv(df, f"{tmp_path}/csv")
    head = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()[0]
    assert head == "\"'=SUM(A1)\",\"API Token\",\"[REDACTED]\",\"plain\""


def test_visits_without_options_are_unfilled(spark):
    from studyloom.operators import assignment as H

    options = spark.createDataFrame([("s", 1, "a", 0.9, 0, 2, 1), ("s", 2, "a", 0.8, 1, 3, 2)], "site string, visit_id long, staff_id string, score double, start long, end long, capacity int")
    visits = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 9)], "site string, visit_id long")
    plan = H.greedy_plan(options, ["site"], visits)
    assert {(r.site, r.visit_id): r.staff_id for r in plan.collect()} == {("s", 1): "a", ("s", 2): None, ("s", 3): None, ("t", 9): None}
    report = {r.site: r for r in H.regret_report(options, plan, ["site"]).collect()}
    assert (report["s"].visits, report["s"].unfilled, report["t"].unfilled, report["t"].escalate) == (3, 2, 1, True)


def test_absent_baseline_and_few_values(spark):
    from studyloom.operators import audit

    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.7), ("b", 3, 0.5), ("b", 4, 0.6), ("b", 5, 0.1)], "g string, i long, v double")
    assert [r.psi for r in audit.stability_index(df, "g", "none", "v").collect()] == [0.0, 0.0]
    got = {r.g: r for r in audit.bootstrap_gini(df, ["g"], "i", "v", 50, 3).collect()}
    assert (got["a"].low, got["a"].high) == (0.0, 1.0) and got["b"].low <= got["b"].gini <= 1 and got["b"].high < 1


def test_latest_copy_switches_whole(spark):
    from studyloom.sources import sinks

    base = scratch_dir(spark, "publish")
    make = lambda day, n: spark.createDataFrame([(day, "a", n), (day, "b", n)], "d string, src string, n int")
    sinks.publish_snapshot(make("2024-01-01", 1), base, "d", "src", {"a", "b"})
    before = sinks.read_latest(spark, base)
    sinks.publish_snapshot(make("2024-02-01", 2), base, "d", "src", {"a", "b"})
    assert {r.n for r in before.collect()} == {1} and {r.n for r in sinks.read_latest(spark, base).collect()} == {2}
    with pytest.raises(ValueError):
        sinks.publish_snapshot(make("2024-03-01", 3).where("src = 'a'"), base, "d", "src", {"a", "b"})
    assert {r.n for r in sinks.read_latest(spark, base).collect()} == {2}
