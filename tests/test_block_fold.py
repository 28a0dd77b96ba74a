"""The workload fold in blocks against a plain loop."""

import random

from pyspark.sql import functions as F

from studyloom.operators import assignment as H


def plain(rows, seed):
    """rows: (pool, case, stage, tied) in any order."""
    out, loads = {}, {}
    for pool, case, stage, tied in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        load = loads.setdefault(pool, {})
        if len(tied) == 1 and stage != "BLANK":
            who, rule = tied[0], stage
        else:
            low = min(load.get(m, 0) for m in tied)
            left = [m for m in tied if load.get(m, 0) == low]
            who = min(left, key=lambda m: (H._pick(seed, case, m), m))
            rule = f"{stage} {'random' if len(left) > 1 else 'workload'}"
        out[case] = (pool, who, rule, load.get(who, 0))
        load[who] = load.get(who, 0) + 1
    return out


def made(seed, n, hot):
    rng = random.Random(seed)
    names = [f"C{i}" for i in range(6)]
    rows = []
    for case in range(n):
        pool = "hot" if rng.random() < hot else rng.choice([None, "a", "b", "z"])
        # uneven: decided cases favour some members, so workloads differ for a long time
        tied = [rng.choice(names[:2])] if rng.random() < .3 else rng.sample(names, rng.randint(2, 5))
        rows.append((pool, case, rng.choice(["NS", "FT", "BLANK"]), tied))
    return rows


def run(spark, rows, parts):
    df = spark.createDataFrame(rows, "pool string, case_id long, stage string, tied array<string>").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        done = H.workload_fold(df.select("case_id", "pool"), df.select("case_id", "stage", "tied"), ["pool"], ["case_id"], 7)
        got = {r.case_id: (r.pool, r.member, r.rule, r.load_before) for r in done.collect()}
        return got, {r.pool: r.n for r in done.groupBy("pool", F.spark_partition_id().alias("p")).count().groupBy("pool").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_equal_the_plain_fold(many_blocks):
    for seed, hot, parts in ((1, .6, 12), (2, 1.0, 9), (3, .2, 5)):
        rows = made(seed, 700, hot)
        got, tasks = run(many_blocks, rows, parts)
        assert got == plain(rows, 7)
        assert tasks["hot"] >= (parts if hot == 1 else parts * hot - 2)  # a pool with most rows is as many tasks as it has blocks


def test_a_lead_is_carried_through_all_blocks(many_blocks):
    """One member is far ahead at the start, so each later block favours the others, which its own rows don't show."""
    rows = [("hot", i, "NS", ["C0"]) for i in range(150)] + [("hot", i, "NS", ["C0", "C1"]) for i in range(150, 600)]
    got, tasks = run(many_blocks, rows, 8)
    assert got == plain(rows, 7) and tasks["hot"] == 8
    assert all(got[i][1] == "C1" for i in range(150, 300))


def test_edges_of_the_fold(spark):
    assert run(spark, [], 4)[0] == {}
    rows = [("a", 1, "NS", ["x"]), (None, 2, "FT", ["x", "y"]), ("a", 3, "BLANK", ["x"])]
    assert run(spark, rows, 4)[0] == plain(rows, 7)


def test_visits_without_an_option_come_back(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["h02_greedy_plan"](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert got.count() == got.select("visit_id").distinct().count() == orders.count()
    bare = orders.join(spark.read.parquet(f"{sf}/lineitem.parquet"), orders.o_orderkey == F.col("l_orderkey"), "left_anti")
    assert got.where("staff_id is null").join(bare, F.col("visit_id") == F.col("o_orderkey")).count() == bare.count()
