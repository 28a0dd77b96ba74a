"""Overlap counts and containment by sweep lines against all pairs."""

import random

from pyspark.sql import functions as F

from studyloom.operators import intervals as I

W, B = "k string, id long, start long, end long", "k string, start long, end long"


def made(seed, n, m):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    span = lambda most: (s := rng.randint(0, 120), s + rng.randint(0, most))
    return [(key(), i, *span(15)) for i in range(n)] + [("a", 900, None, 5), ("a", 901, 3, None)], [(key(), *span(12)) for _ in range(m)] + [("hot", None, 9)]


def test_counts_equal_pairs(many_blocks):
    for seed in (1, 2):
        windows, busy = made(seed, 300, 200)
        got = {(r.k, r.id): r.n for r in I.overlap_counts(many_blocks.createDataFrame(windows, W).repartition(5), many_blocks.createDataFrame(busy, B), ["k"], "id").collect()}
        for k, i, s, e in windows:
            if k is None or s is None or e is None:
                assert (k, i) not in got
                continue
            want = sum(1 for q, x, y in busy if q == k and x is not None and x < e and s < y)
            assert got[k, i] == want, (k, i)


def test_containment_equals_pairs(many_blocks):
    for seed in (3, 4):
        windows, busy = made(seed, 300, 40)
        merged = {}
        for k, s, e in sorted((b for b in busy if None not in b and b[1] < b[2]), key=lambda b: (b[0], b[1])):
            mine = merged.setdefault(k, [])
            if mine and s <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], e)
            else:
                mine.append([s, e])
        cover = many_blocks.createDataFrame([(k, *x) for k, v in merged.items() for x in v], B)
        got = {(r.k, r.id) for r in I.contained(many_blocks.createDataFrame(windows, W).repartition(5), cover, ["k"], "id").collect()}
        want = {(k, i) for k, i, s, e in windows if None not in (k, s, e) and any(x <= s and e <= y and x < e and s < y for x, y in merged.get(k, []))}
        assert got == want


def test_no_pairs_in_the_plans(spark):
    import __spark_entry__ as entry

    for key in ("j19_evidence_state", "f10_resource_checks", "j09_containment"):
        text = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "start_b" not in text and "start_a" not in text and "<" not in "".join(x for x in text.split("\n") if x.strip(" :+-").startswith("Join")), key


def test_empty_sides(spark):
    windows, busy = spark.createDataFrame([("a", 1, 0, 5)], W), spark.createDataFrame([("a", 1, 2)], B)
    assert [r.n for r in I.overlap_counts(windows, busy.where("false"), ["k"], "id").collect()] == [0]
    assert I.overlap_counts(windows.where("false"), busy, ["k"], "id").collect() == [] == I.contained(windows, busy.where("false"), ["k"], "id").collect()
    twice = I.overlap_counts(windows.unionByName(windows.withColumn("id", F.lit(2).cast("long"))), busy.unionByName(busy), ["k"], "id")
    assert sorted((r.id, r.n) for r in twice.collect()) == [(1, 2), (2, 2)]
