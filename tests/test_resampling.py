"""Resamples and reshuffles against plain counting, at the reference's counts."""

import inspect

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studyloom.operators import audit as A, models as M

SF = "/root/testdata/sf0.001"


def test_bootstrap_gini_equals_plain_resamples(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v)) for i, (g, v) in enumerate(zip(rng.choice(["a", "b"], 600), rng.integers(0, 30, 600)))]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(7)
    got = {r.g: r for r in A.bootstrap_gini(df, ["g"], "i", "v", 200, 3).collect()}
    ids = {r.i: r.h for r in df.select("i", F.xxhash64(F.lit(3), "i").alias("h")).collect()}
    for g in "ab":
        mine = [(v, ids[i]) for k, i, v in rows if k == g]
        u = (A.draw_hashes(np.array([h for _, h in mine]), 200, 3) >> np.uint64(11)) / 2.0**53
        ginis = []
        for d in range(200):
            w = [sum(x >= c for c in A.poisson_table()) for x in u[:, d]]
            x = np.sort(np.repeat([v for v, _ in mine], w))
            ginis.append(2 * (np.arange(1, len(x) + 1) * x).sum() / (len(x) * x.sum()) - (len(x) + 1) / len(x))
        ginis.sort()
        assert abs(got[g].low - ginis[5]) < 1e-9 and abs(got[g].high - ginis[195]) < 1e-9 and got[g].draws == 200


def test_permutation_equals_plain_shuffles(spark):
    rng = np.random.default_rng(5)
    cand = [("p", r, int(s)) for r in range(40) for s in rng.choice(8, 3, replace=False)]
    best = [("p", r, min(s for _, q, s in cand if q == r)) for r in range(40)]
    schema = "k string, r int, s int"
    c, b = spark.createDataFrame(cand, schema), spark.createDataFrame(best, schema)
    row = A.permutation_cv(c.repartition(5), b, ["k"], "r", "s", 300, 11).collect()[0]
    lots = {(r.r, r.s): r.h for r in c.select("r", "s", F.xxhash64(F.lit(11), "r", "s").alias("h")).collect()}
    members = sorted({s for _, _, s in cand})

    def cv(picks):
        loads = np.array([picks.count(m) for m in members], float)
        return loads.std() / loads.mean()

    pools = {r: [s for _, q, s in cand if q == r] for r in range(40)}
    hashes = {r: A.draw_hashes(np.array([lots[r, s] for s in pool]), 300, 11) for r, pool in pools.items()}
    seen = cv([s for _, _, s in best])
    want = sum(cv([pools[r][int(hashes[r][:, d].argmin())] for r in pools]) >= seen - 1e-12 for d in range(300)) / 300
    assert abs(row.observed_cv - seen) < 1e-9 and row.p_value == want


def test_counts_are_the_reference_ones(spark):
    # a resample of very few rows can be empty and is left out
    assert all(1800 < r.draws <= 2000 for r in entry.queries()["a51_bootstrap_gini"](spark, SF).collect())
    default = lambda f, k: inspect.signature(f).parameters[k].default
    assert default(A.permutation_cv, "iterations") == 1000 and default(M.bootstrap_mean, "draws") == 500 and default(M.stability, "repeats") == 100
    assert default(M.out_of_fold, "folds") == 5 and default(M.out_of_fold, "rounds") == default(M.permutation_importance, "rounds") == 250


def test_loads_stay_within_their_cells(spark):
    """Loads of all members for all iterations do not fit ``cells``: more ranges give the same shares, also with a pool over 64 and names as ids."""
    rng = np.random.default_rng(6)
    cand = [(k, r, f"m{s}") for k in ("p", None) for r in range(30) for s in rng.choice(150, 100 if r == 7 else 3, replace=False)] + [("p", 50, None), ("q", 1, None)]
    best = [(k, r, min(s for j, q, s in cand if (j, q) == (k, r))) for k in ("p", None) for r in range(30)]
    schema = "k string, r int, s string"
    c, b = spark.createDataFrame(cand, schema), spark.createDataFrame(best, schema)
    lots = {(r.r, r.s): r.h for r in c.select("r", "s", F.xxhash64(F.lit(11), "r", "s").alias("h")).collect()}
    want = {}
    for k in ("p", None):
        members = {s for j, _, s in cand if j == k}  # an id that is missing counts as a member, but nobody is given to it
        pools = {r: [s for j, q, s in cand if (j, q) == (k, r)] for r in range(30)}

        def cv(picks):
            loads = np.array([picks.count(m) for m in members], float)
            return loads.std() / loads.mean()

        hashes = {r: A.draw_hashes(np.array([lots[r, s] for s in pool]), 90, 11) for r, pool in pools.items()}
        seen = cv([s for j, _, s in best if j == k])
        want[k] = sum(cv([pools[r][int(hashes[r][:, d].argmin())] for r in pools]) >= seen - 1e-12 for d in range(90)) / 90
    for cells in (1 << 24, 1_500):
        got = {r.k: r.p_value for r in A.permutation_cv(c.repartition(5), b, ["k"], "r", "s", 90, 11, cells=cells).collect()}
        assert got == want


def test_picks_stay_small_when_members_are_many():
    """The loads a task holds are one number per member and draw, whatever the number of runs."""
    loads, rng = np.zeros((5, 7), np.int32), np.random.default_rng(2)
    sizes = np.array([0, 1, 3, 70, 2, 600])
    codes, ids = rng.integers(0, 5, sizes.sum()), rng.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
    lots = A.mixed(np.arange(1, 8, dtype=np.uint64))
    A._count_picks(loads, codes, ids, sizes, lots)
    want, lo = np.zeros_like(loads), 0
    for n in sizes:
        if n:
            first = A.mixed(ids[lo:lo + n][:, None] ^ lots).argmin(0)
            want[codes[lo + first], np.arange(7)] += 1
        lo += n
    assert (loads == want).all() and (loads.sum(0) == 5).all()
