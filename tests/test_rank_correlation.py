"""Rank correlations against average ranks and a plain correlation."""

import re

import numpy as np
import pandas as pd

from studyloom.operators import stats as S


def plain(frame, a, b):
    ranks = frame.rank(method="average")
    return np.corrcoef(ranks[a], ranks[b])[0, 1]


def test_matches_plain_ranks(spark):
    rng = np.random.default_rng(4)
    n = 400
    frame = pd.DataFrame({"a": rng.integers(0, 5, n), "b": rng.integers(0, 50, n), "c": rng.normal(size=n), "d": np.where(rng.random(n) < 0.7, 1, rng.integers(0, 9, n))}).astype(float)
    frame["c"] += frame["a"]
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r.a, r.b): r for r in S.spearman_matrix(df, list(frame)).collect()}
    assert len(got) == 6 and all(r.n == n for r in got.values())
    for (a, b), r in got.items():
        assert abs(r.rho - plain(frame, a, b)) < 1e-12
    totals = {r.item: r.rho for r in S.item_total(df, list(frame)).collect()}
    for c in frame:
        rest = frame.assign(rest=(frame.sum(axis=1) - frame[c]).round(9))
        assert abs(totals[c] - plain(rest, c, "rest")) < 1e-12


def test_odd_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 3.0, 5.0), (None, 9.0, 5.0), (4.0, None, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, pair double")
    got = {(r.a, r.b): (r.n, r.rho) for r in S.spearman_matrix(df, ["x", "y", "pair"]).collect()}
    assert got == {("x", "y"): (3, 0.5), ("x", "pair"): (3, None), ("y", "pair"): (3, None)}
    assert [(r.n, r.rho) for r in S.spearman_matrix(df.where("false"), ["x", "y"]).collect()] == [(0, None)]
    same = S.rank_correlations(df, [("x", "x")]).collect()
    assert [(r.n, r.rho) for r in same] == [(4, 1.0)]


def test_shuffles_do_not_grow_with_the_columns(spark):
    df = spark.range(200).selectExpr(*[f"cast(id * {k + 3} % 17 as double) as c{k}" for k in range(10)])

    def exchanges(columns):
        plan = S.spearman_matrix(df, columns)._jdf.queryExecution().executedPlan().toString()
        return len(re.findall("Exchange", plan))

    assert exchanges(["c0", "c1"]) == exchanges([f"c{k}" for k in range(10)])
