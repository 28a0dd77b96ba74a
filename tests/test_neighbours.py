"""The pivot index against all pairs, and how many distances it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import neighbours as N

C = ["a", "b", "c"]


def frame(spark, x, ref):
    return spark.createDataFrame([(i, *map(float, v), bool(r)) for i, (v, r) in enumerate(zip(x, ref))], "i long, a double, b double, c double, ref boolean").repartition(6)


def plain(x, ref, k):
    out = {}
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        out[i] = sorted((d[j], j) for j in range(len(x)) if ref[j] and j != i)[:k]
    return out


def clouds(seed, n, centres=25, spread=.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 10, (centres, 3))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, 3))


def test_index_finds_the_nearest_pivot_and_all_open_cells():
    rng = np.random.default_rng(1)
    x = clouds(2, 800)
    index = N.PivotIndex(x[rng.permutation(800)[:40]])
    cell, d, to, looked = index.assign(x)
    all_d = N.distances(x, index.pivots)
    assert np.allclose(all_d.min(1), d) and (all_d.argmin(1) == cell).all() and looked < all_d.size
    for c in range(40):
        own = d[cell == c]
        if len(own):
            index.count[c], index.low[c], index.high[c] = len(own), own.min(), own.max()
    r = rng.random(800) * 3
    rows, cells, _, _ = index.open_cells(x, cell, to, r)
    there = set(zip(rows.tolist(), cells.tolist()))
    pair = N.distances(x, x)
    for i, j in zip(*np.nonzero(pair <= r[:, None])):
        assert cell[j] == cell[i] or (i, cell[j]) in there
    assert len(there) < 800 * 40 / 2


@pytest.mark.parametrize("sizes", [(4096, 4096), (37, 20)])
def test_nearest_against_all_pairs(spark, sizes):
    x = clouds(3, 500)
    x[100:160] = x[0]  # copies: ties go by id
    x[300:340] = np.round(x[300:340])
    ref = np.arange(500) % 4 != 0
    got = {r.i: [(e.d, e.o) for e in r.near] for r in N.nearest_rows(frame(spark, x, ref), "i", C, F.col("ref"), 7, *sizes).collect()}
    assert set(got) == set(range(500))
    for i, near in plain(x, ref, 7).items():
        assert [o for _, o in got[i]] == [o for _, o in near] and np.allclose([d for d, _ in got[i]], [d for d, _ in near])


def test_few_reference_rows_and_odd_ones(spark):
    nan = float("nan")
    rows = [(1, 0., 0., 0., True), (2, 1., 0., 0., True), (3, 5., 0., 0., None), (4, None, 0., 0., True), (5, nan, 0., 0., True), (6, 0., 0., 0., False)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, ref boolean")
    got = {r.i: [tuple(e) for e in r.near] for r in N.nearest_rows(df, "i", C, F.col("ref"), 3).collect()}
    assert got == {1: [(1.0, 2)], 2: [(1.0, 1)], 3: [(4.0, 2), (5.0, 1)], 6: [(0.0, 1), (1.0, 2)]}
    assert all(r.near == [] for r in N.nearest_rows(df, "i", C, F.lit(False), 3).collect())
    assert N.nearest_rows(df.where("false"), "i", C, F.col("ref"), 3).collect() == []


def test_distances_taken_on_clustered_rows(spark):
    n = 6000
    x = clouds(5, n, centres=300)
    df = frame(spark, x, np.ones(n, bool))
    r = N.nearest_rows(df, "i", C, F.lit(True), 5, counted=True).first()
    assert r.rows == n and r.looked < n * np.sqrt(n)
    # a vector that half of all rows share costs no more
    x[::2] = x[0]
    half = N.nearest_rows(frame(spark, x, np.ones(n, bool)), "i", C, F.lit(True), 5, counted=True).first()
    assert half.looked < r.looked
