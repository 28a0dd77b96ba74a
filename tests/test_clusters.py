"""Many starts against single ones, against plain passes and against closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture, KMeans

from studyloom.operators import clusters as C, models as M

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(m, s, (n, 3)) for m, s, n in (((0, 0, 0), .5, 120), ((3, 0, 0), .4, 90), ((0, 3, 1), .8, 60), ((3, 3, 3), .3, 30))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double").repartition(5)
    return df, x


def inertia(x, centres):
    return float(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum())


def test_best_of_many_starts(cloud):
    df, x = cloud
    fits = C.kmeans_table(C.points(df, "i", COLUMNS), 3, (2, 3, 4, 5), 30)
    single = {k: KMeans(k=k, seed=7).fit(M.with_features(df, COLUMNS)).summary.trainingCost for k in fits}
    for k, fit in fits.items():
        assert fit.centres.shape == (k, 3) and fit.sizes.sum() == len(x) and abs(fit.inertia - inertia(x, fit.centres)) < 1e-6
        assert fit.inertia <= single[k] + 1e-6
        label = ((x[:, None] - fit.centres[None]) ** 2).sum(2).argmin(1)
        assert np.allclose([x[label == j].mean(0) for j in range(k)], fit.centres)  # nothing moves any more
        assert (np.bincount(label, minlength=k) == fit.sizes).all()
    got = {r.i: r.label for r in C.labelled(df, COLUMNS, fits[4], "label").collect()}
    assert all(got[i] == ((v - fits[4].centres) ** 2).sum(1).argmin() for i, v in enumerate(x))
    assert {k: f.inertia for k, f in C.kmeans_table(C.points(df.repartition(2), "i", COLUMNS), 3, (3,), 30).items()}[3] == pytest.approx(fits[3].inertia)


def test_best_start_is_the_global_one_on_a_small_table(spark):
    pts = [0., 1., 1.5, 6., 6.5, 9., 9.2, 20.]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "i long, a double")
    fit = C.kmeans_table(C.points(df, "i", ["a"]), 1, (3,), 40)[3]
    least = min(sum(sum((p - np.mean(g)) ** 2 for p in g) for g in (pts[:i], pts[i:j], pts[j:])) for i, j in itertools.combinations(range(1, len(pts)), 2))
    assert abs(fit.inertia - least) < 1e-9


def test_seeds_are_drawn_by_distance(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(50)] + [(50, 10.0), (51, 30.0)], "i long, a double")
    x = C.points(df, "i", ["a"])
    ks = np.full(400, 2)
    centres = C.seeds(x, 1, ks, 3, C.Subsamples(np.full(400, -1), 1.0, 3))[:, :, 0]
    first = centres[:, 0] == 0
    assert first.mean() > .9
    assert .8 < (centres[first, 1] == 30).mean() <= 1 and not (centres[first, 1] == 0).any()  # 900 against 100
    # two different values are two centres, whatever k is
    few = C.seeds(x.where("v[0] < 20"), 1, np.array([4]), 3, C.Subsamples(np.array([-1]), 1.0, 3))
    assert np.isnan(few[0, 2:]).all() and not np.isnan(few[0, :2]).any()


def test_refits_use_their_own_subsamples(cloud):
    df, x = cloud
    p = C.points(df, "i", COLUMNS)
    full = C.kmeans_table(p, 3, (2,), 10)[2]
    cells = C.subsample_agreement(p, 3, full, 6, .5, 5)
    sizes = cells.sum((1, 2))
    assert len(set(sizes.tolist())) > 1 and all(.35 * len(x) < n < .65 * len(x) for n in sizes)
    h = np.array([r.h for r in p.collect()])
    assert sorted(sizes) == sorted(C.Subsamples(np.arange(6), .5, 7).taken(h).sum(0))
    rows = M.stability(df, "i", COLUMNS, 2, 6, .5, starts=5, full_starts=10).collect()
    assert len(rows) == 6 and all(r.n == n for r, n in zip(rows, sizes)) and all(-1 <= r.ari <= 1 for r in rows)


def test_mixtures_from_many_starts(cloud):
    df, x = cloud
    got = {(m["k"], m["covariance"]): m for m in C.mixture_table(C.points(df, "i", COLUMNS), 3, (1, 2, 3), starts=6)}
    n = len(x)
    cov = np.cov(x.T, bias=True) + 1e-6 * np.eye(3)
    gap = x - x.mean(0)
    ll = -.5 * (n * (3 * math.log(2 * math.pi) + math.log(np.linalg.det(cov))) + np.einsum("ij,jk,ik->", gap, np.linalg.inv(cov), gap))
    assert abs(got[1, "full"]["log_likelihood"] - ll) < 1e-6 * abs(ll)
    diag = np.diag(np.diag(cov))
    ll = -.5 * (n * (3 * math.log(2 * math.pi) + math.log(np.linalg.det(diag))) + np.einsum("ij,jk,ik->", gap, np.linalg.inv(diag), gap))
    assert abs(got[1, "diagonal"]["log_likelihood"] - ll) < 1e-6 * abs(ll)
    for k in (2, 3):
        spark_ll = GaussianMixture(k=k, seed=7, maxIter=200, tol=1e-4).fit(M.with_features(df, COLUMNS)).summary.logLikelihood
        m = got[k, "full"]
        assert m["converged"] and m["log_likelihood"] >= spark_ll - 2e-3 * n
        free = k - 1 + 3 * k + 6 * k
        assert abs(m["bic"] - (free * math.log(n) - 2 * m["log_likelihood"])) < 1e-6 and 0 < m["entropy"] <= 1 and m["top_posterior"] > .8
    assert got[3, "full"]["log_likelihood"] > got[2, "full"]["log_likelihood"] > got[2, "diagonal"]["log_likelihood"] > got[1, "diagonal"]["log_likelihood"]


def test_edge_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0., 0.), (2, 0., 0.), (3, None, 1.), (4, nan, 1.), (5, 5., 5.), (None, 5., 5.)], "i long, a double, b double")
    fit = C.kmeans_table(C.points(df, "i", ["a", "b"]), 2, (3,), 4)[3]
    assert len(fit.centres) == 2 and fit.inertia == 0 and sorted(fit.sizes) == [2, 2]
    named = {r.i: r.cluster for r in M.named_kmeans(df, ["a", "b"], 3, "a", ident="i").collect()}
    assert named == {1: 2, 2: 2, 3: None, 4: None, 5: 1, None: 1}
    none = df.where("false")
    assert C.kmeans_table(C.points(none, "i", ["a", "b"]), 2, (2,), 4) == {} and M.cluster_validation(none, ["a", "b"]) == [] == M.mixture_grid(none, ["a", "b"])
    assert M.named_kmeans(none, ["a", "b"], 2, "a").collect() == [] == M.stability(none, "i", ["a", "b"], 2, 3).collect()
