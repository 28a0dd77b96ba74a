"""Models against closed forms and the conditions their solutions must meet."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import audit, models as M

C = ["x", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=300), rng.integers(0, 2, 300).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + 1.2 * x - 0.7 * z)))).astype(int)
    data = (x, z, y)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(*data))], "i long, x double, z double, y int").cache(), data


def design(x, z):
    return np.column_stack([np.ones(len(x)), x, z])


def test_logistic_score_is_zero(frame):
    df, (x, z, y) = frame
    rows = {r[0]: r for r in M.logistic_table(df, "y", C)}
    beta = np.array([next(v for k, v in rows.items() if "ntercept" in k)[1], rows["x"][1], rows["z"][1]])
    d = design(x, z)
    assert np.abs(d.T @ (y - 1 / (1 + np.exp(-d @ beta)))).max() < 1e-2
    assert abs(rows["x"][3] - math.exp(rows["x"][1])) < 1e-9 and rows["x"][4] < rows["x"][3] < rows["x"][5]


def test_penalised_score_is_zero(frame):
    df, (x, z, y) = frame
    beta = np.array([r[1] for r in M.penalised_logistic(df, "y", C)])
    d = design(x, z)
    p = 1 / (1 + np.exp(-d @ beta))
    w = p * (1 - p)
    h = w * np.einsum("ij,jk,ik->i", d, np.linalg.inv(d.T @ (d * w[:, None])), d)
    assert np.abs(d.T @ (y - p + h * (0.5 - p))).max() < 1e-4


def test_penalised_fit_stays_finite_when_labels_are_parted(spark):
    df = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "x double, y int")
    assert all(abs(r[1]) < 50 for r in M.penalised_logistic(df, "y", ["x"]))


def test_distances_equal_numpy(frame):
    df, (x, z, _) = frame
    ref = np.arange(300) < 200
    d = np.column_stack([x, z])
    gap = d - d[ref].mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(d[ref].T)), gap))
    got = {r.i: r for r in M.mahalanobis(df, "i", C, F.col("i") < 200).collect()}
    cut = np.quantile(want[ref], 0.975)
    assert all(abs(got[i].distance - want[i]) < 1e-8 and got[i].is_outlier == (want[i] > cut) for i in range(300) if abs(want[i] - cut) > 1e-9)


def test_components_equal_numpy(frame):
    df, (x, z, _) = frame
    _, shares = M.principal_components(df, "i", C)
    values = np.sort(np.linalg.eigvalsh(np.cov(np.column_stack([x, z]).T)))[::-1]
    assert np.allclose(shares, values / values.sum(), atol=1e-6)


def test_clusters_of_parted_clouds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(10 * (i % 2), 0.3)), float(rng.normal(0, 0.3))) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    prof = M.cluster_profile(M.named_kmeans(df, ["a", "b"], 2, "a"), ["a", "b"]).collect()
    assert len(prof) == 2
    valid = {r[0]: r for r in M.cluster_validation(df, ["a", "b"], ks=(2, 3))}
    assert valid[2][2] > 0.9 > valid[3][2] and valid[2][3] == 60 and valid[2][4]
    assert all(r.ari > 0.99 and r.together > 0.99 for r in M.stability(df, "i", ["a", "b"], 2, 2).collect())
    grid = {r[0]: r for r in M.mixture_grid(df, ["a", "b"], ks=(1, 2))}
    d = np.array([r[1:] for r in rows])
    cov = np.cov(d.T, bias=True)
    ll = -0.5 * len(d) * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(cov)) + 2)
    assert abs(grid[1][1] - ll) < 1e-6 * abs(ll) and grid[2][1] > grid[1][1] and grid[2][5] > 0.99


def test_local_outlier_factor_in_two_densities(spark):
    """A row just outside the dense cloud stands out, one in the thin cloud does not, though its neighbours are farther."""
    rng = np.random.default_rng(5)
    pts = [*rng.normal(0, 0.05, (60, 2)), *(np.array([20, 0]) + rng.normal(0, 2, (60, 2))), np.array([0.0, 1.0]), np.array([20.0, 1.0])]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i long, a double, b double")
    got = {r.i: r for r in M.density_outlier(df, "i", ["a", "b"], F.col("i") < 120, k=8).collect()}
    assert got[120].local_outlier_factor > 3 and got[121].local_outlier_factor < 1.5 and abs(np.median([r.local_outlier_factor for r in got.values()]) - 1) < 0.2


def test_folds_are_stratified_and_scores_out_of_fold(frame):
    df, (_, _, y) = frame
    got = M.out_of_fold(df, "i", "y", C, folds=5, rounds=2).collect()
    assert sorted(r.i for r in got) == list(range(300))
    for label in (0, 1):
        sizes = [sum(r.fold == f and r.label == label for r in got) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == int((y == label).sum())


def test_flags_above_the_trusted_quantile(spark):
    df = spark.createDataFrame([(i, float(i % 2), (i % 50) / 50) for i in range(400)], "i long, label double, score double")
    got = M.unlabelled_share(df, "i", quantile=0.9).collect()
    ok = np.array([(i % 50) / 50 for i in range(400) if i % 2])
    share = lambda s: 1 - min(1.0, s / ok.mean())
    cut = np.quantile([share(s) for s in ok], 0.9)
    assert all(r.flagged == (share((r.i % 50) / 50) > cut) for r in got if abs(share((r.i % 50) / 50) - cut) > 1e-9)


def test_choice_score_is_zero(spark):
    rng = np.random.default_rng(9)
    rows = []
    for run in range(120):
        x = rng.random((4, len(audit.CRITERIA)))
        take = int(np.argmax(x @ np.arange(1, len(audit.CRITERIA) + 1) + rng.gumbel(size=4)))
        rows += [(run, *map(float, v), int(j == take)) for j, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["run_id", *audit.CRITERIA, "taken"])
    beta, weights, _ = audit.choice_model(df, "taken")
    b = np.array([beta[c] for c in audit.CRITERIA])
    score = np.zeros(len(b))
    for run in range(120):
        x = np.array([r[1:-1] for r in rows[4 * run:4 * run + 4]])
        y = np.array([r[-1] for r in rows[4 * run:4 * run + 4]])
        e = np.exp(x @ b)
        score += (y - e / e.sum()) @ x
    assert np.abs(score).max() < 1e-3 and abs(sum(weights.values()) - 1) < 1e-9
