"""Model jobs on Spark ML and on aggregated sums (inventory M01-M16)."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import calendar_features
from ..scale import attach, average_ranks, exact_quantiles, running_over
from ..session import checkpoint_dir
from . import clusters as C
from .audit import uniform
from .neighbours import nearest_rows


def standardise(df: DataFrame, ident: str, columns: list[str], reference: Column) -> DataFrame:
    """Median-imputed z-scores with median, mean and population sd of the reference rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("v")) for c in columns])
    ref = df.where(reference).select(F.inline(cells))
    med = exact_quantiles(ref, ["item"], "v", {"m": 0.5}).agg(*[F.max(F.when(F.col("item") == c, F.col("m"))).alias(f"_m_{c}") for c in columns])
    filled = attach(df, med, []).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    fit = filled.where(reference).agg(*[x for c in columns for x in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = attach(filled, fit, [])
    return z.select(ident, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}"))), F.lit(0.0)).alias(c) for c in columns])


def with_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def named_kmeans(df: DataFrame, columns: list[str], k: int, name_by: str, seed: int = 7, starts: int = 100, ident: str | None = None) -> DataFrame:
    """The best of many k-means fits, its clusters numbered by the mean of a naming column, largest mean first."""
    fit = C.kmeans_table(C.points(df, ident, columns), len(columns), (k,), starts, seed)
    if not fit:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    out = C.labelled(df, columns, fit[k], "_raw")
    means = out.where("_raw is not null").groupBy("_raw").agg(F.avg(name_by).alias("_mean"))
    # k rows in all
    order = means.agg(F.reverse(F.array_sort(F.collect_list(F.struct("_mean", "_raw")))).alias("o"))
    label = F.array_position(F.transform("o", lambda x: x["_raw"]), F.col("_raw"))
    return attach(out, order, []).withColumn("cluster", F.nullif(label, F.lit(0)).cast("int")).drop("_raw", "o")


def cluster_profile(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Size and column means per named cluster."""
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def cluster_validation(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), smallest: int = 15, seed: int = 7, starts: int = 50, ident: str | None = None) -> list[tuple]:
    """(k, inertia, silhouette, smallest size, large enough) of the best of many fits for each k; all fits share their passes."""
    rows = []
    for k, fit in C.kmeans_table(C.points(df, ident, columns), len(columns), ks, starts, seed).items():
        found = with_features(C.labelled(df, columns, fit, "prediction").where("prediction is not null"), columns)
        silhouette = float(ClusteringEvaluator().evaluate(found)) if len(fit.centres) > 1 else None
        rows.append((k, fit.inertia, silhouette, int(min(fit.sizes)), bool(min(fit.sizes) >= smallest)))
    return rows


def side_by_side(spark: SparkSession, fit: Callable, times: int, width: int = 5) -> list:
    """The results of ``fit(0)`` to ``fit(times - 1)``, a few at a time."""
    with ThreadPool(min(width, times)) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), range(times))


def stability(df: DataFrame, ident: str, columns: list[str], k: int, repeats: int = 100, share: float = 0.8, seed: int = 7, starts: int = 20, full_starts: int = 100) -> DataFrame:
    """Agreement of refits on subsamples with the full fit, and pairs that stay together.

    Both come from contingency counts, so no pair of rows is ever formed; the starts of all refits move in the same passes.
    """
    x = C.points(df, ident, columns)
    fit = C.kmeans_table(x, len(columns), (k,), full_starts, seed)
    pairs = lambda ns: float(sum(v * (v - 1) / 2.0 for v in ns))
    rows = []
    for b, cells in enumerate(C.subsample_agreement(x, len(columns), fit[k], repeats, share, starts, seed) if fit else []):
        n = int(cells.sum())
        kept, whole, other = pairs(cells.ravel()), pairs(cells.sum(1)), pairs(cells.sum(0))
        chance = whole * other / pairs([n]) if n > 1 else 0.0
        most = (whole + other) / 2.0
        rows.append((b, n, 1.0 if most == chance else (kept - chance) / (most - chance), kept / whole if whole else None))
    return df.sparkSession.createDataFrame(rows, "repeat int, n long, ari double, together double")


def mixture_grid(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (1, 2, 3), seed: int = 7, kinds: tuple[str, ...] = ("full",), starts: int = 20, ident: str | None = None) -> list[tuple]:
    """(k, log likelihood, AIC, BIC, relative entropy, mean top posterior, covariance, converged) of the best of many mixtures."""
    found = C.mixture_table(C.points(df, ident, columns), len(columns), ks, kinds, starts, seed)
    return [tuple(m[c] for c in ("k", "log_likelihood", "aic", "bic", "entropy", "top_posterior", "covariance", "converged")) for m in found]


def corrected_outcome(df: DataFrame, posterior: str, outcome: str, k: int) -> list[tuple]:
    """Class means of an outcome corrected for misclassification.

    The k by k classification sums come from one aggregation; their inverse weights the outcome sums.
    """
    post, hard = F.col(posterior), F.array_position(F.col(posterior), F.array_max(posterior)).cast("int") - 1
    g = df.withColumn("_h", hard).groupBy("_h").agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("y"), *[F.sum(F.get(post, F.lit(s))).alias(f"p{s}") for s in range(k)])
    rows = {r["_h"]: r for r in g.collect()}
    joint = np.array([[rows[t][f"p{s}"] if t in rows else 0.0 for t in range(k)] for s in range(k)])
    d = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
    w = np.linalg.pinv(d)
    n = np.array([rows[t]["n"] if t in rows else 0 for t in range(k)], dtype=float)
    y = np.array([rows[t]["y"] if t in rows else 0.0 for t in range(k)], dtype=float)
    size, total = n @ w, y @ w
    return [(s, float(size[s]), float(total[s] / size[s]) if abs(size[s]) > 1e-9 else None) for s in range(k)]


def logistic_table(df: DataFrame, y: str, columns: list[str], interactions: list[tuple[str, str]] = ()) -> list[tuple]:
    """(term, coefficient, se, odds ratio, low, high) of a logistic model with Wald intervals."""
    extra = {f"{a}:{b}": F.col(a) * F.col(b) for a, b in interactions}
    names = [*columns, *extra]
    x = with_features(df.withColumns(extra) if extra else df, [f"`{n}`" for n in names]).withColumn("label", F.col(y).cast("double"))
    m = GeneralizedLinearRegression(family="binomial", link="logit").fit(x)
    coef = [*m.coefficients.toArray().tolist(), float(m.intercept)]
    se = list(m.summary.coefficientStandardErrors)
    return [(n, float(c), float(s), math.exp(c), math.exp(c - 1.959963984540054 * s), math.exp(c + 1.959963984540054 * s)) for n, c, s in zip([*names, "intercept"], coef, se)]


def penalised_logistic(df: DataFrame, y: str, columns: list[str], steps: int = 25, tolerance: float = 1e-8) -> list[tuple]:
    """Logistic coefficients with the Jeffreys penalty.

    Rows are counted by distinct (x, y) first. Each Newton step adds up the information matrix on Spark,
    then the score with the hat values of that matrix; only p by p numbers reach the driver.
    """
    x = df.groupBy(F.col(y).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_m")).persist()
    names = ["intercept", *columns]
    cols = [F.lit(1.0), *[F.col(c) for c in columns]]
    p = len(cols)
    try:
        beta = np.zeros(p)
        info = np.eye(p)
        for _ in range(steps):
            eta = sum((c * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
            pi = 1 / (1 + F.exp(-eta))
            w = pi * (1 - pi) * F.col("_m")
            row = x.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
            info = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    info[i, j] = info[j, i] = row[f"h{i}_{j}"]
            inv = np.linalg.inv(info)
            hat = pi * (1 - pi) * sum((cols[i] * cols[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
            score = F.col("_m") * (F.col("_y") - pi + hat * (0.5 - pi))
            u = x.agg(*[F.sum(score * c).alias(f"u{i}") for i, c in enumerate(cols)]).collect()[0]
            move = inv @ np.array([u[f"u{i}"] for i in range(p)])
            beta = beta + np.clip(move, -5, 5)
            if np.max(np.abs(move)) < tolerance:
                break
        se = np.sqrt(np.diag(np.linalg.inv(info)))
        return [(n, float(b), float(s), math.exp(b)) for n, b, s in zip(names, beta, se)]
    finally:
        x.unpersist()


def out_of_fold(df: DataFrame, ident: str, y: str, columns: list[str], folds: int = 5, seed: int = 7, depth: int = 3, rounds: int = 250) -> DataFrame:
    """Each row's score from a tree ensemble that never saw its fold.

    Folds are stratified: the rows of a label are dealt out in a hash order, so every fold has its share of each label.
    """
    checkpoint_dir(df.sparkSession)
    dealt = df.withColumn("label", F.col(y).cast("double")).withColumn("_lot", F.xxhash64(F.lit(seed), F.col(ident)))
    dealt = running_over(dealt, ["label"], [F.col("_lot"), F.col(ident)], _nth=("rows",)).withColumn("fold", ((F.col("_nth") - 1) % folds).cast("int"))
    x = with_features(dealt.drop("_lot", "_nth"), columns).checkpoint()
    out = None
    # a round of boosting is a few short jobs, so the folds are fitted side by side
    models = side_by_side(df.sparkSession, lambda f: GBTClassifier(maxDepth=depth, maxIter=rounds, seed=seed).fit(x.where(F.col("fold") != f)), folds)
    for f, m in enumerate(models):
        one = m.transform(x.where(F.col("fold") == f)).select(ident, "label", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def auc(scored: DataFrame) -> float:
    """Exact area under the curve from tie-averaged ranks; 0.5 if one label is missing."""
    counts = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("_pos"))
    ranks = average_ranks(scored, [], "score").join(counts, "score")
    row = ranks.agg(F.sum("n").alias("n"), F.sum("_pos").alias("p"), F.sum(F.col("_pos") * F.col("avg_rank")).alias("s")).first()
    n, p = row["n"] or 0, row["p"] or 0
    return 0.5 if p in (0, n) else float((row["s"] - p * (p + 1) / 2) / (p * (n - p)))


def negative_control(df: DataFrame, ident: str, trusted: Column, columns: list[str], seed: int = 99, **kw) -> float:
    """The same classifier on labels that a hash gives exactly half of the trusted rows should be no better than chance."""
    clean = df.where(trusted).withColumn("_lot", F.xxhash64(F.lit(seed), F.col(ident)))
    half = clean.count() // 2
    fake = running_over(clean, [], [F.col("_lot"), F.col(ident)], _nth=("rows",)).withColumn("_fake", (F.col("_nth") <= half).cast("double"))
    return auc(out_of_fold(fake.drop("_lot", "_nth"), ident, "_fake", columns, **kw))


def unlabelled_share(scored: DataFrame, ident: str, trusted: Column | None = None, quantile: float = 0.975) -> DataFrame:
    """Chance that a row is not like the trusted ones, ``1 - clip(p / c)``, and a flag above the trusted rows' quantile.

    ``c`` is the mean score of the trusted rows; without a condition those are the rows with label 1.
    """
    trusted = F.col("label") == 1 if trusted is None else trusted
    marked = scored.withColumn("_ok", trusted)
    c = marked.where("_ok").agg(F.avg("score").alias("c"))
    out = attach(marked, c, []).withColumn("contaminated", 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / F.col("c"))))
    cut = exact_quantiles(out.where("_ok"), [], "contaminated", {"cut": quantile})
    return attach(out, cut, []).select(ident, "label", "contaminated", (F.col("contaminated") > F.col("cut")).alias("flagged"))


def bootstrap_mean(df: DataFrame, ident: str, value: str, draws: int = 500, seed: int = 7) -> DataFrame:
    """Mean with a percentile interval over Poisson resamples drawn from a hash."""
    from .audit import poisson_one

    w = df.select(F.col(ident).alias("_id"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    w = w.withColumn("w", poisson_one(uniform(F.lit(seed), F.col("draw"), F.col("_id"))))
    per = w.groupBy("draw").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("m"))
    ci = per.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return attach(df.agg(F.avg(value).alias("mean")), ci, [])


def mahalanobis(df: DataFrame, ident: str, columns: list[str], reference: Column, quantile: float = 0.975) -> DataFrame:
    """Distance to the mean of the reference rows and a flag above their quantile.

    Means and covariances are one aggregation; the inverse is p by p and enters as constants.
    """
    p = len(columns)
    g = df.where(reference).agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = g[f"c{i}_{j}"]
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - float(g[f"a{i}"]) for i, c in enumerate(columns)]
    dist = F.sqrt(F.greatest(F.lit(0.0), sum((d[i] * d[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))))
    out = df.withColumn("distance", dist).withColumn("_ref", reference)
    cut = exact_quantiles(out.where("_ref"), [], "distance", {"cut": quantile})
    return attach(out, cut, []).select(ident, "distance", (F.col("distance") > F.col("cut")).alias("is_outlier"))


def density_outlier(df: DataFrame, ident: str, columns: list[str], reference: Column, k: int = 10) -> DataFrame:
    """Local outlier factor against the reference rows: the mean density around a row's neighbours over the density around the row.

    The density of a row is one over the mean reachability of its k nearest reference rows; a neighbour is reached from no nearer
    than its own k-th neighbour. Values near 1 are usual, larger ones lie in thinner surroundings than their neighbours.
    """
    checkpoint_dir(df.sparkSession)
    near = nearest_rows(df, ident, columns, reference, k).checkpoint()
    own = near.join(df.where(reference).select(ident), ident, "left_semi").select(F.col(ident).alias("_o"), F.element_at("near", -1)["d"].alias("_kd"))
    pairs = near.select(F.col(ident).alias("_i"), F.explode("near").alias("e")).select("_i", F.col("e.o").alias("_o"), F.col("e.d").alias("_d")).join(own, "_o")
    density = pairs.groupBy("_i").agg((1 / (F.avg(F.greatest("_d", "_kd")) + 1e-10)).alias("_lrd"), F.avg("_d").alias("mean_distance")).checkpoint()
    around = pairs.join(density.select(F.col("_i").alias("_o"), F.col("_lrd").alias("_lrd_o")), "_o").groupBy("_i").agg(F.avg("_lrd_o").alias("_around"))
    return density.join(around, "_i").select(F.col("_i").alias(ident), "mean_distance", (F.col("_around") / F.col("_lrd")).alias("local_outlier_factor"))


def permutation_importance(df: DataFrame, ident: str, y: str, columns: list[str], seed: int = 7, rounds: int = 250) -> list[tuple]:
    """Drop of the area under the curve after one column is dealt out again in a hash order."""
    checkpoint_dir(df.sparkSession)
    base = df.select(ident, y, *columns).checkpoint()
    m = GBTClassifier(maxDepth=3, maxIter=rounds, seed=seed, labelCol=y).fit(with_features(base, columns))

    def score(x):
        s = m.transform(with_features(x, columns)).select(F.col(y).alias("label"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        return auc(s)

    whole, rows = score(base), []
    # positions in id order and in hash order, numbered block by block
    here = running_over(base, [], [F.col(ident)], pos=("rows",))
    for c in columns:
        dealt = base.select(F.xxhash64(F.lit(seed), F.lit(c), F.col(ident)).alias("_h"), F.col(ident).alias("_i"), F.col(c).alias("_v"))
        dealt = running_over(dealt, [], [F.col("_h"), F.col("_i")], pos=("rows",)).select("pos", F.col("_v").alias(c))
        rows.append((c, whole, whole - score(here.drop(c).join(dealt, "pos"))))
    return rows


def principal_components(df: DataFrame, ident: str, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """First components of every row and their explained shares."""
    x = with_features(df, columns)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).collect()[0]
    x = x.withColumn("features", array_to_vector(F.array(*[F.col(c) - float(means[c]) for c in columns])))
    m = PCA(k=k, inputCol="features", outputCol="_pc").fit(x)
    a = vector_to_array("_pc")
    return m.transform(x).select(ident, *[F.get(a, F.lit(i)).alias(f"pc{i + 1}") for i in range(k)]), m.explainedVariance.toArray().tolist()


SERIES_FEATURES = ["t", "month_no", "quarter_no", "sin1", "cos1", "sin2", "cos2"]


def series_features(series: DataFrame, keys: list[str], one_hot: list | None = None) -> tuple[DataFrame, list[str]]:
    """X25 features for every month of every series, with an indicator per listed series."""
    first = series.groupBy(*keys).agg(F.min("month").alias("_first"))
    x = series.join(first, keys)
    x = x.select(*series.columns, *calendar_features(F.col("month"), F.months_between("month", "_first")))
    names = [c for c in SERIES_FEATURES if c not in ("month_no", "quarter_no")]
    for v in (one_hot or [])[1:]:
        x = x.withColumn(f"is_{v}", F.when(F.col(keys[0]) == v, 1.0).otherwise(0.0))
        names.append(f"is_{v}")
    return x, names


def count_regression(train: DataFrame, future: DataFrame, keys: list[str], series: list) -> DataFrame:
    """One Poisson log-link model for all series, with a level per series."""
    both = train.select(*keys, "month", F.col("n").cast("double").alias("n")).unionByName(future.select(*keys, "month").withColumn("n", F.lit(None).cast("double")))
    x, names = series_features(both, keys, series)
    x = with_features(x, names)
    m = GeneralizedLinearRegression(family="poisson", link="log", labelCol="n", maxIter=25).fit(x.where("n is not null"))
    return m.transform(x.where("n is null")).select(*keys, "month", F.greatest(F.lit(0.0), F.col("prediction")).alias("yhat"))


def negative_binomial(train: DataFrame, columns: list[str], y: str, alpha: float = 1.0, steps: int = 25) -> list[tuple]:
    """Negative binomial coefficients with fixed dispersion, by weighted sums on Spark."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    p = len(cols)
    x = train.persist()
    try:
        beta = np.zeros(p)
        beta[0] = math.log(max(1e-6, x.agg(F.avg(y)).collect()[0][0]))
        for _ in range(steps):
            eta = sum((c * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
            mu = F.exp(eta)
            w = mu / (1 + alpha * mu)
            z = (F.col(y) - mu) / (1 + alpha * mu)
            row = x.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(z * c).alias(f"u{i}") for i, c in enumerate(cols)]).collect()[0]
            h = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            move = np.linalg.solve(h + 1e-9 * np.eye(p), np.array([row[f"u{i}"] for i in range(p)]))
            beta = beta + np.clip(move, -2, 2)
            if np.max(np.abs(move)) < 1e-9:
                break
        return list(zip(["intercept", *columns], beta.tolist()))
    finally:
        x.unpersist()


def tree_forecast(train: DataFrame, future: DataFrame, keys: list[str], series: list, kind: str = "forest", seed: int = 7) -> DataFrame:
    """Random forest or boosted trees on the calendar features of all series together."""
    both = train.select(*keys, "month", F.col("n").cast("double").alias("n")).unionByName(future.select(*keys, "month").withColumn("n", F.lit(None).cast("double")))
    x, names = series_features(both, keys, series)
    x = with_features(x, [*names, "month_no", "quarter_no"])
    model = RandomForestRegressor(labelCol="n", numTrees=20, maxDepth=5, seed=seed) if kind == "forest" else GBTRegressor(labelCol="n", maxIter=15, maxDepth=3, seed=seed)
    m = model.fit(x.where("n is not null"))
    return m.transform(x.where("n is null")).select(*keys, "month", F.greatest(F.lit(0.0), F.col("prediction")).alias("yhat"))


