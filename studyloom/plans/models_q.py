"""Queries over model jobs (inventory M01-M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import series as S
from .registry import query
from .series_q import K, r, series

#: Domain scores: means of eight neighbouring values each, so that every query reads the whole vector.
DIMS = [f"d{i}" for i in range(1, 9)]


def domain(i: int):
    return F.aggregate(F.slice("embedding", 8 * i - 7, 8), F.lit(0.0), lambda a, v: a + v.cast("double")) / 8


def domain_sql(i: int) -> str:
    return f"list_sum(list_transform(embedding[{8 * i - 7}:{8 * i}], lambda v: cast(v as double))) / 8"


def dims(t):
    return t.embeddings.select("vec_id", "label", *[domain(i).alias(f"d{i}") for i in range(1, 9)])


def table(t, rows, names):
    """A handful of result rows of a fit as a DataFrame."""
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return r(t.spark.range(1).select(F.inline(made)), 4)


_Z = "with e as (select vec_id, label, " + ", ".join(f"case when (vec_id + {i}) % 17 = 0 then null else round({domain_sql(i)}, 6) end d{i}" for i in range(1, 9)) + " from embeddings), m as (select " + ", ".join(
    f"quantile_cont(d{i}, 0.5) m{i}" for i in range(1, 9)) + " from e where label < 5), f as (select vec_id, label, " + ", ".join(f"coalesce(d{i}, m{i}) d{i}" for i in range(1, 9)) + " from e, m), s as (select " + ", ".join(
    f"avg(d{i}) a{i}, stddev_pop(d{i}) s{i}" for i in range(1, 9)) + " from f where label < 5) select vec_id, " + ", ".join(f"round((d{i} - a{i}) / s{i}, 5) as d{i}" for i in range(1, 9)) + " from f, s"


@query("m01_standardise", _Z)
def m01(t):
    df = t.embeddings.select("vec_id", "label", *[F.when((F.col("vec_id") + i) % 17 != 0, F.round(domain(i), 6)).alias(f"d{i}") for i in range(1, 9)])
    return r(M.standardise(df, "vec_id", DIMS, F.col("label") < 5), 5)


@query("m02_named_kmeans")
def m02(t):
    return r(M.cluster_profile(M.named_kmeans(dims(t), DIMS, 3, "d1", ident="vec_id"), DIMS), 4)


@query("m03_cluster_validation")
def m03(t):
    return table(t, M.cluster_validation(dims(t), DIMS, ident="vec_id"), ["k", "inertia", "silhouette", "smallest", "large_enough"])


@query("m04_cluster_stability")
def m04(t):
    return r(M.stability(dims(t), "vec_id", DIMS, 2, 100), 4)


@query("m05_mixture_grid")
def m05(t):
    rows = M.mixture_grid(dims(t), DIMS, kinds=("full", "diagonal"), ident="vec_id")
    return table(t, rows, ["k", "log_likelihood", "aic", "bic", "entropy", "top_posterior", "covariance", "converged"])


@query("m06_corrected_outcome")
def m06(t):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array
    x = M.with_features(dims(t), DIMS)
    post = GaussianMixture(k=2, seed=7).fit(x).transform(x).withColumn("post", vector_to_array("probability"))
    return table(t, M.corrected_outcome(post, "post", "label", 2), ["class", "size", "mean"])


def _outcome(t):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"),
                             (F.col("l_linestatus") == "F").cast("double").alias("closed"))


@query("m07_logistic_model")
def m07(t):
    return table(t, M.logistic_table(_outcome(t), "y", ["quantity", "discount", "closed"], [("quantity", "closed")]), ["term", "coefficient", "se", "odds_ratio", "low", "high"])


@query("m08_penalised_logistic")
def m08(t):
    return table(t, M.penalised_logistic(_outcome(t), "y", ["quantity", "closed"]), ["term", "coefficient", "se", "odds_ratio"])


def _users(t):
    e = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd_value"),
                                        F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    return e.withColumn("y", (F.col("user_id") % 3 == 0).cast("double")).withColumn("mean_value", F.col("mean_value") + F.col("y") * 20)


UF = ["n", "mean_value", "sd_value", "error_share"]


@query("m09_source_classifier")
def m09(t):
    s = M.out_of_fold(_users(t), "user_id", "y", UF, folds=5, rounds=250)
    return table(t, [("source", M.auc(s)), ("negative_control", M.negative_control(_users(t), "user_id", F.col("y") == 1, UF, folds=5, rounds=150))], ["target", "auc"])


@query("m10_unlabelled_share")
def m10(t):
    s = M.unlabelled_share(M.out_of_fold(_users(t), "user_id", "y", UF, folds=5, rounds=250), "user_id")
    return r(M.bootstrap_mean(s.where("label = 0"), "user_id", "contaminated"), 4)


@query("m11_distance_outlier")
def m11(t):
    return r(M.mahalanobis(dims(t), "vec_id", DIMS, F.col("label") < 5), 5)


@query("m12_density_outlier", "with e as (select vec_id, label, " + ", ".join(f"{domain_sql(i)} d{i}" for i in range(1, 9)) + """ from embeddings),
 p as (select a.vec_id, b.vec_id o, a.label, sqrt(""" + " + ".join(f"(a.d{i} - b.d{i}) * (a.d{i} - b.d{i})" for i in range(1, 9)) + """) d from e a join e b on a.vec_id <> b.vec_id and b.label < 5),
 k as (select * from (select *, row_number() over (partition by vec_id order by d, o) rn from p) where rn <= 10), kd as (select vec_id o, max(d) kd from k where label < 5 group by 1),
 l as (select vec_id, avg(d) md, 1 / (avg(greatest(d, kd)) + 1e-10) lrd from k join kd using (o) group by 1)
select k.vec_id, round(any_value(l.md), 5) as mean_distance, round(avg(n.lrd) / any_value(l.lrd), 5) as local_outlier_factor from k join l on l.vec_id = k.vec_id join l n on n.vec_id = k.o group by 1
""")
def m12(t):
    return r(M.density_outlier(dims(t), "vec_id", DIMS, F.col("label") < 5), 5)


@query("m13_permutation_importance")
def m13(t):
    return table(t, M.permutation_importance(_users(t), "user_id", "y", UF), ["feature", "auc", "drop"])


@query("m14_principal_components")
def m14(t):
    return r(M.principal_components(dims(t), "vec_id", DIMS)[0], 4)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("m15_count_regression")
def m15(t):
    s = series(t)
    return r(M.count_regression(s, S.future_months(s, K, 12), K, PRIORITIES), 4)


@query("m15_negative_binomial")
def m15b(t):
    x, names = M.series_features(series(t), K)
    return table(t, M.negative_binomial(x, names, "n", 0.5), ["term", "coefficient"])


@query("m16_tree_forecasts")
def m16(t):
    s = series(t)
    f = S.future_months(s, K, 12)
    a = M.tree_forecast(s, f, K, PRIORITIES, "forest").withColumn("model", F.lit("forest"))
    return r(a.unionByName(M.tree_forecast(s, f, K, PRIORITIES, "boosted").withColumn("model", F.lit("boosted"))), 4)
