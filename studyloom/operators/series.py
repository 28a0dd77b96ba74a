"""Monthly count series (inventory A29-A38, W07-W10, W12, M17, U01).

Every frame below the monthly count holds one row per series and calendar month, so its windows
are bounded by the calendar, whatever the size of the raw table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_filled
from ..scale import attach, null_safe_join, require_empty, running_over
from .smoothing import smoothed_forecast


def roster_audit(roster: DataFrame, ident: str, raw_date: Column, parsed: Column, low: str, high: str) -> DataFrame:
    """Unreadable dates and ids, repeated ids, date range and dates outside the allowed range."""
    rows = roster.select(F.col(ident).alias("_id"), raw_date.alias("_raw"), parsed.alias("_d"))
    per = rows.groupBy("_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_filled(F.col("_raw")) & F.col("_d").isNull()).alias("bad_dates"),
        F.count_if(~is_filled(F.col("_raw"))).alias("blank_dates"), F.min("_d").alias("lo"), F.max("_d").alias("hi"),
        F.count_if(~F.col("_d").between(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("outside"))
    blank = ~is_filled(F.col("_id"))
    return per.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("bad_ids"),
                   F.sum("bad_dates").alias("bad_dates"), F.sum("blank_dates").alias("blank_dates"),
                   F.count_if(~blank & (F.col("n") > 1)).alias("repeated_ids"),
                   F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.sum("outside").alias("out_of_range"))


def assert_essentials(audit: DataFrame, may_be_bad: int = 0) -> None:
    """Stop when there are no rows, no dates or too many unusable rows."""
    require_empty(audit.where((F.col("rows") == 0) | F.col("first_date").isNull() | (F.col("bad_dates") + F.col("bad_ids") > may_be_bad)),
                  "roster fails its essential checks")


def repeated(df: DataFrame, keys: list[str], name: str = "is_repeated") -> DataFrame:
    """Flag every row whose key occurs more than once.

    Counts are taken before the shuffle and joined back, so a key shared by most rows is no single
    window partition; AQE can split it in the join.
    """
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(name))
    return null_safe_join(df, many, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def row_flags(roster: DataFrame, ident: str, raw_date: Column, parsed: Column, label_ok: Column) -> DataFrame:
    """Quality flags per row with the raw values kept."""
    df = roster.withColumns({"bad_id": ~is_filled(F.col(ident)), "bad_date": is_filled(raw_date) & parsed.isNull(), "bad_label": ~label_ok})
    df = repeated(df, [ident], "duplicate_id").withColumn("duplicate_id", F.col("duplicate_id") & ~F.col("bad_id"))
    return df.withColumn("needs_review", F.col("bad_id") | F.col("bad_date") | F.col("bad_label") | F.col("duplicate_id"))


def monthly(df: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """Rows per month over the whole range of each series, empty months as zero."""
    n = df.where(F.col(on).isNotNull()).groupBy(*keys, F.trunc(on, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))
    grid = n.groupBy(*keys).agg(months.alias("m")).select(*keys, F.explode("m").alias("month"))
    return null_safe_join(grid, n, [*keys, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def month_year_totals(series: DataFrame) -> DataFrame:
    """Months, year totals and the grand total in one roll-up; the total levels have null keys."""
    return series.rollup(F.year("month").alias("yr"), F.col("month")).agg(F.sum("n").alias("n"))


def indexed(series: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each month in its series, from 0, and the series length."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    t = F.months_between("month", F.min("month").over(w)).cast("int")
    return series.withColumn("t", t).withColumn("len", F.count(F.lit(1)).over(w).cast("int"))


def diagnostics(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, variance, dispersion, rank correlation with time and the autocorrelation band."""
    s = indexed(series, keys)
    w = Window.partitionBy(*(keys or [F.lit(0)]), "n")
    r = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("n")
    s = s.withColumn("rank_n", F.rank().over(r) + (F.count(F.lit(1)).over(w) - 1) / 2.0)
    g = s.groupBy(*keys).agg(F.avg("n").alias("mean"), F.var_samp("n").alias("variance"), F.corr("t", "rank_n").alias("trend_rho"), F.count(F.lit(1)).alias("months"))
    return g.withColumn("dispersion", F.try_divide("variance", "mean")).withColumn("acf_band", 1.96 / F.sqrt("months"))


def autocorrelation(series: DataFrame, keys: list[str], max_lag: int = 13) -> DataFrame:
    """Autocorrelation per lag, by an equi join of each month with the month ``lag`` later."""
    s = indexed(series, keys)
    mean = F.avg("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    d = s.withColumn("d", F.col("n") - mean)
    left = d.select(*keys, "len", F.col("t"), F.col("d").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("t", F.col("t") + F.col("lag"))
    j = left.join(d.select(*keys, "t", F.col("d").alias("b")), [*keys, "t"])
    g = j.groupBy(*keys, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("c"), F.max("len").alias("len"))
    c0 = g.where("lag = 0").select(*keys, F.col("c").alias("c0"))
    g = attach(g, c0, keys)
    acf = F.try_divide("c", "c0")
    return g.where((F.col("lag") > 0) & (F.col("lag") <= F.floor(F.col("len") / 2))).select(
        *keys, "lag", acf.alias("acf"), (F.abs(acf) > 1.96 / F.sqrt("len")).alias("outside_band"))


def month_profile(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, count and sd per calendar month, with the peak month of the series."""
    g = series.groupBy(*keys, F.month("month").alias("month_no")).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("years"), F.stddev_samp("n").alias("sd"))
    top = F.first("month_no").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("mean"), "month_no"))
    return g.withColumn("is_peak", F.col("month_no") == top)


def intake_trend(df: DataFrame, day: Column, ident: Column, keys: list[str]) -> DataFrame:
    """Slope of the id number over days, correlation, and ids per average month."""
    g = df.select(*keys, day.cast("double").alias("x"), ident.cast("double").alias("y")).groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("per_month", F.col("slope") * 365.25 / 12)


def maturity_boundary(series: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold from the lower quartile of non-zero months and the last month that reaches it."""
    tau = F.greatest(F.lit(1), F.floor(F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.25)))).alias("tau")
    g = series.groupBy(*keys).agg(tau)
    j = attach(series, g, keys)
    return j.groupBy(*keys).agg(F.first("tau").alias("tau"), F.max(F.when(F.col("n") >= F.col("tau"), F.col("month"))).alias("boundary"),
                                F.sum("n").alias("total"))


def split_mature(series: DataFrame, boundary: DataFrame, keys: list[str]) -> DataFrame:
    """Mark months up to the boundary as mature and later ones as censored."""
    b = boundary.select(*keys, "boundary")
    return attach(series, b, keys).withColumn("is_mature", F.col("month") <= F.col("boundary")).drop("boundary")


def mean_forecast(train: DataFrame, future: DataFrame, keys: list[str]) -> DataFrame:
    """The overall mean of the training months."""
    return future.join(train.groupBy(*keys).agg(F.avg("n").alias("yhat")), keys)


def seasonal_forecast(train: DataFrame, future: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the same calendar month, the overall mean where that month was never seen."""
    moy = train.groupBy(*keys, F.month("month").alias("_m")).agg(F.avg("n").alias("_s"))
    overall = train.groupBy(*keys).agg(F.avg("n").alias("_o"))
    j = future.withColumn("_m", F.month("month")).join(moy, [*keys, "_m"], "left").join(overall, keys)
    return j.withColumn("yhat", F.coalesce("_s", "_o")).drop("_m", "_s", "_o")


# Name -> function(train, future, keys) -> future with yhat
REGISTRY: dict[str, Callable[[DataFrame, DataFrame, list[str]], DataFrame]] = {
    "mean": mean_forecast, "seasonal_mean": seasonal_forecast, "smoothed": smoothed_forecast}


def register(name: str, fn: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> None:
    """Add a forecast function under a name."""
    if name in REGISTRY:
        raise ValueError(f"forecast {name} exists")
    REGISTRY[name] = fn


def future_months(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    last = series.groupBy(*keys).agg(F.max("month").alias("_last"))
    steps = F.sequence(F.add_months("_last", 1), F.add_months("_last", horizon), F.expr("interval 1 month"))
    return last.select(*keys, F.explode(steps).alias("month"))


def forecast_all(series: DataFrame, keys: list[str], horizon: int, names: list[str] | None = None) -> DataFrame:
    """Run the chosen registered forecasts on every series."""
    future, out = future_months(series, keys, horizon), None
    for name in names or list(REGISTRY):
        one = REGISTRY[name](series, future, keys).select(*keys, "month", F.lit(name).alias("model"), "yhat")
        out = one if out is None else out.unionByName(one)
    return out


def backtest(series: DataFrame, keys: list[str], names: list[str], folds: int, min_train: int, horizon: int) -> DataFrame:
    """Expanding-window folds; each forecasts ``horizon`` months for every model.

    A fold is one more key of the series, so all folds and series are forecast in the same jobs.
    """
    s = indexed(series, keys)
    first = F.greatest(F.lit(min_train), F.col("len") - horizon - folds + 1)
    s = s.where(F.col("len") - horizon >= first).withColumn("origin", F.explode(F.sequence(first, F.col("len") - horizon)))
    fold_keys = [*keys, "origin"]
    train = s.where("t < origin").select(*fold_keys, "month", "n")
    test = s.where((F.col("t") >= F.col("origin")) & (F.col("t") < F.col("origin") + horizon)).select(*fold_keys, "month", F.col("n").alias("y"))
    naive = Window.partitionBy(*fold_keys).orderBy("month")
    scale = train.withColumn("_d", F.abs(F.col("n") - F.lag("n").over(naive))).groupBy(*fold_keys).agg(F.avg("_d").alias("train_naive"))
    out = None
    for name in names:
        one = REGISTRY[name](train, test, fold_keys).withColumn("model", F.lit(name)).select("model", *fold_keys, "month", "y", "yhat")
        out = one if out is None else out.unionByName(one)
    return out.join(scale, fold_keys)


def error_metrics(predictions: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, bias and MASE with both denominators (whole series and each fold's training)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("month")
    naive = series.withColumn("_d", F.abs(F.col("n") - F.lag("n").over(w))).groupBy(*keys).agg(F.avg("_d").alias("_naive"))
    e = F.col("yhat") - F.col("y")
    safe = lambda c: F.when(c > 1e-9, c).otherwise(1.0)
    g = predictions.groupBy("model", *keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(F.abs(e) / safe(F.col("train_naive"))).alias("mase_fold"), F.count(F.lit(1)).alias("points"))
    return attach(g, naive, keys).withColumn("mase", F.col("mae") / safe(F.col("_naive"))).drop("_naive")


def rank_models(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Best model first by MAE, MASE, RMSE and name."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("mae", "mase", "rmse", "model")
    return metrics.withColumn("place", F.row_number().over(w))


def planning(forecast: DataFrame, booked: DataFrame, keys: list[str]) -> DataFrame:
    """The larger of model and booked counts, with the basis of the number."""
    j = forecast.join(booked.select(*keys, "month", F.col("n").alias("booked")), [*keys, "month"], "left").withColumn("booked", F.coalesce("booked", F.lit(0)))
    firm = F.col("booked") > F.col("yhat")
    return j.withColumn("planning", F.greatest(F.col("yhat"), F.col("booked").cast("double"))).withColumn(
        "basis", F.when(firm, "booked").otherwise("model"))


def guard_degenerate(forecast: DataFrame, fallback: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Use the fallback when the last 12 months' mean leaves 0.4 to 2.5 times the history."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))
    far = forecast.withColumn("_r", n).where("_r <= 12").groupBy(*keys).agg(F.avg("yhat").alias("_far"))
    hist = history.groupBy(*keys).agg(F.avg("n").alias("_hist"))
    ratio = F.try_divide("_far", "_hist")
    j = forecast.join(fallback.select(*keys, "month", F.col("yhat").alias("_fb")), [*keys, "month"]).join(far, keys).join(hist, keys)
    bad = ~F.coalesce(ratio.between(0.4, 2.5), F.lit(False))
    return j.select(*keys, "month", F.when(bad, F.col("_fb")).otherwise(F.col("yhat")).alias("yhat"), bad.alias("guarded"))


def window_totals(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Planning totals of the next 1, 3, 6, 12 and all months, and the peak month."""
    k = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("month"))
    p = plan.withColumn("_k", k)
    return p.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_k") <= m, F.col("planning"))).alias(f"next_{m}") for m in (1, 3, 6, 12)],
        F.sum("planning").alias("next_all"), F.max_by("month", F.struct("planning", (-F.col("_k")).alias("o"))).alias("peak_month"))


def annual_totals(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Planning totals per calendar year."""
    return plan.groupBy(*keys, F.year("month").alias("yr")).agg(F.sum("planning").alias("planning"))


def poisson_quantile(rate: Column, p: float, exact_to: float = 1e10) -> Column:
    """Smallest count whose Poisson cumulative probability reaches p, as a long; null for a null, negative or infinite rate and for rates beyond a long.

    Probabilities are products of neighbours' ratios from thirteen deviations under the rate to thirteen over it, outside of which there is less than a double can tell,
    scaled by their sum, so no logarithm of a factorial is rounded. Above ``exact_to``, where one count is less than 1e-5 deviations, the normal
    quantile with the skewness term gives the count. It runs in Arrow batches; apply it to a table of rates, not to the rows behind them.
    """
    from math import ceil, isfinite, sqrt
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)

    @F.pandas_udf(T.LongType())
    def quantile(rates: pd.Series) -> pd.Series:
        def one(x):
            if not x >= 0 or not isfinite(x) or x > 9e18:
                return None
            if x > exact_to:
                return ceil(x + z * sqrt(x) + (z * z - 1) / 6 - 0.5)
            lo, hi = max(0, int(x - 13 * sqrt(x) - 13)), int(x + 13 * sqrt(x) + 40)
            logs = np.concatenate([[0.0], np.log(np.maximum(x, 1e-300) / np.arange(lo + 1, hi + 1)).cumsum()])
            mass = np.exp(logs - logs.max()).cumsum()
            return lo + int(np.searchsorted(mass, p * mass[-1]))

        return pd.Series([None if pd.isna(x) else one(x) for x in rates], dtype="Int64")

    return quantile(rate.cast("double"))


def cumulative_share(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Running total and running share within a group, block by block so a large group is spread."""
    out = running_over(df, keys, order, running_total=("sum", F.col(value)))
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return null_safe_join(out, total, keys).withColumn("running_share", F.try_divide("running_total", "_total")).drop("_total")


def is_monotonic(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """True when a cumulative series never falls."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("_up", F.coalesce(F.col(value) >= prev, F.lit(True))).groupBy(*keys).agg(F.bool_and("_up").alias("monotonic"))
