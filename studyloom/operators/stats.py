"""Group statistics (inventory A39-A45, A66-A67)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import attach, average_ranks


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; only ever applied to the few rows of a result table."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and v == v else None)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper chi-square tail from the regularised incomplete gamma function, for small result tables."""

    def tail(v, k):
        if v is None or k is None or v != v or k <= 0:
            return None
        a, h = k / 2.0, v / 2.0
        if h <= 0:
            return 1.0
        if h < a + 1:
            term = total = 1.0 / a
            n = a
            while term > total * 1e-16:
                n += 1
                term *= h / n
                total += term
            return max(0.0, 1.0 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))
        b, c = h + 1 - a, 1e300
        d = 1.0 / b
        f = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1.0 / (an * d + b)
            c = b + an / c
            step = d * c
            f *= step
            if abs(step - 1) < 1e-15:
                break
        return math.exp(-h + a * math.log(h) - math.lgamma(a)) * f

    return pd.Series([tail(v, k) for v, k in zip(x, df)])


def crosstab(df: DataFrame, row: str, column: str, order: list[str]) -> DataFrame:
    """Counts and row percent with a fixed category order; absent cells are zero."""
    g = df.groupBy(row).pivot(column, order).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{c}`") for c in order), F.lit(0))
    return g.select(row, *[F.col(f"`{c}`").alias(f"n_{c}") for c in order],
                    *[(F.coalesce(F.try_divide(F.col(f"`{c}`") * 100.0, total), F.lit(0.0))).alias(f"pct_{c}") for c in order])


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square, degrees of freedom, Cramer's V, small-cell warning and tail probability."""
    cell = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    r = cell.groupBy(row).agg(F.sum("n").alias("r"))
    c = cell.groupBy(column).agg(F.sum("n").alias("c"))
    dims = attach(attach(r.agg(F.count(F.lit(1)).alias("nr"), F.sum("r").alias("total")), c.agg(F.count(F.lit(1)).alias("nc")), []),
                  attach(r.agg(F.min("r").alias("rmin")), c.agg(F.min("c").alias("cmin")), []), [])
    # cells that never occur add only their expected count: sum of o*o/e over seen cells minus the total
    j = cell.join(r, row).join(c, column)
    s = j.agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r") * F.col("c").cast("double"))).alias("q"))
    d = attach(dims, s, [])
    stat = F.col("q") * F.col("total") - F.col("total")
    k = F.least(F.col("nr"), F.col("nc")) - 1
    out = d.select("total", stat.alias("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"),
                   F.sqrt(F.try_divide(stat, F.col("total") * k)).alias("cramers_v"), (F.col("rmin") * F.col("cmin") / F.col("total").cast("double") < 5).alias("small_expected"))
    return out.withColumn("p_value", chi_square_tail("statistic", F.col("dof").cast("double")))


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank sum and size per group with tie-averaged ranks over everybody, and the tie correction."""
    ranks = average_ranks(df.select(value), [], value)
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("m"))
    g = per.join(ranks.select(value, "avg_rank"), value).groupBy(group).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("avg_rank")).alias("rank_sum"))
    ties = ranks.agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    return attach(g, ties, [])


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, epsilon squared and tail probability."""
    s = rank_sums(df, group, value)
    n = F.max("total").cast("double")
    g = s.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"), n.alias("total"), F.max("ties").alias("ties"), F.count(F.lit(1)).alias("groups"))
    h = (12.0 / (F.col("total") * (F.col("total") + 1)) * F.col("q") - 3 * (F.col("total") + 1)) / (1 - F.col("ties") / (F.pow("total", F.lit(3)) - F.col("total")))
    out = g.select("groups", F.col("total").cast("long").alias("n"), h.alias("h"), ((h - F.col("groups") + 1) / (F.col("total") - F.col("groups"))).alias("epsilon_squared"))
    return out.withColumn("p_value", chi_square_tail("h", (F.col("groups") - 1).cast("double")))


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """U of the first of two groups, tie-corrected normal z and two-sided probability."""
    s = rank_sums(df.where(F.col(group).isin(a, b)), group, value)
    g = s.agg(F.max(F.when(F.col(group) == a, F.col("rank_sum"))).alias("ra"), F.max(F.when(F.col(group) == a, F.col("n"))).alias("na"),
              F.max(F.when(F.col(group) == b, F.col("n"))).alias("nb"), F.max("total").alias("total"), F.max("ties").alias("ties"))
    na, nb, n = F.col("na").cast("double"), F.col("nb").cast("double"), F.col("total").cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = g.select(F.col("na").alias("n_a"), F.col("nb").alias("n_b"), u.alias("u"), F.try_divide(u - na * nb / 2, sd).alias("z"))
    return out.withColumn("p_value", normal_two_sided("z"))


def cohens_d(df: DataFrame, keys: list[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Standardised mean difference with the pooled sample deviation."""
    def of(fn, g):
        return fn(F.when(F.col(group) == g, F.col(value)))

    g = df.groupBy(*keys).agg(of(F.count, a).alias("n_a"), of(F.count, b).alias("n_b"), of(F.avg, a).alias("mean_a"), of(F.avg, b).alias("mean_b"),
                              of(F.var_samp, a).alias("_va"), of(F.var_samp, b).alias("_vb"))
    pooled = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb"), F.col("n_a") + F.col("n_b") - 2))
    return g.select(*keys, "n_a", "n_b", "mean_a", "mean_b", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.when(pooled > 0, pooled)).alias("d"))


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str, unique: str) -> DataFrame:
    """Adjusted probabilities within a family; a family is a list of tests, far smaller than the data."""
    w = Window.partitionBy(*family)
    n, rank = F.count(p).over(w), F.row_number().over(w.orderBy(F.col(p), unique))
    raw = tests.where(F.col(p).isNotNull()).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * n / rank)).withColumn("_r", rank)
    return raw.withColumn("q_value", F.min("_raw").over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))).drop("_raw", "_r")


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> list[Column]:
    """Share and Wilson interval in percent."""
    p, n = F.try_divide(successes.cast("double"), total), total.cast("double")
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / d
    return [(p * 100).alias("rate"), (F.greatest(F.lit(0.0), mid - half) * 100).alias("low"), (F.least(F.lit(1.0), mid + half) * 100).alias("high")]


def rate_gap(counts: DataFrame, keys: list[str], group: str, a: str, b: str) -> DataFrame:
    """Difference of two rates with conservative bounds from their intervals. Reads ``successes, total``."""
    one = counts.select(*keys, group, *wilson(F.col("successes"), F.col("total")))
    g = one.groupBy(*keys).agg(*[F.max(F.when(F.col(group) == s, F.col(c))).alias(f"{c}_{i}") for i, s in enumerate((a, b)) for c in ("rate", "low", "high")])
    return g.select(*keys, (F.col("rate_0") - F.col("rate_1")).alias("gap"), (F.col("low_0") - F.col("high_1")).alias("gap_low"), (F.col("high_0") - F.col("low_1")).alias("gap_high"))


def cronbach_alpha(items: DataFrame, columns: list[str]) -> DataFrame:
    """Internal consistency of complete rows."""
    df = items.select(*columns).dropna()
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    g = df.agg(F.count(F.lit(1)).alias("n"), F.var_samp(total).alias("_t"), *[F.var_samp(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    k = len(columns)
    spread = sum((F.col(f"_v{i}") for i in range(k)), F.lit(0.0))
    return g.select("n", F.lit(k).alias("items"), (F.lit(k / (k - 1)) * (1 - F.try_divide(spread, "_t"))).alias("alpha"))


def rank_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation ``a, b, n, rho`` of the named pairs of columns over rows where all of them are present.

    All pairs go through the same steps in long form: equal (pair, x, y) are counted first, ranks come from one ordered pass
    over the counted values of every column, and a weighted correlation is summed per pair. So the shuffles are as many for fifty
    columns as for two. ``rho`` is null where a column has one value only; without rows ``n`` is 0.
    """
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).where(present)
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(at[a]).alias("ix"), F.lit(at[b]).alias("iy"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])
    joint = whole.select(F.inline(cells)).groupBy("pair", "ix", "iy", "x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    # a column's values are taken from the first pair that has it
    first = {c: min(i for i, pair in enumerate(pairs) if c in pair) for c in columns}
    of_x = [first[a] == i for i, (a, _) in enumerate(pairs)]
    of_y = [first[b] == i and a != b for i, (a, b) in enumerate(pairs)]
    sides = F.array(*[F.struct(F.element_at(F.lit(own), F.col("pair") + 1).alias("own"), F.col(i).alias("item"), F.col(v).alias("v"), "n") for own, i, v in ((of_x, "ix", "x"), (of_y, "iy", "y"))])
    ranks = average_ranks(joint.select(F.inline(sides)).where("own"), ["item"], "v", "n").select("item", "v", "avg_rank")
    j = joint.join(ranks.select(F.col("item").alias("ix"), F.col("v").alias("x"), F.col("avg_rank").alias("rx")), ["ix", "x"])
    j = j.join(ranks.select(F.col("item").alias("iy"), F.col("v").alias("y"), F.col("avg_rank").alias("ry")), ["iy", "y"])
    j = attach(j, joint.where("pair = 0").agg(F.sum("n").alias("_rows")), [])
    # ranks have the mean (rows + 1) / 2 in every column; taking it off first keeps the sums small
    cx, cy = (F.col(c) - (F.col("_rows") + 1) / 2.0 for c in ("rx", "ry"))
    sums = j.groupBy("pair").agg(F.sum("n").alias("n"), F.sum(F.col("n") * cx * cy).alias("xy"), F.sum(F.col("n") * cx * cx).alias("xx"), F.sum(F.col("n") * cy * cy).alias("yy"))
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    named = df.sparkSession.range(1).select(F.inline(names)).join(sums, "pair", "left")
    return named.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns; the pairs are of columns, not of rows."""
    return rank_correlations(df, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]).select("n", "a", "b", "rho")


def item_total(items: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of each item with the sum of the others."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    df = items.select(*columns, *[F.round(total - F.col(c), 9).alias(f"rest_{c}") for c in columns])
    return rank_correlations(df, [(c, f"rest_{c}") for c in columns]).select(F.col("a").alias("item"), "rho")


def expectation_gate(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected values with a tolerance; an absent metric fails."""
    j = expected.join(metrics, "metric", "left")
    off = F.abs(F.col("observed") - F.col("expected"))
    return j.select("metric", "expected", "observed", "tolerance", F.coalesce(off <= F.col("tolerance"), F.lit(False)).alias("passed"))


def assert_gate(checks: DataFrame) -> None:
    """Stop when any check failed."""
    from ..scale import require_empty

    require_empty(checks.where(~F.col("passed")), "result differs from its expected value")


def tipping_point(counts: DataFrame, keys: list[str], slice_rows: int = 10_000) -> DataFrame:
    """Rate gap for every split of the left-out cases without success over the two groups.

    Reads ``success_a, total_a, success_b, total_b, excluded``. For each number from 0 to ``excluded``, that many join group A's
    denominator and the rest group B's; successes stay. Splits are laid out slice by slice, so no row holds a long list.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("excluded").cast("long"), F.lit(slice_rows).cast("long"))
    x = counts.withColumn("_s", F.explode(starts))
    x = x.repartition("_s", *keys) if keys else x.repartition("_s")
    x = x.withColumn("added_a", F.explode(F.sequence("_s", F.least(F.col("excluded").cast("long"), F.col("_s") + (slice_rows - 1)))))
    x = x.withColumn("added_b", F.col("excluded").cast("long") - F.col("added_a"))
    gap = F.try_divide(F.col("success_a") * 100.0, F.col("total_a") + F.col("added_a")) - F.try_divide(F.col("success_b") * 100.0, F.col("total_b") + F.col("added_b"))
    return x.select(*keys, "added_a", "added_b", gap.alias("gap"), (gap <= 0).alias("reversed"))


def detectable_difference(counts: DataFrame, keys: list[str], z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> DataFrame:
    """Smallest rate difference the two group sizes could show, in percent points."""
    p = (F.col("success_a") + F.col("success_b")) / (F.col("total_a") + F.col("total_b")).cast("double")
    se = F.sqrt(p * (1 - p) * (1.0 / F.col("total_a") + 1.0 / F.col("total_b")))
    return counts.select(*keys, (se * (z_alpha + z_power) * 100).alias("min_difference"))
