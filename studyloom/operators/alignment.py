"""Two-coder alignment and agreement (inventory J03, A46-A48, A68)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hhmmss
from ..scale import attach, exact_quantiles, require_empty, running_over, with_halo


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, left_id: str, right_id: str, tolerance: float) -> DataFrame:
    """Nearest right row in time for each left row within a tolerance; equal distances take the earlier.

    The time axis of a key is cut into buckets and right rows near an edge are copied to the neighbour,
    so one long recording is spread over many tasks. Unmatched left rows are dropped.
    """
    width = max(float(tolerance) * 16, 1e-9)
    l = with_halo(left, at, width, 0, 0).where("is_core").select(*keys, "bucket", F.col(at).alias("_t"), F.col(left_id).alias("_l"), F.lit(1).alias("_side"))
    r = with_halo(right, at, width, tolerance, tolerance).select(*keys, "bucket", F.col(at).alias("_t"), F.col(right_id).alias("_r"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    part = [*keys, "bucket"]
    hit = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_r").alias("id")))
    up = Window.partitionBy(*part).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.desc("_t"), "_side", F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last(hit, ignorenulls=True).over(up)).withColumn("_f", F.last(hit, ignorenulls=True).over(down)).where("_side = 1")
    back, fore = F.col("_t") - F.col("_b.t"), F.col("_f.t") - F.col("_t")
    use_back = back.isNotNull() & (fore.isNull() | (back <= fore))
    chosen = F.when(use_back, F.col("_b")).otherwise(F.col("_f"))
    out = both.select(*keys, F.col("_l").alias(left_id), F.col("_t").alias(f"{at}_left"), chosen.alias("_c"))
    out = out.select(*keys, left_id, f"{at}_left", F.col("_c.id").alias(right_id), F.col("_c.t").alias(f"{at}_right"))
    out = out.withColumn("delta", F.col(f"{at}_right") - F.col(f"{at}_left"))
    return out.where(F.abs(F.col("delta")) <= float(tolerance))


def reuse_counts(aligned: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """How often each right row was taken."""
    return aligned.groupBy(*keys, right_id).agg(F.count(F.lit(1)).alias("uses"))


def median_step(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Median positive step between neighbouring times of a stream."""
    steps = running_over(stream.select(*keys, at).distinct(), keys, [F.col(at)], _prev=("lag", F.col(at)))
    steps = steps.withColumn("_step", F.col(at) - F.col("_prev")).where("_step > 0")
    return exact_quantiles(steps, keys, "_step", {"median_step": 0.5})


def alignment_tolerance(a: DataFrame, b: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Half the larger median step, rounded up."""
    m = median_step(a, keys, at).withColumnRenamed("median_step", "step_a").join(median_step(b, keys, at).withColumnRenamed("median_step", "step_b"), keys)
    return m.withColumn("tolerance", F.ceil(F.greatest("step_a", "step_b") / 2))


def coverage(aligned: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """Aligned share of either stream, right rows used more than once, largest distance."""
    used = reuse_counts(aligned, keys, right_id)
    u = used.groupBy(*keys).agg(F.sum("uses").alias("aligned"), F.count(F.lit(1)).alias("right_used"), F.count_if(F.col("uses") > 1).alias("right_reused"))
    d = aligned.groupBy(*keys).agg(F.max(F.abs("delta")).alias("max_delta"))
    nl = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    nr = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    j = nl.join(nr, keys, "full").join(u, keys, "left").join(d, keys, "left").na.fill(0, ["n_left", "n_right", "aligned", "right_used", "right_reused"])
    return j.withColumn("left_pct", F.try_divide(F.col("aligned") * 100.0, "n_left")).withColumn("right_pct", F.try_divide(F.col("right_used") * 100.0, "n_right"))


def assert_unique_times(stream: DataFrame, keys: list[str], at: str) -> None:
    """Stop when a coder has two rows at one time, or a row without a time."""
    require_empty(stream.where(F.col(at).isNull()).select(*keys), "coder row without a time")
    require_empty(stream.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "coder rows share a time")


def assert_overlap(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> None:
    """Stop when the two coders' time ranges of a recording do not meet, or one coder has none."""
    span = lambda df, s: df.groupBy(*keys).agg(F.min(at).alias(f"lo_{s}"), F.max(at).alias(f"hi_{s}"))
    both = span(left, "a").join(span(right, "b"), keys, "full")
    meets = (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    require_empty(both.where(~F.coalesce(meets, F.lit(False))), "coder time ranges do not overlap")


def assert_coverage(covered: DataFrame, minimum_pct: float = 90.0) -> None:
    """Stop when less than the minimum of either stream of a recording is aligned."""
    low = F.least(F.coalesce("left_pct", F.lit(0.0)), F.coalesce("right_pct", F.lit(0.0))) < minimum_pct
    require_empty(covered.where(low), f"less than {minimum_pct:g} % of a stream is aligned")


def agreement(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Observed and expected agreement and kappa of two coders, per key.

    Rows are counted by code pair first; the margins are sums over that small table.
    """
    joint = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    ends = joint.select(*keys, "n", F.explode(F.array(F.struct(F.col(a).cast("string").alias("c"), F.lit("a").alias("s")),
                                                      F.struct(F.col(b).cast("string").alias("c"), F.lit("b").alias("s")))).alias("e"))
    margin = ends.groupBy(*keys, F.col("e.c").alias("_c")).agg(F.sum(F.when(F.col("e.s") == "a", F.col("n")).otherwise(0)).alias("na"),
                                                              F.sum(F.when(F.col("e.s") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = margin.groupBy(*keys).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_cross"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("eligible"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agreeing"))
    j = attach(total, chance, keys)
    po = F.try_divide(F.col("agreeing").cast("double"), "eligible")
    pe = F.try_divide("_cross", F.col("eligible").cast("double") * F.col("eligible"))
    one = F.abs(1 - pe) < 1e-12
    return j.select(*keys, "eligible", "agreeing", po.alias("observed"), pe.alias("expected"),
                    F.when(~one, (po - pe) / (1 - pe)).alias("kappa"),
                    F.when(F.coalesce(F.col("eligible"), F.lit(0)) == 0, "undefined_no_eligible_rows")
                    .when(one, "undefined_expected_agreement_is_one").otherwise("ok").alias("kappa_status"))


def jaccard(flags: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """Overlap of two flagged sets."""
    return flags.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either")).withColumn(
        "jaccard", F.try_divide(F.col("both").cast("double"), "either"))


def disagreements(pairs: DataFrame, a: str, b: str, seconds: Column | None, delta: Column | None, keep: list[str]) -> DataFrame:
    """Mismatching rows with their time, distance and how the time is known."""
    t = F.lit(None).cast("double") if seconds is None else seconds
    return pairs.where(F.col(a) != F.col(b)).select(
        *keep, F.col(a).alias("code_a"), F.col(b).alias("code_b"), t.alias("seconds"), hhmmss(t).alias("at"),
        (F.lit(None).cast("double") if delta is None else delta).alias("delta"),
        F.when(t.isNotNull(), "video time").otherwise("no time").alias("time_status"))


def adjusted_rand(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    joint = labelled.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

    def pairs(c):
        return c * (c - 1) / 2.0

    n_ab = joint.agg(F.sum(pairs(F.col("n"))).alias("s_ab"), F.sum("n").alias("n"))
    n_a = joint.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("s_a"))
    n_b = joint.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("s_b"))
    j = attach(attach(n_ab, n_a, []), n_b, [])
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), pairs(F.col("n")))
    best = (F.col("s_a") + F.col("s_b")) / 2.0
    return j.select("n", F.coalesce(F.try_divide(F.col("s_ab") - expected, best - expected), F.lit(1.0)).alias("ari"))
