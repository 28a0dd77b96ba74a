"""Response quality rules, item screening and cohorts (inventory A60-A63, F03, F08-F09, W05-W06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import branch_condition
from ..scale import attach, exact_quantiles, running_over, with_halo

# Limits of the trust rules.
MIN_TOTAL_TIME = 11.57
MIN_SECTION_TIME = 7.85
LOW_QUANTILE = 0.01
MIN_ANSWERED_SHARE = 0.80
BURST_SIZE = 3
BURST_SECONDS = (60, 900)
MAX_SIMILARITY = 0.90
HARD_RULES = ("R1", "R2", "R5", "R8", "R9")
SOFT_RULES = ("R3", "R4", "R6", "R7")
RULES = ("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10")


def flag_bursts(df: DataFrame, keys: list[str], at: str, ident: str, seconds: float, minimum: int = BURST_SIZE) -> DataFrame:
    """Rows that lie in some window of ``seconds`` holding at least ``minimum`` rows of the key.

    A window of m rows ends at a row whose (m-1)-th predecessor is near enough; every row of such a
    window is flagged. Buckets with copied edges keep a busy key in many tasks.
    """
    cut = with_halo(df, at, seconds * 64, seconds, seconds)
    w = Window.partitionBy(*keys, "bucket").orderBy(at, ident)
    near = F.coalesce(F.col(at) - F.lag(at, minimum - 1).over(w) <= float(seconds), F.lit(False))
    flagged = cut.withColumn("_end", near).withColumn("in_burst", F.max("_end").over(w.rowsBetween(0, minimum - 1)))
    return flagged.where("is_core").drop("_end", "bucket", "is_core")


def arrival_gaps(df: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """Positive time since the previous row of the key."""
    g = running_over(df.select(*keys, at, ident), keys, [F.col(at), F.col(ident)], _prev=("lag", F.col(at)))
    return g.withColumn("gap", F.col(at) - F.col("_prev")).where("gap > 0").drop("_prev")


def burst_window(gaps: DataFrame, source: list[str], p: float = LOW_QUANTILE) -> DataFrame:
    """Low quantile of the gaps per source, clamped to the allowed window."""
    q = exact_quantiles(gaps, source, "gap", {"q": p})
    return q.withColumn("window_seconds", F.least(F.lit(float(BURST_SECONDS[1])), F.greatest(F.lit(float(BURST_SECONDS[0])), F.col("q"))))


def trust_rules(features: DataFrame, sections: list[str], scale_sds: list[str]) -> DataFrame:
    """Rules R1 to R10 and the trust tier of every response.

    Reads ``uid, source, is_reference, total_time, fingerprint, answered_share, in_burst, similarity,
    branching_issue, impossible, native_gate``, the section times and the scale deviations. The limits
    of R3 and R4 are quantiles of the reference rows, one row in all.
    """
    measures = [*sections, *scale_sds]
    cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in measures])
    ref = features.where("is_reference").select(F.inline(cells))
    low = exact_quantiles(ref, ["item"], "value", {"q": LOW_QUANTILE})
    limits = low.agg(*[F.max(F.when(F.col("item") == c, F.col("q"))).alias(f"_q_{c}") for c in measures])
    copies = features.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    df = attach(features, limits, []).join(copies, "fingerprint", "left")

    def any_of(tests):
        return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests], F.lit(False))

    no = F.lit(False)
    rules = {
        "R1": F.coalesce(F.round("total_time", 2) < MIN_TOTAL_TIME, no),
        "R2": any_of([F.col(c) < MIN_SECTION_TIME for c in sections]),
        "R3": any_of([F.col(c) < F.col(f"_q_{c}") for c in sections]),
        "R4": any_of([F.col(c) <= F.col(f"_q_{c}") for c in scale_sds]),
        "R5": F.col("_copies").isNotNull() & F.coalesce(F.col("answered_share") >= MIN_ANSWERED_SHARE, no),
        "R6": F.coalesce("in_burst", no), "R7": F.coalesce(F.col("similarity") > MAX_SIMILARITY, no),
        "R8": F.coalesce("branching_issue", no), "R9": F.coalesce("impossible", no), "R10": F.coalesce("native_gate", no),
    }
    df = df.select("uid", "source", "is_reference", *[c.alias(n) for n, c in rules.items()])
    return with_tier(df)


def with_tier(rules: DataFrame) -> DataFrame:
    """Tier 1 for a hard rule, 2 for two soft ones, 3 for one, else 4; R10 never decides."""
    hard = reduce(lambda a, b: a | b, [F.col(n) for n in HARD_RULES])
    soft = sum((F.col(n).cast("int") for n in SOFT_RULES), F.lit(0))
    tier = F.when(hard, 1).when(soft >= 2, 2).when(soft == 1, 3).otherwise(4)
    return rules.withColumn("tier", tier).withColumn("triggered", F.concat_ws(",", *[F.when(F.col(n), F.lit(n)) for n in RULES]))


def rule_summary(rules: DataFrame) -> DataFrame:
    """Hits per rule and source, and the share of the reference rows each rule hits."""
    g = rules.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_reference")).alias("_ref"),
                                    *[F.count_if(F.col(n)).alias(f"h_{n}") for n in RULES],
                                    *[F.count_if(F.col(n) & F.col("is_reference")).alias(f"f_{n}") for n in RULES])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"h_{n}").alias("hits"), F.try_divide(F.col(f"f_{n}") * 100.0, "_ref").alias("false_positive_pct"))
                     for n in RULES])
    return g.select("source", "rows", F.inline(rows))


def tier_shares(rules: DataFrame) -> DataFrame:
    """Count and percent of each tier within its source."""
    n = rules.groupBy("source", "tier").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("source")))


def rules_long(rules: DataFrame) -> DataFrame:
    """One row per response and triggered rule."""
    return rules.select("uid", "source", F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in RULES]))).alias("rule"))


def branching_audit(df: DataFrame, ident: str, orphans: list[dict], exclusive: list[tuple[str, str]], at_most: list[tuple[str, float]]) -> DataFrame:
    """Answered follow-ups whose gate is closed, both sides of an exclusive pair, impossible counts."""
    def filled(c):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""

    def row(rule, gate, seen):
        return F.struct(F.lit(rule).alias("rule"), F.to_json(F.struct(*[F.col(g) for g in gate])).alias("gate"), F.to_json(F.struct(*[F.col(s) for s in seen])).alias("observed"))

    made = [F.when(~branch_condition(o["gate"]) & filled(o["follow_up"]), row("orphan_follow_up", [o["gate"]["field"]], [o["follow_up"]])) for o in orphans]
    made += [F.when(filled(a) & filled(b), row("exclusive_pair", [a], [b])) for a, b in exclusive]
    made += [F.when(F.col(c).try_cast("double") > float(m), row("impossible_count", [c], [c])) for c, m in at_most]
    return df.select(ident, F.explode(F.array_compact(F.array(*made))).alias("r")).select(ident, "r.*")


def item_cells(df: DataFrame, items: list[str]) -> DataFrame:
    """Counted cells (item, value, n): one row per distinct answer, built before any wider step."""
    cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("string").alias("value")) for i in items])
    return df.select(F.inline(cells)).groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))


def item_profile(df: DataFrame, items: list[str]) -> DataFrame:
    """N, missing percent, most frequent value and its share, kind and range of every item."""
    c = item_cells(df, items)
    num = F.col("value").try_cast("double")
    g = c.groupBy("item").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("answered"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("n", "value"))).alias("_m"),
        F.bool_and(F.when(F.col("value").isNotNull(), num.isNotNull())).alias("numeric"), F.min(num).alias("low"), F.max(num).alias("high"),
        F.count(F.col("value")).alias("distinct_values"))
    return g.select("item", "rows", "answered", ((F.col("rows") - F.col("answered")) * 100.0 / F.col("rows")).alias("missing_pct"),
                    F.col("_m.value").alias("mode"), F.try_divide(F.col("_m.n") * 100.0, "answered").alias("mode_pct"),
                    F.when(F.col("numeric"), "numeric").otherwise("text").alias("kind"), F.when(F.col("numeric"), F.col("low")).alias("low"),
                    F.when(F.col("numeric"), F.col("high")).alias("high"), "distinct_values")


def screen_items(profile: DataFrame, max_missing_pct: float, max_mode_pct: float, named: list[str]) -> DataFrame:
    """first reason for dropping an item: missing, near constant or named; null keeps it."""
    reason = (F.when(F.col("missing_pct") > max_missing_pct, "missing").when(F.col("mode_pct") >= max_mode_pct, "near_constant")
              .when(F.col("item").isin(*named), "named"))
    return profile.select("item", reason.alias("drop_reason"))


def cohorts(rules: DataFrame, definitions: list[tuple[str, Column]]) -> DataFrame:
    """response once per cohort definition it meets."""
    made = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in definitions]))
    return rules.withColumn("cohort", F.explode(made))


def cohort_flow(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """rows left after each filter, all from one pass."""
    aggs, test = [F.count(F.lit(1)).alias("s0")], F.lit(True)
    for i, (_, t) in enumerate(steps, 1):
        test = test & F.coalesce(t, F.lit(False))
        aggs.append(F.count_if(test).alias(f"s{i}"))
    names = ["all", *[n for n, _ in steps]]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n")) for i, n in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))
