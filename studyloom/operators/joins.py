"""Checked joins, reconciliation and set comparison (inventory J04-J07, J12-J13, O01-O04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import require_empty, running_over


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi join that fails when either side repeats a key."""
    for name, df in (("left", a), ("right", b)):
        require_empty(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"repeated key on the {name} side")
    return a.join(b, keys)


def by_row_order(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Join by position in a declared unique order, numbered block by block."""
    left = running_over(a, [], [F.col(order_a)], position=("rows",))
    right = running_over(b, [], [F.col(order_b)], position=("rows",))
    return left.join(right, "position")


def reconcile(recomputed: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """Both totals per key, absent as zero, signed difference and a mismatch flag. Frames hold (key, n)."""
    j = recomputed.select(key, F.col("n").alias("recomputed")).join(supplied.select(key, F.col("n").alias("supplied")), key, "full")
    j = j.select(key, F.coalesce("recomputed", F.lit(0)).alias("recomputed"), F.coalesce("supplied", F.lit(0)).alias("supplied"))
    return j.withColumn("discrepancy", F.col("recomputed") - F.col("supplied")).withColumn("mismatch", F.col("discrepancy") != 0)


def population_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose multiplicity differs, with the surplus of each side. Counts meet before the join."""
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    j = ca.join(cb, keys, "full").na.fill(0, ["n_a", "n_b"])
    return j.where("n_a <> n_b").select(*keys, F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)).alias("extra"),
                                        F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)).alias("missing"))


def nearest_gap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, at_left: str, at_right: str) -> DataFrame:
    """Smallest day distance of each left row to any right row with the same key.

    Distinct dates per key are merged with the left rows in one order, and the nearest one before and
    after is carried along, so rows are never paired up.
    """
    from ..scale import ordered_blocks, running

    days = right.groupBy(*keys, F.col(at_right).alias("_at")).agg(F.lit(1).alias("_"))
    both = left.select(*keys, F.col(left_id).alias("_id"), F.col(at_left).alias("_at"), F.lit(1).alias("_side")).unionByName(
        days.select(*keys, F.lit(None).cast(dict(left.dtypes)[left_id]).alias("_id"), "_at", F.lit(0).alias("_side")))
    seen = F.when(F.col("_side") == 0, F.col("_at"))
    up = [F.col("_at"), F.col("_side"), F.col("_id")]
    down = [F.col("_at").desc(), F.col("_side"), F.col("_id")]
    before = running(ordered_blocks(both, keys, up), keys, up, _before=("last", seen)).drop("_blk")
    after = running(ordered_blocks(before.where(F.col("_at").isNotNull()), keys, down), keys, down, _after=("last", seen)).drop("_blk")
    gap = F.least(F.datediff("_at", "_before"), F.datediff("_after", "_at"))
    return after.where("_side = 1").select(*keys, F.col("_id").alias(left_id), gap.alias("gap_days"))


def listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in a supplied list."""
    return df.join(ids.select(key), key, "left_semi")


def queue_order(assigned: Column, tier: Column, days_remaining: Column, at: Column, unique: Column) -> list[Column]:
    """Open work first, then tier, days left and date; the unique key makes the order total."""
    return [assigned.asc(), tier.asc(), days_remaining.asc_nulls_last(), at.asc_nulls_last(), unique.asc()]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Best k rows, overall or per key.

    ``row_number() <= k`` is limited in every map task before the shuffle, so a hot key sends at most
    k rows per task to its reducer.
    """
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def code_sort(columns: list[str], unique: str) -> list[Column]:
    """Nulls last, numeric codes before text, closed by a unique key."""
    out: list[Column] = []
    for c in columns:
        n = F.col(c).try_cast("double")
        out += [F.col(c).isNull().asc(), n.asc_nulls_last(), F.col(c).asc_nulls_last()]
    return out + [F.col(unique).asc()]


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of both, only in a, only in b and either, from one pass over the flagged keys."""
    flags = (a.select(key).withColumn("_s", F.lit(1)).unionByName(b.select(key).withColumn("_s", F.lit(2)))
             .groupBy(key).agg(F.max(F.when(F.col("_s") == 1, 1).otherwise(0)).alias("_a"), F.max(F.when(F.col("_s") == 2, 1).otherwise(0)).alias("_b")))
    one = flags.agg(F.count_if((F.col("_a") + F.col("_b")) == 2).alias("k0"), F.count_if(F.col("_a") > F.col("_b")).alias("k1"),
                    F.count_if(F.col("_b") > F.col("_a")).alias("k2"), F.count(F.lit(1)).alias("k3"))
    rows = [F.struct(F.lit(n).alias("part"), F.col(f"k{i}").alias("n")) for i, n in enumerate(("both", "only_a", "only_b", "either"))]
    return one.select(F.inline(F.array(*rows)))
