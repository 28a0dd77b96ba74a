"""Building blocks that keep ordered work spread out when one key holds a large share of the rows.

Spark never splits a window partition, so a window over a hot key runs in one task. The helpers
here cut the total order into contiguous blocks, run the window inside a block, and carry a
short summary across the block edges. Only keys that cross an edge need a carry, at most two
per block, which is the proven bound of the one broadcast used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint_dir

BLOCK = "_blk"


def ordered_blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition on (keys, order), number the partitions, and pin them with a checkpoint.

    The order must end in a unique column, so equal values can be cut apart too.
    """
    checkpoint_dir(df.sparkSession)
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    out = spread.withColumn(BLOCK, F.spark_partition_id()).checkpoint()
    # small inputs end up in one block, which needs nothing carried into it
    out._one_block = out.rdd.getNumPartitions() == 1
    return out


def running(blocks: DataFrame, keys: list[str], order: list[Column], **specs: tuple) -> DataFrame:
    """Add running columns over (keys, order) to the output of :func:`ordered_blocks`.

    A spec is one of ``("rows",)``, ``("sum", col)``, ``("max", col)``, ``("max_before", col)``
    (without the row itself), ``("last", col)`` (last
    non-null up to and including the row), ``("lag", col)`` and ``("lead", col)``.
    """
    part = [BLOCK, *keys]
    w = Window.partitionBy(*part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def within(df: DataFrame) -> DataFrame:
        local = df.withColumn("_row_in_blk", F.row_number().over(w)).withColumn("_rows_in_blk", F.count(F.lit(1)).over(Window.partitionBy(*part)))
        return _within(local, specs, w, run)

    local = within(blocks)
    names = list(specs)
    if getattr(blocks, "_one_block", False):
        done = local.drop("_row_in_blk", "_rows_in_blk", *[f"_v_{n}" for n in names])
        done._one_block = True
        return done
    if keys:
        # at most two keys of a block cross its edges; only their rows go through the windows again
        key = F.struct(*keys)
        edges = F.broadcast(blocks.groupBy(BLOCK).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")))
        edge_rows = within(blocks.join(edges, BLOCK).where(key.eqNullSafe(F.col("_lo")) | key.eqNullSafe(F.col("_hi"))).drop("_lo", "_hi"))
    else:
        edge_rows = local
    last_row = {n: F.max(F.when(F.col("_row_in_blk") == F.col("_rows_in_blk"), F.col(f"_v_{n}" if s[0] in ("lag", "lead", "max_before") else n)))
                for n, s in specs.items()}
    first_row = {n: F.max(F.when(F.col("_row_in_blk") == 1, F.col(f"_v_{n}")))
                 for n, s in specs.items() if s[0] == "lead"}
    summary = (edge_rows.where((F.col("_row_in_blk") == 1) | (F.col("_row_in_blk") == F.col("_rows_in_blk")))
               .groupBy(*part)
               .agg(*[c.alias(f"_e_{n}") for n, c in last_row.items()],
                    *[c.alias(f"_f_{n}") for n, c in first_row.items()]))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        *[
            {
                "rows": lambda n: F.sum(f"_e_{n}").over(before),
                "sum": lambda n: F.sum(f"_e_{n}").over(before),
                "max": lambda n: F.max(f"_e_{n}").over(before),
                "max_before": lambda n: F.max(f"_e_{n}").over(before),
                "last": lambda n: F.last(f"_e_{n}", ignorenulls=True).over(before),
                "lag": lambda n: F.lag(f"_e_{n}").over(across),
                "lead": lambda n: F.lead(f"_f_{n}").over(across),
            }[spec[0]](name).alias(f"_c_{name}")
            for name, spec in specs.items()
        ],
    )
    joined = null_safe_join(local, F.broadcast(carry), part, "left")
    for name, spec in specs.items():
        c, v = F.col(f"_c_{name}"), F.col(name)
        kind = spec[0]
        if kind in ("rows", "sum"):
            out = F.when(c.isNull(), v).when(v.isNull(), c).otherwise(c + v)
        elif kind in ("max", "max_before"):
            out = F.greatest(v, c)
        elif kind == "last":
            out = F.coalesce(v, c)
        elif kind == "lag":
            out = F.when(F.col("_row_in_blk") == 1, c).otherwise(v)
        else:
            out = F.when(F.col("_row_in_blk") == F.col("_rows_in_blk"), c).otherwise(v)
        joined = joined.withColumn(name, out)
    helpers = ["_row_in_blk", "_rows_in_blk"] + [f"_c_{n}" for n in specs] + [f"_v_{n}" for n in specs]
    return joined.drop(*helpers)


def _within(local: DataFrame, specs: dict[str, tuple], w, run) -> DataFrame:
    """The running columns of :func:`running` inside each block."""
    for name, spec in specs.items():
        kind = spec[0]
        if kind == "rows":
            local = local.withColumn(name, F.col("_row_in_blk").cast("long"))
        elif kind == "sum":
            local = local.withColumn(name, F.sum(spec[1]).over(run))
        elif kind == "max":
            local = local.withColumn(name, F.max(spec[1]).over(run))
        elif kind == "max_before":
            local = local.withColumn(f"_v_{name}", F.max(spec[1]).over(run)).withColumn(
                name, F.max(spec[1]).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        elif kind == "last":
            local = local.withColumn(name, F.last(spec[1], ignorenulls=True).over(run))
        elif kind == "lag":
            local = local.withColumn(f"_v_{name}", spec[1]).withColumn(
                name, F.lag(f"_v_{name}").over(w))
        elif kind == "lead":
            local = local.withColumn(f"_v_{name}", spec[1]).withColumn(
                name, F.lead(f"_v_{name}").over(w))
        else:
            raise ValueError(f"unknown running spec {kind}")
    return local


def running_over(df: DataFrame, keys: list[str], order: list[Column], **specs: tuple) -> DataFrame:
    """:func:`ordered_blocks` followed by :func:`running`, without the block column."""
    return running(ordered_blocks(df, keys, order), keys, order, **specs).drop(BLOCK)


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Tie-averaged ranks as one row per distinct (keys, value): ``n``, ``avg_rank``.

    Equal values are counted before anything is ordered, so a value shared by most rows is one row. With ``weight``, a row
    stands for that many.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    upto = running_over(counts, keys, [F.col(value)], upto=("sum", F.col("n")))
    return upto.withColumn("avg_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).drop("upto")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key without holding a group's values in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    upto = running_over(counts, keys, [F.col(value)], _upto=("sum", F.col("_cnt")))
    ranked = attach(upto, counts.groupBy(*keys).agg(F.sum("_cnt").alias("_total")), keys)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo_at, hi_at = F.floor(pos), F.ceil(pos)
        first, last = F.col("_upto") - F.col("_cnt"), F.col("_upto") - 1
        lo = F.max(F.when((first <= lo_at) & (last >= lo_at), F.col(value)))
        hi = F.max(F.when((first <= hi_at) & (last >= hi_at), F.col(value)))
        aggs.append((lo + (hi - lo) * F.max(pos - lo_at)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def with_halo(df: DataFrame, at: str, width: float, before: float, after: float) -> DataFrame:
    """Cut a numeric axis into buckets and copy rows that a neighbour bucket must also see.

    Adds ``bucket`` and ``is_core``. A row is copied to the previous bucket when that bucket needs
    rows up to ``after`` past its end, and to the next one when it needs ``before`` rows earlier.
    """
    if max(before, after) > width:
        raise ValueError("halo may not exceed the bucket width")
    b = F.floor(F.col(at) / F.lit(float(width))).cast("long")
    offset = F.col(at) - b * F.lit(float(width))
    copies = F.array_compact(F.array(
        b,
        F.when(offset <= F.lit(float(after)), b - 1),
        F.when(offset >= F.lit(float(width) - float(before)), b + 1),
    ))
    return (df.withColumn("_home", b).withColumn("bucket", F.explode(copies))
            .withColumn("is_core", F.col("bucket") == F.col("_home")).drop("_home"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the left side's key columns stay. ``how`` is inner or left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-key totals to rows. With no keys ``totals`` is an aggregate without grouping, so it has
    exactly one row and is sent to every task; a shuffle on a constant would put all rows in one."""
    if keys:
        return null_safe_join(df, totals, keys)
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(totals.withColumn("_one", F.lit(0))), "_one").drop("_one")


def bounded(df: DataFrame, max_rows: int) -> bool:
    """True when a table has at most ``max_rows`` rows; reads no more than needed to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after checking the row count; otherwise leave the shuffle join."""
    return F.broadcast(df) if bounded(df, max_rows) else df


def salted(df: DataFrame, salts: int, *on: str) -> DataFrame:
    """Add a repeatable ``_salt`` in [0, salts) from the named columns."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*on), F.lit(salts)))


def require_empty(bad: DataFrame, message: str) -> None:
    """Fail closed when a gate finds any row."""
    hit = bad.limit(1).collect()
    if hit:
        raise ValueError(f"{message}: {hit[0].asDict()}")
