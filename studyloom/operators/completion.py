"""Form completion tallies (inventory A13-A16, J02, J08, J16, F01-F02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_text

# Completion codes and their order.
STATUS_ORDER = ("Complete", "Unverified", "Incomplete", "Not started")
STARTED = ("Complete", "Unverified", "Incomplete")


def completion_status(code: Column) -> Column:
    c = safe_text(code)
    return F.when(c == "2", "Complete").when(c == "1", "Unverified").when(c == "0", "Incomplete").otherwise("Not started")


def completion_tally(records: DataFrame, event: str, suffix: str = "_complete") -> DataFrame:
    """Count per instrument, event and status from all ``*_complete`` columns in one scan."""
    forms = [c for c in records.columns if c.endswith(suffix)]
    cells = F.array(*[F.struct(F.lit(c[: -len(suffix)]).alias("instrument"), completion_status(F.col(c)).alias("status")) for c in forms])
    name = F.when(safe_text(F.col(event)) == "", "(no event)").otherwise(F.col(event))
    long = records.select(name.alias("event"), F.explode(cells).alias("x"))
    return long.groupBy(F.col("x.instrument").alias("instrument"), "event", F.col("x.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def event_volume(records: DataFrame, event: str, ident: str, approximate: bool = False) -> DataFrame:
    """Rows and distinct ids per event."""
    ids = F.approx_count_distinct(ident) if approximate else F.count_distinct(ident)
    return records.groupBy(event).agg(F.count(F.lit(1)).alias("rows"), ids.alias("records"))


def rate(complete: Column, started: Column) -> Column:
    """Percent complete of started, one decimal, 0 when nothing started."""
    return F.coalesce(F.bround(F.try_divide(complete * 100.0, started), 1), F.lit(0.0))


def completion_totals(tally: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One column per status, started and rate, for the whole or per key."""
    sums = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s.lower().replace(" ", "_")) for s in STATUS_ORDER]
    out = tally.groupBy(*(keys or [])).agg(*sums)
    started = reduce(lambda a, b: a + b, [F.col(s.lower()) for s in STARTED])
    return out.withColumn("started", started).withColumn("completion_rate", rate(F.col("complete"), F.col("started")))


def enrich_counts(base: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """Left join of several counts to a base, missing as zero. Each frame holds (key, n)."""
    for name, df in counts.items():
        base = base.join(df.select(F.col(key), F.col("n").alias(name)), key, "left")
    return base.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def with_label(df: DataFrame, code: str, labels: DataFrame, label_code: str, label: str, out: str) -> DataFrame:
    """Label of a code, the code itself when there is none."""
    lookup = labels.select(F.col(label_code).alias(code), F.col(label).alias("_label"))
    return df.join(lookup, code, "left").withColumn(out, F.coalesce("_label", F.col(code).cast("string"))).drop("_label")


def orphans(instruments: DataFrame, mapping: DataFrame, key: str, mapped: str) -> DataFrame:
    """Members of a list that the mapping never mentions."""
    return instruments.join(mapping.select(F.col(mapped).alias(key)), key, "left_anti")


def key_gaps(df: DataFrame, key: str, group: str) -> DataFrame:
    """Whole-number keys missing between the smallest and the largest of each group.

    The range is cut into slices about as wide as there are slices, so no row or task holds all of it.
    """
    present = df.groupBy(group, key).agg(F.lit(1).alias("_"))
    bounds = present.groupBy(group).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    width = F.greatest(F.lit(10_000), F.ceil(F.sqrt(F.col("hi") - F.col("lo"))))
    bounds = bounds.withColumn("w", width.cast("long"))
    slices = bounds.select(group, "lo", "hi", "w", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor(F.col("hi") / F.col("w")))).alias("s"))
    full = slices.repartition(group, "s").select(group, F.explode(F.sequence(
        F.greatest("lo", F.col("s") * F.col("w")), F.least("hi", (F.col("s") + 1) * F.col("w") - 1))).alias(key))
    return full.join(present.select(group, key), [group, key], "left_anti")


def explore(fields: DataFrame, studies: list[str] | None, types: list[str] | None, forms: list[str] | None,
            flags: list[Column], needle: str, searched: list[str], study: str = "project") -> DataFrame:
    """multi-select filters, flag filters and a literal text search without case."""
    tests = []
    for column, wanted in ((study, studies), ("field_type", types), ("form_name", forms)):
        if wanted:
            tests.append(F.col(column).isin(*wanted))
    tests += flags
    if needle.strip():
        tests.append(F.contains(F.lower(F.concat_ws(" ", *searched)), F.lit(needle.strip().lower())))
    return fields.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search_instruments(instruments: DataFrame, needle: str, name: str, label: str) -> DataFrame:
    """text found in the name or the label."""
    n = F.lit(needle.lower())
    return instruments.where(F.contains(F.lower(name), n) | F.contains(F.lower(label), n))
