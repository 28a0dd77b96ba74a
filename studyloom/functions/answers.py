"""Answer-vector expressions (inventory X17-X20, X23-X24, X29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_to_100(x: Column, low: float, high: float, reverse: bool = False) -> Column:
    """Position on the scale in percent, optionally reverse coded."""
    v = x.cast("double")
    v = F.lit(low + high) - v if reverse else v
    return (v - F.lit(float(low))) / F.lit(float(high - low)) * 100


def let(value: Column, body) -> Column:
    """Evaluate a value once and hand it to ``body``; inside a lambda a plain column would be computed
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answered(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def row_mean(a: Column, minimum: int = 1) -> Column:
    """Mean of the answered items when at least ``minimum`` are there."""
    got = answered(a)
    return F.when(F.size(got) >= minimum, array_sum(got) / F.size(got))


def row_sd(a: Column) -> Column:
    """Sample standard deviation of the answered items."""
    def of(got):
        n = F.size(got)
        spread = let(array_sum(got) / n, lambda m: F.aggregate(got, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
        return F.when(n > 1, F.sqrt(spread / (n - 1)))

    return let(answered(a), of)


def row_abs_deviation(a: Column, centre: Column) -> Column:
    """Mean absolute distance from a centre."""
    def of(got):
        total = let(centre, lambda m: F.aggregate(got, F.lit(0.0), lambda s, v: s + F.abs(v - m)))
        return F.when(F.size(got) > 0, total / F.size(got))

    return let(answered(a), of)


def row_statistics(a: Column) -> list[Column]:
    """Answered, missing, distinct values, mean, sd and mean absolute deviation."""
    got = answered(a)
    mean = row_mean(a)
    return [F.size(got).alias("answered"), (F.size(a) - F.size(got)).alias("missing"),
            F.size(F.array_distinct(got)).alias("distinct_values"), mean.alias("row_mean"),
            row_sd(a).alias("row_sd"), row_abs_deviation(a, mean).alias("row_mad")]


def coefficient_of_variation(a: Column) -> Column:
    """Sd over mean of section times, null when the mean is zero."""
    return F.try_divide(row_sd(a), F.nullif(row_mean(a), F.lit(0.0)))


def longest_run(a: Column) -> Column:
    """Longest run of equal neighbours; a null breaks the run."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("cur"), F.lit(None).cast("string").alias("prev"))

    def step(s, v):
        text = v.cast("string")
        cur = F.when(text.isNull(), 0).when(text == s["prev"], s["cur"] + 1).otherwise(1)
        return F.struct(F.greatest(s["best"], cur).alias("best"), cur.alias("cur"), text.alias("prev"))

    return F.aggregate(a, start, step, lambda s: s["best"])


def key_score(answers: list[Column], key: list) -> Column:
    """Number of answers equal to the key, only when all are answered."""
    right = reduce(lambda a, b: a + b, [F.when(c == F.lit(k), 1).otherwise(0) for c, k in zip(answers, key)])
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in answers])
    return F.when(complete, right)


def graded_score(answer: Column, points: dict[str, float]) -> Column:
    """Points of an answer, null for an unlisted one."""
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return F.try_element_at(table, answer)


def branch_condition(condition: dict) -> Column:
    """One configured condition as a boolean; nulls satisfy the negative forms."""
    c = F.col(condition["field"]).try_cast("double")
    if "equals" in condition:
        return c.eqNullSafe(F.lit(float(condition["equals"])))
    if "not_equals" in condition:
        return ~c.eqNullSafe(F.lit(float(condition["not_equals"])))
    if condition.get("nonzero"):
        return ~c.eqNullSafe(F.lit(0.0))
    if condition.get("present"):
        return c.isNotNull()
    raise ValueError(f"unsupported condition on {condition['field']}")


def export_columns(df: DataFrame, field: str) -> tuple[list[str], bool]:
    """Columns that carry a field, and whether it was exported as checkboxes."""
    if field in df.columns:
        return [field], False
    boxes = sorted(c for c in df.columns if c.startswith(f"{field}___"))
    return boxes, bool(boxes)


def any_answered(df: DataFrame, field: str) -> Column:
    """Anything filled in the field, or any of its boxes ticked."""
    columns, boxes = export_columns(df, field)
    if not columns:
        return F.lit(False)
    if boxes:
        tests = [F.coalesce(F.col(c).try_cast("double") == 1, F.lit(False)) for c in columns]
    else:
        tests = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in columns]
    return reduce(lambda a, b: a | b, tests)


def reasons(parts: list[tuple[Column, str]], sep: str = "; ") -> Column:
    """Names of all triggered tests in their fixed order."""
    return F.concat_ws(sep, *[F.when(test, F.lit(name)) for test, name in parts])
