"""Date, window and calendar expressions (inventory X09, X25-X26, X39-X40, X43, J15, A11)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats tried after ISO for each declared validation.
MDY = ("MM/dd/yyyy", "MM-dd-yyyy")
DMY = ("dd/MM/yyyy", "dd-MM-yyyy")
# Projection window and status limits in days.
WINDOW_BEFORE, WINDOW_AFTER = 30, 60
OVERDUE_AFTER, DUE_SOON_WITHIN = 30, 60
CLOSING_DAYS = 14
AFTER_WINDOW = "AFTER_REPORTING_WINDOW"


def parse_date(c: Column, validation: Column | str = "any") -> Column:
    """ISO first, then the formats the field's validation allows; null when none fits."""
    t = F.trim(c.cast("string"))

    def first(*formats):
        return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-MM-dd", *formats)])

    if isinstance(validation, str):
        return first(*{"date_mdy": MDY, "date_dmy": DMY}.get(validation, MDY + DMY))
    return (F.when(validation == "date_mdy", first(*MDY)).when(validation == "date_dmy", first(*DMY))
            .otherwise(first(*MDY, *DMY)))


def short_year_date(c: Column, fmt: str = "dd-MMM-yy") -> Column:
    """Dates with two-digit years; 69 to 99 belong to the last century."""
    d = F.try_to_date(F.trim(c.cast("string")), fmt)
    return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)


def calendar_features(month: Column, t: Column) -> list[Column]:
    """Trend index, month, quarter and two yearly harmonics."""
    angle = F.month(month) * F.lit(2 * math.pi / 12)
    return [t.cast("long").alias("t"), F.month(month).cast("long").alias("month_no"),
            F.quarter(month).cast("long").alias("quarter_no"),
            F.sin(angle).alias("sin1"), F.cos(angle).alias("cos1"),
            F.sin(angle * 2).alias("sin2"), F.cos(angle * 2).alias("cos2")]


def projection_status(due: Column, today: Column) -> list[Column]:
    """Allowed window around a projected date and where it stands today."""
    days = F.datediff(due, today)
    return [F.date_sub(due, WINDOW_BEFORE).alias("earliest"), F.date_add(due, WINDOW_AFTER).alias("latest"),
            F.when(due.isNull(), "needs_review").when(days < -OVERDUE_AFTER, "overdue")
            .when(days < 0, "recent_past").when(days <= DUE_SOON_WITHIN, "due_soon")
            .otherwise("future").alias("status")]


def window_status(start: Column, end: Column, today: Column, complete: Column) -> Column:
    """Unknown, upcoming, open, closing, overdue or complete."""
    return (F.when(complete, "complete").when(start.isNull() | end.isNull(), "unknown")
            .when(today > end, "overdue").when(today < start, "upcoming")
            .when(F.datediff(end, today) <= CLOSING_DAYS, "closing").otherwise("open"))


def window_days_remaining(start: Column, end: Column, today: Column) -> Column:
    """Days to the opening when upcoming, else days to the end."""
    return F.when(today < start, F.datediff(start, today)).otherwise(F.datediff(end, today))


def urgency(status: Column, days_remaining: Column, window_days: Column) -> Column:
    """Pressure in [0, 1], linear in the share of the window that is gone."""
    linear = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - days_remaining / F.greatest(F.lit(1), window_days)))
    return (F.when(status == "overdue", 1.0)
            .when(status.isin("complete", "unknown", "upcoming") | days_remaining.isNull(), 0.0).otherwise(linear))


def offer_window(drive_minutes: Column, duration_hours: Column, lab_open: float = 8.0,
                 lab_close: float = 17.0) -> list[Column]:
    """Earliest and latest start hour that leave room for the drive and the visit."""
    travel = drive_minutes / 60.0
    first = F.lit(lab_open) + travel
    return [first.alias("earliest_hour"),
            F.greatest(first, F.lit(lab_close) - travel - duration_hours).alias("latest_hour")]


def latest_of(columns: list[Column]) -> Column:
    """Latest readable timestamp of several text columns; unreadable ones are skipped."""
    return F.greatest(*[F.try_to_timestamp(c) for c in columns])


def milestone_dates(start: str, end: str, months: tuple[int, ...] = (4, 8, 12)) -> list[str]:
    """First of each chosen month inside a date range, as ISO text. Config-sized."""
    import datetime as dt

    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    return [d.isoformat() for y in range(a.year, b.year + 1) for m in sorted(months)
            if a <= (d := dt.date(y, m, 1)) <= b]


def milestone_calendar(spark: SparkSession, start: str, end: str, months: tuple[int, ...] = (4, 8, 12)) -> DataFrame:
    """The milestone dates as a table."""
    dates = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return (spark.range(1).select(F.explode(dates).alias("milestone"))
            .where(F.month("milestone").isin(*months) & F.col("milestone").between(start, end)))


def first_milestone(d: Column, milestones: list[str]) -> Column:
    """First milestone on or after a date, else the after-window mark, null for no date."""
    later = F.filter(F.array(*[F.lit(m) for m in sorted(milestones)]), lambda m: m >= F.date_format(d, "yyyy-MM-dd"))
    return F.when(d.isNotNull(), F.coalesce(F.array_min(later), F.lit(AFTER_WINDOW)))
