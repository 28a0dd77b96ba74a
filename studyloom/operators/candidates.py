"""Candidate pools from visit history (inventory J10-J12, X34-X37)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_components() -> dict:
    """Score components of a lineitem row read as one candidate of its order."""
    return {"phi": F.col("l_quantity") / 50.0, "omega": F.col("l_discount") * 10, "psi": 1 - F.col("l_tax") * 10,
            "p": F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)}


def served_pairs(history: DataFrame, visits: DataFrame, visit_key: str, history_key: str, staff: str, family: str) -> DataFrame:
    """Distinct staff and family pairs that have met. Grows with the history, not with its square."""
    return (history.join(visits, F.col(visit_key) == F.col(history_key))
            .groupBy(staff, family).agg(F.count(F.lit(1)).alias("n_prior")))
