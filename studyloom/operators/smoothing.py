"""Level and additive season with estimated constants and initial state (inventory M17).

In error form a month's error e moves the level by alpha * e and its calendar month's season by gamma * e, with 0 <= alpha, gamma and alpha + gamma <= 1. For given
constants all errors are linear in the initial level and seasons, so the best initial state is a small least-squares problem; only the two constants
are searched, on a grid and then on ever finer ones around the best point. Every step runs for a block of series at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series side by side in one block.
BLOCK = 256


def errors(y: np.ndarray, there: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors [series, month, column], last levels [series, column] and last seasons [series, column, place].

    Column 0 starts from nothing and sees the series; the others see zeros and start from a unit level or a unit season. ``season`` 0 is a level alone.
    """
    g, t = y.shape
    columns = 2 + season
    level, seas, out = np.zeros((g, columns)), np.zeros((g, columns, max(1, season))), np.zeros((g, t, columns))
    level[:, 1] = 1
    for j in range(season):
        seas[:, 2 + j, j] = 1
    for i in range(t):
        e = -level - seas[:, :, i % season] if season else -level
        e[:, 0] += y[:, i]
        e *= there[:, i, None]
        out[:, i] = e
        level += alpha[:, None] * e
        if season:
            seas[:, :, i % season] += gamma[:, None] * e
    return out, level, seas


def best_state(y: np.ndarray, there: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squared errors of the best initial state, and the level and seasons it ends with.

    A constant may move between level and seasons without changing any error; the initial seasons add up to nothing.
    """
    e, level, seas = errors(y, there, alpha, gamma, season)
    a, b = e[:, :, 1:], e[:, :, 0]
    normal = np.einsum("gti,gtj->gij", a, a)
    if season:
        normal[:, 1:, 1:] += 1.0
    normal += 1e-10 * (np.trace(normal, axis1=1, axis2=2) + 1e-30)[:, None, None] * np.eye(normal.shape[1])
    x = -np.linalg.solve(normal, np.einsum("gti,gt->gi", a, b)[:, :, None])
    rest = b + (a @ x)[:, :, 0]
    whole = np.concatenate([np.ones((len(x), 1, 1)), x], 1)
    return (rest ** 2).sum(1), (level[:, None] @ whole)[:, 0, 0], np.einsum("gcs,gc->gs", seas, whole[:, :, 0])


def estimate(y: np.ndarray, there: np.ndarray, season: int, known: tuple[tuple[float, float], ...] = ((0.3, 0.14),), coarse: float = 0.1, fine: int = 10) -> dict[str, np.ndarray]:
    """alpha, gamma, sse, level and seasons of each series; ``known`` points are always tried. Equal errors keep the smaller constants."""
    g = len(y)
    nothing = 1e-12 * ((y * there) ** 2).sum(1)  # rounding of a perfect fit
    steps = np.round(np.arange(0, 1 + coarse / 2, coarse), 9)
    grid = [(a, c) for a in steps for c in (steps if season else [0.0]) if a + c <= 1 + 1e-9] + [(a, c if season else 0.0) for a, c in known]
    best = {"sse": np.full(g, np.inf), "alpha": np.zeros(g), "gamma": np.zeros(g), "level": np.zeros(g), "seasons": np.zeros((g, max(1, season)))}

    def attempt(alpha: np.ndarray, gamma: np.ndarray) -> None:
        alpha = np.clip(alpha, 0, 1)
        gamma = np.clip(gamma, 0, 1 - alpha)
        sse, level, seas = best_state(y, there, alpha, gamma, season)
        better = sse < best["sse"] * (1 - 1e-12) - nothing
        for name, new in (("sse", sse), ("alpha", alpha), ("gamma", gamma), ("level", level), ("seasons", seas)):
            best[name][better] = new[better]

    for a, c in grid:
        attempt(np.full(g, a), np.full(g, c))
    step = coarse / 2
    around = [(i, j) for i in (-1, 0, 1) for j in ((-1, 0, 1) if season else (0,)) if i or j]
    for _ in range(fine):
        a, c = best["alpha"].copy(), best["gamma"].copy()
        for i, j in around:
            attempt(a + i * step, c + j * step)
        step /= 2
    return best


def smoothing_fit(train: DataFrame, keys: list[str], season: int = 12) -> DataFrame:
    """One row per series: keys, first month, months, alpha, gamma, sse, level and seasons after the last month, counted from the first month on.

    Series of fewer than two whole seasons have a level alone. Months must follow each other without gaps; a missing count is left out of the errors.
    """
    s = train.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month", F.col("n").cast("double").alias("n")))).alias("a"), F.min("month").alias("first"), F.count(F.lit(1)).cast("int").alias("months"))
    rows = s.select(*keys, "first", "months", F.transform("a", lambda x: x["n"]).alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("months", kind="stable")  # blocks of like length
            for wide in (0, season):
                some = frame[(frame["months"] >= 2 * season) == bool(wide)]
                for i in range(0, len(some), BLOCK):
                    part = some.iloc[i:i + BLOCK]
                    y = np.full((len(part), int(part["months"].max())), np.nan)
                    for k, v in enumerate(part["y"]):
                        y[k, :len(v)] = np.asarray(v, float)
                    there = np.isfinite(y).astype(float)
                    found = estimate(np.nan_to_num(y, posinf=0, neginf=0) * there, there, wide)
                    yield part.drop(columns="y").assign(**{c: found[c] for c in ("alpha", "gamma", "sse", "level")}, seasons=list(found["seasons"]))

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("y").schema.fields)
    return rows.mapInPandas(run, f"{named}, alpha double, gamma double, sse double, level double, seasons array<double>")


def smoothed_forecast(train: DataFrame, future: DataFrame, keys: list[str], season: int = 12) -> DataFrame:
    """Level plus the calendar month's season at the end of each series, not below zero."""
    j = future.join(smoothing_fit(train, keys, season), keys)
    place = F.pmod(F.months_between("month", "first").cast("int"), F.size("seasons")) + 1
    return j.withColumn("yhat", F.greatest(F.lit(0.0), F.col("level") + F.element_at("seasons", place))).drop("first", "months", "alpha", "gamma", "sse", "level", "seasons")
