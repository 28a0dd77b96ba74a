"""Scoring expressions for staff and visit candidates (inventory X34-X39, A55, A57)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreConfig:
    """Weights, decay constants, limits and freshness bounds."""

    weights: dict = field(default_factory=lambda: {"phi": 0.45, "omega": 0.15, "psi": 0.30, "p": 0.10})
    kappa: float = 2.0
    tau_days: float = 75.0
    gamma_travel: float = 2.0
    pref_named: float = 1.0
    pref_neutral: float = 0.5
    pref_other_named: float = 0.35
    pref_soft_avoid: float = 0.0
    attribute_bonus: float = 0.25
    n_min_visits: int = 20
    ramp_n0: float = 1.0
    onboarding_max_week: int = 2
    top_k: int = 3
    review_band: float = 0.05
    weak_best: float = 0.20
    reversal_tolerance: float = 0.10
    concentration: float = 60.0
    halt_fraction: float = 0.20
    utilisation_cap: float = 1.0
    travel_share_cap: float = 1.4
    travel_min_trips: int = 8
    travel_min_people: int = 3
    regret_threshold: float = 0.03
    cv_amber: float = 0.25
    cv_red: float = 0.40
    psi_investigate: float = 0.10
    psi_act: float = 0.25
    # (horizon in hours, fresh within seconds, stale within seconds)
    freshness: tuple = ((72, 900, 3600), (336, 14400, 86400), (None, 86400, 259200))
    seed: int = 20260817


DEFAULT = ScoreConfig()


def familiarity(k: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return F.when(k > 0, 1.0 - F.exp(-k / F.lit(cfg.kappa))).otherwise(0.0)


def contact_freshness(days: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    # greatest skips nulls, so a pair that never met is tested first
    return F.when(days.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), days.cast("double")) / F.lit(cfg.tau_days)))


def continuity(k: Column, days: Column, sigma: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Shared history times recency, turned round for families who want a new face."""
    raw = familiarity(k, cfg) * contact_freshness(days, cfg)
    return F.when(sigma >= 0, raw).otherwise(1.0 - raw)


def preference(staff: Column, preferred: Column, soft_avoid: Column, required: Column, attributes: Column,
               cfg: ScoreConfig = DEFAULT) -> Column:
    """Named, avoided, other named or neutral, plus the attribute share, clipped to [0, 1]."""
    base = (F.when(F.array_contains(preferred, staff), cfg.pref_named)
            .when(F.array_contains(soft_avoid, staff), cfg.pref_soft_avoid)
            .when(F.size(preferred) > 0, cfg.pref_other_named).otherwise(cfg.pref_neutral))
    share = F.size(F.array_intersect(required, attributes)) / F.size(required)
    bonus = F.when(F.size(required) > 0, (share - 0.5) * (2.0 * cfg.attribute_bonus)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + bonus))


def ramped_capacity(capacity: Column, completed: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Capacity grows over the first visits of a new member."""
    ramp = F.least(F.lit(1.0), (F.greatest(F.lit(0), completed) + cfg.ramp_n0) / (cfg.n_min_visits + cfg.ramp_n0))
    return F.when(capacity <= 0, 1e-6).otherwise(F.greatest(F.lit(1e-6), capacity * ramp))


def burden(committed: Column, duration: Column, travel_minutes: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Hours held after taking the visit, with travel weighted."""
    return committed + duration + travel_minutes * cfg.gamma_travel / 60.0


def burden_relief(load: Column, capacity: Column) -> Column:
    """Free share of the capacity, clipped to [0, 1]."""
    used = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(load, capacity)))
    return F.when(capacity <= 0, 0.0).otherwise(1.0 - used)


def contributions(components: dict[str, Column], cfg: ScoreConfig = DEFAULT) -> dict[str, Column]:
    """Weight times component for each criterion."""
    return {name: components[name] * cfg.weights[name] for name in cfg.weights}


def weighted_total(components: dict[str, Column], cfg: ScoreConfig = DEFAULT) -> Column:
    """Sum of the contributions clipped to [0, 1]."""
    total = sum(contributions(components, cfg).values(), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def freshness_class(age_seconds: Column, horizon_hours: Column, sync_ok: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Fresh, stale, expired or sync_failed; no snapshot counts as expired."""
    label = None
    for horizon, hard, soft in reversed(cfg.freshness):
        here = F.when(age_seconds <= hard, "fresh").when(age_seconds <= soft, "stale").otherwise("expired")
        label = here if horizon is None else F.when(horizon_hours <= horizon, here).otherwise(label)
    return F.when(age_seconds.isNull(), "expired").when(~sync_ok, "sync_failed").otherwise(label)


def load_band(items: Column, truncated: Column | None = None, busy: int = 3, light: int = 1) -> Column:
    """Busy, light or open; unknown when the day cell was cut off."""
    band = F.when(items >= busy, "busy").when(items >= light, "light").otherwise("open")
    return band if truncated is None else F.when(truncated, "unknown").otherwise(band)
