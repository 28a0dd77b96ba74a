"""Fairness, drift and decision audit over logged candidates (inventory A49-A55, H05-H07, M18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..scale import BLOCK, attach, average_ranks, broadcast_if_small, ordered_blocks, running
from ..session import checkpoint_dir

CRITERIA = ("phi", "omega", "psi", "p")


def inequality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coefficient of variation (population), Gini and largest over mean, per key.

    The Gini sum uses tie-averaged ranks of the distinct values, so equal values are one row.
    """
    v = df.where(F.col(value).isNotNull())
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"), F.max(value).alias("_max"))
    ranks = average_ranks(v.where(F.col(value) >= 0), keys, value)
    s = ranks.groupBy(*keys).agg(F.sum(F.col("avg_rank") * F.col("n") * F.col(value)).alias("_c"), F.sum(F.col("n") * F.col(value)).alias("_t"), F.sum("n").alias("_n"))
    j = attach(g, s, keys)
    gini = F.when(F.col("_t") > 0, 2 * F.col("_c") / (F.col("_n") * F.col("_t")) - (F.col("_n") + 1) / F.col("_n")).otherwise(0.0)
    cv = F.when((F.col("members") >= 2) & (F.col("_mean") != 0), F.col("_sd") / F.col("_mean")).otherwise(0.0)
    return j.select(*keys, "members", cv.alias("cv"), gini.alias("gini"), F.coalesce(F.try_divide("_max", "_mean"), F.lit(0.0)).alias("imbalance"))


def stability_index(df: DataFrame, group: str, baseline, value: str, bins: int = 10) -> DataFrame:
    """Population stability index of each group's scores in [0, 1] against a baseline group."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    inside = F.col(value).between(0, 1)
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(inside & (b == i)).alias(f"b{i}") for i in range(bins)])
    share = F.array(*[F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(1e-4)) for i in range(bins)])
    g = g.select(group, "n", share.alias("share"))
    # an aggregate without keys has one row, so an absent baseline counts as one of no rows
    base = g.where(F.col(group) == F.lit(baseline)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_base"), F.max("share").alias("base"))
    j = attach(g, base, [])
    terms = F.zip_with("share", "base", lambda c, p: (c - p) * F.log(c / p))
    return j.select(group, "n", F.when((F.col("n") < 2) | (F.col("n_base") < 2), 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).alias("psi"))


def drift_colour(value: Column, amber: float, red: float, higher_is_worse: bool = True) -> Column:
    if higher_is_worse:
        return F.when(value >= red, "red").when(value >= amber, "amber").otherwise("green")
    return F.when(value <= red, "red").when(value <= amber, "amber").otherwise("green")


def uniform(*parts) -> Column:
    """Repeatable uniform number in [0, 1) from the hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number of 53 bits, to the last value such a number can tell apart (18)."""
    cdf, pmf, out = 0.0, float(np.exp(-1.0)), F.lit(18)
    steps = []
    for k in range(18):
        cdf += pmf
        steps.append((cdf, k))
        pmf /= k + 1
    for c, k in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix) of unsigned numbers; overflow is meant."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draw_hashes(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """One hash per id (row) and draw (column); ids are hashes already."""
    lots = mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return mixed(ids.astype(np.int64).view(np.uint64)[:, None] ^ lots[None, :])


def poisson_table() -> np.ndarray:
    pmf = np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)])
    return np.cumsum(pmf)


def bootstrap_gini(df: DataFrame, keys: list[str], ident: str, value: str, draws: int = 2_000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """The Gini with a percentile interval over Poisson resamples; fewer than three values give the interval from 0 to 1.

    Every row draws its own weights from a hash, so a rerun after a lost executor gives the same numbers. Rows are ordered once;
    a block adds them up for all draws at a time and leaves three numbers per key and draw, which are joined in block order.
    """
    v = df.where(F.col(value) >= 0).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    names = v.groupBy("_key").agg(*[F.first(k).alias(k) for k in keys])
    rows = v.select("_key", F.col(value).cast("double").alias("_v"), F.xxhash64(F.lit(seed), F.col(ident)).alias("_id"))
    blocks = ordered_blocks(rows, ["_key"], [F.col("_v"), F.col("_id")]).sortWithinPartitions("_key", "_v", "_id")

    def add(parts):
        cdf, key, block = poisson_table(), None, None
        c = t = n = None

        def row():
            return pd.DataFrame({"_key": [key], "_blk": [block], "c": [c], "t": [t], "n": [n]})

        for part in parts:
            for k, g in part.groupby("_key", sort=False):
                if k != key:
                    if key is not None:
                        yield row()
                    key, block = k, int(g[BLOCK].iloc[0])
                    c, t, n = np.zeros(draws), np.zeros(draws), np.zeros(draws)
                for at in range(0, len(g), 256):
                    x, ids = g["_v"].to_numpy()[at:at + 256], g["_id"].to_numpy()[at:at + 256]
                    u = (draw_hashes(ids, draws, seed) >> np.uint64(11)) / float(1 << 53)
                    w = np.searchsorted(cdf, u, side="right").astype(float)
                    upto = n + np.cumsum(w, axis=0)
                    c += ((upto - w + (w + 1) / 2) * w * x[:, None]).sum(0)
                    t += (w * x[:, None]).sum(0)
                    n = upto[-1]
        if key is not None:
            yield row()

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_blk")
        c, t, n = np.zeros(draws), np.zeros(draws), np.zeros(draws)
        for bc, bt, bn in zip(g["c"], g["t"], g["n"]):
            c, t, n = c + bc + n * bt, t + bt, n + bn
        some = n > 0  # a resample without a row is none
        c, t, n = c[some], t[some], n[some]
        a = np.sort(np.where(t > 0, 2 * c / np.where(t > 0, n * t, 1) - (n + 1) / n, 0.0))
        k = len(a)
        low, high = (float(a[int(k * alpha / 2)]), float(a[min(k - 1, int(k * (1 - alpha / 2)))])) if k else (None, None)
        return pd.DataFrame({"_key": [g["_key"].iloc[0]], "low": [low], "high": [high], "draws": [k]})

    sums = blocks.mapInPandas(add, "_key string, _blk int, c array<double>, t array<double>, n array<double>")
    s = sums.groupBy("_key").applyInPandas(join, "_key string, low double, high double, draws long").join(names, "_key").drop("_key")
    point = inequality(df.where(F.col(value) >= 0), keys, value).select(*keys, "gini")
    sizes = df.where(F.col(value) >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = attach(attach(sizes, point, keys), s.select(*keys, "low", "high", "draws"), keys)
    few = F.col("_n") < 3
    return out.select(*keys, "gini", F.when(few, 0.0).otherwise(F.col("low")).alias("low"), F.when(few, 1.0).otherwise(F.col("high")).alias("high"), "draws")


def _count_picks(loads: np.ndarray, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, lots: np.ndarray) -> None:
    """Add 1 to ``loads`` (member, draw) for the candidate with the smallest hash of each run and draw; of equal hashes the first counts.

    ``codes`` and ``ids`` hold the candidates' rows in ``loads`` and hashes, run after run; ``sizes`` the candidates a run has.
    """
    starts = np.cumsum(sizes) - sizes
    # of the loads' own type: with any other, add.at casts number by number
    flat, at, one = loads.reshape(-1), np.arange(len(lots)), loads.dtype.type(1)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]

    def hashes(some: np.ndarray) -> np.ndarray:
        return mixed(ids[some][:, None] ^ lots[None, :])

    wide = int(np.searchsorted(-sizes[order], -64))  # so many runs have more than 64 candidates; these go one by one
    for r in order[:wide]:
        best = who = None
        for lo in range(starts[r], starts[r] + sizes[r], 512):
            x = hashes(np.arange(lo, min(lo + 512, starts[r] + sizes[r])))
            first = x.argmin(0)
            x = x[first, at]
            new = codes[lo + first]
            best, who = (x, new) if best is None else (np.minimum(best, x), np.where(x < best, new, who))
        np.add.at(flat, who * len(lots) + at, one)
    for lo in range(wide, len(order), 256):
        part = order[lo:lo + 256]
        first, n = starts[part], sizes[part]
        best, who = hashes(first), np.repeat(codes[first][:, None], len(lots), 1)
        for place in range(1, int(n[0])):
            k = int(np.searchsorted(-n, -place))  # runs with more candidates than that stand first
            x = hashes(first[:k] + place)
            less = x < best[:k]
            np.copyto(best[:k], x, where=less)
            np.copyto(who[:k], codes[first[:k] + place][:, None], where=less)
        np.add.at(flat, (who * len(lots) + at).reshape(-1), one)


def permutation_cv(candidates: DataFrame, chosen: DataFrame, keys: list[str], run: str, staff: str, iterations: int = 1_000, seed: int = 11,
                   cells: int = 1 << 24, spread: int = 4) -> DataFrame:
    """Share of random feasible assignments whose spread is at least the observed one.

    Each iteration gives a case to the candidate with the smallest hash. Iterations are cut into ``spread`` ranges, or more if members times iterations
    of a range would be over ``cells``. A task streams the cases of a key through the loads of one range, so it holds ``cells`` numbers at most, and what
    is sent are the candidates of each case, once per range, and one row of sums per key and range.
    """
    checkpoint_dir(candidates.sparkSession)
    held = chosen.groupBy(*keys, staff).agg(F.count(F.lit(1)).alias("load")).checkpoint()
    members = candidates.select(*keys, staff).unionByName(held.select(*keys, staff)).groupBy(*keys, staff).agg(F.lit(1).alias("_"))
    n = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).checkpoint()
    most = n.agg(F.max("members")).collect()[0][0] or 1
    ranges = np.array_split(np.arange(1, iterations + 1, dtype=np.uint64), min(iterations, max(spread, -(-most * iterations // cells))))

    def cv(loads, by):
        s = loads.groupBy(*by).agg(F.sum("load").alias("s"), F.sum(F.col("load") * F.col("load")).alias("q"))
        s = attach(s, n, keys)
        mean = F.col("s") / F.col("members")
        return s.withColumn("cv", F.when(F.col("members") >= 2, F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("members") - mean * mean)) / mean).otherwise(0.0))

    observed = cv(held, keys).select(*keys, F.col("cv").alias("observed_cv"), "members")
    code = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    pools = candidates.select(*keys, run, F.col(staff).alias("_s")).groupBy(*keys, run).agg(F.collect_set("_s").alias("_pool")).where(F.size("_pool") > 0)
    copies = pools.select(code.alias("_key"), F.col(run).alias("_run"), "_pool", F.explode(F.array(*[F.lit(i) for i in range(len(ranges))])).alias("_range"))
    # hashes are made after the shuffle, since they don't compress
    dealt = copies.repartition("_key", "_range").sortWithinPartitions(F.xxhash64("_key"), "_key", "_range")
    whole = dict(candidates.dtypes)[staff] in ("bigint", "int", "smallint", "tinyint")
    dealt = dealt.select("_key", "_range", F.transform("_pool", lambda s: s.cast("long" if whole else "string")).alias("_s"),
                         F.transform("_pool", lambda s: F.xxhash64(F.lit(seed), F.col("_run"), s)).alias("_h"))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per key and range: sums of the members' loads and of their squares, per iteration."""
        at, cases, loads, known, lots = None, 0, None, None, None

        def row() -> pa.RecordBatch:
            q = np.zeros(len(lots))
            for lo in range(0, len(known), 4096):
                x = loads[lo:min(lo + 4096, len(known))].astype(float)
                q += (x * x).sum(0)
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([[float(cases)] * len(lots)]), pa.array([q.tolist()])], names=["_key", "s", "q"])

        for batch in batches:
            of = pd.DataFrame({"k": batch.column("_key").to_pandas(), "r": batch.column("_range").to_pandas()})
            cuts = [0, *(np.flatnonzero((of != of.shift()).any(axis=1).to_numpy()[1:]) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if (mine := (of["k"].iloc[lo], int(of["r"].iloc[lo]))) != at:
                    if at is not None:
                        yield row()
                    at, cases, known = mine, 0, pd.Index([])
                    # the finaliser's input of each draw, as in draw_hashes; pages of loads that are not met are never touched
                    lots = mixed(ranges[at[1]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
                    loads = np.zeros((most, len(lots)), np.int32)
                part = batch.slice(lo, hi - lo)
                who, ids = part.column("_s").flatten().to_pandas(), part.column("_h").flatten().to_numpy().view(np.uint64)
                codes = known.get_indexer(who)
                if (codes < 0).any():
                    known = known.append(pd.Index(who[codes < 0].unique())) if len(known) else pd.Index(who.unique())
                    codes = known.get_indexer(who)
                _count_picks(loads, codes, ids, pc.list_value_length(part.column("_s")).to_numpy(), lots)
                cases += hi - lo
        if at is not None:
            yield row()

    sums = dealt.mapInArrow(squares, "_key string, s array<double>, q array<double>").groupBy("_key").agg(
        F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("q")).alias("q"))
    j = attach(observed.withColumn("_key", code).join(sums, "_key"), n.withColumnRenamed("members", "_m"), keys)
    spread_of = F.zip_with("s", "q", lambda s, q: F.when(F.col("_m") >= 2, F.sqrt(F.greatest(F.lit(0.0), q / F.col("_m") - s / F.col("_m") * (s / F.col("_m")))) / (s / F.col("_m"))).otherwise(0.0))
    above = F.size(F.filter(spread_of, lambda v: v >= F.col("observed_cv") - 1e-12))
    return j.select(*keys, "observed_cv", "members", (above / F.lit(float(iterations))).alias("p_value"))


def drift_report(runs: DataFrame, ranked: DataFrame, outcomes: DataFrame, period: str, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """One wide row per period on load, acceptance, ties and cold starts, with colours.

    ``ranked`` holds only feasible candidates with ``rank_position, review_band_flag, is_tied, is_cold_start,
    final_score``; ``outcomes`` holds ``run_id, staff_id, assigned_rank, is_provisional``.
    """
    top = ranked.where("rank_position = 1").select("run_id", "review_band_flag", "is_tied", "final_score")
    r = runs.select("run_id", period).join(top, "run_id", "left").join(outcomes, "run_id", "left")
    cold = ranked.select("run_id", "staff_id", "is_cold_start").groupBy("run_id", "staff_id").agg(F.max("is_cold_start").alias("is_cold_start"))
    r = r.join(cold, ["run_id", "staff_id"], "left")
    decided = F.col("staff_id").isNotNull()

    def share(test):
        return F.coalesce(F.try_divide(F.count_if(decided & test).cast("double"), F.count_if(decided)), F.lit(0.0))

    g = r.groupBy(period).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(decided).alias("assigned"), F.count_if(~decided).alias("unfilled"),
        (F.count_if(F.col("review_band_flag")) / F.count(F.lit(1))).alias("review_band_rate"), (F.count_if(F.col("is_tied")) / F.count(F.lit(1))).alias("tie_rate"),
        share(F.col("assigned_rank") > 1).alias("override_rate"), share(F.col("assigned_rank") == 1).alias("top1_acceptance"),
        share(F.col("assigned_rank") <= cfg.top_k).alias("topk_hit_rate"), share(F.col("is_provisional")).alias("provisional_rate"),
        share(F.coalesce("is_cold_start", F.lit(False))).alias("cold_start_share"), F.avg("final_score").alias("mean_top1"))
    members = ranked.join(runs.select("run_id", period), "run_id").groupBy(period, "staff_id").agg(F.lit(1).alias("_"))
    load = r.where(decided).groupBy(period, "staff_id").agg(F.count(F.lit(1)).alias("visits"))
    per = members.join(load, [period, "staff_id"], "full").withColumn("visits", F.coalesce("visits", F.lit(0)))
    cv = per.groupBy(period).agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.try_divide(F.stddev_pop("visits"), F.avg("visits")), F.lit(0.0)).alias("cv_visits"))
    return g.join(cv, period).withColumn("cv_colour", drift_colour(F.col("cv_visits"), cfg.cv_amber, cfg.cv_red)).withColumn(
        "topk_colour", drift_colour(F.col("topk_hit_rate"), 0.90, 0.75, higher_is_worse=False))


def member_loads(ranked: DataFrame, outcomes: DataFrame, runs: DataFrame, period: str) -> DataFrame:
    """Visits per period and member, members without a visit included."""
    members = ranked.join(runs.select("run_id", period), "run_id").groupBy(period, "staff_id").agg(F.countDistinct("run_id").alias("offered"))
    load = outcomes.join(runs.select("run_id", period), "run_id").groupBy(period, "staff_id").agg(F.count(F.lit(1)).alias("visits"))
    return members.join(load, [period, "staff_id"], "left").withColumn("visits", F.coalesce("visits", F.lit(0)))


def exception_register(runs: DataFrame, ranked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs with any exception and the list of its kinds in fixed order."""
    p = ranked.groupBy("run_id").agg(F.count(F.lit(1)).alias("pool"), F.max("is_tied").alias("tied"),
                                     F.max(F.when(F.col("rank_position") == 1, F.col("review_band_flag"))).alias("band"),
                                     F.max(F.when(F.col("rank_position") == 1, F.col("is_cold_start"))).alias("cold"))
    j = runs.join(p, "run_id", "left").join(outcomes, "run_id", "left")
    pool = F.coalesce("pool", F.lit(0))
    kinds = F.concat_ws(", ", F.when(pool == 0, "pool starvation"), F.when(F.col("band"), "review band"), F.when(F.col("tied"), "tie broken"),
                        F.when(F.col("assigned_rank") > 1, "override"), F.when(F.col("is_provisional"), "provisional"),
                        F.when(F.col("write_time_conflict"), "write-time conflict"), F.when(F.col("cold"), "cold start at rank 1"),
                        F.when(pool <= 1, "single-candidate pool"))
    return j.select("run_id", kinds.alias("kinds"), F.coalesce(F.col("staff_id").cast("string"), F.lit("unassigned")).alias("assigned")).where("kinds <> ''")


def surprise_codes(ranked: DataFrame, outcomes: DataFrame, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """Sorted surprise codes per run."""
    first = F.col("rank_position") == 1
    g = ranked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("final_score"))).alias("best"), F.max(F.when(first, F.col("gap_to_next"))).alias("gap"),
        F.max(F.when(first, F.col("utilisation"))).alias("use"), *[x for c in ("phi", "psi", "omega") for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    j = g.join(outcomes.select("run_id", "assigned_rank"), "run_id", "left")
    inert = [F.when((F.col("n") >= 2) & (F.col(f"lo_{c}") == F.col(f"hi_{c}")) & F.col(f"lo_{c}").isin(0.0, 1.0), F.lit(f"CRITERION_INERT:{c}")) for c in ("phi", "psi", "omega")]
    codes = F.array_compact(F.array(F.when(F.col("assigned_rank") > 1, "HUMAN_OVERRODE_TOP"), F.when(F.col("best") < cfg.weak_best, "WEAK_BEST_OPTION"),
                                    F.when((F.col("n") >= 2) & (F.col("gap") < cfg.review_band), "INSIDE_REVIEW_BAND"),
                                    F.when(F.col("use") > cfg.utilisation_cap, "TOP_PICK_OVER_CAPACITY"), *inert))
    return j.select("run_id", F.array_sort(codes).alias("codes")).where(F.size("codes") > 0)


def unexplained_shifts(now: DataFrame, before: DataFrame, keys: list[str], inputs: list[str], limit: float = 0.15) -> DataFrame:
    """Candidates whose inputs are unchanged but whose score moved by more than the limit."""
    b = before.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*inputs, "final_score"]])
    same = [F.round(F.col(c), 3).eqNullSafe(F.round(F.col(f"_{c}"), 3)) for c in inputs]
    j = now.join(b, keys)
    test = F.abs(F.col("final_score") - F.col("_final_score")) > limit
    for s in same:
        test = test & s
    return j.where(test).select(*keys, (F.col("final_score") - F.col("_final_score")).alias("shift"))


def waterfall(ranked: DataFrame, chosen: DataFrame, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """Contribution differences of the chosen candidate against the suggested one."""
    top = ranked.where("rank_position = 1").select("run_id", *[F.col(c).alias(f"_{c}") for c in CRITERIA])
    mine = ranked.join(chosen.select("run_id", "assigned_rank"), "run_id").where("rank_position = assigned_rank")
    return mine.join(top, "run_id").select("run_id", "staff_id", *[((F.col(c) - F.col(f"_{c}")) * cfg.weights[c]).alias(f"d_{c}") for c in CRITERIA])


def weight_draws(cfg: S.ScoreConfig, samples: int) -> list[list[float]]:
    """Dirichlet weight vectors round the configured weights; a fixed-size table made on the driver."""
    rng = np.random.default_rng(cfg.seed)
    alpha = np.maximum(1e-6, np.array([cfg.weights[c] for c in CRITERIA]) * cfg.concentration)
    return rng.dirichlet(alpha, size=samples).tolist()


def _variants(df: DataFrame, table: list[list[float]]) -> DataFrame:
    """Each candidate once per weight vector, with its score under it."""
    rows = F.array(*[F.struct(F.lit(i).alias("variant"), *[F.lit(v).alias(f"w_{c}") for c, v in zip(CRITERIA, w)]) for i, w in enumerate(table)])
    x = df.withColumn("_w", F.explode(rows))
    return x.select(*df.columns, F.col("_w.variant").alias("variant"), sum((F.col(c) * F.col(f"_w.w_{c}") for c in CRITERIA), F.lit(0.0)).alias("variant_score"))


def _best_of_runs(runs: np.ndarray, parts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by run: where runs start, and per run and draw the best score and its row; the earlier row keeps an equal score.

    Sums run from left to right, as SQL adds, so equal scores are equal in both.
    """
    starts = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(runs)))

    def scores(at: np.ndarray) -> np.ndarray:
        out = parts[at, 0][:, None] * table[:, 0]
        for j in range(1, table.shape[1]):
            out += parts[at, j][:, None] * table[:, j]
        return np.where(np.isnan(out), -np.inf, out)

    best, who = scores(starts), np.repeat(starts[:, None], len(table), 1)
    for place in range(1, int(sizes.max(initial=0))):
        open_ = np.flatnonzero(sizes > place)
        new = scores(starts[open_] + place)
        i, j = np.nonzero(new > best[open_])
        best[open_[i], j] = new[i, j]
        who[open_[i], j] = starts[open_[i]] + place
    return starts, best, who


def selection_stability(scored: DataFrame, samples: int = 2000, cfg: S.ScoreConfig = S.DEFAULT, values: int = 1 << 21) -> DataFrame:
    """Share of weight draws each candidate wins; equal scores go to the smaller id.

    Candidates are range-partitioned by run and id, and each task scores its rows against the whole table of draws as one matrix
    of at most ``values`` numbers at a time, keeping a running best per run and draw. No row is copied per draw. Only the first and last
    run of a partition can go on in a neighbour; for these the task hands over its best scores instead of counts, two short rows a partition,
    so a run that holds most of all candidates is as many tasks as it has partitions. Rows without a run or an id are left out; a missing component loses
    against any score.
    """
    table = np.array(weight_draws(cfg, samples))
    kinds = {c: scored.schema[c].dataType.simpleString() for c in ("run_id", "staff_id")}
    shape = f"run_id {kinds['run_id']}, staff_id {kinds['staff_id']}, wins long, part int, best array<double>, who array<{kinds['staff_id']}>"
    names = ["run_id", "staff_id", "wins", "part", "best", "who"]

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), True, None

        def handed(run, best: np.ndarray, who: np.ndarray, run_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
            columns = [([run], run_type), ([None], id_type), ([None], pa.int64()), ([part], pa.int32()), ([best.tolist()], pa.list_(pa.float64())), ([who.tolist()], pa.list_(id_type))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

        def counted(runs: pa.Array, ids: pa.Array, wins: np.ndarray) -> pa.RecordBatch:
            n, id_type = len(ids), ids.type
            return pa.RecordBatch.from_arrays([runs, ids, pa.array(wins, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(id_type))], names=names)

        step = max(1, values // max(1, len(table)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            run_col, id_col = batch.column("run_id"), batch.column("staff_id")
            kinds = run_col.type, id_col.type
            runs, staff = run_col.to_pandas().to_numpy(), id_col.to_pandas().to_numpy()
            parts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CRITERIA])
            starts, best, who = _best_of_runs(runs, parts, table)
            k, last = 0, len(starts) - 1
            if held is not None and held[0] == runs[0]:
                held = (held[0], np.maximum(held[1], best[0]), np.where(best[0] > held[1], staff[who[0]], held[2]))
                k = 1
            if k > last:
                continue
            if held is not None:
                if first:
                    yield handed(*held, *kinds)
                else:
                    ids, wins = np.unique(held[2], return_counts=True)
                    yield counted(pa.array([held[0]] * len(ids), kinds[0]), pa.array(ids, kinds[1]), wins)
                first = False
            elif k < last:
                yield handed(runs[0], best[0], staff[who[0]], *kinds)
                first, k = False, 1
            wins = np.bincount(who[k:last].ravel(), minlength=len(runs))
            if len(at := np.flatnonzero(wins)):
                yield counted(run_col.take(pa.array(at)), id_col.take(pa.array(at)), wins[at])
            held = (runs[starts[last]], best[last], staff[who[last]])
        if held is not None:
            yield handed(*held, *kinds)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        best, who = np.array(t["best"][0].as_py()), t["who"][0].values.to_pandas().to_numpy()
        for i in range(1, t.num_rows):
            b, w = np.array(t["best"][i].as_py()), t["who"][i].values.to_pandas().to_numpy()
            best, who = np.where(b > best, b, best), np.where(b > best, w, who)
        ids, n = np.unique(who, return_counts=True)
        return pa.table({"run_id": t["run_id"].combine_chunks().take(pa.array([0] * len(ids))), "staff_id": pa.array(ids, t["staff_id"].type), "wins": pa.array(n, pa.int64())})

    # of a member's several rows in a run, the wins are added up
    rows = scored.select("run_id", "staff_id", *[F.col(c).cast("double").alias(c) for c in CRITERIA]).where("run_id is not null and staff_id is not null")
    blocks = rows.repartitionByRange("run_id", "staff_id").sortWithinPartitions("run_id", "staff_id")
    checkpoint_dir(scored.sparkSession)
    found = blocks.mapInArrow(play, shape).checkpoint()
    whole = found.where("wins is not null").groupBy("run_id", "staff_id").agg(F.sum("wins").alias("wins"))
    edges = found.where("wins is null").groupBy("run_id").applyInArrow(merge, f"run_id {kinds['run_id']}, staff_id {kinds['staff_id']}, wins long")
    return whole.unionByName(edges).select("run_id", "staff_id", (F.col("wins") / float(samples)).alias("stability"))


def calibrate_band(ranked: DataFrame, stability: DataFrame, grid: tuple[float, ...] = (0.02, 0.03, 0.04, 0.05, 0.07, 0.10, 0.15, 0.20),
                   cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """Mean flip probability outside each band width and the smallest width that is tolerable."""
    d = ranked.where("rank_position = 1 and gap_to_next is not null").join(stability, ["run_id", "staff_id"], "left")
    flip = 1 - F.coalesce("stability", F.lit(0.0))
    one = d.agg(*[x for i, e in enumerate(grid) for x in (F.count_if(F.col("gap_to_next") >= e).alias(f"n{i}"), F.avg(F.when(F.col("gap_to_next") >= e, flip)).alias(f"f{i}"))])
    rows = F.array(*[F.struct(F.lit(e).alias("epsilon"), F.col(f"n{i}").alias("outside"), F.col(f"f{i}").alias("mean_flip")) for i, e in enumerate(grid)])
    chosen = F.coalesce(F.array_min(F.array_compact(F.array(*[F.when(F.col(f"f{i}") <= cfg.reversal_tolerance, F.lit(e)) for i, e in enumerate(grid)]))), F.lit(max(grid)))
    return one.select(chosen.alias("chosen"), rows.alias("r")).select("chosen", F.inline("r"))


def perturbed(weights: dict[str, float], criterion: str, delta: float) -> list[float]:
    """One weight moved by delta within [0, 1], the others rescaled to keep the sum."""
    new = min(1.0, max(0.0, weights[criterion] + delta))
    rest = 1.0 - weights[criterion]
    return [new if c == criterion else weights[c] * ((1.0 - new) / rest if rest > 0 else 0.0) for c in CRITERIA]


def _overtaken(v: np.ndarray, starts: np.ndarray, cand: pa.Array) -> np.ndarray:
    """Per row and column of ``v``, how many later rows of its run pass it: those with a larger value, or an equal one and a smaller ``cand``."""
    after = np.repeat(np.append(starts[1:], len(v)), np.diff(np.append(starts, len(v)))) - 1 - np.arange(len(v))
    out = np.zeros(v.shape, np.int64)
    for d in range(1, int(after.max(initial=0)) + 1):
        i = np.flatnonzero(after >= d)
        mine, other = v[i], v[i + d]
        passes, level = other > mine, other == mine
        if len(t := np.flatnonzero(level.any(axis=1))):
            a, b = cand.take(pa.array(i[t])).to_pylist(), cand.take(pa.array(i[t] + d)).to_pylist()
            lower = np.array([y is None and x is not None or x is not None and y is not None and y < x for x, y in zip(a, b)])
            passes[t] |= level[t] & lower[:, None]
        out[i] += passes
    return out


def _order_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole runs in base order, one column per variant: per variant and pool size the runs, swapped pairs and runs with a new first."""
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    held: pa.Table | None = None
    width = 0

    def add(t: pa.Table, starts: np.ndarray) -> None:
        columns = [t.column(i).combine_chunks() for i in range(2, t.num_columns)]
        v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        gone = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        # as Spark sorts down: not a number first, null last
        v = np.where(gone, -np.inf, np.where(np.isnan(v), np.inf, v))
        passed = _overtaken(v, starts, t.column("cand").combine_chunks())
        swapped, flips, sizes = np.add.reduceat(passed, starts), passed[starts] > 0, np.diff(np.append(starts, len(v)))
        for n in np.unique(sizes[sizes > 1]).tolist():
            k, s, f = found.get(n, (0, 0, 0))
            found[n] = (k + int((sizes == n).sum()), s + swapped[sizes == n].sum(0), f + flips[sizes == n].sum(0))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        held, width = t, t.num_columns - 2
        run = t.column("run_id").combine_chunks()
        starts = np.append(0, np.flatnonzero(pc.not_equal(run[1:], run[:-1]).to_numpy(zero_copy_only=False)) + 1)
        if len(starts) > 1:
            add(t.slice(0, int(starts[-1])), starts[:-1])
            held = t.slice(int(starts[-1]))  # may go on in the next batch
    if held is not None and held.num_rows:
        add(held, np.zeros(1, np.int64))
    rows = [(i, n, k, int(s[i]), int(f[i])) for n, (k, s, f) in found.items() for i in range(width)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))], names=["variant", "_n", "runs", "swapped", "flips"])


def weight_sensitivity(scored: DataFrame, delta: float = 0.05, cfg: S.ScoreConfig = S.DEFAULT, pool: int = 256) -> DataFrame:
    """Reversal rate and mean Kendall tau for every weight moved up and down.

    Runs of up to ``pool`` candidates are sorted once, and their swapped pairs are counted for all variants at a time where they lie. In larger runs order
    changes are counted bit by bit: two candidates that swap differ first at one bit of their new rank, so running counts per bit and prefix give
    the number of swapped pairs without forming pairs.
    """
    checkpoint_dir(scored.sparkSession)
    names = [(c, d) for c in CRITERIA for d in (delta, -delta)]
    table = [perturbed(cfg.weights, c, d) for c, d in names]
    base = scored.where("run_id is not null").select("run_id", "cand", *CRITERIA)
    score = F.round(S.weighted_total({c: F.col(c) for c in CRITERIA}, cfg), 9)
    large = base.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > pool).checkpoint()
    largest = large.agg(F.max("_n")).collect()[0][0]
    small = base if largest is None else base.join(broadcast_if_small(large.select("run_id")), "run_id", "left_anti")
    # scores are made after the shuffle
    dealt = small.repartition("run_id").withColumn("_s", score).sortWithinPartitions("run_id", F.desc("_s"), "cand")
    moved = [F.round(sum((F.col(c) * F.lit(w) for c, w in zip(CRITERIA, weights)), F.lit(0.0)), 9).alias(f"v{i}") for i, weights in enumerate(table)]
    found = dealt.select("run_id", "cand", *moved).mapInArrow(_order_changes, "variant int, _n long, runs long, swapped long, flips long")
    if largest is not None:
        found = found.unionByName(_large_order_changes(base.join(broadcast_if_small(large), "run_id").withColumn("_s", score), table, largest))
    tau = 1 - 4.0 * F.sum(F.col("swapped") / (F.col("_n") * (F.col("_n") - 1))) / F.sum("runs")
    g = found.groupBy("variant").agg((F.sum("flips") / F.sum("runs")).alias("reversal_rate"), tau.alias("mean_tau"), F.sum("runs").alias("runs"))
    word = F.element_at(F.array(*[F.lit(c) for c, _ in names]), F.col("variant") + 1)
    step = F.element_at(F.array(*[F.lit(d) for _, d in names]), F.col("variant") + 1)
    return g.select(word.alias("criterion"), step.alias("delta"), "reversal_rate", "mean_tau", "runs")


def _large_order_changes(base: DataFrame, table: list[list[float]], largest: int) -> DataFrame:
    """The rows of :func:`_order_changes` for runs that no task should hold."""
    cols = ["run_id", "cand", *CRITERIA]
    order = [F.desc("_s"), F.col("cand")]
    b = running(ordered_blocks(base.select(*cols, "_s", "_n"), ["run_id"], order), ["run_id"], order, base_rank=("rows",)).drop("_blk")
    v = _variants(b.select(*cols, "base_rank", "_n"), table).withColumn("variant_score", F.round("variant_score", 9))
    vk, vo = ["run_id", "variant"], [F.desc("variant_score"), F.col("cand")]
    v = running(ordered_blocks(v.select(*vk, "cand", "variant_score", "base_rank", "_n"), vk, vo), vk, vo, new_rank=("rows",)).drop("_blk")
    bits = max(1, int(largest - 1).bit_length())
    lv = v.select(*vk, "base_rank", "new_rank", "_n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level"))
    lv = lv.withColumns({"prefix": F.expr("shiftright(new_rank - 1, level + 1)"), "bit": F.expr("cast(shiftright(new_rank - 1, level) & 1 as long)")})
    lk = [*vk, "level", "prefix"]
    c = running(ordered_blocks(lv, lk, [F.col("base_rank")]), lk, [F.col("base_rank")], ones=("sum", F.col("bit")))
    swaps = c.groupBy(*vk).agg(F.sum(F.when(F.col("bit") == 0, F.col("ones")).otherwise(0)).alias("swapped"), F.max("_n").alias("_n"),
                               F.max(F.when((F.col("base_rank") == 1) & (F.col("new_rank") != 1), 1).otherwise(0)).alias("flip"))
    return swaps.groupBy("variant", "_n").agg(F.count(F.lit(1)).alias("runs"), F.sum("swapped").alias("swapped"), F.sum("flip").alias("flips"))


def flip_distance(scored: DataFrame, limit: float = 0.5, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """Smallest weight change that would put another candidate on top, per run and criterion.

    Scores are straight lines in the change, so the crossing with each rival is solved directly; each
    rival meets only its run's leader.
    """
    s = scored.withColumn("_s", S.weighted_total({c: F.col(c) for c in CRITERIA}, cfg))
    lead = s.groupBy("run_id").agg(F.max_by(F.struct("cand", "_s", *CRITERIA), F.struct(F.round("_s", 9), -F.col("staff_id"), F.col("cand"))).alias("l"))
    j = s.join(lead, "run_id").where(F.col("cand") != F.col("l.cand"))
    out = []
    for c in CRITERIA:
        w = cfg.weights[c]

        def slope(get):
            rest = sum((get(o) * cfg.weights[o] for o in CRITERIA if o != c), F.lit(0.0))
            return get(c) - rest / (1 - w)

        d1 = slope(lambda o: F.col(f"l.{o}")) - slope(lambda o: F.col(o))
        d0 = F.col("l._s") - F.col("_s")
        x = F.try_divide(-d0, F.when(F.abs(d1) > 1e-12, d1))
        tiny = 1e-9
        ok = (F.abs(x) <= limit + tiny) & (x + w >= -tiny) & (x + w <= 1 + tiny)
        out.append(F.struct(F.lit(c).alias("criterion"), F.when(ok, F.abs(x)).alias("distance")))
    return j.select("run_id", F.inline(F.array(*out))).where(F.col("distance").isNotNull()).groupBy("run_id", "criterion").agg(F.min("distance").alias("flip_distance"))


def choice_model(scored: DataFrame, chosen: str, steps: int = 12, ridge: float = 1e-6) -> tuple[dict[str, float], dict[str, float], float]:
    """Weights people act on, from which candidate of each logged pool they took.

    Newton steps on the conditional choice likelihood. A step aggregates exponentials per run and adds
    the runs up, so only a 4 by 4 matrix reaches the driver. Returns (beta, weights, log likelihood).
    """
    data = scored.select("run_id", *CRITERIA, F.col(chosen).cast("int").alias("_y")).persist()
    try:
        beta, k, ll = np.zeros(len(CRITERIA)), len(CRITERIA), 0.0
        for _ in range(steps):
            u = sum((F.col(c) * float(b) for c, b in zip(CRITERIA, beta)), F.lit(0.0))
            e = F.exp(u)
            per = data.groupBy("run_id").agg(
                F.sum(e).alias("z"), F.sum("_y").alias("y"), F.sum(F.when(F.col("_y") == 1, u)).alias("uy"), F.count(F.lit(1)).alias("n"),
                *[F.sum(e * F.col(c)).alias(f"e_{c}") for c in CRITERIA], *[F.sum(F.col("_y") * F.col(c)).alias(f"y_{c}") for c in CRITERIA],
                *[F.sum(e * F.col(a) * F.col(b)).alias(f"h_{a}_{b}") for i, a in enumerate(CRITERIA) for b in CRITERIA[i:]]).where("n >= 2 and y = 1")
            m = {c: F.col(f"e_{c}") / F.col("z") for c in CRITERIA}
            row = per.agg(F.sum(F.col("uy") - F.log("z")).alias("ll"), *[F.sum(F.col(f"y_{c}") - m[c]).alias(f"g_{c}") for c in CRITERIA],
                          *[F.sum(F.col(f"h_{a}_{b}") / F.col("z") - m[a] * m[b]).alias(f"H_{a}_{b}") for i, a in enumerate(CRITERIA) for b in CRITERIA[i:]]).collect()[0]
            g = np.array([row[f"g_{c}"] or 0.0 for c in CRITERIA])
            h = np.zeros((k, k))
            for i, a in enumerate(CRITERIA):
                for jx in range(i, k):
                    h[i, jx] = h[jx, i] = row[f"H_{a}_{CRITERIA[jx]}"] or 0.0
            ll = float(row["ll"] or 0.0)
            move = np.linalg.solve(h + ridge * np.eye(k), g)
            beta = beta + np.clip(move, -2.0, 2.0)
            if np.max(np.abs(move)) < 1e-8:
                break
        shifted = beta - min(0.0, float(beta.min()))
        total = float(shifted.sum()) or 1.0
        return dict(zip(CRITERIA, beta.tolist())), dict(zip(CRITERIA, (shifted / total).tolist())), ll
    finally:
        data.unpersist()


