"""Eligibility, candidates, ranking and pairing (inventory F04-F06, J10-J11, J21, W01-W03, W11, A56-A57, A73)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..scale import attach, ordered_blocks, running


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """name of the first gate that fails, null when all hold. Later gates are not filtered away."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates])


def eligibility(candidates: DataFrame, gates: list[tuple[str, Column]], calendar_gates: tuple[str, ...]) -> DataFrame:
    """pass flag, first reason, and a rescue mark for calendar-only failures in a pool with nobody left."""
    df = candidates.withColumn("fail_reason", first_failure(gates)).withColumn("passed", F.col("fail_reason").isNull())
    pool = df.groupBy("run_id").agg(F.count_if("passed").alias("n_passed"))
    return df.join(pool, "run_id").withColumn("rescued", (F.col("n_passed") == 0) & F.coalesce(F.col("fail_reason").isin(*calendar_gates), F.lit(False)))


def partner_available(candidates: DataFrame, pool: list[str], signed_off: str) -> DataFrame:
    """whether somebody else in the pool is signed off; one count per pool, no pairs."""
    n = candidates.groupBy(*pool).agg(F.count_if(F.col(signed_off)).alias("_n"))
    me = F.col(signed_off).cast("int")
    return candidates.join(n, pool).withColumn("has_partner", F.col("_n") - me > 0).drop("_n")


def route(visits: DataFrame, checkpoint: str, at: Column, ideal: Column, windows: DataFrame, needs_special: Column, special_exists: Column) -> DataFrame:
    """manual, remote, escalate or score, decided before any candidate is looked at.

    ``windows`` is the configured (checkpoint, window_before, window_after).
    """
    j = visits.join(windows, checkpoint, "left")
    outside = ~at.between(F.date_sub(ideal, F.col("window_before")), F.date_add(ideal, F.col("window_after")))
    route_ = (F.when(F.col(checkpoint) == "36mo", "manual").when(F.col(checkpoint) == "24mo", "remote")
              .when(F.coalesce(outside, F.lit(False)), "escalate_window").when(needs_special & ~special_exists, "escalate_special").otherwise("score"))
    return j.withColumn("route", route_).drop("window_before", "window_after")


def candidate_pool(visits: DataFrame, members: DataFrame, history: DataFrame, load: DataFrame) -> DataFrame:
    """Each open visit with the members of its pool, their shared history and present load.

    Membership is an equi join on ``run_id``; history joins on (staff_id, family_id), load on staff_id.
    """
    j = visits.join(members, "run_id").join(history, ["staff_id", "family_id"], "left").join(load, "staff_id", "left")
    return j.na.fill(0, ["n_prior"]).na.fill(0.0, ["committed_hours"])


def rank_candidates(df: DataFrame, run: str, score: str, staff: str, unique: list[str], top_k: int = 3, band: float = 0.05) -> DataFrame:
    """Position, gap to the next, shortlist flag, and a review flag on the top two when they are close."""
    order = [F.col(score).desc(), F.col(staff), *[F.col(u) for u in unique]]
    b = running(ordered_blocks(df, [run], order), [run], order, rank_position=("rows",), _next=("lead", F.col(score)), _prev=("lag", F.col(score)))
    # gaps are rounded to nine digits, so noise of the subtraction does not decide who is inside the band
    down, up = F.round(F.col(score) - F.col("_next"), 9), F.round(F.col("_prev") - F.col(score), 9)
    close = ((F.col("rank_position") == 1) & (down < band)) | ((F.col("rank_position") == 2) & (up < band))
    return b.select(*[c for c in b.columns if c not in ("_next", "_prev", "_blk")], down.alias("gap_to_next"),
                    (F.col("rank_position") <= top_k).alias("in_shortlist"), F.coalesce(close, F.lit(False)).alias("review_band_flag"))


def break_ties(df: DataFrame, run: str, score: str, staff: str, protocol: str, prior: str, sigma: str, seed: int, tolerance: float = 1e-9) -> DataFrame:
    """Winner and rule among exact ties on top: protocol continuity, family history, then a seeded hash.

    Ties are counted level by level with aggregates, so a hot run is never one window. The hash takes the
    place of a random generator: the same seed gives the same winner on any cluster.
    """
    top = df.groupBy(run).agg(F.max(score).alias("_top"))
    tied = df.join(top, run).where(F.abs(F.col(score) - F.col("_top")) <= tolerance)
    sk = F.when(F.col(sigma) >= 0, F.col(prior)).otherwise(-F.col(prior))
    pick = F.xxhash64(F.lit(seed), F.col(run), F.col(staff))
    a = tied.groupBy(run, F.col(protocol).alias("_p"), sk.alias("_k")).agg(F.count(F.lit(1)).alias("_c"), F.min_by(staff, F.struct(pick, F.col(staff))).alias("_w"))
    b = a.groupBy(run, "_p").agg(F.sum("_c").alias("_cp"), F.max_by(F.struct("_c", "_w"), "_k").alias("_best"))
    c = b.groupBy(run).agg(F.sum("_cp").alias("n_tied"), F.max_by(F.struct("_cp", "_best"), "_p").alias("_t"))
    rule = (F.when(F.col("n_tied") < 2, "none").when(F.col("_t._cp") == 1, "protocol_continuity")
            .when(F.col("_t._best._c") == 1, "family_history").otherwise("random"))
    return c.select(run, "n_tied", F.col("_t._best._w").alias("winner"), rule.alias("tie_rule"))


def next_checkpoint(families: DataFrame, done: DataFrame, family: str, anchor: str, checkpoints: list[tuple[str, int, int, int]], today: str) -> DataFrame:
    """First checkpoint not yet completed, its window, status, urgency and place in the work order.

    ``checkpoints`` is the configured list (name, offset, days before, days after); a family's finished
    names form a set no longer than that list. Missed visits must not be in ``done``.
    """
    names = F.array(*[F.lit(c[0]) for c in checkpoints])
    table = F.create_map(*[x for n, o, b, a in checkpoints for x in (F.lit(n), F.struct(F.lit(o).alias("o"), F.lit(b).alias("b"), F.lit(a).alias("a")))])
    got = done.groupBy(family).agg(F.collect_set("checkpoint").alias("_done"))
    j = families.join(got, family, "left").withColumn("_left", F.array_except(names, F.coalesce("_done", F.array().cast("array<string>"))))
    nxt = F.get("_left", 0)
    c = F.try_element_at(table, nxt)
    target = F.date_add(anchor, c["o"])
    start, end, now = F.date_sub(target, c["b"]), F.date_add(target, c["a"]), F.lit(today).cast("date")
    j = j.withColumns({"checkpoint": nxt, "window_start": start, "window_end": end})
    st = D.window_status(F.col("window_start"), F.col("window_end"), now, F.size("_left") == 0)
    days = D.window_days_remaining(F.col("window_start"), F.col("window_end"), now)
    tier = F.when(st == "overdue", 0).when(st == "closing", 1).when(st == "open", 2).when(st == "upcoming", 3).when(st == "unknown", 4).otherwise(5)
    return j.select(family, "checkpoint", (F.lit(len(checkpoints)) - F.size("_left")).alias("completed"), "window_start", "window_end", st.alias("status"),
                    days.alias("days_remaining"), D.urgency(st, days, F.greatest(F.lit(1), c["b"] + c["a"])).alias("urgency"), tier.alias("tier"))


def history_features(history: DataFrame, pair: list[str], at: str, checkpoint: str, previous: str, now: str) -> DataFrame:
    """Earlier visits, days since contact, previous checkpoint done and visits this week, as of ``now``."""
    today = F.lit(now).cast("date")
    past = F.col(at) <= today
    return history.groupBy(*pair).agg(
        F.count_if(past).alias("n_prior"), F.datediff(today, F.max(F.when(past, F.col(at)))).alias("days_since"),
        F.coalesce(F.max(past & (F.col(checkpoint) == previous)), F.lit(False)).alias("did_previous"),
        F.count_if(F.col(at).between(F.date_sub(today, 6), today)).alias("this_week"))


def fairness_veto(candidates: DataFrame, trips: DataFrame, capacity: DataFrame, now: str, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """Over capacity, or a long drive for somebody above their share of the driving.

    Totals over 28 days form one row per staff member and one row in all; nothing is paired up.
    """
    recent = trips.where((F.col("travel_minutes") > 0) & F.datediff(F.lit(now).cast("date"), F.col("at")).between(0, 28))
    mine = recent.groupBy("staff_id").agg(F.sum("travel_minutes").alias("mine"), F.count(F.lit(1)).alias("trips"))
    team = mine.agg(F.sum("mine").alias("team"), F.sum("trips").alias("n_trips"), F.count(F.lit(1)).alias("drivers"))
    all_cap = capacity.agg(F.sum("capacity_hours").alias("team_capacity"))
    j = candidates.join(capacity, "staff_id").join(mine.select("staff_id", "mine"), "staff_id", "left")
    j = attach(attach(j, team, []), all_cap, [])
    enough = (F.col("n_trips") >= cfg.travel_min_trips) & (F.col("drivers") >= cfg.travel_min_people)
    share = (F.coalesce("mine", F.lit(0.0)) + F.col("trip_minutes")) / (F.col("team") + F.col("trip_minutes"))
    over = share > cfg.travel_share_cap * F.col("capacity_hours") / F.col("team_capacity")
    long_drive = F.col("trip_minutes") > F.col("team") / F.col("n_trips")
    cap = F.coalesce(enough & over & long_drive & (F.col("capacity_hours") > 0), F.lit(False))
    return j.select("candidate_id", "staff_id", F.concat_ws(",", F.when(F.col("utilisation") > cfg.utilisation_cap, "over_capacity"), F.when(cap, "travel_share_cap")).alias("violations"))


def systemic_failure(states: DataFrame, keys: list[str], limit: float = S.DEFAULT.halt_fraction) -> DataFrame:
    """Halt reason when too large a share of the sources cannot be verified. Reads ``freshness``."""
    g = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("freshness").isin("expired", "sync_failed")).alias("bad"))
    text = F.concat(F.lit("calendar_sync_degraded:"), F.col("bad").cast("string"), F.lit("/"), F.col("sources").cast("string"))
    return g.withColumn("halt", F.when(F.col("sources") == 0, "no_calendar_data").when(F.col("bad") / F.col("sources") > limit, text))


def certification_matrix(records: DataFrame, person: str, assessment: str, status: str, assessments: list[str]) -> DataFrame:
    """Best status per person and assessment as columns, and who holds all of them."""
    level = F.when(F.col(status) == "reliable", 2).when(F.col(status) == "training", 1).otherwise(0)
    best = records.groupBy(person).agg(*[F.coalesce(F.max(F.when(F.col(assessment) == a, level)), F.lit(0)).alias(f"_l{i}") for i, a in enumerate(assessments)])
    word = lambda c: F.when(c == 2, "reliable").when(c == 1, "training").otherwise("none")
    held = sum(((F.col(f"_l{i}") == 2).cast("int") for i in range(len(assessments))), F.lit(0))
    return best.select(person, *[word(F.col(f"_l{i}")).alias(f"a_{a}") for i, a in enumerate(assessments)], held.alias("held"), (held == len(assessments)).alias("holds_all"))


def resolve_names(names: DataFrame, name: str, people: DataFrame, ident: str, aliases: list[Column]) -> DataFrame:
    """Person behind a written name when exactly one person has that id, name, alias or first name."""
    keys = people.select(ident, F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.lower(F.trim(a)), F.lit("")) for a in aliases])))).alias("_key"))
    unique = keys.groupBy("_key").agg(F.min(ident).alias(ident), F.max(ident).alias("_hi")).where(F.col(ident) == F.col("_hi")).drop("_hi")
    return names.withColumn("_key", F.lower(F.trim(F.col(name)))).join(unique, "_key", "left").drop("_key")


def best_pairs(people: DataFrame, group: str, staff: str, slots: DataFrame, k: int, cfg: S.ScoreConfig = S.DEFAULT) -> DataFrame:
    """The k best pairs of two different people per group who share a free slot, with the earliest one.

    A pair scores the larger value of phi, omega and p and the mean of psi. That is the best of eight
    sums f(a) + g(b), one per choice of who supplies which of the three, so a pair among the k best of a
    slot always joins one of the k+1 best people by f with one of the k+1 best by g. Only those are
    paired, which is exact and keeps the pairs per slot below a constant.
    """
    w, parts = cfg.weights, ("phi", "omega", "p")
    here = slots.join(people, [group, staff])
    masks = []
    for m in range(8):
        take = [parts[i] for i in range(3) if m >> i & 1]
        rest = [c for c in parts if c not in take]
        f = reduce(lambda a, b: a + b, [F.col(c) * w[c] for c in take], F.col("psi") * w["psi"] / 2)
        g = reduce(lambda a, b: a + b, [F.col(c) * w[c] for c in rest], F.col("psi") * w["psi"] / 2)
        masks.append(F.struct(F.lit(m).alias("_mask"), f.alias("_f"), g.alias("_g")))
    cols = [group, "slot", staff, *parts, "psi"]
    wide = here.select(*cols, F.explode(F.array(*masks)).alias("x")).select(*cols, "x.*")
    by = [group, "slot", "_mask"]

    def best(side):
        order = Window.partitionBy(*by).orderBy(F.desc(f"_{side}"), staff)
        return wide.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select(
            *by, *[F.col(c).alias(f"{c}_{side}") for c in (staff, *parts, "psi")])

    pairs = best("f").join(best("g"), by).where(F.col(f"{staff}_f") != F.col(f"{staff}_g"))
    lo = F.least(f"{staff}_f", f"{staff}_g")
    hi = F.greatest(f"{staff}_f", f"{staff}_g")
    score = reduce(lambda a, b: a + b, [F.greatest(f"{c}_f", f"{c}_g") * w[c] for c in parts]) + (F.col("psi_f") + F.col("psi_g")) / 2 * w["psi"]
    pairs = pairs.select(group, "slot", lo.alias("a"), hi.alias("b"), F.round(score, 9).alias("score"))
    # a pair's score does not depend on the slot; the earliest shared slot is looked up for the kept pairs
    kept = pairs.groupBy(group, "a", "b").agg(F.first("score").alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), "a", "b")
    kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    free_a = slots.select(group, F.col(staff).alias("a"), "slot")
    free_b = slots.select(group, F.col(staff).alias("b"), "slot")
    both = kept.join(free_a, [group, "a"]).join(free_b, [group, "b", "slot"])
    return both.groupBy(group, "a", "b", "score", "place").agg(F.min("slot").alias("first_slot"))
