"""Interval operators on half-open [start, end) second axes (inventory W04, J09, J18-J20, F10, A58-A59, X42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import ordered_blocks, running

DAY = 86_400
# Slot length, shown hours and default working hours.
SLOT_SECONDS, DAY_START_HOUR, DAY_END_HOUR = 1800, 8, 18
WORK_START_HOUR, WORK_END_HOUR = 8, 17
ROSTER_CONFIDENCE = (0.35, 0.05, 0.75)


def merge_intervals(df: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Union of overlapping or touching intervals per key.

    An interval opens an island when it starts after everything before it has ended. The running end
    and the island number are carried across blocks, so one long calendar is many tasks.
    """
    order = [F.col("start"), F.col("end"), F.col(unique)]
    b = ordered_blocks(df.select(*keys, "start", "end", unique), keys, order)
    b = running(b, keys, order, _reach=("max_before", F.col("end")))
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)
    b = running(b, keys, order, island=("sum", opens))
    return b.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("blocks"))


def by_day(df: DataFrame, name: str) -> DataFrame:
    """One copy of an interval for every day it touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.greatest("end", F.col("start") + 1) - 1) / DAY))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with a.start < b.end and b.start < a.end, joined on key and day.

    A pair is kept only on the first day both touch, so no later distinct is needed.
    """
    left = by_day(a, "_day").withColumnsRenamed({"start": "start_a", "end": "end_a"})
    right = by_day(b, "_day").withColumnsRenamed({"start": "start_b", "end": "end_b"})
    j = left.join(right, [*keys, "_day"])
    first = F.greatest(F.floor(F.col("start_a") / DAY), F.floor(F.col("start_b") / DAY))
    return j.where((F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a")) & (F.col("_day") == first)).drop("_day")


def _there(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals with a key and an end that is not before the start; others meet nothing."""
    out = F.col("start") <= F.col("end")
    for k in keys:
        out = out & F.col(k).isNotNull()
    return df.where(out)


def overlap_counts(windows: DataFrame, busy: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """How many busy intervals each window overlaps, as (keys, ident, n), without a pair.

    What overlaps a window has started before its end and not ended by its start: the starts before the one less the ends up to the other. Both are
    running counts along one order of all edges, cut into blocks, so neither a crowded key nor a crowded day is one task.
    """
    w, b = _there(windows, keys), _there(busy, keys)
    none, zero = F.lit(None).cast(dict(windows.dtypes)[ident]), F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    def edge(df: DataFrame, at: str, rank: Column, who: Column, starts: Column, ends: Column) -> DataFrame:
        return df.select(*keys, F.col(at).alias("_at"), rank.alias("_rank"), who.alias("_who"), starts.alias("_starts"), ends.alias("_ends"))

    empty = F.col("start") == F.col("end")
    # at one time: ends, windows' starts, windows' ends, starts of empty intervals, ends of empty windows, starts
    line = (edge(b, "end", F.lit(0), none, zero, one).unionByName(edge(w, "start", F.lit(1), F.col(ident), zero, zero))
            .unionByName(edge(w, "end", F.when(empty, 4).otherwise(2), F.col(ident), zero, zero)).unionByName(edge(b, "start", F.when(empty, 3).otherwise(5), none, one, zero)))
    order = [F.col("_at"), F.col("_rank"), F.col("_who")]
    run = running(ordered_blocks(line, keys, order), keys, order, _started=("sum", F.col("_starts")), _ended=("sum", F.col("_ends")))
    seen = F.when(F.col("_rank") == 1, -F.col("_ended")).otherwise(F.col("_started"))
    return run.where(F.col("_rank").isin(1, 2, 4)).groupBy(*keys, F.col("_who").alias(ident)).agg(F.sum(seen).alias("n"))


def contained(a: DataFrame, merged: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Ids of windows wholly inside the union, given its merged intervals.

    Merged intervals end in the order of their starts, so of all that start by a window's start the latest end decides; it is a running maximum.
    """
    w, m = _there(a, keys), _there(merged, keys)
    end = dict(a.dtypes)["end"]
    none = F.lit(None).cast(dict(a.dtypes)[ident])
    # an empty window must lie strictly inside, so it stands before a start at its time
    rank = F.when(F.col("end") > F.col("start"), 1).otherwise(-1)
    line = m.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_rank"), none.alias("_who"), F.lit(None).cast(end).alias("_until"), F.col("end").cast(end).alias("_reach")).unionByName(
        w.select(*keys, F.col("start").alias("_at"), rank.alias("_rank"), F.col(ident).alias("_who"), F.col("end").alias("_until"), F.lit(None).cast(end).alias("_reach")))
    order = [F.col("_at"), F.col("_rank"), F.col("_who"), F.col("_until")]
    run = running(ordered_blocks(line, keys, order), keys, order, _latest=("max", F.col("_reach")))
    inside = (F.col("_rank") != 0) & (F.col("_until") <= F.col("_latest")) & (F.col("_at") < F.col("_latest"))
    return run.where(inside).select(*keys, F.col("_who").alias(ident))


def working_days(keys_df: DataFrame, keys: list[str], first_day: str, last_day: str, start_hour: float = WORK_START_HOUR,
                 end_hour: float = WORK_END_HOUR, weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Working interval per member and day; Monday is 0. The calendar is laid out inside each row."""
    d = keys_df.select(*keys, F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    d = d.where(F.weekday("day").isin(*weekdays))
    base = F.unix_date("day").cast("long") * DAY
    return d.select(*keys, "day", (base + int(start_hour * 3600)).alias("work_start"), (base + int(end_hour * 3600)).alias("work_end"))


def free_intervals(working: DataFrame, busy: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Working hours minus busy blocks, per member and day."""
    pieces = by_day(busy.select(*keys, "start", "end", unique), "_d").withColumn("day", F.date_from_unix_date(F.col("_d").cast("int"))).drop("_d")
    j = working.join(pieces, [*keys, "day"], "left")
    there = F.col("start").isNotNull()  # greatest and least skip nulls, so an empty day is kept apart
    s, e = F.when(there, F.greatest("start", "work_start")), F.when(there, F.least("end", "work_end"))
    j = j.withColumns({"_s": s, "_e": e}).withColumns({"_s": F.when(F.col("_e") > F.col("_s"), F.col("_s")), "_e": F.when(F.col("_e") > F.col("_s"), F.col("_e"))})
    w = Window.partitionBy(*keys, "day").orderBy(F.col("_s").asc_nulls_last(), "_e", unique)
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lead("work_start").over(w).isNull()
    start = F.coalesce(reach, F.col("work_start"))
    tail = F.greatest(start, F.coalesce("_e", F.col("work_start")))
    gaps = F.array_compact(F.array(
        F.when(F.col("_s") > start, F.struct(start.alias("start"), F.col("_s").alias("end"))),
        F.when(last & (tail < F.col("work_end")), F.struct(tail.alias("start"), F.col("work_end").alias("end")))))
    return j.select(*keys, "day", gaps.alias("g")).select(*keys, "day", F.explode("g").alias("g")).select(*keys, "day", "g.start", "g.end")


def first_slot(free: DataFrame, keys: list[str], need_seconds: Column) -> DataFrame:
    """Earliest free stretch that holds the visit and its travel."""
    fit = free.where(F.col("end") - F.col("start") >= need_seconds)
    return fit.groupBy(*keys).agg(F.min("start").alias("slot_start")).withColumn("slot_end", F.col("slot_start") + need_seconds)


def latest_snapshot(snapshots: DataFrame, people: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """Newest snapshot per person; people without one are marked missing."""
    last = snapshots.groupBy(key).agg(F.max_by(F.struct(at, *keep), F.struct(at, *keep)).alias("s"))
    return people.select(key).join(last, key, "left").select(key, F.col(f"s.{at}").alias(at), *[F.col(f"s.{c}").alias(c) for c in keep],
                                                            F.when(F.col("s").isNull(), "missing").otherwise("present").alias("snapshot_state"))


def evidence(windows: DataFrame, busy: DataFrame, snapshot: DataFrame, keys: list[str], ident: str, inside_hours: Column) -> DataFrame:
    """Conflict, clear or insufficient for each person and window; no evidence is never free."""
    hit = overlap_counts(windows, busy, keys, ident).withColumnRenamed("n", "conflicts")
    j = windows.join(snapshot.select(*keys, "sync_ok"), keys, "left").join(hit, [*keys, ident], "left")
    state = (F.when(~F.coalesce("sync_ok", F.lit(False)), "insufficient").when(F.col("conflicts") > 0, "conflict")
             .when(~inside_hours, "insufficient").otherwise("clear"))
    return j.select(*keys, ident, F.coalesce("conflicts", F.lit(0)).alias("conflicts"), state.alias("evidence"))


def resource_checks(visits: DataFrame, offered: DataFrame, shifts: DataFrame, lab: DataFrame, key: str, ident: str) -> DataFrame:
    """pass, fail or not_applicable against offered times, shifts and the room.

    The calendars are merged intervals per key; ``needs_shift`` and ``in_lab`` are columns of the visits.
    A missing calendar verifies nothing, so it is not a pass.
    """
    out = visits
    for name, cal in (("offered", offered), ("shift", shifts), ("lab", lab)):
        out = out.join(cal.groupBy(key).agg(F.lit(True).alias(f"_has_{name}")), key, "left")
    for name, cal in (("offered", offered), ("shift", shifts)):
        inside = contained(visits, cal, [key], ident).select(key, ident, F.lit(True).alias(f"_in_{name}"))
        out = out.join(inside, [key, ident], "left")
    taken = overlap_counts(visits, lab, [key], ident).where("n > 0").select(key, ident, F.lit(True).alias("_taken"))
    out = out.join(taken, [key, ident], "left")

    def verdict(skip, has, ok):
        return F.when(skip | F.col(has).isNull(), "not_applicable").when(ok, "pass").otherwise("fail")

    return out.select(
        key, ident, verdict(F.lit(False), "_has_offered", F.col("_in_offered").isNotNull()).alias("offered_times"),
        verdict(~F.col("needs_shift"), "_has_shift", F.col("_in_shift").isNotNull()).alias("clinician_shift"),
        verdict(~F.col("in_lab"), "_has_lab", F.col("_taken").isNull()).alias("lab_room"))


def slot_grid(people: DataFrame, key: str, busy: DataFrame, known: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Free, busy or unknown per person and 30-minute slot.

    Busy blocks are cut into slot numbers, so the grid is matched by equality only.
    """
    d = people.select(key, F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    per_day = DAY // SLOT_SECONDS
    first, last = DAY_START_HOUR * 3600 // SLOT_SECONDS, DAY_END_HOUR * 3600 // SLOT_SECONDS - 1
    base = F.unix_date("day").cast("long") * per_day
    grid = d.select(key, "day", F.explode(F.sequence(base + first, base + last)).alias("slot"))
    used = busy.select(key, F.explode(F.sequence(F.floor(F.col("start") / SLOT_SECONDS), F.floor((F.col("end") - 1) / SLOT_SECONDS))).alias("slot"))
    used = used.groupBy(key, "slot").agg(F.lit(True).alias("_busy"))
    j = grid.join(known.select(key, F.lit(True).alias("_known")), key, "left").join(used, [key, "slot"], "left")
    return j.select(key, "day", "slot", F.when(F.col("_known").isNull(), "unknown").when(F.col("_busy"), "busy").otherwise("free").alias("state"))


def slot_counts(grid: DataFrame) -> DataFrame:
    """People free, busy and unknown per slot, and the share whose calendar is known."""
    g = grid.groupBy("day", "slot").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("free", "busy", "unknown")])
    return g.withColumn("coverage", F.try_divide((F.col("free") + F.col("busy")).cast("double"), F.col("free") + F.col("busy") + F.col("unknown")))


def day_signals(items: DataFrame, key: str, status: str, day: str = "day") -> DataFrame:
    """Item counts by status, earliest and latest, density and confidence per person and day."""
    base, each, top = ROSTER_CONFIDENCE
    g = items.groupBy(key, day).agg(
        *[F.count_if(F.col(status) == s).alias(s) for s in ("busy", "tentative", "free")], F.count_if(F.col("named")).alias("named"),
        F.count(F.lit(1)).alias("items"), F.min("start").alias("earliest"), F.max("end").alias("latest"))
    return g.withColumn("density", F.col("busy") + 0.5 * F.col("tentative")).withColumn("confidence", F.least(F.lit(top), F.lit(base) + F.lit(each) * F.col("items")))


def joint_signals(signals: DataFrame, day: str = "day") -> DataFrame:
    """People and load per day over everybody."""
    return signals.groupBy(day).agg(F.count(F.lit(1)).alias("people"), F.sum("density").alias("density"), F.avg("confidence").alias("confidence"))
