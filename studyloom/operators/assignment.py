"""Ordered assignment jobs (inventory F07, A64-A65, H01-H04).

The relational part of every job runs as joins, aggregates and windows. What is left, a choice that
depends on all earlier choices of the same pool, is a fold over sorted rows: rows are partitioned by
pool, sorted by Spark and streamed through a small state, so no pool is held in memory.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[Column], schema: str, new_state: Callable[[], object],
                 step: Callable[[object, tuple], list[tuple]], finish: Callable[[object, tuple], list[tuple]] | None = None) -> DataFrame:
    """Stream the sorted rows of each key through ``step(state, row)``, which returns output rows.

    Only the state of the current key is kept. ``finish(state, key)`` may add rows when a key ends.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    out_names = [p.strip().split()[0].strip("`") for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            made: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current:
                    if current is not None and finish is not None:
                        made += finish(state, current)
                    current, state = key, new_state()
                made += step(state, row)
            if made:
                yield pd.DataFrame(made, columns=out_names)
        if current is not None and finish is not None:
            last = finish(state, current)
            if last:
                yield pd.DataFrame(last, columns=out_names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def exclusion_audit(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """first exclusion reason and its detail per row; null keeps the row.

    The result is meant to be persisted, or written once, before accepted and rejected rows are split.
    """
    reason = F.coalesce(*[F.when(test, F.struct(F.lit(n).alias("reason"), detail.cast("string").alias("detail"))) for n, test, detail in rules])
    return df.withColumn("_x", reason).select("*", F.col("_x.reason").alias("reason"), F.col("_x.detail").alias("detail")).drop("_x")


def split_accepted(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) from one checkpointed scan, so the reasons are computed once."""
    from ..session import checkpoint_dir

    checkpoint_dir(audited.sparkSession)
    kept = audited.checkpoint()
    return kept.where("reason is null").drop("reason", "detail"), kept.where("reason is not null")


def contact_history(visits: DataFrame, family: str, members: str, at: str) -> DataFrame:
    """One row per (family, member, date), members taken from an array column."""
    return visits.where(F.col(at).isNotNull()).select(family, F.explode(members).alias("member"), F.col(at).alias("contact_date")).distinct()


def stage_candidates(cases: DataFrame, contacts: DataFrame, roster: list[str]) -> DataFrame:
    """One trace row per case and eligible member with contact count and nearest gap in days.

    ``cases`` holds ``case_id, family, eval_date, own_members`` (array). The roster is configuration, so
    a case meets a fixed number of members. A family's contact days are lists beside its cases, as long as the calendar at most. The rows of a case
    come out side by side, so choices need no further shuffle. Rows that share a case id each meet the gaps of all of them.
    """
    names = list(dict.fromkeys(roster))
    places = F.array(*[F.lit(i) for i in range(len(names))])
    listed = F.array(*[F.lit(m) for m in names])
    # contacts are distinct, so no family has more rows than members times days
    met = contacts.select("family", F.array_position(listed, F.col("member")).cast("int").alias("_m"), F.unix_date(F.to_date("contact_date")).alias("_day")).where("_m > 0")
    met = met.repartition("family").groupBy("family").agg(
        F.array(*[F.count_if(F.col("_m") == i + 1) for i in range(len(names))]).alias("_counts"),
        F.array(*[F.array_sort(F.collect_list(F.when(F.col("_m") == i + 1, F.col("_day")))) for i in range(len(names))]).alias("_days"))
    own = cases.select("case_id", "family", "eval_date", "examiner_blank", F.array_except(listed, F.col("own_members")).alias("_pool")).where(F.size("_pool") > 0)
    day = F.unix_date(F.to_date("eval_date"))

    def nearest(days: Column) -> Column:
        """Of sorted days only the 32 from the last of each 32nd that is not later, and the one behind them, are looked at."""
        begun = F.size(F.filter(F.sequence(F.lit(0), F.shiftright(F.size(days) - 1, 5)), lambda k: F.get(days, k * 32) <= day))
        part = F.slice(days, F.greatest((begun - 1) * 32, F.lit(0)) + 1, F.lit(33))
        return F.when(F.size(days) > 0, F.array_min(F.transform(part, lambda d: F.abs(d - day))))

    row = F.struct("family", "eval_date", "examiner_blank", F.transform(listed, lambda m: F.array_contains("_pool", m)).alias("open"), F.col("_counts").alias("contacts"), F.transform("_days", nearest).alias("gaps"))
    rows = own.join(met, "family", "left").select("case_id", row.alias("r")).repartition("case_id").groupBy("case_id").agg(F.collect_list("r").alias("rs"))

    def gaps(k: Column) -> Column:
        dated = F.filter("rs", lambda o: o["eval_date"].isNotNull() & F.get(o["open"], k))
        return F.when(F.size(dated) > 0, F.transform(dated, lambda o: F.get(o["gaps"], k))).otherwise(F.array(F.lit(None).cast("int")))

    def traced(c: Column) -> Column:
        return F.flatten(F.transform(F.filter(places, lambda k: F.get(c["open"], k)), lambda k: F.transform(gaps(k), lambda g: F.struct(
            c["family"].alias("family"), F.get(listed, k).alias("member"), c["eval_date"].alias("eval_date"), c["examiner_blank"].alias("examiner_blank"),
            F.coalesce(F.get(c["contacts"], k), F.lit(0)).alias("contacts"), g.alias("gap_days")))))

    return rows.select("case_id", F.inline(F.flatten(F.transform("rs", traced)))).select("family", "member", "case_id", "eval_date", "examiner_blank", "contacts", "gap_days")


def stage_choice(trace: DataFrame) -> DataFrame:
    """Members still equal after the relational stages, with the stage that decides.

    Blank examiner: everybody, by workload. Never seen; else fewest contacts; else largest gap. A single
    survivor is decided; several go to the workload stage.
    """
    # the array of a case is as long as the configured roster
    c = trace.groupBy("case_id").agg(F.max("examiner_blank").alias("blank"), F.array_sort(F.collect_list(F.struct("member", "contacts", "gap_days"))).alias("a"))
    never = F.filter("a", lambda x: x["contacts"] == 0)
    low = F.array_min(F.transform("a", lambda x: x["contacts"]))
    least = F.filter("a", lambda x: x["contacts"] == low)
    far = F.array_max(F.transform(least, lambda x: x["gap_days"]))
    furthest = F.filter(least, lambda x: x["gap_days"] == far)
    chosen = (F.when(F.col("blank"), F.col("a")).when(F.size(never) > 0, never).when(F.size(least) == 1, least).otherwise(furthest))
    stage = (F.when(F.col("blank"), "BLANK").when(F.size(never) > 0, "NS").when(F.size(least) == 1, "LV").otherwise("FT"))
    return c.select("case_id", stage.alias("stage"), F.transform(chosen, lambda x: x["member"]).alias("tied"), F.size("a").alias("eligible"))


def _pick(seed: int, case, member: str) -> int:
    import zlib

    return zlib.crc32(f"{seed}|{case}|{member}".encode())


class _Edge:
    """What a block's rows of one pool come to: picks per member, and the members that could be picked. ``entry`` are the loads they were made from."""

    def __init__(self, entry: dict[str, int], picks: dict[str, int], members: list[str]):
        self.entry, self.picks, self.members = entry, picks, members

    def holds_for(self, entry: dict[str, int]) -> bool:
        """Choices compare loads, so loads that are higher by one number for everybody leave them as they are."""
        return len({entry.get(m, 0) - self.entry.get(m, 0) for m in self.members}) <= 1


def workload_fold(cases: DataFrame, choices: DataFrame, pool: list[str], order: list[str], seed: int) -> DataFrame:
    """In case order, ties go to the member with the fewest assignments so far, then to a seeded hash.

    Every case of a pool, decided or not, adds to the workload. The hash stands for a random draw. ``order`` ends in a unique column.

    Sorted cases are cut into blocks, whatever their pool. A pool inside a block is folded there. For pools that go on in the next block, all blocks are folded side by side
    from a guessed workload; then each is handed the loads its predecessors end with, and only blocks in which these favour other members than the guess
    did run again, until nothing changes. Each round settles at least one more block of a pool. The driver holds the loads at block edges, one number per member.
    Blocks are pinned as packed batches, which are a small part of their rows.
    """
    from ..scale import BLOCK
    from ..session import checkpoint_dir

    spark = cases.sparkSession
    checkpoint_dir(spark)
    df = cases.select("case_id", *pool, *order).join(choices, "case_id").select(*pool, "case_id", *[o for o in order if o != "case_id"], "stage", "tied")
    by = [*pool, *order]
    key = F.struct(*pool)
    named = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pool", F.to_json(key))
    rows = named.select(*pool, "case_id", "_pool", "stage", "tied", F.spark_partition_id().alias(BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per batch: block, place in it, first and last pool, and the rows."""
        for place, batch in enumerate(b for b in batches if b.num_rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            last, names = batch.num_rows - 1, batch.column("_pool")
            values = [batch.column(BLOCK)[0].as_py()], [place], [names[0].as_py()], [names[last].as_py()], [sink.getvalue().to_pybytes()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names=[BLOCK, "place", "lo", "hi", "rows"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                yield from pa.ipc.open_stream(rows.as_buffer())

    blocks = rows.mapInArrow(pack, f"{BLOCK} int, place long, lo string, hi string, rows binary").checkpoint()
    bounds = {r[BLOCK]: (r["lo"], r["hi"]) for r in blocks.groupBy(BLOCK).agg(F.min_by("lo", "place").alias("lo"), F.max_by("hi", "place").alias("hi")).collect()}
    line = sorted(bounds)
    follows = {b: a for a, b in zip(line, line[1:]) if bounds[a][1] == bounds[b][0]}  # block -> the one whose last pool goes on in it

    def choose(row: dict, load: dict[str, int]) -> tuple[str, str, int]:
        tied = row["tied"]
        if len(tied) == 1 and row["stage"] != "BLANK":
            who, rule = tied[0], row["stage"]
        else:
            low = min(load.get(m, 0) for m in tied)
            left = [m for m in tied if load.get(m, 0) == low]
            who = min(left, key=lambda m: (_pick(seed, row["case_id"], m), m))
            rule = f"{row['stage']} {'random' if len(left) > 1 else 'workload'}"
        before = load.get(who, 0)
        load[who] = before + 1
        return who, rule, before

    def edge_folds(todo: dict[tuple[int, str], dict[str, int]]) -> dict[tuple[int, str], _Edge]:
        """Fold the rows of the given blocks and pools from the given loads."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: dict[tuple[int, str], tuple[dict, dict, set]] = {}
            for batch in unpacked(batches):
                for row in batch.filter(pc.is_in(batch.column("_pool"), pools)).to_pylist():
                    at = (row[BLOCK], row["_pool"])
                    if at in todo:
                        load, picks, members = done.setdefault(at, (dict(todo[at]), {}, set()))
                        who, _, _ = choose(row, load)
                        picks[who] = picks.get(who, 0) + 1
                        members.update(row["tied"])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at, picks, sorted(members))) for at, (_, picks, members) in done.items()], pa.binary())], names=["edge"])

        pools = pa.array(sorted({k for _, k in todo}), pa.string())
        wanted = F.col(BLOCK).isin(sorted({b for b, _ in todo}))
        found = [pickle.loads(r["edge"]) for r in blocks.where(wanted).mapInArrow(run, "edge binary").collect()]
        return {at: _Edge(todo[at], picks, members) for at, picks, members in found}

    # every pool that crosses an edge, in every block it has rows in
    crossing = {at for b, a in follows.items() for at in ((a, bounds[a][1]), (b, bounds[b][0]))}
    entry: dict[int, dict[str, int]] = {}
    edges = edge_folds({at: {} for at in crossing}) if crossing else {}
    while crossing:
        again = {}
        for b in line:
            if b not in follows:
                continue
            before = edges[follows[b], bounds[b][0]]
            # a block that is one pool from end to end adds to the loads it was handed
            start = entry.get(follows[b], {}) if bounds[follows[b]][0] == bounds[b][0] else {}
            entry[b] = {m: start.get(m, 0) + before.picks.get(m, 0) for m in {*start, *before.picks}}
            if not edges[b, bounds[b][0]].holds_for(entry[b]):
                again[b, bounds[b][0]] = entry[b]
        if not again:
            break
        edges |= edge_folds(again)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, load = None, {}
        for batch in unpacked(batches):
            made = []
            for row in batch.to_pylist():
                at = (row[BLOCK], row["_pool"])
                if at != current:
                    current, load = at, dict(entry.get(at[0], {})) if at[1] == bounds[at[0]][0] else {}
                made.append(choose(row, load))
            who, rule, before = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(pool) + 1], pa.array(who, pa.string()), pa.array(rule, pa.string()), pa.array(before, pa.int64())],
                                             names=[*pool, "case_id", "member", "rule", "load_before"])

    kinds = dict(df.dtypes)
    return blocks.mapInArrow(assign, ", ".join([f"`{p}` {kinds[p]}" for p in pool] + [f"case_id {kinds['case_id']}", "member string", "rule string", "load_before long"]))


def assignment_checks(cases: DataFrame, trace: DataFrame, assigned: DataFrame, choices: DataFrame, pool: list[str], order: list[str]) -> DataFrame:
    """Failures per independent check of an assignment run; every count should be zero."""
    one = assigned.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    c1 = cases.select("case_id").join(one, "case_id", "left").agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("n"))
    # the members of a case are at most the configured roster
    eligible = trace.groupBy("case_id").agg(F.collect_set("member").alias("_members"))
    c2 = assigned.join(eligible, "case_id", "left").agg(F.count_if(~F.coalesce(F.array_contains("_members", F.col("member")), F.lit(False))).alias("n"))
    j = assigned.join(choices, "case_id")
    c3 = j.agg(F.count_if(~F.array_contains("tied", F.col("member"))).alias("n"))
    c4 = j.agg(F.count_if(~F.startswith("rule", "stage")).alias("n"))
    a = assigned.join(cases.select("case_id", *[o for o in order if o != "case_id"]), "case_id")
    c5 = _replayed(a, pool, order).agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("n"))
    out = None
    for name, df in (("one_member_per_case", c1), ("member_was_eligible", c2), ("member_survived_stages", c3), ("rule_matches_stage", c4), ("workload_replays", c5)):
        row = df.select(F.lit(name).alias("check"), F.col("n").alias("failures"))
        out = row if out is None else out.unionByName(row)
    return out


def _replayed(assigned: DataFrame, pool: list[str], order: list[str]) -> DataFrame:
    """Rows whose ``load_before`` is not the number of earlier rows of their pool and member, as counts (``failures``).

    A block of sorted rows leaves, per pool and member, how far the stated loads are ahead of its own count and for how many rows; what the blocks before
    it counted is what they should be ahead.
    """
    from ..scale import BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, seen, ahead = None, None, {}, {}

        def closed() -> pa.RecordBatch:
            rows = [(current, m, block, a, n) for (m, a), n in ahead.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["_pool", "member", BLOCK, "ahead", "n"])

        for batch in batches:
            for key, member, load, block in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    if ahead:
                        yield closed()
                    current, seen, ahead = key, {}, {}
                at = seen[member] = seen.get(member, -1) + 1
                if load is not None:  # a load that is not stated is not judged, but its row counts
                    ahead[member, load - at] = ahead.get((member, load - at), 0) + 1
                else:
                    ahead[member, None] = ahead.get((member, None), 0) + 1
        if ahead:
            yield closed()

    by = [*pool, *order]
    rows = assigned.repartitionByRange(*by).sortWithinPartitions(*by).select(F.to_json(F.struct(*pool)).alias("_pool"), "member", "load_before", F.spark_partition_id().alias(BLOCK))
    counted = rows.mapInArrow(count, f"_pool string, member string, {BLOCK} int, ahead long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_pool", "member").orderBy(BLOCK).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("_before", before).select(F.when(F.col("ahead") != F.col("_before"), F.col("n")).otherwise(0).alias("failures"))


def greedy_plan(options: DataFrame, group: list[str], visits: DataFrame | None = None) -> DataFrame:
    """Hardest visit first; each takes its best option that fits capacity and overlaps nothing booked.

    ``options`` holds ``visit_id, staff_id, score, start, end, capacity``. The state of a group is its
    booked slots, never its options. Unplaced visits come back with a null member, and so do those of ``visits`` (group, ``visit_id``)
    that have no option at all.
    """
    sizes = options.groupBy(*group, "visit_id").agg(F.count_distinct("staff_id").alias("_pool"))
    cols = [*group, "visit_id", "staff_id", "score", "start", "end", "capacity", "_pool"]
    df = options.join(sizes, [*group, "visit_id"]).select(*cols)
    order = [F.col("_pool"), F.col("visit_id"), F.col("score").desc(), F.col("staff_id"), F.col("start"), F.col("end")]
    ng = len(group)

    def new_state():
        return {"visit": None, "placed": True, "booked": {}}

    def open_visit(state, key):
        return [] if state["visit"] is None or state["placed"] else [(*key, state["visit"], None, 0.0)]

    def step(state, row):
        key, (visit, staff, score, start, end, cap, _) = row[:ng], row[ng:]
        out = []
        if visit != state["visit"]:
            out = open_visit(state, key)
            state["visit"], state["placed"] = visit, False
        if state["placed"]:
            return out
        taken = state["booked"].setdefault(staff, [])
        if len(taken) < cap and all(not (start < e and s < end) for s, e in taken):
            taken.append((start, end))
            state["placed"] = True
            out.append((*key, visit, staff, score))
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{g} {kinds[g]}" for g in group] + [f"visit_id {kinds['visit_id']}", f"staff_id {kinds['staff_id']}", "score double"])
    plan = ordered_fold(df, group, order, schema, new_state, step, lambda s, key: open_visit(s, key))
    if visits is None:
        return plan
    bare = visits.select(*group, "visit_id").distinct().join(options.select(*group, "visit_id").distinct(), [*group, "visit_id"], "left_anti")
    return plan.unionByName(bare.select(*group, "visit_id", F.lit(None).cast(kinds["staff_id"]).alias("staff_id"), F.lit(0.0).alias("score")))


def regret_report(options: DataFrame, plan: DataFrame, group: list[str], threshold: float = 0.03) -> DataFrame:
    """Greedy total against the sum of every visit's best option, an upper bound of any plan. Visits are those of the plan."""
    best = options.groupBy(*group, "visit_id").agg(F.max("score").alias("b")).groupBy(*group).agg(F.sum("b").alias("bound"))
    got = plan.groupBy(*group).agg(F.sum("score").alias("greedy"), F.count(F.lit(1)).alias("visits"), F.count_if(F.col("staff_id").isNull()).alias("unfilled"))
    j = got.join(best, group, "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    regret = (F.col("bound") - F.col("greedy")) / F.when(F.col("bound") > 0, F.col("bound")).otherwise(1.0)
    return j.withColumn("regret", regret).withColumn("escalate", (F.col("regret") > threshold) | (F.col("unfilled") >= 1))


def best_subset(df: DataFrame, keys: list[str], unique: str, weight: str) -> DataFrame:
    """Largest total weight of non-overlapping intervals per key.

    Intervals of different merged stretches never meet, so the best choice is taken stretch by stretch
    and added up; a long calendar is cut wherever it has a gap.
    """
    cut = _stretches(df, keys, unique, weight)

    def new_state():
        return {"ends": [], "best": [0.0]}

    def step(s, row):
        start, end, w = row[-4], row[-3], row[-2]
        before = bisect_right(s["ends"], start)
        s["ends"].append(end)
        s["best"].append(max(s["best"][-1], s["best"][before] + w))
        return []

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["stretch long", "best double", "blocks long"])
    per = ordered_fold(cut, [*keys, "stretch"], [F.col("end"), F.col("start"), F.col(unique)], schema, new_state, step,
                       lambda s, key: [(*key, s["best"][-1], len(s["ends"]))])
    return per.groupBy(*keys).agg(F.sum("best").alias("best_weight"), F.sum("blocks").alias("blocks"))


def greedy_subset(df: DataFrame, keys: list[str], unique: str, weight: str) -> DataFrame:
    """Heaviest first among intervals that still fit, stretch by stretch."""
    cut = _stretches(df, keys, unique, weight)

    def step(s, row):
        start, end, w = row[-4], row[-3], row[-2]
        if all(not (start < e and b < end) for b, e in s["taken"]):
            s["taken"].append((start, end))
            s["sum"] += w
        return []

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["stretch long", "total double", "taken long"])
    per = ordered_fold(cut, [*keys, "stretch"], [F.col(weight).desc(), F.col(unique)], schema, lambda: {"taken": [], "sum": 0.0}, step,
                       lambda s, key: [(*key, s["sum"], len(s["taken"]))])
    return per.groupBy(*keys).agg(F.sum("total").alias("greedy_weight"), F.sum("taken").alias("taken"))


def _stretches(df: DataFrame, keys: list[str], unique: str, weight: str) -> DataFrame:
    from ..scale import ordered_blocks, running

    order = [F.col("start"), F.col("end"), F.col(unique)]
    b = ordered_blocks(df.select(*keys, "start", "end", weight, unique), keys, order)
    b = running(b, keys, order, _reach=("max_before", F.col("end")))
    # touching intervals do not overlap, so a stretch ends as soon as everything before it has ended
    opens = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    b = running(b, keys, order, stretch=("sum", opens))
    return b.select(*keys, F.col("stretch").cast("long").alias("stretch"), "start", "end", F.col(weight).cast("double").alias(weight), unique)


__all__ = ["ordered_fold", "exclusion_audit", "split_accepted", "contact_history", "stage_candidates", "stage_choice", "workload_fold",
           "assignment_checks", "greedy_plan", "regret_report", "best_subset", "greedy_subset"]
