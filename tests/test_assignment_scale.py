"""Stage candidates and replay checks against plain loops, and what they send."""

import datetime as dt
import random

from pyspark.sql import functions as F

from studyloom.operators import assignment as H

D0 = dt.date(2020, 1, 1)
CASES = "case_id long, family long, eval_date date, own_members array<string>, examiner_blank boolean, pool string"


def made(spark):
    rng = random.Random(3)
    roster = ["C0", "C1", "C2", "C3"]
    day = lambda n: D0 + dt.timedelta(days=rng.randrange(n))
    # family 1 has met C0 on many days, 2 nobody, null is no family
    contacts = {(1, "C0", day(900)) for _ in range(400)} | {(f, rng.choice([*roster, "gone"]), day(300)) for f in (1, 3, 4, None) for _ in range(12)}
    cases = [(i, rng.choice([1, 1, 2, 3, 4]), rng.choice([None, *[day(1200) for _ in range(9)]]), rng.choice([[], ["C1"], ["C0", "C3"], roster, None]), i % 7 == 0, "ab"[i % 2]) for i in range(160)]
    cases += [(900, None, day(300), [], False, "a")]
    return roster, cases, contacts, spark.createDataFrame(cases, CASES).repartition(5), spark.createDataFrame(list(contacts), "family long, member string, contact_date date").repartition(4)


def test_trace_equals_plain_loops(many_blocks):
    roster, cases, contacts, c, k = made(many_blocks)
    got = {(r.case_id, r.member): (r.family, r.eval_date, r.examiner_blank, r.contacts, r.gap_days) for r in H.stage_candidates(c, k, roster).collect()}
    want = {}
    for i, family, at, own, blank, _ in cases:
        for m in roster:
            if own is not None and m not in own:
                days = [d for f, x, d in contacts if family is not None and (f, x) == (family, m)]
                want[i, m] = (family, at, blank, len(days), min((abs((d - at).days) for d in days), default=None) if at else None)
    assert got == want and H.stage_candidates(c, k, roster).count() == len(want)


def test_rows_of_one_case_id_meet_all_its_gaps(spark):
    """As before: of two rows with one case id, each has a trace row per gap."""
    c = spark.createDataFrame([(1, 1, D0, ["C1"], False, "a"), (1, 1, D0 + dt.timedelta(days=5), [], False, "a"), (2, 1, None, ["C0"], False, "a")], CASES)
    k = spark.createDataFrame([(1, "C0", D0 + dt.timedelta(days=1))], "family long, member string, contact_date date")
    got = sorted((r.case_id, r.member, r.contacts, r.gap_days if r.gap_days is not None else -1) for r in H.stage_candidates(c, k, ["C0", "C1"]).collect())
    assert got == [(1, "C0", 1, 1), (1, "C0", 1, 1), (1, "C0", 1, 4), (1, "C0", 1, 4), (1, "C1", 0, -1), (2, "C1", 0, -1)]


def test_trace_pins_nothing_and_choice_shuffles_nothing(spark, monkeypatch):
    """Rows of cases and members were pinned twice on their way and then dealt by case."""
    roster, _, _, c, k = made(spark)

    def never(*_, **__):
        raise AssertionError("rows are pinned")

    monkeypatch.setattr(type(c), "checkpoint", never)
    trace = H.stage_candidates(c, k, roster)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(H.stage_choice(trace)) == exchanges(trace)


def test_blocks_are_pinned_packed(many_blocks):
    """What the fold pins is a small part of its rows."""
    import os

    from studyloom.session import checkpoint_dir

    spark = many_blocks
    top = checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if f.startswith("part-"))
    before, n = size(), 20_000
    cases = spark.range(n).select(F.col("id").alias("case_id"), F.lit("hot").alias("pool"))
    choices = spark.range(n).select(F.col("id").alias("case_id"), F.lit("NS").alias("stage"), F.array(F.lit("C0"), F.lit("C1")).alias("tied"))
    done = H.workload_fold(cases, choices, ["pool"], ["case_id"], 7)
    assert size() - before < 40 * n
    assert {r.member: r.n for r in done.groupBy("member").agg(F.count("*").alias("n")).collect()} == {"C0": n // 2, "C1": n // 2}


def test_checks_count_every_failure(many_blocks):
    spark = many_blocks
    roster, _, _, c, k = made(spark)
    c = c.where("family is not null and size(own_members) < 4 and own_members is not null").dropDuplicates(["case_id"])
    trace = H.stage_candidates(c, k, roster)
    choice = H.stage_choice(trace)
    done = H.workload_fold(c, choice, ["pool"], ["case_id"], 7).checkpoint()
    found = lambda d: {r["check"]: r["failures"] for r in H.assignment_checks(c, trace, d, choice, ["pool"], ["case_id"]).collect()}
    assert set(found(done).values()) == {0}
    n = done.count()
    # one load is off by one
    at = done.orderBy("case_id").first().case_id
    assert found(done.withColumn("load_before", F.col("load_before") + F.when(F.col("case_id") == at, 1).otherwise(0)))["workload_replays"] == 1
    assert found(done.withColumn("load_before", F.col("load_before") + 1))["workload_replays"] == n
    assert found(done.withColumn("member", F.lit("nobody")))["member_was_eligible"] == n
    assert found(done.where(F.col("case_id") != at))["one_member_per_case"] == 1
    assert found(done.where("false"))["workload_replays"] == 0
