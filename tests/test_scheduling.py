import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from studyloom.functions import scoring as S
from studyloom.operators import alignment as L
from studyloom.operators import assignment as H
from studyloom.operators import intervals as I
from studyloom.operators import quality as Q
from studyloom.operators import scheduling as G


def test_reference_scores_and_order(spark):
    rows = [("A", 3, 5.0, 18.0, 30.0, 1.0), ("B", 0, None, 9.0, 75.0, 0.0), ("C", 1, 40.0, 12.0, 45.0, 0.0)]
    df = spark.createDataFrame(rows, "staff_id string, k int, days double, hours double, travel double, p double").withColumn("run_id", F.lit(1))
    none = F.array().cast("array<string>")
    cap = S.ramped_capacity(F.lit(20.0), F.lit(40))
    parts = {"phi": S.continuity(F.col("k"), F.col("days"), F.lit(1)), "omega": S.preference(F.col("staff_id"), none, none, none, none),
             "psi": S.burden_relief(S.burden(F.col("hours"), F.lit(2.0), F.col("travel")), cap), "p": F.col("p")}
    df = df.withColumn("score", S.weighted_total(parts))
    out = G.rank_candidates(df, "run_id", "score", "staff_id", []).orderBy("rank_position").collect()
    assert [r["staff_id"] for r in out] == ["A", "C", "B"]
    assert all(abs(r["score"] - want) < 1e-3 for r, want in zip(out, (0.502, 0.246, 0.173)))
    assert not out[0]["review_band_flag"] and sorted(r["rank_position"] for r in out) == [1, 2, 3]


def test_freshness_and_ramp(spark):
    f = lambda age, h, ok=True: spark.range(1).select(S.freshness_class(F.lit(age).cast("double"), F.lit(h), F.lit(ok))).collect()[0][0]
    assert [f(900, 72), f(3600, 72), f(3601, 72), f(4000, 100), f(86400, 400), f(None, 1), f(1, 1, False)] == ["fresh", "stale", "expired", "fresh", "fresh", "expired", "sync_failed"]
    c = spark.createDataFrame([(0,), (20,), (99,)], "n int").select(S.ramped_capacity(F.lit(21.0), F.col("n"))).collect()
    assert [round(r[0], 6) for r in c] == [1.0, 21.0, 21.0]


def test_merge_is_disjoint_and_touching_blocks_join(many_blocks):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", i, s, s + rng.randint(1, 30)) for i in range(300) for s in [rng.randint(0, 3000)]]
    rows += [("z", 900, 0, 10), ("z", 901, 10, 20), ("z", 902, 21, 30)]
    out = I.merge_intervals(many_blocks.createDataFrame(rows, "k string, id int, start long, end long"), ["k"], "id").toPandas()
    for k in ("a", "b", "z"):
        cover = set()
        for _, _, s, e in [r for r in rows if r[0] == k]:
            cover.update(range(s, e))
        got = out[out.k == k].sort_values("start")
        assert set(itertools.chain.from_iterable(range(s, e) for s, e in zip(got.start, got.end))) == cover
        assert (got.start.to_numpy()[1:] > got.end.to_numpy()[:-1]).all()
    assert len(out[out.k == "z"]) == 2


def test_free_time_and_first_slot(spark):
    day = 19724 * 86400  # a Tuesday
    people = spark.createDataFrame([("p",), ("q",)], "who string")
    busy = spark.createDataFrame([("p", 1, day + 9 * 3600, day + 10 * 3600), ("p", 2, day + 9 * 3600 + 600, day + 12 * 3600)], "who string, id int, start long, end long")
    work = I.working_days(people, ["who"], "2024-01-02", "2024-01-02")
    free = sorted((r["who"], (r["start"] - day) / 3600, (r["end"] - day) / 3600) for r in I.free_intervals(work, busy, ["who"], "id").collect())
    assert free == [("p", 8.0, 9.0), ("p", 12.0, 17.0), ("q", 8.0, 17.0)]
    slot = {r["who"]: (r["slot_start"] - day) / 3600 for r in I.first_slot(I.free_intervals(work, busy, ["who"], "id"), ["who"], F.lit(2 * 3600).cast("long")).collect()}
    assert slot == {"p": 12.0, "q": 8.0}


def test_no_snapshot_is_not_free(spark):
    people = spark.createDataFrame([("p",), ("q",)], "who string")
    busy = spark.createDataFrame([("p", 0, 1)], "who string, start long, end long")
    g = I.slot_grid(people, "who", busy, people.where("who = 'p'"), "2024-01-02", "2024-01-02").toPandas()
    assert set(g[g.who == "q"].state) == {"unknown"} and set(g[g.who == "p"].state) == {"free"} and len(g) == 40


def test_nearest_join_matches_pandas(spark):
    rng = np.random.default_rng(4)
    a = pd.DataFrame({"k": rng.choice(["x", "x", "x", "y"], 300), "at": rng.integers(0, 5000, 300).astype(float)}).drop_duplicates().reset_index(drop=True)
    b = pd.DataFrame({"k": rng.choice(["x", "x", "x", "y"], 200), "at": rng.integers(0, 5000, 200).astype(float)}).drop_duplicates().reset_index(drop=True)
    a["ia"], b["ib"] = np.arange(len(a)), np.arange(len(b))
    got = L.nearest_join(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], "at", "ia", "ib", 15).toPandas().set_index("ia")["ib"].to_dict()
    right = b.rename(columns={"at": "t"}).sort_values("t")
    want = pd.merge_asof(a.sort_values("at"), right, left_on="at", right_on="t", by="k", direction="nearest", tolerance=15.0).dropna(subset=["ib"])
    assert got == {int(r.ia): int(r.ib) for r in want.itertuples()}


def test_kappa_worked_case_and_undefined_states(spark):
    rows = [("g", a, b) for a, b, n in (("1", "1", 45), ("1", "0", 5), ("0", "1", 10), ("0", "0", 40)) for _ in range(n)] + [("one", "1", "1")] * 3
    out = {r["d"]: r for r in L.agreement(spark.createDataFrame(rows, "d string, a string, b string"), "a", "b", ["d"]).collect()}
    g = out["g"]
    assert (g["eligible"], g["agreeing"], round(g["observed"], 6), round(g["expected"], 6), round(g["kappa"], 6)) == (100, 85, 0.85, 0.5, 0.7)
    assert out["one"]["kappa"] is None and out["one"]["kappa_status"] == "undefined_expected_agreement_is_one"


def test_bursts_match_two_pointers(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["h", "h", "h", "l"], 250), "t": np.round(rng.uniform(0, 4000, 250), 3), "id": range(250)})
    got = Q.flag_bursts(spark.createDataFrame(pdf), ["k"], "t", "id", 30, 3).toPandas().set_index("id")["in_burst"].to_dict()
    for _, g in pdf.groupby("k"):
        g = g.sort_values("t")
        t, ids = g["t"].to_numpy(), g["id"].to_numpy()
        want = np.zeros(len(t), bool)
        for i in range(len(t) - 2):
            if t[i + 2] - t[i] <= 30:
                want[i:i + 3] = True
        assert {int(i): bool(w) for i, w in zip(ids, want)} == {int(i): got[i] for i in ids}


def test_best_pairs_match_all_pairs(spark):
    rng = random.Random(5)
    people = [("s", i, *(round(rng.random(), 3) for _ in range(4))) for i in range(40)]
    slots = [("s", i, sl) for i in range(40) for sl in range(6) if rng.random() < 0.4]
    w = S.DEFAULT.weights
    free = {}
    for _, i, sl in slots:
        free.setdefault(i, set()).add(sl)
    every = []
    for a, b in itertools.combinations(people, 2):
        common = free.get(a[1], set()) & free.get(b[1], set())
        if common:
            score = sum(max(a[2 + j], b[2 + j]) * w[c] for j, c in enumerate(("phi", "omega", "p"))) + (a[5] + b[5]) / 2 * w["psi"]
            every.append((-round(score, 9), a[1], b[1], min(common)))
    want = [(a, b, s) for _, a, b, s in sorted(every)[:5]]
    df = spark.createDataFrame(people, "g string, staff int, phi double, omega double, p double, psi double")
    out = G.best_pairs(df, "g", "staff", spark.createDataFrame(slots, "g string, staff int, slot int"), 5).orderBy("place").collect()
    assert [(r["a"], r["b"], r["first_slot"]) for r in out] == want


def test_best_subset_matches_brute_force(many_blocks):
    rng = random.Random(2)
    rows = [(k, i, s, s + rng.randint(2, 9), float(rng.randint(1, 9))) for k in ("a", "b") for i in range(12) for s in [rng.randint(0, 40)]]
    df = many_blocks.createDataFrame(rows, "k string, id int, start long, end long, w double")
    got = {r["k"]: r["best_weight"] for r in H.best_subset(df, ["k"], "id", "w").collect()}
    greedy = {r["k"]: r["greedy_weight"] for r in H.greedy_subset(df, ["k"], "id", "w").collect()}
    for k in ("a", "b"):
        mine = [r for r in rows if r[0] == k]
        best = 0.0
        for n in range(1, 13):
            for c in itertools.combinations(mine, n):
                s = sorted(c, key=lambda r: r[2])
                if all(x[3] <= y[2] for x, y in zip(s, s[1:])):
                    best = max(best, sum(r[4] for r in c))
        assert got[k] == best and greedy[k] <= best


def test_greedy_plan_respects_capacity(spark):
    rows = [("g", "v1", "s1", 0.9, 0, 2, 1), ("g", "v1", "s2", 0.8, 0, 2, 1), ("g", "v2", "s1", 0.7, 5, 7, 1), ("g", "v3", "s1", 0.6, 9, 11, 1)]
    df = spark.createDataFrame(rows, "g string, visit_id string, staff_id string, score double, start long, end long, capacity int")
    plan = {r["visit_id"]: r["staff_id"] for r in H.greedy_plan(df, ["g"]).collect()}
    # the visits with one option go first; the second of them finds the member used up
    assert plan == {"v2": "s1", "v3": None, "v1": "s2"}
    rep = H.regret_report(df, H.greedy_plan(df, ["g"]), ["g"]).collect()[0]
    assert rep["unfilled"] == 1 and rep["escalate"] and round(rep["bound"], 6) == 2.2


def test_assignment_stages_and_workload(spark):
    day = "2024-01-10"
    cases = spark.createDataFrame([(1, "f", day, ["C0"], False), (2, "f", day, [], True), (3, "g", day, ["C0"], False)], "case_id long, family string, eval_date string, own_members array<string>, examiner_blank boolean")
    cases = cases.withColumn("eval_date", F.col("eval_date").cast("date")).withColumn("pool", F.lit("p"))
    contacts = spark.createDataFrame([("f", "C1", "2024-01-01"), ("f", "C2", "2024-01-09"), ("g", "C1", "2024-01-01")], "family string, member string, contact_date string").withColumn("contact_date", F.col("contact_date").cast("date"))
    trace = H.stage_candidates(cases, contacts, ["C0", "C1", "C2"])
    choice = {r["case_id"]: (r["stage"], r["tied"]) for r in H.stage_choice(trace).collect()}
    assert choice == {1: ("FT", ["C1"]), 2: ("BLANK", ["C0", "C1", "C2"]), 3: ("NS", ["C2"])}
    done = H.workload_fold(cases, H.stage_choice(trace), ["pool"], ["case_id"], 7)
    got = {r["case_id"]: (r["member"], r["rule"]) for r in done.collect()}
    assert got[1] == ("C1", "FT") and got[3] == ("C2", "NS") and got[2][0] in ("C0", "C2") and got[2][1] == "BLANK random"
    checks = H.assignment_checks(cases, trace, done, H.stage_choice(trace), ["pool"], ["case_id"]).collect()
    assert all(r["failures"] == 0 for r in checks) and len(checks) == 5
