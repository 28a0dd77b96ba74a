"""Queries over fairness, drift and decision audit (inventory A49-A55, H05-H07, M18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import audit as A
from ..operators import scheduling as G
from ..operators.candidates import line_components
from ..session import checkpoint_dir
from .registry import query
from .series_q import r


def scored(t):
    """Lineitem rows as candidates of their order, with four components and a total."""
    c = line_components()
    df = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("staff_id"), *[v.alias(n) for n, v in c.items()],
                           (F.col("l_quantity") / 45.0).alias("utilisation"), (F.col("l_suppkey") % 7 == 0).alias("is_cold_start"),
                           F.concat_ws(":", F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
                                       F.col("l_linenumber").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("cand"), "l_returnflag")
    return df.withColumn("final_score", F.round(S.weighted_total({n: F.col(n) for n in c}), 9))


def ranked(t):
    """Feasible candidates (two of three return flags) ranked within their run."""
    df = scored(t).where("l_returnflag <> 'R'").drop("l_returnflag")
    out = G.rank_candidates(df, "run_id", "final_score", "staff_id", ["cand"])
    # equal scores stand next to each other, so the first gap tells whether the top is shared
    tied = out.where("rank_position = 1").select("run_id", F.coalesce(F.col("gap_to_next") == 0, F.lit(False)).alias("is_tied"))
    # the ranked pool is what a scoring run stores; pinning it keeps the readers below from ranking again
    checkpoint_dir(t.spark)
    return out.join(tied, "run_id").checkpoint()


def runs(t):
    return t.orders.select(F.col("o_orderkey").alias("run_id"), F.trunc("o_orderdate", "quarter").alias("period"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def outcomes(t, rk):
    """The assigned candidate: mostly the first, for every fourth order the second; open orders have none."""
    want = F.when(F.col("run_id") % 4 == 0, 2).otherwise(1)
    closed = runs(t).where("status <> 'P'")
    hit = rk.select("run_id", "staff_id", "rank_position").join(closed, "run_id").where(F.col("rank_position") == want)
    return hit.select("run_id", "staff_id", F.col("rank_position").alias("assigned_rank"), (F.col("priority") == "5-LOW").alias("is_provisional"), (F.col("run_id") % 50 == 0).alias("write_time_conflict"))


_SC = """
with sc as (select l_orderkey run_id, l_suppkey staff_id, l_quantity / 50.0 phi, l_discount * 10 omega, 1 - l_tax * 10 psi, case when l_linestatus = 'F' then 1.0::double else 0.0::double end p, l_quantity / 45.0 utilisation, l_suppkey % 7 = 0 cold,
   lpad(cast(l_suppkey as varchar), 12, '0') || ':' || lpad(cast(l_partkey as varchar), 12, '0') || ':' || l_linenumber || ':' || cast(round(l_extendedprice * 100) as bigint) cand, l_returnflag rf from lineitem),
 sd as (select *, round(least(1.0, greatest(0.0, 0.45 * phi + 0.15 * omega + 0.30 * psi + 0.10 * p)), 9) s from sc)
"""
_RK = _SC + """
, rk as (select *, row_number() over w rn, round(s - lead(s) over w, 9) gap, count(*) over (partition by run_id) n, max(s) over (partition by run_id) top from sd where rf <> 'R' window w as (partition by run_id order by s desc, staff_id, cand)),
 tp as (select run_id, bool_or(rn = 1 and gap < 0.05) band, count(*) filter (s = top) > 1 tied, max(s) best, max(gap) filter (rn = 1) gap, max(utilisation) filter (rn = 1) us, bool_or(cold) filter (rn = 1) cold1, count(*) n,
    min(phi) lph, max(phi) hph, min(psi) lps, max(psi) hps, min(omega) lom, max(omega) hom from rk group by 1),
 ru as (select o_orderkey run_id, cast(date_trunc('quarter', o_orderdate) as date) as period, o_orderstatus st, o_orderpriority pr from orders),
 oc as (select rk.run_id, staff_id, rn ar, pr = '5-LOW' prov, rk.run_id % 50 = 0 wc from rk join ru using (run_id) where st <> 'P' and rn = case when rk.run_id % 4 = 0 then 2 else 1 end)
"""


@query("a49_inequality", """
with v as (select c_nationkey nation, o_custkey, sum(o_totalprice) v from orders join customer on o_custkey = c_custkey group by 1, 2), k as (select *, row_number() over (partition by nation order by v) i from v)
select nation, count(*) as members, round(stddev_pop(v) / avg(v), 6) as cv, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 6) as gini, round(max(v) / avg(v), 6) as imbalance from k group by 1
""")
def a49(t):
    v = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return r(A.inequality(v, ["nation"], "v"))


@query("a50_stability_index", """
with h as (select year(o_orderdate) yr, least(floor(l_discount * 10 * 10), 9) b, count(*) c from lineitem join orders on l_orderkey = o_orderkey group by 1, 2), n as (select yr, sum(c) n from h group by 1),
 g as (select n.yr, n.n, k.b, greatest(coalesce(h.c, 0) / cast(n.n as double), 1e-4) s from n cross join (select unnest(range(10)) b) k left join h on h.yr = n.yr and h.b = k.b)
select cast(g.yr as integer) as yr, cast(any_value(g.n) as bigint) as n, round(sum((g.s - z.s) * ln(g.s / z.s)), 6) as psi from g join g z on z.b = g.b and z.yr = 1996 group by 1
""")
def a50(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.year("o_orderdate").alias("yr"), (F.col("l_discount") * 10).alias("v"))
    return r(A.stability_index(df, "yr", 1996, "v"))


@query("a51_bootstrap_gini")
def a51(t):
    v = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return r(A.bootstrap_gini(v, ["nation"], "o_custkey", "v", 2_000, 7))


@query("a52_permutation_test")
def a52(t):
    c = scored(t).join(runs(t).select("run_id", "period"), "run_id")
    best = c.groupBy("period", "run_id").agg(F.max_by("staff_id", F.struct("final_score", "cand")).alias("staff_id"))
    return r(A.permutation_cv(c, best, ["period"], "run_id", "staff_id", 1_000, 11))


@query("a53_drift_report", _RK + """
, x as (select ru.run_id, ru.period, tp.band, tp.tied, tp.best, oc.staff_id, oc.ar, oc.prov, (select bool_or(cold) from rk where rk.run_id = ru.run_id and rk.staff_id = oc.staff_id) cs from ru left join tp using (run_id) left join oc using (run_id)),
 g as (select period, count(*) as runs, count(staff_id) as assigned, count(*) - count(staff_id) as unfilled, count(*) filter (band) / cast(count(*) as double) review_band_rate, count(*) filter (tied) / cast(count(*) as double) tie_rate,
   count(*) filter (ar > 1) / cast(count(staff_id) as double) override_rate, count(*) filter (ar = 1) / cast(count(staff_id) as double) top1_acceptance, count(*) filter (ar <= 3) / cast(count(staff_id) as double) topk_hit_rate,
   count(*) filter (prov) / cast(count(staff_id) as double) provisional_rate, count(*) filter (cs) / cast(count(staff_id) as double) cold_start_share, avg(best) mean_top1 from x group by 1),
 mb as (select distinct period, staff_id from rk join ru using (run_id)), ld as (select period, staff_id, count(*) v from x where staff_id is not null group by 1, 2),
 cv as (select mb.period, count(*) members, stddev_pop(coalesce(v, 0)) / avg(coalesce(v, 0)) cv from mb left join ld on ld.period = mb.period and ld.staff_id = mb.staff_id group by 1)
select period, runs, assigned, unfilled, round(review_band_rate, 6) as review_band_rate, round(tie_rate, 6) as tie_rate, round(override_rate, 6) as override_rate, round(top1_acceptance, 6) as top1_acceptance, round(topk_hit_rate, 6) as topk_hit_rate,
  round(provisional_rate, 6) as provisional_rate, round(cold_start_share, 6) as cold_start_share, round(mean_top1, 6) as mean_top1, members, round(cv, 6) as cv_visits,
  case when cv >= 0.4 then 'red' when cv >= 0.25 then 'amber' else 'green' end as cv_colour, case when topk_hit_rate <= 0.75 then 'red' when topk_hit_rate <= 0.9 then 'amber' else 'green' end as topk_colour from g join cv using (period)
""")
def a53(t):
    rk = ranked(t)
    return r(A.drift_report(runs(t), rk, outcomes(t, rk).drop("write_time_conflict"), "period"))


@query("a53_member_loads", _RK + """
, mb as (select period, staff_id, count(distinct rk.run_id) offered from rk join ru using (run_id) group by 1, 2), ld as (select period, staff_id, count(*) v from oc join ru using (run_id) group by 1, 2)
select mb.period, mb.staff_id, offered, coalesce(v, 0) as visits from mb left join ld on ld.period = mb.period and ld.staff_id = mb.staff_id
""")
def a53b(t):
    rk = ranked(t)
    return A.member_loads(rk, outcomes(t, rk), runs(t), "period")


@query("a54_exception_register", _RK + """
, k as (select ru.run_id, concat_ws(', ', case when tp.n is null then 'pool starvation' end, case when band then 'review band' end, case when tied then 'tie broken' end, case when ar > 1 then 'override' end, case when prov then 'provisional' end,
  case when wc then 'write-time conflict' end, case when cold1 then 'cold start at rank 1' end, case when coalesce(tp.n, 0) <= 1 then 'single-candidate pool' end) kinds, coalesce(cast(staff_id as varchar), 'unassigned') assigned
  from ru left join tp using (run_id) left join oc using (run_id))
select * from k where kinds <> ''
""")
def a54(t):
    rk = ranked(t)
    return A.exception_register(runs(t).select("run_id"), rk, outcomes(t, rk))


@query("a55_surprise_codes", _RK + """
, k as (select tp.run_id, array_to_string(list_sort(list_filter([case when ar > 1 then 'HUMAN_OVERRODE_TOP' end, case when best < 0.2 then 'WEAK_BEST_OPTION' end, case when n >= 2 and gap < 0.05 then 'INSIDE_REVIEW_BAND' end,
  case when us > 1 then 'TOP_PICK_OVER_CAPACITY' end, case when n >= 2 and lph = hph and lph in (0, 1) then 'CRITERION_INERT:phi' end, case when n >= 2 and lps = hps and lps in (0, 1) then 'CRITERION_INERT:psi' end,
  case when n >= 2 and lom = hom and lom in (0, 1) then 'CRITERION_INERT:omega' end], lambda v: v is not null)), ',') codes from tp left join oc using (run_id))
select * from k where codes <> ''
""")
def a55(t):
    rk = ranked(t)
    return A.surprise_codes(rk, outcomes(t, rk)).withColumn("codes", F.concat_ws(",", "codes"))


@query("a55_unexplained_shift", _SC + """
select run_id, staff_id, cand, 0.2::double as shift from sd where run_id % 10 = 0
""")
def a55b(t):
    now = scored(t)
    before = now.withColumn("final_score", F.col("final_score") - F.when(F.col("run_id") % 10 == 0, 0.2).otherwise(0.1)).withColumn(
        "utilisation", F.when(F.col("run_id") % 20 == 5, F.col("utilisation") + 1).otherwise(F.col("utilisation")))
    return r(A.unexplained_shifts(now, before, ["run_id", "staff_id", "cand"], ["phi", "utilisation"]))


@query("x37_waterfall", _RK + """
select oc.run_id, oc.staff_id, round((a.phi - b.phi) * 0.45, 6) as d_phi, round((a.omega - b.omega) * 0.15, 6) as d_omega, round((a.psi - b.psi) * 0.30, 6) as d_psi, round((a.p - b.p) * 0.10, 6) as d_p
from oc join rk a on a.run_id = oc.run_id and a.rn = oc.ar join rk b on b.run_id = oc.run_id and b.rn = 1
""")
def x37b(t):
    rk = ranked(t)
    return r(A.waterfall(rk, outcomes(t, rk)))


def _draws(n):
    return ", ".join("(" + ", ".join([str(i), *(f"{v!r}::double" for v in w)]) + ")" for i, w in enumerate(A.weight_draws(S.DEFAULT, n)))


#: Each run's candidates as lists in the order of their ids, every draw's first maximum, and the share of draws.
_WINS = """
, dr as materialized (select * from (values {d}) v(i, w1, w2, w3, w4)),
 pool as materialized (select run_id, list(phi order by staff_id) l1, list(omega order by staff_id) l2, list(psi order by staff_id) l3, list(p order by staff_id) l4, list(staff_id order by staff_id) ids from {t} group by run_id),
 wn as (select run_id, ids, list_transform(range(1, len(ids) + 1), lambda j: 0.0::double + l1[j] * w1 + l2[j] * w2 + l3[j] * w3 + l4[j] * w4) x from pool cross join dr),
 st as (select run_id, ids[list_position(x, list_max(x))] staff_id, count(*) / {n}.0::double stability from wn group by 1, 2)
"""


@query("h05_selection_stability", _SC + _WINS.format(d=_draws(2000), t="sc", n=2000) + "select run_id, staff_id, round(stability, 6) as stability from st")
def h05(t):
    return r(A.selection_stability(scored(t)))


@query("h06_band_calibration", _RK + _WINS.format(d=_draws(400), t="rk", n=400) + """
, de as (select gap, 1 - coalesce(stability, 0) flip from rk left join st on st.run_id = rk.run_id and st.staff_id = rk.staff_id where rn = 1 and gap is not null), e as (select unnest([0.02, 0.03, 0.04, 0.05, 0.07, 0.10, 0.15, 0.20])::double e),
 g as (select e, count(*) filter (gap >= e) outside, avg(flip) filter (gap >= e) mean_flip from de cross join e group by 1)
select coalesce((select min(e) from g where mean_flip <= 0.1), 0.2) as chosen, e as epsilon, outside, round(mean_flip, 6) as mean_flip from g
""")
def h06(t):
    rk = ranked(t)
    return r(A.calibrate_band(rk, A.selection_stability(rk, 400)))


_PERT = []
for _c in A.CRITERIA:
    for _d in (0.05, -0.05):
        _w = A.perturbed(S.DEFAULT.weights, _c, _d)
        _PERT.append(f"('{_c}', {_d}::double, " + ", ".join(f"{x!r}::double" for x in _w) + ")")


@query("h07_weight_sensitivity", _SC + f"""
, v as (select * from (values {", ".join(_PERT)}) v(criterion, delta, w1, w2, w3, w4)), u as (select *, count(*) over (partition by run_id) n from sd),
 b as (select *, row_number() over (partition by run_id order by s desc, cand) br from u where n >= 2),
 x as (select b.run_id, b.n, br, criterion, delta, row_number() over (partition by run_id, criterion, delta order by round(0.0::double + phi * w1 + omega * w2 + psi * w3 + p * w4, 9) desc, cand) nr from b cross join v),
 k as (select i.run_id, i.criterion, i.delta, any_value(i.n) n, count(*) filter (i.br < j.br and i.nr > j.nr) dis from x i join x j on i.run_id = j.run_id and i.criterion = j.criterion and i.delta = j.delta group by 1, 2, 3),
 f as (select run_id, criterion, delta, max(case when br = 1 and nr <> 1 then 1 else 0 end) flip from x group by 1, 2, 3)
select k.criterion, k.delta, round(avg(flip), 6) as reversal_rate, round(avg(1 - 4.0 * dis / (n * (n - 1))), 6) as mean_tau, count(*) as runs from k join f on f.run_id = k.run_id and f.criterion = k.criterion and f.delta = k.delta group by 1, 2
""")
def h07(t):
    return r(A.weight_sensitivity(scored(t).select("run_id", "staff_id", "cand", *A.CRITERIA)))


@query("h07_flip_distance", _SC + """
, t as (select *, 0.0::double + phi * 0.45::double + omega * 0.15::double + psi * 0.30::double + p * 0.10::double ts from sd),
 l as (select * from (select *, row_number() over (partition by run_id order by round(least(1, greatest(0, ts)), 9) desc, staff_id, cand desc) rn from t) where rn = 1),
 j as (select t.run_id, t.cand, l.ts - t.ts d0, l.phi - t.phi a1, l.omega - t.omega a2, l.psi - t.psi a3, l.p - t.p a4 from t join l on t.run_id = l.run_id and t.cand <> l.cand),
 q as (select run_id, 'phi' criterion, 0.45 w, -d0 / nullif(case when abs(a1 - (a2 * 0.15 + a3 * 0.30 + a4 * 0.10) / 0.55) > 1e-12 then a1 - (a2 * 0.15 + a3 * 0.30 + a4 * 0.10) / 0.55 end, 0) x from j union all
   select run_id, 'omega', 0.15, -d0 / case when abs(a2 - (a1 * 0.45 + a3 * 0.30 + a4 * 0.10) / 0.85) > 1e-12 then a2 - (a1 * 0.45 + a3 * 0.30 + a4 * 0.10) / 0.85 end from j union all
   select run_id, 'psi', 0.30, -d0 / case when abs(a3 - (a1 * 0.45 + a2 * 0.15 + a4 * 0.10) / 0.70) > 1e-12 then a3 - (a1 * 0.45 + a2 * 0.15 + a4 * 0.10) / 0.70 end from j union all
   select run_id, 'p', 0.10, -d0 / case when abs(a4 - (a1 * 0.45 + a2 * 0.15 + a3 * 0.30) / 0.90) > 1e-12 then a4 - (a1 * 0.45 + a2 * 0.15 + a3 * 0.30) / 0.90 end from j)
select run_id, criterion, round(min(abs(x)) + 1e-9, 6) as flip_distance from q where abs(x) <= 0.5 + 1e-9 and x + w between -1e-9 and 1 + 1e-9 group by 1, 2
""")
def h07b(t):
    out = A.flip_distance(scored(t).select("run_id", "staff_id", "cand", *A.CRITERIA))
    return out.withColumn("flip_distance", F.round(F.col("flip_distance") + 1e-9, 6))


@query("m18_choice_model")
def m18(t):
    s = scored(t)
    dearest = s.groupBy("run_id").agg(F.max_by("cand", F.struct(F.col("utilisation"), F.col("cand"))).alias("_pick"))
    df = s.join(dearest, "run_id").withColumn("chosen", F.col("cand") == F.col("_pick"))
    beta, weights, ll = A.choice_model(df, "chosen")
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(beta[c]).alias("beta"), F.lit(weights[c]).alias("weight")) for c in A.CRITERIA])
    return r(t.spark.range(1).select(F.inline(rows)).withColumn("log_likelihood", F.lit(ll)), 4)
