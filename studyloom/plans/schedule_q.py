"""Queries over intervals, eligibility and ranking (inventory W01-W04, W11, J09-J11, J18-J21, F04-F07, F10, A56-A59, A73)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import intervals as I
from ..operators import scheduling as G
from .registry import query
from .scalar_q import NOW
from .series_q import r


def blocks(t, kinds=None):
    """Events as one-hour blocks on a whole-second axis."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = t.events if kinds is None else t.events.where(F.col("event_type").isin(*kinds))
    return e.select("user_id", "event_id", at.alias("start"), (at + 3600).alias("end"))


_BL = 'bl as (select user_id, event_id, event_type, cast(floor(epoch_us(ts) / 1000000) as bigint) s, cast(floor(epoch_us(ts) / 1000000) as bigint) + 3600 e from events)'
_MERGE = """m{n} as (select user_id, s, e, max(e) over (partition by user_id order by s, e, event_id rows between unbounded preceding and 1 preceding) pe, event_id from bl where {w}),
 i{n} as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by user_id order by s, e, event_id) isl from m{n}),
 u{n} as (select user_id, isl, min(s) s, max(e) e, count(*) k from i{n} group by 1, 2)"""


@query("w04_interval_merge", f"with {_BL}, {_MERGE.format(n=0, w='true')}" + """
select user_id, cast(isl as bigint) as island, s as start, e as "end", k as blocks from u0
""")
def w04(t):
    return I.merge_intervals(blocks(t), ["user_id"], "event_id")


@query("j09_interval_overlap", f"with {_BL}" + """
select a.user_id, a.event_id as id_a, b.event_id as id_b from bl a join bl b on a.user_id = b.user_id and a.s < b.e and b.s < a.e and a.event_type = 'view' and b.event_type in ('signup', 'error')
""")
def j09(t):
    a = blocks(t, ["view"]).withColumnRenamed("event_id", "id_a")
    b = blocks(t, ["signup", "error"]).withColumnRenamed("event_id", "id_b")
    return I.overlap_join(a, b, ["user_id"]).select("user_id", "id_a", "id_b")


def _half(df, seconds=1800):
    return df.withColumn("end", F.col("start") + seconds)


@query("j09_containment", f"with {_BL}, {_MERGE.format(n=0, w='event_type <> ' + repr('view'))}" + """
select a.user_id, a.event_id from bl a where event_type = 'view' and exists (select 1 from u0 where u0.user_id = a.user_id and u0.s <= a.s and a.s + 1800 <= u0.e)
""")
def j09b(t):
    cover = I.merge_intervals(blocks(t, ["click", "signup", "purchase", "error"]), ["user_id"], "event_id")
    return I.contained(_half(blocks(t, ["view"])), cover, ["user_id"], "event_id")


_FREE = f"""with {_BL}, u as (select distinct user_id from events), d as (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) dt),
 w as (select user_id, dt, epoch(dt)::bigint + 28800 ws, epoch(dt)::bigint + 61200 we from u cross join d where isodow(dt) <= 5),
 p as (select w.user_id, dt, ws, we, greatest(s, ws) s, least(e, we) e from w join bl on bl.user_id = w.user_id and s < we and e > ws),
 q as (select *, coalesce(max(e) over (partition by user_id, dt order by s, e rows between unbounded preceding and 1 preceding), ws) pe from p),
 fr as (select user_id, dt, pe s, s e from q where s > pe union all select w.user_id, w.dt, coalesce(mx, ws), we from w left join (select user_id, dt, max(e) mx from p group by 1, 2) x on x.user_id = w.user_id and x.dt = w.dt where coalesce(mx, ws) < we)
"""


def _free(t):
    b = blocks(t)
    work = I.working_days(b.groupBy("user_id").agg(F.lit(1).alias("_")), ["user_id"], "2024-01-01", "2024-01-31")
    return I.free_intervals(work, b, ["user_id"], "event_id")


@query("j18_free_intervals", _FREE + 'select user_id, dt as day, s as start, e as "end" from fr')
def j18(t):
    return _free(t)


@query("j18_first_slot", _FREE + "select user_id, min(s) as slot_start, min(s) + 31500 as slot_end from fr where e - s >= 31500 group by 1")
def j18b(t):
    return I.first_slot(_free(t), ["user_id"], F.lit(8 * 3600 + 2700).cast("long"))


def _snapshots(t):
    return t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("fetched_at"), (F.col("value") > 8).alias("sync_ok"))


@query("j20_latest_snapshot", """
with s as (select user_id, ts, value > 8 ok, row_number() over (partition by user_id order by ts desc, value > 8 desc) rn from events where event_type = 'purchase')
select c_custkey as user_id, epoch_us(ts) as fetched_us, ok as sync_ok, case when ts is null then 'missing' else 'present' end as snapshot_state from customer left join s on s.user_id = c_custkey and rn = 1
""")
def j20(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"))
    out = I.latest_snapshot(_snapshots(t), people, "user_id", "fetched_at", ["sync_ok"])
    return out.select("user_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), "sync_ok", "snapshot_state")


_EV = f"""with {_BL}, s as (select user_id, value > 8 ok, row_number() over (partition by user_id order by ts desc, value > 8 desc) rn from events where event_type = 'purchase'),
 x as (select a.user_id, a.event_id, a.s, count(b.event_id) n from bl a left join bl b on a.user_id = b.user_id and a.s < b.e and b.s < a.s + 1800 and b.event_type = 'signup' where a.event_type = 'view' group by all)
select x.user_id, event_id, n as conflicts, case when not coalesce(ok, false) then 'insufficient' when n > 0 then 'conflict' when s.ok and not (x.s % 86400 >= 28800 and x.s % 86400 + 1800 <= 61200) then 'insufficient' else 'clear' end as evidence
from x left join s on s.user_id = x.user_id and rn = 1
"""


@query("j19_evidence_state", _EV)
def j19(t):
    snap = I.latest_snapshot(_snapshots(t), t.events.select("user_id").distinct(), "user_id", "fetched_at", ["sync_ok"])
    tod = F.col("start") % 86400
    return I.evidence(_half(blocks(t, ["view"])), blocks(t, ["signup"]), snap, ["user_id"], "event_id", (tod >= 28800) & (tod + 1800 <= 61200))


@query("f10_resource_checks", f"with {_BL}, {_MERGE.format(n=0, w='event_type = ' + repr('click'))}, {_MERGE.format(n=1, w='event_type = ' + repr('error'))}" + """
, v as (select user_id, event_id, s, s + 1200 e from bl where event_type = 'view')
select user_id, event_id, case when not exists (select 1 from u0 where u0.user_id = v.user_id) then 'not_applicable' when exists (select 1 from u0 where u0.user_id = v.user_id and u0.s <= v.s and v.e <= u0.e) then 'pass' else 'fail' end as offered_times,
  case when event_id % 3 <> 0 or not exists (select 1 from u1 where u1.user_id = v.user_id) then 'not_applicable' when exists (select 1 from u1 where u1.user_id = v.user_id and u1.s <= v.s and v.e <= u1.e) then 'pass' else 'fail' end as clinician_shift,
  case when event_id % 2 <> 0 or not exists (select 1 from bl where bl.user_id = v.user_id and event_type = 'signup') then 'not_applicable'
    when exists (select 1 from bl where bl.user_id = v.user_id and event_type = 'signup' and bl.s < v.e and v.s < bl.e) then 'fail' else 'pass' end as lab_room from v
""")
def f10(t):
    v = _half(blocks(t, ["view"]), 1200).withColumn("needs_shift", F.col("event_id") % 3 == 0).withColumn("in_lab", F.col("event_id") % 2 == 0)
    offered = I.merge_intervals(blocks(t, ["click"]), ["user_id"], "event_id")
    shifts = I.merge_intervals(blocks(t, ["error"]), ["user_id"], "event_id")
    lab = I.merge_intervals(blocks(t, ["signup"]), ["user_id"], "event_id")
    return I.resource_checks(v, offered, shifts, lab, "user_id", "event_id")


_GRID = f"""with {_BL}, u as (select distinct user_id from events), kn as (select distinct user_id from events where value > 250),
 g as (select user_id, dt, sl from u cross join (select cast(unnest(generate_series(date '2024-01-08', date '2024-01-12', interval 1 day)) as date) dt) cross join (select unnest(generate_series(16, 35)) k),
   lateral (select epoch(dt)::bigint // 1800 + k sl)),
 bs as (select distinct user_id, unnest(generate_series(s // 1800, (e - 1) // 1800)) sl from bl),
 st as (select g.user_id, dt as day, g.sl as slot, case when kn.user_id is null then 'unknown' when bs.sl is not null then 'busy' else 'free' end as state from g left join kn using (user_id) left join bs on bs.user_id = g.user_id and bs.sl = g.sl)
"""


def _grid(t):
    return I.slot_grid(t.events.select("user_id").distinct(), "user_id", blocks(t), t.events.where("value > 250").select("user_id").distinct(), "2024-01-08", "2024-01-12")


@query("a59_availability_grid", _GRID + "select * from st")
def a59(t):
    return _grid(t)


@query("a59_slot_counts", _GRID + """
select day, slot, count(*) filter (state = 'free') as free, count(*) filter (state = 'busy') as busy, count(*) filter (state = 'unknown') as unknown, round(count(*) filter (state <> 'unknown') / cast(count(*) as double), 6) as coverage from st group by 1, 2
""")
def a59b(t):
    return r(I.slot_counts(_grid(t)))


_SIG = f"""with {_BL}, g as (select user_id, make_date(cast(s // 86400 as integer)) as day, count(*) filter (event_type in ('view', 'click')) busy, count(*) filter (event_type = 'signup') tentative,
  count(*) filter (event_type in ('purchase', 'error')) free, count(*) filter (event_id % 5 = 0) named, count(*) items, min(s) earliest, max(e) latest from bl group by 1, 2),
 f as (select *, busy + 0.5::double * tentative density, least(0.75::double, 0.35::double + 0.05::double * items) confidence from g)
"""


def _signals(t):
    kind = F.when(F.col("event_type").isin("view", "click"), "busy").when(F.col("event_type") == "signup", "tentative").otherwise("free")
    e = t.events.select("event_id", kind.alias("status"))
    items = blocks(t).join(e, "event_id").withColumn("named", F.col("event_id") % 5 == 0).withColumn("day", F.date_from_unix_date(F.floor(F.col("start") / 86400).cast("int")))
    return I.day_signals(items, "user_id", "status")


@query("a58_day_signals", _SIG + "select user_id, day, busy, tentative, free, named, items, earliest, latest, density, round(confidence, 6) as confidence from f")
def a58(t):
    return _signals(t).withColumn("confidence", F.round("confidence", 6))


@query("a58_joint_signals", _SIG + "select day, count(*) as people, sum(density) as density, round(avg(confidence), 6) as confidence from f group by 1")
def a58b(t):
    return r(I.joint_signals(_signals(t)))


_CAND = """
with c as (select l_orderkey run_id, l_suppkey staff_id, o_custkey family_id, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, cast(l_shipdate as date) ship, cast(o_orderdate as date) od, o_orderpriority,
  l_extendedprice from lineitem join orders on l_orderkey = o_orderkey)
"""


def cand(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("staff_id"), F.col("o_custkey").alias("family_id"), "l_linenumber", "l_partkey", "l_quantity", "l_discount",
                    "l_tax", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship"), F.to_date("o_orderdate").alias("od"), "o_orderpriority", "l_extendedprice", "o_orderstatus")


@query("f04_eligibility", _CAND + """
, g as (select *, case when (staff_id + family_id) % 23 = 0 then 'family_exclusion' when l_partkey % 7 = 0 then 'missing_credential' when staff_id % 9 = 0 and l_quantity > 40 then 'onboarding_cap' when l_returnflag = 'R' then 'calendar_unavailable'
   when isodow(ship) > 5 then 'no_working_hours_in_window' when l_tax > 0.07 then 'no_open_slot' when l_discount > 0.09 then 'calendar_clash' end fail_reason from c),
 p as (select run_id, count(*) filter (fail_reason is null) n from g group by 1)
select run_id, staff_id, l_linenumber, l_partkey, fail_reason, fail_reason is null as passed, n as n_passed, n = 0 and coalesce(fail_reason in ('calendar_unavailable', 'calendar_clash'), false) as rescued from g join p using (run_id)
""")
def f04(t):
    gates = [("family_exclusion", (F.col("staff_id") + F.col("family_id")) % 23 != 0), ("missing_credential", F.col("l_partkey") % 7 != 0),
             ("onboarding_cap", ~((F.col("staff_id") % 9 == 0) & (F.col("l_quantity") > 40))), ("calendar_unavailable", F.col("l_returnflag") != "R"),
             ("no_working_hours_in_window", F.weekday("ship") < 5), ("no_open_slot", F.col("l_tax") <= 0.07), ("calendar_clash", F.col("l_discount") <= 0.09)]
    return G.eligibility(cand(t), gates, ("calendar_unavailable", "calendar_clash")).select("run_id", "staff_id", "l_linenumber", "l_partkey", "fail_reason", "passed", "n_passed", "rescued")


@query("f05_policy_gates", _CAND + """
, s as (select *, l_returnflag = 'A' so, count(*) filter (l_returnflag = 'A') over (partition by run_id) n from c)
select run_id, staff_id, l_linenumber, l_partkey, n - cast(so as integer) > 0 as has_partner,
  case when staff_id % 11 = 0 and l_quantity > 25 then 'special_certification' when l_returnflag = 'R' then 'reliability' when l_returnflag = 'N' and not n - cast(so as integer) > 0 then 'in_training_unpaired'
    when isodow(ship) - 1 = staff_id % 5 then 'lab_day' when isodow(ship) = 5 then 'friday' when l_discount > 0.08 then 'calendar_conflict' when l_tax > 0.06 then 'resource_ceiling' end as gate from s
""")
def f05(t):
    df = G.partner_available(cand(t).withColumn("signed_off", F.col("l_returnflag") == "A"), ["run_id"], "signed_off")
    gate = G.first_failure([
        ("special_certification", ~((F.col("staff_id") % 11 == 0) & (F.col("l_quantity") > 25))), ("reliability", F.col("l_returnflag") != "R"),
        ("in_training_unpaired", (F.col("l_returnflag") != "N") | F.col("has_partner")), ("lab_day", F.weekday("ship") != F.col("staff_id") % 5),
        ("friday", F.weekday("ship") != 4), ("calendar_conflict", F.col("l_discount") <= 0.08), ("resource_ceiling", F.col("l_tax") <= 0.06)])
    return df.select("run_id", "staff_id", "l_linenumber", "l_partkey", "has_partner", gate.alias("gate"))


@query("f06_routing_rules", """
with o as (select o_orderkey, case o_orderpriority when '1-URGENT' then '9mo' when '2-HIGH' then '12mo' when '3-MEDIUM' then '24mo' when '4-NOT SPECIFIED' then '36mo' else '6mo' end checkpoint, cast(o_orderdate as date) d, o_custkey from orders)
select o_orderkey, checkpoint, case when checkpoint = '36mo' then 'manual' when checkpoint = '24mo' then 'remote'
  when checkpoint = '9mo' and d not between d + cast(o_custkey % 60 as integer) - 45 and d + cast(o_custkey % 60 as integer) + 30 then 'escalate_window'
  when checkpoint = '12mo' and d not between d + cast(o_custkey % 60 as integer) - 20 and d + cast(o_custkey % 60 as integer) + 60 then 'escalate_window'
  when o_custkey % 10 = 0 and not o_orderkey % 2 = 0 then 'escalate_special' else 'score' end as route from o
""")
def f06(t):
    p = F.col("o_orderpriority")
    cp = F.when(p == "1-URGENT", "9mo").when(p == "2-HIGH", "12mo").when(p == "3-MEDIUM", "24mo").when(p == "4-NOT SPECIFIED", "36mo").otherwise("6mo")
    v = t.orders.select("o_orderkey", cp.alias("checkpoint"), F.to_date("o_orderdate").alias("d"), "o_custkey")
    rows = F.array(*[F.struct(F.lit(n).alias("checkpoint"), F.lit(b).alias("window_before"), F.lit(a).alias("window_after")) for n, b, a in (("9mo", 45, 30), ("12mo", 20, 60))])
    windows = t.spark.range(1).select(F.inline(rows))  # configured windows
    out = G.route(v, "checkpoint", F.col("d"), F.date_add("d", (F.col("o_custkey") % 60).cast("int")), windows, F.col("o_custkey") % 10 == 0, F.col("o_orderkey") % 2 == 0)
    return out.select("o_orderkey", "checkpoint", "route")


@query("j10_candidate_pool", """
with h as (select l_suppkey staff_id, o_custkey family_id, count(*) n_prior from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1, 2),
 l as (select l_suppkey staff_id, sum(l_quantity) / 10.0 hours from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1)
select distinct o_orderkey as run_id, l_suppkey as staff_id, o_custkey as family_id, coalesce(n_prior, 0) as n_prior, round(coalesce("hours", 0), 4) as committed_hours, s_nationkey as site
from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey left join h on h.staff_id = l_suppkey and h.family_id = o_custkey left join l on l.staff_id = l_suppkey where o_orderstatus = 'O'
""".replace("sum(l_quantity) / 10.0 hours", 'sum(l_quantity) / 10.0 as "hours"'))
def j10(t):
    c = cand(t)
    closed = c.where("o_orderstatus = 'F'")
    history = closed.groupBy("staff_id", "family_id").agg(F.count(F.lit(1)).alias("n_prior"))
    load = closed.groupBy("staff_id").agg((F.sum("l_quantity") / 10.0).alias("committed_hours"))
    visits = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("family_id"))
    members = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("staff_id")).distinct().join(
        t.supplier.select(F.col("s_suppkey").alias("staff_id"), F.col("s_nationkey").alias("site")), "staff_id")
    return G.candidate_pool(visits, members, history, load).withColumn("committed_hours", F.round("committed_hours", 4))


@query("j11_best_pairs", """
with p as (select s_nationkey site, s_suppkey staff, (s_suppkey * 7 % 100) / 100.0::double phi, (s_suppkey * 13 % 100) / 100.0::double omega, (s_suppkey * 29 % 100) / 100.0::double psi, (s_suppkey * 31 % 100) / 100.0::double p from supplier),
 sl as (select distinct s_nationkey site, s_suppkey staff, l_linenumber slot from lineitem join supplier on l_suppkey = s_suppkey where l_quantity > 44),
 pr as (select a.site, a.staff a, b.staff b, round(0.45 * greatest(a.phi, b.phi) + 0.15 * greatest(a.omega, b.omega) + 0.10 * greatest(a.p, b.p) + 0.30 * (a.psi + b.psi) / 2, 9) score, min(x.slot) first_slot
   from p a join p b on a.site = b.site and a.staff < b.staff join sl x on x.site = a.site and x.staff = a.staff join sl y on y.site = b.site and y.staff = b.staff and y.slot = x.slot group by all),
 k as (select *, row_number() over (partition by site order by score desc, a, b) place from pr)
select site, a, b, score, cast(place as integer) as place, first_slot from k where place <= 3
""")
def j11(t):
    k = F.col("s_suppkey")
    people = t.supplier.select(F.col("s_nationkey").alias("site"), k.alias("staff"), (k * 7 % 100 / 100.0).alias("phi"), (k * 13 % 100 / 100.0).alias("omega"),
                               (k * 29 % 100 / 100.0).alias("psi"), (k * 31 % 100 / 100.0).alias("p"))
    free = t.lineitem.where("l_quantity > 44").join(t.supplier, F.col("l_suppkey") == k).select(F.col("s_nationkey").alias("site"), k.alias("staff"), F.col("l_linenumber").alias("slot")).distinct()
    return G.best_pairs(people, "site", "staff", free, 3)


@query("j21_name_resolution", """
with a as (select s_suppkey id, unnest([cast(s_suppkey as varchar), lower(s_name), 'first' || (s_suppkey % 60)]) key from supplier), u as (select key, min(id) id from (select distinct * from a) group by 1 having count(*) = 1),
 n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 4 when 0 then ' ' || l_suppkey when 1 then upper('Supplier#' || lpad(cast(l_suppkey as varchar), 9, '0')) when 2 then 'First' || (l_suppkey % 60) else 'nobody' end written from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, written, u.id as person from n left join u on u.key = lower(trim(written))
""")
def j21(t):
    k, s = F.col("l_linenumber") % 4, F.col("l_suppkey")
    written = (F.when(k == 0, F.concat(F.lit(" "), s.cast("string"))).when(k == 1, F.upper(F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0"))))
               .when(k == 2, F.concat(F.lit("First"), (s % 60).cast("string"))).otherwise("nobody"))
    names = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", written.alias("written"))
    people = t.supplier.withColumn("person", F.col("s_suppkey"))
    return G.resolve_names(names, "written", people, "person", [F.col("s_suppkey").cast("string"), F.col("s_name"), F.concat(F.lit("First"), (F.col("s_suppkey") % 60).cast("string"))])


@query("w01_ranked_candidates", _CAND + """
, k as (select *, row_number() over w rn, lead(s) over w nx, lag(s) over w pv from (select *, l_extendedprice / 100000.0 s from c) window w as (partition by run_id order by s desc, staff_id, l_partkey, l_linenumber, l_quantity))
select run_id, staff_id, l_partkey, l_linenumber, s as score, rn as rank_position, round(s - nx, 7) as gap_to_next, rn <= 3 as in_shortlist, coalesce((rn = 1 and round(s - nx, 9) < 0.05) or (rn = 2 and round(pv - s, 9) < 0.05), false) as review_band_flag from k
""")
def w01(t):
    df = cand(t).select("run_id", "staff_id", "l_partkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 100000.0).alias("score"))
    return G.rank_candidates(df, "run_id", "score", "staff_id", ["l_partkey", "l_linenumber", "l_quantity"]).drop("l_quantity").withColumn("gap_to_next", F.round("gap_to_next", 7))


@query("w02_tie_break", _CAND + """
, m as (select *, max(floor(l_quantity / 10)) over (partition by run_id) top from c), ti as (select *, case when l_linestatus = 'F' then 1 else 0 end p, case when family_id % 2 = 0 then l_linenumber else -l_linenumber end k from m where floor(l_quantity / 10) = top),
 b as (select *, max(p) over (partition by run_id) mp from ti), b2 as (select *, max(k) over (partition by run_id, p) mk from b)
select run_id, count(*) as n_tied, case when count(*) < 2 then 'none' when count(*) filter (p = mp) = 1 then 'protocol_continuity' when count(*) filter (p = mp and k = mk) = 1 then 'family_history' else 'random' end as tie_rule,
  case when count(*) filter (p = mp and k = mk) = 1 then max(staff_id) filter (p = mp and k = mk) end as winner from b2 group by 1
""")
def w02(t):
    df = cand(t).select("run_id", "staff_id", F.floor(F.col("l_quantity") / 10).cast("double").alias("score"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("p"),
                        F.col("l_linenumber").alias("k"), F.when(F.col("family_id") % 2 == 0, 1).otherwise(-1).alias("sigma"))
    out = G.break_ties(df, "run_id", "score", "staff_id", "p", "k", "sigma", S.DEFAULT.seed)
    return out.withColumn("winner", F.when(F.col("tie_rule") != "random", F.col("winner")))


CHECKPOINTS = [("y1", 365, 60, 90), ("y2", 730, 60, 90), ("y3", 1095, 60, 90), ("y4", 1460, 60, 120), ("y5", 1825, 60, 120)]


@query("w03_next_checkpoint", f"""
with a as (select o_custkey f, min(cast(o_orderdate as date)) anchor from orders group by 1), cp as (select * from (values ('y1', 365, 60, 90, 1), ('y2', 730, 60, 90, 2), ('y3', 1095, 60, 90, 3), ('y4', 1460, 60, 120, 4), ('y5', 1825, 60, 120, 5)) v(n, o, b, a, i)),
 dn as (select distinct o_custkey f, 'y' || (date_diff('day', anchor, cast(o_orderdate as date)) // 365) n from orders join a on a.f = o_custkey where o_orderstatus = 'F' and date_diff('day', anchor, cast(o_orderdate as date)) >= 365),
 lf as (select a.f, anchor, cp.*, row_number() over (partition by a.f order by i) rn, count(*) over (partition by a.f) nl from a cross join cp where not exists (select 1 from dn where dn.f = a.f and dn.n = cp.n)),
 x as (select a.f, n, 5 - coalesce(nl, 0) done, a.anchor + o - b s, a.anchor + o + lf.a e, b + lf.a span from a left join lf on lf.f = a.f and rn = 1),
 y as (select *, case when n is null then 'complete' when date '{NOW}' > e then 'overdue' when date '{NOW}' < s then 'upcoming' when e - date '{NOW}' <= 14 then 'closing' else 'open' end st from x)
select f as family, n as checkpoint, cast(done as integer) as completed, s as window_start, e as window_end, st as status, cast(case when date '{NOW}' < s then s - date '{NOW}' else e - date '{NOW}' end as integer) as days_remaining,
  round(case when st = 'overdue' then 1.0 when st in ('open', 'closing') then greatest(0.0, least(1.0, 1.0 - (e - date '{NOW}') / cast(span as double))) else 0.0 end, 6) as urgency,
  case st when 'overdue' then 0 when 'closing' then 1 when 'open' then 2 when 'upcoming' then 3 when 'unknown' then 4 else 5 end as tier from y
""")
def w03(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("family")).agg(F.min(F.to_date("o_orderdate")).alias("anchor"))
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("family"), F.to_date("o_orderdate").alias("d")).join(a, "family")
    year = F.floor(F.datediff("d", "anchor") / 365)
    done = o.where(year >= 1).select("family", F.concat(F.lit("y"), year.cast("string")).alias("checkpoint"))
    return r(G.next_checkpoint(a, done, "family", "anchor", CHECKPOINTS, NOW))


@query("w11_history_features", _CAND + """
select staff_id, family_id, count(*) filter (ship <= date '1999-06-01') as n_prior, cast(date '1999-06-01' - max(ship) filter (ship <= date '1999-06-01') as integer) as days_since,
  coalesce(bool_or(ship <= date '1999-06-01' and o_orderpriority = '2-HIGH'), false) as did_previous, count(*) filter (ship between date '1999-05-26' and date '1999-06-01') as this_week from c group by 1, 2
""")
def w11(t):
    return G.history_features(cand(t), ["staff_id", "family_id"], "ship", "o_orderpriority", "2-HIGH", "1999-06-01")


@query("a56_fairness_veto", _CAND + """
, tr as (select staff_id, l_tax * 1000 m from c where l_tax > 0 and date '1999-06-01' - ship between 0 and 28), mi as (select staff_id, sum(m) mine, count(*) k from tr group by 1), te as (select sum(mine) team, sum(k) nt, count(*) dr from mi),
 cp as (select s_suppkey staff_id, 10.0 + s_suppkey % 7 cap from supplier), tc as (select sum(cap) tcap from cp)
select run_id * 10 + l_linenumber as candidate_id, c.staff_id, l_partkey, concat_ws(',', case when l_quantity / 45.0 > 1 then 'over_capacity' end,
  case when nt >= 8 and dr >= 3 and (coalesce(mine, 0) + l_tax * 1000) / (team + l_tax * 1000) > 1.4 * cap / tcap and l_tax * 1000 > team / nt then 'travel_share_cap' end) as violations
from c join cp using (staff_id) left join mi using (staff_id), te, tc
""")
def a56(t):
    c = cand(t)
    trips = c.select("staff_id", (F.col("l_tax") * 1000).alias("travel_minutes"), F.col("ship").alias("at"))
    capacity = t.supplier.select(F.col("s_suppkey").alias("staff_id"), (10.0 + F.col("s_suppkey") % 7).alias("capacity_hours"))
    cands = c.select(F.struct(F.col("run_id") * 10 + F.col("l_linenumber"), "l_partkey").alias("candidate_id"), "staff_id", (F.col("l_tax") * 1000).alias("trip_minutes"), (F.col("l_quantity") / 45.0).alias("utilisation"))
    return G.fairness_veto(cands, trips, capacity, "1999-06-01").select(F.col("candidate_id.col1").alias("candidate_id"), "staff_id", F.col("candidate_id.l_partkey").alias("l_partkey"), "violations")


@query("a57_systemic_failure", """
with l as (select user_id, max(ts) last from events group by 1), a as (select user_id % 4 pool, case when user_id % 11 = 0 then 'sync_failed' when epoch(timestamp '2024-01-31 00:00:00') - epoch(last) <= 14400 then 'fresh'
   when epoch(timestamp '2024-01-31 00:00:00') - epoch(last) <= 86400 then 'stale' else 'expired' end f from l)
select pool, count(*) as sources, count(*) filter (f in ('expired', 'sync_failed')) as bad, case when count(*) filter (f in ('expired', 'sync_failed')) / cast(count(*) as double) > 0.2
  then 'calendar_sync_degraded:' || count(*) filter (f in ('expired', 'sync_failed')) || '/' || count(*) end as halt from a group by 1
""")
def a57(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    st = last.select((F.col("user_id") % 4).alias("pool"), S.freshness_class(age, F.lit(200), F.col("user_id") % 11 != 0).alias("freshness"))
    return G.systemic_failure(st, ["pool"])


@query("a73_certification_matrix", """
with x as (select l_suppkey person, p_brand a, max(case when l_returnflag = 'A' and l_quantity > 30 then 2 when l_returnflag = 'N' then 1 else 0 end) lv from lineitem join part on l_partkey = p_partkey group by 1, 2),
 g as (select person, coalesce(max(lv) filter (a = 'Brand#1'), 0) a1, coalesce(max(lv) filter (a = 'Brand#2'), 0) a2, coalesce(max(lv) filter (a = 'Brand#3'), 0) a3 from x group by 1)
select person, ['none', 'training', 'reliable'][a1 + 1] as "a_Brand#1", ['none', 'training', 'reliable'][a2 + 1] as "a_Brand#2", ['none', 'training', 'reliable'][a3 + 1] as "a_Brand#3",
  (a1 = 2)::int + (a2 = 2)::int + (a3 = 2)::int as held, a1 = 2 and a2 = 2 and a3 = 2 as holds_all from g
""")
def a73(t):
    st = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30), "reliable").when(F.col("l_returnflag") == "N", "training").otherwise("none")
    rec = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("person"), F.col("p_brand").alias("a"), st.alias("status"))
    return G.certification_matrix(rec, "person", "a", "status", ["Brand#1", "Brand#2", "Brand#3"])


