"""Queries over alignment, agreement and response quality (inventory J03, A46-A48, A60-A63, A68, F03, F08-F09, W05-W06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import quality as Q
from .registry import query
from .series_q import r

TOL = 7200


def seconds(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def streams(t):
    e = t.events.select("user_id", F.floor(seconds("ts")).cast("long").alias("at"), "event_id", "event_type")
    a = e.where("event_type in ('view', 'click')").select("user_id", "at", F.col("event_id").alias("id_a"), F.col("event_type").alias("code_a"))
    b = e.where("event_type in ('signup', 'purchase', 'error')").select("user_id", "at", F.col("event_id").alias("id_b"), F.col("event_type").alias("code_b"))
    return a, b


_AL = f"""
with e as (select user_id, cast(floor(epoch(ts)) as bigint) tm, event_id, event_type from events), a as (select user_id, tm, event_id id_a, event_type code_a from e where event_type in ('view', 'click')),
 b as (select user_id, tm, event_id id_b, event_type code_b from e where event_type in ('signup', 'purchase', 'error')),
 c as (select a.user_id, id_a, a.tm at_left, id_b, b.tm at_right, code_a, code_b, b.tm - a.tm delta,
   row_number() over (partition by a.user_id, id_a order by abs(b.tm - a.tm), b.tm, case when b.tm <= a.tm then -id_b else id_b end) rn
   from a join b on a.user_id = b.user_id and abs(b.tm - a.tm) <= {TOL}),
 al as (select user_id, id_a, at_left, id_b, at_right, delta, code_a, code_b from c where rn = 1)
"""


def aligned(t):
    a, b = streams(t)
    return L.nearest_join(a, b, ["user_id"], "at", "id_a", "id_b", TOL)


@query("j03_nearest_join", _AL + "select user_id, id_a, at_left, id_b, at_right, delta from al")
def j03(t):
    return aligned(t)


@query("j03_reuse_counts", _AL + "select user_id, id_b, count(*) as uses from al group by 1, 2")
def j03b(t):
    return L.reuse_counts(aligned(t), ["user_id"], "id_b")


@query("a48_alignment_coverage", _AL + """
, na as (select user_id, count(*) n_left from a group by 1), nb as (select user_id, count(*) n_right from b group by 1),
 u as (select user_id, count(*) aligned, count(distinct id_b) right_used, max(abs(delta)) max_delta from al group by 1), ru as (select user_id, count(*) k from (select user_id, id_b from al group by 1, 2 having count(*) > 1) group by 1)
select user_id, n_left, n_right, coalesce(aligned, 0) as aligned, coalesce(right_used, 0) as right_used, coalesce(k, 0) as right_reused, max_delta,
  round(coalesce(aligned, 0) * 100.0 / n_left, 6) as left_pct, round(coalesce(right_used, 0) * 100.0 / n_right, 6) as right_pct
from na join nb using (user_id) left join u using (user_id) left join ru using (user_id)
""")
def a48(t):
    a, b = streams(t)
    return r(L.coverage(aligned(t), a, b, ["user_id"], "id_b"))


@query("a48_step_tolerance", _AL + """
, sa as (select user_id, quantile_cont(d, 0.5) step_a from (select user_id, tm - lag(tm) over (partition by user_id order by tm) d from (select distinct user_id, tm from a)) where d > 0 group by 1),
 sb as (select user_id, quantile_cont(d, 0.5) step_b from (select user_id, tm - lag(tm) over (partition by user_id order by tm) d from (select distinct user_id, tm from b)) where d > 0 group by 1)
select user_id, step_a, step_b, cast(ceil(greatest(step_a, step_b) / 2) as bigint) as tolerance from sa join sb using (user_id)
""")
def a48b(t):
    a, b = streams(t)
    return L.alignment_tolerance(a, b, ["user_id"], "at").select("user_id", F.col("step_a").cast("double").alias("step_a"), F.col("step_b").cast("double").alias("step_b"), "tolerance")


def _coded(t):
    q = F.col("quality").cast("string")
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", "lang", q.alias("a"), F.when(F.col("doc_id") % 29 == 0, None).otherwise((1 - F.col("toxic")).cast("string")).alias("b"), "n_chars")


_COD = """
with c as (select doc_id, lang, cast(quality as varchar) a, case when doc_id % 29 = 0 then null else cast(1 - toxic as varchar) end b, n_chars from labels join documents using (doc_id)),
 j as (select lang, a, b from c where a is not null and b is not null), k as (select lang, count(*) n, count(*) filter (a = b) g from j group by 1),
 m as (select lang, x, sum(ia) na, sum(ib) nb from (select lang, a x, 1 ia, 0 ib from j union all select lang, b, 0, 1 from j) group by 1, 2),
 p as (select lang, sum(na * nb) cr from m group by 1)
"""


@query("a46_agreement", _COD + """
select lang, n as eligible, cast(g as bigint) as agreeing, round(g / n, 6) as observed, round(cr / (cast(n as double) * n), 6) as expected,
  case when abs(1 - cr / (cast(n as double) * n)) >= 1e-12 then round((g / n - cr / (cast(n as double) * n)) / (1 - cr / (cast(n as double) * n)), 6) end as kappa,
  case when abs(1 - cr / (cast(n as double) * n)) < 1e-12 then 'undefined_expected_agreement_is_one' else 'ok' end as kappa_status from k join p using (lang)
""")
def a46(t):
    return r(L.agreement(_coded(t), "a", "b", ["lang"]))


@query("a46_jaccard", """
select lang, count(*) filter (quality = 0 and toxic = 1) as "both", count(*) filter (quality = 0 or toxic = 1) as either,
  round(count(*) filter (quality = 0 and toxic = 1) / nullif(cast(count(*) filter (quality = 0 or toxic = 1) as double), 0), 6) as jaccard from labels join documents using (doc_id) group by 1
""")
def a46b(t):
    df = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return r(L.jaccard(df, F.col("quality") == 0, F.col("toxic") == 1, ["lang"]))


@query("a47_disagreement_log", _COD + """
select doc_id, a as code_a, b as code_b, case when doc_id % 3 <> 0 then n_chars / 10.0 end as seconds,
  case when doc_id % 3 <> 0 then strftime(make_timestamp(cast(n_chars * 100000 as bigint)), '%H:%M:%S.') || lpad(cast((n_chars % 10) * 100 as varchar), 3, '0') end as at,
  case when doc_id % 3 = 0 then 'no time' else 'video time' end as time_status from c where a <> b
""")
def a47(t):
    sec = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 10.0)
    return L.disagreements(_coded(t), "a", "b", sec, None, ["doc_id"]).drop("delta")


@query("a68_partition_agreement", """
with l as (select case when o_orderpriority < '3' then 1 when o_orderpriority < '5' then 2 else 3 end a, case when o_orderstatus = 'F' then 'x' when o_orderpriority < '3' then 'y' else 'z' end b from orders),
 j as (select a, b, count(*) n from l group by 1, 2), s as (select sum(n * (n - 1) / 2.0) ab, sum(n) n from j), sa as (select sum(n * (n - 1) / 2.0) v from (select sum(n) n from j group by a)),
 sb as (select sum(n * (n - 1) / 2.0) v from (select sum(n) n from j group by b))
select cast(s.n as bigint) as n, round((ab - sa.v * sb.v / (s.n * (s.n - 1) / 2.0)) / ((sa.v + sb.v) / 2 - sa.v * sb.v / (s.n * (s.n - 1) / 2.0)), 6) as ari from s, sa, sb
""")
def a68(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    df = t.orders.select(F.when(p < "3", 1).when(p < "5", 2).otherwise(3).alias("a"), F.when(s == "F", "x").when(p < "3", "y").otherwise("z").alias("b"))
    return r(L.adjusted_rand(df, "a", "b"))


@query("w05_burst_detection", """
with e as (select event_id, user_id, epoch_us(ts) / 1e6 tm from events),
  c as (select x.event_id, x.user_id, x.tm, (select count(*) from e y where y.user_id = x.user_id and y.tm between x.tm - 5400 and x.tm) n from e x)
select event_id, exists (select 1 from c y where y.user_id = c.user_id and y.tm between c.tm and c.tm + 5400 and y.n >= 3) as in_burst from c
""")
def w05(t):
    e = t.events.select("event_id", "user_id", seconds("ts").alias("at"))
    return Q.flag_bursts(e, ["user_id"], "at", "event_id", 5400, 3).select("event_id", "in_burst")


@query("w06_arrival_quantile", """
with g as (select user_id % 3 as source, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) gap from events)
select source, round(quantile_cont(gap, 0.01), 4) as q, round(least(900, greatest(60, quantile_cont(gap, 0.01))), 4) as window_seconds from g where gap > 0 group by 1
""")
def w06(t):
    e = t.events.select("event_id", "user_id", seconds("ts").alias("at"))
    gaps = Q.arrival_gaps(e, ["user_id"], "at", "event_id").withColumn("source", F.col("user_id") % 3)
    return r(Q.burst_window(gaps, ["source"]), 4)


def features(t):
    """Users as respondents: section times and answer spread come from their events."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    e = t.events.withColumn("k", k)

    def section(kind):
        return F.sum(F.when(F.col("event_type") == kind, v)) / 100.0

    g = e.groupBy("user_id").agg(
        section("view").alias("t_view"), section("click").alias("t_click"), section("signup").alias("t_signup"), section("purchase").alias("t_purchase"),
        F.stddev_samp(F.when(F.col("event_type") == "view", F.col("k"))).alias("sd_view"), F.stddev_samp(F.when(F.col("event_type") == "click", F.col("k"))).alias("sd_click"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.max("k").alias("kmax"), F.min("k").alias("kmin"), F.count(F.lit(1)).alias("n"))
    u = F.col("user_id")
    return g.select(
        u.alias("uid"), F.when(u % 3 == 0, "trusted").otherwise("other").alias("source"), (u % 3 == 0).alias("is_reference"),
        (F.col("t_view") + F.col("t_click") + F.col("t_signup") + F.col("t_purchase")).alias("total_time"), "t_view", "t_click", "t_signup", "t_purchase", "sd_view", "sd_click",
        F.sha2(F.concat_ws("|", (F.col("n") % 9).cast("string"), F.col("errors").cast("string"), F.col("kmin").cast("string")), 256).alias("fingerprint"),
        F.least(F.lit(1.0), F.col("n") / 60.0).alias("answered_share"), (F.col("errors") > 20).alias("in_burst"), (F.col("kmax") / 100.0 - F.when(u % 4 == 0, 0).otherwise(0.1)).alias("similarity"),
        (F.col("kmin") >= 4).alias("branching_issue"), (F.col("n") > 84).alias("impossible"), (F.col("errors") < 6).alias("native_gate"))


SECTIONS, SDS = ["t_view", "t_click", "t_signup", "t_purchase"], ["sd_view", "sd_click"]

_FEAT = """
with e as (select *, cast(json_extract_string(props, '$.k') as integer) k from events),
 g as (select user_id u, sum(value) filter (event_type = 'view') / 100.0 t1, sum(value) filter (event_type = 'click') / 100.0 t2, sum(value) filter (event_type = 'signup') / 100.0 t3, sum(value) filter (event_type = 'purchase') / 100.0 t4,
   stddev_samp(k) filter (event_type = 'view') s1, stddev_samp(k) filter (event_type = 'click') s2, count(*) filter (event_type = 'error') er, max(k) kx, min(k) kn, count(*) n from e group by 1),
 f as (select *, (n % 9) || '|' || er || '|' || kn fp from g), q as (select quantile_cont(t1, 0.01) q1, quantile_cont(t2, 0.01) q2, quantile_cont(t3, 0.01) q3, quantile_cont(t4, 0.01) q4,
   quantile_cont(s1, 0.01) z1, quantile_cont(s2, 0.01) z2 from f where u % 3 = 0), d as (select fp from f group by 1 having count(*) > 1),
 ru as (select u uid, case when u % 3 = 0 then 'trusted' else 'other' end source, u % 3 = 0 is_reference, coalesce(round(t1 + t2 + t3 + t4, 2) < 11.57, false) "R1",
   coalesce(t1 < 7.85, false) or coalesce(t2 < 7.85, false) or coalesce(t3 < 7.85, false) or coalesce(t4 < 7.85, false) "R2",
   coalesce(t1 < q1, false) or coalesce(t2 < q2, false) or coalesce(t3 < q3, false) or coalesce(t4 < q4, false) "R3", coalesce(s1 <= z1, false) or coalesce(s2 <= z2, false) "R4",
   fp in (select fp from d) and least(1.0, n / 60.0) >= 0.8 "R5", er > 20 "R6", kx / 100.0 - case when u % 4 = 0 then 0 else 0.1 end > 0.9 "R7", kn >= 4 "R8", n > 84 "R9", er < 6 "R10" from f, q),
 ti as (select *, case when "R1" or "R2" or "R5" or "R8" or "R9" then 1 when "R3"::int + "R4"::int + "R6"::int + "R7"::int >= 2 then 2 when "R3"::int + "R4"::int + "R6"::int + "R7"::int = 1 then 3 else 4 end tier,
   concat_ws(',', case when "R1" then 'R1' end, case when "R2" then 'R2' end, case when "R3" then 'R3' end, case when "R4" then 'R4' end, case when "R5" then 'R5' end, case when "R6" then 'R6' end,
     case when "R7" then 'R7' end, case when "R8" then 'R8' end, case when "R9" then 'R9' end, case when "R10" then 'R10' end) triggered from ru)
"""


def rules(t):
    return Q.trust_rules(features(t), SECTIONS, SDS)


@query("a60_trust_rules", _FEAT + "select * from ti")
def a60(t):
    return rules(t)




@query("a62_rule_summary", _FEAT + " " + " union all ".join(
    f"""select source, count(*) as rows, 'R{i}' as rule, count(*) filter ("R{i}") as hits, round(count(*) filter ("R{i}" and is_reference) * 100.0 / nullif(count(*) filter (is_reference), 0), 6) as false_positive_pct from ti group by 1"""
    for i in range(1, 11)))
def a62(t):
    return r(Q.rule_summary(rules(t)))


@query("a62_tier_shares", _FEAT + "select source, tier, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by source), 6) as pct from ti group by 1, 2")
def a62b(t):
    return r(Q.tier_shares(rules(t)))


@query("a62_rules_long", _FEAT + "select uid, source, unnest(string_split(triggered, ',')) as rule from ti where triggered <> ''")
def a62c(t):
    return Q.rules_long(rules(t))


@query("f03_cohorts", _FEAT + """
, x as (select uid, unnest(list_filter(['all', case when tier >= 3 then 'kept' end, case when tier = 4 then 'clean' end, case when is_reference then 'reference' end,
  case when is_reference or tier = 4 then 'reference_or_clean' end], lambda v: v is not null)) cohort from ti) select cohort, count(*) as n, cast(sum(uid) as bigint) as uid_sum from x group by 1
""")
def f03(t):
    df = Q.cohorts(rules(t), [("all", F.lit(True)), ("kept", F.col("tier") >= 3), ("clean", F.col("tier") == 4), ("reference", F.col("is_reference")),
                              ("reference_or_clean", F.col("is_reference") | (F.col("tier") == 4))])
    return df.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("uid").alias("uid_sum"))


@query("a61_branching_audit", """
with p as (select p_partkey, p_size % 3 gate, case when p_partkey % 4 = 0 then p_name end follow, case when p_type = 'PROMO' then 'x' end a, case when p_size > 25 then 'y' end b, p_size from part)
select p_partkey, 'orphan_follow_up' as rule, '{"gate":' || gate || '}' as gate, '{"follow":"' || follow || '"}' as observed from p where gate <> 1 and follow is not null
union all select p_partkey, 'exclusive_pair', '{"a":"x"}', '{"b":"y"}' from p where a is not null and b is not null
union all select p_partkey, 'impossible_count', '{"p_size":' || p_size || '}', '{"p_size":' || p_size || '}' from p where p_size > 45
""")
def a61(t):
    df = t.part.select("p_partkey", (F.col("p_size") % 3).alias("gate"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("follow"),
                       F.when(F.col("p_type") == "PROMO", "x").alias("a"), F.when(F.col("p_size") > 25, "y").alias("b"), "p_size")
    return Q.branching_audit(df, "p_partkey", [{"gate": {"field": "gate", "equals": 1}, "follow_up": "follow"}], [("a", "b")], [("p_size", 45)])


_ITEMS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "note", "constant"]


def _items(t):
    return t.lineitem.withColumn("note", F.when(F.col("l_quantity") > 45, F.col("l_returnflag"))).withColumn("constant", F.when(F.col("l_quantity") > 1, "1").otherwise("0"))


_PROF = """
with l as (select *, case when l_quantity > 45 then l_returnflag end note, case when l_quantity > 1 then '1' else '0' end as constant from lineitem),
 c as (select 'l_quantity' item, cast(l_quantity as varchar) v from l union all select 'l_discount', cast(l_discount as varchar) from l union all select 'l_tax', cast(l_tax as varchar) from l union all
   select 'l_returnflag', l_returnflag from l union all select 'l_linestatus', l_linestatus from l union all select 'note', note from l union all select 'constant', constant from l),
 k as (select item, v, count(*) n from c group by 1, 2), m as (select item, v mode, n mn from (select *, row_number() over (partition by item order by n desc, v desc) rn from k where v is not null) where rn = 1),
 g as (select item, cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (v is not null), 0) as bigint) answered, bool_and(try_cast(v as double) is not null) filter (v is not null) nu, min(try_cast(v as double)) lo, max(try_cast(v as double)) hi, count(v) dv from k group by 1),
 pr as (select g.item, g.rows, answered, round((g.rows - answered) * 100.0 / g.rows, 6) as missing_pct, mode, round(mn * 100.0 / answered, 6) as mode_pct, case when nu then 'numeric' else 'text' end as kind,
   case when nu then lo end as low, case when nu then hi end as high, dv as distinct_values from g join m using (item))
"""


@query("a63_item_profile", _PROF + "select * from pr")
def a63(t):
    return r(Q.item_profile(_items(t), _ITEMS))


@query("f08_item_screening", _PROF + """
select item, case when missing_pct > 50 then 'missing' when mode_pct >= 95 then 'near_constant' when item = 'l_linestatus' then 'named' end as drop_reason from pr
""")
def f08(t):
    return Q.screen_items(Q.item_profile(_items(t), _ITEMS), 50, 95, ["l_linestatus"])


@query("f09_cohort_flow", """
select 0 as step, 'all' as name, count(*) as n from orders union all select 1, 'closed', count(*) filter (o_orderstatus = 'F') from orders
union all select 2, 'large', count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) from orders
union all select 3, 'not low', count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000 and o_orderpriority <> '5-LOW') from orders
""")
def f09(t):
    return Q.cohort_flow(t.orders, [("closed", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 100000), ("not low", F.col("o_orderpriority") != "5-LOW")])
