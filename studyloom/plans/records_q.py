"""Queries over record collapse, milestones and the flagship report (inventory 2.5, first part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import privacy as P
from ..functions import text as X
from ..operators import records as R
from .registry import query

RULES = R.StudyRules()


def study_records(t):
    """Events read as a longitudinal export: one row per participant contact, all text."""
    e, u = F.col("event_id"), F.col("user_id")
    race = F.when(e % 19 == 0, F.element_at(F.array(*[F.lit(str(i)) for i in (1, 2, 3, 4, 5, 7)]), (e % 6 + 1).cast("int"))).otherwise(
        F.when(u % 7 != 0, (u % 3 + 1).cast("string")))
    day = F.date_add(F.lit("2023-01-01").cast("date"), (u * 7 % 560).cast("int"))
    return t.events.select(
        F.lpad(u.cast("string"), 6, "0").alias("participant_id"), F.col("event_type").alias("event"), race.alias("race"),
        F.when(e % 997 == 0, "9").when(e % 487 == 0, "2").otherwise((u % 4).cast("string")).alias("status_code"),
        F.when(u % 3 == 1, "1.0").when(u % 3 == 2, "2").when(u % 6 == 3, "9").alias("eth"), F.when(e % 301 == 0, "1").when(e % 307 == 0, "0").alias("eth2"),
        F.when(e % 811 == 0, "1").otherwise("0").alias("exclude_flag"), F.when(e % 613 == 0, "1").otherwise("0").alias("review_flag"),
        F.when(e % 701 == 3, "bad-date").when(e % 499 == 1, F.date_format(F.date_add(day, 1), "MM/dd/yyyy"))
        .when(u % 11 != 0, F.date_format(day, "yyyy-MM-dd")).alias("visit_date"))


REC = """
with rec as (select lpad(cast(user_id as varchar), 6, '0') participant_id, event_type event,
    case when event_id % 19 = 0 then ['1','2','3','4','5','7'][event_id % 6 + 1] when user_id % 7 <> 0 then cast(user_id % 3 + 1 as varchar) end race,
    case when event_id % 997 = 0 then '9' when event_id % 487 = 0 then '2' else cast(user_id % 4 as varchar) end status_code,
    case when user_id % 3 = 1 then '1' when user_id % 3 = 2 then '2' when user_id % 6 = 3 then '9' end eth,
    case when event_id % 301 = 0 then '1' when event_id % 307 = 0 then '0' end eth2,
    event_id % 811 = 0 as ex, event_id % 613 = 0 as rv, event_id % 701 = 3 as bad,
    case when event_id % 701 = 3 then null when event_id % 499 = 1 then date '2023-01-01' + cast(user_id * 7 % 560 as integer) + 1
         when user_id % 11 <> 0 then date '2023-01-01' + cast(user_id * 7 % 560 as integer) end d from events),
col as (select participant_id, count(*) records, string_agg(distinct race, '|' order by race) raw_race, string_agg(distinct status_code, '|' order by status_code) raw_status,
    coalesce(bool_or(race in ('2','3','4')), false) minority, coalesce(bool_or(race = '5'), false) race_other, coalesce(bool_or(race = '7'), false) race_unexpected,
    count(distinct race) n_races, case when count(distinct status_code) = 1 then min(status_code) end status, count(distinct status_code) > 1 status_conflict,
    bool_or(status_code = '9') status_invalid, bool_or(ex) excluded_flag, bool_or(rv) review_flag,
    coalesce(bool_or(eth = '1'), false) or coalesce(bool_or(eth2 = '1'), false) pos, coalesce(bool_or(eth = '2'), false) or coalesce(bool_or(eth2 = '0'), false) neg,
    coalesce(bool_or(eth = '9'), false) state_unknown, min(d) first_date, bool_or(bad) invalid_date, count(distinct d) > 1 multiple_dates from rec group by 1),
st as (select *, case when pos then true when neg then false end state, pos and neg state_conflict from col),
dec0 as (select *, case when excluded_flag then false when status_conflict then null when status not in ('1','2') then false
    when first_date > date '2024-05-31' then false else true end included,
    case when excluded_flag then 'exclusion flag' when status_conflict then 'conflicting status' when status not in ('1','2') then 'status not enrolled'
    when first_date > date '2024-05-31' then 'after cut-off' else '' end reason from st),
dec as (select *, case when included and review_flag then 'review' when included then 'included' when included is null then 'unresolved' else 'excluded' end decision,
    case when included and not invalid_date and not multiple_dates and first_date is not null then case when first_date <= date '2023-04-01' then '2023-04-01'
      when first_date <= date '2023-08-01' then '2023-08-01' when first_date <= date '2023-12-01' then '2023-12-01'
      when first_date <= date '2024-04-01' then '2024-04-01' else 'AFTER_REPORTING_WINDOW' end end milestone from dec0),
cat as (select *, unnest(list_filter(['Total', case when minority then 'Minority' end, case when state then 'Hispanic' end], lambda x: x is not null)) category from dec)
"""


def decided(t):
    return R.decide(R.collapse(study_records(t), RULES), RULES)


@query("a01_ever_checked", """
select user_id, bool_or(event_type in ('view', 'click')) as looked, bool_or(event_type = 'purchase' and value > 100) as bought_big,
  bool_or(event_id % 90 = 0 or event_id % 70 = 0) as any_box from events group by 1
""")
def a01(t):
    boxes = [F.when(F.col("event_id") % 90 == 0, "1").otherwise("0"), F.when(F.col("event_id") % 70 == 0, "Yes")]
    return t.events.groupBy("user_id").agg(R.ever_coded(F.col("event_type"), ["view", "click"]).alias("looked"),
                                           R.ever((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("bought_big"),
                                           R.ever(R.any_ticked(boxes)).alias("any_box"))


@query("a02_stable_scalar", """
select user_id, case when count(distinct c) = 1 then min(c) end as value, count(distinct c) > 1 as conflict
from (select user_id, case when event_id % 100 = 0 then ' ' when user_id % 2 = 0 then 'k' || user_id % 5 else event_type end c0, nullif(trim(c0), '') c from events) group by 1
""")
def a02(t):
    c = X.string_code(F.when(F.col("event_id") % 100 == 0, " ").when(F.col("user_id") % 2 == 0, F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")))
                      .otherwise(F.col("event_type")))
    return t.events.groupBy("user_id").agg(R.stable(c).alias("value"), R.conflicting(c).alias("conflict"))


@query("a03_date_collapse", """
select user_id, min(d) as first_date, bool_or(bad) as invalid_date, count(distinct d) > 1 as multiple_dates
from (select user_id, event_id % 40 = 0 bad, case when event_id % 40 = 0 then null when user_id % 2 = 0 then date '2024-01-05' else cast(ts as date) end d from events) group by 1
""")
def a03(t):
    raw = F.when(F.col("event_id") % 40 == 0, "2024-02-31").when(F.col("user_id") % 2 == 0, "01/05/2024").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.groupBy("user_id").agg(*R.date_summary(raw, "date_mdy"))


@query("a04_code_lists", """
select user_id, string_agg(distinct c, '|' order by c) as codes, string_agg(distinct 'event=' || c || case c when '0' then ': view' when '1' then ': click' else '' end, ' | '
   order by 'event=' || c || case c when '0' then ': view' when '1' then ': click' else '' end) as shown
from (select user_id, cast(event_id % 4 as varchar) c from events) group by 1
""")
def a04(t):
    g = t.events.groupBy("user_id").agg(R.code_list(X.string_code((F.col("event_id") % 4).cast("double"))).alias("codes"))
    return g.withColumn("shown", R.labelled_codes("event", F.col("codes"), {"0": "view", "1": "click"}))


@query("a05_tri_state", """
with g as (select o_custkey, bool_or(o_orderstatus = 'F') or bool_or(o_orderpriority = '1-URGENT') pos, bool_or(o_orderstatus = 'O') or bool_or(o_orderpriority = '5-LOW') neg,
   bool_or(o_orderstatus = 'P') unk from orders group by 1)
select o_custkey, case when pos then true when neg then false end as state, pos and neg as state_conflict, unk as state_unknown from g
""")
def a05(t):
    return t.orders.groupBy("o_custkey").agg(*R.tri_state([
        (F.col("o_orderstatus"), {"positive": ["F"], "negative": ["O"], "unknown": ["P"]}),
        (F.col("o_orderpriority"), {"positive": ["1-URGENT"], "negative": ["5-LOW"]})]))


@query("a06_participant_audit", REC + """
select participant_id, records, coalesce(raw_race, '') as raw_race, raw_status, included, decision, reason, milestone, minority, state as hispanic, first_date from dec
""")
def a06(t):
    return decided(t).select("participant_id", "records", "raw_race", "raw_status", "included", "decision", "reason", "milestone", "minority",
                             F.col("state").alias("hispanic"), "first_date")


@query("a06_permissive_audit", REC + """
select participant_id, case when excluded_flag or review_flag or n_races = 0 or race_other or state is null or state_conflict then 'flagged-review' else 'included' end as decision,
  concat_ws('; ', case when excluded_flag then 'exclusion flag' end, case when review_flag then 'review flag' end, case when n_races = 0 then 'race missing' end,
    case when race_other then 'race unknown/other' end, case when state is null then 'ethnicity missing' end, case when state_conflict then 'conflicting values' end) as reason
from st
""")
def a06b(t):
    return R.decide_permissive(R.collapse(study_records(t), RULES)).select("participant_id", "decision", "reason")


@query("a07_issue_log", REC + """
, i as (select participant_id, unnest([case when race_unexpected then 'unexpected_race_code' end, case when status_invalid then 'invalid_status_code' end,
  case when n_races = 0 then 'missing_race' end, case when race_other then 'unknown_other_race' end, case when n_races > 1 then 'multiple_race_selections' end,
  case when state is null and not state_unknown then 'missing_ethnicity' end, case when state_unknown then 'unknown_declined_ethnicity' end,
  case when state_conflict then 'conflicting_ethnicity_sources' end, case when excluded_flag then 'excluded_status' end, case when review_flag then 'review_status' end,
  case when status_conflict then 'conflicting_enrollment_status' end, case when first_date is null and not invalid_date then 'missing_enrollment_date' end,
  case when invalid_date then 'invalid_enrollment_date' end, case when multiple_dates then 'conflicting_enrollment_dates' end,
  case when coalesce(included, false) and milestone is null then 'unassignable_milestone' end]) issue_type from dec)
select participant_id, issue_type from i where issue_type is not null
union all select '', 'unresolved_inclusion' from dec where included is null having count(*) > 0
union all select '', 'unresolved_milestone' from dec where included and milestone is null having count(*) > 0
""")
def a07(t):
    return R.issue_log(decided(t)).select("participant_id", "issue_type")


@query("a08_inventory_counts", REC + """
select category, count(*) filter (included) as included, count(*) filter (not included) as excluded, count(*) filter (included is null) as unresolved,
  count(*) filter (decision = 'review') as review from cat group by 1
""")
def a08(t):
    return R.inventory_counts(decided(t))


_MS = "(select unnest([date '2023-04-01', date '2023-08-01', date '2023-12-01', date '2024-04-01']) milestone)"
_TG = f"""
, tg as (select category, milestone, case when category = 'Total' then 20 when category = 'Minority' then 10 end previous_target,
    case when milestone > date '2023-04-01' then case when category = 'Hispanic' then 0 else 15 + month(milestone) end end current_target
    from (select unnest(['Total', 'Minority', 'Hispanic']) category) cross join {_MS}),
act as (select category, m.milestone, count(*) filter (first_date <= m.milestone) actual from cat cross join {_MS} m where included and milestone_ok group by 1, 2)
"""


def targets(t):
    """Target table: a configuration of three categories by four milestones, sized by the config alone."""
    m = F.col("milestone")
    base = t.spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in ("Total", "Minority", "Hispanic")])).alias("category"))
    base = base.select("category", F.explode(F.array(*[F.lit(x).cast("date") for x in RULES.milestones])).alias("milestone"))
    return base.select("category", "milestone",
                       F.when(F.col("category") == "Total", 20).when(F.col("category") == "Minority", 10).cast("long").alias("previous_target"),
                       F.when(m > F.lit("2023-04-01").cast("date"), F.when(F.col("category") == "Hispanic", 0).otherwise(15 + F.month(m))).cast("long").alias("current_target"))


def actuals(t):
    good = decided(t).where(F.col("included") & F.col("milestone").isNotNull())
    return R.milestone_counts(R.categories(good), "first_date", list(RULES.milestones), ["category"])


_REPORT = REC.replace("), cat as", "), cat as") + _TG.replace("included and milestone_ok", "included and cat.milestone is not null")


@query("a09_milestone_report", _REPORT + """
, j as (select tg.*, case when tg.milestone <= date '2023-12-01' then coalesce(actual, 0) end a, coalesce(current_target, previous_target) g from tg left join act using (category, milestone))
select category, milestone, cast(previous_target as bigint) as previous_target, cast(current_target as bigint) as current_target, a as actual, round(a / nullif(cast(g as double), 0), 6) as ratio,
  case when coalesce(g, 0) = 0 then 'N/A' when a is null then case when milestone = date '2023-12-01' then 'Pending' else '' end when a >= g then 'On Target' else 'Below Target' end as status,
  case when current_target is not null then 'current' when previous_target is not null then 'previous' else 'none' end as target_source from j
""")
def a09(t):
    rows = R.report_rows(actuals(t), targets(t), ["category"], R.current_milestone(list(RULES.milestones), "2023-10-15"))
    return rows.withColumn("ratio", F.round("ratio", 6))


@query("a09_milestone_report_wide", _REPORT + """
select category, max(actual) filter (milestone = date '2023-04-01') as "2023_04_01", max(actual) filter (milestone = date '2023-08-01') as "2023_08_01",
 max(actual) filter (milestone = date '2023-12-01') as "2023_12_01", max(actual) filter (milestone = date '2024-04-01') as "2024_04_01" from act group by 1
""")
def a09b(t):
    return R.report_wide(actuals(t), ["category"], list(RULES.milestones))


@query("a10_complete_case", """
with v as (select s_nationkey nation, 'supplier' src, sum(s_acctbal) v from supplier group by 1 union all
   select c_nationkey, c_mktsegment, sum(case when c_acctbal > 0 and not (c_nationkey % 6 = 0 and c_mktsegment = 'BUILDING') then floor(c_acctbal) end) from customer group by 1, 2)
select nation, count(v) as reporting, case when count(v) = 6 then round(sum(v), 2) end as combined from v group by 1
""")
def a10(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("src"), F.col("s_acctbal").alias("v"))
    keep = (F.col("c_acctbal") > 0) & ~((F.col("c_nationkey") % 6 == 0) & (F.col("c_mktsegment") == "BUILDING"))
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("src"), F.when(keep, F.floor("c_acctbal").cast("double")).alias("v"))
    return R.complete_case_sum(s.unionByName(c), ["nation"], "src", "v", 6).withColumn("combined", F.round("combined", 2))


@query("a11_milestone_calendar", """
select m as milestone, count(*) as orders from (select unnest(generate_series(date '1992-01-01', date '1998-12-31', interval 1 month)) ms, cast(ms as date) m) s
join orders on date_trunc('month', o_orderdate) = s.m where month(m) in (4, 8, 12) group by 1
""")
def a11(t):
    cal = D.milestone_calendar(t.spark, "1992-01-01", "1998-12-31")
    n = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("milestone")).agg(F.count(F.lit(1)).alias("orders"))
    return n.join(cal, "milestone", "left_semi")


@query("a12_demographic_quality", """
with b as (select c_nationkey nation, case when c_acctbal < 0 then 'debt' when c_mktsegment = 'BUILDING' then 'building' when c_mktsegment in ('MACHINERY', 'FURNITURE') then 'goods'
   else 'missing' end b from customer),
 k as (select nation, count(*) n from b group by 1)
select k.nation, x.bucket, count(b.b) as n, round(count(b.b) * 100.0 / any_value(k.n), 6) as pct
from k cross join (select unnest(['debt', 'building', 'goods', 'missing']) bucket) x left join b on b.nation = k.nation and b.b = x.bucket group by 1, 2
""")
def a12(t):
    tests = [("debt", F.col("c_acctbal") < 0), ("building", F.col("c_mktsegment") == "BUILDING"), ("goods", F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"))]
    return R.exclusive_buckets(t.customer, tests, ["c_nationkey"]).select(F.col("c_nationkey").alias("nation"), "bucket", "n", F.round("pct", 6).alias("pct"))


@query("a72_fill_rate", """
with g as (select user_id, bool_or(event_type = 'view' and cast(json_extract_string(props, '$.k') as integer) > 90) a, bool_or(json_extract_string(props, '$.zzz') is not null) b,
  bool_or(value > 300) c from events group by 1)
select 'k_high' as field, count(*) filter (a) as filled, count(*) as ids, round(count(*) filter (a) * 100.0 / count(*), 6) as pct from g
union all select 'absent', count(*) filter (b), count(*), round(count(*) filter (b) * 100.0 / count(*), 6) from g
union all select 'large', count(*) filter (c), count(*), round(count(*) filter (c) * 100.0 / count(*), 6) from g
""")
def a72(t):
    k = F.get_json_object("props", "$.k")
    df = t.events.select("user_id", F.when((F.col("event_type") == "view") & (k.cast("int") > 90), k).alias("k_high"),
                         F.get_json_object("props", "$.zzz").alias("absent"), F.when(F.col("value") > 300, "x").otherwise(" ").alias("large"))
    return R.fill_rate(df, "user_id", ["k_high", "absent", "large"]).withColumn("pct", F.round("pct", 6))


@query("j14_milestone_counts", """
select o_orderpriority as priority, m.milestone, count(*) filter (cast(o_orderdate as date) <= m.milestone) as actual
from orders cross join (select cast(unnest(generate_series(date '1995-04-01', date '2001-10-01', interval 3 month)) as date) milestone) m group by 1, 2
""")
def j14(t):
    df = t.orders.select(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("d"))
    return R.milestone_counts(df, "d", D.milestone_dates("1995-04-01", "2001-10-01", (1, 4, 7, 10)), ["priority"])


@query("j15_first_milestone", """
select o_orderkey, case when o_orderkey % 12 = 0 then null else coalesce((select cast(min(m) as varchar) from (select cast(unnest(generate_series(date '1995-04-01', date '2000-12-01', interval 4 month)) as date) m)
  where m >= cast(o_orderdate as date)), 'AFTER_REPORTING_WINDOW') end as milestone from orders
""")
def j15(t):
    d = F.when(F.col("o_orderkey") % 12 != 0, F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", D.first_milestone(d, D.milestone_dates("1995-01-01", "2000-12-31")).alias("milestone"))


@query("flagship_enrollment_report", _REPORT + """
, j as (select tg.*, case when tg.milestone <= date '2023-12-01' then coalesce(actual, 0) end a, coalesce(current_target, previous_target) g from tg left join act using (category, milestone))
select category, milestone, case when a between 1 and 9 then '<10' else cast(a as varchar) end as shown, g as target,
  case when a not between 1 and 9 then round(a / nullif(cast(g as double), 0), 6) end as ratio,
  case when a between 1 and 9 then 'Suppressed' when a is null then '' when coalesce(g, 0) = 0 then 'N/A' when a >= g then 'On Target' else 'Below Target' end as status from j
""")
def flagship(t):
    rows = R.report_rows(actuals(t), targets(t), ["category"], "2023-12-01")
    goal = F.coalesce("current_target", "previous_target")
    a = F.col("actual")
    return rows.select("category", "milestone", P.public_count(a).alias("shown"), goal.alias("target"),
                       F.round(P.public_ratio(a, goal), 6).alias("ratio"), P.public_status(a, goal).alias("status"))
