"""Queries over field dictionaries, completion and key sets (inventory F01-F02, F11, J01-J13, A13-A28, A69, O01-O04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completion as C
from ..operators import joins as J
from ..operators import metadata as M
from .common import DICT
from .registry import query

PROJECTS = ["P0", "P1", "P2"]


def dictionary(t):
    return M.dictionary_from_parts(t.part).withColumn("project", F.concat(F.lit("P"), (F.col("row_id") % 3).cast("string")))


def flags(t):
    return M.structural_flags(dictionary(t))


@query("f01_field_explorer", DICT + """
select row_id from d where project in ('P0', 'P2') and field_type in ('text', 'radio') and required_field = 'y'
  and contains(lower(concat_ws(' ', field_name, field_label, form_name)), 'red')
""")
def f01(t):
    return C.explore(flags(t), ["P0", "P2"], ["text", "radio"], None, [F.col("is_required")], " RED ", ["field_name", "field_label", "form_name"]).select("row_id")


@query("f02_instrument_search", "select p_partkey from part where contains(lower(p_brand), 'd#2') or contains(lower(p_name), 'd#2')")
def f02(t):
    return C.search_instruments(t.part, "D#2", "p_brand", "p_name").select("p_partkey")


@query("f11_field_discovery", DICT + """
select row_id, field_name, form_name from d where regexp_matches(field_label, '(?i)^red\\b|BLUE b') and field_type in ('radio', 'checkbox')
order by case when contains(field_name, 'bolt') then 0 else 1 end, field_name, row_id limit 1
""")
def f11(t):
    return M.find_field(dictionary(t), r"^red\b|BLUE b", ["radio", "checkbox"], "bolt").select("row_id", "field_name", "form_name")


@query("j01_export_expansion", DICT + """
, e as (select row_id, field_name, field_type, unnest(generate_series(1, 2)) choice from d)
select row_id, field_name || '___' || choice as export_field_name, cast(choice as varchar) as choice_value from e where field_type = 'checkbox'
union all select row_id, field_name, '' from d where field_type <> 'checkbox'
""")
def j01(t):
    d = dictionary(t).withColumn("field_name", F.concat("field_name", F.lit("_"), F.col("row_id").cast("string")))
    boxes = d.where(F.col("field_type") == "checkbox").select(F.upper(F.concat(F.lit(" "), "field_name")).alias("original_field_name"), "field_name", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("c"))
    exports = boxes.select("original_field_name", F.concat("field_name", F.lit("___"), F.col("c").cast("string")).alias("export_field_name"),
                           F.col("c").cast("string").alias("choice_value"), F.col("c").alias("export_order"))
    out = M.expand_exports(d, exports)
    return out.select("row_id", F.regexp_replace("export_field_name", r"_\d+(___\d)?$", "$1").alias("export_field_name"), "choice_value")


@query("j02_count_enrichment", """
select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers,
  (select count(*) from supplier where s_nationkey = n_nationkey and s_acctbal < 0) as debtors from nation
""")
def j02(t):
    def count(df, key):
        return df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return C.enrich_counts(t.nation.select("n_nationkey"), "n_nationkey", {
        "customers": count(t.customer, "c_nationkey"), "suppliers": count(t.supplier, "s_nationkey"),
        "debtors": count(t.supplier.where("s_acctbal < 0"), "s_nationkey")})


@query("j04_one_to_one_join", "select doc_id, quality, toxic, lang, n_chars from labels join documents using (doc_id)")
def j04(t):
    return J.one_to_one(t.labels, t.documents.select("doc_id", "lang", "n_chars"), ["doc_id"])


@query("j05_row_order_join", """
with a as (select doc_id, quality, row_number() over (order by doc_id) p from labels), b as (select item_id, row_number() over (order by item_id desc) p from benchmark)
select p as position, doc_id, quality, item_id from a join b using (p)
""")
def j05(t):
    b = t.benchmark.select("item_id", (-F.col("item_id")).alias("o"))
    return J.by_row_order(t.labels.select("doc_id", "quality"), b, "doc_id", "o").select("position", "doc_id", "quality", "item_id")


@query("j06_reconciliation", """
with m as (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) n from orders group by 1),
  s as (select month, n + case when month(month) = 6 then 1 else 0 end n from m where month(month) <> 2 union all select date '2010-01-01', 7)
select coalesce(m.month, s.month) as month, coalesce(m.n, 0) as recomputed, coalesce(s.n, 0) as supplied, coalesce(m.n, 0) - coalesce(s.n, 0) as discrepancy,
  coalesce(m.n, 0) <> coalesce(s.n, 0) as mismatch from m full join s on m.month = s.month
""")
def j06(t):
    m = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    kept = m.where(F.month("month") != 2).select("month", F.when(F.month("month") == 6, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    extra = t.spark.range(1).select(F.lit("2010-01-01").cast("date").alias("month"), F.lit(7).cast("long").alias("n"))
    return J.reconcile(m, kept.unionByName(extra), "month")


@query("j07_population_equality", """
with a as (select o_custkey, o_orderpriority from orders), b as (select o_custkey, case when o_orderkey % 50 = 0 then 'X' else o_orderpriority end o_orderpriority from orders where o_orderkey % 77 <> 3),
  ca as (select o_custkey, o_orderpriority, count(*) n from a group by all), cb as (select o_custkey, o_orderpriority, count(*) n from b group by all)
select o_custkey, o_orderpriority, greatest(coalesce(ca.n, 0) - coalesce(cb.n, 0), 0) as extra, greatest(coalesce(cb.n, 0) - coalesce(ca.n, 0), 0) as missing
from ca full join cb using (o_custkey, o_orderpriority) where coalesce(ca.n, 0) <> coalesce(cb.n, 0)
""")
def j07(t):
    a = t.orders.select("o_custkey", "o_orderpriority")
    b = t.orders.where(F.col("o_orderkey") % 77 != 3).select("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return J.population_difference(a, b, ["o_custkey", "o_orderpriority"])


@query("j08_orphans", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45 and l_discount > 0.08)")
def j08(t):
    return C.orphans(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 45 and l_discount > 0.08"), "p_partkey", "l_partkey")


@query("j08_key_gaps", """
with p as (select distinct o_orderpriority g, o_orderkey k from orders), b as (select g, min(k) lo, max(k) hi from p group by 1),
  f as (select g, unnest(generate_series(lo, hi)) k from b)
select g as o_orderpriority, k as o_orderkey from f where (g, k) not in (select g, k from p)
""")
def j08b(t):
    return C.key_gaps(t.orders, "o_orderkey", "o_orderpriority")


@query("j12_nearest_gap", """
with v as (select o_orderkey, o_custkey, cast(o_orderdate as date) d from orders),
  c as (select distinct o_custkey, cast(l_shipdate as date) s from lineitem join orders on l_orderkey = o_orderkey)
select v.o_custkey, v.o_orderkey, min(abs(s - d)) as gap_days from v left join c on c.o_custkey = v.o_custkey group by 1, 2
""")
def j12(t):
    v = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    c = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.to_date("l_shipdate").alias("s"))
    return J.nearest_gap(v, c, ["o_custkey"], "o_orderkey", "d", "s").select("o_custkey", "o_orderkey", F.col("gap_days").cast("long").alias("gap_days"))


@query("j13_id_list_semi_join", "select c_custkey, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def j13(t):
    ids = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return J.listed(t.customer.select("c_custkey", "c_acctbal"), ids, "c_custkey")


@query("j16_label_lookup", """
select c_custkey, coalesce(n_name, cast(k as varchar)) as site from (select c_custkey, case when c_custkey % 9 = 0 then 99 else c_nationkey end k from customer) left join nation on n_nationkey = k
""")
def j16(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, 99).otherwise(F.col("c_nationkey")).alias("code"))
    return C.with_label(c, "code", t.nation, "n_nationkey", "n_name", "site").select("c_custkey", "site")


def completion_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").cast("string").alias("id"), F.when(k % 8 == 0, "").otherwise(F.col("o_orderpriority")).alias("event"),
                           (k % 3).cast("string").alias("intake_complete"), F.when(k % 4 == 3, "").otherwise((k % 4).cast("string")).alias("exam_complete"),
                           F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "1").alias("survey_complete"))


_COMP = """
with r as (select o_custkey id, case when o_orderkey % 8 = 0 then '(no event)' else o_orderpriority end event, unnest([
    {'i': 'intake', 's': cast(o_orderkey % 3 as integer)}, {'i': 'exam', 's': cast(o_orderkey % 4 as integer)},
    {'i': 'survey', 's': case o_orderstatus when 'F' then 2 when 'O' then 1 else 3 end}]) x from orders),
 c as (select x.i instrument, event, case x.s when 2 then 'Complete' when 1 then 'Unverified' when 0 then 'Incomplete' else 'Not started' end status, count(*) n from r group by all)
"""


@query("a13_completion_tally", _COMP + "select * from c")
def a13(t):
    return C.completion_tally(completion_rows(t), "event")


@query("a14_event_volume", "select event_type as event, count(*) as rows, count(distinct user_id) as records from events group by 1")
def a14(t):
    return C.event_volume(t.events.withColumnRenamed("event_type", "event"), "event", "user_id")


_TOT = """cast(coalesce(sum(n) filter (status = 'Complete'), 0) as bigint) as complete, cast(coalesce(sum(n) filter (status = 'Unverified'), 0) as bigint) as unverified,
 cast(coalesce(sum(n) filter (status = 'Incomplete'), 0) as bigint) as incomplete, cast(coalesce(sum(n) filter (status = 'Not started'), 0) as bigint) as not_started,
 cast(coalesce(sum(n) filter (status <> 'Not started'), 0) as bigint) as started,
 coalesce(round(sum(n) filter (status = 'Complete') * 100.0 / nullif(sum(n) filter (status <> 'Not started'), 0), 1), 0.0)::double as completion_rate"""


@query("a15_completion_totals", _COMP + f"select {_TOT} from c")
def a15(t):
    return C.completion_totals(C.completion_tally(completion_rows(t), "event"))


@query("a16_instrument_summary", _COMP + f"select instrument, {_TOT} from c group by 1")
def a16(t):
    return C.completion_totals(C.completion_tally(completion_rows(t), "event"), ["instrument"])


@query("a16_event_summary", _COMP + f", v as (select event, count(*) // 3 as rows, count(distinct id) as records from r group by 1) select event, any_value(rows) as rows, any_value(records) as records, {_TOT} from c join v using (event) group by event")
def a16b(t):
    rows = completion_rows(t)
    volume = C.event_volume(rows.withColumn("event", F.when(F.col("event") == "", "(no event)").otherwise(F.col("event"))), "event", "id")
    return volume.join(C.completion_totals(C.completion_tally(rows, "event"), ["event"]), "event")


@query("a17_study_overview", """
select n_name as study, coalesce(customers, 0) as customers, coalesce(debt, 0) as debt, customers is not null as ok from nation left join
 (select c_nationkey k, count(*) customers, count(*) filter (c_acctbal < 0) debt from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2) group by 1) on k = n_nationkey
""")
def a17(t):
    s = (t.customer.join(t.nation.where("n_regionkey <> 2"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("study"))
         .agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("debt")))
    return M.overview(t.nation.select(F.col("n_name").alias("study")), s, "study", ["customers", "debt"])


@query("a18_type_breakdown", DICT + "select project, field_type, count(*) as n from d group by 1, 2")
def a18(t):
    return M.type_breakdown(dictionary(t), "project")


@query("a19_quality_checks", DICT + """
select 'Fields with no label' as check, count(*) filter (field_label = '') as n from d
union all select 'Text fields with no validation', count(*) filter (field_type in ('text', 'notes') and validation = '') from d
union all select 'Choice fields with no choices', count(*) filter (field_type in ('radio', 'dropdown', 'checkbox') and n_choices = 0) from d
union all select 'Identifier-flagged fields', count(*) filter (identifier = 'y') from d
union all select 'Fields with branching logic', count(*) filter (branching_logic <> '') from d
union all select 'Required fields', count(*) filter (required_field = 'y') from d
union all select 'Calculated fields', count(*) filter (field_type = 'calc') from d
""")
def a19(t):
    return M.quality_checks(flags(t))


@query("a20_project_summary", DICT + """
, k as (select project, field_name, count(distinct form_name) forms from d group by 1, 2)
select d.project, count(*) as design_rows, count(distinct field_name) as distinct_fields, (select count(*) from k where k.project = d.project and forms > 1) as name_collisions,
  count(*) filter (required_field = 'y') as required, count(*) filter (identifier = 'y') as identifiers, count(*) filter (branching_logic <> '') as branching,
  count(*) filter (validation <> '') as validated, count(distinct case when matrix_group_name <> '' then form_name || matrix_group_name end) as matrix_groups
from d group by 1
""")
def a20(t):
    return M.project_summary(flags(t), "project")


@query("a21_overlap_summary", """
with f as (select o_custkey, bool_or(o_orderpriority = '1-URGENT') a, bool_or(o_orderpriority = '2-HIGH') b, bool_or(o_orderpriority = '5-LOW') c from orders
   where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') group by 1)
select 'COMMON_ALL' as metric, 'all' as scope, count(*) filter (a and b and c) as n from f union all select 'TOTAL', 'all', count(*) from f
union all select 'TOTAL', '1-URGENT', count(*) filter (a) from f union all select 'TOTAL', '2-HIGH', count(*) filter (b) from f union all select 'TOTAL', '5-LOW', count(*) filter (c) from f
union all select 'UNIQUE', '1-URGENT', count(*) filter (a and not b and not c) from f union all select 'UNIQUE', '2-HIGH', count(*) filter (b and not a and not c) from f
union all select 'UNIQUE', '5-LOW', count(*) filter (c and not a and not b) from f
union all select 'MISSING_VS_REFERENCE', '1-URGENT', count(*) filter (c and not a) from f union all select 'MISSING_VS_REFERENCE', '2-HIGH', count(*) filter (c and not b) from f
union all select 'COMMON_PAIR', '1-URGENT & 2-HIGH', count(*) filter (a and b) from f union all select 'COMMON_PAIR', '1-URGENT & 5-LOW', count(*) filter (a and c) from f
union all select 'COMMON_PAIR', '2-HIGH & 5-LOW', count(*) filter (b and c) from f
""")
def a21(t):
    projects = ["1-URGENT", "2-HIGH", "5-LOW"]
    return M.overlap_summary(t.orders.where(F.col("o_orderpriority").isin(*projects)), "o_custkey", "o_orderpriority", projects, "5-LOW")


@query("a21_missing_keys", """
with f as (select o_custkey, bool_or(o_orderpriority = '1-URGENT') a, bool_or(o_orderpriority = '2-HIGH') b, bool_or(o_orderpriority = '5-LOW') c from orders group by 1)
select o_custkey, '1-URGENT' as missing_in from f where c and not a union all select o_custkey, '2-HIGH' from f where c and not b
""")
def a21b(t):
    return M.missing_keys(t.orders, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "5-LOW")


@query("a22_cross_project_comparison", DICT + """
, k as (select field_name || '_' || lower(form_name) || '_' || (size % 9) key, * from d), g as (select key field_key,
  count(distinct nullif(lower(trim(field_label)), '')) lv, count(distinct field_type) tv, count(distinct lower(form_name)) iv,
  arg_min(form_name, (case project when 'P1' then 0 when 'P0' then 1 else 2 end, row_id)) example_instrument,
  bool_or(project = 'P0') p0, bool_or(project = 'P1') p1, bool_or(project = 'P2') p2,
  list_distinct(list_filter([bool_or(validation <> '') filter (project = 'P0'), bool_or(validation <> '') filter (project = 'P1'), bool_or(validation <> '') filter (project = 'P2')], lambda x: x is not null)) vs,
  list_distinct(list_filter([bool_or(identifier = 'y') filter (project = 'P0'), bool_or(identifier = 'y') filter (project = 'P1'), bool_or(identifier = 'y') filter (project = 'P2')], lambda x: x is not null)) ids
  from k group by 1)
select field_key, example_instrument, p0 as "in_P0", p1 as "in_P1", p2 as "in_P2", concat_ws(', ', case when not p0 then 'P0' end, case when not p1 then 'P1' end, case when not p2 then 'P2' end) as missing_in,
  greatest(lv - 1, 0) as label_mismatch, greatest(tv - 1, 0) as type_mismatch, greatest(iv - 1, 0) as instrument_mismatch,
  greatest(lv - 1, 0) + greatest(tv - 1, 0) + greatest(iv - 1, 0) as mismatch_total, len(vs) > 1 as validation_gap, len(ids) > 1 as identifier_mismatch,
  case when not (p0 and p1 and p2) and p1 then 'MISSING_VS_REFERENCE' when not (p0 and p1 and p2) then 'PARTIAL_PRESENCE' when tv > 1 then 'TYPE_MISMATCH' when lv > 1 then 'LABEL_MISMATCH'
    when iv > 1 then 'INSTRUMENT_MISMATCH' when len(vs) > 1 then 'VALIDATION_GAP' else 'ALIGNED' end as category from g
""")
def a22(t):
    d = dictionary(t).withColumn("field_name", F.concat_ws("_", "field_name", F.lower("form_name"), (F.col("size") % 9).cast("string")))
    return M.compare_projects(M.structural_flags(d), "project", PROJECTS, "P1")


@query("a23_issue_profile", DICT + """
, g as (select field_name k, project p, bool_or(validation <> '') v, bool_or(identifier = 'y') i, bool_or(contains(form_name, '7') and contains(field_name, 'r')) dt from (select *, field_name || '_' || (size % 12) fn from d) group by 1, 2),
 h as (select *, fk from (select fn fk, project p, bool_or(validation <> '') v, bool_or(identifier = 'y') i, bool_or(contains(form_name, '7') and contains(field_name, 'r')) dt from (select *, field_name || '_' || (size % 12) fn from d) group by 1, 2)),
 al as (select fk, list(p order by p) filter (v) vp, list(p order by p) filter (not v) nv, list(p order by p) filter (i) ip, list(p order by p) filter (not i) ni, list(p order by p) filter (dt) dp, list(p) ps from h group by 1)
select 'MISSING_LABEL' as issue_type, project, field_name || '_' || (size % 12) as field_key, 'blank' as observed, '' as compared_with from d where field_label = '' group by project, field_name || '_' || (size % 12), form_name
union all select 'VALIDATION_GAP', unnest(nv), fk, 'not validated', array_to_string(vp, ', ') from al where vp is not null and nv is not null
union all select 'DATE_FIELD_MISSING', unnest(list_filter(['P0', 'P1', 'P2'], lambda x: not list_contains(ps, x))), fk, 'absent', array_to_string(dp, ', ') from al where dp is not null
union all select 'IDENTIFIER_FLAG_MISMATCH', unnest(ip), fk, 'identifier', array_to_string(ni, ', ') from al where ip is not null and ni is not null
union all select 'IDENTIFIER_FLAG_MISMATCH', unnest(ni), fk, 'not identifier', array_to_string(ip, ', ') from al where ip is not null and ni is not null
""")
def a23(t):
    d = dictionary(t)
    dated = F.contains(F.col("form_name"), F.lit("7")) & F.contains(F.col("field_name"), F.lit("r"))
    d = d.withColumn("is_date_field", dated).withColumn("field_name", F.concat_ws("_", "field_name", (F.col("size") % 12).cast("string")))
    return M.issue_profile(M.structural_flags(d), "project", PROJECTS)


@query("a24_presence_matrix", """
select p_name as item, bool_or(p_type = 'PROMO') as "in_PROMO", bool_or(p_type = 'SMALL') as "in_SMALL", bool_or(p_type = 'ECONOMY') as "in_ECONOMY",
  cast(bool_or(p_type = 'PROMO') as integer) + cast(bool_or(p_type = 'SMALL') as integer) + cast(bool_or(p_type = 'ECONOMY') as integer) as studies
from (select p_name || ' ' || p_size p_name, p_type from part) group by 1 having studies >= 2
""")
def a24(t):
    return M.presence_matrix(t.part.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("item"), "p_type"), "item", "p_type", ["PROMO", "SMALL", "ECONOMY"], 2)


_CMP = DICT + """
, f as (select field_name || '_' || size nm, project, row_id, field_type, lower(trim(field_label)) lab from d),
 w as (select nm, arg_min(field_type, row_id) filter (project = 'P0') t0, arg_min(field_type, row_id) filter (project = 'P1') t1, arg_min(field_type, row_id) filter (project = 'P2') t2,
   arg_min(lab, row_id) filter (project = 'P0') l0, arg_min(lab, row_id) filter (project = 'P1') l1, arg_min(lab, row_id) filter (project = 'P2') l2 from f group by 1),
 z as (select nm as field_name, coalesce(t0, '—') as "type_P0", coalesce(t1, '—') as "type_P1", coalesce(t2, '—') as "type_P2",
   cast((t0 is not null)::int + (t1 is not null)::int + (t2 is not null)::int as integer) as studies_with_field,
   case when t0 is null or t1 is null or t2 is null then 'partial' when t0 <> t1 or t1 <> t2 then 'type differs' when l0 <> l1 or l1 <> l2 then 'label differs' else 'identical' end as consistency from w)
"""


@query("a25_instrument_comparison", _CMP + "select * from z")
def a25(t):
    d = dictionary(t).withColumn("field_name", F.concat_ws("_", "field_name", F.col("size").cast("string")))
    return M.compare_instrument(d, "project", PROJECTS, 3)


@query("a25_comparison_headline", _CMP + """
select k as consistency, (select count(*) from z where consistency = k) as n from (select unnest(['identical', 'label differs', 'type differs', 'partial']) k)
""")
def a25b(t):
    return M.comparison_headline(a25(t))


@query("a26_field_availability", """
with a as (select distinct o_custkey k from orders where o_orderpriority = '1-URGENT'), b as (select distinct o_custkey k from orders where o_orderpriority = '5-LOW')
select coalesce(a.k, b.k) as o_custkey, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'only_a' else 'only_b' end as where
from a full join b on a.k = b.k
""".replace(" as where", ' as "where"'))
def a26(t):
    return M.availability(t.orders.where("o_orderpriority = '1-URGENT'"), t.orders.where("o_orderpriority = '5-LOW'"), "o_custkey")


@query("a27_range_mismatch", """
with c as (select 'customer' s, 'acctbal' f, case when c_custkey % 10 = 0 then 'n/a' else cast(c_acctbal as varchar) end v from customer union all
  select 'customer', 'nation', cast(c_nationkey as varchar) from customer union all select 'customer', 'segment', c_mktsegment from customer union all
  select 'supplier', 'acctbal', cast(s_acctbal as varchar) from supplier union all select 'supplier', 'nation', cast(s_nationkey as varchar) from supplier union all
  select 'supplier', 'segment', '1' from supplier), n as (select s, f, try_cast(v as double) x from c),
 g as (select f as field, min(x) filter (s = 'customer') as min_customer, max(x) filter (s = 'customer') as max_customer, count(x) filter (s = 'customer') as n_customer,
   round(count(*) filter (s = 'customer' and x is null) * 100.0 / count(*) filter (s = 'customer'), 6) as missing_pct_customer,
   min(x) filter (s = 'supplier') as min_supplier, max(x) filter (s = 'supplier') as max_supplier, count(x) filter (s = 'supplier') as n_supplier,
   round(count(*) filter (s = 'supplier' and x is null) * 100.0 / count(*) filter (s = 'supplier'), 6) as missing_pct_supplier from n group by 1)
select *, min_customer <> min_supplier or max_customer <> max_supplier as mismatch from g where n_customer > 0 and n_supplier > 0
""")
def a27(t):
    def cells(df, name, cols):
        made = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in cols.items()])
        return df.select(F.lit(name).alias("source"), F.inline(made))
    c = cells(t.customer, "customer", {"acctbal": F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")),
                                       "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")})
    s = cells(t.supplier, "supplier", {"acctbal": F.col("s_acctbal"), "nation": F.col("s_nationkey"), "segment": F.lit("1")})
    out = M.range_mismatch(c.unionByName(s), "source", "customer", "supplier")
    return out.withColumns({c: F.round(c, 6) for c in ("missing_pct_customer", "missing_pct_supplier")})


@query("a28_expectation_check", DICT + """
, m as (select field_name, arg_min(form_name, row_id) fo, arg_min(field_type, row_id) ty, arg_min(n_choices, row_id) nc from d group by 1),
 e as (select distinct field_name from d union all select 'absent_field')
select e.field_name, concat_ws('; ', case when fo is null then 'missing field' end, case when fo <> 'Brand#1' then 'form differs' end, case when ty <> 'radio' then 'type differs' end,
   case when fo is not null and nc = 0 then 'codes missing: 1,2' end) as detail, case when fo = 'Brand#1' and ty = 'radio' and nc = 2 then 'PASS' else 'FAIL' end as result
from e left join m using (field_name)
""")
def a28(t):
    d = dictionary(t)
    names = d.select("field_name").distinct().unionByName(t.spark.range(1).select(F.lit("absent_field").alias("field_name")))
    expected = names.select("field_name", F.lit("Brand#1").alias("expected_form"), F.lit("radio").alias("expected_type"), F.array(F.lit("1"), F.lit("2")).alias("codes"))
    return M.expectation_check(d, expected)


@query("a69_field_mapping_audit", DICT + """
select distinct field_name, case field_type when 'text' then 'free text' when 'radio' then 'answer' else 'other' end as role,
  case field_type when 'text' then 'excluded' when 'radio' then 'used' else 'not used' end as decision, case when form_name in ('Brand#1', 'Brand#2') then 'returned' else 'not requested' end as export_status from d
union all select 'record_id', 'identifier', 'used', 'system' union all select 'event', 'event', 'used', 'system'
""")
def a69(t):
    return M.field_mapping_audit(dictionary(t), {"text": ("free text", "excluded"), "radio": ("answer", "used")}, ["Brand#1", "Brand#2"],
                                 [("record_id", "identifier", "used"), ("event", "event", "used")])


@query("o01_priority_queue", """
with q as (select o_orderkey, row_number() over (order by o_orderstatus = 'F', o_orderpriority, case when o_orderkey % 10 <> 0 then date_diff('day', date '2001-06-01', cast(o_orderdate as date)) end nulls last,
  o_orderdate, o_orderkey) as place from orders) select * from q
""")
def o01(t):
    days = F.when(F.col("o_orderkey") % 10 != 0, F.datediff(F.to_date("o_orderdate"), F.lit("2001-06-01").cast("date")))
    df = t.orders.withColumn("assigned", F.col("o_orderstatus") == "F").withColumn("days", days)
    order = J.queue_order(F.col("assigned"), F.col("o_orderpriority"), F.col("days"), F.col("o_orderdate"), F.col("o_orderkey"))
    from ..scale import running_over
    return running_over(df, [], order, place=("rows",)).select("o_orderkey", "place")


@query("o02_top_k_per_group", """
select l_orderkey, l_suppkey, l_extendedprice, cast(r as integer) as rank from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_suppkey, l_partkey, l_linenumber) r from lineitem) where r <= 3
""")
def o02(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")]
    return J.top_k(t.lineitem, ["l_orderkey"], order, 3).select("l_orderkey", "l_suppkey", "l_extendedprice", "rank")


@query("o02_top_types", "select p_type, count(*) as n from part group by 1 order by n desc, p_type limit 3")
def o02b(t):
    n = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return J.top_k(n, [], [F.col("n").desc(), F.col("p_type")], 3)


@query("o03_stable_sort", """
with c as (select o_orderkey, o_custkey, case when o_orderkey % 6 = 0 then null when o_orderkey % 6 = 1 then 'x' || o_custkey % 3 else cast(o_custkey % 40 as varchar) end code from orders)
select o_orderkey, row_number() over (order by code is null, try_cast(code as double) nulls last, code nulls last, o_orderkey) as place from c
""")
def o03(t):
    k = F.col("o_orderkey")
    code = F.when(k % 6 == 1, F.concat(F.lit("x"), (F.col("o_custkey") % 3).cast("string"))).when(k % 6 != 0, (F.col("o_custkey") % 40).cast("string"))
    from ..scale import running_over
    df = t.orders.select("o_orderkey", code.alias("code"))
    return running_over(df, [], J.code_sort(["code"], "o_orderkey"), place=("rows",)).select("o_orderkey", "place")


@query("o04_key_sets", """
with a as (select distinct c_custkey k from customer where c_acctbal > 2000), b as (select distinct o_custkey k from orders where o_totalprice > 350000)
select 'both' as part, count(*) as n from (select k from a intersect select k from b) union all select 'only_a', count(*) from (select k from a except select k from b)
union all select 'only_b', count(*) from (select k from b except select k from a) union all select 'either', count(*) from (select k from a union select k from b)
""")
def o04(t):
    a = t.customer.where("c_acctbal > 2000").select(F.col("c_custkey").alias("k"))
    return J.key_sets(a, t.orders.where("o_totalprice > 350000").select(F.col("o_custkey").alias("k")), "k")
