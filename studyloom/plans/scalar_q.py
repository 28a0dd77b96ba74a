"""Queries over scalar and array expressions (inventory 2.2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import dates as D
from ..functions import privacy as P
from ..functions import scoring as S
from ..functions import text as X
from .common import DICT
from .registry import query

NOW = "2001-06-01"


def r6(c):
    return F.round(c, 6)


@query("x01_safe_text", """
select o_orderkey,
       coalesce(p, '') as priority_text,
       length(trim(coalesce(p, ''))) > 0 as filled
from (select o_orderkey, case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then '  '
                              else o_orderpriority end p from orders)
""")
def x01(t):
    k = F.col("o_orderkey")
    p = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "  ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.safe_text(p).alias("priority_text"), X.is_filled(p).alias("filled"))


@query("x02_plain_text", """
with d as (select page_id, regexp_replace(replace(replace(replace(html, '&quot;', chr(34)), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g') h from pages)
select page_id, trim(regexp_replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g')) as plain from d
""")
def x02(t):
    return t.pages.select("page_id", X.plain_text(F.col("html")).alias("plain"))


@query("x03_comparison_key", """
select p_partkey, lower(trim(p_name)) as name_key, lower(trim(p_brand)) as brand_key,
       lower(trim(regexp_replace(regexp_replace('<b>' || p_name || '&amp;</b>  ' || p_type, '<[^>]*>', ' ', 'g')
             .replace('&amp;', '&'), '\\s+', ' ', 'g'))) as marked_key
from part
""")
def x03(t):
    marked = F.concat(F.lit("<b>"), F.col("p_name"), F.lit("&amp;</b>  "), F.col("p_type"))
    return t.part.select("p_partkey", X.comparison_key(F.col("p_name")).alias("name_key"),
                         X.field_key(F.col("p_brand")).alias("brand_key"),
                         X.comparison_key(marked).alias("marked_key"))


@query("x04_boolean_parse", """
select event_id, lower(trim(w)) in ('1', 'true', 't', 'yes', 'y') as truth,
       regexp_replace(lower(trim(w)), '^([+-]?\\d+)\\.0+$', '\\1') in ('1', 'true', 'yes', 'y') as ticked
from (select event_id, case cast(json_extract_string(props, '$.k') as bigint) % 8
        when 0 then '1' when 1 then ' TRUE' when 2 then 't' when 3 then 'Yes' when 4 then 'no' when 5 then '1.0'
        when 6 then '' else '0' end w from events)
""")
def x04(t):
    k = F.get_json_object("props", "$.k").cast("long") % 8
    words = F.array(*[F.lit(w) for w in ("1", " TRUE", "t", "Yes", "no", "1.0", "", "0")])
    w = F.element_at(words, (k + 1).cast("int"))
    return t.events.select("event_id", X.as_bool(w).alias("truth"), X.is_checked(w).alias("ticked"))


@query("x05_tag_extraction", """
select doc_id, array_to_string(list_distinct_ordered, '; ') as tags from (
  select doc_id, list_filter(a, lambda v, i: list_position(a, v) = i) as list_distinct_ordered from (
    select doc_id, list_transform(regexp_extract_all(text || ' @' || source || ' @' || lang || ' x@no @' || source,
             '(?:^|[^A-Za-z0-9_])@([A-Za-z][A-Za-z0-9_-]*)', 1), lambda v: '@' || upper(v)) a from documents))
""")
def x05(t):
    text = F.concat(F.col("text"), F.lit(" @"), F.col("source"), F.lit(" @"), F.col("lang"), F.lit(" x@no @"), F.col("source"))
    return t.documents.select("doc_id", F.concat_ws("; ", X.tags(text)).alias("tags"))


@query("x06_pattern_match", """
select doc_id, regexp_matches(text, '(?i)token\\s*=') or regexp_matches(source, '(?i)token\\s*=')
            or regexp_matches(text, '(?i)SRC1\\d') or regexp_matches(source, '(?i)SRC1\\d') as hit
from documents
""")
def x06(t):
    return t.documents.select("doc_id", X.matches_any(
        [F.col("text"), F.col("source")], [r"token\s*=", r"SRC1\d", "(unclosed"]).alias("hit"))


@query("x07_choice_list", """
select s_suppkey, 2 + cast(s_suppkey % 3 = 0 as integer) as n_choices,
       case when s_suppkey % 3 = 0 then 'Third' else null end as label_3,
       case when s_suppkey % 5 = 0 then '' when s_suppkey % 3 = 0 then '1.0,2.0,3.0' else '1.0,2.0' end as codes,
       'B ' || s_name as label_2
from supplier
""")
def x07(t):
    k = F.col("s_suppkey")
    cell = F.concat(F.lit("1, A | nothing | "), F.when(k % 5 == 0, "x").otherwise("2"), F.lit(",  B   "), F.col("s_name"),
                    F.when(k % 3 == 0, " | 3, Old | 3,Third").otherwise(""))
    m = X.choice_map(cell)
    return t.supplier.select(
        "s_suppkey", F.size(X.choices(cell)).alias("n_choices"), F.try_element_at(m, F.lit("3")).alias("label_3"),
        F.concat_ws(",", F.transform(X.numeric_codes(cell), lambda v: v.cast("string"))).alias("codes"),
        F.coalesce(F.try_element_at(m, F.lit("2")), F.try_element_at(m, F.lit("x"))).alias("label_2"))


@query("x08_code_normalisation", """
with c as (select user_id, event_id, case when event_id % 11 = 0 then ' ' when event_id % 11 = 1 then 'x' ||
             (event_id % 3) when event_id % 11 = 2 then '0' else cast(cast(floor(value) as bigint) % 12 as varchar) || '.0' end raw
           from events),
     n as (select user_id, nullif(regexp_replace(trim(raw), '^([+-]?\\d+)\\.0+$', '\\1'), '') code from c)
select user_id, string_agg(code, '|' order by not regexp_matches(code, '^-*\\d+$'), code) as codes
from (select distinct user_id, code from n where code is not null) group by user_id
""")
def x08(t):
    e = F.col("event_id")
    raw = (F.when(e % 11 == 0, " ").when(e % 11 == 1, F.concat(F.lit("x"), (e % 3).cast("string"))).when(e % 11 == 2, "0")
           .otherwise(F.concat((F.floor("value") % 12).cast("string"), F.lit(".0"))))
    codes = t.events.select("user_id", X.string_code(raw).alias("code"))
    # the code set is a small fixed vocabulary, so the set per id stays short
    return codes.groupBy("user_id").agg(F.concat_ws("|", X.sorted_codes(F.collect_set("code"))).alias("codes"))


@query("x09_date_parse", """
select o_orderkey, v, case
    when f = 0 then cast(o_orderdate as date)
    when f = 1 and v <> 'date_dmy' then cast(o_orderdate as date)
    when f = 1 and day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
    when f = 2 and v = 'date_dmy' then cast(o_orderdate as date)
    when f = 2 and day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
    when f = 2 and v = 'any' then cast(o_orderdate as date)
    else null end as parsed
from (select *, o_orderkey % 4 f, case o_orderkey % 3 when 0 then 'date_mdy' when 1 then 'date_dmy' else 'any' end v from orders)
""")
def x09(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "MM/dd/yyyy"))
           .when(k % 4 == 2, F.date_format(d, "dd-MM-yyyy")).otherwise("2026-02-30"))
    v = F.when(k % 3 == 0, "date_mdy").when(k % 3 == 1, "date_dmy").otherwise("any")
    return t.orders.select("o_orderkey", v.alias("v"), D.parse_date(raw, v).alias("parsed"))


@query("x10_visit_month", """
select event_id, try_cast(nullif(regexp_extract(n, '^(\\d+)_months?_arm_\\d+$', 1), '') as integer) as visit_month,
       case when event_id % 4 <> 3 then cast(ts as date) end as visit_date,
       event_id % 3 = 2 as complete
from (select event_id, ts, case event_id % 5 when 0 then '9_months_arm_1' when 1 then '1_month_arm_2' when 2 then '12_months_arm'
        when 3 then event_type else '24_months_arm_1x' end n from events)
""")
def x10(t):
    e = F.col("event_id")
    names = F.array(F.lit("9_months_arm_1"), F.lit("1_month_arm_2"), F.lit("12_months_arm"), F.col("event_type"), F.lit("24_months_arm_1x"))
    raw = F.when(e % 4 == 3, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", X.event_month(F.element_at(names, (e % 5 + 1).cast("int"))).alias("visit_month"),
                           X.strict_iso_date(raw).alias("visit_date"),
                           (X.safe_text((e % 3).cast("string")) == "2").alias("complete"))


@query("x11_record_id_rules", """
select o_orderkey, id, o_orderkey % 5 = 0 as is_copy, o_orderkey % 5 <> 0 and o_orderkey % 7 <> 1 as included
from (select o_orderkey, case when o_orderkey % 5 = 0 then lpad(cast(o_orderkey as varchar), 8, '0') || '--' || (1 + o_orderkey % 2)
        when o_orderkey % 7 = 1 then ' ' else lpad(cast(o_orderkey as varchar), 8, '0') end id from orders)
""")
def x11(t):
    k = F.col("o_orderkey")
    pad = F.lpad(k.cast("string"), 8, "0")
    i = F.when(k % 5 == 0, F.concat(pad, F.lit("--"), (1 + k % 2).cast("string"))).when(k % 7 == 1, " ").otherwise(pad)
    return t.orders.select("o_orderkey", i.alias("id"), X.is_copy_id(i).alias("is_copy"), X.is_included_id(i).alias("included"))


@query("x12_allow_list", """
select o_orderkey, case when p in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') then p end as canonical,
  case p when '1-URGENT' then 'amy' when '2-HIGH' then 'amy,bo' else '' end as members,
  case when p in ('1-URGENT', '2-HIGH', '3-MEDIUM') then case when p = '3-MEDIUM' then 'recognised' else 'recognised' end
       when p = '4-NOT SPECIFIED' then 'unexpected' else 'missing' end as status
from (select o_orderkey, o_orderpriority p from orders)
""")
def x12(t):
    p = F.when(F.col("o_orderpriority") == "5-LOW", " N/A ").otherwise(F.col("o_orderpriority"))
    m = X.allow_list(p, {"1-urgent": ["amy"], "2-high": ["amy", "bo"], "3-medium": []})
    return t.orders.select("o_orderkey", m.alias("m")).select(
        "o_orderkey", "m.canonical", F.concat_ws(",", "m.members").alias("members"), "m.status")


@query("x13_code_token", """
select o_orderkey, case o_orderkey % 4 when 0 then lower(o_orderstatus) || '-x__y' when 1 then '3.00' when 2 then '  ' else ' a b ' end raw,
  case o_orderkey % 4 when 0 then o_orderstatus || ' X Y' when 1 then '3' when 2 then null else 'A B' end as token,
  case o_orderkey % 4 when 0 then o_orderstatus || '_X_Y' when 1 then '3' when 2 then null else 'A_B' end as label
from orders
""")
def x13(t):
    k = F.col("o_orderkey")
    raw = (F.when(k % 4 == 0, F.concat(F.lower("o_orderstatus"), F.lit("-x__y"))).when(k % 4 == 1, "3.00")
           .when(k % 4 == 2, "  ").otherwise(" a b "))
    return t.orders.select("o_orderkey", raw.alias("raw"), X.clean_token(raw).alias("token"), X.canonical_label(raw).alias("label"))


@query("x14_layered_code", """
select doc_id, case q when 0 then 'RING' when 1 then case when doc_id % 3 = 0 then 'FISH' when doc_id % 3 = 1 then 'POP' else '7' end
  else null end as toy, case when toxic = 1 then 'AWAY' else '0' end as look
from (select doc_id, quality q, toxic from labels)
""")
def x14(t):
    raw = F.when(F.col("quality") == 0, "1").otherwise("7.0")
    age = F.when(F.col("doc_id") % 3 == 0, 9).when(F.col("doc_id") % 3 == 1, 12)
    look = F.when(F.col("toxic") == 1, "elsewhere").otherwise("not-looking")
    return t.labels.select("doc_id", X.normalise_code(raw, "toy", age).alias("toy"),
                           X.normalise_code(look, "looking", custom={"Elsewhere": "away"}).alias("look"))


@query("x15_duration_format", """
select event_id, case when s < 0 then '-' else '' end || lpad(cast(cast(floor(abs(s) / 3600) as bigint) as varchar), 2, '0') || ':' ||
  lpad(cast(cast(floor((abs(s) % 3600) / 60) as bigint) as varchar), 2, '0') || ':' || printf('%06.3f', abs(s) % 60) as shown
from (select event_id, (value - 200) * 40 s from events)
""")
def x15(t):
    return t.events.select("event_id", X.hhmmss((F.col("value") - 200) * 40).alias("shown"))


@query("x16_path_identity", """
select lpad(cast(user_id as varchar), 5, '0') as participant_id, case when event_type = 'view' then 9 else 12 end as age_months, count(*) as n from events group by 1, 2
""")
def x16(t):
    files = t.events.select("user_id", "event_type", F.col("_metadata.file_path").alias("path"))
    made = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.lit("s"), F.lpad(F.col("user_id").cast("string"), 5, "0"),
                    F.lit("_"), F.when(F.col("event_type") == "view", "09m").otherwise("12m"), F.lit(".csv"))
    ident = X.identity_from_path(made)
    return files.select(ident.alias("i")).groupBy("i.participant_id", "i.age_months").agg(F.count(F.lit(1)).alias("n"))


@query("x17_scale_to_100", """
select p_partkey, round((p_size - 1) / 49.0 * 100, 6) as pct, round((51 - p_size - 1) / 49.0 * 100, 6) as reversed from part
""")
def x17(t):
    return t.part.select("p_partkey", r6(A.scale_to_100(F.col("p_size"), 1, 50)).alias("pct"),
                         r6(A.scale_to_100(F.col("p_size"), 1, 50, reverse=True)).alias("reversed"))


_VEC = "list_transform(embedding, lambda v, i: case when i % 9 = 0 then null else round(cast(v as double), 6) end)"


def _vec(t, *extra):
    v = F.transform("embedding", lambda x, i: F.when(i % 9 == 8, None).otherwise(F.round(x.cast("double"), 6)))
    return t.embeddings.select("vec_id", *extra, v.alias("a"))


@query("x18_row_mean", f"""
with v as (select vec_id, {_VEC} a from embeddings),
     s as (select vec_id, list_filter(a[1:7], lambda x: x is not null) p, list_filter(a[9:18], lambda x: x is not null) q,
                  list_filter(a, lambda x: x is not null) w from v)
select vec_id, round(case when len(p) >= 7 then list_avg(p) end, 6) as domain_1,
       round(case when len(q) >= 9 then list_avg(q) end, 6) as domain_2, round(list_avg(w), 6) as overall from s
""")
def x18(t):
    a = F.col("a")
    return _vec(t).select("vec_id", r6(A.row_mean(F.slice(a, 1, 7), 7)).alias("domain_1"),
                          r6(A.row_mean(F.slice(a, 9, 10), 9)).alias("domain_2"),
                          r6(A.row_mean(a, 1)).alias("overall"))


@query("x19_row_statistics", f"""
with v as (select vec_id, {_VEC} a from embeddings), g as (select vec_id, a, list_filter(a, lambda x: x is not null) got from v),
     m as (select *, list_avg(got) mu from g)
select vec_id, cast(len(got) as integer) as answered, cast(len(a) - len(got) as integer) as missing,
  cast(len(list_distinct(got)) as integer) as distinct_values, round(mu, 6) as row_mean,
  round(sqrt(list_sum(list_transform(got, lambda x: (x - mu) * (x - mu))) / (len(got) - 1)), 6) as row_sd,
  round(list_avg(list_transform(got, lambda x: abs(x - mu))), 6) as row_mad
from m
""")
def x19(t):
    out = _vec(t).select("vec_id", *A.row_statistics(F.col("a")))
    return out.select("vec_id", "answered", "missing", "distinct_values", r6(F.col("row_mean")).alias("row_mean"),
                      r6(F.col("row_sd")).alias("row_sd"), r6(F.col("row_mad")).alias("row_mad"))


@query("x20_longest_run", """
with v as (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings),
  b as (select vec_id, i, x > 0 as s, row_number() over (partition by vec_id order by i) -
        row_number() over (partition by vec_id, x > 0 order by i) g from v),
  r as (select vec_id, s, g, count(*) n from b group by all)
select vec_id, cast(max(n) as integer) as longest from r group by vec_id
""")
def x20(t):
    return t.embeddings.select("vec_id", A.longest_run(F.transform("embedding", lambda v: v > 0)).alias("longest"))


@query("x21_fingerprint", """
select doc_id, sha256(text || '|' || case when doc_id % 3 = 0 then '<NA>' else source end || '|' || lang) as fingerprint from documents
""")
def x21(t):
    a = F.array("text", F.when(F.col("doc_id") % 3 != 0, F.col("source")), "lang")
    return t.documents.select("doc_id", X.fingerprint(a).alias("fingerprint"))


@query("x22_open_text_statistics", """
with f as (select conv_id, turn, list_filter([trim(text), case when turn % 2 = 0 then '  ' else role end, ''], lambda s: trim(s) <> '') a
           from conversations)
select conv_id, turn, cast(len(a) as integer) as filled,
       round(case when len(a) > 0 then list_avg(list_transform(a, lambda s: length(s))) else 0.0 end, 6) as mean_length,
       md5(array_to_string(a, ' ')) as joined_md5 from f
""")
def x22(t):
    s = X.open_text_stats([F.col("text"), F.when(F.col("turn") % 2 == 0, "  ").otherwise(F.col("role")), F.lit("")])
    return t.conversations.select("conv_id", "turn", s.alias("s")).select(
        "conv_id", "turn", "s.filled", r6(F.col("s.mean_length")).alias("mean_length"), F.md5("s.joined").alias("joined_md5"))


@query("x23_answer_key", """
select event_id, case when a is not null and b is not null and c is not null then
   cast(a = 'view' as integer) + cast(b = 'low' as integer) + cast(c = 1 as integer) end as score,
   case event_type when 'click' then 1.0::double when 'view' then 0.5::double when 'signup' then 2.0::double end as graded
from (select event_id, event_type, event_type a, case when value < 50 then 'low' when value < 200 then 'mid' end b, event_id % 4 c from events)
""")
def x23(t):
    b = F.when(F.col("value") < 50, "low").when(F.col("value") < 200, "mid")
    return t.events.select("event_id", A.key_score([F.col("event_type"), b, F.col("event_id") % 4], ["view", "low", 1]).alias("score"),
                           A.graded_score(F.col("event_type"), {"click": 1.0, "view": 0.5, "signup": 2.0}).alias("graded"))


@query("x24_branch_condition", """
select p_partkey, v is not distinct from 3.0 as eq, v is distinct from 3.0 as ne, v is distinct from 0.0 as nonzero, v is not null as present,
       p_partkey % 3 = 1 or p_partkey % 4 = 1 as any_box
from (select p_partkey, try_cast(case p_size % 5 when 4 then 'n/a' else cast(p_size % 5 as varchar) end as double) v from part)
""")
def x24(t):
    raw = F.when(F.col("p_size") % 5 == 4, "n/a").otherwise((F.col("p_size") % 5).cast("string"))
    df = t.part.select("p_partkey", raw.alias("gate"), (F.col("p_partkey") % 3).cast("string").alias("age___1"),
                       F.when(F.col("p_partkey") % 4 == 1, "1").alias("age___2"))
    return df.select("p_partkey", A.branch_condition({"field": "gate", "equals": 3}).alias("eq"),
                     A.branch_condition({"field": "gate", "not_equals": 3}).alias("ne"),
                     A.branch_condition({"field": "gate", "nonzero": True}).alias("nonzero"),
                     A.branch_condition({"field": "gate", "present": True}).alias("present"),
                     A.any_answered(df, "age").alias("any_box"))


@query("x25_calendar_features", """
with m as (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) n from orders group by 1)
select month, n, row_number() over (order by month) - 1 as t, month(month) as month_no, quarter(month) as quarter_no,
  round(sin(2 * pi() * month(month) / 12), 6) as sin1, round(cos(2 * pi() * month(month) / 12), 6) as cos1,
  round(sin(4 * pi() * month(month) / 12), 6) as sin2, round(cos(4 * pi() * month(month) / 12), 6) as cos2 from m
""")
def x25(t):
    m = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min("month").over(Window.partitionBy(F.lit(0)))  # one row per calendar month
    gap = F.months_between("month", first)
    out = m.select("month", "n", *D.calendar_features(F.col("month"), gap))
    return out.select("month", "n", "t", "month_no", "quarter_no",
                      *[r6(F.round(c, 9)).alias(c) for c in ("sin1", "cos1", "sin2", "cos2")])


@query("x26_projection_status", f"""
select o_orderkey, d - 30 as earliest, d + 60 as latest, case when d is null then 'needs_review' when d - date '{NOW}' < -30 then 'overdue'
  when d - date '{NOW}' < 0 then 'recent_past' when d - date '{NOW}' <= 60 then 'due_soon' else 'future' end as status
from (select o_orderkey, case when o_orderkey % 9 <> 0 then cast(o_orderdate as date) end d from orders)
""")
def x26(t):
    due = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", *D.projection_status(due, F.lit(NOW).cast("date")))


@query("x27_ratio_status", """
with y as (select year(o_orderdate) yr, count(*) n from orders group by 1),
  p as (select y.yr, case when y.yr % 4 <> 3 then y.n end actual, coalesce(q.n, 0) target from y left join y q on q.yr = y.yr - 1)
select cast(yr as integer) as yr, round(actual / nullif(cast(target as double), 0), 6) as ratio,
  coalesce(cast(cast(round_even(actual / nullif(cast(target as double), 0) * 100, 0) as bigint) as varchar) || '%', 'N/A') as pct,
  case when actual is null then '' when target = 0 then 'N/A' when actual >= target then 'On Target' else 'Below Target' end as report_status,
  case when target = 0 then 'N/A' when actual is null then case when yr = 1999 then 'Pending' else '' end
       when actual >= target then 'On Target' else 'Below Target' end as text_status,
  case when target = 0 then 'N/A' when actual is null then 'Not reported' when actual >= target then 'On target' else 'Behind' end as long_status
from p
""")
def x27(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    prev = y.select((F.col("yr") + 1).alias("yr"), F.col("n").alias("target"))
    df = y.join(prev, "yr", "left").withColumn("target", F.coalesce("target", F.lit(0)))
    df = df.withColumn("actual", F.when(F.col("yr") % 4 != 3, F.col("n")))
    a, g = F.col("actual"), F.col("target")
    return df.select("yr", r6(P.ratio(a, g)).alias("ratio"), P.percent_text(a, g).alias("pct"),
                     P.status(a, g).alias("report_status"),
                     P.status(a, g, "text", F.col("yr") == 1999).alias("text_status"),
                     P.status(a, g, "long").alias("long_status"))


@query("x28_small_cells", """
with c as (select n_nationkey as nation, count(s_suppkey) n, 10 target from nation left join supplier on s_nationkey = n_nationkey group by 1)
select nation, case when n between 1 and 9 then '<10' else cast(n as varchar) end as shown,
  case when n = 0 then '0' when n < 10 then '<10' else cast(n - n % 10 as varchar) || '–' || cast(n - n % 10 + 9 as varchar) end as band,
  case when n not between 1 and 9 then round(n / 10.0, 6) end as ratio,
  case when n between 1 and 9 then 'Suppressed' when n >= 10 then 'On Target' else 'Below Target' end as status
from (select nation, n * (1 + nation % 5) n from c)
""")
def x28(t):
    c = (t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
         .groupBy(F.col("n_nationkey").alias("nation")).agg(F.count("s_suppkey").alias("n")))
    n = F.col("n") * (1 + F.col("nation") % 5)
    return c.select("nation", P.public_count(n).alias("shown"), P.public_band(n).alias("band"),
                    r6(P.public_ratio(n, F.lit(10))).alias("ratio"), P.public_status(n, F.lit(10)).alias("status"))


@query("x29_reason_text", """
select o_orderkey, concat_ws('; ', case when o_orderdate >= timestamp '2001-01-01' then 'late' end,
  case when o_totalprice > 400000 then 'large' end, case when o_orderpriority = '5-LOW' then 'low priority' end) as reason from orders
""")
def x29(t):
    return t.orders.select("o_orderkey", A.reasons([
        (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "late"),
        (F.col("o_totalprice") > 400000, "large"), (F.col("o_orderpriority") == "5-LOW", "low priority")]).alias("reason"))


@query("x30_field_flags", DICT + """
select row_id as p_partkey, required_field = 'y' as is_required, identifier = 'y' as is_identifier, branching_logic <> '' as has_branching,
  validation <> '' as is_validated, matrix_group_name <> '' as is_matrix, field_label = '' as missing_label,
  split_part(field_name, '_', 1) as field_prefix, tags as action_tags, tags <> '' as tag_hidden,
  case when validation <> '' then 'text:integer' else field_type end as type_detail, cast(n_choices as integer) as choice_count
from d
""")
def x30(t):
    from ..operators.metadata import dictionary_from_parts, structural_flags
    return structural_flags(dictionary_from_parts(t.part)).select(
        F.col("row_id").alias("p_partkey"), "is_required", "is_identifier", "has_branching", "is_validated", "is_matrix",
        "missing_label", "field_prefix", "action_tags", "tag_hidden", "type_detail", "choice_count")


@query("x31_secret_redaction", """
select doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' secret: ' || source || ' Bearer abcdef' || source || 'xyz12345',
   '((?:api[\\s_-]*token|access[\\s_-]*token|password|secret)\\s*[:=]\\s*)([^\\s,;]+)', '\\1[REDACTED]', 'gi'),
   '\\bBearer\\s+[A-Za-z0-9._~+/=-]{12,}', '[REDACTED]', 'gi'), '\\b[0-9A-Fa-f]{32,64}\\b', '[REDACTED]', 'g') as redacted from documents
""")
def x31(t):
    text = F.concat(F.col("text"), F.lit(" secret: "), F.col("source"), F.lit(" Bearer abcdef"), F.col("source"), F.lit("xyz12345"))
    return t.documents.select("doc_id", P.redact_text(text).alias("redacted"))


@query("x32_sensitive_labels", """
select event_id, '[REDACTED]' as access_token, event_type,
  '{"k":"[REDACTED]"}' as props from events
""")
def x32(t):
    df = t.events.select("event_id", F.col("user_id").cast("string").alias("access_token"), "event_type",
                         P.redact_json(F.col("props"), extra_sensitive="^k$").alias("props"))
    return P.redact_frame(df)


@query("x33_formula_guard", """
select doc_id, case when doc_id % 4 < 2 then '''' || v else v end as cell
from (select doc_id, (case doc_id % 4 when 0 then '=' when 1 then chr(9) || '-' when 2 then '' else '''' end) || text v from documents)
""")
def x33(t):
    k = F.col("doc_id") % 4
    v = F.concat(F.when(k == 0, "=").when(k == 1, "\t-").when(k == 2, "").otherwise("'"), F.col("text"))
    return t.documents.select("doc_id", P.spreadsheet_safe(v).alias("cell"))


@query("x34_continuity_score", f"""
with h as (select l_suppkey s, o_custkey c, count(*) k, max(l_shipdate) last from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
  d as (select s, c, k, case when k % 5 <> 0 then greatest(0, date_diff('day', cast(last as date), date '{NOW}')) end gap from h)
select s as supplier, c as customer, k as visits,
  round(case when c % 4 = 0 then 1 - f else f end, 6) as phi
from (select *, (1 - exp(-k / 2.0)) * coalesce(exp(-gap / 75.0), 0) f from d)
""")
def x34(t):
    h = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy(F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("customer"))
         .agg(F.count(F.lit(1)).alias("visits"), F.max("l_shipdate").alias("last")))
    days = F.when(F.col("visits") % 5 != 0, F.datediff(F.lit(NOW).cast("date"), F.to_date("last")))
    sigma = F.when(F.col("customer") % 4 == 0, -1).otherwise(1)
    return h.select("supplier", "customer", "visits", r6(S.continuity(F.col("visits"), days, sigma)).alias("phi"))


@query("x35_preference_score", """
with h as (select distinct o_custkey c_custkey, l_suppkey s_suppkey from lineitem join orders on l_orderkey = o_orderkey),
  p as (select h.*, c_mktsegment seg from h join customer using (c_custkey))
select c_custkey, s_suppkey, round(least(1.0, greatest(0.0,
   case when c_custkey % 3 = 0 and s_suppkey % 4 = 0 then 1.0 when c_custkey % 5 = 0 and s_suppkey % 4 = 1 then 0.0
        when c_custkey % 3 = 0 then 0.35 else 0.5 end +
   case when seg = 'BUILDING' then 0.0 else (case when s_suppkey % 2 = 0 then 1.0 else 0.5 end - 0.5) * 0.5 end))::double, 6) as omega
from p
""")
def x35(t):
    from ..operators.candidates import served_pairs
    pairs = served_pairs(t.lineitem, t.orders, "o_orderkey", "l_orderkey", "l_suppkey", "o_custkey")
    df = pairs.select(F.col("l_suppkey").alias("s_suppkey"), F.col("o_custkey").alias("c_custkey")).join(t.customer, "c_custkey")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    none = F.array().cast("array<bigint>")
    preferred = F.when(c % 3 == 0, F.array(s - s % 4)).otherwise(none)
    avoid = F.when(c % 5 == 0, F.array(s - s % 4 + 1)).otherwise(none)
    words = F.array().cast("array<string>")
    need = F.when(F.col("c_mktsegment") == "BUILDING", words).otherwise(F.array(F.lit("a"), F.lit("b")))
    have = F.when(s % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return df.select("c_custkey", "s_suppkey", r6(S.preference(s, preferred, avoid, need, have)).alias("omega"))


@query("x36_capacity_burden", """
with h as (select l_suppkey s, count(*) n, sum(l_quantity) / 100.0 as "hours", sum(l_quantity * l_tax) travel from lineitem group by 1),
  c as (select s, n, "hours", travel, case when s % 10 = 9 then 1e-6 else greatest(1e-6, 40.0 * (1 + s % 3) * least(1.0, ((n % 25) + 1) / 21.0)) end cap from h)
select s as supplier, round(cap, 6) as capacity, round("hours" + 1.5 + 2.0 * travel / 60, 6) as burden,
  round(1 - least(1, greatest(0, ("hours" + 1.5 + 2.0 * travel / 60) / cap)), 6) as relief from c
""")
def x36(t):
    h = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") / 100.0).alias("hours"), F.sum(F.col("l_quantity") * F.col("l_tax")).alias("travel"))
    full = F.when(F.col("supplier") % 10 == 9, 0.0).otherwise(40.0 * (1 + F.col("supplier") % 3))
    cap = S.ramped_capacity(full, F.col("n") % 25)
    load = S.burden(F.col("hours"), F.lit(1.5), F.col("travel"))
    return h.select("supplier", r6(cap).alias("capacity"), r6(load).alias("burden"), r6(S.burden_relief(load, cap)).alias("relief"))


@query("x37_weighted_total", """
select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(0.45 * a, 6) as c_phi, round(0.15 * b, 6) as c_omega, round(0.30 * c, 6) as c_psi,
  round(0.10 * d, 6) as c_p, round(least(1, greatest(0, 0.45 * a + 0.15 * b + 0.30 * c + 0.10 * d)), 6) as total
from (select *, l_quantity / 50.0 a, l_discount * 10 b, 1 - l_tax * 10 c, case when l_linestatus = 'F' then 1.0::double else 0.0 end d from lineitem)
""")
def x37(t):
    from ..operators.candidates import line_components
    parts = line_components()
    con = S.contributions(parts)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                             *[r6(c).alias(f"c_{n}") for n, c in con.items()], r6(S.weighted_total(parts)).alias("total"))


@query("x38_freshness_class", """
with l as (select user_id, max(ts) last from events group by 1),
  a as (select user_id, epoch(timestamp '2024-01-31 00:00:00') - epoch(last) age, case user_id % 3 when 0 then 48 when 1 then 200 else 1000 end h,
          user_id % 11 <> 0 ok from l)
select user_id, case when not ok then 'sync_failed'
  when age <= case when h <= 72 then 900 when h <= 336 then 14400 else 86400 end then 'fresh'
  when age <= case when h <= 72 then 3600 when h <= 336 then 86400 else 259200 end then 'stale' else 'expired' end as freshness from a
""")
def x38(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    h = F.when(F.col("user_id") % 3 == 0, 48).when(F.col("user_id") % 3 == 1, 200).otherwise(1000)
    return last.select("user_id", S.freshness_class(age, h, F.col("user_id") % 11 != 0).alias("freshness"))


@query("x39_window_urgency", f"""
with w as (select o_orderkey, case when o_orderkey % 13 <> 0 then cast(o_orderdate as date) - 30 end s,
             case when o_orderkey % 13 <> 0 then cast(o_orderdate as date) + 30 end e, o_orderstatus = 'F' done from orders),
 k as (select *, case when done then 'complete' when s is null then 'unknown' when date '{NOW}' > e then 'overdue'
         when date '{NOW}' < s then 'upcoming' when e - date '{NOW}' <= 14 then 'closing' else 'open' end status from w)
select o_orderkey, status, round(case when status = 'overdue' then 1.0 when status in ('open', 'closing')
   then greatest(0.0, least(1.0, 1.0 - (e - date '{NOW}') / 60.0)) else 0.0 end, 6) as urgency from k
""")
def x39(t):
    d = F.when(F.col("o_orderkey") % 13 != 0, F.to_date("o_orderdate"))
    s, e, now = F.date_sub(d, 30), F.date_add(d, 30), F.lit(NOW).cast("date")
    st = D.window_status(s, e, now, F.col("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", st.alias("status"),
                           r6(D.urgency(st, D.window_days_remaining(s, e, now), F.lit(60))).alias("urgency"))


@query("x40_offer_window", """
select o_orderkey, round(8 + m / 60.0, 6) as earliest_hour, round(greatest(8 + m / 60.0, 17 - m / 60.0 - d), 6) as latest_hour
from (select o_orderkey, cast(o_custkey % 240 as double) m, 1.0 + (o_orderkey % 5) d from orders)
""")
def x40(t):
    w = D.offer_window((F.col("o_custkey") % 240).cast("double"), 1.0 + F.col("o_orderkey") % 5)
    return t.orders.select("o_orderkey", *w).select("o_orderkey", r6(F.col("earliest_hour")).alias("earliest_hour"),
                                                    r6(F.col("latest_hour")).alias("latest_hour"))


@query("x41_minimal_projection", "select c_custkey, c_mktsegment from customer")
def x41(t):
    from ..sources.readers import minimal_projection
    return minimal_projection(t.customer, ["c_custkey", "c_phone", "c_mktsegment", "c_custkey"])


@query("x42_load_band", """
with u as (select distinct user_id from events), d as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) dt),
  n as (select user_id, cast(ts as date) as day, count(*) n, max(value) > 300 cut from events group by 1, 2)
select u.user_id, cast(d.dt as date) as day, coalesce(n.n, 0) as items,
  case when coalesce(n.cut, false) then 'unknown' when coalesce(n.n, 0) >= 3 then 'busy' when coalesce(n.n, 0) >= 1 then 'light' else 'open' end as band
from u join d on true left join n on n.user_id = u.user_id and n.day = cast(d.dt as date)
""")
def x42(t):
    n = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("items"), (F.max("value") > 300).alias("cut"))
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    # the calendar is spread inside each member's row, so no cross join is planned
    grid = n.groupBy("user_id").agg(F.lit(1).alias("_")).select("user_id", F.explode(days).alias("day"))
    df = grid.join(n, ["user_id", "day"], "left")
    items = F.coalesce("items", F.lit(0))
    return df.select("user_id", "day", items.alias("items"), S.load_band(items, F.coalesce("cut", F.lit(False))).alias("band"))


@query("x43_row_latest", """
select l_orderkey, l_linenumber, l_suppkey, l_partkey, strftime(greatest(l_shipdate, o_orderdate, case when l_linenumber <> 3 then o_orderdate + interval 40 day end),
  '%Y-%m-%d') as latest from lineitem join orders on l_orderkey = o_orderkey
""")
def x43(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    later = F.when(F.col("l_linenumber") != 3, F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "yyyy-MM-dd HH:mm:ss")).otherwise("not yet")
    cols = [F.col("l_shipdate").cast("string"), F.col("o_orderdate").cast("string"), later]
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.date_format(D.latest_of(cols), "yyyy-MM-dd").alias("latest"))


@query("x44_metadata_selection", """
with r as (select p_brand, min(p_size % 7) lo, max(p_size % 7) hi, count(distinct p_size % 7) k from part group by 1)
select p_brand as field, case when lo = 1 and hi = k and k between 4 and 7 then hi end as scale from r
where lo = 1 and hi = k and k between 4 and 7 union all
select 'Z' || p_brand, max(p_size % 5 + 1) from part group by 1 having min(p_size % 5 + 1) = 1 and max(p_size % 5 + 1) between 4 and 7
  and count(distinct p_size % 5 + 1) = max(p_size % 5 + 1)
""")
def x44(t):
    from ..operators.metadata import likert_fields
    a = t.part.select(F.col("p_brand").alias("field"), (F.col("p_size") % 7).alias("code"))
    b = t.part.select(F.concat(F.lit("Z"), "p_brand").alias("field"), (F.col("p_size") % 5 + 1).alias("code"))
    cells = a.unionByName(b).groupBy("field").agg(F.concat_ws(" | ", F.array_sort(F.collect_set(
        F.concat(F.col("code").cast("string"), F.lit(", c"))))).alias("choices"))
    return likert_fields(cells)


@query("x45_unavailability_text", """
select doc_id, case doc_id % 5 when 0 then 'Ana' when 1 then 'Bo' when 2 then 'Cy' end as name,
  case doc_id % 5 when 0 then 'out' when 1 then 'unavailable for visits' when 2 then 'on leave' end as status from documents
""")
def x45(t):
    k = F.col("doc_id") % 5
    head = F.substring("text", 1, 1)
    banner = (F.when(k == 0, "Ana Out").when(k == 1, "Aug 11 Bo  Unavailable for Visits").when(k == 2, "11. Cy Lee is on leave")
              .when(k == 3, F.concat(F.col("text"), F.lit(" is free"))).otherwise(F.concat(head, F.lit(" 1 2 3 4 Out now"))))
    return t.documents.select("doc_id", X.unavailability(banner).alias("u")).select("doc_id", "u.name", "u.status")
