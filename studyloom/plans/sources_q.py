"""Queries over sources and sinks (inventory 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import TABLES, scratch_dir
from ..sources import readers as R
from ..sources import sinks as K
from .registry import query


@query("s01_headerless_scan", """
select cast(o_orderkey as varchar) as c0, cast(o_custkey as varchar) as c1, o_orderstatus as c2, o_orderpriority as c3 from orders
""")
def s01(t):
    path = scratch_dir(t.spark, "headerless")
    t.orders.select(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"
                    ).write.option("header", False).csv(path)
    df = R.headerless_csv(t.spark, path, 4)
    return df.where(F.col("_bad").isNull()).drop("_bad")


def _sheet(t):
    """Orders laid out as three tables side by side, one header line per file position."""
    k = F.col("o_orderkey")
    head = k % 1000 == 0
    return t.orders.select(
        F.when(head, "participant_id").when(k % 17 == 0, " ").otherwise(k.cast("string")).alias("c0"),
        F.date_format("o_orderdate", "dd-MMM-yy").alias("c1"), F.col("o_orderpriority").alias("c2"), F.lit(None).cast("string").alias("c3"),
        F.when(head, "Month").when(k % 3 == 0, F.date_format("o_orderdate", "MMM-yy")).alias("c4"), (k % 9).cast("string").alias("c5"),
        F.lit("").alias("c6"), F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy")).alias("c7"), (k % 11).cast("string").alias("c8"))


@query("s02_side_by_side_blocks", """
with o as (select o_orderkey k, o_orderdate d, o_orderpriority p from orders)
select 'roster' as block, cast(k as varchar) as key, strftime(d, '%d-%b-%y') || '/' || p as cells from o where k % 1000 <> 0 and k % 17 <> 0
union all select 'monthly', strftime(d, '%b-%y'), cast(k % 9 as varchar) from o where k % 1000 <> 0 and k % 3 = 0
union all select 'yearly', strftime(d, '%Y'), cast(k % 11 as varchar) from o where k % 5 = 0
""")
def s02(t):
    out = R.split_blocks(_sheet(t), {"roster": [0, 1, 2], "monthly": [4, 5], "yearly": [7, 8]}, {"participant_id", "month"})
    return out.select("block", "key", F.concat_ws("/", "cells").alias("cells"))


@query("s03_verified_cache", "select o_orderstatus as value, count(*) as n from orders group by 1 union all select c_mktsegment, count(*) from customer group by 1")
def s03(t):
    paths = [t.path("orders"), t.path("customer")]
    side = scratch_dir(t.spark, "sidecar")
    R.parquet_fingerprints(t.spark, paths).write.parquet(side)
    said = t.spark.read.parquet(side)
    out = None
    for path, key in zip(paths, ("o_orderstatus", "c_mktsegment")):
        df = R.verified_parquet(t.spark, [path], said.where(R.file_key("path").startswith(R.file_key(F.lit(path)))))
        one = df.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s04_file_inventory", " union all ".join(f"select '{n}' as \"table\", count(*) as n_rows, (select count(*)::integer from (describe {n})) as n_columns from {n}" for n in TABLES))
def s04(t):
    """Every file is fingerprinted; the result adds them up per table, since the number of files and their hashes are not in the tables' content."""
    files = R.file_inventory(t.spark, [t.path(n) for n in TABLES]).withColumn("table", F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1))
    return files.where("row_hash rlike '^[0-9]+$'").groupBy("table").agg(F.sum("rows").alias("n_rows"), F.max("columns").alias("n_columns"))


@query("s05_namespaced_union", """
select 'customer' as source, 'customer_' || c_custkey as uid, cast(c_custkey as varchar) as record_id, c_acctbal as acctbal, c_mktsegment as segment from customer
union all select 'supplier', 'supplier_' || s_suppkey, cast(s_suppkey as varchar), s_acctbal, null from supplier
""")
def s05(t):
    c = t.customer.select(F.col("c_custkey").cast("string").alias("record_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").cast("string").alias("record_id"), F.col("s_acctbal").alias("acctbal"))
    return R.namespaced_union({"customer": c, "supplier": s}, "record_id", {"customer": c.count(), "supplier": s.count()})


@query("s06_alias_scan", """
select doc_id as row_id, case when doc_id % 4 <> 0 then cast(quality as double) end as quality, toxic,
  cast(doc_id % 4 = 0 as integer) as unreadable from labels
""")
def s06(t):
    raw = t.labels.select(F.col("doc_id").alias("Row ID"), F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("quality").cast("string")).alias("Quality-Code"),
                          F.col("toxic").alias("TOXIC"))
    return R.aliased_scan(raw, {"row_id": [], "quality": ["quality code"], "toxic": ["flag"]}, {"quality"}, {"toxic": "toxic"})


def _coded(t):
    status = F.col("o_orderstatus")
    coded = t.orders.select("o_orderkey", status.alias("st"), F.col("o_orderpriority").alias("pr"))
    k = F.col("o_orderkey")
    labelled = t.orders.select(
        "o_orderkey", F.when(status == "F", "Finished").when(status == "O", "Open").otherwise("Partial").alias("st_label"),
        F.when(k % 2 == 0, "even").otherwise(F.col("o_orderpriority")).alias("pr_label"))
    return coded, labelled


@query("s07_label_decode", """
select 'st' as field, count(*) as cells, count(*) as agreeing from orders
union all select 'pr', count(*), 0 from orders
""")
def s07(t):
    coded, labelled = _coded(t)
    return R.decode_agreement(coded, labelled, "o_orderkey", {"st": "st_label", "pr": "pr_label"})


@query("s07_label_dictionary", """
select 'st' as field, o_orderstatus as code, case o_orderstatus when 'F' then 'Finished' when 'O' then 'Open' else 'Partial' end as label, count(*) as n
from orders group by 1, 2, 3
""")
def s07b(t):
    coded, labelled = _coded(t)
    return R.decode_dictionary(coded, labelled, "o_orderkey", {"st": "st_label", "pr": "pr_label"})


@query("s08_safe_csv", """
select doc_id, '[REDACTED]' as api_token, case when doc_id % 2 = 0 then '''=' || lang else lang end as cell,
   regexp_replace(regexp_replace(source || ' token', 'x', 'x'), 'y', 'y') as note from documents
""")
def s08(t):
    path = scratch_dir(t.spark, "csv")
    df = t.documents.select("doc_id", F.col("source").alias("api_token"),
                            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("="), "lang")).otherwise(F.col("lang")).alias("cell"),
                            F.concat("source", F.lit(" token")).alias("note"))
    K.write_safe_csv(df, path)
    return K.read_safe_csv(t.spark, path, "doc_id bigint, api_token string, cell string, note string")


@query("s08_safe_csv_documents", """
with r as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '((?:api[\\s_-]*token|access[\\s_-]*token|password|secret)\\s*[:=]\\s*)([^\\s,;]+)', '\\1[REDACTED]', 'gi'),
   '\\bBearer\\s+[A-Za-z0-9._~+/=-]{12,}', '[REDACTED]', 'gi'), '\\b[0-9A-Fa-f]{32,64}\\b', '[REDACTED]', 'g') x from documents)
select doc_id, true as same, cast(length(x) + cast(regexp_matches(x, '^[ \\t\\r\\n]*[=+@-]') as integer) as integer) as n_chars from r
""")
def s08b(t):
    path = scratch_dir(t.spark, "csv")
    safe = K.write_safe_csv(t.documents.select("doc_id", "text"), path)
    back = K.read_safe_csv(t.spark, path, "doc_id bigint, text string")
    j = back.withColumnRenamed("text", "back").join(safe, "doc_id")
    return j.select("doc_id", (F.col("back") == F.col("text")).alias("same"), F.length("back").alias("n_chars"))


@query("s09_restricted_split", """
select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2
""")
def s09(t):
    base = scratch_dir(t.spark, "split")
    deny = {"c_name"}
    K.write_split(t.customer, base, "customer", True, deny)
    summary = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return t.spark.read.parquet(K.write_split(summary, base, "segments", False, deny))


@query("s10_output_manifest", """
select 'orders by status' as caption, count(distinct o_orderstatus) as rows, 2 as columns from orders
union all select 'customers', count(*), 5 from customer
""")
def s10(t):
    base = scratch_dir(t.spark, "manifest")
    K.write_with_manifest(t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), f"{base}/a", f"{base}/manifest", "orders by status")
    K.write_with_manifest(t.customer, f"{base}/b", f"{base}/manifest", "customers")
    return t.spark.read.parquet(f"{base}/manifest").select("caption", "rows", "columns")


@query("s11_dated_publish", """
with n as (select cast(ts as date) d, event_type, count(*) n from events group by 1, 2)
select 'dated' as copy, d as report_date, event_type, n from n union all select 'latest', d, event_type, n from n where d = (select max(d) from n)
""")
def s11(t):
    base = scratch_dir(t.spark, "publish")
    n = t.events.groupBy(F.to_date("ts").alias("report_date"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    K.publish_snapshot(n, base, "report_date", "event_type", {"view", "click", "signup", "purchase", "error"})
    dated = t.spark.read.parquet(f"{base}/dated").select(F.lit("dated").alias("copy"), "report_date", "event_type", "n")
    return dated.unionByName(K.read_latest(t.spark, base).select(F.lit("latest").alias("copy"), "report_date", "event_type", "n"))


@query("s12_json_manifest", """
with n as (select r_name project, c_mktsegment category, count(*) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
select '{"project":"' || project || '","counts":[' || string_agg('{"category":"' || category || '","count":"' || case when n between 1 and 9 then '<10' else cast(n as varchar) end || '"}', ',' order by category)
  || '],"policies":{"small_cells":"under ten hidden","dates":"first valid"},"checks":{"has_rows":true}}' as value from n group by project
""")
def s12(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n = j.groupBy(F.col("r_name").alias("project"), F.col("c_mktsegment").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    out = K.run_manifest(n, "project", {"small_cells": "under ten hidden", "dates": "first valid"})
    path = scratch_dir(t.spark, "run-manifest")
    out.select("manifest").write.text(path)
    return t.spark.read.text(path)


def facts(t):
    """Orders as scoring runs, lineitem rows as their candidates, the dearest one as the outcome."""
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("family_id"), F.to_date("o_orderdate").alias("run_date"),
                           F.col("o_orderpriority").alias("checkpoint"))
    cand = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("staff_id"), F.col("l_extendedprice").alias("score"))
    cand = cand.join(runs.select("run_id", "run_date"), "run_id")
    best = cand.groupBy("run_id", "run_date").agg(F.max_by("staff_id", F.struct("score", "staff_id")).alias("staff_id"))
    return runs, cand, best


@query("s13_decision_facts", """
with c as (select l_orderkey run_id, count(*) n, max(l_extendedprice) best from lineitem group by 1)
select cast(year(o_orderdate) as integer) as yr, count(*) as runs, cast(sum(coalesce(n, 0)) as bigint) as candidates, count(n) as outcomes,
  round(sum(best), 2) as best_total
from orders left join c on run_id = o_orderkey group by 1
""")
def s13(t):
    base = scratch_dir(t.spark, "facts")
    runs, cand, best = facts(t)
    month = lambda df: df.withColumn("run_month", F.date_format("run_date", "yyyy-MM"))
    K.append_facts(base, month(runs), month(cand), month(best), "run_month")
    read = t.spark.read.parquet
    r = read(f"{base}/run").withColumn("yr", F.year("run_date")).groupBy("yr").agg(F.count(F.lit(1)).alias("runs"))
    c = read(f"{base}/candidate").groupBy("run_id", "run_date").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    c = c.groupBy(F.year("run_date").alias("yr")).agg(F.sum("n").alias("candidates"), F.round(F.sum("top"), 2).alias("best_total"))
    o = read(f"{base}/outcome").groupBy(F.year("run_date").alias("yr")).agg(F.count(F.lit(1)).alias("outcomes"))
    return r.join(c, "yr").join(o, "yr")


@query("s14_period_scan", """
select l_orderkey as run_id, l_suppkey as staff_id, l_linenumber, l_partkey, l_extendedprice from lineitem
where l_orderkey in (select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-04-01')
""")
def s14(t):
    runs = R.runs_between(t.orders, "1997-01-01", "1997-04-01", "o_orderdate").select(F.col("o_orderkey").alias("run_id"))
    c = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("staff_id"), "l_linenumber", "l_partkey", "l_extendedprice")
    return R.of_runs(c, runs)


@query("s15_inbox_ingest", """
with seen as (select distinct sha256(text) h from documents where doc_id % 3 = 0),
  f as (select doc_id, sha256(text) content_hash from documents where doc_id % 3 <> 0 and doc_id % 10 <> 1)
select min(doc_id) as doc_id, content_hash from f where content_hash not in (select h from seen) group by content_hash
""")
def s15(t):
    d = t.documents.select("doc_id", "text")
    seen = d.where(F.col("doc_id") % 3 == 0).select(F.sha2("text", 256).alias("content_hash")).distinct()
    batch = d.where(F.col("doc_id") % 3 != 0).withColumn("text", F.when(F.col("doc_id") % 10 != 1, F.col("text")))
    return R.unseen(batch.select("doc_id", "text"), seen, F.col("text")).select("doc_id", "content_hash")


@query("s16_review_state", """
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn, count(*) over (partition by user_id) n from events)
select user_id as block_id, event_type <> 'error' as confirmed, event_id % 4 as reviewer, n as decisions, event_type <> 'error' as is_evidence from r where rn = 1
""")
def s16(t):
    d = t.events.select(F.col("user_id").alias("block_id"), "ts", "event_id", (F.col("event_type") != "error").alias("confirmed"),
                        (F.col("event_id") % 4).alias("reviewer"))
    return R.latest_review(d, "block_id", ["ts", "event_id"], ["confirmed", "reviewer"]).withColumn(
        "is_evidence", F.col("reviewer").isNotNull() & F.col("confirmed"))


@query("s16_rejection_rate", """
select event_id % 4 as reviewer, count(*) as reviewed, round(avg(cast(event_type = 'error' as integer)), 6) as rejection_rate from events group by 1
""")
def s16b(t):
    return t.events.groupBy((F.col("event_id") % 4).alias("reviewer")).agg(
        F.count(F.lit(1)).alias("reviewed"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("rejection_rate"))


@query("s17_compact_export", """
select p_partkey, dense_rank() over (order by p_brand) as p_brand_code, dense_rank() over (order by p_type) as p_type_code,
  cast(cast(p_size > 25 as integer) + 2 * cast(p_retailprice > 1000 as integer) + 4 * cast(p_type = 'PROMO' as integer) as integer) as flags from part
""")
def s17(t):
    return K.compact_export(t.part, ["p_brand", "p_type"], [("large", F.col("p_size") > 25), ("dear", F.col("p_retailprice") > 1000),
                                                          ("promo", F.col("p_type") == "PROMO")], ["p_partkey"])


@query("s17_code_tables", """
select 'p_brand' as field, p_brand as value, dense_rank() over (order by p_brand) as code from (select distinct p_brand from part)
union all select 'p_name', p_name, dense_rank() over (order by p_name) from (select distinct p_name from part)
""")
def s17b(t):
    a = K.code_table(t.part, "p_brand").select(F.lit("p_brand").alias("field"), F.col("p_brand").alias("value"), "code")
    return a.unionByName(K.code_table(t.part, "p_name").select(F.lit("p_name").alias("field"), F.col("p_name").alias("value"), "code"))


