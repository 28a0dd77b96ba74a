"""Queries over group statistics (inventory A39-A45, A66-A67)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .models_q import domain, domain_sql
from .registry import query
from .series_q import r

SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("a39_crosstab", "select c_nationkey as nation, " + ", ".join(
    [f"count(*) filter (c_mktsegment = '{s}') as \"n_{s}\"" for s in SEG] + [f"round(count(*) filter (c_mktsegment = '{s}') * 100.0 / count(*), 6) as \"pct_{s}\"" for s in SEG]) + " from customer group by 1")
def a39(t):
    return r(S.crosstab(t.customer.withColumnRenamed("c_nationkey", "nation"), "nation", "c_mktsegment", SEG))


@query("a40_chi_square", """
with c as (select c_mktsegment a, c_nationkey b, count(*) n from customer group by 1, 2), ra as (select a, sum(n) r from c group by 1), cb as (select b, sum(n) k from c group by 1), z as (select sum(n) total from c),
 g as (select sum((coalesce(c.n, 0) - r * k / cast(total as double)) ^ 2 / (r * k / cast(total as double))) st from ra cross join cb cross join z left join c on c.a = ra.a and c.b = cb.b)
select cast(total as bigint) as total, round(st, 6) as statistic, (select count(*) - 1 from ra) * (select count(*) - 1 from cb) as dof, round(sqrt(st / (total * (least((select count(*) from ra), (select count(*) from cb)) - 1))), 6) as cramers_v,
  (select min(r) from ra) * (select min(k) from cb) / cast(total as double) < 5 as small_expected from g, z
""")
def a40(t):
    return r(S.chi_square(t.customer, "c_mktsegment", "c_nationkey").drop("p_value"))


@query("a40_chi_square_p")
def a40b(t):
    return r(S.chi_square(t.lineitem, "l_returnflag", "l_linestatus"))


_RANK = """
with k as (select {g} g, {v} v, rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0 rk from {t}),
 s as (select g, count(*) n, sum(rk) rs from k group by 1), ti as (select sum(c ^ 3 - c) ties from (select count(*) c from k group by v)), z as (select cast(count(*) as double) n from k)
"""


@query("a41_kruskal_wallis", _RANK.format(g="c_mktsegment", v="c_acctbal", t="customer") + """
, h as (select (12.0 / (z.n * (z.n + 1)) * sum(rs * rs / s.n) - 3 * (z.n + 1)) / (1 - ties / (z.n ^ 3 - z.n)) h, count(*) groups, z.n from s, z, ti group by z.n, ties)
select groups, cast(n as bigint) as n, round(h, 6) as h, round((h - groups + 1) / (n - groups), 6) as epsilon_squared from h
""")
def a41(t):
    return r(S.kruskal_wallis(t.customer, "c_mktsegment", "c_acctbal").drop("p_value"))


@query("a41_mann_whitney", _RANK.format(g="l_returnflag", v="l_quantity", t="lineitem where l_returnflag in ('A', 'R')") + """
, u as (select (select rs from s where g = 'A') ra, (select n from s where g = 'A') na, (select n from s where g = 'R') nb)
select na as n_a, nb as n_b, round(ra - na * (na + 1) / 2, 6) as u, round((ra - na * (na + 1) / 2 - cast(na as double) * nb / 2) / sqrt(cast(na as double) * nb / 12 * ((z.n + 1) - ties / (z.n * (z.n - 1)))), 6) as z from u, z, ti
""")
def a41b(t):
    return r(S.mann_whitney(t.lineitem, "l_returnflag", "l_quantity", "A", "R").drop("p_value"))


@query("a42_effect_size", """
with g as (select c_nationkey nation, count(*) filter (c_mktsegment = 'BUILDING') n_a, count(*) filter (c_mktsegment = 'MACHINERY') n_b, avg(c_acctbal) filter (c_mktsegment = 'BUILDING') ma, avg(c_acctbal) filter (c_mktsegment = 'MACHINERY') mb,
  var_samp(c_acctbal) filter (c_mktsegment = 'BUILDING') va, var_samp(c_acctbal) filter (c_mktsegment = 'MACHINERY') vb from customer group by 1)
select nation, n_a, n_b, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) as d from g
""")
def a42(t):
    return r(S.cohens_d(t.customer.withColumnRenamed("c_nationkey", "nation"), ["nation"], "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"))


@query("a42_false_discovery", """
with p as (select c_nationkey nation, n_regionkey fam, abs(avg(c_acctbal)) / 10000 p from customer join nation on c_nationkey = n_nationkey group by 1, 2),
 k as (select *, least(1.0, p * count(*) over (partition by fam) / row_number() over (partition by fam order by p, nation)) raw, row_number() over (partition by fam order by p, nation) rk from p)
select nation, fam as family, round(p, 6) as p, round(min(raw) over (partition by fam order by rk desc), 6) as q_value from k
""")
def a42b(t):
    p = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("family")).agg((F.abs(F.avg("c_acctbal")) / 10000).alias("p"))
    return r(S.benjamini_hochberg(p, ["family"], "p", "nation"))


_WIL = """
with c as (select l_returnflag g, l_linenumber ln, count(*) n, count(*) filter (l_linestatus = 'F') s from lineitem group by 1, 2), p as (select *, s / cast(n as double) p, 1.959963984540054 z from c),
 w as (select g, ln, n, s, p * 100 rate, greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) * 100 lo, least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) * 100 hi from p)
"""


def _rates(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("ln")).agg(F.count_if(F.col("l_linestatus") == "F").alias("successes"), F.count(F.lit(1)).alias("total"))


@query("a43_wilson_interval", _WIL + "select g, ln, s as successes, n as total, round(rate, 6) as rate, round(lo, 6) as low, round(hi, 6) as high from w")
def a43(t):
    return r(_rates(t).select("g", "ln", "successes", "total", *S.wilson(F.col("successes"), F.col("total"))))


@query("a43_rate_gap", _WIL + "select a.ln, round(a.rate - b.rate, 6) as gap, round(a.lo - b.hi, 6) as gap_low, round(a.hi - b.lo, 6) as gap_high from w a join w b on a.ln = b.ln and a.g = 'A' and b.g = 'R'")
def a43b(t):
    return r(S.rate_gap(_rates(t), ["ln"], "g", "A", "R"))


_DIM = [f"d{i}" for i in range(1, 9)]


def _dims(t):
    return t.embeddings.select("vec_id", *[F.round(domain(i), 6).alias(f"d{i}") for i in range(1, 9)])


@query("a44_scale_reliability", "with e as (select " + ", ".join(f"round({domain_sql(i)}, 6) d{i}" for i in range(1, 9)) + """ from embeddings)
select count(*) as n, 8 as items, round(8.0 / 7 * (1 - (var_samp(d1) + var_samp(d2) + var_samp(d3) + var_samp(d4) + var_samp(d5) + var_samp(d6) + var_samp(d7) + var_samp(d8)) / var_samp(d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8)), 6) as alpha from e
""")
def a44(t):
    return r(S.cronbach_alpha(_dims(t), _DIM))


@query("a44_item_total", "with e as (select " + ", ".join(f"round({domain_sql(i)}, 6) d{i}" for i in range(1, 9)) + " from embeddings), f as (select *, " + ", ".join(
    f"round(0.0::double + d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8 - d{i}, 9) r{i}" for i in range(1, 9)) + " from e), k as (select " + ", ".join(
    f"rank() over (order by {c}{i}) + (count(*) over (partition by {c}{i}) - 1) / 2.0 {c}k{i}" for i in range(1, 9) for c in "dr") + " from f) " + " union all ".join(
    f"select 'd{i}' as item, round(corr(dk{i}, rk{i}), 6) as rho from k" for i in range(1, 9)))
def a44b(t):
    return r(S.item_total(_dims(t), _DIM))


@query("a45_spearman_matrix", """
with k as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 q, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 d,
   rank() over (order by l_tax) + (count(*) over (partition by l_tax) - 1) / 2.0 x from lineitem)
select count(*) as n, 'l_quantity' as a, 'l_discount' as b, round(corr(q, d), 6) as rho from k union all select count(*), 'l_quantity', 'l_tax', round(corr(q, x), 6) from k union all select count(*), 'l_discount', 'l_tax', round(corr(d, x), 6) from k
""")
def a45(t):
    return r(S.spearman_matrix(t.lineitem, ["l_quantity", "l_discount", "l_tax"]))


@query("a66_expectation_gate", """
with m as (select 'rows' metric, cast(count(*) as double) observed from orders union all select 'mean_price', avg(o_totalprice) from orders union all select 'closed_share', avg(cast(o_orderstatus = 'F' as integer)) from orders),
 e as (select * from (values ('rows', 15000.0::double, 0.5::double), ('mean_price', 250000.0::double, 5000.0::double), ('closed_share', 0.9::double, 0.1::double), ('absent', 1.0::double, 0.0::double)) v(metric, expected, tolerance))
select e.metric, expected, round(observed, 4) as observed, tolerance, coalesce(abs(observed - expected) <= tolerance, false) as passed from e left join m using (metric)
""")
def a66(t):
    g = t.orders.agg(F.count(F.lit(1)).cast("double").alias("a"), F.avg("o_totalprice").alias("b"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("c"))
    m = g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("observed")) for n, c in (("rows", "a"), ("mean_price", "b"), ("closed_share", "c"))])))
    want = [("rows", 15000.0, 0.5), ("mean_price", 250000.0, 5000.0), ("closed_share", 0.9, 0.1), ("absent", 1.0, 0.0)]
    e = t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(x).alias("expected"), F.lit(y).alias("tolerance")) for n, x, y in want])))
    return r(S.expectation_gate(m, e), 4)


_TIP = """
with c as (select s_nationkey nation, count(*) filter (l_returnflag = 'A' and l_linestatus = 'F') sa, count(*) filter (l_returnflag = 'A') ta, count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') sb, count(*) filter (l_returnflag = 'R') tb,
   count(*) filter (l_returnflag = 'N') ex from lineitem join supplier on l_suppkey = s_suppkey group by 1)
"""


def _tip(t):
    f, s = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count_if((f == "A") & s).alias("success_a"), F.count_if(f == "A").alias("total_a"), F.count_if((f == "R") & s).alias("success_b"), F.count_if(f == "R").alias("total_b"), F.count_if(f == "N").alias("excluded"))


@query("a67_tipping_point", _TIP + """
, x as (select *, unnest(generate_series(0, ex)) added_a from c)
select nation, added_a, ex - added_a as added_b, round(sa * 100.0 / (ta + added_a) - sb * 100.0 / (tb + ex - added_a), 6) as gap, sa * 100.0 / (ta + added_a) - sb * 100.0 / (tb + ex - added_a) <= 0 as reversed from x
""")
def a67(t):
    return r(S.tipping_point(_tip(t), ["nation"]))


@query("a67_detectable_difference", _TIP + """
, p as (select *, (sa + sb) / cast(ta + tb as double) p from c) select nation, round((1.959963984540054 + 0.8416212335729143) * sqrt(p * (1 - p) * (1.0 / ta + 1.0 / tb)) * 100, 6) as min_difference from p
""")
def a67b(t):
    return r(S.detectable_difference(_tip(t), ["nation"]))
