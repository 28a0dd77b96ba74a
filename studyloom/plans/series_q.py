"""Queries over monthly series (inventory A29-A38, W07-W10, W12, U01, M17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import series as S
from .registry import query

K = ["priority"]


def r(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


def orders_by(t, key="o_orderpriority", name="priority"):
    return t.orders.select(F.col(key).alias(name), F.to_date("o_orderdate").alias("day"))


def series(t):
    return S.monthly(orders_by(t), "day", K)


_SER = """
with m as (select o_orderpriority priority, cast(date_trunc('month', o_orderdate) as date) as month, count(*) n from orders group by 1, 2),
 g as (select priority, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from m group by 1),
 s as (select g.priority, g.month, coalesce(n, 0) n, row_number() over (partition by g.priority order by g.month) - 1 t, count(*) over (partition by g.priority) len
       from g left join m on m.priority = g.priority and m.month = g.month)
"""


def _roster(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 97 == 0, "31-Feb-99").when(k % 101 == 0, " ").otherwise(F.date_format("o_orderdate", "dd-MMM-yy"))
    return t.orders.select(F.when(k % 89 == 0, "").when(k % 83 == 0, F.lit("7")).otherwise(k.cast("string")).alias("id"), raw.alias("raw"),
                           F.col("o_orderpriority").alias("label"), "o_orderkey").withColumn("d", D.short_year_date(F.col("raw")))


_ROS = """
with ros as (select o_orderkey, case when o_orderkey % 89 = 0 then '' when o_orderkey % 83 = 0 then '7' else cast(o_orderkey as varchar) end id,
   o_orderkey % 97 = 0 bad, o_orderkey % 97 <> 0 and o_orderkey % 101 = 0 blank, case when o_orderkey % 97 <> 0 and o_orderkey % 101 <> 0 then cast(o_orderdate as date) end d,
   o_orderpriority <> '3-MEDIUM' label_ok from orders)
"""


@query("a29_roster_audit", _ROS + """
select count(*) as rows, count(*) filter (id = '') as bad_ids, count(*) filter (bad) as bad_dates, count(*) filter (blank) as blank_dates,
  (select count(*) from (select id from ros where id <> '' group by 1 having count(*) > 1)) as repeated_ids, min(d) as first_date, max(d) as last_date,
  count(*) filter (d not between date '1996-01-01' and date '2000-12-31') as out_of_range from ros
""")
def a29(t):
    return S.roster_audit(_roster(t), "id", F.col("raw"), F.col("d"), "1996-01-01", "2000-12-31")


@query("a30_row_flags", _ROS + """
select o_orderkey, id, id = '' as bad_id, bad as bad_date, not label_ok as bad_label, id <> '' and count(*) over (partition by id) > 1 as duplicate_id,
  id = '' or bad or not label_ok or (id <> '' and count(*) over (partition by id) > 1) as needs_review from ros
""")
def a30(t):
    out = S.row_flags(_roster(t), "id", F.col("raw"), F.col("d"), F.col("label") != "3-MEDIUM")
    return out.select("o_orderkey", "id", "bad_id", "bad_date", "bad_label", "duplicate_id", "needs_review")


@query("a31_monthly_resample", _SER + "select priority, month, n from s")
def a31(t):
    return series(t)


@query("a31_month_year_totals", _SER + "select cast(year(month) as integer) as yr, month, cast(sum(n) as bigint) as n from s group by rollup (1, 2)")
def a31b(t):
    return S.month_year_totals(series(t))


@query("a32_series_diagnostics", _SER + """
, q as (select *, rank() over (partition by priority order by n) + (count(*) over (partition by priority, n) - 1) / 2.0 rk from s)
select priority, round(avg(n), 6) as mean, round(var_samp(n), 6) as variance, round(corr(t, rk), 6) as trend_rho, count(*) as months, round(var_samp(n) / avg(n), 6) as dispersion,
  round(1.96 / sqrt(count(*)), 6) as acf_band from q group by 1
""")
def a32(t):
    return r(S.diagnostics(series(t), K))


@query("a32_autocorrelation", _SER + """
, d as (select priority, t, len, n - avg(n) over (partition by priority) d from s), c0 as (select priority, sum(d * d) c0 from d group by 1),
 l as (select a.priority, b.t - a.t lag, sum(a.d * b.d) c, any_value(a.len) len from d a join d b on a.priority = b.priority and b.t - a.t between 1 and 13 group by 1, 2)
select l.priority, cast(lag as integer) as lag, round(c / c0, 6) as acf, abs(c / c0) > 1.96 / sqrt(len) as outside_band from l join c0 using (priority) where lag <= floor(len / 2)
""")
def a32b(t):
    return r(S.autocorrelation(series(t), K))


@query("a33_month_profile", _SER + """
, p as (select priority, month(month) month_no, avg(n) mean, count(*) as "years", stddev_samp(n) sd from s group by 1, 2)
select priority, cast(month_no as integer) as month_no, round(mean, 6) as mean, "years", round(sd, 6) as sd, row_number() over (partition by priority order by mean desc, month_no) = 1 as is_peak from p
""")
def a33(t):
    return r(S.month_profile(series(t), K))


@query("a34_intake_trend", """
select o_orderpriority as priority, round(regr_slope(o_orderkey, date_diff('day', date '1995-01-01', cast(o_orderdate as date))), 6) as slope,
  round(corr(date_diff('day', date '1995-01-01', cast(o_orderdate as date)), o_orderkey), 6) as r, count(*) as n,
  round(regr_slope(o_orderkey, date_diff('day', date '1995-01-01', cast(o_orderdate as date))) * 365.25 / 12, 6) as per_month from orders group by 1
""")
def a34(t):
    return r(S.intake_trend(t.orders.withColumnRenamed("o_orderpriority", "priority"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.col("o_orderkey"), K))


@query("a35_maturity_boundary", _SER + """
, q as (select priority, greatest(1, floor(quantile_cont(n, 0.25) filter (n > 0))) tau from s group by 1)
select s.priority, cast(tau as bigint) as tau, max(month) filter (n >= tau) as boundary, cast(sum(n) as bigint) as total from s join q using (priority) group by 1, 2
""")
def a35(t):
    return S.maturity_boundary(series(t), K)


@query("a35_mature_split", _SER + """
, q as (select priority, greatest(1, floor(quantile_cont(n, 0.25) filter (n > 0))) tau from s group by 1), b as (select priority, max(month) filter (n >= tau) b from s join q using (priority) group by 1)
select priority, month, n, month <= b as is_mature from s join b using (priority)
""")
def a35b(t):
    s = series(t)
    return S.split_mature(s, S.maturity_boundary(s, K), K)


_BT = _SER + """
, f as (select *, unnest(generate_series(greatest(24, len - 6 - 36 + 1), len - 6)) origin from s),
 tr as (select * from f where t < origin), te as (select * from f where t >= origin and t < origin + 6),
 ov as (select priority, origin, avg(n) o from tr group by 1, 2), mo as (select priority, origin, month(month) mm, avg(n) s from tr group by 1, 2, 3),
 nv as (select priority, origin, avg(d) train_naive from (select priority, origin, abs(n - lag(n) over (partition by priority, origin order by month)) d from tr) group by 1, 2),
 p as (select 'mean' model, te.priority, te.origin, te.month, te.n y, o yhat from te join ov using (priority, origin) union all
       select 'seasonal_mean', te.priority, te.origin, te.month, te.n, coalesce(s, o) from te join ov using (priority, origin) left join mo on mo.priority = te.priority and mo.origin = te.origin and mm = month(te.month)),
 e as (select model, p.priority, avg(abs(yhat - y)) mae, sqrt(avg((yhat - y) * (yhat - y))) rmse, avg(yhat - y) bias, avg(abs(yhat - y) / case when train_naive > 1e-9 then train_naive else 1 end) mase_fold, count(*) points
       from p join nv using (priority, origin) group by 1, 2),
 wn as (select priority, avg(d) w from (select priority, abs(n - lag(n) over (partition by priority order by month)) d from s) group by 1),
 mt as (select e.*, mae / w mase from e join wn using (priority))
"""


def _backtest(t):
    return S.backtest(series(t), K, ["mean", "seasonal_mean"], 36, 24, 6)


@query("w10_rolling_backtest", _BT + "select model, priority, cast(origin as integer) as origin, month, y, round(yhat, 6) as yhat from p")
def w10(t):
    return r(_backtest(t).drop("train_naive"))


@query("a36_forecast_errors", _BT + """
select model, priority, round(mae, 6) as mae, round(rmse, 6) as rmse, round(bias, 6) as bias, round(mase_fold, 6) as mase_fold, points, round(mase, 6) as mase,
  cast(row_number() over (partition by priority order by mae, mase, rmse, model) as integer) as place from mt
""")
def a36(t):
    return r(S.rank_models(S.error_metrics(_backtest(t), series(t), K), K))


_FUT = _SER + """
, fu as (select priority, cast(unnest(generate_series(max(month) + interval 1 month, max(month) + interval 36 month, interval 1 month)) as date) as month from s group by 1),
 ov as (select priority, avg(n) o from s group by 1), mo as (select priority, month(month) mm, avg(n) sv from s group by 1, 2),
 fc as (select fu.priority, fu.month, o, coalesce(sv, o) yhat from fu join ov using (priority) left join mo on mo.priority = fu.priority and mm = month(fu.month))
"""


@query("w09_seasonal_forecast", _FUT + "select priority, month, 'seasonal_mean' as model, round(yhat, 6) as yhat from fc union all select priority, month, 'mean', round(o, 6) from fc")
def w09(t):
    return r(S.forecast_all(series(t), K, 36, ["mean", "seasonal_mean"]))


def _plan(t):
    s = series(t)
    fc = S.forecast_all(s, K, 36, ["seasonal_mean"]).drop("model")
    # orders shipped long after the last order month stand for the firm bookings
    booked = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("priority"), F.trunc("l_shipdate", "month").alias("month"))
    booked = booked.groupBy("priority", "month").agg(F.count(F.lit(1)).alias("n"))
    return S.planning(S.guard_degenerate(fc, fc, s, K), booked, K)


_PLAN = _FUT + """
, bk as (select o_orderpriority priority, cast(date_trunc('month', l_shipdate) as date) as month, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
 pl as (select fc.priority, fc.month, yhat, coalesce(n, 0) booked, greatest(yhat, coalesce(n, 0)) planning, case when coalesce(n, 0) > yhat then 'booked' else 'model' end basis,
   row_number() over (partition by fc.priority order by fc.month) k from fc left join bk on bk.priority = fc.priority and bk.month = fc.month)
"""


@query("a37_planning_forecast", _PLAN + "select priority, month, round(yhat, 6) as yhat, false as guarded, booked, round(planning, 6) as planning, basis from pl")
def a37(t):
    return r(_plan(t))


@query("a37_window_totals", _PLAN + """
select priority, round(sum(planning) filter (k <= 1), 6) as next_1, round(sum(planning) filter (k <= 3), 6) as next_3, round(sum(planning) filter (k <= 6), 6) as next_6,
  round(sum(planning) filter (k <= 12), 6) as next_12, round(sum(planning), 6) as next_all, arg_max(month, (planning, -k)) as peak_month from pl group by 1
""")
def a37b(t):
    return r(S.window_totals(_plan(t), K))


@query("a37_annual_totals", _PLAN + "select priority, cast(year(month) as integer) as yr, round(sum(planning), 6) as planning from pl group by 1, 2")
def a37c(t):
    return r(S.annual_totals(_plan(t), K))


@query("a38_poisson_interval", _SER + """
, mr as (select priority, month(month) month_no, avg(n) rate from s group by 1, 2), k as (select unnest(range(0, 400)) k),
 c as (select priority, month_no, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by priority, month_no order by k) cdf from mr cross join k)
select priority, cast(month_no as integer) as month_no, round(any_value(rate), 6) as rate, min(k) filter (cdf >= 0.1) as low, min(k) filter (cdf >= 0.9) as high from c group by 1, 2
""")
def a38(t):
    m = series(t).groupBy("priority", F.month("month").alias("month_no")).agg(F.avg("n").alias("rate"))
    return m.select("priority", "month_no", F.round("rate", 6).alias("rate"), S.poisson_quantile(F.col("rate"), 0.1).alias("low"), S.poisson_quantile(F.col("rate"), 0.9).alias("high"))


@query("w07_duplicate_rows", "select doc_id, count(*) over (partition by text) > 1 as is_repeated from documents")
def w07(t):
    df = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return S.repeated(df, ["h"]).select("doc_id", "is_repeated")


@query("w08_monotonic_check", """
with m as (select o_orderpriority priority, cast(date_trunc('month', o_orderdate) as date) as month, count(*) n from orders group by 1, 2),
 c as (select priority, month, sum(n) over (partition by priority order by month) c, n from m)
select priority, (select bool_and(up) from (select c >= lag(c, 1, 0) over (order by month) up from c b where b.priority = a.priority)) as cumulative_ok,
  (select bool_and(up) from (select n >= lag(n, 1, 0) over (order by month) up from c b where b.priority = a.priority)) as plain_ok from (select distinct priority from m) a
""")
def w08(t):
    s = series(t)
    c = s.withColumn("c", F.sum("n").over(Window.partitionBy("priority").orderBy("month")))
    a = S.is_monotonic(c, K, "month", "c").withColumnRenamed("monotonic", "cumulative_ok")
    return a.join(S.is_monotonic(c, K, "month", "n").withColumnRenamed("monotonic", "plain_ok"), "priority")


@query("w12_cumulative_share", """
select c_nationkey as nation, o_orderkey, round(sum(o_totalprice) over w, 2) as running_total, round(sum(o_totalprice) over w / sum(o_totalprice) over (partition by c_nationkey), 6) as running_share
from orders join customer on c_custkey = o_custkey window w as (partition by c_nationkey order by o_orderdate, o_orderkey)
""")
def w12(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderdate", "o_orderkey", "o_totalprice")
    out = S.cumulative_share(df, ["nation"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")
    return out.select("nation", "o_orderkey", F.round("running_total", 2).alias("running_total"), F.round("running_share", 6).alias("running_share"))


@query("u01_forecast_registry")
def u01(t):
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"))
    return r(S.forecast_all(S.monthly(c, "day", ["nation"]), ["nation"], 6))


@query("m17_smoothed_forecast")
def m17(t):
    s = series(t)
    return r(S.smoothed_forecast(s, S.future_months(s, K, 12), K))


