"""Queries and oracles: monthly series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from munim.operators import forecast as FC
from munim.plans.aggregate_queries import total
from munim.plans.fixtures import TXN_SQL, stored, txn_base
from munim.plans.registry import query

R2 = "round_even(greatest({}, 0) * 100.0, 0) / 100.0"
TREND = """CASE WHEN {0} > 0.01 * {1} THEN 'increasing' WHEN {0} < -0.01 * {1} THEN 'decreasing'
  ELSE 'stable' END"""


def record(pred: str, low: str, high: str, trend: str, avg: str, method: str) -> str:
    return (f"{R2.format(pred)} AS predicted_amount, {R2.format(low)} AS lower_bound, "
            f"{R2.format(high)} AS upper_bound, {trend} AS trend, "
            f"round_even({avg} * 100.0, 0) / 100.0 AS historical_avg, '{method}' AS method")


WITH = "WITH " + TXN_SQL + f"""
, ms AS (SELECT statement_id, category, date_trunc('month', date) AS ds, {total('amount')} AS y
         FROM deb GROUP BY ALL),
sp AS (SELECT statement_id, category, min(ds) AS lo, max(ds) AS hi FROM ms GROUP BY ALL),
gr AS (SELECT statement_id, category, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ds FROM sp),
se AS (SELECT gr.statement_id, gr.category, CAST(gr.ds AS DATE) AS ds, coalesce(y, 0.0) AS y
       FROM gr LEFT JOIN ms ON gr.statement_id = ms.statement_id AND gr.category = ms.category AND gr.ds = ms.ds),
xy AS (SELECT statement_id, category, ds, CAST(round(y * 100) AS BIGINT)::HUGEINT AS y,
       ((year(ds) - 2000) * 12 + month(ds))::HUGEINT AS x FROM se),
li AS (SELECT statement_id, category, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS sy, sum(x)::DOUBLE AS sx,
       max(x)::DOUBLE AS lx, sum(x * x)::DOUBLE AS sxx, sum(x * y)::DOUBLE AS sxy, sum(y * y)::DOUBLE AS syy
       FROM xy GROUP BY ALL HAVING count(*) >= 3),
lq AS (SELECT *, sy / n / 100 AS av, n * sxx - sx * sx AS dxx, n * sxy - sx * sy AS dxy,
       n * syy - sy * sy AS dyy, n * (lx + 1) - sx AS ah FROM li),
lp AS (SELECT *, dxy / dxx / 100 AS sl, av + dxy * ah / (n * dxx) / 100 AS p,
       1.2816::DOUBLE * sqrt(greatest(dyy - dxy * dxy / dxx, 0) / n / 10000 / (n - 2))
       * sqrt(1 + 1 / n + ah * ah / (n * dxx)) AS h FROM lq),
tr AS (SELECT statement_id, category,
       {record('p', 'p - h', 'p + h', TREND.format('sl', 'av'), 'av', 'linear_trend')} FROM lp),
s1 AS (SELECT statement_id, category, {total('amount')} / count(*) AS av,
       date_diff('month', min(date), max(date)) + 1 AS n FROM deb GROUP BY ALL),
sm AS (SELECT statement_id, category, {record('av * 1.05', 'av * 1.05 * 0.85', 'av * 1.05 * 1.15',
       "'stable'", 'av', 'simple_average')} FROM s1 WHERE n < 3),
d1 AS (SELECT *, y - lag(y) OVER (PARTITION BY statement_id, category ORDER BY ds) AS dd FROM xy),
d2 AS (SELECT *, lag(dd) OVER (PARTITION BY statement_id, category ORDER BY ds) AS pp FROM d1),
a1 AS (SELECT statement_id, category, count(*) AS n, sum(y)::DOUBLE / count(*) / 100 AS av,
       arg_max(y, ds)::DOUBLE AS ly, arg_max(dd, ds)::DOUBLE AS lc, arg_max(dd, ds)::DOUBLE / 100 AS ld,
       coalesce(sum(dd * pp)::DOUBLE / nullif(sum(pp * pp)::DOUBLE, 0), 0) AS phi, sum(dd * pp)::DOUBLE AS dp,
       (sum(dd * dd) FILTER (pp IS NOT NULL))::DOUBLE AS d2, count(pp) AS k FROM d2
       GROUP BY ALL HAVING count(*) >= 3),
a2 AS (SELECT *, (ly + phi * lc) / 100 AS p, 1.96::DOUBLE * sqrt(greatest(d2 - phi * dp, 0) / k) / 100 AS h
       FROM a1),
hrb1 AS (SELECT *, lag(dd, 2) OVER (PARTITION BY statement_id, category ORDER BY ds) AS qq FROM d2),
hrb2 AS (SELECT statement_id, category, sum(pp * pp)::DOUBLE AS spp, sum(pp * qq)::DOUBLE AS spq,
       sum(qq * qq)::DOUBLE AS sqq, sum(dd * pp)::DOUBLE AS sdp, sum(dd * qq)::DOUBLE AS sdq
       FROM hrb1 WHERE qq IS NOT NULL GROUP BY ALL),
hrb3 AS (SELECT *, spp * sqq - spq * spq > 1e-9 * spp * sqq AS ok, spp * sqq - spq * spq AS det FROM hrb2),
hrb4 AS (SELECT *, CASE WHEN ok THEN (sdp * sqq - sdq * spq) / det ELSE coalesce(sdp / nullif(spp, 0), 0) END AS f1,
       CASE WHEN ok THEN (sdq * spp - sdp * spq) / det ELSE 0 END AS f2 FROM hrb3),
hrb5 AS (SELECT hrb1.*, floor(dd::DOUBLE - f1 * pp::DOUBLE - f2 * qq::DOUBLE + 0.5)::HUGEINT AS e
       FROM hrb1 LEFT JOIN hrb4 USING (statement_id, category)),
hrb6 AS (SELECT *, lag(e) OVER (PARTITION BY statement_id, category ORDER BY ds) AS f FROM hrb5),
hrb7 AS (SELECT statement_id, category, count(*) AS n, sum(y)::DOUBLE / count(*) / 100 AS av,
       arg_max(y, ds)::DOUBLE AS ly, arg_max(dd, ds)::DOUBLE AS ld, arg_max(e, ds)::DOUBLE AS le, count(f) AS k,
       sum(pp * pp) FILTER (f IS NOT NULL)::DOUBLE AS pp, sum(pp * f)::DOUBLE AS pf, sum(f * f)::DOUBLE AS ff,
       sum(dd * pp) FILTER (f IS NOT NULL)::DOUBLE AS dp, sum(dd * f)::DOUBLE AS df,
       sum(dd * dd) FILTER (f IS NOT NULL)::DOUBLE AS dd FROM hrb6 GROUP BY ALL HAVING count(*) >= 8),
hrb8 AS (SELECT *, pp * ff - pf * pf > 1e-9 * pp * ff AS ok, pp * ff - pf * pf AS det FROM hrb7),
hrb9 AS (SELECT *, greatest(-0.99, least(0.99, CASE WHEN ok THEN (dp * ff - df * pf) / det
       ELSE coalesce(dp / nullif(pp, 0), 0) END))::DOUBLE AS phi,
       greatest(-0.99, least(0.99, CASE WHEN ok THEN (df * pp - dp * pf) / det ELSE 0 END))::DOUBLE AS th FROM hrb8),
hrba AS (SELECT *, ld / 100 AS sl, (ly + phi * ld + th * le) / 100 AS p, 1.96::DOUBLE * sqrt(greatest(dd
       - 2 * phi * dp - 2 * th * df + phi * phi * pp + 2 * phi * th * pf + th * th * ff, 0) / k) / 100 AS h FROM hrb9),
hram AS (SELECT statement_id, category,
       {record('p', 'p - h', 'p + h', TREND.format('sl', 'av'), 'av', 'arma')} FROM hrba),
ar AS (SELECT statement_id, category,
       {record('p', 'p - h', 'p + h', TREND.format('ld', 'av'), 'av', 'ar1')} FROM a2),
fc AS (SELECT * FROM tr UNION ALL SELECT * FROM sm),
fs AS (SELECT statement_id, category, predicted_amount AS next_month_forecast, lower_bound, upper_bound,
       CASE WHEN historical_avg <> 0 THEN round_even((predicted_amount - historical_avg) / historical_avg
         * 100 * 100.0, 0) / 100.0 ELSE 0 END AS vs_last_month_pct_change, trend AS trend_direction FROM fc),
ft AS (SELECT statement_id, {total('predicted_amount')} AS total_forecast, {total('lower_bound')} AS total_lower,
       {total('upper_bound')} AS total_upper FROM fc GROUP BY 1)
"""


@query("forecast_simple", WITH + "SELECT * FROM sm")
def forecast_simple(spark, d):
    return FC.simple_forecast(txn_base(spark, d))


@query("forecast_trend", WITH + "SELECT * FROM tr")
def forecast_trend(spark, d):
    return FC.trend_forecast(FC.category_series(txn_base(spark, d)))


@query("forecast_ar1", WITH + "SELECT * FROM ar")
def forecast_ar1(spark, d):
    return FC.ar1_forecast(FC.category_series(txn_base(spark, d)))


@query("forecast_arma", WITH + """
SELECT * FROM hram UNION ALL SELECT ar.* FROM ar JOIN a1 USING (statement_id, category) WHERE n < 8
UNION ALL SELECT * FROM sm""")
def forecast_arma(spark, d):
    rows = txn_base(spark, d).select("statement_id", "date", "category", "transaction_type", "debit", "credit", "amount")
    return FC.forecast(stored(rows), method="arma")


@query("forecast_by_category", WITH + "SELECT * FROM fc")
def forecast_by_category(spark, d):
    return FC.forecast(txn_base(spark, d))


@query("trend_label", WITH + f"""
SELECT statement_id, category, {TREND.format('ld', 'av')} AS trend FROM a1""")
def trend_label(spark, d):
    return FC.ar1_forecast(FC.category_series(txn_base(spark, d))).select(
        "statement_id", "category", "trend")


@query("forecast_summary", WITH + "SELECT * FROM fs")
def forecast_summary(spark, d):
    return FC.forecast_summary(FC.forecast(txn_base(spark, d)))


@query("forecast_total", WITH + "SELECT * FROM ft")
def forecast_total(spark, d):
    return FC.forecast_total(FC.forecast(txn_base(spark, d)))


@query("forecast_cards", WITH + f"""
, mt AS (SELECT statement_id, ds, {total('y')} AS y FROM ms GROUP BY ALL),
la AS (SELECT statement_id, arg_max(y, ds) AS last_actual, max(ds) AS mo FROM mt GROUP BY 1)
SELECT ft.*, last_actual, coalesce((total_forecast - last_actual) * 100 / nullif(last_actual, 0), 0) AS vs_last_pct,
  CAST(greatest(60, least(98, trunc(100 - abs(total_forecast - last_actual) / greatest(last_actual, 1) * 50)))
    AS INT) AS confidence_pct, strftime(mo + INTERVAL 1 MONTH, '%b %Y') AS next_month
FROM ft JOIN la USING (statement_id)""")
def forecast_cards(spark, d):
    df = txn_base(spark, d)
    return FC.forecast_cards(df, FC.forecast_total(FC.forecast(df)))


@query("forecast_vs_actual", WITH + """
, la AS (SELECT statement_id, max(ds) AS ds FROM ms GROUP BY 1)
SELECT fs.statement_id, fs.category, next_month_forecast, coalesce(y, 0) AS last_actual
FROM fs JOIN la USING (statement_id) LEFT JOIN ms ON fs.statement_id = ms.statement_id
  AND fs.category = ms.category AND la.ds = ms.ds""")
def forecast_vs_actual(spark, d):
    df = txn_base(spark, d)
    out = FC.forecast_vs_actual(df, FC.forecast_summary(FC.forecast(df)))
    return out.select("statement_id", "category", "next_month_forecast", "last_actual")
