"""Queries and oracles: scores, labels, texts, planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from munim.operators import forecast as FC, insights as I, planner as P
from munim.plans.aggregate_queries import total
from munim.plans.fixtures import stored, txn
from munim.plans.forecast_queries import WITH as FORECAST
from munim.plans.registry import query

FACTS_SQL = FORECAST + f"""
, ia AS (SELECT *, transaction_type = 'debit' AND pick % 97 = 0 AS is_anomaly FROM txn),
s0 AS (SELECT statement_id, coalesce({total('credit')}, 0) AS cr, coalesce({total('debit')}, 0) AS db,
       count(*) AS n, count(*) FILTER (is_anomaly) AS na,
       coalesce({total('CASE WHEN is_anomaly THEN amount END')}, 0) AS fa,
       min(date) AS d0, max(date) AS d1, count(DISTINCT date_trunc('month', date)) AS mo FROM ia GROUP BY 1),
c0 AS (SELECT statement_id, category, {total('debit')} AS s FROM deb GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY s DESC, category) AS r FROM c0),
c2 AS (SELECT statement_id, max(category) FILTER (r = 1) AS c_1, max(s) FILTER (r = 1) AS s_1,
       max(category) FILTER (r = 2) AS c_2, max(s) FILTER (r = 2) AS s_2, count(*) AS nc FROM c1 GROUP BY 1),
f0 AS (SELECT statement_id, {total('vs_last_month_pct_change')} / count(*) AS ch,
       {total('next_month_forecast')} AS ft FROM fs GROUP BY 1),
fa AS (SELECT s0.*, c_1, s_1, c_2, s_2, coalesce(nc, 0) AS nc, ch, ft,
       CASE WHEN cr <> 0 THEN (cr - db) / cr * 100 ELSE 0.0 END AS sr,
       least(100.0, coalesce(s_1 * 100 / nullif(db, 0), 100.0)) AS top_pct
       FROM s0 LEFT JOIN c2 USING (statement_id) LEFT JOIN f0 USING (statement_id)),
h0 AS (SELECT *, CASE WHEN cr > 0 THEN least(25.0, greatest(0.0, sr * 1.25)) ELSE 10.0 END AS sp,
       greatest(0.0, least(25.0, nc * 2.5) * (1 - greatest(0.0, (top_pct - 40) / 100))) AS dp,
       greatest(0.0, 25.0 - na::DOUBLE / greatest(n, 1) * 100 * 8.0) AS ap,
       CASE WHEN ch IS NULL THEN 12.0 WHEN ch <= 0 THEN 25.0 WHEN ch <= 10 THEN 18.0 WHEN ch <= 20 THEN 10.0
            ELSE 4.0 END AS tp FROM fa),
hs AS (SELECT *, CAST(round_even(sp, 0) AS INT) AS savings_pts, CAST(round_even(dp, 0) AS INT) AS diversity_pts,
       CAST(round_even(ap, 0) AS INT) AS anomaly_pts, CAST(round_even(tp, 0) AS INT) AS trend_pts,
       CAST(least(100, greatest(0, round_even(sp + dp + ap + tp, 0))) AS INT) AS health_score FROM h0)
"""


def F1(x: str) -> str:
    return f"format('{{:.1f}}', round_even({x} * 10.0, 0) / 10.0)"


def F0(x: str) -> str:
    return f"format('{{}}', CAST(round_even({x}, 0) AS BIGINT))"


def lakh(x: str) -> str:
    """Indian-grouped whole rupees of a non-negative amount below 10^9."""
    s = f"CAST(CAST(trunc(abs({x})) AS BIGINT) AS VARCHAR)"
    return (f"'₹' || (CASE WHEN length({s}) <= 3 THEN {s} WHEN length({s}) <= 5 THEN "
            f"left({s}, length({s}) - 3) || ',' || right({s}, 3) WHEN length({s}) <= 7 THEN "
            f"left({s}, length({s}) - 5) || ',' || substring({s}, length({s}) - 4, 2) || ',' || right({s}, 3) "
            f"ELSE left({s}, length({s}) - 7) || ',' || substring({s}, length({s}) - 6, 2) || ',' || "
            f"substring({s}, length({s}) - 4, 2) || ',' || right({s}, 3) END)")


def marked(spark, d):
    flag = (F.col("transaction_type") == "debit") & (F.col("pick") % 97 == 0)
    return txn(spark, d).withColumns({
        "is_anomaly": flag, "anomaly_score": F.when(flag, 0.7).otherwise(0.3)})


def facts(spark, d):
    df = stored(marked(spark, d).drop("subcategory", "pick"))
    return df, I.facts(df, FC.forecast_summary(FC.forecast(df)))


@query("health_score", FACTS_SQL + """
SELECT statement_id, savings_pts, diversity_pts, anomaly_pts, trend_pts, health_score,
  CAST((sr < 20 AND savings_pts < 25)::INT + (top_pct > 50)::INT + (na > 0)::INT
    + coalesce((ch > 10)::INT, 0) AS INT) AS n_tips FROM hs""")
def health_score(spark, d):
    out = I.health_score(facts(spark, d)[1])
    return out.select("statement_id", "savings_pts", "diversity_pts", "anomaly_pts", "trend_pts",
                      "health_score", F.size("tips").alias("n_tips"))


@query("health_status", FACTS_SQL + """
SELECT statement_id, CASE WHEN sr < 0 AND health_score < 80 THEN 'Structurally At Risk'
  WHEN sr < 0 THEN 'Strong Portfolio, Critical Cash Gap' WHEN health_score >= 85 THEN 'Financially Resilient'
  WHEN health_score >= 65 THEN 'On Track' ELSE 'Needs Attention' END AS status,
  CASE WHEN health_score >= 71 THEN 'Healthy' WHEN health_score >= 41 THEN 'Moderate' ELSE 'At Risk' END AS band,
  CASE WHEN savings_pts >= 17.5 THEN 'good' WHEN savings_pts >= 10 THEN 'fair' ELSE 'poor' END AS savings_band
FROM hs""")
def health_status(spark, d):
    out = I.health_score(facts(spark, d)[1])
    score = F.col("health_score")
    return out.select(
        "statement_id", I.health_status(F.col("savings_rate"), score).alias("status"),
        I.report_band(score).alias("band"), I.component_band(F.col("savings_pts")).alias("savings_band"))


@query("risk_level", FACTS_SQL + f"""
, sh AS (SELECT *, na::DOUBLE / greatest(n, 1) * 100 AS sh FROM fa)
SELECT statement_id, CASE WHEN sh = 0 AND (cr = 0 OR sr >= 20) THEN 'Low'
  WHEN sh <= 2 AND (cr = 0 OR sr >= 0) THEN 'Medium' ELSE 'High' END AS risk_level,
  CASE WHEN cr > 0 THEN {F1('sr')} || '%' ELSE 'N/A' END AS savings_text,
  coalesce({lakh('ft')}, 'N/A') AS forecast_text FROM sh""")
def risk_level(spark, d):
    return I.risk_level(facts(spark, d)[1])


@query("key_insights", FACTS_SQL + f"""
, k AS (SELECT statement_id, 1 AS o, CASE WHEN cr <= 0 THEN 'primary' WHEN sr >= 20 THEN 'success'
    WHEN sr >= 0 THEN 'warning' ELSE 'danger' END AS variant,
    CASE WHEN cr <= 0 THEN 'Total outflows ' || {lakh('db')} || ' across ' || format('{{:,}}', n) || ' transactions'
    WHEN sr >= 20 THEN 'Savings rate ' || {F1('sr')} || '% — surplus ' || {lakh('cr - db')}
    WHEN sr >= 0 THEN 'Savings rate ' || {F1('sr')} || '% — financial planners recommend 20% or more'
    ELSE 'Deficit of ' || {lakh('cr - db')} || ' — spending exceeds income' END AS message FROM fa
  UNION ALL SELECT statement_id, 2, CASE WHEN top_pct <= 40 THEN 'primary' ELSE 'warning' END,
    c_1 || ' is top spend — ' || {lakh('s_1')} || ' (' || {F1('top_pct')} || '%)' FROM fa WHERE c_1 IS NOT NULL
  UNION ALL SELECT statement_id, 3, CASE WHEN na > 0 THEN 'danger' ELSE 'success' END,
    CASE WHEN na > 0 THEN na || ' unusual transaction' || CASE WHEN na <> 1 THEN 's' ELSE '' END || ' — '
      || {lakh('fa')} || ' flagged' ELSE 'No anomalous activity detected' END FROM fa
  UNION ALL SELECT statement_id, 4, CASE WHEN ch > 5 THEN 'warning' ELSE 'success' END,
    CASE WHEN ch > 5 THEN 'Spend forecast rising ' || {F1('ch')} || '% next month — tighten budget'
    ELSE 'Spend forecast falling ' || {F1('abs(ch)')} || '% — positive trend' END
    FROM fa WHERE ch > 5 OR ch < -5)
SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY o) AS INT) AS rank,
  variant, message FROM k""")
def key_insights(spark, d):
    return I.key_insights(facts(spark, d)[1]).drop("icon")


@query("story", FACTS_SQL + f"""
, m AS (SELECT *, CAST(round_even(greatest(1, date_diff('day', d0, d1)) / 30.4::DOUBLE, 0) AS INT) AS months FROM fa)
SELECT statement_id, CASE WHEN cr > 0 THEN 'Over ' || months || ' month' || CASE WHEN months <> 1 THEN 's' ELSE '' END
    || ', you earned ' || {lakh('cr')} || ' and spent ' || {lakh('db')}
    || CASE WHEN cr >= db THEN ', saving ' ELSE ', overspending by ' END || {lakh('cr - db')} || ' ('
    || {F0('abs(sr)')} || CASE WHEN cr >= db THEN '% savings rate' ELSE '% deficit' END || ') across '
    || format('{{:,}}', n) || ' transactions.'
  ELSE 'Over ' || months || ' month' || CASE WHEN months <> 1 THEN 's' ELSE '' END || ', ' || format('{{:,}}', n)
    || ' transactions totalling ' || {lakh('db')} || ' in outflows were recorded.' END || ' '
  || CASE WHEN c_1 IS NULL THEN '' ELSE CASE WHEN c_2 IS NOT NULL THEN c_1 || ' (' || {lakh('s_1')} || ') and ' || c_2 || ' (' || {lakh('s_2')}
    || ') together represent ' || {F0('(s_1 + s_2) / db * 100')} || '% of total outflows.'
  ELSE c_1 || ' was the single largest category at ' || {lakh('s_1')} || '.' END || ' ' END
  || CASE WHEN na > 0 THEN na || ' transaction' || CASE WHEN na <> 1 THEN 's were' ELSE ' was' END
    || ' flagged as unusual — review the Anomalies tab for details.'
  WHEN ft IS NULL THEN 'Spending patterns are consistent with no major irregularities detected.'
  ELSE 'Next month''s projected spend is ' || {lakh('ft')} || ' — plan accordingly.' END AS story FROM m""")
def story(spark, d):
    return I.story(facts(spark, d)[1]).select(
        "statement_id", F.array_join("sentences", " ").alias("story"))


@query("spending_personality", FORECAST + f"""
, nd AS (SELECT *, CASE category WHEN 'SMALL' THEN 'Food' WHEN 'LARGE' THEN 'Shopping' WHEN 'PROMO'
         THEN 'Transportation' WHEN 'MEDIUM' THEN 'Entertainment' ELSE category END AS cat FROM deb),
c AS (SELECT statement_id, cat, {total('debit')} AS s FROM nd GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY s DESC, cat) AS r,
       sum(s) OVER (PARTITION BY statement_id) AS al FROM c),
mm AS (SELECT statement_id, cat, description, {total('debit')} AS s FROM nd GROUP BY ALL),
mx AS (SELECT statement_id, cat, max(s) AS mx FROM mm GROUP BY ALL),
w AS (SELECT statement_id, isodow(date) - 1 AS dow, {total('debit')} AS s FROM nd GROUP BY ALL),
wk AS (SELECT statement_id, coalesce(sum(s) FILTER (dow >= 5), 0) * 100 / sum(s) AS we FROM w GROUP BY 1),
pk AS (SELECT statement_id, dow FROM (SELECT *, row_number() OVER (PARTITION BY statement_id
       ORDER BY s DESC, dow) AS r FROM w) WHERE r = 1)
SELECT statement_id, cr.cat AS top_category, CAST(dow AS INT) AS peak_dow, mx / s > 0.55 AS single_dominates,
  CASE WHEN cr.cat = 'Food' AND we > 60 THEN 'Weekend Diner'
  WHEN cr.cat = 'Shopping' AND mx / s > 0.55 THEN 'Brand Loyalist'
  WHEN cr.cat = 'Entertainment' THEN 'Experience Spender' WHEN cr.cat = 'Transportation' THEN 'Frequent Traveler'
  WHEN s * 100 / al < 30 THEN 'Diversified Spender' ELSE 'Focused Spender' END AS label
FROM cr JOIN wk USING (statement_id) JOIN pk USING (statement_id) JOIN mx USING (statement_id, cat) WHERE r = 1""")
def spending_personality(spark, d):
    names = {"SMALL": "Food", "LARGE": "Shopping", "PROMO": "Transportation", "MEDIUM": "Entertainment"}
    df = txn(spark, d).replace(names, subset=["category"])
    return I.spending_personality(df).select(
        "statement_id", "top_category", "peak_dow", "single_dominates", "label")


def paise_text(x: str) -> str:
    r = f"(round_even(abs({x}) * 100.0, 0) / 100.0)"
    return f"({lakh(r)} || '.' || right(format('{{:.2f}}', {r}), 2))"


@query("rule_advice", FACTS_SQL + f"""
, sv AS (SELECT *, cr - db AS lf, coalesce(s_1 * 100 / nullif(db, 0), 0) AS sh FROM fa)
SELECT statement_id, concat_ws(chr(10),
  CASE WHEN cr > 0 AND sr >= 20 THEN 'You''re saving ' || {F0('sr')}
    || '% of your income — that''s genuinely good. Here''s what the numbers say:'
  WHEN cr > 0 AND sr >= 0 THEN 'Saving ' || {F0('sr')} || '% of income. Room to grow — let''s see where the leaks are:'
  WHEN cr > 0 THEN 'Spending is outpacing income by ' || {paise_text('lf')}
    || '. Worth addressing now before it compounds:'
  ELSE 'Here''s the read on ' || n || ' transactions:' END, '',
  CASE WHEN cr > 0 THEN '- Income ' || {paise_text('cr')} || ' vs spend ' || {paise_text('db')} || ' — net '
    || CASE WHEN lf >= 0 THEN 'surplus' ELSE 'deficit' END || ' of ' || {paise_text('lf')} || '.' END,
  CASE WHEN sh > 40 THEN '- ' || c_1 || ' is eating ' || {paise_text('s_1')} || ' (' || {F0('sh')}
    || '% of spend) — that''s a concentrated outflow worth reviewing.'
  ELSE '- Biggest category is ' || c_1 || ' at ' || {paise_text('s_1')} || ' (' || {F0('sh')}
    || '%) — spending looks reasonably spread out.' END,
  CASE WHEN na > 0 THEN '- ' || na || ' transaction' || CASE WHEN na <> 1 THEN 's' ELSE '' END
    || ' flagged as unusual — worth a quick check to rule out errors or one-offs.' END,
  '- Next month''s spend is forecast at ' || {paise_text('ft')}
    || ' — set that aside now so it doesn''t catch you off guard.', '',
  CASE WHEN cr <= 0 THEN '**Next step:** Link your income data for a complete picture — it''ll make these insights a lot sharper.'
  WHEN sr < 20 AND c_1 IS NOT NULL THEN '**Next step:** Trim ' || c_1
    || ' spending by 15–20% to push your savings rate past the 20% mark.'
  WHEN sr >= 20 THEN '**Next step:** Park the surplus in a SIP or RD — idle savings in a current account lose value to inflation.'
  ELSE '**Next step:** Identify one discretionary category you can cut this month to stop the shortfall.' END)
  AS advice FROM sv""")
def rule_advice(spark, d):
    return I.rule_advice(facts(spark, d)[1])


@query("context_block", FACTS_SQL + f"""
, am AS (SELECT statement_id, {total('debit')} / count(DISTINCT date_trunc('month', date)) AS av FROM deb GROUP BY 1),
cb AS (SELECT statement_id, string_agg('  ' || category || ': ' || {paise_text('s')}, chr(10) ORDER BY s DESC, category)
       AS t FROM c0 GROUP BY 1),
a5 AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY date, line_no) AS r FROM ia WHERE is_anomaly),
ab AS (SELECT statement_id, string_agg('  - ' || description || ': ' || {paise_text('amount')} || ' [' || category
       || '] score=0.70', chr(10) ORDER BY r) AS t FROM a5 WHERE r <= 5 GROUP BY 1)
SELECT statement_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'FINANCIAL SUMMARY',
  '  total_debits: ' || {paise_text('db')}, '  total_credits: ' || {paise_text('cr')},
  '  net_cashflow: ' || CASE WHEN cr < db THEN '-' ELSE '' END || {paise_text('(cr - db)')},
  '  transaction_count: ' || {paise_text('n')}, '  date_range: ' || d0 || ' to ' || d1,
  '  avg_monthly_spend: ' || {paise_text('coalesce(av, 0)')}),
  'CATEGORY BREAKDOWN' || chr(10) || cb.t,
  'ANOMALOUS TRANSACTIONS (' || na || ' total, top 5 shown)' || chr(10) || ab.t,
  'FORECAST' || chr(10) || '  total_forecast: ' || {paise_text('ft')}) AS context
FROM fa LEFT JOIN am USING (statement_id) LEFT JOIN cb USING (statement_id) LEFT JOIN ab USING (statement_id)""")
def context_block(spark, d):
    df, row = facts(spark, d)
    return I.context_block(df, row)


SCENARIOS = [("ECONOMY", 25.0), ("SMALL", 50.0), ("PROMO", 100.0)]
SCENARIO_SQL = ", ".join(f"('{c}', {p}::DOUBLE)" for c, p in SCENARIOS)
PLAN_SQL = FACTS_SQL + f"""
, mc AS (SELECT statement_id, category, s / mo AS ms FROM c0 JOIN s0 USING (statement_id)),
sn AS (SELECT * FROM (VALUES {SCENARIO_SQL}) v(category, cut_pct))"""


def scenarios(spark):
    return spark.createDataFrame(SCENARIOS, "category STRING, cut_pct DOUBLE")


@query("whatif_cut", PLAN_SQL + """
SELECT statement_id, category, cut_pct, ms AS monthly_spend, ms * cut_pct / 100 AS saved_monthly,
  ms * cut_pct / 100 * 12 AS saved_yearly, 100000.0 / (ms * cut_pct / 100) AS months_to_lakh
FROM mc JOIN sn USING (category)""")
def whatif_cut(spark, d):
    return P.whatif_cut(txn(spark, d), scenarios(spark))


@query("union_scenarios", PLAN_SQL + """
, cu AS (SELECT statement_id, category AS cut_category, cut_pct FROM mc JOIN sn USING (category)),
nw AS (SELECT * FROM mc JOIN cu USING (statement_id))
SELECT statement_id, cut_category, cut_pct, category, ms AS monthly_spend, 'Current' AS scenario FROM nw
UNION ALL SELECT statement_id, cut_category, cut_pct, category,
  ms * CASE WHEN category = cut_category THEN 1 - cut_pct / 100 ELSE 1.0 END, 'After Cut' FROM nw""")
def union_scenarios(spark, d):
    return P.before_after(txn(spark, d), scenarios(spark))


@query("goal_tracker", PLAN_SQL + """
, bg AS (SELECT statement_id, max(ms) AS bg, arg_min(category, (-ms, category)) AS bc FROM mc GROUP BY 1),
sv AS (SELECT statement_id, greatest(0, (cr - db) / mo) AS ms FROM s0),
gl AS (SELECT * FROM (VALUES ('New Laptop', 50000.0::DOUBLE), ('Car', 800000.0::DOUBLE)) v(goal, goal_amount))
SELECT statement_id, goal, goal_amount, ms AS monthly_savings, goal_amount / ms AS months_needed,
  goal_amount / (ms * 2) AS months_at_double, least(100, coalesce(ms * 100 / bg, 100)) AS cut_needed_pct,
  bc AS biggest_category, least(100, ms * 100 / goal_amount) AS progress_pct,
  greatest(0, goal_amount - ms) AS remaining
FROM sv LEFT JOIN bg USING (statement_id), gl WHERE ms > 0""")
def goal_tracker(spark, d):
    return P.goal_tracker(txn(spark, d), [("New Laptop", 50000.0), ("Car", 800000.0)])


@query("report_figures", FACTS_SQL + """
SELECT statement_id, health_score, CASE WHEN health_score >= 71 THEN 'Healthy' WHEN health_score >= 41 THEN 'Moderate'
  ELSE 'At Risk' END AS band, CASE WHEN cr - db >= 0 THEN '+' ELSE '-' END AS sign FROM hs""")
def report_figures(spark, d):
    figures = I.report_tables(*facts(spark, d))["figures"]
    return figures.select("statement_id", "health_score", "band", F.left("net_cashflow", F.lit(1)).alias("sign"))


@query("report_anomalies", FACTS_SQL + """
SELECT statement_id, line_no, r AS rank FROM (SELECT statement_id, line_no, CAST(row_number() OVER (
  PARTITION BY statement_id ORDER BY line_no) AS INT) AS r FROM ia WHERE is_anomaly) WHERE r <= 5""")
def report_anomalies(spark, d):
    return I.report_tables(*facts(spark, d))["anomalies"].select("statement_id", "line_no", "rank")
