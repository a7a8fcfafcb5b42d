"""Queries and oracles: filters, aggregates, month comparisons, top-k."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from munim.functions import money
from munim.operators import aggregates as A, filters
from munim.plans.fixtures import TXN_SQL, txn, txn_base
from munim.plans.registry import query
from munim.operators.paging import read_page, write_sorted
from munim.operators.rollup import add_batch, month_rollup, read_rollup, rupees
from munim.session import ensure_checkpoint_dir

WITH = "WITH " + TXN_SQL


def total(expr: str) -> str:
    """Exact SQL sum of money."""
    return f"(sum(CAST(round(({expr}) * 10000) AS BIGINT))::DOUBLE / 10000.0)"


def by_brand(df):
    """Brands as categories, for operators that need more than a handful."""
    return df.withColumn("category", F.col("subcategory"))


@query("filter_debit", WITH + "SELECT statement_id, line_no, amount FROM deb")
def filter_debit(spark, d):
    return filters.debits(txn(spark, d)).select("statement_id", "line_no", "amount")


@query("txn_search", WITH + """
SELECT statement_id, line_no, description, category FROM txn
WHERE (contains(lower(description), 'ring') OR contains(lower(category), 'ring'))
  AND transaction_type = 'debit' AND category = 'ECONOMY'""")
def txn_search(spark, d):
    hits = filters.search(txn(spark, d), " RING ", "Debits", "ECONOMY")
    return hits.select("statement_id", "line_no", "description", "category")


@query("topk_semijoin", WITH + f"""
, ct AS (SELECT statement_id, subcategory, {total('debit')} AS s FROM deb GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement_id
        ORDER BY s DESC, subcategory) AS r FROM ct) WHERE r <= 3)
SELECT deb.statement_id, line_no, deb.subcategory AS category, debit FROM deb
SEMI JOIN top ON deb.statement_id = top.statement_id AND deb.subcategory = top.subcategory""")
def topk_semijoin(spark, d):
    hits = A.in_top_categories(by_brand(txn(spark, d)), 3)
    return hits.select("statement_id", "line_no", "category", "debit")


@query("summary_stats", WITH + f"""
, m AS (SELECT statement_id, date_trunc('month', date) AS mo, {total('debit')} AS s
        FROM deb GROUP BY ALL),
a AS (SELECT statement_id, count(*) AS n, avg(1.0) AS one FROM m GROUP BY 1)
SELECT statement_id,
  coalesce({total("CASE WHEN transaction_type = 'debit' THEN debit END")}, 0) AS total_debits,
  coalesce({total("CASE WHEN transaction_type = 'credit' THEN credit END")}, 0) AS total_credits,
  coalesce({total("CASE WHEN transaction_type = 'credit' THEN credit END")}, 0)
   - coalesce({total("CASE WHEN transaction_type = 'debit' THEN debit END")}, 0) AS net_cashflow,
  count(*) AS transaction_count, min(date) AS first_date, max(date) AS last_date,
  coalesce({total("CASE WHEN transaction_type = 'debit' THEN debit END")}
    / any_value(a.n), 0) AS avg_monthly_spend
FROM txn LEFT JOIN a USING (statement_id) GROUP BY statement_id""")
def summary_stats(spark, d):
    stats = A.summary_stats(txn_base(spark, d))
    return stats.select(
        "statement_id", "total_debits", "total_credits", "net_cashflow", "transaction_count",
        F.col("date_range.min").alias("first_date"), F.col("date_range.max").alias("last_date"),
        "avg_monthly_spend",
    )


@query("category_breakdown", WITH + f"""
, ct AS (SELECT statement_id, category, {total('debit')} AS total_spent, count(*) AS txn_count
         FROM deb GROUP BY ALL)
SELECT statement_id, category, total_spent,
  round_even(total_spent / sum(total_spent) OVER (PARTITION BY statement_id) * 100 * 10.0, 0) / 10.0
    AS pct,
  txn_count, round_even(total_spent / txn_count * 100.0, 0) / 100.0 AS avg_txn FROM ct""")
def category_breakdown(spark, d):
    return A.category_breakdown(txn_base(spark, d))


@query("category_month_matrix", WITH + f"""
SELECT statement_id, category, CAST(date_trunc('month', date) AS DATE) AS month,
  {total('debit')} AS spent FROM deb GROUP BY ALL""")
def category_month_matrix(spark, d):
    return A.category_month_matrix(txn_base(spark, d))


@query("monthly_resample", WITH + f"""
, m AS (SELECT statement_id, CAST(date_trunc('month', date) AS DATE) AS ds, {total('debit')} AS y
        FROM deb GROUP BY ALL),
span AS (SELECT statement_id, min(ds) AS lo, max(ds) AS hi FROM m GROUP BY 1),
grid AS (SELECT statement_id,
  CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ds FROM span)
SELECT statement_id, ds, coalesce(y, 0) AS y FROM grid LEFT JOIN m USING (statement_id, ds)""")
def monthly_resample(spark, d):
    return A.monthly_series(txn_base(spark, d))


@query("category_monthly_avg", WITH + f"""
, n AS (SELECT statement_id, count(DISTINCT date_trunc('month', date)) AS n FROM deb GROUP BY 1)
SELECT statement_id, category, {total('debit')} / any_value(n) AS monthly_avg,
  greatest(CAST(round_even({total('debit')} / any_value(n), 0) AS BIGINT), 1) AS suggested_budget
FROM deb JOIN n USING (statement_id) GROUP BY statement_id, category""")
def category_monthly_avg(spark, d):
    return A.category_monthly_avg(txn_base(spark, d))


@query("category_distribution", WITH + """
SELECT category, subcategory, count(*) AS n FROM txn GROUP BY ALL""")
def category_distribution(spark, d):
    return A.category_distribution(txn_base(spark, d))


@query("category_stats", WITH + f"""
SELECT statement_id, category, {total('amount')} / count(*) AS mean,
  round(coalesce(nullif(stddev_samp(amount), 0), 1), 4) AS std FROM deb GROUP BY ALL""")
def category_stats(spark, d):
    return A.category_stats(txn_base(spark, d)).withColumn("std", F.round("std", 4))


@query("weekday_profile", WITH + f"""
, w AS (SELECT statement_id, isodow(date) - 1 AS dow, {total('debit')} AS s FROM deb GROUP BY ALL),
t AS (SELECT statement_id, sum(s) AS al, coalesce(sum(s) FILTER (dow >= 5), 0) AS we
      FROM w GROUP BY 1),
p AS (SELECT statement_id, dow FROM (SELECT *, row_number() OVER (PARTITION BY statement_id
      ORDER BY s DESC, dow) AS r FROM w) WHERE r = 1)
SELECT statement_id, round(coalesce(we * 100 / nullif(al, 0), 0), 6) AS weekend_pct,
  CAST(dow AS INT) AS peak_dow FROM t JOIN p USING (statement_id)""")
def weekday_profile(spark, d):
    return A.weekday_profile(txn_base(spark, d)).withColumn(
        "weekend_pct", F.round("weekend_pct", 6))


@query("merchant_dominance", WITH + f"""
, m AS (SELECT statement_id, category, description, {total('debit')} AS s FROM deb GROUP BY ALL),
c AS (SELECT statement_id, category, {total('s')} AS t, max(s) AS mx FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY t DESC, category) AS r FROM c)
SELECT statement_id, category AS top_category, mx / t AS merchant_share,
  mx / t > 0.55 AS single_dominates FROM r WHERE r = 1""")
def merchant_dominance(spark, d):
    return A.merchant_dominance(txn_base(spark, d))


MONTHS_SQL = f"""
, cm AS (SELECT statement_id, category, date_trunc('month', date) AS mo, {total('debit')} AS s
         FROM deb GROUP BY ALL),
ag AS (SELECT *, dense_rank() OVER (PARTITION BY statement_id ORDER BY mo DESC) AS age FROM cm)"""


@query("mom_by_category", WITH + MONTHS_SQL + f"""
, ok AS (SELECT statement_id FROM ag GROUP BY 1 HAVING max(age) >= 2),
w AS (SELECT statement_id, category, coalesce(sum(s) FILTER (age = 2), 0) AS prev_spent,
      coalesce(sum(s) FILTER (age = 1), 0) AS curr_spent FROM ag WHERE age <= 2 GROUP BY ALL)
SELECT statement_id, category, prev_spent, curr_spent,
  CASE WHEN prev_spent > 0 THEN (curr_spent - prev_spent) / prev_spent * 100
       WHEN curr_spent > 0 THEN 100.0 ELSE 0.0 END AS pct_change
FROM w SEMI JOIN ok USING (statement_id) WHERE prev_spent <> 0 OR curr_spent <> 0""")
def mom_by_category(spark, d):
    return A.mom_by_category(txn_base(spark, d))


@query("biggest_riser", WITH + MONTHS_SQL + f"""
, ok AS (SELECT statement_id FROM ag GROUP BY 1 HAVING max(age) >= 2),
w AS (SELECT statement_id, category, coalesce(sum(s) FILTER (age = 2), 0) AS p,
      coalesce(sum(s) FILTER (age = 1), 0) AS c FROM ag WHERE age <= 2 GROUP BY ALL),
g AS (SELECT statement_id, category, CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 100.0 END AS pct
      FROM w SEMI JOIN ok USING (statement_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY pct DESC, category DESC) AS k
      FROM g)
SELECT statement_id, category, pct AS pct_change FROM r WHERE k = 1 AND pct > 10""")
def biggest_riser(spark, d):
    return A.biggest_riser(A.mom_by_category(txn_base(spark, d)))


@query("mom_total", WITH + f"""
, m AS (SELECT statement_id, transaction_type AS direction, date_trunc('month', date) AS mo,
        {total('debit + credit')} AS s FROM txn GROUP BY ALL),
ag AS (SELECT *, dense_rank() OVER (PARTITION BY statement_id, direction ORDER BY mo DESC) AS age
       FROM m)
SELECT statement_id, direction, sum(s) FILTER (age = 2) AS prev_total,
  sum(s) FILTER (age = 1) AS curr_total,
  CASE WHEN sum(s) FILTER (age = 2) <> 0 THEN (sum(s) FILTER (age = 1) - sum(s) FILTER (age = 2))
    / sum(s) FILTER (age = 2) * 100 END AS pct_change
FROM ag WHERE age <= 2 GROUP BY ALL""")
def mom_total(spark, d):
    return A.mom_totals(month_rollup(txn_base(spark, d)))


@query("mom_lag", WITH + MONTHS_SQL + """
SELECT statement_id, category, CAST(mo AS DATE) AS month, s AS spent,
  lag(s) OVER (PARTITION BY statement_id, category ORDER BY mo) AS prev_spent FROM cm""")
def mom_lag(spark, d):
    return A.mom_lag(txn_base(spark, d))


@query("budget_vs_actual", WITH + MONTHS_SQL + f"""
, l AS (SELECT statement_id, date_trunc('month', max(date)) AS last_mo FROM txn GROUP BY 1),
now AS (SELECT statement_id, category, coalesce(sum(s) FILTER (mo = last_mo), 0) AS spent
        FROM cm JOIN l USING (statement_id) GROUP BY ALL),
n AS (SELECT statement_id, count(DISTINCT mo) AS n FROM cm GROUP BY 1),
b AS (SELECT statement_id, category,
      greatest(CAST(round_even({total('s')} / any_value(n), 0) AS BIGINT), 1) AS budget
      FROM cm JOIN n USING (statement_id) GROUP BY statement_id, category)
SELECT statement_id, category, budget, spent, spent / budget AS used,
  CASE WHEN spent / budget < 0.7 THEN 'success' WHEN spent / budget <= 1 THEN 'warning'
       ELSE 'danger' END AS band
FROM b JOIN now USING (statement_id, category)""")
def budget_vs_actual(spark, d):
    rollup = month_rollup(txn_base(spark, d))
    budgets = A.category_monthly_avg_of(rollup).select(
        "statement_id", "category", F.col("suggested_budget").alias("budget"))
    return A.budgets_of(rollup, budgets)


@query("rollup_batches", WITH + f"""
SELECT statement_id, category, transaction_type, CAST(date_trunc('month', date) AS DATE) AS month,
  count(*) AS n_rows, {total('debit')} AS debit, {total('credit')} AS credit
FROM txn GROUP BY ALL""")
def rollup_batches(spark, d):
    """Three batches, one of them written twice, read back as one roll-up."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}"
    df = txn_base(spark, d)
    for batch in (0, 1, 2, 1):
        add_batch(df.where(F.col("statement_id") % 3 == batch), path, str(batch))
    return read_rollup(spark, path).select(
        "statement_id", "category", "transaction_type", "month", "n_rows",
        rupees(F.col("debit")).alias("debit"), rupees(F.col("credit")).alias("credit"))


@query("control_totals", WITH + f"""
SELECT statement_id, count(*) FILTER (transaction_type = 'debit') AS debit_count,
  count(*) FILTER (transaction_type = 'credit') AS credit_count,
  coalesce({total("CASE WHEN transaction_type = 'debit' THEN abs(amount) END")}, 0) AS debit_total,
  coalesce({total("CASE WHEN transaction_type = 'credit' THEN abs(amount) END")}, 0) AS credit_total
FROM txn GROUP BY 1""")
def control_totals(spark, d):
    return A.control_totals(txn_base(spark, d))


@query("quality_counts", WITH + """
, q AS (SELECT statement_id, date, description, nullif(transaction_type, 'credit') AS kind FROM txn)
SELECT statement_id, count(*) AS row_count,
  count(*) - count(DISTINCT (date, description)) AS duplicate_rows,
  count(*) FILTER (date IS NULL) AS null_date, count(*) FILTER (kind IS NULL) AS null_kind
FROM q GROUP BY 1""")
def quality_counts(spark, d):
    df = txn_base(spark, d).withColumn("kind", F.nullif("transaction_type", F.lit("credit")))
    return A.quality_counts(df, ["date", "kind"], ["date", "description"])


@query("category_list", WITH + """
SELECT statement_id, array_to_string(list_prepend('All', list_sort(list(DISTINCT subcategory))), '|')
  AS categories FROM txn GROUP BY 1""")
def category_list(spark, d):
    return A.category_list(by_brand(txn_base(spark, d))).withColumn(
        "categories", F.array_join("categories", "|"))


@query("top_categories", WITH + f"""
, ct AS (SELECT statement_id, subcategory AS category, {total('debit')} AS total_spent
         FROM deb GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id
  ORDER BY total_spent DESC, category) AS INT) AS rank FROM ct) WHERE rank <= 3""")
def top_categories(spark, d):
    return A.top_categories(by_brand(txn_base(spark, d)), 3)


@query("topn_others", WITH + f"""
, ct AS (SELECT statement_id, subcategory AS category, {total('debit')} AS s FROM deb GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY s DESC, category) AS k FROM ct)
SELECT statement_id, CASE WHEN k <= 8 THEN category ELSE 'Others' END AS category,
  {total('s')} AS total_spent FROM r GROUP BY ALL""")
def topn_others(spark, d):
    return A.top_n_others(by_brand(txn_base(spark, d)), 8)


@query("sort_date", WITH + "SELECT statement_id, line_no, date, amount FROM txn ORDER BY date, line_no")
def sort_date(spark, d):
    return txn(spark, d).select("statement_id", "line_no", "date", "amount").orderBy(
        "date", "statement_id", "line_no")


@query("browse_limit", WITH + """
SELECT statement_id, line_no, date, amount FROM txn ORDER BY date, statement_id, line_no LIMIT 500""")
def browse_limit(spark, d):
    return txn(spark, d).select("statement_id", "line_no", "date", "amount").orderBy(
        "date", "statement_id", "line_no").limit(500)


@query("browse_page", WITH + """
, n AS (SELECT statement_id, line_no, date, amount,
        row_number() OVER (ORDER BY date, statement_id, line_no) AS row_no FROM txn)
SELECT *, (row_no - 1) // 700 + 1 AS page FROM n WHERE (row_no - 1) // 700 + 1 IN (1, 4, (SELECT
  (count(*) - 1) // 700 + 1 FROM n))""")
def browse_page(spark, d):
    """The first, the fourth and the last page of all transactions by date."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/pages-{uuid.uuid4().hex}"
    order = ["date", "statement_id", "line_no"]
    write_sorted(txn(spark, d).select(*order, "amount"), order, path)
    last = (spark.read.parquet(f"{path}/index").agg(F.sum("_rows")).first()[0] - 1) // 700 + 1
    out = None
    for page in sorted({1, 4, last}):
        rows = read_page(spark, path, order, page, 700).withColumn("page", F.lit(page).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("savings_rate", WITH + f"""
, s AS (SELECT statement_id, coalesce({total('credit')}, 0) AS cr, coalesce({total('debit')}, 0) AS db
        FROM txn GROUP BY 1)
SELECT statement_id, CASE WHEN cr <> 0 THEN (cr - db) / cr * 100 ELSE 0 END AS savings_rate,
  CASE WHEN cr > 0 THEN db / cr ELSE 0 END AS spend_per_rupee FROM s""")
def savings_rate(spark, d):
    stats = A.summary_stats(txn_base(spark, d))
    cr, db = F.col("total_credits"), F.col("total_debits")
    return stats.select(
        "statement_id", money.savings_rate(cr, db).alias("savings_rate"),
        money.ratio(db, cr, 0.0).alias("spend_per_rupee"),
    )
