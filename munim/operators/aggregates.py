"""Per-statement aggregates.

Every grouping key starts with ``statement_id``.  Sums, counts, minima and maxima
are combined map-side, so a statement that holds a large share of all rows sends
one partial row per map task into the shuffle.  Windows only ever run over such
aggregates (months or categories of a statement), never over raw transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from munim.functions import money
from munim.functions.dates import month_start
from munim.operators.rollup import KEY, month_rollup, rupees


def only(df: DataFrame, direction: str) -> DataFrame:
    """Debits or credits only."""
    return df.where(F.col("transaction_type") == direction)


def monthly_totals(df: DataFrame, direction: str = "debit") -> DataFrame:
    """(statement, month) sums of one direction."""
    return only(df, direction).groupBy(KEY, month_start(F.col("date")).alias("month")).agg(
        money.total(F.col(direction)).alias("total")
    )


def summary_stats(df: DataFrame) -> DataFrame:
    """Totals, net, count, date range and mean monthly spend of each statement.

    One shuffle of (statement, month) partial sums; the statement level is
    aggregated from those few rows.
    """
    is_debit = F.col("transaction_type") == "debit"
    monthly = df.groupBy(KEY, month_start(F.col("date")).alias("_month")).agg(
        F.sum(money.paise(F.when(is_debit, F.col("debit")))).alias("_debit"),
        F.sum(money.paise(F.when(~is_debit, F.col("credit")))).alias("_credit"),
        F.count(F.lit(1)).alias("_n"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    debits = F.coalesce(F.sum("_debit"), F.lit(0)) / F.lit(100.0)
    credits = F.coalesce(F.sum("_credit"), F.lit(0)) / F.lit(100.0)
    return monthly.groupBy(KEY).agg(
        debits.alias("total_debits"),
        credits.alias("total_credits"),
        (credits - debits).alias("net_cashflow"),
        F.sum("_n").alias("transaction_count"),
        F.struct(F.min("_first").alias("min"), F.max("_last").alias("max")).alias("date_range"),
        money.ratio(debits, F.count("_debit"), 0.0).alias("avg_monthly_spend"),
        F.count("_month").alias("n_months"),
    )


def category_totals(df: DataFrame) -> DataFrame:
    """(statement, category) spend and count; the shared input of most reports."""
    return only(df, "debit").groupBy(KEY, "category").agg(
        money.total(F.col("debit")).alias("total_spent"), F.count(F.lit(1)).alias("txn_count")
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    """Spend per category with its share of the statement and the mean charge."""
    whole = F.sum("total_spent").over(W.partitionBy(KEY))
    return category_totals(df).select(
        KEY, "category", "total_spent",
        money.round_even(money.ratio(F.col("total_spent"), whole) * 100, 1).alias("pct"),
        "txn_count",
        money.round_even(F.col("total_spent") / F.col("txn_count"), 2).alias("avg_txn"),
    )


def category_month_matrix(df: DataFrame) -> DataFrame:
    """(statement, category, month) spend."""
    month = month_start(F.col("date")).alias("month")
    return only(df, "debit").groupBy(KEY, "category", month).agg(
        money.total(F.col("debit")).alias("spent")
    )


def category_month_wide(df: DataFrame, categories: list[str]) -> DataFrame:
    """(statement, month) rows with one spend column per listed category."""
    month = month_start(F.col("date")).alias("month")
    return only(df, "debit").groupBy(KEY, month).agg(
        *[money.total_or_zero(F.when(F.col("category") == c, F.col("debit"))).alias(c)
          for c in categories]
    )


def monthly_series(df: DataFrame, value: str = "debit", keys: list[str] | None = None) -> DataFrame:
    """Monthly spend per key without gaps: months without a charge get 0."""
    keys = keys or [KEY]
    month = month_start(F.col("date")).alias("ds")
    sums = only(df, "debit").groupBy(*keys, month).agg(money.total(F.abs(value)).alias("y"))
    return fill_months(sums, keys)


def fill_months(sums: DataFrame, keys: list[str], values: tuple[str, ...] = ("y",)) -> DataFrame:
    """Insert a row of zeros for each month missing between a key's first and last ``ds``.

    Each row emits the empty months up to its successor, so no join is needed and
    the work per row is bounded by the gap.
    """
    nxt = F.lead("ds").over(W.partitionBy(*keys).orderBy("ds"))
    gap = F.when(
        F.col("_next") > F.add_months("ds", 1),
        F.sequence(F.add_months("ds", 1), F.add_months("_next", -1), F.expr("interval 1 month")),
    )
    zeros = [F.lit(0).cast(sums.schema[v].dataType).alias(v) for v in values]
    months = F.concat(
        F.array(F.struct("ds", *values)),
        F.coalesce(F.transform(gap, lambda d: F.struct(d.alias("ds"), *zeros)), F.expr("array()")),
    )
    return sums.withColumn("_next", nxt).select(*keys, F.inline(months).alias("ds", *values))


def month_count(df: DataFrame) -> DataFrame:
    """Distinct months of each statement, at least 1."""
    months = df.select(KEY, month_start(F.col("date")).alias("_m")).distinct()
    return months.groupBy(KEY).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_months"))


def category_monthly_avg(df: DataFrame) -> DataFrame:
    """Mean monthly spend per category and the whole-rupee budget suggested from it."""
    return category_monthly_avg_of(month_rollup(df))


def category_monthly_avg_of(rollup: DataFrame) -> DataFrame:
    """``category_monthly_avg`` from a roll-up: categories and months of a statement meet in one window."""
    w = W.partitionBy(KEY)
    months = F.size(F.collect_set(F.struct("month")).over(w))  # null is a month of its own
    cells = only(rollup, "debit").withColumn("n_months", months)
    spent = cells.groupBy(KEY, "category").agg(
        rupees(F.sum("debit")).alias("_total"), F.max("n_months").alias("n_months"))
    avg = F.col("_total") / F.col("n_months")
    return spent.select(
        KEY, "category", avg.alias("monthly_avg"),
        F.greatest(money.round_even(avg), F.lit(1.0)).cast("bigint").alias("suggested_budget"),
    )


def category_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


def category_stats(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of debit amounts per category; deviation 1 when undefined or 0."""
    sd = F.stddev_samp("amount")
    return only(df, "debit").groupBy(KEY, "category").agg(
        money.ratio(money.total(F.col("amount")), F.count("amount")).alias("mean"),
        F.coalesce(F.when(sd != 0, sd), F.lit(1.0)).alias("std"),
    )


def weekday_profile(df: DataFrame) -> DataFrame:
    """Share of spend on weekends and the weekday with most spend (0 = Monday)."""
    daily = only(df, "debit").groupBy(KEY, F.weekday("date").alias("dow")).agg(
        money.total(F.col("debit")).alias("spent")
    )
    weekend = F.coalesce(F.sum(F.when(F.col("dow") >= 5, F.col("spent"))), F.lit(0.0))
    return daily.groupBy(KEY).agg(
        money.ratio(weekend * 100, F.sum("spent"), 0.0).alias("weekend_pct"),
        F.max_by("dow", F.struct("spent", -F.col("dow"))).cast("int").alias("peak_dow"),
    )


def top_category(totals: DataFrame) -> DataFrame:
    """The largest category of each statement (ties: first by name) and its share."""
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("total_spent"), "category"))
    whole = F.sum("total_spent").over(W.partitionBy(KEY))
    count = F.count(F.lit(1)).over(W.partitionBy(KEY))
    return (
        totals.select(
            KEY, "category", "total_spent", rank.alias("_rank"), whole.alias("all_spent"),
            count.alias("n_categories"),
        )
        .where(F.col("_rank") == 1)
        .select(
            KEY, F.col("category").alias("top_category"), F.col("total_spent").alias("top_spent"),
            "all_spent", "n_categories",
            money.ratio(F.col("total_spent") * 100, F.col("all_spent")).alias("top_pct"),
        )
    )


def merchant_dominance(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Share of the biggest merchant within the top category."""
    merchants = only(df, "debit").groupBy(KEY, "category", "description").agg(
        money.total(F.col("debit")).alias("_spent")
    )
    per_category = merchants.groupBy(KEY, "category").agg(
        money.total(F.col("_spent")).alias("total_spent"), F.max("_spent").alias("_max")
    )
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("total_spent"), "category"))
    share = money.ratio(F.col("_max"), F.col("total_spent"))
    return (
        per_category.withColumn("_rank", rank).where(F.col("_rank") == 1)
        .select(
            KEY, F.col("category").alias("top_category"), share.alias("merchant_share"),
            (share > threshold).alias("single_dominates"),
        )
    )


def two_latest_months(per_month: DataFrame) -> DataFrame:
    """Keep the two most recent months that occur in each statement (``_age`` 1 = latest)."""
    age = F.dense_rank().over(W.partitionBy(KEY).orderBy(F.desc("month")))
    return per_month.withColumn("_age", age).where(F.col("_age") <= 2)


def mom_by_category(df: DataFrame) -> DataFrame:
    """Latest against previous month per category; new spend counts as +100 %."""
    recent = two_latest_months(category_month_matrix(df))
    at = lambda age: F.coalesce(F.sum(F.when(F.col("_age") == age, F.col("spent"))), F.lit(0.0))
    wide = recent.groupBy(KEY, "category").agg(
        at(2).alias("prev_spent"), at(1).alias("curr_spent"), F.max("_age").alias("_seen")
    )
    statements = recent.groupBy(KEY).agg(F.max("_age").alias("_months"))
    change = (
        F.when(F.col("prev_spent") > 0,
               (F.col("curr_spent") - F.col("prev_spent")) / F.col("prev_spent") * 100)
        .when(F.col("curr_spent") > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    return (
        wide.join(statements.where(F.col("_months") == 2), KEY, "left_semi")
        .where((F.col("prev_spent") != 0) | (F.col("curr_spent") != 0))
        .select(KEY, "category", "prev_spent", "curr_spent", change.alias("pct_change"))
    )


def biggest_riser(mom: DataFrame, threshold: float = 10.0) -> DataFrame:
    """The category that rose most, where it rose by more than ``threshold`` percent."""
    best = mom.groupBy(KEY).agg(
        F.max(F.struct("pct_change", "category")).alias("_b")
    )
    return best.where(F.col("_b.pct_change") > threshold).select(
        KEY, F.col("_b.category").alias("category"), F.col("_b.pct_change").alias("pct_change")
    )


def mom_total(df: DataFrame, direction: str) -> DataFrame:
    """Latest against previous month total of one direction; null without a previous month."""
    return mom_totals(month_rollup(df)).where(F.col("direction") == direction).drop("direction")


def mom_totals(rollup: DataFrame) -> DataFrame:
    """``mom_total`` of both directions from a roll-up."""
    direction = F.col("transaction_type").alias("direction")
    value = F.when(F.col("transaction_type") == "debit", F.col("debit")).otherwise(F.col("credit"))
    per_month = rollup.where(F.col("transaction_type").isin("debit", "credit")).groupBy(
        KEY, direction, "month").agg(rupees(F.sum(value)).alias("total"))
    age = F.dense_rank().over(W.partitionBy(KEY, "direction").orderBy(F.desc("month")))
    at = lambda k: F.sum(F.when(F.col("_age") == k, F.col("total")))
    wide = per_month.withColumn("_age", age).where(F.col("_age") <= 2).groupBy(KEY, "direction").agg(
        at(2).alias("prev_total"), at(1).alias("curr_total"))
    change = (F.col("curr_total") - F.col("prev_total")) / F.col("prev_total") * 100
    return wide.withColumn("pct_change", F.when(F.col("prev_total") != 0, change))


def mom_lag(df: DataFrame) -> DataFrame:
    """Each month's spend per category beside that of the category's preceding month."""
    w = W.partitionBy(KEY, "category").orderBy("month")
    return category_month_matrix(df).withColumn("prev_spent", F.lag("spent").over(w))


def budget_vs_actual(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spend of the statement's latest month against budgets (statement, category, budget)."""
    return budgets_of(month_rollup(df), budgets)


def budgets_of(rollup: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget_vs_actual`` from a roll-up.

    Budgets of categories the statement never used are skipped.
    """
    last = F.max("month").over(W.partitionBy(KEY))
    now = only(rollup.withColumn("_last", last), "debit").groupBy(KEY, "category").agg(rupees(
        F.coalesce(F.sum(F.when(F.col("month") == F.col("_last"), F.col("debit"))), F.lit(0))).alias("spent"))
    used = F.col("spent") / F.col("budget")
    return (
        budgets.where(F.col("budget") > 0)
        .join(now, [KEY, "category"])
        .select(
            KEY, "category", "budget", "spent", used.alias("used"),
            F.when(used < 0.70, "success").when(used <= 1.0, "warning").otherwise("danger")
            .alias("band"),
        )
    )


def control_totals(df: DataFrame) -> DataFrame:
    """Counts and sums per direction."""
    is_debit = F.col("transaction_type") == "debit"
    return df.groupBy(KEY).agg(
        F.count_if(is_debit).alias("debit_count"),
        F.count_if(~is_debit).alias("credit_count"),
        money.total_or_zero(F.when(is_debit, F.abs("amount"))).alias("debit_total"),
        money.total_or_zero(F.when(~is_debit, F.abs("amount"))).alias("credit_total"),
    )


def quality_counts(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Nulls per column and number of rows that repeat an earlier row on ``keys``."""
    grouped = df.groupBy(KEY, *[k for k in keys if k != KEY]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns]
    )
    return grouped.groupBy(KEY).agg(
        F.sum("_n").alias("row_count"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
        *[F.sum(f"_{c}").alias(f"null_{c}") for c in columns],
    )


def category_list(df: DataFrame) -> DataFrame:
    """Sorted distinct categories, with ``All`` first."""
    names = F.array_sort(F.collect_set("category"))
    return df.groupBy(KEY).agg(F.concat(F.array(F.lit("All")), names).alias("categories"))


def score_histogram(scored: DataFrame, low: float, high: float, bins: int = 40) -> DataFrame:
    """Number of debit scores in each of ``bins`` equal intervals; ``high`` joins the last one."""
    bucket = F.least(F.width_bucket("anomaly_score", F.lit(low), F.lit(high), F.lit(bins)),
                     F.lit(bins))
    return only(scored, "debit").groupBy(bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def top_categories(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest categories of each statement."""
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("total_spent"), "category"))
    return (
        category_totals(df).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
        .select(KEY, "category", "total_spent", "rank")
    )


def in_top_categories(df: DataFrame, k: int = 3) -> DataFrame:
    """Debits whose category is among the statement's ``k`` largest."""
    return only(df, "debit").join(top_categories(df, k), [KEY, "category"], "left_semi")


def top_n_others(df: DataFrame, n: int = 8, label: str = "Others") -> DataFrame:
    """The ``n`` largest categories; all further ones summed under ``label``."""
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("total_spent"), "category"))
    name = F.when(F.col("_rank") <= n, F.col("category")).otherwise(F.lit(label))
    return category_totals(df).withColumn("_rank", rank).groupBy(KEY, name.alias("category")).agg(
        money.total(F.col("total_spent")).alias("total_spent")
    )


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of each statement in ``order``.

    ``row_number() <= k`` lets Spark cut every map partition to k rows per
    statement before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(*order))
    return df.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
