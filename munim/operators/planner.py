"""What-if cuts and savings goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from munim.functions import money
from munim.operators import aggregates as AG

KEY = AG.KEY


def monthly_by_category(df: DataFrame) -> DataFrame:
    """(statement, category) spend per month of the statement."""
    months = AG.month_count(df)
    return AG.category_totals(df).join(months, KEY).select(
        KEY, "category", (F.col("total_spent") / F.col("n_months")).alias("monthly_spend")
    ).where(F.col("monthly_spend") > 0)


def whatif_cut(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Savings of cutting a category by a percentage.

    ``scenarios`` (category, cut_pct) meets the statements by category, so only
    categories a statement uses produce rows.
    """
    saved = F.col("monthly_spend") * F.col("cut_pct") / 100
    return monthly_by_category(df).join(scenarios, "category").select(
        KEY, "category", "cut_pct", "monthly_spend", saved.alias("saved_monthly"),
        (saved * 12).alias("saved_yearly"),
        F.when(saved > 0, F.lit(100000.0) / saved).alias("months_to_lakh"),
    )


def before_after(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """All categories of a statement before and after each applicable cut."""
    spend = monthly_by_category(df)
    cuts = spend.join(scenarios, "category").select(
        KEY, F.col("category").alias("cut_category"), "cut_pct")
    now = spend.join(cuts, KEY)
    keep = F.when(F.col("category") == F.col("cut_category"), 1 - F.col("cut_pct") / 100).otherwise(1.0)
    columns = [KEY, "cut_category", "cut_pct", "category"]
    current = now.select(*columns, "monthly_spend", F.lit("Current").alias("scenario"))
    after = now.select(
        *columns, (F.col("monthly_spend") * keep).alias("monthly_spend"),
        F.lit("After Cut").alias("scenario"))
    return current.unionByName(after)


def goal_tracker(df: DataFrame, goals: list[tuple[str, float]]) -> DataFrame:
    """Time to reach each goal at the statement's present savings.

    Statements that save nothing have no row.
    """
    spend = monthly_by_category(df).groupBy(KEY).agg(
        F.max("monthly_spend").alias("biggest"),
        F.min_by("category", F.struct(-F.col("monthly_spend"), "category")).alias("biggest_category"),
    )
    stats = AG.summary_stats(df).join(AG.month_count(df).withColumnRenamed("n_months", "_m"), KEY)
    saving = F.greatest(F.lit(0.0), (F.col("total_credits") - F.col("total_debits")) / F.col("_m"))
    listed = F.array(*[
        F.struct(F.lit(name).alias("goal"), F.lit(float(amount)).alias("goal_amount"))
        for name, amount in goals
    ])
    rows = stats.select(KEY, saving.alias("monthly_savings")).join(spend, KEY, "left").where(
        F.col("monthly_savings") > 0).select("*", F.inline(listed))
    save, goal = F.col("monthly_savings"), F.col("goal_amount")
    return rows.select(
        KEY, "goal", "goal_amount", "monthly_savings", (goal / save).alias("months_needed"),
        (goal / (save * 2)).alias("months_at_double"),
        F.least(F.lit(100.0), money.ratio(save * 100, F.col("biggest"), 100.0)).alias("cut_needed_pct"),
        "biggest_category", F.least(F.lit(100.0), save * 100 / goal).alias("progress_pct"),
        F.greatest(F.lit(0.0), goal - save).alias("remaining"),
    )
