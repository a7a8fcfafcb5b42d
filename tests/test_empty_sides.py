"""Statements without debits, without credits, with zero or missing amounts must not fail."""

import datetime as dt

from pyspark.sql import functions as F

from munim.operators import aggregates as AG, anomaly as AN, forecast as FC, insights as I
from munim.operators import planner as P, recurring as R


def test_one_sided_statements(spark):
    day = dt.date(2025, 1, 5)
    rows = [
        (1, 1, day, "Pay", "Income", 0.0, 100.0, "credit"),
        (2, 1, day, "Shop", "Food", 50.0, 0.0, "debit"),
        (3, 1, day, "Zero", "Food", 0.0, 0.0, "debit"),
        (3, 2, day, "Zero", "Food", 0.0, 0.0, "debit"),
        (4, 1, day, "Null", "Food", None, None, "debit"),
    ]
    df = spark.createDataFrame(
        rows, "statement_id BIGINT, line_no BIGINT, date DATE, description STRING, category STRING, "
        "debit DOUBLE, credit DOUBLE, transaction_type STRING"
    ).withColumns({"amount": F.col("debit") - F.col("credit"), "is_anomaly": F.lit(False),
                   "anomaly_score": F.lit(0.1)})
    facts = I.facts(df, FC.forecast_summary(FC.forecast(df)))
    tables = [
        AG.summary_stats(df), AG.category_breakdown(df), AG.mom_by_category(df), AG.weekday_profile(df),
        AG.merchant_dominance(df), AG.category_monthly_avg(df), R.recurring_merchants(df),
        AN.features(df, AN.fit_stats(df)), I.health_score(facts), I.story(facts), I.rule_advice(facts),
        I.key_insights(facts), I.risk_level(facts), I.context_block(df, facts),
        I.spending_personality(df), P.goal_tracker(df, [("Goal", 10.0)]),
    ]
    for table in tables:
        table.collect()
    stats = {r.statement_id: r for r in AG.summary_stats(df).collect()}
    assert stats[1].avg_monthly_spend == 0.0 and stats[2].total_credits == 0.0
    health = {r.statement_id: r for r in I.health_score(facts).collect()}
    assert health[2].savings_pts == 10 and health[1].savings_pts == 25
    advice = {r.statement_id: r.advice for r in I.rule_advice(facts).collect()}
    assert "null" not in advice[1] and "forecast" not in advice[1]
    stories = {r.statement_id: r.sentences for r in I.story(facts).collect()}
    assert len(stories[1]) == 2 and not any("null" in s for s in stories[1])
