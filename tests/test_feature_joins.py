"""Anomaly features: what is joined per debit, and how often debits are shuffled for it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from munim.operators import anomaly as A

SCHEMA = ("statement_id long, line_no long, date date, description string, category string, "
          "transaction_type string, amount double")


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda n: dt.date(2024, 1, n)
    data = [(1, 1, day(1), "a", "x", "debit", 10.0), (1, 2, day(1), "a", "x", "debit", 30.0),
            (1, 3, day(9), "b", None, "debit", 50.0), (1, 4, None, "b", "x", "debit", 70.0),
            (1, 5, None, None, "y", "debit", 5.0), (2, 1, day(3), "a", "x", "debit", 8.0),
            (2, 1, day(3), "a", "x", "debit", 8.0), (2, 2, day(4), "a", "x", "credit", 9.0),
            (None, 1, day(5), "a", "x", "debit", 6.0)]
    return spark.createDataFrame(data, SCHEMA)


def values(df):
    return sorted(map(str, df.select(*A.FEATURES, "statement_id", "line_no", "category_mean", "category_std").collect()))


def test_features_are_those_of_the_single_operators(rows):
    stats = A.fit_stats(rows)
    debits = rows.where("transaction_type = 'debit'")
    one = A.with_days_since_last(A.with_zscore(
        A.with_merchant_frequency(debits, stats.merchant_counts), stats.category_stats))
    weekday = F.weekday("date")
    one = one.withColumns({
        "amount_log": F.log1p(F.abs("amount")), "day_of_month": F.dayofmonth("date"), "day_of_week": weekday,
        "hour_of_day": F.lit(12), "is_weekend": (weekday >= 5).cast("int")})
    found = A.features(rows, stats)
    assert values(found) == values(one)
    assert found.count() == 7  # null dates stay, the null statement has no figures


def test_debits_are_shuffled_once_for_statement_and_day(spark, rows):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.features(rows, A.fit_stats(rows))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # Debits by merchant, by category and by day; no fourth time by statement.
    assert plan.count("SortMergeJoin") == 4
    assert plan.count("Exchange hashpartitioning") == 9


def test_only_what_is_read_again_is_stored(spark):
    """The stored feature rows hold keys and features, the stored view debits without unused columns."""
    from munim.plans import anomaly_queries as Q

    seen = []
    real = Q.stored
    Q.stored = lambda df: seen.append(df.columns) or real(df)
    try:
        Q.standardize(spark, "/root/testdata/sf0.001")
    finally:
        Q.stored = real
    assert seen[0] == ["statement_id", "date", "description", "category", "transaction_type", "amount", "line_no"]
    assert seen[1] == ["statement_id", "line_no", *A.FEATURES]


def test_facts_store_no_unused_columns(spark):
    from munim.plans import insight_queries as Q

    df, _ = Q.facts(spark, "/root/testdata/sf0.001")
    assert not {"subcategory", "pick"} & set(df.columns)
