"""Row filters.  All are narrow and push down where Spark can."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from munim.functions import text as T


def debits(df: DataFrame) -> DataFrame:
    return df.where(F.col("transaction_type") == "debit")


def credits(df: DataFrame) -> DataFrame:
    return df.where(F.col("transaction_type") == "credit")


def with_date(df: DataFrame) -> DataFrame:
    """Drop rows whose date could not be read."""
    return df.na.drop(subset=["date"])


def rejected_dates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows kept and dropped by :func:`with_date`, per key."""
    return df.groupBy(*keys).agg(
        F.count("date").alias("kept"), F.count_if(F.col("date").isNull()).alias("rejected")
    )


def with_amount(df: DataFrame) -> DataFrame:
    """Drop rows without a positive amount."""
    return df.where(F.col("amount") > 0)


def without_noise(df: DataFrame, column: str = "line") -> DataFrame:
    """Drop page chrome, totals and other rows that are not transactions."""
    return df.where(~T.is_noise_row(F.col(column)))


def without_self_transfers(df: DataFrame, column: str = "description") -> DataFrame:
    return df.where(~T.is_self_transfer(F.col(column)))


def search(
    df: DataFrame, text: str = "", kind: str = "All", category: str = "All"
) -> DataFrame:
    """Transaction browser: literal text in description or category, direction, category."""
    out = df
    needle = text.strip().lower()
    if needle:
        has = lambda c: F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        out = out.where(has("description") | has("category"))
    if kind == "Debits":
        out = debits(out)
    elif kind == "Credits":
        out = credits(out)
    elif kind == "Anomalies":
        out = out.where(F.col("is_anomaly"))
    if category != "All":
        out = out.where(F.col("category") == category)
    return out
