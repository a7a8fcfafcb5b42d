"""Target schemas and the output contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

PIPELINE = T.StructType(
    [
        T.StructField("statement_id", T.LongType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("debit", T.DoubleType(), False),
        T.StructField("credit", T.DoubleType(), False),
        T.StructField("balance", T.DoubleType(), True),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("transaction_type", T.StringType(), False),
        T.StructField("month_year", T.StringType(), False),
    ]
)

CLASSIFICATION_FIELDS = ["category", "subcategory", "confidence", "match_confidence", "match_notes"]

#: Columns every parsed-document table must have, and those that may not be null.
CONTRACT_REQUIRED = ["date", "description", "amount", "transaction_type", "bank_source"]
CONTRACT_NOT_NULL = ["date", "amount", "transaction_type"]


class ContractError(ValueError):
    """A table does not satisfy the output contract."""


def assert_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise ``ContractError`` when a required column is absent (driver-side, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def contract_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the number of contract violations of each kind.

    One aggregate pass; counts are combined map-side, so a hot key costs nothing extra.
    """
    assert_columns(df, CONTRACT_REQUIRED)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in CONTRACT_NOT_NULL]
    bad_type = ~F.col("transaction_type").isin("debit", "credit")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *nulls, F.count_if(bad_type).alias("bad_type")
    )
    broken = sum((F.col(f"null_{c}") for c in CONTRACT_NOT_NULL), F.col("bad_type"))
    return out.withColumn("is_valid", broken == 0)
