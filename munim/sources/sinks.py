"""Writing analysed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from munim.functions.dates import month_start
from munim.operators.classify import Merchant, classify


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_month(df: DataFrame, path: str) -> None:
    """Parquet partitioned by month, so later reads prune to the months they need."""
    months = df.withColumn("month", F.date_format(month_start(F.col("date")), "yyyy-MM"))
    months.write.mode("overwrite").partitionBy("month").parquet(path)


def classify_csv(
    spark: SparkSession, source: str, target: str, merchants: Sequence[Merchant] | None = None
) -> None:
    """Read (date, description, amount, type) CSV files, classify, write CSV files."""
    table = spark.read.csv(
        source, header=True, schema="date DATE, description STRING, amount DOUBLE, type STRING")
    renamed = table.withColumnRenamed("type", "transaction_type")
    write_csv(classify(renamed, merchants, amount="amount"), target)
