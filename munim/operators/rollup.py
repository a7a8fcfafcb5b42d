"""Monthly roll-up: a small state that reports read instead of the transactions.

A cell holds the sums of one statement, category, direction and month.  Cells of different rows
add up, so batches of new rows are rolled up on their own and never reread earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from munim.functions import money
from munim.functions.dates import month_start

KEY = "statement_id"
CELL = [KEY, "category", "transaction_type", "month"]
#: Files that one month of one batch is written to, by a hash of the statement.
FILES = 16


def month_rollup(df: DataFrame) -> DataFrame:
    """One row per cell: n_rows, sums of debit, credit, amount and its size (charges), and n_amount.

    Only columns that ``df`` has are summed.  Sums are whole hundredths of a paisa, so they are
    exact however rows are partitioned or batched; they combine map-side.
    """
    fine = lambda value: F.sum(F.round(value * money.FINE).cast("bigint"))
    sums = [fine(F.col(c)).alias(c) for c in ("debit", "credit", "amount") if c in df.columns]
    if "amount" in df.columns:
        sums += [fine(F.abs("amount")).alias("charges"), F.count("amount").alias("n_amount")]
    return df.groupBy(KEY, "category", "transaction_type", month_start(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), *sums)


def rupees(fine: Column) -> Column:
    """A rolled-up sum as money."""
    return fine / F.lit(float(money.FINE))


def merge_rollups(cells: DataFrame) -> DataFrame:
    """Cells of several roll-ups added up."""
    return cells.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in cells.columns if c not in CELL])


def add_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write the roll-up of new rows below ``path``; a batch written again replaces itself.

    Nothing stored before is read or rewritten, so a job that lost its executors is simply run again.
    """
    cells = month_rollup(df).repartition(F.col("month"), F.pmod(F.xxhash64(KEY), F.lit(FILES)))
    cells.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(
        f"{path}/batch={batch}")


def read_rollup(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The stored roll-up of all batches; months before ``since`` are not read."""
    cells = spark.read.option("basePath", path).parquet(path).drop("batch")
    if since is not None:
        cells = cells.where(F.col("month") >= F.lit(since).cast("date"))
    return merge_rollups(cells.withColumn("month", F.col("month").cast("date")))
