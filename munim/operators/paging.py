"""Pages of a sorted table: sorted once into ranges, any page read from the ranges it lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType


def write_sorted(df: DataFrame, order: list[str], path: str, ranges: int | None = None) -> None:
    """Write ``df`` in ``order`` (ascending, nulls first) as ranges below ``path``, with their counts.

    ``order`` should tell all rows apart: rows of equal keys lie in one range, and in no fixed order
    unless ``order`` names more columns.  ``ranges`` defaults to the shuffle partitions; a range
    has to fit into a task.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(
        *order).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/empty")  # the schema, also without rows
    counts = _ranges(df.sparkSession, path).groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).write.mode(
        "overwrite").parquet(f"{path}/index")  # one row a range


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/empty").schema.add("_range", IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_page(
    spark: SparkSession, path: str, order: list[str], page: int, size: int,
) -> DataFrame:
    """Rows of page ``page`` (from 1) of ``size`` rows, and ``row_no`` (from 1 over the whole table).

    Only the ranges that the page touches are read.  A page past the end is empty.
    """
    low, high = (page - 1) * size, page * size
    index = spark.read.parquet(f"{path}/index")
    hit = {r["_range"]: r["_before"] for r in index.where(
        (F.col("_before") < high) & (F.col("_before") + F.col("_rows") > low)).collect()}
    rows = _ranges(spark, path).where(F.col("_range").isin(list(hit)))
    before = F.lit(0)
    for part, n in hit.items():  # at most the ranges of one page
        before = F.when(F.col("_range") == part, F.lit(n)).otherwise(before)
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    numbered = rows.withColumn("row_no", (place + before).cast("long"))
    return numbered.where((F.col("row_no") > low) & (F.col("row_no") <= high)).drop("_range")
