"""Transaction views over the driver's star-schema tables, in Spark and in SQL.

``txn`` is the pipeline-shaped table: one statement per customer, one row per
line item.  ``line_no`` is ``days since 1970 * 10^9 + rank within the day``, so it
is unique and ordered within a statement, and ranking never needs more than one
day of one statement in a task.  ``pick`` only varies the generated texts.

The other views format ``txn`` back into statement texts, so parsing them must
return the unformatted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from munim.functions import money
from munim.plans.samples import NARRATIONS
from munim.session import stored

DAY_SPAN = 10**9

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's customer and their part's names; one price, no texts made of it."""
    item = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return (
        item.join(order, item.l_orderkey == order.o_orderkey)
        .join(part, item.l_partkey == part.p_partkey)
        .select(
            F.col("o_custkey").alias("statement_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("p_name").alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


def with_amounts(rows: DataFrame, *more: str | Column) -> DataFrame:
    """Transaction columns of ``items``, and ``more``."""
    is_credit = F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice")
    return rows.select(
        "statement_id", "date", "description", "category", "subcategory",
        F.when(is_credit, "credit").otherwise("debit").alias("transaction_type"),
        F.when(is_credit, 0.0).otherwise(price).alias("debit"),
        F.when(is_credit, price).otherwise(0.0).alias("credit"),
        F.when(is_credit, -price).otherwise(price).alias("amount"),
        *more,
    )


def txn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without ``line_no``; enough for every aggregate."""
    return with_amounts(items(spark, sf_dir), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with ``line_no`` and ``pick``; amounts are made of the price after the shuffle."""
    day = W.partitionBy("statement_id", "date").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.abs("l_extendedprice")
    )
    days = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    ranked = items(spark, sf_dir).withColumn("_rank", F.row_number().over(day).cast("bigint"))
    return with_amounts(
        ranked,
        (days * DAY_SPAN + F.col("_rank")).alias("line_no"),
        (F.col("statement_id") * 31 + days * 7 + F.col("_rank")).alias("pick"),
    )


def stored_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(txn(spark, sf_dir))


def debits(df: DataFrame) -> DataFrame:
    return df.where(F.col("transaction_type") == "debit")


TXN_SQL = f"""
txn_base AS (
  SELECT o_custkey AS statement_id, CAST(l_shipdate AS DATE) AS date, p_name AS description,
         p_type AS category, p_brand AS subcategory,
         CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS transaction_type,
         CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_extendedprice END AS debit,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0::DOUBLE END AS credit,
         CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount,
         CAST(row_number() OVER (
           PARTITION BY o_custkey, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS rnk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), txn AS (
  SELECT * EXCLUDE (rnk),
         date_diff('day', DATE '1970-01-01', date) * {DAY_SPAN} + rnk AS line_no,
         statement_id * 31 + date_diff('day', DATE '1970-01-01', date) * 7 + rnk AS pick
  FROM txn_base
), deb AS (SELECT * FROM txn WHERE transaction_type = 'debit')
"""


def narration(pick: Column) -> Column:
    """One of the sample narrations, with a reference number."""
    texts = F.split(F.lit("\x1f".join(NARRATIONS)), "\x1f")  # folded into one constant
    text = F.get(texts, (pick % len(NARRATIONS)).cast("int"))
    return F.replace(text, F.lit("{num}"), (pick % 900000 + 1000).cast("string"))


NARRATION_SQL = (
    "replace(list_extract([" + ", ".join("'" + n.replace("'", "''") + "'" for n in NARRATIONS)
    + f"], CAST(pick % {len(NARRATIONS)} AS INT) + 1), '{{num}}', "
    "CAST(pick % 900000 + 1000 AS VARCHAR))"
)


def raw_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` with date, amount and narration as statement texts."""
    return as_texts(txn(spark, sf_dir))


def stored_raw_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_txn`` over a stored view; without category, subcategory, debit and credit."""
    return as_texts(stored(txn(spark, sf_dir).drop("category", "subcategory", "debit", "credit")))


def as_texts(rows: DataFrame) -> DataFrame:
    date_text = (
        F.when(F.col("pick") % 4 == 0, F.date_format("date", "dd-MM-yyyy"))
        .when(F.col("pick") % 4 == 1, F.date_format("date", "d/M/yyyy"))
        .when(F.col("pick") % 4 == 2, F.date_format("date", "yyyy-MM-dd"))
        .otherwise(F.date_format("date", "dd-MMM-yyyy"))
    )
    # Layouts that no list names.
    rare = [
        "d MMM yyyy' 10:30:00'", "MMM d yyyy", "MMMM d, yyyy", "dd.MM.yy", "yyyyMMdd", "d'th 'MMMM yyyy",
        "yyyy MMM d", "'Sunday, 'd MMMM yyyy", "yyyy.MM.dd", "d MMMM, yyyy", "dd-MMM-yyyy' 9:05 am'",
        "yyyy-MM-dd'T10:30:00Z'",
    ]
    for k, layout in enumerate(rare):
        date_text = F.when(F.col("pick") % 40 == 20 + k, F.date_format("date", layout)).otherwise(date_text)
    edge = F.when(F.col("pick") % 5 == 1, "\t").when(F.col("pick") % 5 == 2, "\u00a0").otherwise("")
    date_text = F.concat(edge, date_text, edge)
    lakh = F.substring(money.format_inr_paise(F.abs("amount")), 2, 40)
    side = F.when(F.col("transaction_type") == "debit", "Dr").otherwise("Cr")
    amount_text = (
        F.when(F.col("pick") % 3 == 0, F.concat(F.lit("₹"), lakh, F.lit(" "), side))
        .when(F.col("pick") % 3 == 1, F.concat(F.lit("Rs. "), lakh, side))
        .otherwise(F.concat(lakh, F.lit(" "), F.upper(side)))
    )
    amount_text = F.concat(amount_text, edge)
    return rows.select(
        "*", date_text.alias("raw_date"), amount_text.alias("raw_amount"), lakh.alias("lakh"),
        narration(F.col("pick")).alias("narration"),
    )


#: ``txn`` with the same narrations, for oracles that need the text.
NARRATED_SQL = TXN_SQL + f", raw AS (SELECT *, {NARRATION_SQL} AS narration FROM txn)"


def narrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` whose description is a realistic narration."""
    return txn(spark, sf_dir).withColumn("description", narration(F.col("pick")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges with a time of day: one statement per user, amounts coarse so they repeat."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("statement_id"), F.col("event_id").alias("line_no"), "ts",
        F.col("event_type").alias("description"), F.round("value", -2).alias("amount"),
    )
