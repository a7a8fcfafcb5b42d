"""Raw statement rows to the pipeline table, and between table layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from munim.functions import amounts as A, dates as D, money, text as T
from munim.functions.blank import strip
from munim.operators.ordered import first_per_key, line_bucket, running_total

KEY = "statement_id"


def positive_zero(value: Column) -> Column:
    """-0.0 as 0.0."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def split_dr_cr(cell: Column) -> tuple[Column, Column]:
    """Debit and credit of a single amount cell; without a suffix it is a debit."""
    value = F.coalesce(F.abs(A.parse_amount(cell)), F.lit(0.0))
    credit = A.has_suffix(cell, "cr") & ~A.has_suffix(cell, "dr")
    return F.when(credit, 0.0).otherwise(value), F.when(credit, value).otherwise(F.lit(0.0))


def unify_amount(df: DataFrame) -> DataFrame:
    """Add signed ``amount`` (debit positive) and ``transaction_type``."""
    is_debit = F.col("debit") > 0
    return df.withColumns(
        {
            "amount": positive_zero(F.when(is_debit, F.col("debit")).otherwise(-F.col("credit"))),
            "transaction_type": F.when(is_debit, "debit").otherwise("credit"),
        }
    )


def dedup_exact(df: DataFrame) -> DataFrame:
    """Drop exact copies (date, description, debit, credit); the lowest line stays."""
    return first_per_key(df, [KEY, "date", "description", "debit", "credit"], ["line_no"])


def flag_duplicates(df: DataFrame, keys: Sequence[str] = ("date", "amount", "description")) -> DataFrame:
    """Mark every copy after the first.

    The first line of each key comes from a map-side combined minimum; joining it
    back leaves a hot key to adaptive skew splitting, since only the row side is big.
    """
    on = [KEY, *keys]
    firsts = df.groupBy(*on).agg(F.min("line_no").alias("_first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in on]
    return df.alias("r").join(firsts.alias("f"), same, "left").select(
        "r.*", (F.col("r.line_no") > F.col("f._first")).alias("is_duplicate")
    )


def running_balance(
    df: DataFrame, opening: float, buckets: Sequence[Column] | None = None
) -> DataFrame:
    """Balance after each row, ordered by date and line."""
    change = money.paise(F.col("credit")) - money.paise(F.col("debit"))
    out = running_total(
        df, [KEY], ["date", "line_no"], buckets or [F.col("date"), line_bucket()],
        {"_change": change},
    )
    start = int(round(opening * 100))
    return out.withColumn("balance", (F.col("_change") + F.lit(start)) / F.lit(100.0)).drop("_change")


def clean(rows: DataFrame, *, deduplicate: bool = True) -> DataFrame:
    """Text rows (date, description, debit, credit, balance, amount_raw) to the pipeline table.

    Everything but the deduplication is narrow.  A row with an ``amount_raw`` text and
    neither a debit nor a credit column (both null in the whole row) is split by its suffix.
    """
    single = F.col("single_amount")
    debit, credit = split_dr_cr(F.col("amount_raw"))
    zero = F.lit(0.0)
    typed = rows.select(
        KEY, "line_no",
        D.parse_date(F.col("date")).alias("date"),
        T.normalize_merchant(F.col("description")).alias("description"),
        F.when(single, debit).otherwise(F.coalesce(A.parse_amount(F.col("debit")), zero)).alias("debit"),
        F.when(single, credit).otherwise(F.coalesce(A.parse_amount(F.col("credit")), zero)).alias("credit"),
        A.parse_amount(F.col("balance")).alias("balance"),
    ).where(F.col("date").isNotNull())
    out = unify_amount(typed)
    if deduplicate:
        out = dedup_exact(out)
    return out.withColumn("month_year", D.month_year(F.col("date")))


def to_interchange(df: DataFrame, bank_source: str, account: str) -> DataFrame:
    """Pipeline table to the interchange layout: credit positive, debit negative."""
    return df.select(
        KEY, "line_no", "date", "description",
        positive_zero(-F.col("amount")).alias("amount"), "transaction_type",
        F.lit(bank_source).alias("bank_source"), F.lit(account).alias("account"),
    )


def document_to_interchange(df: DataFrame) -> DataFrame:
    """Parsed-document table (amount always positive) to the interchange layout."""
    is_debit = F.col("transaction_type") == "debit"
    return df.select(
        KEY, "line_no", "date", "description",
        F.when(is_debit, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        "transaction_type", "bank_source", F.lit("").alias("account"),
    )


def to_pipeline(df: DataFrame) -> DataFrame:
    """Interchange layout to the pipeline table; a balance is carried when there is one."""
    is_credit = F.col("transaction_type") == "credit"
    size = F.abs("amount")
    zero = F.lit(0.0)
    optional = lambda c, default: F.col(c) if c in df.columns else F.lit(default)
    return df.where(F.col("date").isNotNull()).select(
        KEY, "line_no", "date", "description",
        F.when(is_credit, zero).otherwise(size).alias("debit"),
        F.when(is_credit, size).otherwise(zero).alias("credit"),
        optional("balance", 0.0).alias("balance"),
        positive_zero(F.when(F.col("amount") < 0, size).otherwise(-size)).alias("amount"),
        "transaction_type",
        optional("account", "").alias("account"), optional("bank_source", "").alias("bank_source"),
        D.month_year(F.col("date")).alias("month_year"),
    )


def records_normalize(records: DataFrame, bank_source: Column) -> DataFrame:
    """Parser records (signed ``raw_amount``, notes, meta) to the parsed-document table."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) if c in records.columns else F.lit("")
    desc, notes, meta = text("description"), text("notes"), text("meta")
    extra = lambda c: F.when((c != "") & (c != desc), c)
    raw = F.coalesce(F.col("raw_amount"), F.lit(0.0))
    return records.select(
        KEY, "line_no", "date",
        F.concat_ws(" | ", F.when(desc != "", desc), extra(notes), extra(meta)).alias("description"),
        F.abs(raw).alias("amount"),
        F.when(raw > 0, "credit").otherwise("debit").alias("transaction_type"),
        bank_source.alias("bank_source"),
    )


def post_process(df: DataFrame) -> DataFrame:
    """Drop undated and zero rows, scrub descriptions, mark duplicates."""
    tidy = df.withColumns(
        {
            "date": F.col("date").cast("date"),
            "amount": F.abs("amount"),
            "description": T.scrub_description(F.col("description")),
        }
    )
    return flag_duplicates(tidy.where(F.col("date").isNotNull() & (F.col("amount") > 0)))
