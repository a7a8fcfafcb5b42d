"""Anomaly features, repeated charges, reasons and summaries.

Statistics are small aggregates that are joined back to the transactions by
equality; nothing is looked up through a window over a whole statement.  Where
several are joined in a row, ``source`` names the plain transactions, so that each
aggregate reads a few columns of those and not the joins made before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from munim.functions import money
from munim.operators.aggregates import KEY, category_stats, only, top_rows

FEATURES = [
    "amount_log", "day_of_month", "day_of_week", "hour_of_day", "merchant_frequency",
    "amount_zscore", "is_weekend", "days_since_last",
]
SCORE_LIMIT = 0.65
LIFTED_SCORE = 0.66


@dataclass(frozen=True)
class FittedStats:
    """What has been learnt from a training table; new transactions can be scored with it."""

    merchant_counts: DataFrame
    category_stats: DataFrame
    scaler: DataFrame | None = None


def merchant_counts(df: DataFrame) -> DataFrame:
    return only(df, "debit").groupBy(KEY, "description").agg(
        F.count(F.lit(1)).alias("merchant_frequency")
    )


def with_merchant_frequency(df: DataFrame, counts: DataFrame) -> DataFrame:
    """How often the merchant occurs in the fitted statement; 0 when it is new."""
    return df.join(counts, [KEY, "description"], "left").withColumn(
        "merchant_frequency", F.coalesce("merchant_frequency", F.lit(0))
    )


def with_category_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``category_mean``/``category_std``, null for a category that was not fitted."""
    named = stats.select(KEY, "category", F.col("mean").alias("category_mean"),
                         F.col("std").alias("category_std"))
    return df.join(named, [KEY, "category"], "left")


def with_zscore(df: DataFrame, stats: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Distance of an amount from its category, in deviations.

    A category that was not fitted uses mean and deviation of the statement at hand.
    """
    joined = with_category_stats(df, stats).join(_overall(df if source is None else source), KEY)
    return joined.withColumn("amount_zscore", _zscore()).drop("_mean", "_std")


def _overall(source: DataFrame) -> DataFrame:
    """Mean and deviation of each statement's amounts."""
    return source.groupBy(KEY).agg(
        money.ratio(money.total(F.col("amount")), F.count("amount")).alias("_mean"),
        F.stddev_samp("amount").alias("_std"),
    )


def _zscore() -> Column:
    mean = F.coalesce("category_mean", "_mean")
    std = F.coalesce("category_std", "_std")
    return (F.abs("amount") - F.abs(mean)) / F.when(std != 0, std).otherwise(1.0)


def with_days_since_last(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Days since the statement's previous debit, 0 for the first one.

    Only the first line of a day can have a gap, so the window runs over distinct
    days of a statement rather than over its lines.
    """
    return df.join(_days(df if source is None else source), [KEY, "date"], "left").withColumn(
        "days_since_last", _since_last()).drop("_first", "_gap")


def _days(source: DataFrame) -> DataFrame:
    """First line of each day of a statement, and the days since its day before."""
    days = source.groupBy(KEY, "date").agg(F.min("line_no").alias("_first"))
    gap = F.datediff("date", F.lag("date").over(W.partitionBy(KEY).orderBy("date")))
    return days.withColumn("_gap", F.coalesce(gap, F.lit(0)))


def _since_last() -> Column:
    return F.when(F.col("line_no") == F.col("_first"), F.col("_gap")).otherwise(0)


def _micros(df: DataFrame, at: str) -> Column:
    """Microseconds since 1970 of a DATE or time-zone free timestamp column."""
    days = F.datediff(at, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(df.schema[at].dataType, T.DateType):
        return days * 86_400_000_000
    clock = (F.hour(at) * 3600 + F.minute(at) * 60).cast("bigint") * 1_000_000
    return days * 86_400_000_000 + clock + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def with_repeat_charge(
    df: DataFrame, at: str = "date", days: int = 7, source: DataFrame | None = None
) -> DataFrame:
    """Add ``is_dup_charge``: same merchant and amount again within ``days`` whole days.

    Time is cut into bins of ``days + 1`` days.  Two charges in one bin are always
    close enough; otherwise only the last charge of the bin before and the first of
    the bin after can be.  The aggregate per bin combines map-side, so a charge
    that repeats without end still sends one row per bin and map task.
    """
    width = (days + 1) * 86_400_000_000
    on = [KEY, "description", "amount"]
    position = _micros(df, at)
    slot = F.floor(position / F.lit(width)).cast("bigint")
    bins = (df if source is None else source).groupBy(*on, slot.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_min"), F.max(position).alias("_max")
    )
    w = W.partitionBy(*on).orderBy("_bin")
    near = (
        (F.col("_n") > 1)
        | (F.col("_min") - F.lag("_max").over(w) < width)
        | (F.lead("_min").over(w) - F.col("_max") < width)
    )
    repeats = bins.withColumn("_near", F.coalesce(near, F.lit(False))).where("_near").select(
        *on, "_bin", F.lit(True).alias("is_dup_charge")
    )
    return df.withColumn("_bin", slot).join(repeats, [*on, "_bin"], "left").withColumn(
        "is_dup_charge", F.coalesce("is_dup_charge", F.lit(False))
    ).drop("_bin")


def fit_stats(df: DataFrame) -> FittedStats:
    """Merchant counts and category statistics of the debits."""
    return FittedStats(merchant_counts(df), category_stats(df))


def features(df: DataFrame, stats: FittedStats) -> DataFrame:
    """Debits with the eight model features.

    Figures of whole statements come with those of their days, which windows have gathered by
    statement already; every debit has a day, so the debits are shuffled once for both.
    """
    debits = only(df, "debit")
    out = with_category_stats(with_merchant_frequency(debits, stats.merchant_counts), stats.category_stats)
    days = _days(debits).join(_overall(debits), KEY).withColumnsRenamed({KEY: "_key", "date": "_date"})
    out = out.join(days, (F.col(KEY) == F.col("_key")) & F.col("date").eqNullSafe(F.col("_date")))
    figures = {"amount_zscore": _zscore(), "days_since_last": _since_last()}
    out = out.withColumns(figures).drop("_key", "_date", "_mean", "_std", "_first", "_gap")
    weekday = F.weekday("date")
    return out.withColumns(
        {
            "amount_log": F.log1p(F.abs("amount")),
            "day_of_month": F.dayofmonth("date"),
            "day_of_week": weekday,
            "hour_of_day": F.lit(12),
            "is_weekend": (weekday >= 5).cast("int"),
        }
    )


def fit_scaler(feature_rows: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature and statement, and its number of rows."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in FEATURES:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"_mu_{f}"), F.coalesce(F.when(sd != 0, sd), F.lit(1.0)).alias(f"_sd_{f}")]
    return feature_rows.groupBy(KEY).agg(*aggs)


def overall_scaler(scaler: DataFrame) -> dict[str, float]:
    """Mean and deviation of each feature over all fitted rows: one row, from the small scaler."""
    n = F.col("_rows")
    means = {f"_mu_{f}": F.sum(F.col(f"_mu_{f}") * n) / F.sum(n) for f in FEATURES}
    squares = {f"_sd_{f}": F.sum((F.col(f"_sd_{f}") ** 2 + F.col(f"_mu_{f}") ** 2) * n) / F.sum(n)
               for f in FEATURES}
    row = scaler.agg(*[c.alias(k) for k, c in {**means, **squares}.items()]).first().asDict()
    for f in FEATURES:
        spread = (row[f"_sd_{f}"] or 0.0) - (row[f"_mu_{f}"] or 0.0) ** 2
        row |= {f"_sd_{f}": math.sqrt(spread) if spread > 0 else 1.0, f"_mu_{f}": row[f"_mu_{f}"] or 0.0}
    return row


def standardize(
    feature_rows: DataFrame, scaler: DataFrame, prefix: str = "",
    overall: dict[str, float] | None = None,
) -> DataFrame:
    """Features as distances from the fitted mean in deviations; constant features are 0.

    With a ``prefix`` the original features stay beside the new columns.  Statements that were
    not fitted use the ``overall`` scaler; without one their features are null.
    """
    at = lambda c: F.coalesce(c, F.lit(overall[c])) if overall else F.col(c)
    scaled = {prefix + f: (F.col(f) - at(f"_mu_{f}")) / at(f"_sd_{f}") for f in FEATURES}
    joined = feature_rows.join(scaler, KEY, "left")
    return joined.withColumns(scaled).drop(*[c for c in scaler.columns if c != KEY])


def decide(scored: DataFrame) -> DataFrame:
    """Flag, lift the score of repeated charges, and state the reason.

    Needs ``anomaly_score``, ``is_dup_charge``, ``merchant_frequency``,
    ``category_mean`` and ``category_std``.
    """
    raw = F.col("anomaly_score")
    lifted = F.col("is_dup_charge") & (raw < SCORE_LIMIT)
    score = F.when(lifted, LIFTED_SCORE).otherwise(raw)
    flagged = scored.withColumns(
        {"is_anomaly": (raw > SCORE_LIMIT) | F.col("is_dup_charge"), "anomaly_score": score,
         "_lifted": lifted}
    )
    return flagged.withColumn(
        "anomaly_reason", F.when(F.col("is_anomaly"), reason()).otherwise("")
    ).drop("_lifted")


def reason() -> Column:
    """Why a transaction was flagged."""
    amount = F.abs("amount")
    mean = F.abs("category_mean")
    rupees = lambda v: F.concat(F.lit("₹"), money.whole_number(v))
    against = F.concat(
        F.lit("("), rupees(amount), F.lit(" vs avg "), rupees(mean), F.lit(" for "),
        F.col("category"), F.lit(")"))
    parts = F.concat_ws(
        "; ",
        F.when(amount > mean + 2 * F.col("category_std"),
               F.concat(F.lit("Unusually large amount "), against)),
        F.when((F.col("anomaly_score") >= SCORE_LIMIT) & (F.col("merchant_frequency") == 0),
               F.concat(F.lit("First-time merchant with high amount ("), rupees(amount), F.lit(")"))),
        F.when(F.col("_lifted"), "Same merchant charged twice within 7 days"),
    )
    fallback = F.when(
        F.col("category_mean").isNotNull(), F.concat(F.lit("Unusual spending pattern "), against)
    ).otherwise(F.concat(F.lit("Unusual transaction pattern ("), rupees(amount), F.lit(")")))
    return F.when(parts != "", parts).otherwise(fallback)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Number and summed amount of flagged transactions per statement."""
    return scored.groupBy(KEY).agg(
        F.count_if(F.col("is_anomaly")).alias("total_anomalies"),
        money.total_or_zero(F.when(F.col("is_anomaly"), F.abs("amount"))).alias("total_flagged_amount"),
    )


def top_anomalies(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest-scored flagged transactions of each statement."""
    return top_rows(scored.where("is_anomaly"), k, F.desc("anomaly_score"), F.col("line_no"))


def severity(score: Column) -> Column:
    return F.when(score >= 0.80, "critical").when(score >= 0.72, "high").otherwise("medium")
