"""The row-level operators on a stream.

Cleaning and classification are stateless, so the batch functions run unchanged
on ``readStream`` frames; only dropping repeats needs state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from munim.operators.classify import Merchant, classify
from munim.operators.clean import clean


def clean_stream(rows: DataFrame, merchants: Sequence[Merchant] | None = None) -> DataFrame:
    """Raw text rows of a stream to classified transactions."""
    return classify(clean(rows, deduplicate=False), merchants)


def drop_repeats(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop a charge of the same statement, merchant and amount that repeats within ``delay``."""
    timed = stream.withColumn("event_time", F.col("date").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        ["statement_id", "description", "amount"])
