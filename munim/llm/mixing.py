"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from munim.llm.support import GROUP_ROWS, cut, fresh, word_count
from munim.operators.ordered import running_total

#: Least quality weight, so that every document has a finite key.
LEAST_QUALITY = 0.1


def size_words(text: Column) -> Column:
    """Size of a document: its words; null text has none."""
    return word_count(text)


def text_quality(text: Column) -> Column:
    """Share of letters and blanks among the characters of a text, at least LEAST_QUALITY."""
    other = F.regexp_count(text, F.lit(r"[^\p{L}\s]"))
    share = other / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(F.greatest(1.0 - share, F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))


def source_targets(
    sized: DataFrame, *, source_col: str = "source", share: float = 1.5, cap: float = 2.0,
    weights: Sequence[float] = (5, 2, 1),
) -> DataFrame:
    """One row per source: source, source_no, docs, source_size, target.

    Sources are ordered by code point, null last, and take ``weights`` in turn.  ``share`` times
    the sum of all sizes is dealt out by weight; a target stops at ``cap`` times its source's
    size and the excess is dealt again by weight among the others until none is above.  Each
    round needs two sums over the table of sources; only those reach the driver.
    """
    per = sized.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    spans = per.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = cut(per.repartitionByRange(int(spans), F.col("source").asc_nulls_last())
                 .withColumns({"_span": F.spark_partition_id(), "_all": F.lit(1),
                               "_null": F.col("source").isNull()}))
    numbered = running_total(spread, ["_all"], ["_null", "source"], [F.col("_span")],
                             {"source_no": F.lit(1)})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(numbered.select(
        "source", "source_no", "docs", "source_size",
        F.get(turn, (F.col("source_no") - 1) % len(weights)).alias("_weight")))
    full = F.col("source_size") * F.lit(float(cap))
    level, total = None, None
    while True:
        open_ = F.lit(True) if level is None else full >= F.lit(level) * F.col("_weight")
        row = table.agg(F.sum("source_size").alias("all"),
                        F.sum(F.when(open_, F.col("_weight"))).alias("w"),
                        F.sum(F.when(~open_, full)).alias("taken")).first()
        total = min(share, cap) * (row["all"] or 0)
        again = (total - (row["taken"] or 0.0)) / row["w"] if row["w"] else level
        if again is None or level is not None and again <= level:
            break
        level = again
    target = F.least(full, F.lit(level or 0.0) * F.col("_weight"))
    return table.select("source", "source_no", "docs", "source_size", target.alias("target"))


def mix(
    sized: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", share: float = 1.5,
    cap: float = 2.0, weights: Sequence[float] = (5, 2, 1), seed: int = 7,
) -> DataFrame:
    """Add source_size, target and taken to documents with columns size and quality.

    ``taken`` is the number of words that the mix takes of a document: its whole size for every
    complete epoch of its source, then the fraction left is filled by documents in the order of
    the keys ``-ln(u) / quality`` with u drawn by a hash of ``seed``, id and size.  The document
    on which the budget ends gives the words that are still missing, so a source's taken words
    are its target, rounded down.  No document gives more than ``cap`` times its size.

    Null sources are a source of their own, and a null id or repeated rows are rows like any
    other; rows of equal keys are ordered by id and size.  Documents without words give nothing.
    Columns named like a result column are replaced.  An empty table gives an empty result.

    Running sums are taken in slices of a source by key, so that a source holding most rows is
    spread over all tasks; only one row per slice takes part in the sum over the source.
    """
    targets = cut(source_targets(sized, source_col=source_col, share=share, cap=cap, weights=weights))
    most = targets.agg(F.max("docs")).first()[0] or 0
    slices = max(1, -(-most // GROUP_ROWS))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "size"), F.lit(1 << 53)) + 0.5) / (1 << 53)
    key = -F.log(draw) / F.col("quality")
    plain = sized.drop("source_size", "target", "taken")
    source, no, docs, key_col, upto = fresh(sized, "_source", "source_no", "docs", "_key", "_upto")
    of = targets.withColumnsRenamed({"source": source, "source_no": no, "docs": docs})
    rows = plain.join(of, F.col(source_col).eqNullSafe(F.col(source))).withColumn(key_col, key)
    slice_ = F.floor((1 - F.exp(-F.col(key_col))) * slices).cast("long")
    summed = running_total(rows, [no], [key_col, id_col], [slice_], {upto: F.col("size")})
    epochs = F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(0).cast("long")
    part = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), part - (F.col(upto) - F.col("size"))))
    return summed.withColumn("taken", epochs * F.col("size") + extra).drop(
        source, no, docs, key_col, upto)


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """Whole documents as often as they are taken; the last one of a source if at least half is."""
    size = F.nullif("size", F.lit(0))
    copies = F.floor((F.col("taken") + size / 2) / size).cast("int")
    return mixed.where("size > 0").withColumn("_copies", copies).where("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
