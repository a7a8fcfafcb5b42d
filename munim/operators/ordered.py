"""Order-dependent operators that do not put a whole statement into one task.

A plain window over ``statement_id`` sorts a whole statement in a single task; if
one statement holds a third of all rows, so does that task.  Here the ordered
rows of a statement are cut into consecutive buckets.  The row-level window runs
per (statement, bucket); only one summary row per bucket takes part in the
window over the statement, and is joined back on (statement, bucket), a key the
row-level data is already partitioned by.  That join is by merging: summary rows can
be nearly as many as rows, and of generated rows Spark expects too few for it to
send them to every task through the driver.

``buckets`` are columns that never decrease along ``order``, or the name that ``cut_long`` gave
its column: that cuts only long keys into buckets, since a bucket of few rows costs more in
summaries than it saves, and row-level data stays partitioned for the next helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Lines per bucket where lines are numbered from 0 without gaps.
DENSE_SPAN = 65536
#: Rows of a key that one task takes whole.
WHOLE_ROWS = 20_000
#: Bucket of all rows of a shorter key.
WHOLE = -(1 << 62)


def line_bucket(span: int = DENSE_SPAN, line_no: str = "line_no") -> Column:
    """Bucket of consecutive lines."""
    return F.floor(F.col(line_no) / F.lit(span)).cast("bigint")


def cut_long(df: DataFrame, part: list[str], bucket: Column, name: str = "_cut") -> DataFrame:
    """Add ``name``: ``bucket`` for keys of more than ``WHOLE_ROWS`` rows, else ``WHOLE``.

    Keys are counted by a map-side combined aggregate; the long ones, at most one of ``WHOLE_ROWS``
    rows, are sent to every task.  Null keys, which match nothing, and null buckets stay as they are.
    """
    long = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE_ROWS).select(
        *part, F.lit(True).alias("_long"))
    apart = F.col("_long").isNotNull()
    for key in part:
        apart = apart | F.col(key).isNull()
    return df.join(F.broadcast(long), part, "left").withColumn(
        name, F.when(apart, bucket).when(bucket.isNotNull(), F.lit(WHOLE))).drop("_long")


def _with_buckets(
    df: DataFrame, buckets: Sequence[Column | str],
) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its buckets, their names, and those of them that are not of ``df``."""
    if isinstance(buckets[0], str):
        return df, list(buckets), []
    names = [f"_bucket{i}" for i in range(len(buckets))]
    return df.withColumns(dict(zip(names, buckets))), names, names


def _several(rows: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """Rows of keys that may have several buckets.

    A key in one bucket needs no summary; its rows are dropped before any shuffle.
    """
    return rows if own else rows.where(F.col(names[0]) != WHOLE)


def running_total(
    df: DataFrame, part: list[str], order: list[str], buckets: Sequence[Column | str],
    values: dict[str, Column],
) -> DataFrame:
    """Add cumulative sums (including the row itself), one per entry of ``values``."""
    rows, names, own = _with_buckets(df, buckets)
    inner = W.partitionBy(*part, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*part).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns({f"_in_{k}": F.sum(v).over(inner) for k, v in values.items()})
    totals = _several(rows, names, own).groupBy(*part, *names).agg(
        *[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()]
    )
    before = totals.select(
        *part, *names, *[F.sum(f"_sum_{k}").over(outer).alias(f"_before_{k}") for k in values]
    )
    joined = local.join(before.hint("merge"), [*part, *names], "left")
    return joined.withColumns(
        {
            k: F.coalesce(F.col(f"_in_{k}"), F.lit(0)) + F.coalesce(F.col(f"_before_{k}"), F.lit(0))
            for k in values
        }
    ).drop(*own, *[f"_in_{k}" for k in values], *[f"_before_{k}" for k in values])


def carry_forward(
    df: DataFrame, part: list[str], order: list[str], buckets: Sequence[Column | str],
    value: Column, name: str, *, include_current: bool = True,
) -> DataFrame:
    """Add the latest non-null ``value`` at or before (or strictly before) each row."""
    rows, names, own = _with_buckets(df.withColumn("_value", value), buckets)
    inner = W.partitionBy(*part, *names).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1
    )
    outer = W.partitionBy(*part).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_in", F.last("_value", ignorenulls=True).over(inner))
    # Null positions are ignored, so a bucket without a value still has its (empty) row.
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    lasts = _several(rows, names, own).groupBy(*part, *names).agg(
        F.max_by("_value", position).alias("_last"))
    before = lasts.select(
        *part, *names, F.last("_last", ignorenulls=True).over(outer).alias("_before")
    )
    joined = local.join(before.hint("merge"), [*part, *names], "left")
    return joined.withColumn(name, F.coalesce("_in", "_before")).drop(
        "_value", "_in", "_before", *own
    )


def following(
    df: DataFrame, part: list[str], order: list[str], buckets: Sequence[Column | str],
    value: Column, names_out: list[str], *, back: bool = False,
) -> DataFrame:
    """Add the values of the next ``len(names_out)`` rows, null past the end.

    With ``back`` these are the rows before, the nearest first.
    """
    depth = len(names_out)
    rows, names, own = _with_buckets(df.withColumn("_value", value), buckets)
    turned = lambda columns: [F.desc_nulls_first(c) for c in columns] if back else columns
    inner = W.partitionBy(*part, *names).orderBy(*turned(order))
    local = rows.withColumns(
        {
            "_rank": F.row_number().over(inner),
            **{f"_next{k}": F.lead(F.struct("_value"), k).over(inner) for k in range(1, depth + 1)},
        }
    )
    heads = _several(local, names, own).where(F.col("_rank") <= depth).groupBy(*part, *names).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_value"))).alias("_head")
    )
    outer = W.partitionBy(*part).orderBy(*turned(names))
    after = heads.select(
        *part, *names,
        F.slice(F.flatten(
            F.array(*[
                F.coalesce(F.lead("_head", k).over(outer), F.expr("slice(_head, 1, 0)"))
                for k in range(1, depth + 1)
            ])
        ), 1, depth).alias("_after"),
    )
    joined = local.join(after.hint("merge"), [*part, *names], "left")
    out = {}
    for k, name in enumerate(names_out, 1):
        # Rows of this bucket still ahead decide how deep to look into the next bucket.
        ahead = sum(
            (F.col(f"_next{j}").isNotNull().cast("int") for j in range(1, k)), F.lit(0)
        )
        out[name] = F.coalesce(
            F.col(f"_next{k}")["_value"],
            F.when(F.col(f"_next{k}").isNull(), F.get("_after", F.lit(k - 1) - ahead)["_value"]),
        )
    return joined.withColumns(out).drop(
        "_value", "_rank", "_after", *[f"_next{k}" for k in range(1, depth + 1)], *own
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key in ``order``.

    An aggregate, not a window: copies of one key collapse map-side before the
    shuffle, so a key with any number of copies costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return first.select(*keys, "_row.*").select(*df.columns)
