"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain Python reuse of a Column repeats its whole expression at every use;
    cascades of regular expressions over one text then cost a multiple.
    """
    return F.transform(F.array(value), body)[0]


def capture(text: Column, pattern: str, groups: int) -> Column:
    """Groups of a pattern that spans the whole text, as an array; null without a match.

    One match instead of one per group.
    """
    mark = "\u0001"
    joined = F.regexp_replace(text, pattern, mark.join(f"${i}" for i in range(1, groups + 1)))
    return let(F.split(joined, mark), lambda a: F.when(F.size(a) == groups, a))


def once(df: DataFrame, row: Column, keep: list[str] | None = None) -> DataFrame:
    """Add the fields of a costly struct so that nothing above evaluates it again.

    Filters and projections on the new columns are never inlined through a
    generator, as they would be through a projection.
    """
    return df.select(*(keep if keep is not None else ["*"]), F.inline(F.array(row)))
