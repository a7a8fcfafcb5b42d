"""Money arithmetic and Indian-style number texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from munim.rules.tokens import LATIN1_REPLACEMENTS


#: Parts of a rupee in which amounts are added.
FINE = 10_000


def paise(amount: Column) -> Column:
    """Whole paise of a rupee amount."""
    return F.round(amount * 100).cast("bigint")


def total(amount: Column) -> Column:
    """Exact sum of money, down to a hundredth of a paisa.

    Adding whole numbers makes the result independent of row order and partitioning,
    and keeps the aggregate buffer a plain ``bigint``.
    """
    return F.sum(F.round(amount * FINE).cast("bigint")) / F.lit(float(FINE))


def total_or_zero(amount: Column) -> Column:
    return F.coalesce(total(amount), F.lit(0.0))


def round_even(value: Column, places: int = 0) -> Column:
    """Round to ``places`` decimals, ties to even, in binary arithmetic."""
    if places == 0:
        return F.rint(value)
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def ratio(part: Column, whole: Column, default: float | None = None) -> Column:
    """``part / whole``, or ``default`` when ``whole`` is zero or null."""
    out = F.when(whole != 0, part / whole)
    return out if default is None else F.coalesce(out, F.lit(default))


def savings_rate(credits: Column, debits: Column) -> Column:
    """Percent of income kept; 0 when there is no income."""
    return F.when(credits != 0, (credits - debits) / credits * 100).otherwise(F.lit(0.0))


def _group_digits(digits: Column) -> Column:
    return F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")


def format_inr(amount: Column) -> Column:
    """``-123456.7`` -> ``-₹1,23,456`` (fraction cut, lakh grouping)."""
    digits = _group_digits(F.abs(amount).cast("bigint").cast("string"))
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), digits)


def fixed(value: Column, places: int) -> Column:
    """Number text with ``places`` decimals, rounded half-even; null stays null."""
    text = F.format_string(f"%.{places}f", round_even(value, places))
    return F.when(value.isNotNull(), text)


def format_inr_paise(amount: Column) -> Column:
    """``123456.7`` -> ``₹1,23,456.70``."""
    text = fixed(F.abs(amount), 2)
    whole = F.substring_index(text, ".", 1)
    return F.concat(
        F.when(amount < 0, "-").otherwise(""), F.lit("₹"), _group_digits(whole),
        F.lit("."), F.substring_index(text, ".", -1),
    )


def format_inr_compact(amount: Column) -> Column:
    """``Rs.1.2Cr`` / ``Rs.3.4L`` / ``Rs.5,678`` / ``Rs.12``, sign dropped."""
    value = F.abs(amount)
    return F.concat(
        F.lit("Rs."),
        F.when(value >= 1e7, F.concat(fixed(value / 1e7, 1), F.lit("Cr")))
        .when(value >= 1e5, F.concat(fixed(value / 1e5, 1), F.lit("L")))
        .when(value >= 1e3, F.format_number(value, 0))
        .otherwise(fixed(value, 0)),
    )


def whole_number(value: Column) -> Column:
    """``1234567.8`` -> ``1,234,568`` (western grouping, half-even)."""
    return F.format_number(value, 0)


def latin1_safe(text: Column, max_length: int = 200) -> Column:
    """Text limited to Latin-1, longer texts cut, unknown characters as ``?``."""
    cut = F.left(text, F.lit(max_length))
    swapped = reduce(
        lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LATIN1_REPLACEMENTS.items(), cut
    )
    return F.regexp_replace(swapped, "[^\\x00-\\xFF]", "?")
