"""Amount texts to numbers.  All functions are null-safe ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from munim.functions.binding import let
from munim.functions.blank import strip
from munim.rules.patterns import CURRENCY, NUMBER, SIGNED_AMOUNT
from munim.rules.tokens import EMPTY_AMOUNTS, NULL_TOKENS

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def null_token(cell: Column) -> Column:
    """Strip a cell and turn the textual null tokens into SQL null."""
    trimmed = strip(cell)
    return F.when(~trimmed.isin(NULL_TOKENS), trimmed)


def to_number(text: Column) -> Column:
    """Plain decimal text to double, anything else to null (no ``nan``/``inf``)."""
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double"))


def has_suffix(cell: Column, side: str) -> Column:
    """Whether an amount text ends in a ``Dr``/``Cr`` marker."""
    first = side[0].upper()
    return strip(cell).rlike(rf"({first}r\.?|{first}R\.?)$")


def parse_amount(cell: Column) -> Column:
    """Statement-cell amount: currency marks, lakh commas, Dr/Cr suffix, ``(x)``, ``x-``.

    The suffix only marks the side; it does not change the sign.
    """
    body = F.regexp_replace(null_token(cell), r"₹|Rs\.|Rs|INR|[ ,]", "")
    body = F.regexp_replace(body, r"([DC]r\.?|[DC]R\.?)$", "")
    return let(
        body,
        lambda t: F.when(t.startswith("(") & t.endswith(")"), to_number(_negated(t, 2, 2)))
        .when(t.endswith("-"), to_number(_negated(t, 1, 1)))
        .otherwise(to_number(t)),
    )


def _negated(text: Column, start: int, cut: int) -> Column:
    return F.concat(F.lit("-"), F.substring(text, F.lit(start), F.length(text) - cut))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _not_empty(cell: Column) -> Column:
    text = strip(cell)
    return F.when(~F.lower(text).isin(EMPTY_AMOUNTS), text)


def parse_amount_signed(cell: Column) -> Column:
    """Find an amount anywhere in a text; credit positive, debit negative.

    A sign before the currency wins, then a CR/DR suffix, then a bare currency (debit).
    """
    suffixed = rf"(?i){CURRENCY}?\s*({NUMBER})\s*(CR|DR|C|D)\b"
    plain = rf"(?i){CURRENCY}\s*({NUMBER})"

    def read(text: Column) -> Column:
        signed = _digits(F.regexp_extract(text, SIGNED_AMOUNT, 2))
        crdr = _digits(F.regexp_extract(text, suffixed, 1))
        is_credit = F.upper(F.regexp_extract(text, suffixed, 2)).startswith("C")
        return (
            F.when(text.rlike(SIGNED_AMOUNT),
                   F.when(F.regexp_extract(text, SIGNED_AMOUNT, 1) == "+", signed)
                   .otherwise(-signed))
            .when(text.rlike(suffixed), F.when(is_credit, crdr).otherwise(-crdr))
            .when(text.rlike(plain), -_digits(F.regexp_extract(text, plain, 1)))
        )

    return let(_not_empty(cell), read)


def parse_amount_anchored(cell: Column) -> Column:
    """Whole cell must be an amount; credit positive, debit negative, ``(x)`` and bare = debit."""
    signed = rf"(?i)^([+\-])\s*{CURRENCY}\s*({NUMBER})$"
    suffixed = rf"(?i)^{CURRENCY}?\s*({NUMBER})\s*(CR|DR|C|D)\.?$"
    parens = rf"(?i)^\({CURRENCY}?\s*({NUMBER})\)$"

    def read(text: Column) -> Column:
        bare = strip(F.regexp_replace(text, rf"(?i)^{CURRENCY}\s*|,", ""))
        value = _digits(F.regexp_extract(text, signed, 2))
        crdr = _digits(F.regexp_extract(text, suffixed, 1))
        is_credit = F.upper(F.regexp_extract(text, suffixed, 2)).startswith("C")
        return (
            F.when(text.rlike(signed),
                   F.when(F.regexp_extract(text, signed, 1) == "+", value).otherwise(-value))
            .when(text.rlike(suffixed), F.when(is_credit, crdr).otherwise(-crdr))
            .when(text.rlike(parens), -_digits(F.regexp_extract(text, parens, 1)))
            .otherwise(-F.abs(let(bare, to_number)))
        )

    return let(_not_empty(cell), read)


def parse_amount_plain(cell: Column) -> Column:
    """Unsigned amount of a debit or credit column; anything unreadable is 0."""
    text = F.regexp_replace(_not_empty(cell), rf"(?i)^{CURRENCY}\s*", "")
    text = F.regexp_replace(text, r"(?i)\s*(CR|DR|C|D)\.?$", "")
    number = let(strip(F.regexp_replace(text, ",", "")), to_number)
    return F.coalesce(F.abs(number), F.lit(0.0))


def parse_amount_free(match: Column) -> Column:
    """Signed value of one hit of the any-format amount scanner."""
    text = strip(match)
    value = _digits(F.regexp_extract(text, NUMBER, 0))
    credit = text.startswith("+") | (~text.startswith("-") & text.rlike(r"(?i)\bCR\b"))
    return F.when(credit, value).otherwise(-value)
