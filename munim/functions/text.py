"""Description texts: cleaning, names, grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from munim.functions.blank import strip
from munim.rules import patterns as P
from munim.rules import tokens as K


def literal_map(table: dict[str, str]) -> Column:
    """Map literal of a small fixed lookup table."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed lookup table, null when the key is absent."""
    return F.try_element_at(literal_map(table), key)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so ``MCDONALD'S`` becomes ``Mcdonald'S``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def header_key(cell: Column) -> Column:
    """Header text in comparable form: one space between words, lower case."""
    return F.lower(collapse_spaces(cell))


def normal_cell(cell: Column) -> Column:
    """Document cell on one line, runs of blanks reduced, null as empty."""
    text = strip(F.regexp_replace(F.coalesce(cell, F.lit("")), "\n", " "))
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def normalize_merchant(text: Column) -> Column:
    """Drop trailing reference numbers and title-case the rest; null becomes empty."""
    out = strip(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"[#/]\s*\d+\s*$", "")
    out = F.regexp_replace(out, r"\s+\d{4,}\s*$", "")
    out = F.regexp_replace(out, r"\s*-\s*\d{4,}\s*$", "")
    return title_case(strip(out))


def scrub_description(text: Column) -> Column:
    """Drop numeric tokens and long reference numbers, collapse blanks, keep 200 characters."""
    words = F.filter(F.split(strip(text), r"\s+"), lambda w: ~w.rlike(r"^\d+$"))
    out = strip(F.regexp_replace(F.array_join(words, " "), r"\b\d{6,}\b", ""))
    out = F.regexp_replace(out, r"\s{2,}", " ")
    return F.left(F.coalesce(out, F.lit("")), F.lit(200))


def clean_by_issuer(issuer: Column, text: Column) -> Column:
    """Issuer-specific clean-up of a description; other issuers keep the text."""
    def squeeze(c: Column) -> Column:
        return F.regexp_replace(strip(c), r"\s{2,}", " ")

    sbi = strip(F.regexp_replace(text, P.SBI_PREFIX, ""))
    return (
        F.when(issuer == "SBI", squeeze(F.regexp_replace(sbi, P.SBI_SUFFIX, "")))
        .when(issuer == "HDFC", squeeze(F.regexp_replace(text, P.HDFC_SUFFIX, "")))
        .when(issuer == "ICICI", squeeze(F.regexp_replace(text, P.ICICI_SUFFIX, "")))
        .otherwise(text)
    )


def first_payload_line(cell: Column) -> Column:
    """First line of a cell that is neither empty nor UPI metadata, else its first line."""
    lines = F.transform(
        F.split(F.regexp_replace(cell, "\r", "\n"), "\n"), lambda line: strip(line)
    )
    payload = F.filter(lines, lambda line: (line != "") & ~line.rlike(P.UPI_META))
    return F.coalesce(F.get(payload, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))


def clean_account(text: Column) -> Column:
    """Account name without a masked number suffix."""
    stripped = F.regexp_replace(strip(text), r"\s*[-–]\s*\d+\s*$", "")
    return F.coalesce(strip(F.substring_index(stripped, "\n", 1)), F.lit(""))


def split_camel(name: Column) -> Column:
    """``AdityaArunRao`` -> ``Aditya Arun Rao``; all-capital names stay."""
    spaced = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    spaced = strip(F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2"))
    has_lower = name != F.upper(name)
    has_letter = F.upper(name) != F.lower(name)
    return F.when(has_letter & ~has_lower, name).otherwise(spaced)


def repair_name(name: Column, is_credit: Column) -> Column:
    """Readable payee name: senders are split by case, payees repaired or title-cased."""
    all_caps = name.rlike(r"^\p{Lu}[\p{Lu} ]*$") & ~name.rlike(r"^ *$")
    payee = F.coalesce(
        lookup(K.NAME_REPAIRS, F.upper(name)),
        F.when(all_caps, title_case(name)).otherwise(split_camel(name)),
    )
    return F.when(is_credit, split_camel(name)).otherwise(payee)


def infer_account(text: Column) -> Column:
    """Account named in a statement line, null when none is."""
    return (
        F.when(text.rlike(r"(?i)State\s+Bank"), "State Bank Of India")
        .when(text.rlike(r"(?i)ICICI\s+Bank"), "ICICI Bank")
        .when(text.rlike(r"(?i)UPI\s+Lite"), "UPI Lite")
        .when(text.rlike(r"(?i)Gold\s+Coin"), "Gold Coins")
    )


def recurring_key(text: Column) -> Column:
    """Grouping key of a payee: at most three significant words."""
    out = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9\s]", " ")
    out = strip(F.regexp_replace(out, K.RECURRING_NOISE, " "))
    words = F.filter(F.split(out, r"\s+"), lambda w: F.length(w) > 1)
    return F.array_join(F.slice(words, 1, 3), " ")


def bigrams(text: Column) -> Column:
    """Distinct two-character substrings; a shorter text is its own only member."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))
    )
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array(text))


def is_refund(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(P.REFUND)


def is_noise_row(text: Column) -> Column:
    return strip(text).rlike(P.SKIP_ROW)


def is_self_transfer(text: Column) -> Column:
    return text.rlike(P.SELF_TRANSFER)


def find_column(headers: Column, candidates: list[str]) -> Column:
    """0-based index of the first exactly matching header, else of the first containing one, else -1."""
    exact = F.transform(headers, lambda h: h.isin(candidates))
    partial = F.transform(
        headers, lambda h: F.exists(F.lit(candidates), lambda c: F.contains(h, c))
    )
    hit = F.when(F.array_position(exact, True) > 0, F.array_position(exact, True)).otherwise(
        F.array_position(partial, True)
    )
    return F.coalesce(hit - 1, F.lit(-1)).cast("int")
