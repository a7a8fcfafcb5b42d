"""Layered rule classification as one narrow projection.

Layers, first hit wins: credit, blank, refund, merchant name, merchant in the UPI
payee, person name, person in the UPI payee, keyword, keyword in the UPI payee,
amount, nothing.  There is no shuffle and no Python worker; each layer is only
evaluated for rows that the layers before it left open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from munim.functions.binding import let, once
from munim.functions.blank import strip
from munim.functions.text import is_refund
from munim.rules.keywords import KEYWORDS
from munim.rules.merchants import WHOLE_WORD_MERCHANTS, builtin_merchants
from munim.rules.patterns import UPI_PAYEE
from munim.rules.tokens import BUSINESS_WORDS, HONORIFICS
from munim.schema import CLASSIFICATION_FIELDS, ContractError

#: Leading characters of a keyword that a merchant table is joined on.
HEAD = 8
#: Bits of the largest field that tells where a keyword may begin (8 MB); 16 a keyword up to that.
MOST_BITS = 1 << 26


class Merchant(NamedTuple):
    keyword: str
    category: str
    subcategory: str


def default_merchants() -> list[Merchant]:
    """The built-in table; it is small and becomes a literal of the plan."""
    return [Merchant(*m) for m in builtin_merchants()]


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """Merchant table of any size from CSV files with columns keyword, category, subcategory."""
    return spark.read.csv(
        path, header=True, schema="keyword STRING, category STRING, subcategory STRING")


def head_bits(heads: DataFrame, bits: int) -> Column:
    """Bit field of the texts in ``_head`` as one array of 64-bit words: ``bits / 8`` bytes."""
    places = heads.select(F.explode(F.array(*_bits_of(F.col("_head"), bits))).alias("_bit")).distinct()
    words = places.select(
        F.floor(F.col("_bit") / 64).cast("long").alias("_word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int")).alias("_value"))
    blank = heads.sparkSession.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_value"))
    full = words.unionByName(blank).groupBy("_word").agg(F.bit_or("_value").alias("_value"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_value"))),
                                lambda x: x["_value"]).alias("words")).scalar()


def _bits_of(head: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), head), F.lit(bits)) for seed in (1, 2)]


def merchant_spots(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """Places (_at) of ``_low`` where a keyword may begin, with its leading characters (_head).

    Candidates are tested against a bit field in the stage that makes them, so that only keywords'
    places and a few others go on.
    """
    known = heads.agg(F.count("*").alias("n"), F.collect_set(F.length("_head")).alias("sizes")).first()
    sizes = F.array(*[F.lit(n) for n in sorted(known["sizes"])]).cast("array<int>")  # at most HEAD
    bits = min(MOST_BITS, 1 << max(12, (16 * known["n"]).bit_length()))
    words = head_bits(heads, bits)
    spots = texts.select("_low", F.explode(F.sequence(F.lit(1), F.length("_low"))).alias("_at")).withColumn(
        "_n", F.explode(sizes)).where(F.col("_n") <= F.length("_low") - F.col("_at") + 1)
    out = spots.select("_low", "_at", F.substring(F.col("_low"), F.col("_at"), F.col("_n")).alias("_head"))
    for bit in _bits_of(F.col("_head"), bits):
        out = out.where(F.getbit(F.get(words, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1)
    return out


def with_merchants(df: DataFrame, text: str, merchants: DataFrame, name: str) -> DataFrame:
    """Add ``name``: struct(category, subcategory) of the merchant that column ``text`` names.

    The leftmost, then longest keyword wins, like in ``merchant_lookup``, but the table may be of
    any size.  Each distinct text meets the keywords by their leading ``HEAD`` characters (whole
    ones that are shorter), at the few places that a bit field of these lets through; hits are
    confirmed in full.  A keyword listed twice keeps the least category and subcategory.
    """
    key = F.lower(strip("keyword"))
    table = merchants.select(key.alias("_key"), F.struct("category", "subcategory").alias("_of")).where(
        F.coalesce(F.col("_key"), F.lit("")) != "").groupBy("_key").agg(F.min("_of").alias("_of"))
    short = (F.length("_key") <= 3) & F.col("_key").rlike(r"^\p{L}+$")
    table = table.select("_key", "_of", F.left("_key", F.lit(HEAD)).alias("_head"),
                         (short | F.col("_key").isin(WHOLE_WORD_MERCHANTS)).alias("_whole"))
    texts = df.select(F.lower(F.col(text)).alias("_low")).where(F.length("_low") > 0).distinct()
    heads = merchant_spots(texts, table.select("_head").distinct())
    end = F.col("_at") + F.length("_key")
    word = lambda at: F.coalesce(F.substring(F.col("_low"), at, F.lit(1)).rlike(r"^\w"), F.lit(False))
    before = (F.col("_at") > 1) & word(F.col("_at") - 1)
    hits = heads.join(table, "_head").where(
        (F.substring(F.col("_low"), F.col("_at"), F.length("_key")) == F.col("_key"))
        & (~F.col("_whole") | (~before & ~word(end))))
    best = hits.groupBy("_low").agg(
        F.min_by("_of", F.struct("_at", -F.length("_key"))).alias(name))
    return df.withColumn("_low", F.lower(F.col(text))).join(best, "_low", "left").drop("_low")


def any_of(words: Sequence[str]) -> str:
    """Regular expression for the longest of ``words`` at a position.

    Common beginnings are factored out, so a position is rejected after one or two
    characters instead of being tried against every word.
    """
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    branches = [
        re.sub(r"([^\w\s])", r"\\\1", head) + (any_of(tails) if tails != [""] else "")
        for head, tails in heads.items() if head
    ]
    if not branches:
        return ""
    body = "(?:" + "|".join(branches) + ")"
    return body + "?" if "" in heads else body


def merchant_pattern(merchants: Sequence[Merchant]) -> str:
    """Pattern that finds the leftmost, then longest, merchant name in a lower-case text."""
    keys = {m.keyword for m in merchants}
    whole = {k for k in keys if (len(k) <= 3 and k.isalpha()) or k in WHOLE_WORD_MERCHANTS}
    parts = [any_of(keys - whole)] if keys - whole else []
    if whole:
        parts.append(rf"\b{any_of(whole)}\b")
    return "(" + "|".join(parts) + ")"


def merchant_lookup(text: Column, merchants: Sequence[Merchant] | None = None) -> Column:
    """struct(category, subcategory) of the merchant named in a text, else null."""
    rules = list(merchants) if merchants is not None else default_merchants()
    # One literal that is folded into a constant, rather than hundreds of expressions.
    entries = {m.keyword: {"category": m.category, "subcategory": m.subcategory} for m in rules}
    table = F.from_json(F.lit(json.dumps(entries)),
                        "map<string, struct<category: string, subcategory: string>>")
    return F.try_element_at(table, F.regexp_extract(F.lower(text), merchant_pattern(rules), 1))


def upi_payee(text: Column) -> Column:
    """Payee name inside a UPI reference, else null."""
    name = strip(F.regexp_extract(text, UPI_PAYEE, 1))
    return let(name, lambda n: F.when((F.length(n) >= 3) & ~n.rlike(r"^\d+$"), n))


def person_rule(text: Column) -> Column:
    """Which person rule a text meets, else null.

    ``3`` honorific and name, ``2`` name@provider, ``1`` two to four plain words;
    none of them with a business word.
    """
    business = F.lit(BUSINESS_WORDS)

    def rule(t: Column) -> Column:
        words = F.split(F.lower(t), r"\s+")
        bare = F.transform(words, lambda w: F.regexp_replace(w, r"[.,]+$", ""))
        titled = F.get(words, F.lit(0)).rlike("^(" + "|".join(HONORIFICS) + r")\.*$")
        handle = F.split(strip(F.substring_index(F.lower(t), "@", 1)), r"[\s_\-]+")
        return F.when(F.length(t) <= 80, F.when(
            titled & (F.size(words) >= 2)
            & ~F.arrays_overlap(F.slice(bare, F.lit(2), F.size(bare)), business), "3")
            .when(t.rlike(r"^[a-zA-Z]+([\s_\-]+[a-zA-Z]+){1,3}\s*@")
                  & ~F.arrays_overlap(handle, business), "2")
            .when(t.rlike(r"^[a-zA-Z]{2,15}(\s+[a-zA-Z]{2,15}){1,3}$")
                  & ~F.arrays_overlap(bare, business), "1"))

    return let(strip(text), rule)


def _ranked_keywords() -> list[tuple[str, str, str]]:
    return sorted(KEYWORDS, key=lambda k: -len(k[0]))


def keyword_rank(text: Column) -> Column:
    """1-based rank of the longest keyword phrase in a text, else null.

    One pass with a look-ahead finds the longest phrase at every word start, so
    overlapping phrases are all seen; the best rank among the hits wins.
    """
    phrases = [k[0] for k in _ranked_keywords()]
    hits = F.regexp_extract_all(
        F.lower(text), F.lit(rf"\b(?=({any_of(phrases)})\b)"), F.lit(1)
    )
    return F.array_min(F.transform(hits, lambda h: F.array_position(F.lit(phrases), h)))


def keyword_lookup(rank: Column) -> Column:
    """struct(category, subcategory) of a keyword rank, else null."""
    entries = [
        F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory"))
        for _, cat, sub in _ranked_keywords()
    ]
    return F.get(F.array(*entries), (rank - 1).cast("int"))


def _result(category, subcategory, confidence: float, match: str, notes) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = [category, subcategory, confidence, match, notes]
    return F.struct(*[lit(v).alias(n) for v, n in zip(values, CLASSIFICATION_FIELDS)])


def _column(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name), None)


def classify(
    df: DataFrame, merchants: Sequence[Merchant] | DataFrame | None = None,
    amount: str | None = "debit",
) -> DataFrame:
    """Add category, subcategory, confidence, match_confidence and match_notes.

    ``merchants`` replaces the built-in merchant table: a short list becomes part of the plan, a
    DataFrame of any size (keyword, category, subcategory) is joined.

    Needs a ``description`` column (any case); ``transaction_type`` and ``amount``
    are used when present.  Works on batch and streaming frames alike.
    """
    desc = _column(df, "description")
    if desc is None:
        raise ContractError(f"no 'description' column in {df.columns}")
    kind, size = _column(df, "transaction_type"), amount and _column(df, amount)
    credit = (F.lower(F.col(kind)) == "credit") if kind else F.lit(False)
    value = F.col(size).cast("double") if size else F.lit(None).cast("double")
    text, upi = F.col("_text"), F.col("_upi")

    staged = df.withColumn("_text", strip(F.coalesce(F.col(desc), F.lit(""))))
    staged = staged.withColumn("_refund", is_refund(text))
    open_ = ~F.coalesce(credit, F.lit(False)) & (text != "") & ~F.col("_refund")
    staged = staged.withColumn("_upi", F.when(open_, upi_payee(text)))
    no_m1 = open_ & F.col("_m1").isNull()
    if isinstance(merchants, DataFrame):
        staged = staged.withColumn("_t1", F.when(open_, text))
        staged = with_merchants(staged, "_t1", merchants, "_m1")
        staged = staged.withColumn("_t2", F.when(no_m1, upi))
        staged = with_merchants(staged, "_t2", merchants, "_m2").drop("_t1", "_t2")
    else:
        staged = staged.withColumn("_m1", F.when(open_, merchant_lookup(text, merchants)))
        staged = staged.withColumn(
            "_m2", F.when(no_m1 & upi.isNotNull(), merchant_lookup(upi, merchants)))
    no_m2 = no_m1 & F.col("_m2").isNull()
    staged = staged.withColumn("_p1", F.when(no_m2, person_rule(text)))
    no_p1 = no_m2 & F.col("_p1").isNull()
    staged = staged.withColumn("_p2", F.when(no_p1 & upi.isNotNull(), person_rule(upi)))
    no_p2 = no_p1 & F.col("_p2").isNull()
    staged = staged.withColumn("_k1", F.when(no_p2, keyword_rank(text)))
    no_k1 = no_p2 & F.col("_k1").isNull()
    staged = staged.withColumn("_k2", F.when(no_k1 & upi.isNotNull(), keyword_rank(upi)))

    notes = lambda m: (
        F.when(F.col(f"{m}.subcategory") == "Rent", "possible_rent")
        .when(F.col(f"{m}.category") == "Loan and EMI", "possible_loan").otherwise("")
    )
    split = F.when((value != 0) & (value <= 2000), ",possible_split").otherwise("")
    k1, k2 = keyword_lookup(F.col("_k1")), keyword_lookup(F.col("_k2"))
    income, unmatched = "Income and Salary", ("Uncategorized", "Unmatched", 0.0, "unmatched", "")
    refund = _result(income, "Refund", 1.0, "global_override", "refund_reversal_cashback")
    out = (
        F.when(credit, F.when(F.col("_refund"), refund)
               .otherwise(_result(income, "Salary", 1.0, "credit_type", "")))
        .when(text == "", _result(*unmatched))
        .when(F.col("_refund"), refund)
        .when(F.col("_m1").isNotNull(), _result(
            F.col("_m1.category"), F.col("_m1.subcategory"), 1.0, "exact_merchant", notes("_m1")))
        .when(F.col("_m2").isNotNull(), _result(
            F.col("_m2.category"), F.col("_m2.subcategory"), 0.95, "upi_parsed",
            F.concat(F.lit("upi_extracted;"), notes("_m2"))))
        .when(F.col("_p1").isNotNull(), _result(
            "Personal Transfer", "Peer Transfer", 0.85, "person_name_detected",
            F.concat(F.lit("personal_transfer"), split, F.lit(";condition="), F.col("_p1"))))
        .when(F.col("_p2").isNotNull(), _result(
            "Personal Transfer", "Peer Transfer", 0.80, "person_name_detected",
            F.concat(F.lit("personal_transfer;upi_name;condition="), F.col("_p2"))))
        .when(F.col("_k1").isNotNull(), _result(
            k1["category"], k1["subcategory"], 0.8, "keyword",
            F.when(k1["subcategory"] == "Rent", "possible_rent").otherwise("")))
        .when(F.col("_k2").isNotNull(), _result(
            k2["category"], k2["subcategory"], 0.70, "upi_parsed", "upi_keyword"))
        .when(value >= 50_000, _result(
            "Investment and Savings", "Large Transfer", 0.40, "heuristic", "large_amount"))
        .when(value >= 10_000, _result(
            "Transfer and Banking", "Bank Transfer", 0.35, "heuristic", "medium_amount"))
        .otherwise(_result(*unmatched))
    )
    kept = [c for c in df.columns if c not in CLASSIFICATION_FIELDS]
    return once(staged, out, keep=kept)


def person_condition_counts(classified: DataFrame) -> DataFrame:
    """How often each person rule decided."""
    rule = F.regexp_extract("match_notes", r"condition=(\d)", 1)
    persons = classified.where(F.col("match_confidence") == "person_name_detected")
    return persons.groupBy(
        F.when(rule.isin("1", "2", "3"), rule).otherwise("other").alias("condition")
    ).agg(F.count(F.lit(1)).alias("n"))


def near_miss_business(classified: DataFrame) -> DataFrame:
    """Names that look like a person but for a business word."""
    text = strip("description")
    words = F.transform(
        F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[.,]+$", "")
    )
    return classified.where(
        text.rlike(r"^[a-zA-Z]+(\s+[a-zA-Z]+){1,3}$")
        & F.arrays_overlap(words, F.lit(BUSINESS_WORDS))
        & (F.col("category") != "Personal Transfer")
    )


def personal_transfers(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("category") == "Personal Transfer")


def uncategorized(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("category") == "Uncategorized")
