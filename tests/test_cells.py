"""Parsing of single cells: edge cases of amounts, dates, texts."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from munim.functions import amounts as A, dates as D, money as M, text as T


def values(spark, fn, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i INT, c STRING")
    return [r.v for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "1,23,456": 123456.0, "1,23,456.78": 123456.78, "₹1,23,456": 123456.0, "Rs. 500": 500.0,
        "INR 5 Dr": 5.0, "500.00 CR": 500.0, "(250.50)": -250.5, "250-": -250.0, "": None, "-": None,
        "NIL": None, "0.00": None, "nan": None, "inf": None, "1_000": None, "abc": None, None: None,
        " 1 000.5 Cr. ": 1000.5, "--5": None,
    }
    assert values(spark, A.parse_amount, list(cases)) == list(cases.values())


def test_signed_amounts(spark):
    cases = {
        "+ Rs.8,000": 8000.0, "-INR2,000": -2000.0, "8,000.00 Cr": 8000.0, "553 Dr": -553.0,
        "Rs.8,000": -8000.0, "553": None, "n/a": None, "—": None,
    }
    assert values(spark, A.parse_amount_signed, list(cases)) == list(cases.values())
    anchored = {"(₹553)": -553.0, "553": -553.0, "-553": -553.0, "553 CR.": 553.0, "paid 553": None}
    assert values(spark, A.parse_amount_anchored, list(anchored)) == list(anchored.values())
    plain = {"₹ 553 Cr": 553.0, "x": 0.0, None: 0.0, "-5": 5.0}
    assert values(spark, A.parse_amount_plain, list(plain)) == list(plain.values())
    free = {"+1,234.56": 1234.56, "-₹500": -500.0, "12 CR": 12.0, "12 DR": -12.0, "Rs 7": -7.0}
    assert values(spark, A.parse_amount_free, list(free)) == list(free.values())


@pytest.mark.parametrize("text", [
    "15-06-2025", "15/06/2025", "2025-06-15", "15-Jun-2025", "15/JUN/2025", "15-06-25", "15/06/25",
    "2025/06/15", "15 Jun 2025", "15 June 2025", "15-June-2025", "06/15/2025", "2025-06-15 10:30:00",
])
def test_date_layouts(spark, text):
    assert values(spark, D.parse_date, [text]) == [dt.date(2025, 6, 15)]


def test_bad_dates(spark):
    assert values(spark, D.parse_date, ["31-02-2024", "soon", "", None, "0"]) == [None] * 5
    assert values(spark, D.parse_date, ["12/12/99"]) == [dt.date(1999, 12, 12)]


def test_timestamps(spark):
    got = values(spark, D.parse_timestamp, [
        "Mon, 22 Mar 2024  11:39 PM", "Jan 15, 2024", "15.01.24", "5 Jan '24", "March 3, 2024", "x"])
    assert got == [
        dt.datetime(2024, 3, 22, 23, 39), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 15),
        dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 3), None]


def test_merchant_names(spark):
    cases = {
        "AMAZON #12345": "Amazon", "SWIGGY 987654321": "Swiggy", "UPI/1234567890": "Upi",
        "MCDONALD'S POS": "Mcdonald'S Pos", "  ": "", None: "", "Shop 24": "Shop 24",
    }
    assert values(spark, T.normalize_merchant, list(cases)) == list(cases.values())


def test_recurring_key(spark):
    cases = {"UPI payment to Netflix India Pvt Ltd": "netflix", "a b": "", "One two three four": "one two three"}
    assert values(spark, T.recurring_key, list(cases)) == list(cases.values())


def test_money_texts(spark):
    df = spark.createDataFrame([(123456789.5,), (-1234.0,), (999.0,), (0.0,)], "x DOUBLE")
    got = [tuple(r) for r in df.select(
        M.format_inr(F.col("x")), M.format_inr_paise(F.col("x")), M.format_inr_compact(F.col("x"))).collect()]
    assert got == [
        ("₹12,34,56,789", "₹12,34,56,789.50", "Rs.12.3Cr"), ("-₹1,234", "-₹1,234.00", "Rs.1,234"),
        ("₹999", "₹999.00", "Rs.999"), ("₹0", "₹0.00", "Rs.0")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**11), min_size=1, max_size=30))
def test_amount_round_trip(spark, paise):
    df = spark.createDataFrame([(i, p / 100.0) for i, p in enumerate(paise)], "i INT, x DOUBLE")
    back = df.select("i", "x", A.parse_amount(M.format_inr_paise(F.col("x"))).alias("y")).collect()
    for r in back:
        # "0.00" with a currency mark is a number, not a null token.
        assert r.y == pytest.approx(r.x, abs=1e-9)
