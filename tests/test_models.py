"""Classification precedence, forest, repeats, similarity, forecasts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from munim.operators import anomaly as AN, classify as K, forecast as FC, forest as FO, recurring as R


def classified(spark, rows, merchants=None):
    df = spark.createDataFrame(
        [(i, d, a, t) for i, (d, a, t) in enumerate(rows)],
        "i INT, description STRING, debit DOUBLE, transaction_type STRING")
    return K.classify(df, merchants).orderBy("i").collect()


def test_cascade(spark):
    cases = {
        ("Swiggy order #12345", 1.0, "debit"): ("Food Delivery", 1.0, "exact_merchant"),
        ("", 1.0, "debit"): ("Unmatched", 0.0, "unmatched"),
        ("Swiggy refund", 1.0, "debit"): ("Refund", 1.0, "global_override"),
        ("Swiggy", 1.0, "credit"): ("Salary", 1.0, "credit_type"),
        ("cash back", 1.0, "credit"): ("Refund", 1.0, "global_override"),
        ("Anil Kumar", 1500.0, "debit"): ("Peer Transfer", 0.85, "person_name_detected"),
        ("UPI/12/RAMESH KUMAR/99", 1.0, "debit"): ("Peer Transfer", 0.80, "person_name_detected"),
        ("Sharma Kirana Store", 60000.0, "debit"): ("Large Transfer", 0.40, "heuristic"),
        ("XQ1", 10000.0, "debit"): ("Bank Transfer", 0.35, "heuristic"),
        ("XQ1", 9999.0, "debit"): ("Unmatched", 0.0, "unmatched"),
        ("my car loan and hostel rent!", 1.0, "debit"): ("Car Loan", 1.0, "exact_merchant"),
        ("paid hostel rent for 2024", 1.0, "debit"): ("Hotels", 0.8, "keyword"),
        ("colas", 5.0, "debit"): ("Unmatched", 0.0, "unmatched"),
    }
    got = [(r.subcategory, r.confidence, r.match_confidence) for r in classified(spark, list(cases))]
    assert got == list(cases.values())


def test_leftmost_then_longest_merchant(spark):
    rules = [K.Merchant("zz", "A", "short"), K.Merchant("zz top", "A", "long"),
             K.Merchant("aaaaaaaa", "B", "later")]
    got = classified(spark, [("the zz top aaaaaaaa", 1.0, "debit"), ("fizz buzz 1", 1.0, "debit")], rules)
    assert [r.subcategory for r in got] == ["long", "Unmatched"]


def test_longest_keyword_wins_over_leftmost(spark):
    got = classified(spark, [("rent 99 for mutual fund sips 7", 1.0, "debit")], [K.Merchant("qqq", "A", "a")])
    assert got[0].subcategory == "Mutual Funds"


def test_notes(spark):
    got = classified(spark, [("Mr. Suresh Iyer", 100.0, "debit"), ("SBI HOME LOAN EMI", 1.0, "debit")])
    assert got[0].match_notes == "personal_transfer,possible_split;condition=3"
    assert got[1].match_notes == "possible_loan"


def test_merchant_table_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("keyword,category,subcategory\nCorner Shop,Shopping,Local\n")
    rules = K.read_merchants(spark, str(tmp_path / "m.csv"))
    assert classified(spark, [("CORNER SHOP 5", 1.0, "debit")], rules)[0].subcategory == "Local"


def ledger(spark, n=300, outlier=50000.0):
    rng = random.Random(42)
    start = dt.date(2025, 1, 1)
    rows = [(1, i, start + dt.timedelta(days=i % 90), f"Shop {i % 10}", "Food",
             rng.uniform(200, 800)) for i in range(n)]
    rows.append((1, n, start + dt.timedelta(days=30), "Rare", "Food", outlier))
    df = spark.createDataFrame(
        rows, "statement_id BIGINT, line_no BIGINT, date DATE, description STRING, category STRING, debit DOUBLE")
    return df.withColumns({"amount": F.col("debit"), "transaction_type": F.lit("debit")})


def test_forest_finds_outlier(spark):
    df = ledger(spark)
    fitted, forest = FO.fit(df, trees=100)
    out = FO.predict(df, fitted, forest).select("line_no", "anomaly_score", "is_anomaly").toPandas()
    scores = out.set_index("line_no").anomaly_score
    assert scores[300] == scores.max() and scores[300] > scores.drop(300).mean()
    assert out[out.line_no < 300].is_anomaly.mean() < 0.2
    fitted2, forest2 = FO.fit(df.repartition(7), trees=100)
    assert np.allclose(forest.split, forest2.split) and forest.offset == pytest.approx(forest2.offset)
    fresh = df.limit(1).withColumns({"description": F.lit("New"), "category": F.lit("Other")})
    assert FO.predict(fresh, fitted, forest).count() == 1


def test_exact_percentile(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [1e6]])
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE").repartition(5)
    for q in (0.0, 0.05, 0.5, 0.77, 1.0):
        assert FO.exact_percentile(df, "x", q, bins=16, small=50) == pytest.approx(np.percentile(values, q * 100))


def test_repeat_charges_brute_force(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), i, base + dt.timedelta(hours=rng.randint(0, 24 * 200)),
             rng.choice("ab"), float(rng.choice([100, 200]))) for i in range(120)]
    df = spark.createDataFrame(
        rows, "statement_id BIGINT, line_no BIGINT, ts TIMESTAMP_NTZ, description STRING, amount DOUBLE")
    got = {r.line_no: r.is_dup_charge for r in AN.with_repeat_charge(df, "ts").collect()}
    for s, i, t, d, a in rows:
        near = any(j != i and (s2, d2, a2) == (s, d, a) and abs(t - t2).days <= 7
                   for s2, j, t2, d2, a2 in rows)
        assert got[i] == near


def test_similar_names_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"aa", "aaa"})
    grams = {n: {n[i:i + 2] for i in range(len(n) - 1)} or {n} for n in names}
    want = {(a, b) for a in names for b in names
            if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    assert {(r.name_a, r.name_b) for r in R.similar_pairs(df).collect()} == want
    near = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    best = {n: min(((-near(n, m), m) for m in names if (n, m) in want or (m, n) in want), default=None) for n in names}
    assert {r.name: r.partner for r in R.similar_names(df).collect()} == {n: b[1] for n, b in best.items() if b}


def test_forecast_contract(spark):
    rng = random.Random(42)
    rows = [(1, dt.date(2025, m, 10), c, rng.uniform(1000, 5000)) for m in range(1, 7) for c in ("A", "B")]
    rows += [(1, dt.date(2025, 1, 3), "New", 100.0), (1, dt.date(2025, 1, 9), "New", 300.0)]
    df = spark.createDataFrame(rows, "statement_id BIGINT, date DATE, category STRING, debit DOUBLE").withColumns(
        {"amount": F.col("debit"), "transaction_type": F.lit("debit")})
    for method in ("trend", "ar1"):
        out = {r.category: r for r in FC.forecast(df, method=method).collect()}
        assert set(out) == {"A", "B", "New"}
        for r in out.values():
            assert 0 <= r.lower_bound <= r.predicted_amount <= r.upper_bound
        assert (out["New"].predicted_amount, out["New"].method) == (210.0, "simple_average")
        assert out["New"].historical_avg == 200.0


def test_forecast_line_is_exact(spark):
    rows = [(1, dt.date(2025, m, 1), "A", 100.0 * m) for m in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "statement_id BIGINT, date DATE, category STRING, debit DOUBLE").withColumns(
        {"amount": F.col("debit"), "transaction_type": F.lit("debit")})
    r = FC.forecast(df).first()
    assert (r.predicted_amount, r.lower_bound, r.upper_bound, r.trend) == (500.0, 500.0, 500.0, "increasing")
