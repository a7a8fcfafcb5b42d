"""The stored monthly roll-up, reports from it, and the forecast with a moving-average term."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from munim.operators import aggregates as A, forecast as FC, rollup as RU

SCHEMA = ("statement_id long, date date, category string, transaction_type string, debit double, "
          "credit double, amount double")


def rows(seed, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        debit = rng.random() < 0.8
        value = float(rng.integers(1, 10**6)) / 100
        out.append((int(rng.integers(0, 5)), dt.date(2023 + int(rng.integers(0, 2)), int(rng.integers(1, 13)), 5),
                    [None, "Food", "Rent"][int(rng.integers(0, 3))], "debit" if debit else "credit",
                    value if debit else 0.0, 0.0 if debit else value, value))
    return out + [(1, None, None, "debit", None, None, None), (None, None, "Food", "credit", 0.0, 1.5, 1.5)]


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_add_up(spark, tmp_path):
    path = str(tmp_path / "rollup")
    parts = [spark.createDataFrame(rows(k), SCHEMA) for k in range(3)]
    RU.add_batch(parts[2], path, "b")
    for k, part in enumerate(parts):
        RU.add_batch(part, path, "abc"[k])  # "b" first held other rows
    RU.add_batch(parts[0], path, "a")  # written again
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    stored = RU.read_rollup(spark, path)
    want = RU.month_rollup(whole)
    assert table(stored.select(*want.columns)) == table(want)
    recent = RU.read_rollup(spark, path, since="2024-03-01")
    assert table(recent.select(*want.columns)) == table(want.where("month >= '2024-03-01'"))
    assert "PartitionFilters: [isnotnull(month" in recent._jdf.queryExecution().toString()
    budgets = A.category_monthly_avg(whole).select("statement_id", "category", F.lit(50).alias("budget"))
    assert table(A.budgets_of(stored, budgets)) == table(A.budget_vs_actual(whole, budgets))
    assert table(A.mom_totals(stored).where("direction = 'credit'").drop("direction")) == table(A.mom_total(whole, "credit"))
    assert table(FC.forecast_of(stored)) == table(FC.forecast(whole))


def test_empty_rollup(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert RU.month_rollup(empty).count() == 0
    assert A.mom_totals(RU.month_rollup(empty)).count() == FC.forecast(empty, method="arma").count() == 0


def arma(y):
    """Two regressions of ``FC.arma_forecast`` by NumPy; (predicted, half width) in paise."""
    d = np.diff(np.asarray(y, dtype=float))
    first = np.linalg.lstsq(np.stack([d[1:-1], d[:-2]], axis=1), d[2:], rcond=None)[0]
    e = np.floor(d[2:] - np.stack([d[1:-1], d[:-2]], axis=1) @ first + 0.5)
    x, target = np.stack([d[2:-1], e[:-1]], axis=1), d[3:]
    w = np.clip(np.linalg.lstsq(x, target, rcond=None)[0], -0.99, 0.99)
    sse = ((target - x @ w) ** 2).sum()
    return y[-1] + w[0] * d[-1] + w[1] * e[-1], 1.96 * np.sqrt(sse / len(target))


@pytest.mark.parametrize("months", [8, 24, 90])
def test_arma_equals_numpy(spark, months):
    rng = np.random.default_rng(months)
    series = {k: np.maximum(rng.normal(50_000, 9_000, months).cumsum() * (k % 2) + rng.integers(1, 10**6, months), 1)
              .astype(int) for k in range(6)}
    df = spark.createDataFrame(
        [(k, "c", dt.date(2010 + m // 12, m % 12 + 1, 1), float(v) / 100)
         for k, y in series.items() for m, v in enumerate(y)],
        "statement_id long, category string, ds date, y double")
    got = {r.statement_id: r for r in FC.arma_forecast(df).collect()}
    for k, y in series.items():
        at, half = arma(y)
        assert got[k].predicted_amount == pytest.approx(max(at, 0) / 100, abs=0.011)
        assert got[k].upper_bound == pytest.approx(max(at + half, 0) / 100, abs=0.011)
    assert FC.arma_forecast(df.where("ds < '2010-08-01'")).count() == 0


def test_arma_of_flat_and_short_histories(spark):
    rows_ = [(s, dt.date(2020 + m // 12, m % 12 + 1, 3), "c", "debit", 10.0, 0.0, 10.0)
             for s, n in ((1, 12), (2, 5), (3, 1)) for m in range(n)]
    got = {r.statement_id: r for r in FC.forecast(spark.createDataFrame(rows_, SCHEMA), method="arma").collect()}
    assert [got[s].method for s in (1, 2, 3)] == ["arma", "ar1", "simple_average"]
    assert got[1].predicted_amount == got[2].predicted_amount == 10.0 and got[1].lower_bound == 10.0
