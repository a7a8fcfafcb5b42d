"""Bucketed windows against plain loops, with buckets far smaller than a statement."""

import random

import pytest
from pyspark.sql import functions as F

from munim.operators.ordered import carry_forward, first_per_key, following, line_bucket, running_total


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for s in range(4):
        numbers = sorted(rng.sample(range(0, 120), 40 if s else 1))
        rows += [(s, n, rng.choice([None, rng.randint(-5, 5)])) for n in numbers]
    return rows, spark.createDataFrame(rows, "statement_id BIGINT, line_no BIGINT, v BIGINT").repartition(3)


def by_statement(rows):
    out = {}
    for s, n, v in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(s, []).append((n, v))
    return out


@pytest.mark.parametrize("span", [1, 3, 10, 1000])
def test_running_total(data, span):
    rows, df = data
    out = running_total(df, ["statement_id"], ["line_no"], [line_bucket(span)],
                        {"t": F.coalesce("v", F.lit(0))})
    got = {(r.statement_id, r.line_no): r.t for r in out.collect()}
    for s, seq in by_statement(rows).items():
        acc = 0
        for n, v in seq:
            acc += v or 0
            assert got[s, n] == acc


@pytest.mark.parametrize("span", [1, 3, 10, 1000])
@pytest.mark.parametrize("current", [True, False])
def test_carry_forward(data, span, current):
    rows, df = data
    out = carry_forward(df, ["statement_id"], ["line_no"], [line_bucket(span)], F.col("v"), "last",
                        include_current=current)
    got = {(r.statement_id, r.line_no): r["last"] for r in out.collect()}
    for s, seq in by_statement(rows).items():
        last = None
        for n, v in seq:
            if current:
                last = v if v is not None else last
                assert got[s, n] == last
            else:
                assert got[s, n] == last
                last = v if v is not None else last


@pytest.mark.parametrize("span", [1, 2, 7, 1000])
def test_following(data, span):
    rows, df = data
    out = following(df, ["statement_id"], ["line_no"], [line_bucket(span)], F.col("line_no"),
                    ["a", "b", "c"])
    got = {(r.statement_id, r.line_no): (r.a, r.b, r.c) for r in out.collect()}
    assert len(got) == len(rows)
    for s, seq in by_statement(rows).items():
        numbers = [n for n, _ in seq] + [None] * 3
        for i, (n, _) in enumerate(seq):
            assert got[s, n] == tuple(numbers[i + 1:i + 4])


def test_first_per_key_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, 3, "a"), (1, 1, "a"), (1, 2, "b"), (2, 9, "a")], "statement_id INT, line_no INT, d STRING")
    once = first_per_key(df, ["statement_id", "d"], ["line_no"])
    twice = first_per_key(once, ["statement_id", "d"], ["line_no"])
    expected = [(1, 1, "a"), (1, 2, "b"), (2, 9, "a")]
    assert sorted(tuple(r) for r in once.collect()) == expected
    assert sorted(tuple(r) for r in twice.collect()) == expected
