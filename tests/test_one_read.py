"""Queries that read their view several times work it out once; ordered helpers merge their summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from munim.operators import ordered as O, statement_text as TX
from munim.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", [
    "rows_subrow_merge", "rows_typed", "scan_csv_dynamic", "sheet_scan", "universal_lines", "wallet_lines",
    "strip_pages", "post_process", "anomaly_reason", "standardize", "context_block", "forecast_arma"])
def test_view_is_worked_out_once(spark, name):
    """The joins of the view are not in the plan of the result."""
    assert "l_orderkey" not in plan(QUERIES[name](spark, SF_DIR))


def test_lines_of_files_are_stored(spark):
    """The lines read back are worked out once; no branch goes back to the raw lines."""
    assert "LogicalRDD" not in plan(QUERIES["load_files"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["parse_documents", "parse_fallback"])
def test_remains_of_documents_are_stored(spark, name):
    """What earlier stages leave over is filtered once, not in every branch that reads it."""
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "LeftAnti" not in text and "LogicalRDD" not in text


def generated(spark):
    """Few rows that become many: Spark expects no more than the few."""
    return spark.range(40).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n"))


@pytest.mark.parametrize("helper", ["running_total", "carry_forward", "following"])
def test_summaries_are_not_broadcast(spark, helper):
    rows, args = generated(spark), (["k"], ["n"], [F.col("n")])
    out = {
        "running_total": lambda: O.running_total(rows, *args, {"x": F.col("n")}),
        "carry_forward": lambda: O.carry_forward(rows, *args, F.when(F.col("n") % 7 == 0, F.col("n")), "x"),
        "following": lambda: O.following(rows, *args, F.col("n"), ["x"]),
    }[helper]()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {"running_total": lambda n: n * (n + 1) // 2, "carry_forward": lambda n: n - n % 7,
            "following": lambda n: n + 1 if n < 49 else None}[helper]
    got = out.collect()
    assert len(got) == 2000 and all(r.x == want(r.n) for r in got)


def test_following_keeps_no_more_than_it_needs(spark):
    rows = generated(spark)
    depth = O.following(rows, ["k"], ["n"], [F.col("n") % 50], F.col("n"), ["a", "b", "c"])
    assert "slice(flatten" in plan(depth)
    assert all([r.a, r.b, r.c] == [n if n < 50 else None for n in range(r.n + 1, r.n + 4)] for r in depth.collect())


def test_year_of_month(spark):
    """Against the months of the period counted one by one."""
    days = [dt.date(2000, 3, 1), dt.date(2000, 12, 31), dt.date(2001, 2, 28), dt.date(2002, 8, 1), dt.date(2000, 1, 30), None]
    rows = [(a, b, m) for a in days for b in days for m in (*range(0, 14), None) if not (a and b and a > b)]
    df = spark.createDataFrame(rows, "a date, b date, m int")
    each = F.transform(F.filter(F.sequence("a", "b", F.expr("interval 1 month")), lambda d: F.month(d) == F.col("m")), F.year)
    out = df.select(TX.year_of_month(F.col("m"), F.col("a"), F.col("b")).alias("got"),
                    F.coalesce(F.array_max(each), F.year("a")).alias("want"))
    assert all(r.got == r.want for r in out.collect())
    assert "sequence(" not in plan(out.select("got"))


def test_period_dates(spark):
    texts = [("1 MAR'00 - 28 FEB'01", dt.date(2000, 3, 1), dt.date(2001, 2, 1)),
             ("28 FEB'01 - 1 MAR'00", dt.date(2000, 3, 1), dt.date(2001, 2, 1)), ("1 MAR'00", None, None), (None, None, None)]
    df = spark.createDataFrame(texts, "t string, a date, b date").withColumn("p", TX.period_dates(F.col("t")))
    assert all((r.p and (r.p.start, r.p.end) or (None, None)) == (r.a, r.b) for r in df.collect())
    once = df.select("p")
    assert plan(once).count("regexp_extract_all") == 2
