"""Years of a statement's head, and what the block parser works out once."""

from pyspark.sql import functions as F

from munim.operators import statement_text as TX
from munim.plans.catalog import QUERIES


def test_years_are_those_of_the_joined_head(spark):
    texts = {
        1: ["Passbook 2000", "to 2003", "x20019", "2001-05"],
        2: ["", " ", "no year"],
        3: ["a" * 20, "2004 and 20055", "2009"],  # cut in the second line and before the third
        4: ["b" * 26, "20111"],  # the cut leaves 2011
        5: ["c" * 27, "2012"],  # the cut leaves 201
        6: [None, "2013"],
    }
    lines = spark.createDataFrame(
        [(k, n, t) for k, ts in texts.items() for n, t in enumerate(ts)], "statement_id long, line_no long, line string")
    years = F.transform(F.regexp_extract_all("head", F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    for chars in (5, 13, 31, 3000):
        first, last = F.array_min(years), F.array_max(years)
        plain = TX.head_text(lines, chars).select(
            "statement_id", first.alias("_first_year"), F.when(last > first, last).alias("_last_year"))
        found = TX.statement_years(lines, chars)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())), chars


def test_lines_are_not_shuffled_as_text_for_years(spark):
    lines = spark.createDataFrame([(1, 0, "Passbook 2000")], "statement_id long, line_no long, line string")
    plan = TX.statement_years(lines)._jdf.queryExecution().executedPlan().toString()
    assert "head" not in plan and "collect_list" not in plan


def test_dated_rows_are_worked_out_once(spark):
    """Amounts are cut out of the text before the years are told, not in every branch that does so."""
    plan = QUERIES["wallet_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert r"([+\-])" not in plan
