"""What queries leave on disk: shuffle files of stored views, text and cells that nothing reads."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from munim.functions import dates as D
from munim.operators import ordered as O, statement_tables as TB, statement_text as TX
from munim.plans import anomaly_queries as Q
from munim.session import setting, stored

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def on_disk(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(".data" in str(blocks.apply(i).getName()) for i in range(blocks.size()))


def test_shuffles_of_stored_views_are_removed(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(20_000).groupBy((F.col("id") % 9_000).alias("k")).agg(F.sum("id").alias("v"))
    before, old = on_disk(spark), spark.conf.get(key, None)
    kept = stored(rows)
    for _ in range(50):
        if on_disk(spark) <= before:
            break
        time.sleep(0.1)
    assert on_disk(spark) <= before
    assert spark.conf.get(key, None) == old
    assert kept.count() == 9_000


def test_setting_is_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    with pytest.raises(ValueError), setting(spark, key, "3"):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == old


# --- metadata rows of wallet tables ----------------------------------------


def table(spark):
    """A long statement, a short one, one without id; rows that only other rows give a meaning."""
    def record(s, n, name):
        return (s, n, ["01-02-2024", name, "n", "acc", "- Rs.5"])
    rows = []
    for k in range(12):
        rows += [record("long", 10 * k, f"m{k}"), ("long", 10 * k + 3, [None, f"UPI Ref {k}", None]),
                 ("long", 10 * k + 4, [None, "nothing", None])]
        if k % 3 == 0:
            rows += [("long", 10 * k + 5, ["Page 3", None, None]), ("long", 10 * k + 6, [None, "UPI Ref lost", None])]
    rows += [record("short", 0, "a"), record("short", 0, "a"), ("short", 1, [None, "Order ID 1", "x", None]),
             ("short", 2, [None, "UPI Ref 2", None]), ("short", 3, ["no date", "x", "- Rs.5"]),
             (None, 0, ["01-02-2024", "z", "n", "acc", "+ Rs.5"]), (None, 1, [None, "UPI Ref 9", None])]
    return spark.createDataFrame(rows, "statement_id string, line_no long, cells array<string>")


@pytest.mark.parametrize("whole", [10, 20_000])
def test_subrows(spark, monkeypatch, whole):
    monkeypatch.setattr(O, "WHOLE_ROWS", whole)
    day = dt.datetime(2024, 2, 1)
    want = [("long", 10 * k, day, f"m{k}", "n", "acc", -5.0, f"| UPI Ref {k}") for k in range(12)]
    want += [("short", 0, day, "a", "n", "acc", -5.0, "| Order ID 1 x | UPI Ref 2")] * 2
    want += [(None, 0, day, "z", "n", "acc", 5.0, "")]
    got = TB.merge_subrows(table(spark), 10)
    assert got.columns == ["statement_id", "line_no", "date", "description", "notes", "account", "raw_amount", "meta"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_subrows_are_read_and_shuffled_once(spark):
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        text = TB.merge_subrows(table(spark), 10)._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") == 1  # that of the buckets of long statements
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert 0 < len(shuffled) <= 6  # one more for the count of lines, in each of two branches


# --- head of wallet texts ----------------------------------------------------

TEXTS = [
    ["Statement for 1 MAR'00 - 28 FEB'01", "Transaction Details"], ["Passbook 2019", "5 Mar Paid to x - Rs.5"],
    ["for 12", "MAR'00", " - ", "28", "", "FEB'01 x"], ["Paid 1,23", " MAR'05 -", "7 FEB'06 2031"],
    ["x" * 499 + "2024 y"], ["x" * 495, "2024"], ["x" * 496, "2024"], ["a1 2 MAR'20 - 3", "APR", "'21"], ["2 MAR'20", "and", "- 3 APR'21"],
    ["y" * 2990, "1 MAR'00 - 28 FEB'01"], ["y" * 2975, "1 MAR'00 - 28 FEB'01"], ["nothing"], [None, "2018"], ["3 MAR'20 -1 APR'21", "2044"],
]


def test_periods_are_those_of_the_whole_head(spark):
    rows = [(s, n, line) for s, text in enumerate(TEXTS) for n, line in enumerate(text)] + [(None, 0, "2017")]
    lines = spark.createDataFrame(rows, "statement_id long, line_no long, line string")
    for chars in (20, 600, 3000):
        want = TX.head_text(lines, chars).select("statement_id", TX.wallet_period(F.col("head")).alias("period"))
        assert sorted(map(str, TX.statement_periods(lines, chars).collect())) == sorted(map(str, want.collect()))


def test_other_text_of_the_head_is_not_shuffled(spark):
    rows = [(s, n, f"{n} words that name nothing ₹5.{n}") for s in range(3) for n in range(4)]
    lines = spark.createDataFrame(rows, "statement_id long, line_no long, line string")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        text = TX.statement_periods(lines)._jdf.queryExecution().executedPlan().toString()
    below = text.split("Exchange hashpartitioning")[1]
    assert "regexp_extract(line" in below and "AS _text" in below


def test_cells_without_digits_are_not_tried(spark):
    texts = ["abc", "", None, "no date", "May", "01-02-2024", "Monday, 3 May 2024", "3rd May 2024 9:05 pm", "₹5"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select(D.parse_timestamp(F.col("c")).alias("d"))
    got = [r.d for r in df.collect()]
    assert [g is not None for g in got] == [False] * 5 + [True] * 3 + [False]
    assert "CASE WHEN RLIKE(c" in plan(df) or "CASE WHEN c" in plan(df)


# --- debits for features and forests -----------------------------------------


@pytest.mark.parametrize("name", ["anomaly_features", "anomaly_share", "predict_unseen", "isolation_forest"])
def test_debits_are_stored_without_unused_columns(spark, monkeypatch, name):
    seen = []
    real = Q.stored
    monkeypatch.setattr(Q, "stored", lambda df: seen.append(df.columns) or real(df))
    out = getattr(Q, name)(spark, SF_DIR)
    assert seen[0] == ["statement_id", "date", "description", "category", "transaction_type", "amount", "line_no"]
    assert "l_orderkey" not in plan(out) and "LogicalRDD" not in plan(out)
