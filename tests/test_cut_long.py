"""Only long statements are cut into buckets; short ones are shuffled once and need no summaries."""

import pytest
from pyspark.sql import Window as W, functions as F

from munim.operators import ordered as O, statement_text as TX

KINDS = ["x", "Transaction statement", "9876543210, someone@bank.in", "Date&time Transactiondetails Amount"]


def rows(spark):
    """A key of 40 rows, one of 4, null keys and null lines."""
    data = [("long", n, n % 7 or None) for n in range(40)] + [("short", 3 * n, n) for n in range(4)]
    data += [(None, n, n) for n in range(3)] + [("short", None, 9)]
    return spark.createDataFrame(data, "k string, n long, v long")


@pytest.fixture
def cut(spark, monkeypatch):
    monkeypatch.setattr(O, "WHOLE_ROWS", 10)
    return O.cut_long(rows(spark), ["k"], O.line_bucket(3, "n"))


def test_buckets(cut):
    got = {(r.k, r.n): r._cut for r in cut.collect()}
    want = {("long", n): n // 3 for n in range(40)} | {("short", 3 * n): O.WHOLE for n in range(4)}
    assert got == want | {(None, n): 0 for n in range(3)} | {("short", None): None}


def test_helpers_agree_with_plain_windows(cut):
    args = (["k"], ["n"], ["_cut"])
    real = cut.where("k IS NOT NULL AND n IS NOT NULL")
    w = W.partitionBy("k").orderBy("n")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    out = O.following(real, *args, F.col("v"), ["a1", "a2", "a3", "a4"])
    out = O.following(out, *args, F.col("v"), ["b1", "b2", "b3", "b4"], back=True)
    out = O.carry_forward(out, *args, F.col("v"), "last")
    out = O.running_total(out, *args, {"total": F.coalesce("v", F.lit(0))})
    want = {f"{s}{i}": f("v", i).over(w) for s, f in (("a", F.lead), ("b", F.lag)) for i in range(1, 5)}
    want |= {"last": F.last("v", True).over(so_far), "total": F.sum(F.coalesce("v", F.lit(0))).over(so_far)}
    names = ["k", "n", *want]
    got = out.select(names).collect()
    assert len(got) == 44 and sorted(got) == sorted(real.withColumns(want).select(names).collect())


def test_short_statements_are_shuffled_once(spark):
    """One exchange of the lines for both passes, and no join of summaries."""
    lines = spark.range(400).select(
        (F.col("id") % 20).alias("statement_id"), F.floor(F.col("id") / 20).alias("line_no"),
        F.get(F.lit(KINDS), (F.col("id") / 20).cast("int") % 4).alias("line"))
    out = TX.strip_page_lines(lines, 1)
    assert len(out.collect()) == 100
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
