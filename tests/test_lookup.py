"""Merchant tables of any size, pages of a sorted table, page headers in line tables."""

import random

from pyspark.sql import functions as F

from munim.operators import classify as K, paging as PG, statement_text as TX


def names(n):
    return [f"{random.Random(k).randrange(36 ** 6):06d} traders {k}" for k in range(n)]


def test_few_places_meet_a_large_table(spark):
    many = names(60_000)
    table = spark.createDataFrame([(k, "c", k) for k in many] + [("zip", "short", "zip"), (None, "n", "n")],
                                  "keyword string, category string, subcategory string")
    texts = [f"upi/ab/{k}/somewhere in town {i}" for i, k in enumerate(many[::30])] + [
        f"nothing known here number {i} at all" for i in range(2000)] + ["unzip", "a zip b", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.m and r.m.subcategory for r in K.with_merchants(df, "t", table, "m").collect()}
    want = {i: k for i, k in enumerate(many[::30])} | {len(texts) - 3: "zip"}
    assert got == {i: want.get(i) for i in range(len(texts))}
    heads = table.where("keyword IS NOT NULL").select(F.left("keyword", F.lit(K.HEAD)).alias("_head")).distinct()
    spots = K.merchant_spots(df.where("length(t) > 0").select(F.col("t").alias("_low")), heads)
    assert spots.count() < 4 * len(texts)


def test_empty_merchant_table(spark):
    table = spark.createDataFrame([], "keyword string, category string, subcategory string")
    df = spark.createDataFrame([("swiggy",), (None,)], "t string")
    assert [r.m for r in K.with_merchants(df, "t", table, "m").collect()] == [None, None]


def test_pages(spark, tmp_path):
    rows = [(random.Random(k).randrange(40), k, "x") for k in range(997)] + [(None, -1, "x")]
    df = spark.createDataFrame(rows, "a int, b long, c string")
    PG.write_sorted(df, ["a", "b"], str(tmp_path / "p"), ranges=7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for page, size in ((1, 100), (2, 100), (10, 100), (11, 100), (3, 333), (1, 5000)):
        got = PG.read_page(spark, str(tmp_path / "p"), ["a", "b"], page, size).orderBy("row_no").collect()
        part = want[(page - 1) * size:page * size]
        assert [(r.a, r.b, r.c) for r in got] == part
        assert [r.row_no for r in got] == list(range((page - 1) * size + 1, (page - 1) * size + 1 + len(part)))
    PG.write_sorted(df.limit(0), ["a", "b"], str(tmp_path / "none"))
    assert PG.read_page(spark, str(tmp_path / "none"), ["a", "b"], 1, 10).count() == 0


def test_strip_page_lines(spark):
    head = ["Transaction statement", "98765, me@bank"]
    period = ["Transactionstatementperiod A", "anything"]
    columns = ["Date&time Transactiondetails Amount"]
    foot = ["Note:Thisstatement x", "anything", "Page1of9"]
    pages = [
        (head + columns + ["a"] + foot, ["a"]),
        (head + period + columns + ["b", "c"] + foot + head + columns + ["d"], ["b", "c", "d"]),
        (head + ["no columns", "e"], head + ["no columns", "e"]),
        (["Note:Thisstatement x", "f"], ["Note:Thisstatement x", "f"]), (["Page1of9"], ["Page1of9"]),
        (foot + foot, []), ([], []),
    ]
    rows = [(s, 3 * k, line) for s, (given, _) in enumerate(pages) for k, line in enumerate(given)] + [(99, 0, None)]
    lines = spark.createDataFrame(rows, "statement_id long, line_no long, line string")
    for span in (4, 1000):  # blocks that cross buckets, and none
        got = TX.strip_page_lines(lines, span).orderBy("line_no").collect()
        assert [[r.line for r in got if r.statement_id == s] for s in range(len(pages))] == [w for _, w in pages]
        assert [r.line for r in got if r.statement_id == 99] == [None]
