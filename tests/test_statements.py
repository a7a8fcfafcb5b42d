"""Whole statement files: encodings, headers, aliases, duplicates, sinks, generator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from munim.operators import aggregates as AG, clean as C
from munim.plans.pipeline import analyse, load
from munim.schema import PIPELINE, ContractError
from munim.sources import sinks, statements as S, synthetic
from munim.streaming import ingest

SPLIT = (
    "Bank of Somewhere\nBranch: X\n\nTxn Date,Description,Ref No/Cheque No,Debit,Credit,Balance\n"
    "01-01-2025,Salary,-,NIL,\"50,000.00\",50000\n02-01-2025,SWIGGY ORDER #123,-,500,NIL,49500\n"
    "02-01-2025,SWIGGY ORDER #456,-,500,NIL,49500\nbad,row,-,1,NIL,1\n,,,,,\n"
    "03-01-2025,too,many,1,NIL,1,extra\n03-01-2025,Zero,-,NIL,NIL,\n"
)
SUFFIXED = (
    "Transaction Date,Value Date,Description,Amount,Balance\n"
    "05-Feb-2025,05-Feb-2025,Caf\xe9 Noir,310.00 DR,1000\n06-Feb-2025,06-Feb-2025,Refund,50.00 CR,1050\n"
    "07-Feb-2025,07-Feb-2025,Odd,-20,1050\n"
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("in")
    (path / "a.csv").write_text(SPLIT, encoding="utf-8-sig")
    (path / "b.txt").write_bytes(SUFFIXED.encode("latin-1"))
    return str(path)


def test_load(spark, folder):
    table = load(spark, folder)
    rows = [(r.date, r.description, r.debit, r.credit, r.amount, r.transaction_type, r.month_year)
            for r in table.orderBy("date", "line_no").collect()]
    day = dt.date
    assert rows == [
        (day(2025, 1, 1), "Salary", 0.0, 50000.0, -50000.0, "credit", "Jan 2025"),
        (day(2025, 1, 2), "Swiggy Order", 500.0, 0.0, 500.0, "debit", "Jan 2025"),
        (day(2025, 1, 3), "Zero", 0.0, 0.0, 0.0, "credit", "Jan 2025"),
        (day(2025, 2, 5), "Café Noir", 310.0, 0.0, 310.0, "debit", "Feb 2025"),
        (day(2025, 2, 6), "Refund", 0.0, 50.0, -50.0, "credit", "Feb 2025"),
        (day(2025, 2, 7), "Odd", 20.0, 0.0, 20.0, "debit", "Feb 2025"),
    ]
    assert set(PIPELINE.names) == set(table.columns)
    assert table.select("statement_id").distinct().count() == 2


def test_line_breaks_inside_quotes(spark):
    texts = spark.createDataFrame([
        ("a", 'Date,Description,Debit\n01-01-2025,"two\nlines ""q""",5\n02-01-2025,plain,6'),
        ("b", 'size 5" pipe\nand 6" too\nend'), ("c", None), ("d", 'x,"open\ny')], "statement_id STRING, text STRING")
    got = {}
    for r in S.to_lines(texts).orderBy("statement_id", "line_no").collect():
        got.setdefault(r.statement_id, []).append(r.line)
    assert got["a"] == ["Date,Description,Debit", '01-01-2025,"two\nlines ""q""",5', "02-01-2025,plain,6"]
    assert got["b"] == ['size 5" pipe', 'and 6" too', "end"] and got["d"] == ['x,"open', "y"]


def test_quoted_description_is_loaded(spark, tmp_path):
    text = 'Date,Description,Debit,Credit\n01-01-2025,"CORNER\nSHOP",5,\n02-01-2025\t,Plain,\u00a06 ,\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    (tmp_path / "copy.csv").write_text(text, encoding="utf-8")
    rows = load(spark, str(tmp_path)).collect()
    assert sorted((r.date.day, r.debit) for r in rows) == [(1, 5.0), (1, 5.0), (2, 6.0), (2, 6.0)]
    assert len({r.statement_id for r in rows}) == 2


def test_checkpoints_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from munim.session import ensure_checkpoint_dir, is_local

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster)
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]")


def test_sums_below_a_paisa(spark):
    from munim.functions import money

    df = spark.createDataFrame([(1.005,), (1.005,), (0.004,)], "x DOUBLE")
    assert df.agg(money.total(F.col("x"))).first()[0] == 2.014


def test_summary(spark, folder):
    stats = AG.summary_stats(load(spark, folder)).where("total_credits > 1000").first()
    assert (stats.total_debits, stats.total_credits, stats.transaction_count) == (500.0, 50000.0, 3)
    assert stats.avg_monthly_spend == 500.0


def test_contract(spark):
    with pytest.raises(ContractError):
        from munim.schema import contract_report
        contract_report(spark.range(1), ["id"])


def test_sinks(spark, tmp_path):
    source = tmp_path / "t.csv"
    source.write_text(
        "date,description,amount,type\n2024-01-05,Swiggy Order #84521,450.0,debit\n"
        "2024-01-29,Amazon Refund Order #7823,1500.0,credit\n")
    sinks.classify_csv(spark, str(source), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("date").collect()
    assert [(r.category, r.subcategory) for r in got] == [
        ("Food and Dining", "Food Delivery"), ("Income and Salary", "Refund")]
    sinks.write_by_month(spark.sql("SELECT DATE'2024-01-05' AS date, 1 AS x"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("month = '2024-01'").count() == 1


def test_generator_and_pipeline(spark):
    ledger = synthetic.synthetic_ledger(spark.range(2).withColumnRenamed("id", "statement_id"))
    counts = {r.statement_id: r["count"] for r in ledger.groupBy("statement_id").count().collect()}
    assert counts == {0: 805, 1: 805}
    again = synthetic.synthetic_ledger(spark.range(2).withColumnRenamed("id", "statement_id"))
    assert ledger.exceptAll(again).isEmpty()
    table = C.unify_amount(ledger).withColumn("month_year", F.date_format("date", "MMM yyyy"))
    out = analyse(table, trees=20)
    tx = out["transactions"]
    assert tx.count() == 1610
    twice = tx.where("description = 'CROMA ELECTRONICS POS'")
    assert twice.where("is_anomaly").count() == 4
    health = out["health"].collect()
    assert len(health) == 2 and all(0 <= r.health_score <= 100 for r in health)
    assert all(2 <= len(r.sentences) <= 3 for r in out["story"].collect())
    assert out["insights"].groupBy("statement_id").count().where("count > 4").isEmpty()
    for name in ("forecast", "recurring", "advice", "personality", "subscriptions"):
        assert not out[name].isEmpty()


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, i, "02-01-2025", "SWIGGY", "500", None, None, None, False) for i in range(3)],
        "statement_id BIGINT, line_no BIGINT, date STRING, description STRING, debit STRING, "
        "credit STRING, balance STRING, amount_raw STRING, single_amount BOOLEAN")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    query = (
        ingest.drop_repeats(ingest.clean_stream(stream)).writeStream.format("memory")
        .queryName("repeats").option("checkpointLocation", str(tmp_path / "c")).start())
    query.processAllAvailable()
    query.stop()
    got = spark.table("repeats").collect()
    assert [(r.category, r.debit) for r in got] == [("Food and Dining", 500.0)]


def test_lines_of_split_files_equal_whole_texts(spark, tmp_path):
    """Splits of a few bytes, also within quoted records and characters, change nothing."""
    from munim.sources import files as L

    texts = {
        "a.csv": "﻿Date,Description,Debit\r\n" + "".join(
            f'0{k % 9 + 1}-01-2025,"two\nlines ""q"" é {k}",5\r\nplain {k},x,6\n' for k in range(40)),
        "b.csv": 'size 5" pipe\nand 6" too\nend', "c.txt": 'x,"open\ny', "d.csv": 'a,b"c\nd"e,f\n"",\n',
        "e.csv": "one", "f.csv": '"' + "\n" * 60 + '"\nlast',
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes("caf\xe9 \xa0,1\nb,2\n".encode("latin-1"))
    (tmp_path / "h.pdf").write_bytes(b"%PDF-1.4 binary")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "307")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = L.read_lines(spark, str(tmp_path)).collect()
        assert L.raw_lines(spark, str(tmp_path)).select("path", "split").distinct().count() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line_no)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    whole = S.read_files(spark, str(tmp_path)).where("kind = 'csv'")
    names = {r.statement_id: r.path.rsplit("/", 1)[1] for r in whole.collect()}
    want = {}
    for r in S.to_lines(whole).orderBy("statement_id", "line_no").collect():
        want.setdefault(names[r.statement_id], []).append((r.line_no, r.line))
    for name in want:  # a text that ends with a line break has an empty last line
        trimmed = want[name][:-1] if want[name][-1][1] == "" else want[name]
        assert got[name] == trimmed, name
    assert set(got) == set(want)


def test_load_accounts_for_every_line(spark, tmp_path):
    from munim.plans.pipeline import load_all

    (tmp_path / "a.csv").write_text(SPLIT + "02-01-2025,SWIGGY ORDER #123,-,500,NIL,49500\n", encoding="utf-8-sig")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.csv").write_text("nothing here\n")
    (tmp_path / "d.csv").write_text("")  # nothing to reject
    (tmp_path / "e.pdf.txt").write_text(
        "Some Bank\nAccount statement\n2025/03/01 GROCERY STORE 1,250.00 DR\n2025/03/02 SALARY 50,000.00 CR\nThank you\n")
    done = load_all(spark, str(tmp_path))
    fates = {}
    for r in done.lines.collect():
        fates.setdefault(r.path.rsplit("/", 1)[1], {}).setdefault(r.fate, []).append(r.line_no)
    assert fates["a.csv"] == {"before the header": [0, 1], "blank": [2], "header": [3], "row": [4, 5, 10],
                              "repeat": [6, 11], "no date": [7], "no value": [8], "too many fields": [9]}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in done.rejected.collect()} == {
        "b.pdf": "not text: extract its text or rows first", "c.csv": "no dated row"}
    rows = done.table.collect()
    assert len(rows) == 3 + 2
    assert sorted((r.debit, r.credit) for r in rows if r.date.month == 3) == [(0.0, 50000.0), (1250.0, 0.0)]
