"""Queries and oracles: statement lines and table rows.

Lines and cells are formatted from ``txn``; the oracle is the unformatted value.
Line numbers are the transaction's times four plus the line within it.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from munim.functions import dates as D
from munim.operators import statement_tables as TB, statement_text as TX
from munim.plans.clean_queries import pick
from munim.plans.fixtures import DAY_SPAN, TXN_SQL, raw_txn, stored_raw_txn, table, txn
from munim.plans.registry import query
from munim.rules import ledger_profile as LP
from munim.sources.synthetic import synthetic_ledger as ledger

WITH = "WITH " + TXN_SQL
KEYS = ["statement_id", "line_no"]
SPAN = DAY_SPAN * 4


def as_lines(rows: DataFrame, *texts: Column) -> DataFrame:
    """Up to four lines per transaction; null texts make no line."""
    numbered = F.array(*[F.struct((F.col("line_no") * 4 + i).alias("n"), t.alias("line"))
                         for i, t in enumerate(texts)])
    return rows.select("statement_id", F.inline(numbered)).where(F.col("line").isNotNull()).select(
        "statement_id", F.col("n").alias("line_no"), "line")


def heading(rows: DataFrame, *texts: Column | str) -> DataFrame:
    """Lines 0, 1, ... of every statement."""
    lines = F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    return rows.select("statement_id").distinct().select(
        "statement_id", F.posexplode(lines).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def in_2000(rows: DataFrame) -> DataFrame:
    """Transactions moved into March 2000 to February 2001, month and day kept."""
    year = F.when(F.month("date") >= 3, 2000).otherwise(2001)
    day = F.least(F.dayofmonth("date"), F.lit(28))
    return rows.withColumn("date", D.safe_date(year, F.month("date"), day))


MOVED_SQL = WITH + """
, mv AS (SELECT * REPLACE (make_date(CASE WHEN month(date) >= 3 THEN 2000 ELSE 2001 END, month(date),
         least(day(date), 28)) AS date) FROM txn)"""


@query("issuer_detect", WITH + """
SELECT DISTINCT statement_id, CASE statement_id % 6 WHEN 0 THEN 'GPay' WHEN 1 THEN 'Paytm' WHEN 2 THEN 'HDFC CC'
  WHEN 3 THEN 'SBI' WHEN 4 THEN 'PhonePe' ELSE 'Unknown' END AS issuer FROM txn""")
def issuer_detect(spark, d):
    rows = txn(spark, d)
    title = F.get(F.lit([
        "Transaction statement", "Passbook", "HDFC Bank Credit Card", "State Bank of India",
        "phonepe.com Google Pay", "Some Bank"]), (F.col("statement_id") % 6).cast("int"))
    foot = F.when(F.col("statement_id") % 6 == 1, "UPI Ref No: 1").otherwise("Powered by UPI")
    head = heading(rows, title, F.when(
        F.col("statement_id") % 6 == 1, "Passbook Payments History").otherwise("Page 1"))
    return TX.detect_issuer(head.unionByName(as_lines(rows, F.col("description"), foot)))


@query("upi_lines_compact", WITH + """
SELECT statement_id, line_no * 4 AS line_no, date, amount_abs AS amount, transaction_type,
  CASE WHEN transaction_type = 'debit' AND pick % 2 = 1 THEN 'Family Restaurant'
  ELSE array_to_string(list_transform(string_split(description, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
  END AS description FROM (SELECT *, abs(amount) AS amount_abs FROM txn)""")
def upi_lines_compact(spark, d):
    rows = raw_txn(spark, d)
    credit = F.col("transaction_type") == "credit"
    camel = F.replace(F.initcap("description"), F.lit(" "))
    name = F.when(credit | (F.col("pick") % 2 == 0), camel).otherwise("FAMILYRESTAURANT")
    line = F.concat(F.date_format("date", "ddMMM,yyyy"), F.when(credit, " Receivedfrom").otherwise(" Paidto"),
                    name, F.lit(" ₹"), F.col("lakh"))
    lines = as_lines(rows, line, F.lit("09:15AM UPITransactionID:123"), F.lit("PaidbyIndianBank1234"))
    return TX.upi_lines(lines).drop("bank_source")


@query("strip_pages", WITH + """
SELECT statement_id, line_no, date, abs(amount) AS amount, transaction_type FROM txn""")
def strip_pages(spark, d):
    """Records between page headers and footers; both may hold a line shaped like a record."""
    rows = stored_raw_txn(spark, d)
    credit = F.col("transaction_type") == "credit"
    line = F.concat(F.date_format("date", "ddMMM,yyyy"), F.when(credit, " Receivedfrom").otherwise(" Paidto"),
                    F.replace("description", F.lit(" ")), F.lit(" \u20b9"), F.col("lakh"))
    opens, closes = F.col("pick") % 2 == 0, F.col("pick") % 3 == 0
    period = opens & (F.col("statement_id") % 2 == 0)
    texts = [F.when(opens, "Transaction statement"), F.when(opens, "9876543210, someone@bank.in"),
             F.when(period, "Transactionstatementperiod Sent Received"), F.when(period, F.concat(F.lit("02Jan,2020 PaidtoNobody"), F.lit(" \u20b98"))),
             F.when(opens, "Date&time Transactiondetails Amount"), line, F.lit("PaidbyIndianBank1234"),
             F.when(closes, "Note:Thisstatement reflects payments"),
             F.when(closes, F.concat(F.lit("01Jan,2020 PaidtoNobody"), F.lit(" \u20b97"))),
             F.when(closes, "Page1of9")]
    numbered = F.array(*[F.struct((F.col("line_no") * 16 + i).alias("n"), t.alias("line"))
                         for i, t in enumerate(texts)])
    lines = rows.select("statement_id", F.inline(numbered)).where(F.col("line").isNotNull()).select(
        "statement_id", F.col("n").alias("line_no"), "line")
    found = TX.upi_lines(TX.strip_page_lines(lines, DAY_SPAN * 16))
    return found.select("statement_id", F.floor(F.col("line_no") / 16).cast("bigint").alias("line_no"),
                        "date", "amount", "transaction_type")


def wallet(spark, d) -> DataFrame:
    rows = in_2000(stored_raw_txn(spark, d))
    credit = F.col("transaction_type") == "credit"
    line = F.concat(
        F.date_format("date", "d MMM "), F.when(credit, "Received from ").otherwise("Paid to "),
        F.col("description"), pick(" Tag: # Food", "", " Note: lunch Tag: # Shopping"),
        F.when(credit, " + Rs.").otherwise(" - Rs."), F.col("lakh"))
    more = pick(F.lit("UPI ID: a@b"), F.lit("extra #Rent"), F.lit("12345"))
    lines = as_lines(rows, line, F.lit("11:39 PM"), more, F.lit(" "))
    return heading(rows, "Statement for 1 MAR'00 - 28 FEB'01", "Transaction Details").unionByName(lines)


@query("wallet_lines", MOVED_SQL + """
SELECT statement_id, line_no * 4 AS line_no, date, abs(amount) AS amount, transaction_type,
  description || CASE pick % 3 WHEN 1 THEN ' extra' ELSE '' END AS description,
  CASE pick % 3 WHEN 0 THEN 'Food' WHEN 1 THEN 'Rent' ELSE 'Shopping' END AS paytm_tag FROM mv""")
def wallet_lines(spark, d):
    return TX.wallet_lines(wallet(spark, d), SPAN).drop("bank_source")


def in_order(rows: DataFrame) -> DataFrame:
    """Lines numbered by moved date; odd statements lie within the year 2000."""
    odd = F.col("statement_id") % 2 == 1
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    old = F.floor(F.col("line_no") / DAY_SPAN).cast("int")
    was = F.date_add(F.lit("1970-01-01").cast("date"), old)
    turn = (F.year(was) - 1990) * 1_000_000 + F.dayofmonth(was) * 10_000
    moved = in_2000(rows).withColumn("date", F.when(odd, D.safe_date(
        F.lit(2000), F.month("date"), F.dayofmonth("date"))).otherwise(F.col("date")))
    return moved.withColumn("line_no", day * DAY_SPAN + turn + F.col("line_no") % DAY_SPAN)


IN_ORDER_SQL = WITH + f"""
, m0 AS (SELECT *, (year(date) - 1990) * 1000000 + day(date) * 10000 AS y, make_date(CASE WHEN month(date) >= 3 OR statement_id % 2 = 1 THEN 2000
         ELSE 2001 END, month(date), least(day(date), 28)) AS moved FROM txn),
mv AS (SELECT * REPLACE (moved AS date, date_diff('day', DATE '1970-01-01', moved) * {DAY_SPAN}
       + y + line_no % {DAY_SPAN} AS line_no) FROM m0)"""


@query("wallet_blocks", IN_ORDER_SQL + """
SELECT statement_id, line_no * 4 AS line_no, CAST(date AS TIMESTAMP) + CASE pick % 2 WHEN 0
    THEN INTERVAL '23 hours 39 minutes' ELSE INTERVAL '0 hours' END AS date, -amount AS amount, description,
  transaction_type, CASE pick % 4 WHEN 0 THEN 'State Bank Of India' WHEN 2 THEN 'UPI Lite' ELSE '' END AS account
FROM mv WHERE pick % 5 <> 0""")
def wallet_blocks(spark, d):
    rows = in_order(stored_raw_txn(spark, d))
    credit = F.col("transaction_type") == "credit"
    own = F.when(F.col("pick") % 5 == 0, "self transfer").otherwise(F.col("description"))
    line = F.concat(F.date_format("date", "d MMM "), own, pick(" Note: x + Rs.5 Tag: y", ""),
                    F.when(credit, " + Rs.").otherwise(" - Rs."), F.col("lakh"))
    lines = as_lines(rows, line, pick("11:39 PM", "Ref 9"), pick("State Bank Of India - 24", "ref", "UPI lite", "z"),
                     F.lit("Page 2 of 3"))
    # Every other statement names no period, only a year, and lists its lines in order.
    head = F.when(F.col("statement_id") % 2 == 0, "1 MAR'00 - 28 FEB'01").otherwise("Passbook 2000")
    text = heading(rows, head, "Transaction Details").unionByName(lines)
    periods = TX.head_text(text, 100).select(
        "statement_id", TX.period_dates(F.col("head")).alias("p")).where("p IS NOT NULL").select(
        "statement_id", "p.*")
    return TX.wallet_blocks(text, periods, SPAN)


@query("line_blocks", MOVED_SQL + """
SELECT statement_id, line_no * 4 + i AS line_no, line_no * 4 AS block FROM mv, (SELECT unnest([0, 1, 2]) AS i)""")
def line_blocks(spark, d):
    rows = in_2000(txn(spark, d))
    line = F.concat(F.date_format("date", "d MMM "), F.col("description"))
    lines = as_lines(rows, line, F.lit("11:39 PM"), F.lit("UPI Ref"))
    return TX.line_blocks(heading(rows, "stray").unionByName(lines), SPAN).drop("line")


@query("period_year", MOVED_SQL + """
SELECT statement_id, line_no, year(date)::INT AS year FROM mv""")
def period_year(spark, d):
    rows = in_2000(txn(spark, d))
    text = heading(rows, F.concat(F.lit("Passbook "), F.col("statement_id").cast("string")),
                   "1 MAR'00 - 28 FEB'01")
    dated = rows.join(TX.statement_periods(text), "statement_id")
    year = TX.year_in_period(F.month("date"), F.dayofmonth("date"), F.col("period"))
    return dated.select(*KEYS, year.cast("int").alias("year"))


@query("month_year_lookup", MOVED_SQL + """
SELECT statement_id, line_no, CAST(CASE WHEN statement_id % 2 = 0 THEN year(date)
  WHEN month(date) <= 8 THEN 2002 ELSE 2001 END AS INT) AS year FROM mv""")
def month_year_lookup(spark, d):
    # Odd statements have a period of 30 months, in which a month takes its latest year.
    period = F.when(F.col("statement_id") % 2 == 0, "01 MAR'00 to 28 FEB'01").otherwise(
        "01 MAR'00 to 31 AUG'02")
    rows = in_2000(txn(spark, d)).withColumn("p", TX.period_dates(period))
    year = TX.year_of_month(F.month("date"), F.col("p.start"), F.col("p.end"))
    return rows.select(*KEYS, year.cast("int").alias("year"))


ROLL_SQL = WITH + """
, o AS (SELECT statement_id, month(date) AS m,
        CASE WHEN statement_id % 2 = 0 THEN line_no ELSE 100000::BIGINT * {span} - line_no END AS line_no FROM txn),
p AS (SELECT *, lag(m) OVER (PARTITION BY statement_id ORDER BY line_no) AS pm,
      row_number() OVER (PARTITION BY statement_id ORDER BY line_no) AS r FROM o),
v AS (SELECT statement_id, count(*) FILTER (m - pm BETWEEN 0 AND 6) >= count(*) FILTER (m - pm BETWEEN -6 AND -1)
      AS fw FROM p WHERE r <= 30 GROUP BY 1),
c AS (SELECT *, sum(CASE WHEN m < pm - 2 THEN 1 ELSE 0 END) OVER w AS bk,
      sum(CASE WHEN m > pm + 2 THEN 1 ELSE 0 END) OVER w AS ah FROM p
      WINDOW w AS (PARTITION BY statement_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT statement_id, line_no, CAST(CASE WHEN fw THEN 1995 + bk ELSE 2001 - ah END AS INT) AS year
FROM c JOIN v USING (statement_id)""".format(span=DAY_SPAN)


@query("year_rollover", ROLL_SQL)
def year_rollover(spark, d):
    order = F.when(F.col("statement_id") % 2 == 0, F.col("line_no")).otherwise(
        F.lit(100000 * DAY_SPAN) - F.col("line_no"))
    rows = txn(spark, d).select(
        "statement_id", order.alias("line_no"), F.month("date").alias("month"),
        F.lit(1995).alias("min_year"), F.lit(2001).alias("max_year"))
    return TX.assign_years(rows, DAY_SPAN).select(*KEYS, "year")


@query("universal_lines", WITH + """
SELECT statement_id, line_no * 4 AS line_no, date, description,
  CASE WHEN pick % 3 = 2 THEN -abs(amount) ELSE -amount END AS raw_amount FROM txn""")
def universal_lines(spark, d):
    rows = stored_raw_txn(spark, d)
    credit = F.col("transaction_type") == "credit"
    date = pick(F.date_format("date", "yyyy/MM/dd"), F.date_format("date", "d MMM yyyy"),
                F.date_format("date", "dd.MM.yyyy"))
    side = F.when(credit, " CR").otherwise(" DR")
    sign = F.when(credit, "+ ₹").otherwise("- ₹")
    tail = pick(F.concat(F.lit(" | "), F.col("lakh"), side), F.concat(F.lit(", "), sign, F.col("lakh")),
                F.lit(""))
    line = F.concat(F.lit(" "), date, F.lit(" - "), F.col("description"), tail)
    nxt = F.when(F.col("pick") % 3 == 2, F.concat(F.lit("Rs. "), F.col("lakh"))).otherwise("note: none")
    lines = as_lines(rows, line, nxt, F.lit("Opening balance: 2001-01-01 Rs.9"))
    out = TX.universal_lines(lines, SPAN).withColumn("date", F.col("date").cast("date"))
    return out.select(*KEYS, "date", "description", "raw_amount")


# --- tables ----------------------------------------------------------------

HEADERS = {
    "split": ["Txn Date", "Narration", "Withdrawal", "Deposit", "Balance"],
    "single": ["Date", "Description", "Amount", "Balance"],
    "drcr": ["Tran Date", "Particulars", "Dr/Cr", "Amount", "Balance"],
    "typed": ["Date", "Transaction Details x", "Type", "Amount"],
}


def cells_of(kind: str) -> Column:
    credit = F.col("transaction_type") == "credit"
    date = F.date_format("date", "dd-MM-yyyy")
    lakh, desc = F.col("lakh"), F.col("description")
    blank = F.lit("")
    return {
        "split": F.array(date, desc, F.when(credit, blank).otherwise(lakh),
                         F.when(credit, lakh).otherwise(blank), lakh),
        "single": F.array(date, desc, F.concat(lakh, F.when(credit, " Cr").otherwise(" Dr")), lakh),
        "drcr": F.array(date, desc, F.when(credit, "CR").otherwise("DR"), lakh, lakh),
        "typed": F.array(date, desc, F.when(credit, "Credit").otherwise("Debit"), lakh),
    }[kind]


def table_rows(rows: DataFrame, kind: str) -> DataFrame:
    head = rows.select("statement_id").distinct().select(
        "statement_id", F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("line_no"), F.array(F.lit("Account No"), F.lit("12")).alias("cells")),
            F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit(HEADERS[kind]).alias("cells")))))
    body = rows.select(*KEYS, cells_of(kind).alias("cells"))
    return head.unionByName(body)


RECORD_SQL = WITH + "SELECT statement_id, line_no, date, description, -amount AS raw_amount FROM txn"


def read_kind(kind: str, issuer: str):
    def run(spark, d):
        rows = table_rows(stored_raw_txn(spark, d), kind)
        issuers = rows.select("statement_id").distinct().withColumn("issuer", F.lit(issuer))
        layout = TB.layouts(rows, issuers)
        below = rows.join(layout, "statement_id").where(F.col("line_no") > F.col("header_line"))
        out = TB.read_records(below.where(F.col("kind") == kind))
        return out.select(*KEYS, F.col("date").cast("date"), "description", "raw_amount")

    return run


query("rows_split", RECORD_SQL)(read_kind("split", "HDFC"))
query("rows_single", RECORD_SQL)(read_kind("single", "AmEx"))
query("rows_drcr", RECORD_SQL)(read_kind("drcr", "Axis"))
query("rows_typed", RECORD_SQL)(read_kind("typed", "PhonePe"))


@query("positional_infer", RECORD_SQL)
def positional_infer(spark, d):
    raw = stored_raw_txn(spark, d)
    split = F.col("statement_id") % 2 == 0
    body = raw.select(*KEYS, F.when(split, cells_of("split")).otherwise(cells_of("single")).alias("cells"))
    head = raw.select("statement_id").distinct().select(
        "statement_id", F.lit(0).cast("bigint").alias("line_no"),
        F.array(F.lit("Branch"), F.lit("x")).alias("cells"))
    # A split table with one-sided statements has no exclusive pair; keep those with both sides.
    out = TB.positional_rows(head.unionByName(body))
    return out.select(*KEYS, F.col("date").cast("date"), "description", "raw_amount")


@query("rows_subrow_merge", WITH + """
SELECT statement_id, line_no * 4 AS line_no, date, description, -amount AS raw_amount,
  CASE WHEN pick % 2 = 0 THEN '| UPI Ref 1 | Order ID 2' ELSE '| UPI Ref 1' END AS meta FROM txn""")
def rows_subrow_merge(spark, d):
    raw = stored_raw_txn(spark, d)
    credit = F.col("transaction_type") == "credit"
    amount = F.concat(F.when(credit, "+ Rs.").otherwise("- Rs."), F.col("lakh"))
    none = F.lit(None).cast("string")
    main = F.array(F.date_format("date", "dd-MM-yyyy"), F.col("description"), F.lit("n"), F.lit("acc"), amount)
    sub = F.array(none, F.lit("UPI Ref 1"), none, none, none)
    third = pick(F.array(none, F.lit("Order ID 2"), none, none, none),
                 F.array(F.lit("Page 3"), none, none, none, none))
    last = F.array(none, F.lit("UPI Ref lost"), none, none, none)
    numbered = F.array(*[
        F.struct((F.col("line_no") * 4 + i).alias("n"), c.alias("cells"))
        for i, c in enumerate([main, sub, third])] + [
        F.struct((F.col("line_no") * 4 + 3).alias("n"),
                 F.when(F.col("pick") % 2 == 1, last).otherwise(F.array(none)).alias("cells"))])
    rows = raw.select("statement_id", F.inline(numbered)).withColumnRenamed("n", "line_no")
    out = TB.merge_subrows(rows, SPAN)
    return out.select(*KEYS, F.col("date").cast("date"), "description", "raw_amount", "meta")


@query("parse_fallback", WITH + """
SELECT statement_id, CASE WHEN statement_id % 4 = 3 THEN line_no * 4 ELSE line_no END AS line_no, date, description,
  -amount AS raw_amount, CAST(CASE statement_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS INT) AS stage
FROM txn""")
def parse_fallback(spark, d):
    raw = stored_raw_txn(spark, d)
    group = lambda k: raw.where(F.col("statement_id") % 4 == k)
    credit = F.col("transaction_type") == "credit"
    rows = (
        table_rows(group(0), "split").unionByName(table_rows(group(1), "single"))
        .unionByName(group(2).select(*KEYS, cells_of("single").alias("cells")))
        .unionByName(group(3).select(*KEYS, F.array(F.lit("no"), F.lit("table")).alias("cells")))
    )
    line = F.concat(F.date_format("date", "yyyy/MM/dd "), F.col("description"), F.lit(" "), F.col("lakh"),
                    F.when(credit, " CR").otherwise(" DR"))
    issuers = raw.select("statement_id").distinct().withColumn("issuer", F.lit("Unknown"))
    out = TB.parse_documents(rows, as_lines(raw, line), issuers, SPAN)
    return out.select(*KEYS, F.col("date").cast("date"), "description", "raw_amount", "stage")


@query("parse_documents", MOVED_SQL + """
SELECT statement_id, CASE WHEN statement_id % 7 IN (3, 4, 5) THEN line_no * 4 ELSE line_no END AS line_no,
  CASE WHEN statement_id % 7 = 5 THEN mv.date ELSE txn.date END AS date, abs(txn.amount) AS amount,
  txn.transaction_type, CASE statement_id % 7 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'AmEx' WHEN 4 THEN 'GPay'
    WHEN 5 THEN 'Paytm' WHEN 6 THEN 'Paytm' ELSE 'Unknown' END AS bank_source
FROM txn JOIN mv USING (statement_id, line_no)""")
def parse_documents(spark, d):
    raw = stored_raw_txn(spark, d)
    group = lambda k, df=raw: df.where(F.col("statement_id") % 7 == k)
    credit = F.col("transaction_type") == "credit"
    signed = F.concat(F.when(credit, "+ Rs.").otherwise("- Rs."), F.col("lakh"))
    bare = F.array(F.date_format("date", "dd-MM-yyyy"), F.col("description"), F.lit("n"), F.lit("a"), signed)
    rows = (
        table_rows(group(0), "split").unionByName(table_rows(group(1), "single"))
        .unionByName(group(2).select(*KEYS, cells_of("single").alias("cells")))
        .unionByName(group(3).select(*KEYS, F.array(F.lit("no"), F.lit("table")).alias("cells")))
        .unionByName(group(6).select(*KEYS, bare.alias("cells"))))
    line = F.concat(F.date_format("date", "yyyy/MM/dd "), F.col("description"), F.lit(" "), F.col("lakh"),
                    F.when(credit, " CR").otherwise(" DR"))
    compact = F.concat(F.date_format("date", "ddMMM,yyyy"), F.when(credit, " Receivedfrom").otherwise(" Paidto"),
                       F.replace("description", F.lit(" ")), F.lit(" ₹"), F.col("lakh"))
    app = F.concat(F.date_format("date", "d MMM "), F.lit("Paid to "), F.col("description"), F.lit(" "), signed)
    wallet_rows = in_2000(group(5))
    lines = (
        as_lines(group(3), line).unionByName(as_lines(group(4), compact, F.lit("Page1of9")))
        .unionByName(heading(wallet_rows, "Statement for 1 MAR'00 - 28 FEB'01"))
        .unionByName(as_lines(wallet_rows, app, F.lit("11:39 PM"))))
    issuers = raw.select("statement_id").distinct().withColumn("issuer", F.get(F.lit(
        ["HDFC", "AmEx", "Unknown", "Unknown", "GPay", "Paytm", "Paytm"]), (F.col("statement_id") % 7).cast("int")))
    table_ = TB.document_table(TB.parse_documents(rows, lines, issuers, SPAN), issuers)
    return table_.select(*KEYS, "date", "amount", "transaction_type", "bank_source")


# --- synthetic ledger ------------------------------------------------------


def sql_uniform(*parts: str) -> str:
    text = " || '|' || ".join(["'42'", "statement_id", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def sql_choice(options: list[str], x: str) -> str:
    body = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"list_extract([{body}], CAST(floor({x} * {len(options)}) AS INT) + 1)"


def sql_between(lo: float, hi: float, x: str) -> str:
    return f"round_even(({lo} + ({hi - lo}) * {x}) * 100.0, 0) / 100.0"


def ledger_sql() -> str:
    u = lambda name, *p: sql_uniform(f"'{name}'", *p)
    slots = LP.MONTHS * 4
    extra = " + ".join(f"1 + floor({u('k', str(m))} * 3)" for m in range(LP.MONTHS))
    month0 = f"CAST(floor((i - {LP.MONTHS}) / 3) AS INT)"
    tops = list(accumulate(v[0] for v in LP.SPENDING.values()))
    case = lambda f: "CASE " + " ".join(
        f"WHEN {u('c', 'i')} * 100 < {top} THEN {f(v)}" for top, v in zip(tops, LP.SPENDING.values())) + " END"
    planted = ", ".join(
        f"({LP.ROWS + slots + 1 + n}, DATE '{d}', '{t}', {a}::DOUBLE)" for n, (d, t, a) in enumerate(LP.PLANTED))
    return f"""
WITH s AS (SELECT s_suppkey AS statement_id FROM supplier),
r AS (SELECT statement_id, unnest(range(0, {LP.ROWS + slots + 1}))::INT AS i FROM s),
k AS (SELECT * FROM r WHERE i < {LP.MONTHS}
  OR (i >= {LP.MONTHS} AND i < {slots} AND (i - {LP.MONTHS}) % 3 < 1 + floor({u('k', month0)} * 3))
  OR (i >= {slots} AND i - {slots} < {LP.ROWS - LP.MONTHS} - ({extra}))),
g AS (SELECT statement_id, i::BIGINT AS line_no, CASE WHEN i < {LP.MONTHS} THEN make_date({LP.YEAR}, i + 1, 1)
    WHEN i < {slots} THEN make_date({LP.YEAR}, {month0} + 1, CAST(5 + floor({u('d', 'i')} * 24) AS INT))
    ELSE make_date({LP.YEAR}, CAST(1 + floor({u('m', 'i')} * {LP.MONTHS}) AS INT),
      CAST(1 + floor({u('d', 'i')} * 28) AS INT)) END AS date,
  CASE WHEN i < {LP.MONTHS} THEN {sql_choice(LP.SALARIES, u('t', 'i'))}
    WHEN i < {slots} THEN {sql_choice(LP.INCOMES, u('t', 'i'))}
    ELSE replace({case(lambda v: sql_choice(v[3], u('t', 'i')))}, '{{num}}',
      CAST(CAST(1000 + floor({u('n', 'i')} * 998999) AS BIGINT) AS VARCHAR)) END AS description,
  CASE WHEN i < {slots} THEN 0.0 ELSE {case(lambda v: sql_between(v[1], v[2], u('a', 'i')))} END::DOUBLE AS debit,
  CASE WHEN i < {LP.MONTHS} THEN {sql_between(*LP.SALARY_RANGE, u('a', 'i'))}
    WHEN i < {slots} THEN {sql_between(*LP.INCOME_RANGE, u('a', 'i'))} ELSE 0.0 END::DOUBLE AS credit FROM k
  UNION ALL SELECT statement_id, v.n, v.d, v.t, v.a, 0.0 FROM s, (VALUES {planted}) v(n, d, t, a))
SELECT *, ({int(LP.OPENING_BALANCE * 100)} + sum(CAST(round(credit * 100) AS BIGINT) - CAST(round(debit * 100) AS BIGINT))
  OVER (PARTITION BY statement_id ORDER BY date, line_no ROWS UNBOUNDED PRECEDING))::DOUBLE / 100.0 AS balance FROM g"""


@query("synthetic_ledger", ledger_sql())
def synthetic_ledger(spark, d):
    return ledger(table(spark, d, "supplier").select(F.col("s_suppkey").alias("statement_id")))
