"""Queries and oracles: sources, parsing of cells, cleaning, layouts, duplicates.

Texts are formatted from ``txn``, so where parsing must return the original
value the oracle is simply the unformatted column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from munim.functions import amounts as AM, dates as D, money, text as T
from munim.operators import clean as C, filters
from munim.plans.fixtures import DAY_SPAN, NARRATED_SQL, TXN_SQL, raw_txn, stored, stored_raw_txn, table, txn, txn_base
from munim.plans.registry import query
from munim.schema import contract_report
from munim.session import ensure_checkpoint_dir
from munim.sources import files as L, headers as H, statements as S

WITH = "WITH " + TXN_SQL
RAW = "WITH " + NARRATED_SQL
KEYS = ["statement_id", "line_no"]


def pick(*values) -> Column:
    """One of ``values`` by the row's ``pick``."""
    options = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.get(F.array(*options), (F.col("pick") % len(values)).cast("int"))


# --- sources ---------------------------------------------------------------


def csv_lines(spark, d) -> DataFrame:
    """Lines of one CSV statement per customer in three bank layouts.

    ``statement_id % 7`` preamble lines precede the header; transaction lines follow.
    """
    raw = stored_raw_txn(spark, d)
    bank = F.col("statement_id") % 3
    header = (
        F.when(bank == 0, "Txn Date,Description,Ref No/Cheque No,Debit,Credit,Balance")
        .when(bank == 1, "Date,Narration,Chq/Ref No,Value Date,Withdrawal Amt,Deposit Amt,Closing Balance")
        .otherwise("Transaction Date,Value Date,Description,Cheque Number,Amount,Balance")
    )
    preamble = F.transform(
        F.sequence(F.lit(1), (F.col("statement_id") % 7).cast("int")),
        lambda i: F.concat(F.lit("Account Holder "), i.cast("string"), F.lit(", Debit card only")),
    )
    head = raw.select("statement_id").distinct().select(
        "statement_id",
        F.posexplode(
            F.concat(F.when(F.col("statement_id") % 7 > 0, preamble).otherwise(F.array()),
                     F.array(header))
        ).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    text = F.concat(F.lit('"'), F.col("lakh"), F.lit('"'))
    debit = F.col("transaction_type") == "debit"
    body = (
        F.when(bank == 0, F.concat_ws(
            ",", F.date_format("date", "dd-MM-yyyy"), "narration", F.lit("-"),
            F.when(debit, text).otherwise("NIL"), F.when(debit, "NIL").otherwise(text), text))
        .when(bank == 1, F.concat_ws(
            ",", F.date_format("date", "dd/MM/yyyy"), "narration", F.lit("REF1"),
            F.date_format("date", "dd/MM/yyyy"), F.when(debit, text).otherwise(""),
            F.when(debit, "").otherwise(text), text))
        .otherwise(F.concat_ws(
            ",", F.date_format("date", "dd-MMM-yyyy"), F.lit("x"), "narration", F.lit(""),
            F.concat(F.lit('"'), F.col("lakh"), F.when(debit, " DR").otherwise(" CR"), F.lit('"')),
            text))
    )
    return head.unionByName(raw.select(*KEYS, body.alias("line")))


def cell_rows(spark, d) -> DataFrame:
    return csv_lines(spark, d).select(*KEYS, S.csv_cells(F.col("line")).alias("cells"))


@query("scan_csv_dynamic", WITH + """
SELECT statement_id, line_no, date, debit, credit, abs(amount) AS balance FROM txn""")
def scan_csv_dynamic(spark, d):
    rows = C.clean(S.scan_csv(csv_lines(spark, d)), deduplicate=False)
    return rows.select(*KEYS, "date", "debit", "credit", "balance")


#: What the files of ``load_files`` hold beside good rows, one of each: (line, fate).
BAD_LINES = [("99-99-2025,x,\"a\nb\",no date,,", "no date"), (",,,,,", "no value"),
             ("01-01-2025,a,b,c,d,e,f,g", "too many fields"), ("", "blank")]


@query("load_files", WITH + """
, n AS (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1)
SELECT statement_id, 'row' AS fate, n FROM n
UNION ALL SELECT statement_id, fate, 1 FROM n,
  (VALUES ('no date'), ('no value'), ('too many fields'), ('blank'), ('header')) AS f(fate)
UNION ALL SELECT statement_id, 'before the header', statement_id % 7 FROM n WHERE statement_id % 7 > 0""")
def load_files(spark, d):
    """Written CSV files, a quoted line break and bad lines in each: every line read back has its fate."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    lines = csv_lines(spark, d)
    bad = lines.select("statement_id").distinct().select("statement_id", F.posexplode(F.lit(
        [line for line, _ in BAD_LINES])).alias("line_no", "line")).withColumn("line_no", F.lit(2**62) + F.col("line_no"))
    lines.unionByName(bad).repartition("statement_id").sortWithinPartitions("statement_id", "line_no").select(
        "statement_id", "line").write.options(**L.SMALL_FILES).partitionBy("statement_id").text(folder)
    read = stored(L.read_lines(spark, folder))
    named = read.select("statement_id", F.regexp_extract("path", r"statement_id=(\d+)", 1).cast("long").alias("_s")).distinct()
    return L.line_fates(read).join(named, "statement_id").groupBy(F.col("_s").alias("statement_id"), "fate").agg(
        F.count("*").alias("n"))


@query("alias_rename", WITH + """
SELECT DISTINCT statement_id, CAST(0 AS INT) AS date_at,
  CAST(CASE statement_id % 3 WHEN 2 THEN 2 ELSE 1 END AS INT) AS description_at,
  CAST(CASE statement_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS INT) AS debit_at,
  CAST(CASE statement_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 END AS INT) AS credit_at,
  CAST(CASE statement_id % 3 WHEN 2 THEN 4 END AS INT) AS amount_at,
  CAST(CASE statement_id % 3 WHEN 1 THEN 2 END AS INT) AS reference_at
FROM txn""")
def alias_rename(spark, d):
    header = H.first_header(csv_lines(spark, d))
    at = header.select("statement_id", H.target_positions(S.csv_cells(F.col("header"))).alias("at"))
    return at.select(
        "statement_id", F.col("at.date").alias("date_at"),
        F.col("at.description").alias("description_at"), F.col("at.debit").alias("debit_at"),
        F.col("at.credit").alias("credit_at"), F.col("at.amount_raw").alias("amount_at"),
        F.col("at.reference").alias("reference_at"),
    )


HEADER_SQL = WITH + "SELECT DISTINCT statement_id, statement_id % 7 AS header_line FROM txn"


@query("header_detect_first", HEADER_SQL)
def header_detect_first(spark, d):
    return H.first_header(csv_lines(spark, d)).select("statement_id", "header_line")


@query("header_detect_best", HEADER_SQL)
def header_detect_best(spark, d):
    return H.best_sheet_header(cell_rows(spark, d)).select("statement_id", "header_line")


@query("header_detect_signals", HEADER_SQL)
def header_detect_signals(spark, d):
    return H.best_signal_header(cell_rows(spark, d)).select("statement_id", "header_line")


@query("sheet_scan", WITH + """
SELECT statement_id, line_no, date, debit, credit, abs(amount) AS balance FROM txn""")
def sheet_scan(spark, d):
    rows = cell_rows(spark, d)
    out = C.clean(S.read_sheet_rows(rows, H.best_sheet_header(rows)), deduplicate=False)
    return out.select(*KEYS, "date", "debit", "credit", "balance")


@query("null_tokens", WITH + """
SELECT statement_id, line_no, CASE WHEN pick % 7 = 6 THEN description END AS cell FROM txn""")
def null_tokens(spark, d):
    cell = pick("", "-", " NIL ", "0.00", "N/A", "--", F.concat(F.lit("  "), F.col("description")))
    return txn(spark, d).select(*KEYS, AM.null_token(cell).alias("cell"))


@query("drop_empty", WITH + """
SELECT statement_id, line_no, category AS c0, description AS c2 FROM txn WHERE pick % 11 <> 0""")
def drop_empty(spark, d):
    keep = F.col("pick") % 11 != 0
    cells = txn(spark, d).select(
        *KEYS, F.when(keep, F.col("category")).alias("c0"), F.lit(None).cast("string").alias("c1"),
        F.when(keep, F.col("description")).alias("c2"),
    )
    return H.drop_empty(cells, ["c0", "c1", "c2"])


@query("source_dispatch", """
SELECT c_custkey AS statement_id, CASE c_custkey % 5 WHEN 1 THEN 'document'
  WHEN 2 THEN 'sheet' WHEN 3 THEN 'sheet' ELSE 'csv' END AS kind FROM customer""")
def source_dispatch(spark, d):
    end = F.get(F.lit([".csv", ".PDF", ".xlsx", ".xls", ".txt"]), (F.col("c_custkey") % 5).cast("int"))
    path = F.concat(F.lit("in/v1.2/"), F.col("c_name"), end)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("statement_id"), S.file_kind(path).alias("kind"))


@query("clean_header_cells", WITH + """
SELECT statement_id, line_no, 'Txn Date|_col1|' || description AS header, category AS cell FROM txn""")
def clean_header_cells(spark, d):
    header = F.array(F.lit(" Txn \n Date "), F.lit("Unnamed: 1"), F.concat(F.col("description"), F.lit(" ")))
    cells = F.array(F.lit("nan"), F.concat(F.lit(" "), F.col("category"), F.lit("  ")))
    return txn(spark, d).select(
        *KEYS, F.array_join(H.clean_header(header), "|").alias("header"),
        F.array_join(H.clean_cells(cells), "|").alias("cell"),
    )


@query("text_scan_guard", r"""
SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 150 AS usable FROM documents""")
def text_scan_guard(spark, d):
    good, bad = S.usable_texts(table(spark, d, "documents"))
    return good.select("doc_id", F.lit(True).alias("usable")).unionByName(
        bad.select("doc_id", F.lit(False).alias("usable")))


@query("content_key", "SELECT doc_id, md5(text) AS statement_key FROM documents")
def content_key(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.content_key(F.col("text").cast("binary")).alias("statement_key"))


# --- cells -----------------------------------------------------------------


@query("parse_amount", WITH + "SELECT statement_id, line_no, abs(amount) AS amount FROM txn")
def parse_amount(spark, d):
    return raw_txn(spark, d).select(*KEYS, AM.parse_amount(F.col("raw_amount")).alias("amount"))


@query("split_drcr", WITH + "SELECT statement_id, line_no, debit, credit FROM txn")
def split_drcr(spark, d):
    debit, credit = C.split_dr_cr(F.col("raw_amount"))
    return raw_txn(spark, d).select(*KEYS, debit.alias("debit"), credit.alias("credit"))


def signed_text() -> Column:
    credit = F.col("transaction_type") == "credit"
    mark = F.when(credit, "+").otherwise("-")
    return pick(
        F.concat(mark, F.lit(" Rs."), F.col("lakh")),
        F.concat(mark, F.lit("₹ "), F.col("lakh")),
        F.concat(F.col("lakh"), F.when(credit, " Cr").otherwise(" DR")),
    )


@query("parse_amount_signed", WITH + """
SELECT statement_id, line_no, -amount AS amount FROM txn""")
def parse_amount_signed(spark, d):
    text = F.concat(F.lit("paid "), signed_text(), F.lit(" done"))
    return raw_txn(spark, d).select(*KEYS, AM.parse_amount_signed(text).alias("amount"))


@query("parse_amount_anchored", WITH + """
SELECT statement_id, line_no, CASE WHEN pick % 5 < 3 THEN -amount ELSE -abs(amount) END AS amount FROM txn""")
def parse_amount_anchored(spark, d):
    credit = F.col("transaction_type") == "credit"
    mark = F.when(credit, "+").otherwise("-")
    text = pick(
        F.concat(mark, F.lit(" Rs."), F.col("lakh")),
        F.concat(F.col("lakh"), F.when(credit, " Cr.").otherwise(" DR")),
        F.concat(F.lit("INR "), F.col("lakh"), F.when(credit, "C").otherwise("D")),
        F.concat(F.lit("(₹"), F.col("lakh"), F.lit(")")),
        F.col("lakh"),
    )
    return raw_txn(spark, d).select(*KEYS, AM.parse_amount_anchored(text).alias("amount"))


@query("parse_amount_plain", WITH + """
SELECT statement_id, line_no, CASE WHEN pick % 4 = 3 THEN 0 ELSE abs(amount) END AS amount FROM txn""")
def parse_amount_plain(spark, d):
    text = pick(F.concat(F.lit("Rs. "), F.col("lakh")), F.concat(F.col("lakh"), F.lit(" Cr")),
                F.col("lakh"), F.lit("n/a"))
    return raw_txn(spark, d).select(*KEYS, AM.parse_amount_plain(text).alias("amount"))


@query("parse_date_multi", WITH + "SELECT statement_id, line_no, date FROM txn")
def parse_date_multi(spark, d):
    return raw_txn(spark, d).select(*KEYS, D.parse_date(F.col("raw_date")).alias("date"))


@query("parse_ts_multi", WITH + """
SELECT statement_id, line_no, CAST(date AS TIMESTAMP)
  + CASE pick % 6 WHEN 0 THEN INTERVAL '13 hours 5 minutes' WHEN 1 THEN INTERVAL '23 hours'
    ELSE INTERVAL '0 hours' END AS ts FROM txn""")
def parse_ts_multi(spark, d):
    text = pick(
        F.concat(F.date_format("date", "d MMM yyyy"), F.lit(" 13:05")),
        F.concat(F.lit("Tue, "), F.date_format("date", "dd MMM yyyy"), F.lit("  11:00 PM")),
        F.date_format("date", "MMM d, yyyy"), F.date_format("date", "dd.MM.yyyy"),
        F.date_format("date", "d MMM ''yy"), F.date_format("date", "dd MMMM yyyy"),
    )
    return txn(spark, d).select(*KEYS, D.parse_timestamp(text).alias("ts"))


@query("unify_amount", WITH + "SELECT statement_id, line_no, amount, transaction_type FROM txn")
def unify_amount(spark, d):
    rows = txn(spark, d).select(*KEYS, "debit", "credit")
    return C.unify_amount(rows).select(*KEYS, "amount", "transaction_type")


@query("normalize_merchant", RAW + r"""
, s AS (SELECT statement_id, line_no, regexp_extract_all(trim(regexp_replace(regexp_replace(
  regexp_replace(trim(narration), '[#/]\s*\d+\s*$', ''), '\s+\d{4,}\s*$', ''),
  '\s*-\s*\d{4,}\s*$', '')), '([a-zA-Z]+|[^a-zA-Z]+)') AS w FROM raw)
SELECT statement_id, line_no, coalesce(array_to_string(list_transform(w,
  lambda x: upper(x[1]) || lower(x[2:])), ''), '') AS merchant FROM s""")
def normalize_merchant(spark, d):
    return raw_txn(spark, d).select(
        *KEYS, T.normalize_merchant(F.col("narration")).alias("merchant"))


@query("month_year", WITH + "SELECT statement_id, line_no, strftime(date, '%b %Y') AS month_year FROM txn")
def month_year(spark, d):
    return txn(spark, d).select(*KEYS, D.month_year(F.col("date")).alias("month_year"))


@query("scrub_description", RAW + r"""
SELECT statement_id, line_no, left(regexp_replace(trim(regexp_replace(array_to_string(list_filter(
  regexp_split_to_array(trim(narration || ' ' || pick || '  REF1234567 X98765432 12-3456789'), '\s+'),
  lambda x: NOT regexp_matches(x, '^\d+$')), ' '), '\b\d{6,}\b', '', 'g')), '\s{2,}', ' ', 'g'), 200)
  AS description FROM raw""")
def scrub_description(spark, d):
    text = F.concat(F.col("narration"), F.lit(" "), F.col("pick").cast("string"),
                    F.lit("  REF1234567 X98765432 12-3456789"))
    return raw_txn(spark, d).select(*KEYS, T.scrub_description(text).alias("description"))


@query("bank_desc_clean", WITH + """
SELECT statement_id, line_no, CASE WHEN pick % 4 = 3 THEN 'RTGS CR-' || description || ' 1234567'
  ELSE description END AS description FROM txn""")
def bank_desc_clean(spark, d):
    body = F.col("description")
    issuer = pick("SBI", "HDFC", "ICICI", "Axis")
    text = pick(F.concat(F.lit("BY TRANSFER-"), body, F.lit(" 1234567")),
                F.concat(body, F.lit(" - 123456789")), F.concat(body, F.lit(" REF NO. AB123456")),
                F.concat(F.lit("RTGS CR-"), body, F.lit(" 1234567")))
    return txn(spark, d).select(*KEYS, T.clean_by_issuer(issuer, text).alias("description"))


@query("first_payload_line", WITH + "SELECT statement_id, line_no, description AS payee FROM txn")
def first_payload_line(spark, d):
    cell = F.concat(F.lit(" \nUPI Ref No: 12\r"), F.col("description"), F.lit("\nOrder ID 9"))
    return txn(spark, d).select(*KEYS, T.first_payload_line(cell).alias("payee"))


@query("clean_account", WITH + "SELECT statement_id, line_no, description || ' Bank' AS account FROM txn")
def clean_account(spark, d):
    text = F.concat(F.lit(" "), F.col("description"), F.lit(" Bank "), pick("- ", "– "),
                    F.lit("24 "))
    return txn(spark, d).select(*KEYS, T.clean_account(text).alias("account"))


@query("repair_name", WITH + """
, w AS (SELECT *, list_transform(string_split(description, ' '),
        lambda x: upper(x[1]) || lower(x[2:])) AS words FROM txn)
SELECT statement_id, line_no, CASE WHEN pick % 4 = 2 THEN 'Family Restaurant'
  WHEN pick % 4 = 3 AND transaction_type = 'credit' THEN upper(description)
  ELSE array_to_string(words, ' ') END AS name FROM w""")
def repair_name(spark, d):
    title = F.initcap("description")
    raw = pick(F.replace(title, F.lit(" ")), F.replace(title, F.lit(" ")),
               F.lit("FamilyRestaurant"), F.upper("description"))
    return txn(spark, d).select(
        *KEYS, T.repair_name(raw, F.col("transaction_type") == "credit").alias("name"))


LAKH_SQL = """
, n AS (SELECT statement_id, line_no, amount, CAST(CAST(trunc(abs(amount) * {k}) AS BIGINT) AS VARCHAR)
        AS s FROM txn),
g AS (SELECT *, CASE WHEN length(s) > 3 THEN left(s, length(s) - 3) ELSE '' END AS hi,
      right(s, 3) AS lo FROM n),
t AS (SELECT *, CASE WHEN hi = '' THEN lo ELSE concat_ws(',',
        nullif(left(hi, greatest(length(hi) - 4, 0)), ''),
        nullif(right(left(hi, greatest(length(hi) - 2, 0)), 2), ''), right(hi, 2), lo) END AS body
      FROM g)
SELECT statement_id, line_no, CASE WHEN amount < 0 THEN '-' ELSE '' END || '₹' || body AS inr FROM t"""


@query("format_inr", WITH + LAKH_SQL.format(k="100.0"))
def format_inr(spark, d):
    return txn(spark, d).select(
        *KEYS, money.format_inr(F.col("amount") * F.lit(100.0)).alias("inr"))


@query("format_inr_compact", WITH + """
, v AS (SELECT statement_id, line_no, CASE CAST(pick % 4 AS INT) WHEN 0 THEN abs(amount) * 1000
        WHEN 1 THEN abs(amount) * 20 WHEN 2 THEN abs(amount) ELSE abs(amount) / 1000 END AS x FROM txn)
SELECT statement_id, line_no, 'Rs.' || CASE
  WHEN x >= 1e7 THEN format('{:.1f}', round_even(x / 1e7 * 10, 0) / 10) || 'Cr'
  WHEN x >= 1e5 THEN format('{:.1f}', round_even(x / 1e5 * 10, 0) / 10) || 'L'
  WHEN x >= 1e3 THEN format('{:,}', CAST(round_even(x, 0) AS BIGINT))
  ELSE format('{}', CAST(round_even(x, 0) AS BIGINT)) END AS inr FROM v""")
def format_inr_compact(spark, d):
    size = F.abs("amount")
    x = pick(size * 1000, size * 20, size, size / 1000)
    return txn(spark, d).select(*KEYS, money.format_inr_compact(x).alias("inr"))


@query("latin1_safe", WITH + """
SELECT statement_id, line_no, left('Rs.5 - ' || description || '?...', 200) AS label FROM txn""")
def latin1_safe(spark, d):
    text = F.concat(F.lit("₹5 — "), F.col("description"), F.lit("अ…"))
    return txn(spark, d).select(*KEYS, money.latin1_safe(text).alias("label"))


@query("find_column", WITH + """
SELECT statement_id, line_no, CAST(CASE pick % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS INT) AS at FROM txn""")
def find_column(spark, d):
    headers = pick(
        F.lit(["my closing balance", "balance", "date"]), F.lit(["date", "debit", "closing balance rs"]),
        F.array(F.lit("date"), F.col("description")))
    from munim.rules.tokens import BALANCE_HEADERS

    return txn(spark, d).select(*KEYS, T.find_column(headers, BALANCE_HEADERS).alias("at"))


@query("day_mon_time", WITH + """
SELECT statement_id, line_no, CAST(date AS TIMESTAMP) + CASE pick % 4
  WHEN 0 THEN INTERVAL '23 hours 39 minutes' WHEN 1 THEN INTERVAL '0 hours 5 minutes'
  WHEN 2 THEN INTERVAL '12 hours' ELSE INTERVAL '0 hours' END AS ts FROM txn""")
def day_mon_time(spark, d):
    day = F.date_format("date", "d MMM")
    text = F.concat(day, F.lit("\n"), pick("11:39 PM", "12:05 AM", "12:00pm", ""))
    return txn(spark, d).select(
        *KEYS, D.timestamp_of(F.year("date"), D.day_month_time(text)).alias("ts"))


# --- rows ------------------------------------------------------------------


@query("drop_bad_dates", WITH + """
SELECT statement_id, count(*) FILTER (pick % 9 <> 0) AS kept, count(*) FILTER (pick % 9 = 0) AS rejected
FROM txn GROUP BY 1""")
def drop_bad_dates(spark, d):
    text = F.when(F.col("pick") % 9 == 0, "31-02-2024").otherwise(F.col("raw_date"))
    rows = raw_txn(spark, d).select("statement_id", D.parse_date(text).alias("date"))
    return filters.rejected_dates(rows, ["statement_id"])


@query("drop_zero_amount", WITH + """
SELECT statement_id, line_no, amount FROM txn WHERE transaction_type = 'debit' AND pick % 5 <> 0""")
def drop_zero_amount(spark, d):
    amount = F.when(F.col("pick") % 5 == 0, 0.0).otherwise(F.col("amount"))
    return filters.with_amount(txn(spark, d).select(*KEYS, amount.alias("amount")))


@query("skip_noise", WITH + """
SELECT statement_id, line_no, description AS line FROM txn WHERE pick % 4 = 3""")
def skip_noise(spark, d):
    line = pick(F.lit("Page 5 of 30"), F.concat(F.lit("Opening  balance: "), F.col("description")),
                F.lit(" For any queries call"), F.col("description"))
    return filters.without_noise(txn(spark, d).select(*KEYS, line.alias("line")))


@query("exclude_self_transfer", WITH + """
SELECT statement_id, line_no, description FROM txn WHERE pick % 3 <> 0""")
def exclude_self_transfer(spark, d):
    text = F.when(F.col("pick") % 3 == 0, F.concat(F.col("description"), F.lit(" SELF  transfer")))
    rows = txn(spark, d).select(*KEYS, F.coalesce(text, F.col("description")).alias("description"))
    return filters.without_self_transfers(rows)


@query("refund_flag", RAW + r"""
SELECT statement_id, line_no, regexp_matches(narration,
  '(?i)\b(refund|reversal|reversed|cashback|cash[\s\-]?back|reward|revert)\b') AS is_refund FROM raw""")
def refund_flag(spark, d):
    return raw_txn(spark, d).select(*KEYS, T.is_refund(F.col("narration")).alias("is_refund"))


@query("validate_contract", WITH + """
SELECT statement_id, count(*) AS row_count, count(*) FILTER (pick % 13 = 0) AS null_date,
  0::BIGINT AS null_amount, 0::BIGINT AS null_transaction_type, count(*) FILTER (pick % 17 = 0) AS bad_type,
  count(*) FILTER (pick % 13 = 0) + count(*) FILTER (pick % 17 = 0) = 0 AS is_valid
FROM txn GROUP BY 1""")
def validate_contract(spark, d):
    rows = txn(spark, d).select(
        "statement_id", F.when(F.col("pick") % 13 != 0, F.col("date")).alias("date"), "description",
        "amount", F.when(F.col("pick") % 17 == 0, "other").otherwise(F.col("transaction_type"))
        .alias("transaction_type"), F.lit("CSV").alias("bank_source"),
    )
    return contract_report(rows, ["statement_id"])


@query("to_interchange", WITH + """
SELECT statement_id, line_no, -amount AS amount, transaction_type, 'CSV' AS bank_source,
  'CSV Import' AS account FROM txn""")
def to_interchange(spark, d):
    return C.to_interchange(txn(spark, d), "CSV", "CSV Import").drop("date", "description")


@query("to_pipeline", WITH + """
SELECT statement_id, line_no, date, description, debit, credit, 0.0::DOUBLE AS balance, amount,
  transaction_type, strftime(date, '%b %Y') AS month_year, 'CSV' AS bank_source, 'CSV Import' AS account
FROM txn""")
def to_pipeline(spark, d):
    out = C.to_pipeline(C.to_interchange(txn(spark, d), "CSV", "CSV Import"))
    return out


@query("document_to_interchange", WITH + """
SELECT statement_id, line_no, date, description, CASE transaction_type WHEN 'debit' THEN -abs(amount)
  ELSE abs(amount) END AS amount, transaction_type, 'HDFC' AS bank_source, '' AS account FROM txn""")
def document_to_interchange(spark, d):
    return C.document_to_interchange(txn(spark, d).select(
        *KEYS, "date", "description", F.abs("amount").alias("amount"), "transaction_type",
        F.lit("HDFC").alias("bank_source")))


@query("records_normalize", WITH + """
SELECT statement_id, line_no, abs(amount) AS amount, transaction_type, CASE pick % 3
  WHEN 0 THEN description || ' | note | UPI Ref 1' WHEN 1 THEN description ELSE 'note' END AS description
FROM txn""")
def records_normalize(spark, d):
    records = txn(spark, d).select(
        *KEYS, "date", pick(F.col("description"), F.col("description"), F.lit("")).alias("description"),
        pick(F.lit("note"), F.col("description"), F.lit("note")).alias("notes"),
        pick("UPI Ref 1", "", "").alias("meta"), (-F.col("amount")).alias("raw_amount"),
    )
    return C.records_normalize(records, F.lit("HDFC")).drop("date", "bank_source")


@query("post_process", WITH + """
, p AS (SELECT statement_id, line_no, date, abs(amount) AS amount,
        trim(regexp_replace(description || ' 1234567', '\\b\\d{6,}\\b', '')) AS description FROM txn)
SELECT *, row_number() OVER (PARTITION BY statement_id, date, amount, description ORDER BY line_no) > 1
  AS is_duplicate FROM p""")
def post_process(spark, d):
    rows = stored(txn(spark, d).select(*KEYS, "date", "amount", "description"))
    return C.post_process(rows.withColumn("description", F.concat(F.col("description"), F.lit(" 1234567"))))


# --- duplicates and balances -----------------------------------------------


def coarse(df: DataFrame) -> DataFrame:
    """``txn`` with months for dates and coarse amounts, so that copies occur."""
    return df.withColumns({
        "date": F.trunc("date", "MM").cast("date"), "debit": F.round("debit", -5),
        "credit": F.round("credit", -5), "amount": F.round("amount", -5)})


COARSE_SQL = WITH + """
, c AS (SELECT statement_id, line_no, CAST(date_trunc('month', date) AS DATE) AS date, description,
        round(debit, -5) AS debit, round(credit, -5) AS credit, round(amount, -5) AS amount FROM txn)"""


@query("dedup_exact", COARSE_SQL + """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
  PARTITION BY statement_id, date, description, debit, credit ORDER BY line_no) AS r FROM c) WHERE r = 1""")
def dedup_exact(spark, d):
    return C.dedup_exact(coarse(txn(spark, d)).select(
        *KEYS, "date", "description", "debit", "credit", "amount"))


@query("flag_duplicates", COARSE_SQL + """
SELECT statement_id, line_no, row_number() OVER (
  PARTITION BY statement_id, date, amount, description ORDER BY line_no) > 1 AS is_duplicate FROM c""")
def flag_duplicates(spark, d):
    return C.flag_duplicates(coarse(txn(spark, d))).select(*KEYS, "is_duplicate")


@query("running_balance", WITH + """
SELECT statement_id, line_no, (8500000 + sum(CAST(round(credit * 100) AS BIGINT)
  - CAST(round(debit * 100) AS BIGINT)) OVER (PARTITION BY statement_id ORDER BY date, line_no
  ROWS UNBOUNDED PRECEDING))::DOUBLE / 100.0 AS balance FROM txn""")
def running_balance(spark, d):
    out = C.running_balance(txn(spark, d), 85000.0, [F.col("date")])
    return out.select(*KEYS, "balance")
