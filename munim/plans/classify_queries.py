"""Queries and oracles: classification, recurring charges, name similarity."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from munim.operators import classify as K, recurring as R
from munim.plans.aggregate_queries import total
from munim.plans.fixtures import NARRATED_SQL, narrated, table, txn
from munim.plans.registry import query
from munim.rules.keywords import KEYWORDS
from munim.rules.merchants import WHOLE_WORD_MERCHANTS
from munim.rules.tokens import BUSINESS_WORDS, HONORIFICS, RECURRING_NOISE, SUBSCRIPTION_WORDS

WITH = "WITH " + NARRATED_SQL
KEYS = ["statement_id", "line_no"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def sql_merchant(text: str) -> str:
    """``category|subcategory`` of the merchant in a text, else NULL."""
    rules = K.default_merchants()
    cases = " ".join(
        f"WHEN {quoted(m.keyword)} THEN {quoted(m.category + '|' + m.subcategory)}" for m in rules)
    whole = lambda k: (len(k) <= 3 and k.isalpha()) or k in WHOLE_WORD_MERCHANTS
    keys = sorted((m.keyword for m in rules), key=lambda k: -len(k))
    plain = lambda k: re.sub(r"([^\w\s])", r"\\\1", k)
    pattern = "(?i)(" + "|".join(
        rf"\b{plain(k)}\b" if whole(k) else plain(k) for k in keys) + ")"
    return f"(CASE lower(regexp_extract({text}, {quoted(pattern)}, 1)) {cases} END)"


def sql_keyword(text: str) -> str:
    """``category|subcategory`` of the longest keyword in a text, else NULL."""
    ranked = sorted(KEYWORDS, key=lambda k: -len(k[0]))
    return "(CASE " + " ".join(
        f"WHEN regexp_matches({text}, {quoted('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}) "
        f"THEN {quoted(c + '|' + s)}" for p, c, s in ranked) + " END)"


def sql_upi(text: str) -> str:
    name = f"trim(regexp_extract({text}, '(?i)UPI[-/](?:[A-Z0-9]+[-/])?([^@/\\-]{{3,30}})(?:[@/\\-]|$)', 1))"
    return f"(CASE WHEN length({name}) >= 3 AND NOT regexp_matches({name}, '^\\d+$') THEN {name} END)"


def sql_person(text: str) -> str:
    biz = sql_list(BUSINESS_WORDS)
    words = f"regexp_split_to_array(lower({text}), '\\s+')"
    bare = f"list_transform({words}, lambda w: rtrim(w, '.,'))"
    handle = f"regexp_split_to_array(lower(trim(string_split({text}, '@')[1])), '[\\s_\\-]+')"
    honor = "|".join(HONORIFICS)
    return f"""(CASE WHEN length({text}) > 80 THEN NULL
  WHEN regexp_matches({words}[1], '^({honor})\\.*$') AND len({words}) >= 2
    AND NOT list_has_any({bare}[2:], {biz}) THEN '3'
  WHEN contains({text}, '@') AND len({handle}) BETWEEN 2 AND 4 AND NOT list_has_any({handle}, {biz})
    AND len(list_filter({handle}, lambda w: NOT regexp_matches(w, '^[a-z]+$'))) = 0 THEN '2'
  WHEN len({words}) BETWEEN 2 AND 4 AND NOT list_has_any({bare}, {biz})
    AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[a-z]{{2,15}}$'))) = 0 THEN '1' END)"""


REFUND_SQL = r"(?i)\b(refund|reversal|reversed|cashback|cash[\s\-]?back|reward|revert)\b"
CLASSIFY_SQL = WITH + f"""
, a AS (SELECT *, trim(narration) AS t, regexp_matches(narration, '{REFUND_SQL}') AS rf FROM raw),
b AS (SELECT *, {sql_upi('t')} AS u FROM a),
c AS (SELECT *, {sql_merchant('t')} AS m1, {sql_merchant('u')} AS m2, {sql_person('t')} AS p1,
      {sql_person('u')} AS p2, {sql_keyword('t')} AS k1, {sql_keyword('u')} AS k2 FROM b),
e AS (SELECT *, CASE
  WHEN transaction_type = 'credit' AND rf THEN 'Income and Salary|Refund'
  WHEN transaction_type = 'credit' THEN 'Income and Salary|Salary'
  WHEN t = '' THEN 'Uncategorized|Unmatched' WHEN rf THEN 'Income and Salary|Refund'
  WHEN m1 IS NOT NULL THEN m1 WHEN m2 IS NOT NULL THEN m2
  WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN 'Personal Transfer|Peer Transfer'
  WHEN k1 IS NOT NULL THEN k1 WHEN k2 IS NOT NULL THEN k2
  WHEN debit >= 50000 THEN 'Investment and Savings|Large Transfer'
  WHEN debit >= 10000 THEN 'Transfer and Banking|Bank Transfer'
  ELSE 'Uncategorized|Unmatched' END AS cs,
  CASE WHEN rf THEN 'global_override' WHEN transaction_type = 'credit' THEN 'credit_type'
  WHEN t = '' THEN 'unmatched' WHEN m1 IS NOT NULL THEN 'exact_merchant'
  WHEN m2 IS NOT NULL THEN 'upi_parsed' WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN 'person_name_detected'
  WHEN k1 IS NOT NULL THEN 'keyword' WHEN k2 IS NOT NULL THEN 'upi_parsed'
  WHEN debit >= 10000 THEN 'heuristic' ELSE 'unmatched' END AS match_confidence FROM c),
cl AS (SELECT statement_id, line_no, t AS description, split_part(cs, '|', 1) AS category,
  split_part(cs, '|', 2) AS subcategory, match_confidence,
  CASE WHEN match_confidence IN ('global_override', 'credit_type', 'exact_merchant') THEN 1.0
    WHEN match_confidence = 'upi_parsed' AND m2 IS NOT NULL THEN 0.95
    WHEN match_confidence = 'upi_parsed' THEN 0.7
    WHEN match_confidence = 'person_name_detected' AND p1 IS NOT NULL THEN 0.85
    WHEN match_confidence = 'person_name_detected' THEN 0.8
    WHEN match_confidence = 'keyword' THEN 0.8
    WHEN match_confidence = 'heuristic' THEN CASE WHEN debit >= 50000 THEN 0.4 ELSE 0.35 END
    ELSE 0.0 END::DOUBLE AS confidence,
  CASE match_confidence WHEN 'global_override' THEN 'refund_reversal_cashback'
    WHEN 'exact_merchant' THEN CASE WHEN cs LIKE 'Loan and EMI|%' THEN 'possible_loan' ELSE '' END
    WHEN 'upi_parsed' THEN CASE WHEN m2 IS NULL THEN 'upi_keyword' ELSE 'upi_extracted;' ||
      CASE WHEN cs LIKE 'Loan and EMI|%' THEN 'possible_loan' ELSE '' END END
    WHEN 'person_name_detected' THEN CASE WHEN p1 IS NULL THEN 'personal_transfer;upi_name;condition=' || p2
      ELSE 'personal_transfer' || CASE WHEN debit <> 0 AND debit <= 2000 THEN ',possible_split' ELSE '' END
        || ';condition=' || p1 END
    WHEN 'keyword' THEN CASE WHEN cs LIKE '%|Rent' THEN 'possible_rent' ELSE '' END
    WHEN 'heuristic' THEN CASE WHEN debit >= 50000 THEN 'large_amount' ELSE 'medium_amount' END
    ELSE '' END AS match_notes
  FROM e)"""


@query("classify", CLASSIFY_SQL + " SELECT * EXCLUDE (description) FROM cl")
def classify(spark, d):
    return K.classify(narrated(spark, d)).select(
        *KEYS, "category", "subcategory", "confidence", "match_confidence", "match_notes")


@query("merchant_lookup", WITH + f"""
, m AS (SELECT statement_id, line_no, {sql_merchant('narration')} AS cs FROM raw)
SELECT statement_id, line_no, split_part(cs, '|', 1) AS category, split_part(cs, '|', 2) AS subcategory
FROM m WHERE cs IS NOT NULL""")
def merchant_lookup(spark, d):
    rows = narrated(spark, d).withColumn("m", K.merchant_lookup(F.col("description")))
    return rows.where("m IS NOT NULL").select(*KEYS, "m.*")


@query("merchant_lookup_table", WITH + """
, k AS (SELECT lower(trim(p_name)) AS key, min((p_type, p_brand)) AS cs FROM part GROUP BY 1),
n AS (SELECT DISTINCT lower('POS ' || description || ' ' || category || ' ' || (statement_id % 7)) AS t FROM txn),
h AS (SELECT t, arg_min(cs, (strpos(t, key), -length(key))) AS cs FROM n JOIN k ON contains(t, key) GROUP BY t)
SELECT statement_id, line_no, cs[1] AS category, cs[2] AS subcategory
FROM txn JOIN h ON t = lower('POS ' || description || ' ' || category || ' ' || (statement_id % 7))""")
def merchant_lookup_table(spark, d):
    table_ = table(spark, d, "part").select(
        F.col("p_name").alias("keyword"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"))
    rows = txn(spark, d).select(*KEYS, F.concat(
        F.lit("POS "), "description", F.lit(" "), "category", F.lit(" "),
        (F.col("statement_id") % 7).cast("string")).alias("text"))
    return K.with_merchants(rows, "text", table_, "m").where("m IS NOT NULL").select(*KEYS, "m.*")


@query("keyword_lookup", WITH + f"""
, m AS (SELECT statement_id, line_no, {sql_keyword('narration')} AS cs FROM raw)
SELECT statement_id, line_no, split_part(cs, '|', 1) AS category, split_part(cs, '|', 2) AS subcategory
FROM m WHERE cs IS NOT NULL""")
def keyword_lookup(spark, d):
    rows = narrated(spark, d).withColumn("rank", K.keyword_rank(F.col("description")))
    return rows.where("rank IS NOT NULL").withColumn(
        "k", K.keyword_lookup(F.col("rank"))).select(*KEYS, "k.*")


@query("person_name", WITH + f"SELECT statement_id, line_no, {sql_person('trim(narration)')} AS rule FROM raw")
def person_name(spark, d):
    return narrated(spark, d).select(*KEYS, K.person_rule(F.col("description")).alias("rule"))


@query("upi_extract", WITH + f"SELECT statement_id, line_no, {sql_upi('narration')} AS payee FROM raw")
def upi_extract(spark, d):
    return narrated(spark, d).select(*KEYS, K.upi_payee(F.col("description")).alias("payee"))


@query("person_condition_counts", CLASSIFY_SQL + r"""
SELECT regexp_extract(match_notes, 'condition=(\d)', 1) AS condition, count(*) AS n FROM cl
WHERE match_confidence = 'person_name_detected' GROUP BY 1""")
def person_condition_counts(spark, d):
    return K.person_condition_counts(K.classify(narrated(spark, d)))


@query("near_miss_business", CLASSIFY_SQL + f"""
SELECT statement_id, line_no, description, category FROM cl
WHERE regexp_matches(description, '^[a-zA-Z]+(\\s+[a-zA-Z]+){{1,3}}$') AND category <> 'Personal Transfer'
  AND list_has_any(regexp_split_to_array(lower(description), '\\s+'), {sql_list(BUSINESS_WORDS)})""")
def near_miss_business(spark, d):
    return K.near_miss_business(K.classify(narrated(spark, d))).select(*KEYS, "description", "category")


@query("personal_transfers", CLASSIFY_SQL + """
SELECT statement_id, line_no, description FROM cl WHERE category = 'Personal Transfer'""")
def personal_transfers(spark, d):
    return K.personal_transfers(K.classify(narrated(spark, d))).select(*KEYS, "description")


@query("uncategorized", CLASSIFY_SQL + """
SELECT statement_id, line_no, description FROM cl WHERE category = 'Uncategorized'""")
def uncategorized(spark, d):
    return K.uncategorized(K.classify(narrated(spark, d))).select(*KEYS, "description")


RECURRING_SQL = WITH + f"""
, d1 AS (SELECT statement_id, date, narration AS description, round_even(debit, 0) / 100.0 AS debit FROM raw
         WHERE transaction_type = 'debit'),
d2 AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(
  regexp_replace(lower(trim(description)), '[^a-z0-9\\s]', ' ', 'g'),
  '{RECURRING_NOISE}', ' ', 'g')), '\\s+'), lambda w: length(w) > 1)[1:3], ' ') AS k FROM d1),
nm AS (SELECT statement_id, k, description, row_number() OVER (PARTITION BY statement_id, k
       ORDER BY count(*) DESC, description) AS r FROM d2 GROUP BY statement_id, k, description),
g AS (SELECT statement_id, k, count(*) AS frequency, {total('debit')} AS tot,
      {total('debit')} / count(*) AS mean, stddev_pop(debit) AS sd,
      count(DISTINCT date_trunc('month', date)) AS months_active FROM d2 GROUP BY ALL),
rec AS (SELECT g.statement_id, description AS merchant, frequency,
  round_even(mean * 100.0, 0) / 100.0 AS avg_amount, round_even(tot * 100.0, 0) / 100.0 AS total_spent,
  CAST(months_active AS INT) AS months_active, sd / mean < 0.2 AND (mean <= 1500
    OR regexp_matches(description, '(?i)({SUBSCRIPTION_WORDS})')) AS likely_subscription
FROM g JOIN nm ON g.statement_id = nm.statement_id AND g.k = nm.k AND r = 1
WHERE length(g.k) >= 2 AND frequency >= 2 AND months_active >= 2)"""


def small_charges(spark, d):
    return narrated(spark, d).withColumn("debit", F.rint("debit") / F.lit(100.0))


@query("recurring_merchants", RECURRING_SQL + " SELECT * FROM rec")
def recurring_merchants(spark, d):
    return R.recurring_merchants(small_charges(spark, d))


@query("dear_subscriptions", RECURRING_SQL + """
SELECT statement_id, merchant, avg_amount, avg_amount * 12 AS yearly_saving FROM rec
WHERE likely_subscription AND avg_amount > 200""")
def dear_subscriptions(spark, d):
    return R.dear_subscriptions(R.recurring_merchants(small_charges(spark, d)))


@query("subscription_rollup", RECURRING_SQL + f"""
SELECT statement_id, count(*) AS recurring_count,
  count(*) FILTER (likely_subscription) AS subscription_count,
  coalesce({total('CASE WHEN likely_subscription THEN avg_amount END')}, 0) AS monthly_cost,
  coalesce({total('CASE WHEN likely_subscription AND avg_amount > 200 THEN avg_amount * 12 END')}, 0)
    AS yearly_saving FROM rec GROUP BY 1""")
def subscription_rollup(spark, d):
    return R.subscription_rollup(R.recurring_merchants(small_charges(spark, d)))


@query("merchant_similarity", """
WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
g AS (SELECT name, list_distinct(list_transform(range(1, length(name)),
      lambda i: substring(name, i::INT, 2))) AS g FROM n),
p AS (SELECT a.name AS name_a, b.name AS name_b, len(list_intersect(a.g, b.g)) AS s,
      len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.name < b.name),
h AS (SELECT name_a AS name, name_b AS partner, s / (na + nb - s) AS similarity FROM p
      WHERE s / (na + nb - s) >= 0.6),
b AS (SELECT * FROM h UNION ALL SELECT partner, name, similarity FROM h)
SELECT name, arg_min(partner, (-similarity, partner)) AS partner, max(similarity) AS similarity FROM b GROUP BY name""")
def merchant_similarity(spark, d):
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return R.similar_names(names)


@query("merchant_groups", """
WITH RECURSIVE n AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
g AS (SELECT name, list_distinct(list_transform(range(1, length(name)),
      lambda i: substring(name, i::INT, 2))) AS g FROM n),
p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.g, b.g)) AS s, len(a.g) + len(b.g) AS m
      FROM g a JOIN g b ON a.name < b.name),
h AS (SELECT a, b FROM p WHERE s / (m - s) >= 0.6),
b AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT name, name AS seen FROM n UNION SELECT r.name, b.b FROM r JOIN b ON r.seen = b.a),
c AS (SELECT a AS name, count(*) AS n_links FROM b GROUP BY 1)
SELECT name, min(seen) AS class_id, coalesce(any_value(n_links), 0) AS n_links
FROM r LEFT JOIN c USING (name) GROUP BY name""")
def merchant_groups(spark, d):
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return R.similar_groups(names)
