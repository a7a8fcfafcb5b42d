"""Synthetic six-month ledgers, one per given statement.

Every value is a function of a hash of (seed, statement, row), so a lost task is
recomputed to the same rows and no random state is shared.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from munim.functions.binding import once
from munim.operators.clean import running_balance
from munim.rules import ledger_profile as L

KEY = "statement_id"


def uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) from an MD5 of the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def synthetic_ledger(statements: DataFrame, seed: int = 42) -> DataFrame:
    """800 rows per statement plus five planted unusual ones, with a running balance.

    Six salaries, one to three further incomes a month, and weighted spending.
    """
    u = lambda name, *p: uniform(seed, F.col(KEY), F.lit(name), *p)
    i = F.col("i")
    between = lambda lo, hi, x: F.rint((lo + (hi - lo) * x) * 100.0) / F.lit(100.0)
    choose = lambda options, x: F.get(F.lit(options), F.floor(x * len(options)).cast("int"))
    extra = sum((1 + F.floor(u("k", F.lit(m)) * 3) for m in range(L.MONTHS)), F.lit(0))
    slots = L.MONTHS * 4
    # A few input rows become hundreds each, so they are spread before they grow.
    spread = statements.repartition(statements.sparkSession.sparkContext.defaultParallelism, KEY)
    rows = once(spread, F.struct(extra.alias("_extra")), keep=[KEY]).select(
        KEY, "_extra", F.explode(F.sequence(F.lit(0), F.lit(L.ROWS + slots))).alias("i"))
    salary, income = i < L.MONTHS, (i >= L.MONTHS) & (i < slots)
    month0 = F.floor((i - L.MONTHS) / 3).cast("int")
    kept = salary | (income & ((i - L.MONTHS) % 3 < 1 + F.floor(u("k", month0) * 3))) | (
        (i >= slots) & (i - slots < L.ROWS - L.MONTHS - F.col("_extra")))
    day = lambda m, d: F.make_date(F.lit(L.YEAR), m.cast("int"), d.cast("int"))
    date = (
        F.when(salary, day(i + 1, F.lit(1)))
        .when(income, day(month0 + 1, 5 + F.floor(u("d", i) * 24)))
        .otherwise(day(1 + F.floor(u("m", i) * L.MONTHS), 1 + F.floor(u("d", i) * 28)))
    )
    bounds = list(accumulate(v[0] for v in L.SPENDING.values()))
    pick = u("c", i) * 100
    spend = F.coalesce(*[
        F.when(pick < top, F.struct(
            choose(texts, u("t", i)).alias("text"), between(lo, hi, u("a", i)).alias("amount")))
        for top, (_, lo, hi, texts) in zip(bounds, L.SPENDING.values())
    ])
    number = (1000 + F.floor(u("n", i) * 998999)).cast("string")
    drawn = rows.where(kept).withColumn("_s", F.when(i >= slots, spend)).select(
        KEY, i.cast("bigint").alias("line_no"), date.alias("date"),
        F.when(salary, choose(L.SALARIES, u("t", i))).when(income, choose(L.INCOMES, u("t", i)))
        .otherwise(F.replace(F.col("_s.text"), F.lit("{num}"), number)).alias("description"),
        F.when(i >= slots, F.col("_s.amount")).otherwise(0.0).alias("debit"),
        F.when(salary, between(*L.SALARY_RANGE, u("a", i)))
        .when(income, between(*L.INCOME_RANGE, u("a", i))).otherwise(0.0).alias("credit"),
    )
    planted = statements.select(KEY, F.inline(F.array(*[
        F.struct(F.lit(L.ROWS + slots + 1 + n).cast("bigint").alias("line_no"),
                 F.lit(d).cast("date").alias("date"), F.lit(t).alias("description"),
                 F.lit(a).alias("debit"), F.lit(0.0).alias("credit"))
        for n, (d, t, a) in enumerate(L.PLANTED)])))
    return running_balance(drawn.unionByName(planted), L.OPENING_BALANCE)
