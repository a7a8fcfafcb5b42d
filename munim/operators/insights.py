"""Scores, labels and texts: one row of facts per statement, then plain expressions.

:func:`facts` reads the transactions once and adds the forecast; every insight is a
projection of that row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from munim.functions import money
from munim.functions.dates import month_start
from munim.functions.money import fixed, format_inr, format_inr_paise, whole_number
from munim.operators import aggregates as AG
from munim.operators.anomaly import top_anomalies
from munim.rules import messages as M

KEY = AG.KEY
SAVINGS_TARGET = 20.0


def say(template: str, **values: Column) -> Column:
    """Message text with its placeholders filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p
    ])


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def statement_stats(df: DataFrame) -> DataFrame:
    """Summary, two dearest categories and flagged charges of each statement, in one read.

    Rows are combined per (statement, category, month, direction) before the shuffle; what
    follows aggregates those few rows to categories and then to statements.
    """
    debit = F.col("transaction_type") == "debit"
    money_of = lambda c: F.sum(F.round(c * money.FINE).cast("bigint"))
    rupees = lambda c: F.coalesce(F.sum(c), F.lit(0)) / F.lit(float(money.FINE))
    small = df.groupBy(KEY, "category", month_start(F.col("date")).alias("_month"), debit.alias("_d")).agg(
        money_of(F.when(debit, F.col("debit")).otherwise(F.col("credit"))).alias("_sum"),
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last"),
        F.count_if(F.col("is_anomaly")).alias("_an"),
        money_of(F.when(F.col("is_anomaly"), F.abs("amount"))).alias("_as"))
    spent = lambda c: F.when(F.col("_d"), F.col(c))
    per = small.groupBy(KEY, "category").agg(
        F.sum(spent("_sum")).alias("_debit"), F.sum(F.when(~F.col("_d"), F.col("_sum"))).alias("_credit"),
        F.sum(spent("_n")).alias("_dn"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"), F.sum("_an").alias("_an"), F.sum("_as").alias("_as"),
        F.collect_set("_month").alias("_months"), F.collect_set(spent("_month")).alias("_spent_in"))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    dear = F.array_sort(F.collect_list(F.when(F.col("_dn") > 0, F.struct(
        (-F.coalesce("_debit", F.lit(0))).alias("cost"), "category"))))
    one = per.groupBy(KEY).agg(
        rupees("_debit").alias("total_debits"), rupees("_credit").alias("total_credits"),
        F.sum("_n").alias("transaction_count"),
        F.struct(F.min("_first").alias("min"), F.max("_last").alias("max")).alias("date_range"),
        distinct("_months").cast("long").alias("n_months"), distinct("_spent_in").alias("_spent_months"),
        dear.alias("_dear"), F.sum("_an").alias("total_anomalies"), rupees("_as").alias("total_flagged_amount"))
    nth = lambda i: F.get("_dear", F.lit(i))
    cost = lambda i: -nth(i)["cost"] / F.lit(float(money.FINE))
    return one.select(
        KEY, "total_debits", "total_credits",
        (F.col("total_credits") - F.col("total_debits")).alias("net_cashflow"), "transaction_count",
        "date_range", money.ratio(F.col("total_debits"), F.col("_spent_months"), 0.0).alias("avg_monthly_spend"),
        "n_months", nth(0)["category"].alias("top_category"), cost(0).alias("top_spent"),
        nth(1)["category"].alias("second_category"), cost(1).alias("second_spent"),
        F.size("_dear").cast("long").alias("n_categories"), "total_anomalies", "total_flagged_amount")


def facts(df: DataFrame, forecast_summary: DataFrame) -> DataFrame:
    """Everything the insights need, one row per statement.

    ``df`` is a scored table (with ``category`` and ``is_anomaly``).
    """
    stats = statement_stats(df)
    ahead = forecast_summary.groupBy(KEY).agg(
        (money.total(F.col("vs_last_month_pct_change")) / F.count(F.lit(1))).alias("mean_change"),
        money.total(F.col("next_month_forecast")).alias("forecast_total"),
    )
    return (
        stats.join(ahead, KEY, "left")
        .withColumn("savings_rate", money.savings_rate(F.col("total_credits"), F.col("total_debits")))
        .withColumn("top_pct", F.least(F.lit(100.0), money.ratio(
            F.col("top_spent") * 100, F.col("total_debits"), 100.0)))
        .na.fill({"n_categories": 0, "total_anomalies": 0, "total_flagged_amount": 0.0})
    )


def health_score(facts: DataFrame) -> DataFrame:
    """Score of 0 to 100 from four parts of 25 points, with tips."""
    rate, top, change = F.col("savings_rate"), F.col("top_pct"), F.col("mean_change")
    has_income = F.col("total_credits") > 0
    flagged = F.col("total_anomalies")
    savings = F.when(
        has_income, F.least(F.lit(25.0), F.greatest(F.lit(0.0), rate * 1.25))).otherwise(10.0)
    diversity = F.greatest(F.lit(0.0), F.least(F.lit(25.0), F.col("n_categories") * 2.5)
                           * (1 - F.greatest(F.lit(0.0), (top - 40.0) / 100)))
    share = flagged / F.greatest(F.col("transaction_count"), F.lit(1))
    anomaly = F.greatest(F.lit(0.0), 25.0 - share * 100 * 8.0)
    trend = (
        F.when(change.isNull(), 12.0).when(change <= 0, 25.0).when(change <= 10, 18.0)
        .when(change <= 20, 10.0).otherwise(4.0)
    )
    points = facts.withColumns({"_s": savings, "_d": diversity, "_a": anomaly, "_t": trend})
    whole = lambda c: F.rint(c).cast("int")
    total = F.col("_s") + F.col("_d") + F.col("_a") + F.col("_t")
    scored = points.withColumns({
        "savings_pts": whole("_s"), "diversity_pts": whole("_d"), "anomaly_pts": whole("_a"),
        "trend_pts": whole("_t"),
        "health_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.rint(total))).cast("int"),
    }).drop("_s", "_d", "_a", "_t")
    left = lambda c: 25 - F.col(c)
    tips = F.array_compact(F.array(
        F.when((rate < SAVINGS_TARGET) & (left("savings_pts") > 0), say(
            M.TIP_SAVINGS, rate=fixed(rate, 0), gain=left("savings_pts"))),
        F.when(top > 50, say(M.TIP_TOP, top=fixed(top, 0),
                             gain=F.greatest(F.lit(0), left("diversity_pts")))),
        F.when(flagged > 0, say(M.TIP_ANOMALY, n=flagged, noun=plural(flagged, "anomaly", "anomalies"),
                                gain=left("anomaly_pts"))),
        F.when(change > 10, say(M.TIP_TREND, change=fixed(change, 0))),
    ))
    return scored.withColumn("tips", tips)


def health_status(rate: Column, score: Column) -> Column:
    """Label of a savings rate and score together."""
    return (
        F.when((rate < 0) & (score < 80), "Structurally At Risk")
        .when(rate < 0, "Strong Portfolio, Critical Cash Gap")
        .when(score >= 85, "Financially Resilient")
        .when(score >= 65, "On Track")
        .otherwise("Needs Attention")
    )


def report_band(score: Column) -> Column:
    return F.when(score >= 71, "Healthy").when(score >= 41, "Moderate").otherwise("At Risk")


def component_band(points: Column) -> Column:
    """Band of one 25-point part."""
    fill = points / 25 * 100
    return F.when(fill >= 70, "good").when(fill >= 40, "fair").otherwise("poor")


def risk_level(facts: DataFrame) -> DataFrame:
    """Low, Medium or High, with the advisory figures."""
    share = F.col("total_anomalies") / F.greatest(F.col("transaction_count"), F.lit(1)) * 100
    no_income, rate = F.col("total_credits") == 0, F.col("savings_rate")
    level = (
        F.when((share == 0) & (no_income | (rate >= SAVINGS_TARGET)), "Low")
        .when((share <= 2) & (no_income | (rate >= 0)), "Medium")
        .otherwise("High")
    )
    return facts.select(
        KEY, level.alias("risk_level"),
        F.when(F.col("total_credits") > 0, F.concat(fixed(rate, 1), F.lit("%"))).otherwise("N/A")
        .alias("savings_text"),
        F.coalesce(format_inr(F.col("forecast_total")), F.lit("N/A")).alias("forecast_text"),
    )


def key_insights(facts: DataFrame, limit: int = 4) -> DataFrame:
    """Up to four (variant, icon, message) rows per statement."""
    rate, change = F.col("savings_rate"), F.col("mean_change")
    net, flagged = F.col("net_cashflow"), F.col("total_anomalies")

    def row(variant, icon: str, message: Column) -> Column:
        variant = variant if isinstance(variant, Column) else F.lit(variant)
        return F.struct(variant.alias("variant"), F.lit(icon).alias("icon"), message.alias("message"))

    cash = (
        F.when(F.col("total_credits") <= 0, row("primary", "i", say(
            M.OUTFLOWS, debits=format_inr(F.col("total_debits")),
            n=whole_number(F.col("transaction_count")))))
        .when(rate >= 20, row("success", "+", say(M.SURPLUS, rate=fixed(rate, 1), net=format_inr(net))))
        .when(rate >= 0, row("warning", "~", say(M.BELOW_TARGET, rate=fixed(rate, 1))))
        .otherwise(row("danger", "!", say(M.DEFICIT, net=format_inr(F.abs(net)))))
    )
    top = F.when(F.col("top_category").isNotNull(), row(
        F.when(F.col("top_pct") <= 40, "primary").otherwise("warning"), "i",
        say(M.TOP_SPEND, category=F.col("top_category"), amount=format_inr(F.col("top_spent")),
            share=fixed(F.col("top_pct"), 1))))
    unusual = F.when(flagged > 0, row("danger", "!", say(
        M.UNUSUAL, n=flagged, noun=plural(flagged, "transaction", "transactions"),
        amount=format_inr(F.col("total_flagged_amount"))))
    ).otherwise(row("success", "+", F.lit(M.NO_UNUSUAL)))
    ahead = (
        F.when(change > 5, row("warning", "~", say(M.RISING, change=fixed(change, 1))))
        .when(change < -5, row("success", "+", say(M.FALLING, change=fixed(F.abs(change), 1))))
    )
    rows = F.slice(F.array_compact(F.array(cash, top, unusual, ahead)), 1, limit)
    return facts.select(KEY, F.posexplode(rows).alias("rank", "_i")).select(
        KEY, (F.col("rank") + 1).alias("rank"), "_i.*")


def story(facts: DataFrame) -> DataFrame:
    """Two or three sentences about the period."""
    days = F.greatest(F.lit(1), F.datediff("date_range.max", "date_range.min"))
    months = F.rint(days / 30.4).cast("int")
    period = say(M.PERIOD, n=months, noun=plural(months, "month", "months"))
    net, flagged = F.col("net_cashflow"), F.col("total_anomalies")
    n = whole_number(F.col("transaction_count"))
    gain = net >= 0
    debits = format_inr(F.col("total_debits"))
    first = F.when(F.col("total_credits") > 0, say(
        M.STORY_INCOME, period=period, credits=format_inr(F.col("total_credits")), debits=debits,
        direction=F.when(gain, "saving").otherwise("overspending by"), net=format_inr(F.abs(net)),
        rate=fixed(F.abs("savings_rate"), 0),
        label=F.when(gain, "savings rate").otherwise("deficit"), n=n,
    )).otherwise(say(M.STORY_SPEND, period=period, n=n, debits=debits))
    a, b = format_inr(F.col("top_spent")), format_inr(F.col("second_spent"))
    both = money.ratio(F.col("top_spent") + F.col("second_spent"), F.col("total_debits"), 0.0) * 100
    second = F.coalesce(
        say(M.STORY_TWO, first=F.col("top_category"), a=a, second=F.col("second_category"), b=b,
            share=fixed(both, 0)),
        say(M.STORY_ONE, first=F.col("top_category"), a=a),
    )
    third = (
        F.when(flagged > 0, say(M.STORY_UNUSUAL, n=flagged, noun=plural(
            flagged, "transaction was", "transactions were")))
        .when(F.col("forecast_total").isNotNull(), say(
            M.STORY_FORECAST, amount=format_inr(F.col("forecast_total"))))
        .otherwise(M.STORY_CALM)
    )
    return facts.select(
        KEY, F.array_compact(F.array(first, second, third)).alias("sentences"))


def spending_personality(df: DataFrame) -> DataFrame:
    """Label and supporting fact of how a statement's money is spent."""
    top = AG.top_category(AG.category_totals(df))
    joined = top.join(AG.weekday_profile(df), KEY).join(
        AG.merchant_dominance(df).drop("top_category"), KEY)
    name, share = F.lower("top_category"), F.col("top_pct")
    has = lambda *words: F.array_max(F.array(*[name.contains(w) for w in words]))
    values = dict(
        category=F.col("top_category"), share=fixed(share, 0), weekend=fixed(F.col("weekend_pct"), 0),
        day=F.get(F.lit(M.WEEKDAYS), F.col("peak_dow")),
    )
    rules = [
        (has("food") & (F.col("weekend_pct") > 60), "Weekend Diner", M.WEEKEND_DINER),
        (has("shopping") & F.col("single_dominates"), "Brand Loyalist", M.BRAND_LOYALIST),
        (has("entertainment", "subscription"), "Experience Spender", M.EXPERIENCE_SPENDER),
        (has("travel", "transport"), "Frequent Traveler", M.FREQUENT_TRAVELER),
        (share < 30, "Diversified Spender", M.DIVERSIFIED),
        (F.lit(True), "Focused Spender", M.FOCUSED),
    ]
    pick = F.coalesce(*[
        F.when(test, F.struct(F.lit(label).alias("label"), say(text, **values).alias("fact")))
        for test, label, text in rules
    ])
    return joined.withColumn("_p", pick).select(
        KEY, "top_category", F.col("top_pct"), "weekend_pct", "peak_dow", "single_dominates", "_p.*")


def rule_advice(facts: DataFrame) -> DataFrame:
    """Advice text from the rules alone."""
    credits, debits = F.col("total_credits"), F.abs("total_debits")
    left = credits - debits
    rate = F.when(credits > 0, left / credits * 100)
    flagged = F.col("total_anomalies")
    share = money.ratio(F.col("top_spent") * 100, F.col("total_debits"), 0.0)
    top = dict(category=F.col("top_category"), amount=format_inr_paise(F.col("top_spent")),
               share=fixed(share, 0))
    opening = (
        F.when(rate >= 20, say(M.ADVICE_GOOD, rate=fixed(rate, 0)))
        .when(rate >= 0, say(M.ADVICE_ROOM, rate=fixed(rate, 0)))
        .when(rate < 0, say(M.ADVICE_SHORT, net=format_inr_paise(F.abs(left))))
        .otherwise(say(M.ADVICE_BLIND, n=F.col("transaction_count")))
    )
    points = [
        F.when(credits > 0, say(
            M.ADVICE_NET, credits=format_inr_paise(credits), debits=format_inr_paise(debits),
            side=F.when(left >= 0, "surplus").otherwise("deficit"), net=format_inr_paise(F.abs(left)))),
        F.when(share > 40, say(M.ADVICE_HEAVY, **top)).otherwise(say(M.ADVICE_SPREAD, **top)),
        F.when(flagged > 0, say(M.ADVICE_UNUSUAL, n=flagged,
                                noun=plural(flagged, "transaction", "transactions"))),
        say(M.ADVICE_FORECAST, amount=format_inr_paise(F.col("forecast_total"))),
    ]
    step = (
        F.when(rate.isNull(), M.NEXT_LINK)
        .when((rate < 20) & F.col("top_category").isNotNull(), say(
            M.NEXT_TRIM, category=F.col("top_category")))
        .when(rate >= 20, M.NEXT_PARK)
        .otherwise(M.NEXT_CUT)
    )
    text = F.concat_ws("\n", opening, F.lit(""), *points, F.lit(""), step)
    return facts.select(KEY, text.alias("advice"))


def context_block(df: DataFrame, facts: DataFrame, top: int = 5) -> DataFrame:
    """Plain-text summary of a statement: totals, categories, first anomalies, forecast.

    Lists are gathered from per-category sums and from at most ``top`` rows per
    statement, never from raw transactions.
    """
    line = lambda label, value: F.concat(F.lit(f"  {label}: "), value)
    categories = AG.category_totals(df).groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("total_spent")).alias("o"), "category", "total_spent"))).alias("_c"))
    first = AG.top_rows(df.where("is_anomaly"), top, F.col("date"), F.col("line_no")).groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "description", "amount", "category", "anomaly_score"))).alias("_a"))
    rows = facts.join(categories, KEY, "left").join(first, KEY, "left")
    figures = ["total_debits", "total_credits", "net_cashflow", "transaction_count"]
    summary = F.concat_ws(
        "\n", F.lit("FINANCIAL SUMMARY"),
        *[line(c, format_inr_paise(F.col(c).cast("double"))) for c in figures],
        line("date_range", F.concat_ws(
            " to ", F.col("date_range.min").cast("string"), F.col("date_range.max").cast("string"))),
        line("avg_monthly_spend", format_inr_paise(F.col("avg_monthly_spend"))),
    )
    breakdown = F.concat(
        F.lit("CATEGORY BREAKDOWN\n"),
        F.array_join(F.transform("_c", lambda c: F.concat(
            F.lit("  "), c["category"], F.lit(": "), format_inr_paise(c["total_spent"]))), "\n"))
    unusual = F.concat(
        F.lit("ANOMALOUS TRANSACTIONS ("), F.col("total_anomalies").cast("string"),
        F.lit(" total, top 5 shown)\n"),
        F.array_join(F.transform("_a", lambda a: F.concat(
            F.lit("  - "), a["description"], F.lit(": "), format_inr_paise(a["amount"]), F.lit(" ["),
            a["category"], F.lit("] score="), fixed(a["anomaly_score"], 2))), "\n"))
    ahead = F.concat(F.lit("FORECAST\n"), line("total_forecast", format_inr_paise(F.col("forecast_total"))))
    return rows.select(KEY, F.concat_ws("\n\n", summary, breakdown, unusual, ahead).alias("context"))


def report_tables(df: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Key figures, category table and top anomalies of a printed report."""
    compact = money.format_inr_compact
    net = F.col("net_cashflow")
    figures = health_score(facts).select(
        KEY, compact(F.col("total_debits")).alias("total_spend"),
        compact(F.col("total_credits")).alias("total_income"),
        F.concat(F.when(net >= 0, "+").otherwise("-"), compact(net)).alias("net_cashflow"),
        compact(F.col("avg_monthly_spend")).alias("avg_month"), "health_score",
        report_band(F.col("health_score")).alias("band"),
    )
    return {
        "figures": figures,
        "categories": AG.category_breakdown(df),
        "anomalies": top_anomalies(df, 5),
    }
