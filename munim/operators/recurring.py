"""Recurring charges and similar merchant names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from munim.functions import money
from munim.functions.dates import month_start
from munim.functions.text import bigrams, recurring_key
from munim.operators.aggregates import KEY, only
from munim.operators.groups import linked_groups
from munim.rules.tokens import SUBSCRIPTION_WORDS
from munim.session import ensure_checkpoint_dir


def recurring_merchants(df: DataFrame) -> DataFrame:
    """Merchants charged at least twice and in at least two months.

    Figures per (statement, key) come from plain aggregates with one distinct count,
    the display name from counts per spelling.  Both combine map-side, so a merchant
    with any number of charges or spellings never gathers them in one task.
    """
    spent = F.col("debit")
    charges = only(df, "debit").select(
        KEY, "date", "description", "debit", recurring_key(F.col("description")).alias("_key")
    ).where(F.length("_key") >= 2)
    total = F.sum(money.paise(spent)) / F.lit(100.0)
    figures = charges.groupBy(KEY, "_key").agg(
        F.count(F.lit(1)).alias("frequency"), money.ratio(total, F.count(spent)).alias("_avg"),
        total.alias("_total"), F.stddev_pop(spent).alias("_sd"),
        F.count_distinct(month_start(F.col("date"))).cast("int").alias("months_active"),
    ).where((F.col("frequency") >= 2) & (F.col("months_active") >= 2))
    names = charges.groupBy(KEY, "_key", "description").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        KEY, "_key").agg(F.min_by("description", F.struct(-F.col("_n"), "description")).alias("merchant"))
    groups = figures.join(names, [KEY, "_key"])
    steady = F.when(F.col("_avg") > 0, F.col("_sd") / F.col("_avg") < 0.20).otherwise(F.lit(True))
    subscription = F.col("merchant").rlike(f"(?i)({SUBSCRIPTION_WORDS})")
    return groups.select(
        KEY, "merchant", "frequency",
        money.round_even(F.col("_avg"), 2).alias("avg_amount"),
        money.round_even(F.col("_total"), 2).alias("total_spent"), "months_active",
        (steady & (subscription | (F.col("_avg") <= 1500))).alias("likely_subscription"),
    )


def subscription_rollup(recurring: DataFrame, high: float = 200.0) -> DataFrame:
    """Recurring and subscription counts, monthly cost, and the yearly saving of dear ones."""
    sub = F.col("likely_subscription")
    dear = sub & (F.col("avg_amount") > high)
    return recurring.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("recurring_count"),
        F.count_if(sub).alias("subscription_count"),
        money.total_or_zero(F.when(sub, F.col("avg_amount"))).alias("monthly_cost"),
        money.total_or_zero(F.when(dear, F.col("avg_amount") * 12)).alias("yearly_saving"),
    )


def dear_subscriptions(recurring: DataFrame, high: float = 200.0) -> DataFrame:
    """Subscriptions worth cancelling, with the saving per month and year."""
    return recurring.where(F.col("likely_subscription") & (F.col("avg_amount") > high)).select(
        KEY, "merchant", "avg_amount", (F.col("avg_amount") * 12).alias("yearly_saving")
    )


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def similar_names(names: DataFrame, threshold: float = 0.60) -> DataFrame:
    """(name, partner, similarity): the most similar other name of each name that has one.

    Among equally similar names the first in order is the partner.
    """
    pairs = similar_pairs(names, threshold)
    both = pairs.select(F.col("name_a").alias("name"), F.col("name_b").alias("partner"), "similarity").unionByName(
        pairs.select(F.col("name_b").alias("name"), F.col("name_a").alias("partner"), "similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "partner"))
    return both.groupBy("name").agg(best.alias("_b")).select(
        "name", F.col("_b.partner").alias("partner"), (-F.col("_b.far")).alias("similarity"))


def similar_groups(names: DataFrame, threshold: float = 0.60) -> DataFrame:
    """(name, class_id, n_links): groups of names that similar names join, also through others.

    class_id is the first name of the group in order, n_links the number of names that are
    similar to the row's own.  Names without a similar one are their own group; null names are
    left out, and repeated ones count once.
    """
    ensure_checkpoint_dir(names.sparkSession)
    pairs = similar_pairs(names, threshold).select(
        F.col("name_a").alias("a"), F.col("name_b").alias("b")).checkpoint()
    counts = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(
        F.count("*").alias("n_links"))
    groups = linked_groups(pairs).select(F.col("v").alias("name"), F.col("group").alias("class_id"))
    every = names.where(F.col("name").isNotNull()).select("name").distinct()
    return every.join(groups, "name", "left").join(counts, "name", "left").select(
        "name", F.coalesce("class_id", "name").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_pairs(names: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Pairs of distinct names whose bigram Jaccard similarity reaches ``threshold``.

    Exact prefix filtering: with bigrams in rarest-first order, two similar names
    of two or more bigrams share at least two of their first
    ``n - ceil(threshold * n) + 2``.  Names therefore meet on a pair of rare
    bigrams and on their size, never on a single common bigram.
    """
    sets = names.where(F.col("name").isNotNull()).select("name").distinct().select("name", bigrams(F.col("name")).alias("grams"))
    single = sets.select("name", F.explode("grams").alias("gram"))
    counts = single.groupBy("gram").agg(F.count(F.lit(1)).alias("_f"))
    ranked = single.join(counts, "gram").groupBy("name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_f", "gram"))), lambda g: g["gram"]
        ).alias("grams")
    )
    n = F.size("grams")
    prefix = F.slice("grams", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 2).cast("int"))
    pairs = F.flatten(
        F.transform(prefix, lambda x, i: F.transform(
            F.slice(prefix, i + 2, F.size(prefix)), lambda y: F.concat_ws("\u0001", x, y)))
    )
    keys = F.when(n >= 2, pairs).otherwise(F.col("grams"))
    keyed = ranked.select("name", "grams", n.alias("n"), F.explode(keys).alias("key"))
    low = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    probe = keyed.select(
        F.col("name").alias("name_a"), F.col("grams").alias("grams_a"), "key",
        F.explode(F.sequence(low, F.col("n"))).alias("n"),
    )
    other = keyed.select(F.col("name").alias("name_b"), F.col("grams").alias("grams_b"), "key", "n")
    # The partner is never larger; equal sizes are kept once, by name order.
    larger = (F.size("grams_a") > F.size("grams_b")) | (F.col("name_a") < F.col("name_b"))
    hits = probe.join(other, ["key", "n"]).where(larger & (F.col("name_a") != F.col("name_b")))
    similarity = jaccard(F.col("grams_a"), F.col("grams_b"))
    return hits.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select(
        F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"),
        "similarity",
    ).distinct()
