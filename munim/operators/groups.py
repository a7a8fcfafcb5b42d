"""Groups of linked values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from munim.session import ensure_checkpoint_dir


def linked_groups(links: DataFrame) -> DataFrame:
    """(v, group) for every value of the undirected ``links`` (a, b); group is its least member.

    Every round hooks each value to its linked value of least hash, follows the hooks twice and
    contracts; rounds grow with the logarithm of the longest chain.  Only whether links are left
    reaches the driver, and a value with many links costs a map-side combined minimum.
    """
    def rank(c: Column) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))

    ensure_checkpoint_dir(links.sparkSession)
    left = links.where("a <> b").select("a", "b").distinct().checkpoint()
    kind = dict(left.dtypes)["a"]
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min(rank(F.col("b"))).alias("m")).select(
            "v", F.least(rank(F.col("v")), F.col("m"))["v"].alias("p")).checkpoint()
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("_up"))
            hook = hook.join(up, "p").select("v", F.col("_up").alias("p"))
        hook = hook.checkpoint()
        rounds.append(hook)
        a, b = (hook.select(F.col("v").alias(k), F.col("p").alias(f"_{k}")) for k in "ab")
        left = left.join(a, "a").join(b, "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().checkpoint()
    if not rounds:
        return links.sparkSession.createDataFrame([], f"v {kind}, group {kind}")
    top = rounds[-1]
    for lower in reversed(rounds[:-1]):
        above = top.select(F.col("v").alias("p"), F.col("p").alias("_root"))
        top = lower.join(above, "p", "left").select("v", F.coalesce("_root", "p").alias("p"))
    least = top.groupBy("p").agg(F.min("v").alias("group"))
    return top.join(least, "p").select("v", "group")
