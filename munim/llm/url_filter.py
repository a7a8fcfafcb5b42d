"""Allow and block lists over URLs: hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from munim.llm.support import fresh

#: Hexadecimal digits of a digest that the join compares; the full digest is confirmed after it.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge(
    pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules`` has host, path and action.  A rule fits its host and all subdomains of it if the
    URL's path starts with the rule's; the rule with the longest host and path text wins, then
    the one with the longer host; of equal rules with two actions, ``block`` wins.  ``rule`` is
    that text and ``verdict`` its action; null and ``default`` where no rule fits.

    A URL without ``://`` and a null URL have an empty host and path, which fit no rule with a
    host.  Rules holding a null are ignored.  Repeated URLs are judged once and joined back, so
    every row keeps its verdict.  Columns of ``pages`` named like a result column are replaced.

    Each distinct (host, path) is expanded into the suffixes and prefixes whose numbers of labels
    and characters occur in the rules, which is all of them that can match.  Expressions meet the
    rules on a short prefix of their SHA-256; full digests are compared afterwards.  No join is
    hinted: a small rule table is broadcast by its known size, a large one is shuffled and
    adaptive execution splits hot expressions.
    """
    depth = F.size(F.split("_host", r"\."))
    table = rules.select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("_host"),
        F.col("path").alias("_path"), F.col("action").alias("_action"),
    ).dropna().groupBy("_host", "_path").agg(
        F.when(F.max(F.col("_action") == "block"), "block").otherwise(F.max("_action"))
        .alias("_action"))
    # Distinct label counts and path lengths: bounded by the longest host and path of a rule.
    sizes = table.agg(F.collect_set(depth).alias("d"), F.collect_set(F.length("_path")).alias("n")
                      ).first()
    ruled = table.select(
        F.sha2(F.concat("_host", "_path"), 256).alias("_full"), F.length("_host").alias("_labels"),
        F.concat("_host", "_path").alias("_rule"), "_action",
    ).withColumn("_short", F.substring("_full", 1, PREFIX_DIGITS))

    judged = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    labels = F.split("host", r"\.")
    depths = F.array(*[F.lit(d) for d in sorted(sizes["d"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(sizes["n"])]).cast("array<int>")
    suffixes = F.transform(
        F.filter(depths, lambda d: d <= F.size(labels)),
        lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n))
    hosts = judged.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
    expressions = hosts.withColumn("_prefix", F.explode(prefixes)).select(
        "host", "path",
        F.sha2(F.concat("_suffix", "_prefix"), 256).alias("_digest"),
    ).withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))
    (found,) = fresh(pages, "_best")
    best = expressions.join(ruled, "_short").where("_digest = _full").groupBy("host", "path").agg(
        F.max_by(F.struct("_rule", "_action"), F.struct(F.length("_rule"), "_labels")).alias(found))
    rest = [c for c in judged.columns if c.lower() not in ("rule", "verdict")]
    return judged.select(*rest).join(best, ["host", "path"], "left").select(
        *[c for c in rest if c not in ("host", "path")], "host", "path",
        F.col(f"{found}._rule").alias("rule"),
        F.coalesce(f"{found}._action", F.lit(default)).alias("verdict"))
