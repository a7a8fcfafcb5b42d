"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from munim.session import ensure_checkpoint_dir

#: Rows that one window group may hold where a group is cut into salts.
GROUP_ROWS = 10_000
#: Rows up to which a table of a few numbers a row is broadcast (some MB); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def ship(module: str) -> None:
    """Send a module's functions with each job, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later jobs reread it after a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def light(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder: smaller than ``cut`` for many short rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until they clash with no column of ``df``, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def least_hashed(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows of the ``k`` least values of the hash ``h`` in each ``key`` (few keys, not null).

    Of rows with equal key and hash the one with least other columns stays.  A hash below which a
    key has at least ``k`` values, and not twice as many, comes from a merged count of distinct
    hashes; only rows below it are shuffled, so that a key holding most rows needs no group of its
    own.  The hashes left, under ``2 * k + 200`` a key, are ranked by the driver.
    """
    share = (k + 6 * k ** 0.5) * 1.1 / F.col("_n")
    limits = rows.groupBy(key).agg(F.approx_count_distinct("h", 0.02).alias("_n")).select(
        key, F.when(share < 0.9, (share * 2.0 ** 64 - 2.0 ** 63).cast("long"))
        .otherwise((1 << 63) - 1).alias("_limit"))
    rest = F.struct(*[c for c in rows.columns if c not in (key, "h")])
    near = cut(rows.join(F.broadcast(limits), key).where(F.col("h") <= F.col("_limit")).groupBy(
        key, "h").agg(F.min(rest).alias("_rest")))  # one limit a key
    hashes: dict = {}
    for value, h in near.select(key, "h").collect():
        hashes.setdefault(value, []).append(h)
    last = rows.sparkSession.createDataFrame(
        [(value, sorted(hs)[:k][-1]) for value, hs in hashes.items()],
        StructType([StructField(key, rows.schema[key].dataType), StructField("_limit", LongType())]))
    return near.join(F.broadcast(last), key).where(F.col("h") <= F.col("_limit")).select(
        key, "h", "_rest.*")


def word_count(text: Column) -> Column:
    """Number of runs outside ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def number_rows(df: DataFrame, key: str, salt_of: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps, in no particular order.

    ``rows`` is the row count of ``df``.  Each key is cut into salts by a hash of ``salt_of``;
    rows are numbered within (key, salt) and shifted by the salts before, so that a key holding
    most rows is spread over all tasks.  ``df`` is read twice and must not change between reads.
    """
    salts = max(1, -(-rows // GROUP_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shift = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n")).select(
        key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(key, "_salt").orderBy(*salt_of)
    return salted.withColumn("_inside", F.row_number().over(inside) - 1).join(
        shift, [key, "_salt"]).withColumn(
        name, (F.col("_inside") + F.col("_shift")).cast("long")).drop("_salt", "_inside", "_shift")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b), both long.

    Returns (v, component) for every vertex of a non-loop edge; ``component`` is the smallest
    vertex of its component.  Each round hooks every vertex to its neighbour of least hash,
    jumps twice along these hooks and contracts; cliques and stars need one round, and the
    number of rounds grows with the logarithm of the longest path.  Only the emptiness of the
    remaining edges reaches the driver.  A vertex with very many links costs a map-side combined
    minimum and a join that adaptive execution splits, never a collected neighbour list.
    """
    def rank(c: Column) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))

    left = cut(edges.where("a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min(rank(F.col("b"))).alias("m")).select(
            "v", F.least(rank(F.col("v")), F.col("m"))["v"].alias("p"))
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("_up"))
            hook = hook.join(up, "p").select("v", F.col("_up").alias("p"))
        hook = cut(hook)
        rounds.append(hook)
        a, b = (hook.select(F.col("v").alias(k), F.col("p").alias(f"_{k}")) for k in "ab")
        left = cut(left.join(a, "a").join(b, "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not rounds:
        return edges.sparkSession.createDataFrame([], "v long, component long")
    # Later rounds hold only the roots of earlier ones: compose from the last to the first.
    top = rounds[-1]
    for lower in reversed(rounds[:-1]):
        up = top.select(F.col("v").alias("p"), F.col("p").alias("_root"))
        top = lower.join(up, "p", "left").select("v", F.coalesce("_root", "p").alias("p"))
    least = top.groupBy("p").agg(F.min("v").alias("component"))
    return top.join(least, "p").select("v", "component")
