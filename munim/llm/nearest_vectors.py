"""Nearest neighbours by cosine: int8 products of blocks with error bounds, survivors in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from munim.llm.embedding_dedup import usable
from munim.llm.support import cut, number_rows, ship

ship(__name__)

#: Candidates of a tile at least and at most, and queries of a tile.
CANDIDATES, MOST_CANDIDATES, QUERIES = 8_192, 131_072, 32_768
#: Queries and candidates of one int8 product, and dimensions whose products stay exact in float32.
STRIP, COLUMNS, DIMS = 256, 8_192, 1_024
#: Tiles of the first round; every further round has twice as many.
FIRST_TILES = 8
#: Rows of one merge task.
MERGED = 200_000
#: Above the rounding errors of the bounds themselves, which are taken in float32.
SLACK = 1e-5


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which loses nothing, and their lengths."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -e[:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def quantise(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and error lengths: |x / length - scale * int8| <= error."""
    unit = x / length[:, None]
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    code = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1))
    return code.astype(np.int8), scale, error


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int8 rows by float32 BLAS; sums of ``DIMS`` products are below 2^24, so exact."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for d in range(0, a.shape[1], DIMS):
        out += a[:, d:d + DIMS].astype(np.float32) @ b[:, d:d + DIMS].astype(np.float32).T
    return out


def cosines(a: np.ndarray, la: float, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Cosines of one row with many, in double precision; equal rows give equal cosines."""
    return (b * a).sum(axis=1) / (la * lb)


def search_tile(
    q: np.ndarray, floor: np.ndarray, v: np.ndarray, least_id: np.ndarray, c: np.ndarray, k: int,
) -> list[list[tuple[float, int, int]]]:
    """For each query (cosine, -least id, -class) of its k best rows of ``v``, best first.

    ``floor[i]`` is a cosine that k rows are known to reach.  A heap of k keeps what is best so far;
    its least member raises the floor for the columns after it.
    """
    x, lx = directions(q)
    y, ly = directions(v)
    xq, xs, xe = quantise(x, lx)
    yq, ys, ye = quantise(y, ly)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in q]
    floor = floor.copy()
    for s in range(0, len(q), STRIP):
        rows = slice(s, s + STRIP)
        for t in range(0, len(v), COLUMNS):
            cols = slice(t, t + COLUMNS)
            near = int8_product(xq[rows], yq[cols])
            near *= xs[rows, None].astype(np.float32)
            near *= ys[None, cols].astype(np.float32)
            # |x y - x' y'| <= |y - y'| + |x - x'| |y'|, and |y'| <= 1 + |y - y'|.
            room = ye[None, cols] + xe[rows, None] * (1 + ye[None, cols]) + SLACK
            room = room.astype(np.float32)
            high = near + room
            level = floor[rows]
            if near.shape[1] > k:
                low = np.partition(near - room, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                level = np.maximum(level, low.astype(np.float64) - SLACK)
            i, j = np.divmod(np.flatnonzero(high >= level[:, None]), high.shape[1])
            for n, found in zip(*_runs(i, j)):
                at = s + n
                score = cosines(x[at], lx[at], y[t + found], ly[t + found])
                heap = heaps[at]
                some = np.flatnonzero(score >= floor[at])
                if len(some) > k:
                    least = np.partition(score[some], len(some) - k)[len(some) - k]
                    some = some[score[some] >= least]
                if len(some) > k:  # equal scores: the smaller ids
                    of = found[some] + t
                    some = some[np.lexsort((c[of], least_id[of], -score[some]))[:k]]
                for m in some:
                    entry = (float(score[m]), -int(least_id[t + found[m]]), -int(c[t + found[m]]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    floor[at] = max(floor[at], heap[0][0])
    return [sorted(h, reverse=True) for h in heaps]


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Columns ``j`` of each distinct row number in the sorted ``i``."""
    names, start = np.unique(i, return_index=True)
    return names.tolist(), np.split(j, start[1:])


def matrix(values: pd.Series, dims: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(values), dims))
    for n, v in enumerate(values):
        out[n, :len(v)] = v
    return out


def nearest(
    rows: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k rows of largest cosine to every query row: query_id, rank (from 1), ``id_col``, score.

    Candidates are all rows but the query's own; the score is the cosine of the original vectors
    in double precision; ties go to the smaller id.  Rows with a null id, and vectors that are null,
    zero or hold null or non-finite components, take no part; shorter vectors are filled
    up with zeros.  Repeated rows are rows of their own.  With fewer than k other rows all are
    given, other columns are ignored, and a table without usable rows gives an empty result.

    Nothing is approximate in the end: a pair is left out only if its int8 product and both
    quantisation errors show that k rows are nearer.  Equal vectors are compared once; of
    each class only its k + 1 least ids can be among the k best.  A task compares one tile of queries
    with one tile of candidates.  Tiles are searched in rounds that double, and the k + 1 best so
    far of every query bound the next round, so later rounds send little.
    """
    wide = k + 1  # one place for the query itself
    doubles = F.transform(vector_col, lambda x: x.cast("double"))
    base = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), doubles.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # 0.0 and -0.0 are equal, trailing zeros are not looked at: both only split classes.
    base = cut(base.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    classes = cut(base.groupBy("h1", "h2").agg(
        F.min("id").alias("least"), F.max("asks").alias("asks"), F.first("vec").alias("vec")))
    n, asking, dims = classes.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec"))).first()
    if not asking:
        return base.sparkSession.createDataFrame(
            [], f"query_id long, rank int, {id_col} long, score double")
    flat = cut(number_rows(classes.withColumn("_all", F.lit(1)), "_all", ["h1", "h2"], "c", n).drop("_all"))
    tile = min(MOST_CANDIDATES, max(CANDIDATES, n // 64))
    tiles, asked = -(-n // tile), -(-asking // QUERIES)
    deal = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    queries = flat.where("asks").select(
        F.col("c").alias("c"), F.col("vec").alias("vec"), F.pmod(F.xxhash64("c"), F.lit(asked)).alias("qt"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("least", ignore_index=True)
            found = search_tile(
                matrix(left["data"], dims), left["floor"].to_numpy(), matrix(right["data"], dims),
                right["least"].to_numpy(), right["c"].to_numpy(), wide)
            out = [(q, -number, -least, score) for q, heap in zip(left["c"].to_numpy(), found)
                   for score, least, number in heap]
        return pd.DataFrame(out, columns=["q", "c", "least", "score"]).astype(
            {"q": "int64", "c": "int64", "least": "int64", "score": "float64"})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, list] = {}
        for q, c, least, score in zip(group["q"].tolist(), group["c"].tolist(), group["least"].tolist(),
                                      group["score"].tolist()):
            heap, entry = heaps.setdefault(q, []), (score, -least, -c)
            if len(heap) < wide:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        return pd.DataFrame([(q, -c, -least, score) for q, heap in heaps.items() for score, least, c in heap],
                            columns=["q", "c", "least", "score"])

    best: DataFrame | None = None
    for first, end in rounds(tiles):
        floor = queries.withColumn("floor", F.lit(-2.0))
        if best is not None:
            known = best.groupBy(F.col("q").alias("c")).agg(
                F.min("score").alias("_low"), F.count("*").alias("_n"))
            floor = queries.join(known, "c", "left").withColumn(
                "floor", F.when(F.col("_n") >= wide, F.col("_low")).otherwise(F.lit(-2.0))).drop("_low", "_n")
        left = floor.select("c", F.col("vec").alias("data"), "floor", "qt", deal(first, end).alias("vt"))
        right = flat.withColumn("vt", (F.col("c") % tiles).cast("int")).where(
            F.col("vt").between(first, end - 1)).select(
            "c", "least", F.col("vec").alias("data"), "vt", deal(0, asked).alias("qt"))
        found = left.withColumn("qt", F.col("qt").cast("int")).groupBy("vt", "qt").cogroup(
            right.groupBy("vt", "qt")).applyInPandas(search, "q long, c long, least long, score double")
        if best is not None:
            found = found.unionByName(best)
        found = cut(found)
        if end - first > 1 or best is not None:
            parts = max(1, -(-found.count() // MERGED))
            found = cut(found.groupBy(F.pmod(F.xxhash64("q"), F.lit(parts))).applyInPandas(
                merge, "q long, c long, least long, score double"))
        best = found

    # Members of the best classes, and every query row of a class in its place.
    named = base.join(flat.select("h1", "h2", "c"), ["h1", "h2"]).select(
        "c", "id", "asks", F.monotonically_increasing_id().alias("r"))
    named = cut(named)
    inside = W.partitionBy("c").orderBy("id", "r")
    members = named.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= wide)
    members = members.select("c", F.col("id").alias("_id"), F.col("r").alias("_r"))
    rank = W.partitionBy("q").orderBy(F.desc("score"), "_id", "_r")
    # The k + 1 best rows of each query class; its query rows leave out themselves.
    rows_of = best.select("q", "c", "score").join(members, "c").withColumn(
        "_n", F.row_number().over(rank)).where(F.col("_n") <= wide)
    asked_rows = named.where("asks").select(F.col("c").alias("q"), F.col("id").alias("query_id"), "r")
    pairs = asked_rows.join(rows_of.select("q", "_id", "_r", "score"), "q").where("r <> _r")
    order = W.partitionBy("query_id", "r").orderBy(F.desc("score"), "_id", "_r")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("_id").alias(id_col), "score")


def rounds(tiles: int) -> Iterator[tuple[int, int]]:
    """Ranges of tiles: ``FIRST_TILES``, then twice as many each time."""
    start, size = 0, FIRST_TILES
    while start < tiles:
        yield start, min(tiles, start + size)
        start, size = start + size, 2 * size
