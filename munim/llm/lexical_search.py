"""Ranked lexical search: dense blocked products of item term counts and document impacts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from munim.llm.support import cut, number_rows, ship, store

ship(__name__)

#: Maximal runs of these bytes of the UTF-8 text are terms: ASCII letters and digits, and all of non-ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Items and documents of a tile, and vocabulary columns multiplied at a time.
ITEMS, DOCS, COLUMNS = 512, 2_048, 2_048
#: Up to so many distinct item terms, of so many bytes in all, are broadcast; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 16 << 20
#: Postings of one Arrow batch.
BATCH = 100_000
#: Sums below this are exact in double precision.
EXACT = 1 << 53


def term_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(r, id, n, term, tf): a row per distinct term of each row of ``rows``.

    r tells rows apart, n is the row's number of terms with repeats.  A row with any term also has
    one of the empty term, whose tf is n.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = TaskContext.get().partitionId() << 40
        held: tuple[list, ...] = ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            out = pa.record_batch([pa.array(v, t) for v, t in zip(held, types)],
                                  names=["r", "id", "n", "term", "tf"])
            for v in held:
                v.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1)):
                r += 1
                words = TERM.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else []
                if not words:
                    continue
                found = Counter(words)
                found[b""] = n = len(words)
                for v, new in zip(held, ([r] * len(found), [i] * len(found), [n] * len(found),
                                         found.keys(), found.values())):
                    v.extend(new)
                if len(held[0]) >= BATCH:
                    yield flush()
        if held[0]:
            yield flush()

    return rows.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "r long, id long, n long, term binary, tf long")


def exact_product(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """``q @ a.T`` of non-negative int64 matrices, through float64 products that stay exact.

    Every partial sum of a product is at most the row sum of ``q`` times the largest of ``a``.
    Where that may reach 2^53, ``q`` is taken in digits small enough, or by halves of its columns.
    """
    top = max(int(a.max(initial=0)), 1)
    if int(q.sum(axis=1).max(initial=0)) * top < EXACT:
        return (q.astype(np.float64) @ a.T.astype(np.float64)).astype(np.int64)
    bits = ((EXACT - 1) // (top * q.shape[1]) + 1).bit_length() - 1
    if bits < 1:
        half = q.shape[1] // 2
        if not half:
            return q @ a.T
        return exact_product(q[:, :half], a[:, :half]) + exact_product(q[:, half:], a[:, half:])
    out, shift = np.zeros((len(q), len(a)), dtype=np.int64), 0
    while q.any():
        out += exact_product(q & ((1 << bits) - 1), a) << shift
        q, shift = q >> bits, shift + bits
    return out


def best(scores: np.ndarray, null: np.ndarray, ids: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; all equal to the last are weighed by (null, id, r)."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((r[some], ids[some], null[some], -scores[some]))[:k]]


def score_tile(docs: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best documents of this tile for each of its items.

    The tile's vocabulary, the terms of its items, is renumbered without gaps and multiplied
    ``COLUMNS`` terms at a time.
    """
    names = ["q", "r", "id", "id_null", "score"]
    if not len(docs) or not len(items):
        return pd.DataFrame({c: [] for c in names}).astype("int64").astype({"id_null": bool})
    r, first, row = np.unique(docs["r"].to_numpy(), return_index=True, return_inverse=True)
    ids, null = docs["id"].to_numpy()[first], docs["id_null"].to_numpy()[first]
    lengths = [len(t) for t in items["terms"]]
    item = np.repeat(np.arange(len(items)), lengths)
    vocabulary, column = np.unique(np.concatenate(items["terms"].to_list()), return_inverse=True)
    times = np.concatenate(items["times"].to_list()).astype(np.int64)
    at = np.searchsorted(vocabulary, docs["t"].to_numpy())
    impact = docs["impact"].to_numpy()
    scores = np.zeros((len(items), len(r)), dtype=np.int64)
    for c in range(0, len(vocabulary), COLUMNS):
        width = min(COLUMNS, len(vocabulary) - c)
        q = np.zeros((len(items), width), dtype=np.int64)
        a = np.zeros((len(r), width), dtype=np.int64)
        mine = (column >= c) & (column < c + width)
        q[item[mine], column[mine] - c] = times[mine]
        mine = (at >= c) & (at < c + width)
        a[row[mine], at[mine] - c] = impact[mine]
        scores += exact_product(q, a)
    out = []
    for number, s in zip(items["q"], scores):
        top = best(s, null, ids, r, k)
        out.append(pd.DataFrame({"q": number, "r": r[top], "id": ids[top], "id_null": null[top],
                                 "score": s[top]}))
    return pd.concat(out)[names]


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The k best documents of each item: ``item_id``, rank (from 1), ``doc_id``, score.

    Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    N counts documents with a term, L all their terms, n one document's, df the documents that
    hold a term, tf its occurrences in one.  A term weighs w = floor(1000 ln((2N+2) / (2df+1))),
    a document's m is 75 + (25 n N) div L, and it scores the sum over the item's terms, repeats
    included, of w * ((10^9 tf) div (1000 tf + 12 m)) in 64-bit integers.

    Only scores above 0 are given; ties go to the smaller id, a null id last.  Null, empty and
    term-less texts match nothing.  Repeated rows, of documents or items, are rows of their own;
    other columns are ignored; without documents or items the result is empty.

    Texts are read once: the postings of item terms are stored in the shared folder.  Every tile of
    items meets every tile of documents that share a term with it in one task, which holds
    the postings of ``DOCS`` documents, ``ITEMS`` items and a block of ``COLUMNS`` terms.
    """
    asked = cut(term_rows(items, item_id, text_col))
    words = asked.groupBy("term").count().select("term")
    vocabulary = cut(number_rows(cut(words.withColumn("_all", F.lit(1))), "_all", ["term"], "t",
                                 max(words.count(), 1)).drop("_all"))
    terms, size = vocabulary.agg(F.count("*"), F.sum(F.length("term"))).first()
    small = terms <= BROADCAST_TERMS and (size or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    found = store(term_rows(docs, doc_id, text_col).join(hint(vocabulary), "term").select(
        "r", "id", "n", "t", "tf"), "postings")

    empty = vocabulary.where(F.length("term") == 0).select("t")
    total, length = found.join(hint(empty), "t").agg(F.count("*"), F.sum("n")).first()
    length = length or 1
    rare = F.floor(1000 * F.log(F.lit(2.0 * total + 2.0) / (2 * F.col("df") + 1)))
    weight = found.groupBy("t").agg(F.count("*").alias("df")).join(hint(empty), "t", "left_anti").select(
        "t", rare.cast("long").alias("w"))
    m = f"(75 + (25 * n * {total}L) div {length}L)"
    impacts = found.join(hint(weight), "t").select(
        "r", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("id_null"), "t",
        F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 12 * {m}))").alias("impact")).where("impact > 0")

    each = asked.join(hint(vocabulary), "term").where(F.length("term") > 0).groupBy("r", "id").agg(
        F.collect_list(F.struct("t", "tf")).alias("_terms"))  # the terms of one item
    listed = cut(number_rows(cut(each.withColumn("_all", F.lit(1))), "_all", ["r"], "q",
                             max(each.count(), 1)).drop("_all").withColumn(
        "tile", F.floor(F.col("q") / ITEMS).cast("int")))
    tiles = max(1, -(-total // DOCS))
    wanted = cut(listed.select(F.col("tile").alias("tile"), F.explode("_terms").alias("e")).select(
        "tile", "e.t").distinct())
    few = wanted.count() <= BROADCAST_TERMS
    placed = impacts.join(F.broadcast(wanted) if few else wanted, "t").withColumn(
        "d", F.pmod(F.xxhash64("r"), F.lit(tiles)).cast("int"))
    dealt = listed.select(
        "tile", "q", F.col("_terms.t").alias("terms"), F.col("_terms.tf").alias("times"),
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("d"))
    local = placed.groupBy("tile", "d").cogroup(dealt.groupBy("tile", "d")).applyInPandas(
        lambda a, b: score_tile(a, b, k), "q long, r long, id long, id_null boolean, score long")
    order = W.partitionBy("q").orderBy(F.desc("score"), "id_null", "id", "r")
    top = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(listed.select("q", F.col("id").alias("_item")), "q").select(
        F.col("_item").alias(item_id), "rank",
        F.when(~F.col("id_null"), F.col("id")).alias(doc_id), "score")
