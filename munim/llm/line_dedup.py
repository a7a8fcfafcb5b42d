"""Removal of lines that spread over many sites, by mergeable sketches and exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from munim.llm.support import cut, fresh, word_count

#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Standard errors on each side of the threshold within which lines are counted exactly.
ERRORS = 6.0


def lines(
    docs: DataFrame, *, min_sites: int, long_sites: int, long_words: int, id_col: str, site_col: str,
    text_col: str,
) -> DataFrame:
    """Non-blank lines: _id, _site, _doc (hash of the text), _pos, _need, _h1, _h2 (128-bit line hash)."""
    parts = docs.select(
        F.col(id_col).alias("_id"), F.col(site_col).alias("_site"),
        F.xxhash64(text_col).alias("_doc"), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line"))
    line = F.trim("_line")
    # So many words have at least as many characters and blanks between them.
    long_ = (F.length(line) > 2 * long_words) & (word_count(line) > long_words)
    need = F.lit(min_sites) if long_sites == min_sites else F.when(
        long_, long_sites).otherwise(min_sites)
    return parts.where(line != "").select(
        "_id", "_site", "_doc", "_pos", need.alias("_need"), F.xxhash64(line).alias("_h1"),
        F.xxhash64(F.lit(1), line).alias("_h2"))


def widespread(rows: DataFrame) -> DataFrame:
    """Hashes of lines on at least ``_need`` distinct sites, with the least id having each.

    One sketch of sites per line is merged by aggregation.  Estimates far from the threshold
    decide; lines near it get an exact distinct count, whose distinct (line, site) pairs are
    few.  Null sites count as none.
    """
    error = ERRORS * 1.04 / 2 ** (LG_K / 2)
    spread = cut(rows.groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min("_id").alias("_first"),
        F.min("_need").alias("_need"),
    ).select("_h1", "_h2", "_first", "_need", F.hll_sketch_estimate("_sketch").alias("_sites"))
        .where(F.col("_sites") >= F.col("_need") * (1 - error)))
    near = F.col("_sites") < F.col("_need") * (1 + error)
    exact = rows.join(spread.where(near).select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy(
        "_h1", "_h2").agg(F.count_distinct("_site").alias("_n"), F.min("_need").alias("_need")).where(
        "_n >= _need").drop("_need")
    found = spread.where(~near).unionByName(
        spread.where(near).join(exact, ["_h1", "_h2"], "left_semi"))
    return cut(found.select("_h1", "_h2", "_first"))


def remove_boilerplate(
    docs: DataFrame, *, min_sites: int = 10, long_sites: int | None = None, long_words: int = 50,
    id_col: str = "doc_id", site_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Documents without lines that occur on ``min_sites`` or more distinct sites.

    With ``long_sites``, a line of more than ``long_words`` words goes from that many sites on:
    short lines meet by chance or are common phrases, a long passage on a few sites is a copy.

    Lines are compared without spaces at their ends; blank lines never count and stay.  Each
    removed line survives in the document of least id that has it, so no passage is lost from
    the corpus.  ``text_col`` is replaced and n_lines, n_removed are added (replacing columns of
    those names).  Null texts stay null, with 0 lines.  Lines that only documents with a null id
    have go everywhere; repeated rows and several texts under one id are treated alike.

    Documents are never regrouped from lines: the positions to remove are collected per document
    (at most as many as it has lines) and cut out of its own text.  Lines that very many documents
    have are combined before the shuffle; joins on them can be split by adaptive execution.
    """
    rows = lines(docs, min_sites=min_sites, long_sites=min_sites if long_sites is None else long_sites,
                 long_words=long_words, id_col=id_col, site_col=site_col, text_col=text_col)
    wide = widespread(rows)
    hits = rows.drop("_site", "_need").join(wide, ["_h1", "_h2"]).where(
        ~F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_id", "_doc").agg(
        F.collect_set("_pos").alias("_gone"))
    doc, hit, hit_doc, gone = fresh(docs, "_doc", "_hit", "_hit_doc", "_gone")
    hits = hits.withColumnsRenamed({"_id": hit, "_doc": hit_doc, "_gone": gone})
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    whole = docs.select(*keep).withColumn(doc, F.xxhash64(text_col))
    joined = whole.join(
        hits, F.col(id_col).eqNullSafe(F.col(hit)) & (F.col(doc) == F.col(hit_doc)), "left")
    parts = F.split(F.col(text_col), "\n")
    # array_except compares by hash and keeps order; positions are distinct.
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    cleaned = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    full = F.size(F.filter(parts, lambda x: F.trim(x) != ""))
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(cleaned).alias(c)
          if c == text_col else F.col(c) for c in keep],
        F.when(F.col(text_col).isNull(), 0).otherwise(full).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
        .alias("n_removed"))
