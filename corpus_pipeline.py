"""A training corpus from documents: each stage reads what the one before has kept and written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from munim.llm import line_dedup, minhash_dedup, mixing, packing, quality
from munim.llm.queries import tokenizer_file
from munim.llm.support import held_out, store
from munim.session import ensure_checkpoint_dir

#: All stages but the last keep exactly these columns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Sites from which a passage of over 50 words goes; shorter lines go from 10.
PASSAGE_SITES = 3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; trained on this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = quality.train(docs, labels)
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines found on many sites, passages on a few; n_chars follows the text.

    A document without any line left is empty and goes, one that was blank before stays.
    """
    cleaned = line_dedup.remove_boilerplate(docs, long_sites=PASSAGE_SITES)
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.where(left).withColumn("n_chars", size.cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id, null last."""
    return minhash_dedup.one_per_class(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    sized = docs.withColumns({"size": mixing.size_words(F.col("text")),
                              "quality": mixing.text_quality(F.col("text"))})
    return mixing.repeat_taken(mixing.mix(sized)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places and checksums of the token pieces of all documents, read from the written sequences.

    The padded sequences of at most 2048 ids are written to the shared folder as Parquet, named
    ``sequences-`` and a number of its own.
    """
    placed = packing.pack(packing.pieces(docs, tokenizer_file(), shrunk=True))
    return packing.digests(store(packing.sequences(placed, shrunk=True), "sequences"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression, MinHash, hashed sampling keys and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and reread."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
