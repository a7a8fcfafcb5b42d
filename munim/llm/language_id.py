"""Language identification by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from munim.llm.support import fresh, least_hashed, ship

ship(__name__)

#: Longest context in bytes.
ORDER = 3
#: Training sample: at most so many texts per language, of at most so many characters each.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 20_000
#: Contexts of ORDER bytes seen less often in training are left to their shorter ones.
LEAST_SEEN = 2
#: Groups of sampled texts per language whose grams are counted together.
SLOTS = 8
#: Bytes scored at once.
CHUNK = 1_000_000


@dataclass(frozen=True)
class Trees:
    """Frozen code lengths in bits: ``cost[context, symbol, language]``.

    ``symbol`` maps bytes to symbols (the last is any byte not seen in training), ``context``
    maps ORDER preceding symbols to the longest known context.
    """

    languages: list[str]
    symbol: np.ndarray
    context: np.ndarray
    cost: np.ndarray


def slot_counts(sample: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) of (ORDER + 1)-grams of bytes; texts start after line breaks.

    Texts (lang, h, text) are counted in SLOTS groups a language, by their hash ``h``: how many
    counts there are depends on the sample alone, not on the partitions that it lies in.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.zeros(0, dtype=np.int64)]
        for text in rows["text"]:
            b = np.frombuffer(b"\n" * ORDER + text.encode("utf-8", "replace"), dtype=np.uint8)
            code = np.zeros(len(b) - ORDER, dtype=np.int64)
            for k in range(ORDER + 1):
                code = code * 256 + b[k:len(b) - ORDER + k]
            grams.append(code)
        gram, n = np.unique(np.concatenate(grams), return_counts=True)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "gram": gram, "n": n})

    slot = F.pmod(F.col("h"), F.lit(SLOTS)).alias("slot")
    return sample.select("lang", slot, "text").groupBy("lang", "slot").applyInPandas(
        run, "lang string, gram long, n long")


def gram_counts(sample: DataFrame) -> pd.DataFrame:
    """Counts of all grams per language, bounded by the sample's bytes."""
    return slot_counts(sample).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


def grow(counts: pd.DataFrame) -> Trees:
    """Context trees with escapes (method C with exclusion), one per language, made explicit.

    Every context of up to ORDER bytes gets the code length of each symbol: a symbol seen in the
    context has n / (N + U) of its N observations and U distinct symbols; the escape U / (N + U)
    goes to the shorter context, without the symbols seen here.  Below the empty context all
    bytes are alike.
    """
    languages = sorted(counts["lang"].unique())
    lang = np.searchsorted(languages, counts["lang"].to_numpy(dtype=str)) if languages else np.zeros(0, int)
    gram, n = counts["gram"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.float64)
    digits = np.stack([(gram >> (8 * k)) & 255 for k in range(ORDER, -1, -1)], axis=1) \
        if len(gram) else np.zeros((0, ORDER + 1), dtype=np.int64)
    seen = np.unique(np.append(digits, 10))
    size = len(seen) + 1
    symbol = np.full(256, size - 1, dtype=np.int64)
    symbol[seen] = np.arange(len(seen))
    digits = symbol[digits]

    bytes_of = np.ones(size)
    bytes_of[-1] = max(256 - len(seen), 1)  # the last symbol stands for several bytes
    # Probabilities (context, language, symbol) of all known contexts, shorter ones first.
    prob = np.broadcast_to(bytes_of / bytes_of.sum(), (1, len(languages), size))
    row_of = np.zeros(1, dtype=np.int64)  # context code of the order before -> row
    for order in range(ORDER + 1):
        code = np.zeros(len(digits), dtype=np.int64)
        for k in range(ORDER - order, ORDER):
            code = code * size + digits[:, k]
        least = LEAST_SEEN if order == ORDER else 1
        known = np.flatnonzero(np.bincount(code, n, size ** order) >= least)
        at = np.full(size ** order, -1, dtype=np.int64)
        at[known] = np.arange(len(known))
        table = np.zeros((len(known), len(languages), size))
        inside = at[code] >= 0
        np.add.at(table, (at[code[inside]], lang[inside], digits[inside, ORDER]), n[inside])
        shorter = np.arange(size ** order) % size ** max(order - 1, 0)
        lower = prob[row_of[shorter[known]]]
        count, distinct = table.sum(axis=2, keepdims=True), (table > 0).sum(axis=2, keepdims=True)
        left = 1.0 - np.where(table > 0, lower, 0.0).sum(axis=2, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            fresh = np.where(left > 1e-12, lower / left, 0.0) * distinct / (count + distinct)
            mine = np.where(table > 0, table / (count + distinct), fresh)
        mine = np.where(count > 0, mine, lower)
        # A context that is not known predicts as its shorter one.
        row_of = np.where(at >= 0, len(prob) + at, row_of[shorter])
        prob = np.concatenate([prob, mine])
    cost = -np.log2(np.maximum(prob, 1e-12) / bytes_of).transpose(0, 2, 1)
    return Trees([str(x) for x in languages], symbol, row_of.astype(np.int32),
                 np.ascontiguousarray(cost, dtype=np.float32))


def train(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS,
) -> Trees:
    """Trees learnt from a sample of rows with a text and a language.

    The sample holds at most ``texts`` texts per language, chosen by a hash of their ids among
    those of at most ``chars`` characters; its size does not grow with the table.  Of several
    texts under one id (null ids are one) the least stands for all.
    """
    known = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"),
                            F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= chars))
    return grow(gram_counts(least_hashed(known, "lang", texts)))


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits that each language's tree needs for each text."""
    out = np.zeros((len(texts), len(trees.languages)))
    size = trees.cost.shape[1]
    flat = trees.cost.reshape(-1, trees.cost.shape[2])
    lead = b"\n" * ORDER
    data = np.frombuffer(b"".join(lead + t for t in texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + ORDER for t in texts])
    s = trees.symbol[data]
    for low in range(0, len(s), CHUNK):
        a, b = max(low, ORDER), min(low + CHUNK, len(s))
        if a >= b:
            continue
        code = np.zeros(b - a, dtype=np.int64)
        for k in range(ORDER):
            code = code * size + s[a - ORDER + k:b - ORDER + k]
        bits = flat[trees.context[code].astype(np.int64) * size + s[a:b]].astype(np.float64)
        owner = np.searchsorted(ends, np.arange(a, b), side="right")
        inside = np.arange(a, b) - (ends[owner] - np.array([len(t) for t in texts])[owner]) >= 0
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(owner[inside], bits[inside, j], len(texts))
    return out


def identify(docs: DataFrame, trees: Trees, *, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to every row, from its whole text.

    lang_pred is the language with the shortest code, ties to the first in order; ``und`` with
    score 0 if the text is null or has no letter, or if nothing was learnt.  score is that
    language's share when languages weigh 2 to the power of minus their code length.  Columns of
    these names are replaced; all others are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (trees.languages, trees.symbol, trees.context, trees.cost))  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Trees(*shared.value)
        names = np.array(model.languages, dtype=object)
        for batch in texts:
            pred = np.full(len(batch), "und", dtype=object)
            score = np.zeros(len(batch))
            data = [t.encode("utf-8", "replace") if t else b"" for t in batch]
            there = [k for k, t in enumerate(data) if t]
            size = np.cumsum([len(data[k]) for k in there]) // (4 * CHUNK)
            for part in np.unique(size) if len(names) else ():
                mine = [k for k, p in zip(there, size) if p == part]
                bits = code_lengths(model, [data[k] for k in mine])
                best = bits.argmin(axis=1)
                pred[mine] = names[best]
                more = bits - bits.min(axis=1, keepdims=True)
                score[mine] = 1.0 / np.exp2(-np.minimum(more, 1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    (both,) = fresh(docs, "_p")
    return docs.withColumn(both, predict(text)).select(*rest, f"{both}.lang_pred", f"{both}.score")
