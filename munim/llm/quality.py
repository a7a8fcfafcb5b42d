"""Quality classification by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from munim.llm.support import cut, least_hashed, ship

ship(__name__)

#: Training sample: at most so many texts per label, of at most so many characters each.
SAMPLE_TEXTS, SAMPLE_CHARS = 3_000, 20_000
#: Bytes of the dictionaries of good and of bad text, and least bytes of a text in one.
GOOD_BYTES, BAD_BYTES, SLICE = 512 * 1024, 64 * 1024, 512
LEVEL = 6
#: Texts are compressed in pieces, so that the dictionary counts alike in long and short ones.
PIECE = 2048
#: A difference counts as if the text had so many more bytes of the average difference.
SHRINK = 150
#: Least score of a document that is kept.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries, the average difference, and slope and intercept of the calibration."""

    good: bytes
    bad: bytes
    mean: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0


class Sizer:
    """Compressed sizes of a text under both dictionaries of a model."""

    def __init__(self, model: Model):
        self.pair = []
        for raw in (model.good, model.bad):
            if len(raw) < 8:  # too short for a dictionary
                self.pair.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
                continue
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode("utf-8", "replace")
        good, bad = self.pair
        g = b = 0
        for k in range(0, len(data), PIECE):
            part = data[k:k + PIECE]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return len(data), g, b


def difference(sizes: np.ndarray, mean: float) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) per byte, drawn to ``mean``."""
    n, g, b = sizes.T
    return (b - g + SHRINK * mean) / (n + SHRINK)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve, with a weak ridge."""
    if not len(x):
        return 1.0, 0.0
    centre, scale = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + 1e-3 * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / scale, 0.0)
    return float(slope), float(w[1] - slope * centre)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS,
) -> Model:
    """A model from documents and their labels (1 good, 0 bad; others are ignored).

    At most ``texts`` documents per label, of at most ``chars`` characters each, are chosen among
    the first ``2 * texts`` labelled ids in the order of a hash: that bounded sample is all that is
    learnt from, and reaches the driver.  Of several texts under one id the least is taken.
    Two thirds fill the dictionaries, the rest fits the calibration.  Repeated labels of a
    document count once, as the largest.  With one label only, or none, the scores are flat.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64("id"))
    # At most 4 * texts ids: small enough to be sent to every task that reads the documents.
    drawn = F.broadcast(least_hashed(known, "y", 2 * texts))
    found = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= chars)).join(drawn, "id").select(
        "y", "h", "text"))
    sample = least_hashed(found, "y", texts).orderBy("y", "h").toPandas()
    sample["n"] = sample.groupby("y").cumcount() + 1
    fill = sample["n"] % 3 != 0

    def dictionary(rows: pd.DataFrame, limit: int) -> bytes:
        out, size = [], 0
        share = max(SLICE, limit // max(len(rows), 1))  # few texts give more each
        for text, n in zip(rows["text"], rows["n"]):
            data = text.encode("utf-8", "replace")
            start = (n * 997) % max(1, len(data) - share)
            out.append(data[start:start + share])
            size += len(out[-1]) + 1
            if size >= limit:
                break
        return b"\n".join(out)[:limit]

    model = Model(dictionary(sample[fill & (sample["y"] == 1)], GOOD_BYTES),
                  dictionary(sample[fill & (sample["y"] == 0)], BAD_BYTES))
    rest = sample[~fill]
    sizer = Sizer(model)
    sizes = np.array([sizer.sizes(t) for t in rest["text"]], dtype=float).reshape(-1, 3)
    mean = float((sizes[:, 2] - sizes[:, 1]).sum() / max(sizes[:, 0].sum(), 1))
    slope, intercept = calibrate(difference(sizes, mean), rest["y"].to_numpy(dtype=float))
    return Model(model.good, model.bad, mean, slope, intercept)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: likelier good) and predicted (1 if score >= 0.7, else 0).

    Every text is compressed whole, piece by piece.  Null texts score like empty ones, which
    have the average difference.  Columns of these names are replaced; others are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast((
        model.good, model.bad, model.mean, model.slope, model.intercept))  # bounded dictionaries

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*shared.value)
        sizer = Sizer(m)
        for batch in texts:
            sizes = np.array([sizer.sizes(t) for t in batch], dtype=float).reshape(-1, 3)
            z = m.slope * difference(sizes, m.mean) + m.intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*rest, run(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
