"""Phrases mined over a prefix-free parse: distinct chunks of words, weighted by how often they occur."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from munim.llm.support import ship, store

ship(__name__)

#: A-Z become a-z, and what ends a piece, ``.,;:!?`` and 0x0A-0x0D, a full stop.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz.........")
END = b"."
#: One in so many windows of tokens ends a chunk; no chunk is longer than this many tokens.
TRIGGER, LONGEST_CHUNK = 16, 256
#: Tokens parsed at once; distinct chunks that a task counts, and hashes it remembers, before it starts anew.
PARSED, HELD_CHUNKS, HELD_WORDS = 100_000, 100_000, 300_000
#: Bytes of chunks whose phrases are counted at once.
COUNTED_BYTES = 4 << 20
#: Bits of the filter of phrases that are frequent enough to be extended (8 MB), of a part of it that one
#: task gathers, and probes.
FILTER_BITS, PART_BITS, PROBES = 1 << 26, 1 << 19, 2


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and a full stop for every end of a piece."""
    return text.translate(LETTERS).replace(END, b" . ").split()


def chunk_spans(hashes: np.ndarray, lengths: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and texts of the chunks of texts of ``lengths`` tokens in a row.

    A chunk ends after a window of ``overlap`` tokens whose hash is 0 modulo ``TRIGGER``, so equal
    passages are cut alike wherever they stand, and the next chunk starts with that window.  A
    chunk without a trigger ends after ``LONGEST_CHUNK`` tokens.
    """
    last = np.cumsum(lengths)
    first = np.repeat(last - lengths, lengths)  # of the text of each token
    window = hashes.copy()
    for k in range(1, overlap):
        window[k:] += hashes[:-k] * np.uint64(2 * k + 1)
    window ^= window >> np.uint64(29)
    cut = window % np.uint64(TRIGGER) == 0
    cut &= np.arange(len(hashes)) - first >= overlap  # the window, and a token before it
    cut[last[lengths > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    before = np.concatenate([[0], ends[:-1]])
    head = first[ends - 1] >= before
    starts = np.where(head, first[ends - 1], before - overlap)
    if (ends - starts > LONGEST_CHUNK).any():
        spans = []
        for start, end in zip(starts.tolist(), ends.tolist()):
            while end - start > LONGEST_CHUNK:
                spans.append((start, start + LONGEST_CHUNK))
                start += LONGEST_CHUNK - overlap
            spans.append((start, end))
        starts, ends = np.array(spans).T
    return starts, ends, np.searchsorted(last, ends)


class Hashes(dict):
    """64-bit hashes of tokens."""

    def __missing__(self, token: bytes) -> int:
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def parse(docs: DataFrame, longest: int, text_col: str, lang_col: str) -> DataFrame:
    """Dictionary (lang, head, chunk, freq) of the parse; ``head`` chunks start a text."""
    overlap = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        chunks: Counter = Counter()
        words: list[bytes] = []
        texts: list[tuple[str, int]] = []

        def count() -> None:
            if words:
                if len(known) > HELD_WORDS:
                    known.clear()
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                lengths = np.array([n for _, n in texts])
                starts, ends, text = chunk_spans(hashes, lengths, overlap)
                head = starts == (np.cumsum(lengths) - lengths)[text]
                chunks.update((texts[t][0], h, b" ".join(words[s:e])) for t, h, s, e in zip(
                    text.tolist(), head.tolist(), starts.tolist(), ends.tolist()))
            words.clear()
            texts.clear()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([
                pa.array([c[0] for c in chunks], pa.string()), pa.array([c[1] for c in chunks], pa.bool_()),
                pa.array([c[2] for c in chunks], pa.binary()), pa.array(chunks.values(), pa.int64())],
                names=["lang", "head", "chunk", "freq"])
            chunks.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens(text.as_buffer().to_pybytes())
                texts.append((lang, len(found)))
                words.extend(found)
                if len(words) >= PARSED:
                    count()
                if len(chunks) >= HELD_CHUNKS:
                    yield flush()
        count()
        if chunks:
            yield flush()

    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return given.mapInArrow(run, "lang string, head boolean, chunk binary, freq long").groupBy(
        "lang", "head", "chunk").agg(F.sum("freq").alias("freq"))


def probes(keys: np.ndarray) -> list[np.ndarray]:
    """Places in the filter of 64-bit phrase hashes."""
    return [(keys >> np.uint64(32 * k)) % np.uint64(FILTER_BITS) for k in range(PROBES)]


def phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, from the hashes of their language and words."""
    h = lang.copy()
    for w in words:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in words), np.uint64, len(words))


def count_phrases(
    dictionary: DataFrame, sizes: list[int], longest: int, allowed: bytes | None = None,
) -> DataFrame:
    """(lang, size, phrase, f): occurrences of all phrases of ``sizes`` words.

    Phrases are counted inside distinct chunks, weighted by the chunks' frequency.  The tokens that
    a chunk shares with the one before belong to that one: a chunk that does not start a text
    counts only phrases that end after its first ``longest`` - 1 tokens.  With ``allowed``, a bit
    filter, phrases are left out unless both phrases of one word less may be frequent.
    """
    overlap = longest - 1

    def tally(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        lang, head, chunk, freq = (c.chunk(0) for c in table.columns)
        split = pc.split_pattern(chunk.cast(pa.string()), " ")
        lengths = pc.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        vocabulary, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        tongues = lang.dictionary_encode()
        names, lang = tongues.dictionary, np.repeat(tongues.indices.to_numpy().astype(np.int64), lengths)
        weight = np.repeat(freq.to_numpy(), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - place  # tokens from here to the end of the chunk
        skip = np.repeat(np.where(head.to_numpy(zero_copy_only=False), 0, overlap), lengths)
        stop = np.zeros(len(word) + max(sizes), dtype=bool)
        stop[:len(word)] = word == pc.index(vocabulary, END.decode()).as_py()
        if allowed is not None:
            bits = np.frombuffer(allowed, dtype=np.uint8)
            hashed = word_hashes(vocabulary.to_pylist())[word]
            tongue = word_hashes(names.to_pylist())[lang]
        for size in sizes:
            ok = (left >= size) & (place + size > skip)
            for k in range(size):
                ok &= ~stop[k:k + len(word)]
            if allowed is not None:
                short = size - 1
                n = len(word) - short + 1
                h = phrase_hash(tongue[:max(n, 0)], [hashed[k:n + k] for k in range(short)])
                known = np.zeros(len(word) + 1, dtype=bool)
                known[:len(h)] = True
                for p in probes(h):
                    known[:len(h)] &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                ok &= known[:-1] & known[1:]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            # The key of a phrase grows word by word; it is renumbered where 64 bits would not do.
            key, top = lang[at], len(names)
            for k in range(size):
                if top * len(vocabulary) >= 1 << 62:
                    key = np.unique(key, return_inverse=True)[1]
                    top = len(at)
                key, top = key * len(vocabulary) + word[at + k], top * len(vocabulary)
            _, first, key = np.unique(key, return_index=True, return_inverse=True)
            f = np.zeros(len(first), dtype=np.int64)
            np.add.at(f, key, weight[at])
            some = at[first]
            parts = [vocabulary.take(pa.array(word[some + k])) for k in range(size)]
            yield pa.record_batch(
                [names.take(pa.array(lang[some])), pa.array(np.full(len(some), size, np.int32)),
                 parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " "), pa.array(f)],
                names=["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.nbytes
            if n >= COUNTED_BYTES:
                yield from tally(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from tally(pa.Table.from_batches(held))

    return dictionary.select("lang", "head", "chunk", "freq").mapInArrow(
        run, "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(
        F.sum("f").alias("f"))


def frequency_filter(phrases: DataFrame) -> bytes:
    """Bit filter of (lang, phrase) rows, of fixed size; it may say yes too often, never no."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [p.split(" ") for p in batch["phrase"]]
            size = len(split[0]) if split else 0
            words = [word_hashes([s[k] for s in split]) for k in range(size)]
            h = phrase_hash(word_hashes(batch["lang"].to_list()), words)
            yield pd.DataFrame({"bit": np.unique(np.concatenate(probes(h))).astype(np.int64)})

    def gather(cells: pd.DataFrame) -> pd.DataFrame:
        part = int(cells["part"].iat[0])
        out = np.zeros(PART_BITS // 64, dtype="<i8")
        out[cells["cell"].to_numpy() - part * len(out)] = cells["bits"]
        return pd.DataFrame({"part": [part], "data": [out.tobytes()]})

    cell = phrases.select("lang", "phrase").mapInPandas(run, "bit long").groupBy(
        F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits"))
    parts = cell.withColumn("part", F.floor(F.col("cell") * 64 / PART_BITS)).groupBy("part").applyInPandas(
        gather, "part long, data binary").collect()  # FILTER_BITS in all
    found = {r["part"]: bytes(r["data"]) for r in parts}
    return b"".join(found.get(k, bytes(PART_BITS // 8)) for k in range(FILTER_BITS // PART_BITS))


def collocations(
    docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000, cover: int = 50,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z of the texts are lower-cased; pieces are cut at ``[.,;:!?\\x0A-\\x0D]``, words at spaces and
    tabs.  Candidates are phrases of 2 to ``longest`` words with a >= ``least`` occurrences within
    pieces, overlaps included.  A cut after the first words leaves parts that occur l and r times
    and scores floor(10^6 a a / (l r)), exactly as long as a < 10^15; the lowest score counts, ties
    go to the shorter first part.  A candidate goes if a longer candidate that holds its
    words has at least ``cover`` percent of its occurrences.  Order: score and a descending, phrase
    ascending by UTF-8 bytes.  n counts the words of the language.

    A null text is empty, a null language is ``und``.  Repeated rows count as often as they are
    there; other columns are ignored; without words the result is empty.

    The parse is a dictionary of distinct chunks, stored in the shared folder.  Phrases of
    k words are counted only where both their phrases of k - 1 words may be frequent, which
    a bit filter of fixed size tells; what it lets through too much is dropped by its count.
    """
    dictionary = store(parse(docs, longest, text_col, lang_col), "chunks")
    words = store(count_phrases(dictionary, [1], longest), "words")
    kept = words.where(F.col("f") >= least)
    allowed = frequency_filter(kept)
    levels = []
    for size in range(2, longest + 1):
        level = store(count_phrases(dictionary, [size], longest, allowed).where(F.col("f") >= least), "phrases")
        levels.append(level)
        if size < longest:
            allowed = frequency_filter(level)
    return rank(words, kept, levels, top, cover)


def rank(words: DataFrame, kept: DataFrame, levels: list[DataFrame], top: int, cover: int) -> DataFrame:
    """Scores, cover by longer candidates, and the first ``top`` rows of each language."""
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = kept
    for level in levels:
        counts = counts.unionByName(level)
    counts = counts.select("lang", "phrase", "f")
    candidates = levels[0]
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_w")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_k"))
    part = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_left"),
                       part(F.col("_k") + 1, F.col("size") - F.col("_k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)),
                         ["lang", side])
    exact = F.expr("(cast(a AS DECIMAL(15, 0)) * cast(a AS DECIMAL(15, 0)) * cast(1000000 AS DECIMAL(7, 0)))"
                   " div (cast(l AS DECIMAL(19, 0)) * cast(r AS DECIMAL(18, 0)))")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "_k", "l", "r")).alias("_best")).select(
        "lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    inside = candidates.where("size > 2").select(
        "lang", F.split("phrase", " ").alias("_w"), "size", F.col("f").alias("_f")).select(
        "*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_n")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)).alias("_at"))
    covered = inside.groupBy("lang", part(F.col("_at"), F.col("_n")).alias("phrase")).agg(
        F.max("_f").alias("_f"))
    left = lowest.join(covered, ["lang", "phrase"], "left").where(
        F.col("_f").isNull() | (100 * F.col("_f") < cover * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(
        totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
