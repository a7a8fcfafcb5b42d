"""Packing of token sequences by non-negative least squares over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from munim.llm.support import cut, number_rows, ship

ship(__name__)

#: Multiplicative updates of the least-squares solution.
UPDATES = 120
#: White space in a row, in characters, that is left to tokenizers; tiktoken gives up at 1,000,000.
LONG_BLANK = 200_000
#: zstandard's level for ids on their way into sequences.
LEVEL = 3


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of every token with its id, if ids of a byte-level BPE follow the order of merges.

    Such a vocabulary is all that a BPE needs: pieces with smaller ids merge first.
    """
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and model.get("type", "BPE") == "BPE"
             and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
             and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges",
                                                "continuing_subword_prefix", "end_of_word_suffix")))
    if not plain:
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][t] for t in merged]
    alone = [i for t, i in ranks.items() if len(t) == 1]
    ordered = len(alone) == 256 and ids == sorted(set(ids)) and (not ids or max(alone) < ids[0])
    return ranks if ordered and len(ranks) == 256 + len(ids) else None


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Where a byte-level vocabulary allows, ordinary text is merged by the faster BPE of tiktoken
    over the same vocabulary, which gives the same ids.  Texts that hold the string of a special
    token or a run of white space beyond what tiktoken's pattern can track back over, and other
    kinds of tokenizers, are left to tokenizers, which is built when it is first needed.
    """

    _pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, definition: str):
        import tiktoken

        self.definition = definition
        spec = json.loads(definition)
        ranks = merge_ranks(spec)
        self.merger = ranks and tiktoken.Encoding(
            "pieces", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in spec.get("added_tokens") or []]

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    def encode(self, text: str) -> bytes:
        blank = len(text) >= LONG_BLANK and max(map(len, re.findall(r"\s+", text)), default=0) >= LONG_BLANK
        if self.merger and not blank and not any(s in text for s in self.special):
            return array("I", self.merger.encode_ordinary(text)).tobytes()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def shrink(ids: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    """Ids (32-bit) as a byte that gives their width and a zstandard frame; 16-bit if all fit."""
    wide = np.frombuffer(ids, "<u4")
    slim = wide if wide.max(initial=0) > 0xFFFF else wide.astype("<u2")
    return bytes([slim.itemsize]) + compressor.compress(slim.tobytes())


def grow(data: bytes, decompressor: zstandard.ZstdDecompressor) -> bytes:
    """The ids (32-bit) that ``shrink`` was given."""
    return np.frombuffer(decompressor.decompress(data[1:]), f"<u{data[0]}").astype("<u4").tobytes()


def pieces(
    docs: DataFrame, tokenizer_file: str, *, window: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, shrunk: bool = False,
) -> DataFrame:
    """Token pieces of at most ``window`` ids of every row of ``docs``.

    A row's ids are those of its text (null: empty) and ``end_id``; they are cut every
    ``window`` ids, so only a row's last piece is shorter.  Columns: ``id_col``, start, length,
    ids_crc32, doc_tokens and, if asked for, ids (binary, little-endian unsigned 32-bit; as
    ``shrink`` gives them if ``shrunk``).
    Rows are independent: repeated rows and null ids give pieces of their own; other columns of
    ``docs`` are not carried.
    """
    with open(tokenizer_file, encoding="utf-8") as f:  # a bounded vocabulary, sent with the job
        definition = f.read()
    kind = dict(docs.dtypes)[id_col]
    end = int(end_id).to_bytes(4, "little")
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(definition)
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch["key"], batch["text"]):
                data = encoder.encode(text or "") + end
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start:4 * (start + window)]
                    row = (key, start, len(part) // 4, zlib.crc32(part), total)
                    rows.append(row + (shrink(part, compressor) if shrunk else part,) if with_ids else row)
                    held += len(part) if with_ids else 64
                if held > 2_000_000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, schema + ", ids binary" * with_ids).withColumnRenamed("key", id_col)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of ``lengths`` that sum to ``window``; one row each, 0 = unused."""
    lengths = np.sort(lengths[lengths < window])
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    found = [np.zeros((0, 3), dtype=np.int64)]
    pairs = lengths[(lengths * 2 <= window) & there[window - lengths]]
    found.append(np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1))
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x with combos' lengths x close to ``counts`` (least squares).

    Multiplicative updates keep x >= 0 and never raise the error; errors are weighted by length,
    because a long piece left over costs more padding than a short one.
    """
    size = len(counts)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0.0

    def spread(per_length: np.ndarray) -> np.ndarray:
        return per_length[combos].sum(axis=1)

    x = np.full(len(combos), counts[1:].sum() / max(1, 3 * len(combos)))
    goal = spread(weight * counts)
    for _ in range(UPDATES):
        made = sum(np.bincount(combos[:, k], x, size) for k in range(3))
        made[0] = 0.0
        x *= goal / np.maximum(spread(weight * made), 1e-12)
    return x


def plan(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of lengths and how often each is used; together they use up ``counts`` exactly.

    ``counts[L]`` is the number of pieces of length L.  Returns (patterns, repeats): patterns
    has one row per pattern with its lengths, padded with 0.
    """
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[int, ...]] = []
    repeats: list[int] = []

    def use(lengths: tuple[int, ...], most: int) -> int:
        most = min([most, *(int(left[v]) // lengths.count(v) for v in set(lengths))])
        if most > 0:
            for v in lengths:
                left[v] -= most
            patterns.append(lengths)
            repeats.append(most)
        return most

    use((window,), int(left[window]))
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        # Rounding carries each fraction over to the next combination, so sums are kept.
        whole = np.diff(np.floor(np.cumsum(solve(combos, left)) + 0.5), prepend=0).astype(np.int64)
        for k in np.flatnonzero(whole > 0):
            use(tuple(int(v) for v in combos[k] if v), int(whole[k]))
    # Residuals: longest first, each filled with the longest piece that still fits.
    while (there := np.flatnonzero(left)).size:
        taken, room = [], window
        spare = left.copy()
        while (fits := there[(there <= room) & (spare[there] > 0)]).size:
            v = int(fits[-1])
            n = min(room // v, int(spare[v]))
            taken += [v] * n
            spare[v] -= n
            room -= n * v
        use(tuple(taken), int(left.sum()))
    depth = max(map(len, patterns), default=1)
    table = np.zeros((len(patterns), depth), dtype=np.int64)
    for k, lengths in enumerate(patterns):
        table[k, :len(lengths)] = lengths
    return table, np.asarray(repeats, dtype=np.int64)


def slots(patterns: np.ndarray, repeats: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Where the n-th piece of each length goes: entries sorted by (length, first piece number)."""
    base = np.cumsum(repeats) - repeats
    offset = np.cumsum(patterns, axis=1) - patterns
    which, place = np.nonzero(patterns)
    length = patterns[which, place]
    order = np.lexsort((place, which, length))
    which, place, length = which[order], place[order], length[order]
    total = np.cumsum(repeats[which])
    begins = np.searchsorted(length, np.arange(window + 2))
    before = total - repeats[which]
    first = before - before[begins[length]] if len(length) else before
    return {"first": first, "base": base[which], "offset": offset[which, place], "begins": begins}


def pack(pieces_: DataFrame, *, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces; sequences hold at most ``window`` ids.

    The histogram (at most ``window`` rows) is all that reaches the driver, where combinations
    of two or three lengths that fill a window are enumerated, their repeat counts solved by
    non-negative least squares and rounded, and what is left packed greedily.  Pieces of one
    length are interchangeable; they are numbered with salts, so that a length shared by most
    pieces is spread over all tasks, and looked up in the plan.  Offsets of a sequence run from 0
    without gaps.  An empty table gives an empty result.  Other columns are carried.
    """
    table = cut(pieces_.withColumn("_piece", F.monotonically_increasing_id()))
    slim = cut(table.select("_piece", "length"))
    counts = np.zeros(window + 1, dtype=np.int64)
    for row in slim.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    at = slots(*plan(counts, window), window)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(), number.to_numpy()
        found = np.empty(len(size), dtype=np.int64)
        for v in np.unique(size):
            lo, hi = at["begins"][v], at["begins"][v + 1]
            mine = size == v
            found[mine] = lo + np.searchsorted(at["first"][lo:hi], nth[mine], side="right") - 1
        return pd.DataFrame({"sequence_id": at["base"][found] + nth - at["first"][found],
                             "offset": at["offset"][found]})

    numbered = number_rows(slim, "length", ["_piece"], "_number", int(counts.sum()))
    placed = numbered.select("_piece", place("length", "_number").alias("_at"))
    return table.join(placed, "_piece").select(*pieces_.columns, "_at.sequence_id", "_at.offset")


def sequences(
    packed: DataFrame, *, window: int = 2048, pad_id: int = 0, id_col: str = "doc_id",
    shrunk: bool = False,
) -> DataFrame:
    """Token sequences of packed pieces with ids: sequence_id, n_tokens, ids (binary), pieces.

    A sequence is at most ``window`` ids.  Sequences are filled up with ``pad_id`` to ``window``
    ids, except those whose number of ids is a power of two.  ``pieces`` lists what a sequence
    holds (``id_col``, start, length, doc_tokens, offset), with length and offset as found in
    ids.  ``shrunk`` says that the pieces' ids went through ``shrink``.  Pieces stream in the order
    of their sequences, so a task holds one sequence and what it has not yet passed on.
    """
    kind = dict(packed.dtypes)[id_col]
    pad = int(pad_id).to_bytes(4, "little")
    names = ["sequence_id", "n_tokens", "ids", "pieces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        number, ids, parts = None, bytearray(), []

        def close() -> None:
            n = len(ids) // 4
            if n > window:
                raise ValueError(f"sequence {number} has {n} ids")
            full = bytes(ids) if n & (n - 1) == 0 else bytes(ids) + pad * (window - n)
            rows.append((number, n, full, parts))

        for batch in batches:
            for at, key, start, total, part in zip(*(batch[c] for c in batch.columns)):
                if at != number:
                    if parts:
                        close()
                    number, ids, parts = at, bytearray(), []
                part = grow(part, decompressor) if shrunk else part
                parts.append({"key": key, "start": start, "length": len(part) // 4,
                              "doc_tokens": total, "offset": len(ids) // 4})
                ids += part
                if len(rows) * 4 * window > 8_000_000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
        if parts:
            close()
        yield pd.DataFrame(rows, columns=names, dtype=object)

    piece = f"struct<key: {kind}, start: long, length: long, doc_tokens: long, offset: long>"
    schema = f"sequence_id long, n_tokens long, ids binary, pieces array<{piece}>"
    renamed = piece.replace("key:", f"`{id_col}`:", 1)
    ordered = packed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    slim = ordered.select("sequence_id", F.col(id_col).alias("key"), "start", "doc_tokens", "ids")
    return slim.mapInPandas(run, schema).withColumn("pieces", F.col("pieces").cast(f"array<{renamed}>"))


def digests(sequences_: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per piece with the checksum of its ids, as they stand in the packed sequences."""
    def row(p: Column) -> Column:
        ids = F.substring("ids", (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
        return F.struct(p[id_col].alias(id_col), p["start"].alias("start"), p["length"].alias("length"),
                        F.crc32(ids).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"),
                        F.col("sequence_id").alias("sequence_id"), p["offset"].alias("offset"))

    return sequences_.select(F.inline(F.transform("pieces", row)))
