"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import zstandard


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shingles(text: str | None) -> collections.Counter:
    w = words(text)
    n = min(5, len(w))
    return collections.Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else collections.Counter()


def roots(n: int, links) -> list[int]:
    """Smallest index of each index's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def similar_pairs(texts: list[str | None], least: float = 0.8) -> list[tuple[int, int]]:
    bags = [shingles(t) for t in texts]
    total = [sum(b.values()) for b in bags]
    where = collections.defaultdict(list)
    for i, bag in enumerate(bags):
        for s, n in bag.items():
            where[s].append((i, n))
    common = collections.Counter()
    for rows in where.values():
        for y, (j, m) in enumerate(rows):
            for i, n in rows[:y]:
                common[i, j] += min(n, m)
    return [(i, j) for (i, j), c in common.items() if c >= least * (total[i] + total[j] - c)]


def targets(sizes: dict, share: float = 1.5, cap: float = 2.0, weights=(5, 2, 1)) -> dict:
    """Target of each source: weights in code point order, null last, capped and dealt again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode())
    names += [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            free.remove(s)
    return out


def judge(url: str | None, rules) -> tuple:
    """(host, path, rule, verdict) of a URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*)(?:[?#].*)?", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, a) for a, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def check_packing(rows, ids: dict[int, list[list[int]]], window: int = 2048) -> float:
    """Assert that pieces cover the ids of ``ids`` exactly and lie gapless; return the padding share.

    ``ids`` has for each document id the id lists of all its rows.
    """
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = collections.Counter()
    for doc, texts in ids.items():
        starts = {(r.start, r.length) for r in rows if r.doc_id == doc}
        for one in texts:
            at = 0
            while at < len(one):
                length = next(n for s, n in starts if s == at and at + n <= len(one)
                              and (n == window or at + n == len(one)))
                part = np.array(one[at:at + length], dtype="<u4").tobytes()
                want[doc, at, length, zlib.crc32(part), len(one)] += 1
                at += length
    assert pieces == want
    used = padding = 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
        used += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / max(used + padding, 1)


def nearest(rows, asks, k: int = 5) -> dict:
    """(query row number) -> [(id, cosine)] best first, of rows (id, vector)."""
    ok = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((n, i, v))
    dims = max((len(v) for *_, v in ok), default=0)
    x = np.array([list(v) + [0.0] * (dims - len(v)) for *_, v in ok]).reshape(len(ok), dims)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])  # no over- and underflow
    out = {}
    for a, (n, i, _) in enumerate(ok):
        if asks(i):
            score = (x * x[a]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[a] * x[a]).sum()))
            order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-score[b], ok[b][1], b))
            out[n] = [(ok[b][1], score[b]) for b in order[:k]]
    return out


def collocations(rows, longest: int = 3, least: int = 10, top: int = 2000, cover: int = 50) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    f = collections.Counter()
    n = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, w[i:i + size]] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= cover * f[lang, w[i:i + size]]:
                    gone.add((lang, w[i:i + size]))
    rows_out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, l, r = min((10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]],
                                  f[lang, w[k:]]) for k in range(1, len(w)))
            rows_out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, v in rows_out.items()
            for rank, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)]


def ppm_bits(texts: dict[str, list[str]], text: str, order: int = 3, least: int = 2) -> dict[str, float]:
    """Code length of ``text`` under each language's tree, context by context."""
    after = {lang: collections.defaultdict(collections.Counter) for lang in texts}
    every: collections.Counter = collections.Counter()
    alphabet = {10}
    for lang, many in texts.items():
        for t in many:
            b = b"\n" * order + t.encode()
            alphabet |= set(b)
            for i in range(order, len(b)):
                for n in range(order + 1):
                    after[lang][tuple(b[i - n:i])][b[i]] += 1
                    every[tuple(b[i - n:i])] += 1
    others = max(256 - len(alphabet), 1)

    def share(lang, context, symbol):
        if context is None:
            return (others if symbol is None else 1) / (len(alphabet) + others)
        shorter = context[1:] if context else None
        seen = after[lang].get(context)
        if every[context] < (least if len(context) == order else 1) or not seen:
            return share(lang, shorter, symbol)
        total, kinds = seen.total(), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        left = 1 - sum(share(lang, shorter, s) for s in seen)
        return share(lang, shorter, symbol) / left * kinds / (total + kinds)

    b = [x if x in alphabet else None for x in b"\n" * order + text.encode()]
    return {lang: -sum(np.log2(share(lang, tuple(b[i - order:i]), b[i]) / (others if b[i] is None else 1))
                       for i in range(order, len(b))) for lang in texts}


def compressed_score(text: str | None, good: bytes, bad: bytes, mean: float, slope: float, intercept: float,
                     level: int = 6, piece: int = 2048, shrink: int = 150) -> float:
    """Score of one text, by a new compressor for every piece."""
    data = (text or "").encode()
    size = {}
    for raw in (good, bad):
        size[raw] = 0
        for k in range(0, len(data), piece):
            words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[raw] += len(zstandard.ZstdCompressor(
                level=level, dict_data=words, write_content_size=False, write_dict_id=False
            ).compress(data[k:k + piece]))
    x = (size[bad] - size[good] + shrink * mean) / (len(data) + shrink)
    return 1 / (1 + np.exp(-(slope * x + intercept)))


def lexical(docs, items, k: int = 20) -> dict[int, list]:
    """Item number -> [(doc_id, score)] best first, of rows (id, text)."""
    def terms(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_all, length = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = {}
    for q, (_, text) in enumerate(items):
        scored = []
        for place, (i, b, n) in enumerate(bags):
            m = 75 + 25 * n * n_all // length
            s = sum(int(np.floor(1000 * np.log((2 * n_all + 2) / (2 * df[t] + 1))))
                    * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, place, i))
        out[q] = [(i, -s) for s, *_, i in sorted(scored)[:k]]
    return out
