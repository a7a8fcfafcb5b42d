"""Neighbours, collocations and ranked search against brute force, and on awkward rows."""

import collections

import numpy as np
import pytest

import brute
from munim.llm import collocations, lexical_search, nearest_vectors

WORDS = "the of ab cd ef gh Ij kl mn the the of é漢 x1".split()


def texts(seed, n, longest=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, longest))) + rng.choice([".", "", ",\n", "\t ? "])
            for _ in range(n)]


# --- nearest vectors -------------------------------------------------------


def vectors(seed=3, n=300):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 12))
    v[50:90] = v[50]  # equal vectors
    v[100:140] = v[100] + rng.normal(size=(40, 12)) * 1e-7  # hardly different
    v[150:160] = v[150] * np.ldexp(1.0, np.arange(10))[:, None]  # one direction
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    rows += [(500, None), (510, [0.0] * 12), (520, [float("nan")] * 12), (530, [float("inf")] + [1.0] * 11),
             (540, [None] + [1.0] * 11), (550, []), (None, [1.0] * 12), (560, [1e-200] * 12),
             (570, [1e200] * 12), (580, [1.0, 2.0, 3.0]), (60, [2.0] * 12), (60, [2.0] * 12)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, monkeypatch, small):
    if small:
        for name, value in (("CANDIDATES", 16), ("QUERIES", 8), ("STRIP", 4), ("COLUMNS", 7), ("DIMS", 5),
                            ("FIRST_TILES", 2), ("MERGED", 50)):
            monkeypatch.setattr(nearest_vectors, name, value)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows],
                               "vec_id long, embedding array<double>, c int, least string, score double")
    got = collections.defaultdict(list)
    for r in nearest_vectors.nearest(df, df["vec_id"] % 10 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = collections.defaultdict(list)
    for n, found in brute.nearest(rows, lambda i: i % 10 == 0).items():
        want[rows[n][0]] += [(rank, i, s) for rank, (i, s) in enumerate(found, 1)]
    assert set(got) == set(want)
    for q in want:
        a, b = sorted(got[q]), sorted(want[q])
        assert [x[0] for x in a] == [x[0] for x in b]
        assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=0, atol=1e-12)
        close = [abs(x[2] - y[2]) for x in b for y in b if x[1] != y[1] and x[0] < y[0]]
        if not close or min(close) > 1e-12:
            assert [x[1] for x in a] == [x[1] for x in b]


def test_nearest_ties_and_few_rows(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(9, 0, -1)], "vec_id long, embedding array<double>")
    got = nearest_vectors.nearest(df, df["vec_id"] == 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(3, n, i, 1.0) for n, i in enumerate([1, 2, 4, 5, 6], 1)]
    two = df.where("vec_id < 3")
    assert [tuple(r) for r in nearest_vectors.nearest(two, two["vec_id"] == 2).collect()] == [(2, 1, 1, 1.0)]
    assert nearest_vectors.nearest(df.where("false"), df["vec_id"] == 3).count() == 0
    assert nearest_vectors.nearest(df, df["vec_id"] == 99).columns == ["query_id", "rank", "vec_id", "score"]


def test_int8_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 40)) * np.exp(rng.normal(size=(200, 1)) * 20)
    y, length = nearest_vectors.directions(x)
    code, scale, error = nearest_vectors.quantise(y, length)
    unit = y / length[:, None]
    approx = nearest_vectors.int8_product(code, code) * scale[:, None] * scale
    room = error[None] + error[:, None] * (1 + error[None]) + nearest_vectors.SLACK
    assert (np.abs(unit @ unit.T - approx) <= room).all()


# --- collocations ----------------------------------------------------------


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations(spark, monkeypatch, longest):
    for name, value in (("HELD_CHUNKS", 50), ("HELD_WORDS", 5), ("PARSED", 300), ("COUNTED_BYTES", 2000),
                        ("LONGEST_CHUNK", 9)):
        monkeypatch.setattr(collocations, name, value)
    rows = [(t, lang) for seed, lang in ((1, "a"), (2, "b"), (3, None), (4, "und")) for t in texts(seed, 150)]
    rows += [rows[0]] * 20 + [(None, "a"), (None, None), ("", "b"), (" \t ", "c"), ("one", "d"),
                              ("A.B:c" * 12, "e"), ("x\x0by z w " * 30, "f"), ("of the " * 700, "a")]
    df = spark.createDataFrame([(n, *r, 1, "y") for n, r in enumerate(rows)],
                               "doc_id int, text string, lang string, f int, phrase string")
    assert mined(df, longest=longest) == sorted(brute.collocations(rows, longest))
    assert mined(df, longest=longest, top=3, cover=80, least=4) == sorted(
        brute.collocations(rows, longest, 4, 3, 80))


def test_collocations_long_and_empty(spark):
    rows = [("ab " * 400_000, "a"), ("q" * 2_000_000, "a")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert mined(df) == sorted(brute.collocations(rows))
    assert mined(df.where("false")) == [] and mined(df.where("false").unionAll(
        spark.createDataFrame([(None, None)], "text string, lang string"))) == []


def test_chunks_cover_every_phrase_once():
    rng = np.random.default_rng(2)
    for n in list(range(1, 40)) + [600, 5000]:
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64) if n % 2 else np.zeros(n, np.uint64) + np.uint64(n)
        lengths = np.diff(np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]]))
        base = np.cumsum(lengths) - lengths
        for overlap in (1, 2, 3):
            seen = collections.Counter()
            for start, end, text in zip(*collocations.chunk_spans(hashes, lengths, overlap)):
                assert 0 < end - start <= collocations.LONGEST_CHUNK
                for size in range(1, overlap + 2):
                    first = 0 if start == base[text] else max(0, overlap - size + 1)
                    seen.update((int(i), size) for i in range(start + first, end - size + 1))
            assert seen == {(i, s): 1 for s in range(1, overlap + 2) for b, m in zip(base, lengths)
                            for i in range(b, b + m - s + 1)}


# --- ranked search ---------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, monkeypatch, small):
    if small:
        for name, value in (("ITEMS", 3), ("DOCS", 20), ("COLUMNS", 4), ("BROADCAST_TERMS", 0), ("BATCH", 30)):
            monkeypatch.setattr(lexical_search, name, value)
    docs = list(enumerate(texts(7, 200))) + [(5, None), (6, ""), (7, "..."), (None, "ab cd"), (None, "ab cd"),
                                            (8, "ab cd"), (8, "ab cd"), (9, "THE É a-b 漢字"), (10, "zq " * 60_000)]
    items = list(enumerate(texts(8, 12, 12))) + [(50, None), (51, ""), (52, "nowhere"), (None, "ab"), (3, "ab cd ab"),
                                                (3, "ab cd ab"), (60, "zq " * 5000 + "é")]
    a = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id int, text string, q int, n int")
    b = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id int, text string, r int, tile int")
    got = collections.Counter()
    by = collections.defaultdict(list)
    for r in lexical_search.search(a, b, k=7).collect():
        got[r.item_id, r["rank"], r.doc_id, r.score] += 1
        by[r.item_id].append(r["rank"])
    want = collections.Counter((items[q][0], n, i, s) for q, found in brute.lexical(docs, items, 7).items()
                               for n, (i, s) in enumerate(found, 1))
    assert got == want
    assert lexical_search.search(a.where("false"), b).count() == 0
    assert lexical_search.search(a, b.where("false")).count() == 0


def test_products_stay_exact(monkeypatch):
    rng = np.random.default_rng(4)
    q, a = rng.integers(0, 400_000, (5, 30)), rng.integers(0, 1 << 33, (6, 30))
    assert (lexical_search.exact_product(q, a) == q @ a.T).all()
    monkeypatch.setattr(lexical_search, "EXACT", 1 << 34)
    assert (lexical_search.exact_product(q, a) == q @ a.T).all()
