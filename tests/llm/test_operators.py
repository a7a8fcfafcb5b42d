"""Each operator on whole small tables against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

import brute
from munim.llm import (
    chat_format, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, packing, quality,
    support, topk_search, url_filter,
)
from munim.llm import queries as Q

ODD = ["", " ", "a", "x  y", "\n\n", "<|endoftext|> and <|end|>", "it's I'LL\n\n x ", "\u00a0b c\t\td",
       "émile ß 漢字 \U0001f600", "word " * 30_000, "tab\t\x0b\x0c\r\n end", "<\\|end|> <|start|>\\"]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    assert compare(spark, con, sf, Q.QUERIES[name], Q.ORACLES[name]) is None


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    found = dict(tuple(r) for r in support.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = brute.roots(461, pairs)
    real = {v for p in pairs if p[0] != p[1] for v in p}
    assert found == {v: want[v] for v in real}
    assert support.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_number_rows(spark):
    df = support.cut(spark.range(0, 1000).withColumn("k", F.col("id") % 3))
    old = support.GROUP_ROWS
    try:
        support.GROUP_ROWS = 50
        rows = support.number_rows(df, "k", ["id"], "n", 1000).collect()
    finally:
        support.GROUP_ROWS = old
    by = collections.defaultdict(list)
    for r in rows:
        by[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 1000


# --- packing ---------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_file())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_whole_table(spark, sf, docs):
    ids = tokenizer()
    share = brute.check_packing(Q.op1(spark, sf).collect(), {d.doc_id: [ids(d.text)] for d in docs})
    assert share < 0.01


def test_packing_awkward_rows(spark):
    ids = tokenizer()
    rows = [(k, t, 7, 8) for k, t in enumerate(ODD)] + [(3, None, 7, 8), (3, None, 7, 8), (None, "null id", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id int")
    pieces = packing.pieces(df, Q.tokenizer_file())
    placed = packing.pack(pieces).cache()
    given = collections.defaultdict(list)
    for k, t, *_ in rows:
        given[k].append(ids(t))
    brute.check_packing(placed.collect(), given)
    out = {r.sequence_id: r for r in packing.sequences(placed, pad_id=0).collect()}
    for r in placed.collect():
        at = out[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)]
        assert bytes(at) == bytes(r.ids)
    for r in out.values():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 2048)
    assert packing.pack(packing.pieces(df.limit(0), Q.tokenizer_file(), with_ids=False)).count() == 0


def test_op1_digests_come_from_sequences(spark, sf, monkeypatch):
    """The query packs ids: other ids in the sequences give other digests."""
    build, seen = packing.sequences, []

    def spoilt(*args, **kw):
        seen.append(build(*args, **kw))
        return seen[0].withColumn("ids", F.unhex(F.repeat(F.lit("00"), F.length("ids"))))

    want = {(r.doc_id, r.start): r for r in Q.op1(spark, sf).collect()}
    monkeypatch.setattr(packing, "sequences", spoilt)
    for r in Q.op1(spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(bytes(4 * r.length)) != want[r.doc_id, r.start].ids_crc32
    rows = seen[0].select("n_tokens", F.length("ids").alias("n")).collect()
    assert {r.n == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048) for r in rows} == {True}


@pytest.mark.parametrize("shrunk", [False, True])
def test_sequences_of_awkward_rows(spark, shrunk):
    ids = tokenizer()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, None), (3, None), (None, "null id"), (20, "a" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = packing.pack(packing.pieces(df, Q.tokenizer_file(), shrunk=shrunk))
    seqs = packing.sequences(placed, pad_id=9, shrunk=shrunk).cache()
    given = collections.defaultdict(list)
    for k, t in rows:
        given[k].append(ids(t))
    got = packing.digests(seqs).collect()
    brute.check_packing(got, given)
    assert len({r.sequence_id for r in got}) == seqs.count()
    for r in seqs.collect():
        tail = np.frombuffer(bytes(r.ids[4 * r.n_tokens:]), "<u4")
        assert (tail == 9).all() and len(tail) in (0, 2048 - r.n_tokens)
    assert packing.sequences(placed.limit(0), shrunk=shrunk).count() == 0


def test_shrunk_ids_come_back():
    import zstandard

    for ids in ([1], [0, 65535] * 9, [65536, 3], [2**32 - 1]):
        data = np.array(ids, "<u4").tobytes()
        small = packing.shrink(data, zstandard.ZstdCompressor())
        assert packing.grow(small, zstandard.ZstdDecompressor()) == data


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    definition = open(Q.tokenizer_file(), encoding="utf-8").read()
    encoder, plain = packing.Encoder(definition), Tokenizer.from_str(definition)
    assert encoder.merger is not None
    for text in ODD:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", "\t ", "a", "\u00e9", ".", "7", "\u6f22"])
def test_encoder_on_long_runs(run):
    with open(Q.tokenizer_file(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    text = "x" + run * (2_000_000 // len(run)) + "y"
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert encoder.tokenizer.decode(ids) == text
    short = text[:150_000]
    assert np.frombuffer(encoder.encode(short), "<u4").tolist() == encoder.tokenizer.encode(
        short, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, 500 if seed else 3), minlength=65)
    patterns, repeats = packing.plan(counts, 64)
    assert patterns.sum(axis=1).max() <= 64
    used = sum(np.bincount(p[p > 0], minlength=65) * n for p, n in zip(patterns, repeats))
    assert (used == counts).all()


def test_least_squares_meets_counts():
    combos = np.array([[1, 3, 0], [2, 2, 0], [1, 1, 2]])
    counts = np.array([0, 40, 30, 20, 0])
    x = packing.solve(combos, counts)
    made = sum(np.bincount(combos[:, k], x, 5) for k in range(3))
    assert (x >= 0).all() and np.abs(made[1:4] - counts[1:4]).max() < 2


# --- URL filter ------------------------------------------------------------

URLS = [None, "", "no scheme.com/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "ftp://a.b.example.com/en/?q",
        "https://example.com", "https://example.com/", "x://example.com?/en/", "x://notexample.com/en/", "x://net/es/",
        "x://a.net/fr", "x://a.net/fr/#y", "x://com./en/", "x:///en/", "x://ÉXAMPLE.COM/\nen/", "x://user@h.net:80/es/",
        "http://a.com/://b.net/es/", "x://" + "a." * 3000 + "net/es/" + "y" * 50_000, "x://..com/"]


def test_url_filter_awkward_rows(spark):
    df = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(URLS + URLS)],
                               "page_id long, url string, rule string, HOST int")
    rules = spark.createDataFrame(Q.URL_RULES + [("block", None, "/"), ("allow", "net", "/es/")],
                                  "action string, host string, path string")
    got = {r.page_id: tuple(r)[-4:] for r in url_filter.judge(df, rules).select(
        "page_id", "host", "path", "rule", "verdict").collect()}
    want = {k: brute.judge(u, Q.URL_RULES) for k, u in enumerate(URLS + URLS)}
    assert got == want
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}


# --- line dedup ------------------------------------------------------------


def test_line_dedup_awkward_rows(spark):
    rows, k = [], 0
    for n in (8, 9, 10, 11, 14):
        for s in range(n):
            rows.append((k, f"own {k}\n  spread {n} \n\nown {k}", f"s{s}"))
            k += 1
        rows.append((k, f"spread {n}\n", "s0"))
        k += 1
    rows += [(None, "spread 14", "s1"), (k, None, "s1"), (k + 1, "", "s2"), (k + 2, "spread 14", None),
             (3, "own 3", "s1"), (3, "own 3", "s1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_removed int")
    got = line_dedup.remove_boilerplate(df).collect()
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")] |= {s} - {None}
                if i is not None:
                    first[line.strip(" ")] = min(i, first.get(line.strip(" "), i))
    want = collections.Counter()
    for i, t, s in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if len(sites.get(x.strip(" "), ())) >= 10 and first[x.strip(" ")] != i]
        left = None if t is None else "\n".join(x for x in lines if x not in gone)
        want[i, left, s, sum(bool(x.strip(" ")) for x in lines), len(gone)] += 1
    assert collections.Counter((r.doc_id, r.text, r.source, r.n_lines, r.n_removed) for r in got) == want
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


@pytest.mark.parametrize("long_sites", [2, 3, None])
def test_line_dedup_long_passages(spark, long_sites):
    long, edge = ({n: f"p{n} " + " ".join(f"w{k}" for k in range(m)) for n in range(1, 12)} for m in (50, 49))
    rows = [(100 * n + s, f"own {n} {s}\n {long[n]} \n{edge[n]}", f"s{s}") for n in long for s in range(n)]
    rows += [(100 * n + 50, f"{long[n]}\n{edge[n]}", "s0") for n in long]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(df, long_sites=long_sites).collect()}
    want = {}
    for i, t, _ in rows:
        n, gone = i // 100, set()
        if i % 100:
            gone |= {long[n]} if n >= (long_sites or 10) else set()
            gone |= {edge[n]} if n >= 10 else set()
        want[i] = "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone)
    assert got == want


# --- chat formatting -------------------------------------------------------


def test_chat_round_trip(spark):
    roles = ["system", "user", "user", "assistant", "assistant", "", "a<|b", "assistant"]
    rows = [(c, None if k == 0 else k, roles[(k + c) % 8], ODD[(k * 3 + c) % len(ODD)], "x")
            for c in range(6) for k in range(7)]
    rows += [(9, 1, None, None, "x"), (9, 1, None, None, "x"), (9, 2, "assistant", None, "x"), (None, 1, "user", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df).withColumns({
        "turns": chat_format.read_turns(F.col("formatted")),
        "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    by = collections.defaultdict(list)
    for c, k, r, t, _ in rows:
        by[c].append((-1 if k is None else k, r or "", t or ""))
    assert len(out) == len(by)
    for r in out:
        turns = sorted(by[r.conv_id])
        assert [tuple(t) for t in r.turns] == [t[1:] for t in turns]
        assert r.loss == "".join(t for _, role, t in turns if role == "assistant")
        assert all(a.role != b.role for a, b in zip(r.messages, r.messages[1:]))
        assert r.formatted.count("<|end|>") == len(r.messages)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_places_in_code_points(spark):
    texts = ["\ufeffa", "\U0001f600<|end|>", "", "\ufeff", "e\u0301<", "|x"]
    rows = [(1, k, ["assistant", "user", "assistant"][k % 3], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df).withColumn(
        "loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    want = [t for _, _, role, t in rows if role == "assistant"]
    assert r.loss == "".join(want) and len(r.loss_spans) == len(want)
    for s, t in zip(r.loss_spans, want):
        assert re.sub(r"<(\\*)\\\|", r"<\1|", r.formatted[s.start:s.start + s.length]) == t


def test_chat_long_conversation(spark):
    import time

    def run(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(
            F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("\u00e9 text "), F.col("id").cast("string")).alias("text"))
        start = time.monotonic()
        r = chat_format.format_chats(rows).select(
            F.size("loss_spans").alias("n"), F.sha2(chat_format.read_loss(
                F.col("formatted"), F.col("loss_spans")), 256).alias("h"),
            F.size(chat_format.read_turns(F.col("formatted"))).alias("turns")).first()
        want = "".join(f"\u00e9 text {k}" for k in range(1, n, 2))
        assert (r.n, r.turns, r.h) == (n // 2, n, hashlib.sha256(want.encode()).hexdigest())
        return time.monotonic() - start

    run(5_000)
    assert run(100_000) < 20 * (run(5_000) + 1)  # with squared work: 400 times


def test_chat_forged_marks(spark, sf):
    row = Q.op4(spark, sf).where("conv_id = -7").first()
    turns = "".join(f"{r}\n{Q.FORGED}\n" for r in ("user", "assistant"))
    assert row.n_turns == 2 and row.loss_chars == len(Q.FORGED)
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(Q.FORGED.encode()).hexdigest()


# --- embeddings ------------------------------------------------------------


@pytest.mark.parametrize("dims,kind", [(64, "float"), (20, "double"), (3, "double")])
def test_near_vectors(spark, dims, kind):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    near = base[rng.integers(0, 60, 150)] + rng.normal(size=(150, dims)) * rng.uniform(0, 0.6, (150, 1))
    x = np.concatenate([base, near, base[:5], base[:5]]).astype(np.float32).astype(float)
    vectors = [v.tolist() for v in x]
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1),
           [float("inf")] * dims]
    rows = [(k * 2, v, 1, 2) for k, v in enumerate(vectors)] + [(1001 + k, v, 1, 2) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n_links int, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    root = brute.roots(len(x), np.argwhere(linked))
    want = {2 * k: (int(linked[k].sum()), 2 * root[k], root[k] == k) for k in range(len(x))}
    want |= {1001 + k: (0, 1001 + k, True) for k in range(len(odd))}
    assert got == want


def test_near_vectors_tiles_and_blanks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(90, 16)) * 0.2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    old = embedding_dedup.TILE, embedding_dedup.STRIP
    try:
        embedding_dedup.TILE, embedding_dedup.STRIP = 7, 4
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    finally:
        embedding_dedup.TILE, embedding_dedup.STRIP = old
    assert got == {k: int((unit @ unit[k] >= 0.9).sum()) - 1 for k in range(90)}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [2.0, 0.0])],
                                  "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(nulls).collect()} == {
        (None, 2, 5, False), (5, 2, 5, True)}


# --- MinHash ---------------------------------------------------------------


def classes(rows):
    texts = [t for _, t in rows]
    root = brute.roots(len(rows), brute.similar_pairs(texts))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return [least.get(root[k]) for k in range(len(rows))]


def test_near_documents_whole_table(spark, sf, docs):
    rows = [(d.doc_id, d.text) for d in docs]
    got = {r.doc_id: r.class_id for r in Q.op6(spark, sf).collect()}
    assert got == {i: c for (i, _), c in zip(rows, classes(rows))}


def test_near_documents_awkward_rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(25):  # chains of edits: some pairs are linked only through others
            b = list(b)
            b[rng.integers(0, 120)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(b)))
    rows += [(200, "one two three"), (201, "one  two\tthree"), (202, "one two"), (203, None), (204, ""), (205, " \n"),
             (206, "a b c d e " * 2000), (207, "a b c d e " * 2100), (208, "a b c d e"), (None, "one two three"),
             (None, "alone here with a null id"), (200, "one two three")]
    df = spark.createDataFrame([(i, t, 0, True) for i, t in rows], "doc_id long, text string, class_id int, kept boolean")
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash_dedup.near_documents(df).collect())
    want = collections.Counter((i, c) for (i, _), c in zip(rows, classes(rows)))
    assert got == want
    assert minhash_dedup.near_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile,columns", [(1024, 4096), (5, 7)])
def test_near_documents_edited_copies(spark, monkeypatch, tile, columns):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "COLUMNS", columns)
    rng = np.random.default_rng(8)
    origin = [f"w{k}" for k in rng.integers(0, 400, 200)]
    rows = []
    for k in range(120):  # each edit breaks five shingles; most pairs stay just below 0.8
        words = list(origin)
        for at in rng.choice(200, rng.integers(2, 9), replace=False):
            words[at] = f"x{rng.integers(0, 10 ** 6)}"
        rows.append((k, " ".join(words)))
    rows += [(200, rows[3][1]), (201, " ".join(origin * 300)), (202, " ".join(origin * 301))]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.roots(len(rows), brute.similar_pairs([t for _, t in rows]))
    assert got == {i: rows[r][0] for (i, _), r in zip(rows, want)}
    assert 3 < len(set(got.values())) < 110


def test_common_elements():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(-50, 50, rng.integers(1, 60))) for _ in range(n)] for n in (7, 9))
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    assert (minhash_dedup.common_elements(a, b) == np.array(want)).all()
    assert not minhash_dedup.common_elements([np.array([1])], [np.array([2])]).any()


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    est = []
    for trial in range(60):
        e = rng.integers(0, 2**62, 40).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        both = []
        for w in (wa, wb):
            keep = w > 0
            both.append((np.sort(e[keep]), w[keep][np.argsort(e[keep])].astype(float)))
        el = np.concatenate([both[0][0], both[1][0]])
        we = np.concatenate([both[0][1], both[1][1]])
        doc = np.repeat([0, 1], [len(both[0][0]), len(both[1][0])])
        s = minhash_dedup.signatures(el, we, doc, 2)
        est.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(est)) < 0.015 and np.std(est) < 0.06


# --- language --------------------------------------------------------------


def test_language_trees_are_distributions():
    import pandas as pd

    counts = pd.DataFrame({"lang": ["x", "x", "y", "y"], "n": [5, 1, 2, 3], "gram": [
        int.from_bytes(b"\n\n\na", "big"), int.from_bytes(b"\n\nab", "big"), int.from_bytes(b"abac", "big"),
        int.from_bytes(b"\n\n\nb", "big")]})
    trees = language_id.grow(counts)
    bytes_of = np.ones(trees.cost.shape[1])
    bytes_of[-1] = 256 - (len(bytes_of) - 1)
    mass = (np.exp2(-trees.cost.astype(float)) * bytes_of[None, :, None]).sum(axis=1)
    assert np.abs(mass - 1).max() < 1e-5


def test_language_code_lengths(spark):
    rows = [(k, t, lang) for lang, texts in {
        "en": ["the cat and the dog went to the house", "a dog", "this and that\nthen"],
        "fr": ["le chat et le chien sont dans la maison", "\u00e9t\u00e9 \u00e0 la mer", "a"],
        "x": ["zz"]}.items() for k, t in enumerate(texts)]
    trees = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learnt = collections.defaultdict(list)
    for _, t, lang in rows:
        learnt[lang].append(t)
    asked = ["the dog", "la mer", "q", "z", "\u6f22\u5b57 the", "no such word\n\n\nthe cat", "a" * 300]
    got = language_id.code_lengths(trees, [t.encode() for t in asked])
    for bits, t in zip(got, asked):
        want = brute.ppm_bits(learnt, t)
        assert np.allclose(bits, [want[lang] for lang in trees.languages], rtol=1e-4, atol=1e-3)
        pred = language_id.identify(spark.createDataFrame([(t,)], "text string"), trees).first()
        assert pred.lang_pred == min(sorted(want), key=want.get)
        assert pred.score == pytest.approx(1 / sum(2 ** (min(want.values()) - b) for b in want.values()), abs=1e-3)


def test_least_hashed(spark):
    """One key holds most rows; repeated rows count once; the plan has no window over the key."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("lang"),
        F.xxhash64(F.col("id")).alias("h"), F.col("id").alias("doc_id"))
    rows = rows.unionByName(rows.where("doc_id < 9000")).unionByName(
        rows.limit(1).select(F.lit("one").alias("lang"), "h", "doc_id"))
    for k in (400, 5000):
        out = support.least_hashed(rows, "lang", k)
        got = {lang: sorted(h for x, h in out.select("lang", "h").collect() if x == lang) for lang in ("hot", "rare", "one")}
        for lang in got:
            assert got[lang] == sorted({r.h for r in rows.where(F.col("lang") == lang).collect()})[:k]
        assert "Window" not in out._jdf.queryExecution().toString()
    assert support.least_hashed(rows.limit(0), "lang", 3).count() == 0


def test_clashing_names(spark):
    """Columns named like an operator's own ones, in any case, come out as they went in."""
    names = ["_doc", "_HIT", "_gone", "docs", "Source_No", "_key", "_best", "_P", "_source"]
    df = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit("a text\nof lines").alias("text"), F.lit("s").alias("source"),
        F.lit("http://x.com/y").alias("url"), F.lit("r").alias("Rule"), F.lit(3).cast("long").alias("size"),
        F.lit(0.5).alias("quality"), *[F.lit(n).alias(n) for n in names])
    rules = spark.sql("SELECT 'allow' AS action, 'com' AS host, '/' AS path")
    trees = language_id.train(spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string"))
    for out in (line_dedup.remove_boilerplate(df), mixing.mix(df), url_filter.judge(df, rules),
                language_id.identify(df, trees)):
        assert out.count() == 3
        for n in names:
            assert {r[0] for r in out.select(n).collect()} == {n}
    assert {r[0] for r in url_filter.judge(df, rules).select("rule").collect()} == {"com/"}


def test_language_counts_do_not_depend_on_partitions(spark):
    """As many counts from texts in one partition as from texts in forty."""
    sample = spark.range(200).select(
        F.lit("en").alias("lang"), F.xxhash64("id").alias("h"), F.concat(F.lit("text no "), F.col("id") % 7).alias("text"))
    some = [language_id.slot_counts(sample.repartition(n)).count() for n in (1, 40)]
    assert some[0] == some[1] < 200
    counts = language_id.gram_counts(sample)
    assert counts["n"].sum() == 200 * 9 and not counts.duplicated(["lang", "gram"]).any()


def test_language_held_out(spark):
    rows = Q.op7(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward_rows(spark):
    rows = [(1, "the cat and the dog went to the house", "en"), (2, "le chat et le chien sont dans la maison", "fr"),
            (3, "no language", None), (4, None, "en"), (5, "123 !!", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.train(df)
    assert trees.languages == ["en", "fr"]
    asked = spark.createDataFrame([(k, t, "z", 0) for k, t in enumerate(
        [None, "", "12 \n", "the dog and the cat", "la maison et le chat", "漢字", "the " * 100_000])],
        "doc_id long, text string, lang_pred string, SCORE int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, trees).collect()}
    assert [got[k][0] for k in (0, 1, 2, 3, 4, 6)] == ["und", "und", "und", "en", "fr", "en"]
    assert got[0][1] == 0.0 and got[5][0] in ("en", "fr")
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(asked, none).collect()} == {"und"}
    assert language_id.identify(asked.limit(0), trees).count() == 0


# --- top-k -----------------------------------------------------------------


@pytest.mark.parametrize("scale,dims", [(1, 40), (2**27, 5)])
def test_top_k(spark, scale, dims):
    rng = np.random.default_rng(dims)
    x = rng.integers(-4, 5, (130, dims)) * scale
    x[20:30] = x[0]
    ids = [k // 2 if k < 40 else k for k in range(130)]  # repeated ids
    rows = [(i, v.tolist(), 9) for i, v in zip(ids, x)] + [(None, x[0].tolist(), 9), (777, None, 9)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, score int")
    old = topk_search.CANDIDATES, topk_search.QUERIES, topk_search.STRIP
    try:
        topk_search.CANDIDATES, topk_search.QUERIES, topk_search.STRIP = 37, 9, 4
        got = collections.Counter(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0).collect())
    finally:
        topk_search.CANDIDATES, topk_search.QUERIES, topk_search.STRIP = old
    want = collections.Counter()
    big = [[int(c) for c in v] for v in x]
    for q in (k for k in range(130) if ids[k] % 5 == 0):
        scored = sorted((-sum(a * b for a, b in zip(big[q], big[c])), ids[c]) for c in range(130) if c != q)
        for rank, (s, i) in enumerate(scored[:5], 1):
            want[ids[q], rank, i, -s] += 1
    assert got == want


def test_top_k_of_long_vectors(spark):
    """A few very long vectors: bounds are not rounded, nothing is cut to 64 bits before it is ranked."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.12, (300, 64)).astype(np.float32)
    x[0, 0], x[50, 3], x[7, 5], x[9, 5], x[250] = 1e14, 1e22, 3e12, -3e12, x[250] * 1e11
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = df.select("vec_id", topk_search.to_integers(F.col("embedding")).alias("vector"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(rows, F.col("vec_id") % 50 == 0).collect()}
    whole = [[math.floor(256 * float(c)) for c in v] for v in x]
    want = {}
    for q in range(0, 300, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in range(300) if c != q)
        want |= {(q, n): (c, max(-2**63, min(-s, 2**63 - 1))) for n, (s, c) in enumerate(scored[:5], 1)}
    assert got == want


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1]), (50, [2, 3])], "vec_id long, vector array<long>")
    got = {tuple(r) for r in topk_search.top_k(df, F.lit(True)).collect()}
    assert got == {(0, 1, 50, 2), (50, 1, 0, 2)}
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0
    odd = spark.createDataFrame([([1.5, float("nan")],), ([-0.001, None],), ([-0.001, 2.0],), (None,)], "e array<float>")
    assert [r[0] for r in odd.select(topk_search.to_integers(F.col("e"))).collect()] == [None, None, [-1, 512], None]


# --- quality ---------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op9(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.96
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)


def test_quality_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    asked = [None, "", "a", "some words. " * 900] + [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in quality.score(rows, model).collect():
        want = brute.compressed_score(asked[r.doc_id], model.good, model.bad, model.mean, model.slope, model.intercept)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == (r.score >= 0.7)


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(k, "a sound sentence about things" if k % 2 else "$$$ ### %%% &&&", "z") for k in range(80)]
        + [(200, None, "z"), (201, "", "z"), (None, "text", "z"), (202, "long " * 50_000, "z")],
        "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 0), (None, 1), (5, None), (7, 4)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 84 and all(0 <= r.score <= 1 for r in got.values())
    assert got[71].score > got[72].score and got[200].score == got[201].score
    flat = quality.train(docs, labels.limit(0))
    assert quality.score(docs, flat).count() == 84
    assert quality.score(docs.limit(0), model).count() == 0


# --- mixing ----------------------------------------------------------------


def check_mix(rows, texts):
    """rows: (source, size, source_size, target, taken) of each document."""
    sizes = collections.Counter()
    for s, t in texts:
        sizes[s] += brute.size(t)
    want = brute.targets(dict(sizes))
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
    for s in sizes:
        assert 0 <= want[s] - taken[s] < 1 + 1e-6


def test_mixing_whole_table(spark, sf, docs):
    text = {d.doc_id: (d.source, d.text) for d in docs}
    rows = Q.op10(spark, sf).collect()
    assert {r.doc_id: r.size for r in rows} == {i: brute.size(t) for i, (_, t) in text.items()}
    sources = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    check_mix(Q.op10(spark, sf).join(sources, "doc_id").collect(), text.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Q.op10(spark, sf).collect()))


def test_mixing_awkward_rows(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), ["a", "É", None, "z", ""][k % 5 if k < 60 else 0], "x") for k in range(150)]
    rows += [(None, "b c", "nine", "x"), (None, None, "nine", "x"), (3, "b\u00a0c", "Z", "x"), (3, "b\u00a0c", "Z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").withColumns(
        {"size": mixing.size_words(F.col("text")), "quality": mixing.text_quality(F.col("text"))})
    old = mixing.GROUP_ROWS
    try:
        mixing.GROUP_ROWS = 8
        got = mixing.mix(df).collect()
    finally:
        mixing.GROUP_ROWS = old
    check_mix(got, [(s, t) for _, t, s, _ in rows])
    assert mixing.mix(df.limit(0)).count() == 0
    blank = mixing.mix(df.where("size = 0")).collect()
    assert blank and all(r.taken == 0 for r in blank)


def test_mixing_prefers_quality(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("quality"))
    got = mixing.mix(df, share=0.25).groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("taken")).collect()
    took = {r[0]: r[1] for r in got}
    assert took[0] > 2 * took[1] and took[0] + took[1] == 10_000


def test_word_counts(spark):
    rows = [(t,) for t in ODD + [None]]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(mixing.size_words(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (t,) in rows]
