"""Every stage of the pipeline on the output of the one before, against brute force."""

import collections

import brute
import corpus_pipeline as P
import pytest
from munim.llm import quality
from munim.llm import queries as Q
from munim.llm.support import held_out
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    written, store = {}, P.store
    P.store = lambda df, name: written.setdefault(name, store(df, name))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    P.store = store
    return out | written


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_schema(steps):
    for name in ("quality", "line_dedup", "near_dedup", "mixing"):
        assert steps[name].dtypes == steps["documents"].dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = quality.score(steps["documents"], quality.train(steps["documents"], labels))
    want = {r.doc_id for r in scored.collect() if r.score >= 0.7}
    kept = rows(steps["quality"])
    assert {r[0] for r in kept} == want and set(kept) <= set(rows(steps["documents"]))
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert len(good & want) >= 0.9 * len(good)


def test_lines(steps):
    given = rows(steps["quality"])
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s, _ in given:
        for line in t.split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
                first[line.strip(" ")] = min(i, first.get(line.strip(" "), i))
    want = {}
    for i, t, lang, s, n in given:
        parts = t.split("\n")
        left = [x for x in parts if not (len(sites[x.strip(" ")]) >= 10 and first[x.strip(" ")] != i)]
        if len(left) == len(parts):
            want[i] = (i, t, lang, s, n)
        elif any(x.strip(" ") for x in left):
            want[i] = (i, "\n".join(left), lang, s, len("\n".join(left)))
    assert {r[0]: r for r in rows(steps["line_dedup"])} == want


def test_passages_on_few_sources(spark, sf):
    """A passage of over 50 words on 3 to 9 sources is left in one document, a short line in all."""
    passage = {n: f"passage {n} " + "of many words " * 20 for n in range(2, 10)}
    given = [(10 * n + s, f"own {n} {s}\n{passage[n]}\nshort {n}", "en", f"s{s}", 5)
             for n in passage for s in range(n)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    for i, text, *_ in rows(P.without_boilerplate(spark, docs, sf)):
        n = i // 10
        assert (passage[n] in text) == (n < 3 or i % 10 == 0) and f"short {n}" in text


def test_near_duplicates(steps):
    given = sorted(rows(steps["line_dedup"]))
    root = brute.roots(len(given), brute.similar_pairs([r[1] for r in given]))
    assert sorted(rows(steps["near_dedup"])) == [r for k, r in enumerate(given) if root[k] == k]


def test_near_duplicates_with_repeated_and_null_ids(spark, sf):
    def text(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    near = text("a") + " end"
    given = [(1, text("a")), (1, text("b")), (2, near), (None, text("a")), (None, text("c")), (None, text("c")),
             (None, text("d")), (5, text("b")), (5, text("b")), (6, text("e")), (6, text("e")), (7, None), (7, None),
             (8, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in given],
                                 "doc_id long, text string, lang string, source string, n_chars long, _H1 int")
    got = collections.Counter((r.doc_id, r.text) for r in P.one_of_each_group(spark, docs, sf).collect())
    assert got == collections.Counter([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")),
                                       (6, text("e")), (7, None), (7, None), (8, ""), (None, " ")])


def test_awkward_and_empty_tables(spark, sf):
    """All stages on nulls in every column, repeated rows and a column more; and on no rows at all."""
    given = [(None, None, None, None, None, 0), (None, "a b", None, None, None, 0), (3, "", "en", "s", 0, 1),
             (4, "x " * 100_000, "en", "s", 9, 1), (4, "x " * 100_000, "en", "s", 9, 1), (-5, "one more", None, "t", 8, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Size int"
    for docs in (spark.createDataFrame(given, schema), spark.createDataFrame([], schema)):
        some = not docs.isEmpty()
        for _, stage in P.STAGES[1:]:
            docs = stage(spark, docs, sf).checkpoint()
            assert some or docs.isEmpty()
        assert not some or docs.agg(F.sum("length")).first()[0] > 0


def test_mix(steps):
    given, got = rows(steps["near_dedup"]), collections.Counter(rows(steps["mixing"]))
    assert set(got) <= set(given)
    sizes, most, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in given:
        sizes[r[3]] += brute.size(r[1])
        most[r[3]] = max(most[r[3]], brute.size(r[1]))
    for r, n in got.items():
        assert n <= 2
        taken[r[3]] += n * brute.size(r[1])
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= most[s]


def test_pack(steps):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(Q.tokenizer_file())
    ids = collections.defaultdict(list)
    for r in rows(steps["mixing"]):
        ids[r[0]].append(tokens.encode(r[1], add_special_tokens=False).ids + [1])
    assert brute.check_packing(steps["packing"].collect(), ids) < 0.02


def test_sequences_are_written(steps):
    """The written sequences hold the token ids of the mixed documents, padded unless a power of two."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(Q.tokenizer_file())
    want = collections.Counter(
        len(tokens.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows(steps["mixing"]))
    got, at = collections.Counter(), collections.defaultdict(int)
    for r in steps["sequences"].collect():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 2048) and sum(p.length for p in r.pieces) == n
        for p in r.pieces:
            at[p.doc_id] += p.length
            if p.start + p.length == p.doc_tokens:
                got[p.doc_tokens] += 1
                assert bytes(r.ids[4 * (p.offset + p.length) - 4:4 * (p.offset + p.length)]) == b"\1\0\0\0"
    assert got == want and sum(at.values()) == sum(n * k for n, k in want.items())


def test_run_equals_stages(spark, sf, steps):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert collections.Counter(map(tuple, P.run(spark, sf).select(*key).collect())) == collections.Counter(
        map(tuple, steps["packing"].select(*key).collect()))
