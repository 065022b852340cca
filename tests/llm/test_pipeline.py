"""The corpus pipeline against plain versions of its stages."""

import random
import string

import public_tokenizers
import tiktoken

import corpus_pipeline
from bitloom.llm import bpe, langid, queries, secrets
from tests.llm.test_documents import plain_components, plain_contamination

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_passages", "secret_spans", "token_ids"]
    assert out.columns[: len(docs.columns)] == docs.columns
    model = langid.fitted(spark, docs)
    kept = [(r.doc_id, r.text) for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5]
    components = plain_components(kept)
    kept = [(d, t) for d, t in kept if components[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in plain_contamination(kept, items) if not hit}
    kept = spark.createDataFrame([(d, t) for d, t in kept if d in clean], "doc_id long, text string")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: r.text for r in secrets.redact(kept).collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(want) and len(want) > 150
    for d, t in want.items():
        assert got[d].text == t and got[d].n_chars == len(t) and got[d].round_trip
        assert got[d].token_ids == plain.encode_ordinary(t)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, "x"), (None, "the words of the text and more of them", "en", "s", 5, "x"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_columns_of_a_user_keep_their_values(spark):
    text = "the quick answer is that the people of the country have been here for many years"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), "a", "b", "c", "d")], "doc_id long, text string, lang string, source string, n_chars long, _decoded string, _secrets string, _kept_score string, Score string")
    model_docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = model_docs.selectExpr("*", "'a' as _decoded", "'b' as _secrets", "'c' as _kept_score", "'d' as Score").unionByName(docs)
    for name, stage in corpus_pipeline.STAGES:
        wide = stage(spark, wide, DATA)
        assert {tuple(r) for r in wide.select("_decoded", "_secrets", "_kept_score", "Score").distinct().collect()} == {("a", "b", "c", "d")}, name
    assert wide.where("doc_id = 1").count() >= 1


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_near_duplicates_take_five_words_at_four_fifths(spark):
    words = lambda k, n: [f"{k}w{i}" for i in range(n)]
    edited = words("b", 94)
    edited[30] = edited[60] = "other"
    far = words("c", 94)
    far[20] = far[40] = far[60] = "other"
    texts = [words("a", 100), words("a", 100) + words("x", 20), words("b", 94), edited, words("c", 94), far]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(2, rows[2][1]), (2, "another text of this id"), (10, "a b"), (10, "a b"), (None, "c d"), (None, "c d"), (None, "c e"), (11, None), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()), key=repr)
    assert got == sorted([rows[k] for k in (0, 2, 4, 5, 7, 8, 10, 12, 13)], key=repr)


def test_language_rejects_foreign_texts_and_noise(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(4)
    noise = "".join(rng.choices(string.ascii_lowercase, k=600))
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    ]
    bad = [*foreign, *(" ".join([t] * 50) for t in foreign), "x" * 500, noise, " ".join(noise[k : k + 6] for k in range(0, 600, 6))]
    held = docs.where(langid.held_out(docs.doc_id) & docs.lang.isNotNull()).collect()
    short = [" ".join(r.text.split()[:n]) for r in held for n in (3, 8)]
    rows = [(-1 - k, t, None, None, len(t)) for k, t in enumerate(bad)] + [(10_000_000 + k, t, None, None, len(t)) for k, t in enumerate(short)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), DATA).collect()}
    assert not [bad[-1 - k][:40] for k in kept if k < 0]
    assert sum(k >= 10_000_000 for k in kept) >= 0.99 * len(short)
    assert {r.doc_id for r in held} <= kept
