"""LM scores, language, quality and embeddings: exact parts by brute force, learned ones by held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import embeddings, langid, lm, quality

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(d, n, r):
    return zlib.crc32(str(d).encode()) % n == r


@pytest.mark.parametrize("frequent", [40, 65_536])
def test_lm_counts_are_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(3)
    rows = [(i, " ".join("w%d" % min(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Ünseen WORDS"), (502, "Ünseen WORDS"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = lm.lm_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + ["\n"]
    c = Counter()
    for d, t in rows:
        if d is not None and not held(d, 7, 2):
            c.update(words(t))
    total = sum(c.values())
    want = Counter()
    for d, t in rows:
        w = words(t)
        want[(d, d is None or held(d, 7, 2), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_is_normalised():
    """Probabilities of all entries after any two contexts sum to one, and an entry that words share is theirs to the last unseen one."""
    rng = np.random.default_rng(0)
    n = 3000
    words = np.unique(rng.integers(0, lm.SUFFIXES, n).astype(np.uint64) << np.uint64(56) | rng.integers(0, 2**55, n).astype(np.uint64))
    words = rng.permutation(words[words != lm.END])
    words = np.append(np.uint64(lm.END), words)
    seen = np.sort(rng.integers(1, 500, len(words)))[::-1]
    counts = lm.Counts.of(10**6, 5000, words, seen, rng.integers(0, 99, lm.SUFFIXES), rng.integers(0, 9, lm.SUFFIXES))
    model = lm.Model.start(counts)
    for table in (model.r1, model.r2, model.u, model.q, model.qc, model.bc, model.b):
        table += rng.normal(0, 0.5, table.shape)
    z = np.stack([model.class_normalisers(k) for k in range(lm.CONTEXTS)])
    zw = np.stack([model.entry_normalisers(int(a), int(b)) for a, b in zip(counts.bounds[:-1], counts.bounds[1:])])
    every = np.arange(len(counts.classes))
    held = np.bincount(counts.classes, minlength=lm.CLASSES) > 0
    for k1, k2 in ((5, 9), (0, 0), (lm.CONTEXTS - 1, 3), (800, 900)):
        p = np.exp(model.log_probs(np.full(len(every), k1), np.full(len(every), k2), every, counts, z, zw))
        empty = np.exp((model.r1[k1] + model.r2[k2]) @ model.qc[~held].T + model.bc[~held] - z[k1, k2]).sum()
        assert abs(p.sum() + empty - 1) < 1e-4 and (held.all() or empty < 1)
    hit, count, entry = counts.look_up(words[:50])
    assert hit.all() and count.tolist() == seen[:50].tolist() and entry.tolist() == list(range(50))
    hit, count, entry = counts.look_up(np.array([7 << 56 | 12345], np.uint64))
    assert not hit[0] and entry[0] == counts.rest[7] and counts.classes[entry[0]] == lm.TOP_CLASSES + 7


def test_lm_takes_long_texts_and_ids_that_are_null(spark):
    rows = [(1, "word " * 200_000), (2, "a b c"), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.lm_scores(df, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))).collect()
    assert sorted(r.n_tokens for r in got) == [3, 3, 4, 200_001]
    assert [r.held_out for r in got if r.doc_id is None] == [False, False] and all(math.isfinite(r.score) for r in got)


def test_lm_learns(spark):
    rng = random.Random(1)
    nxt = {f"a{i}": f"a{(i * 7 + 3) % 40}" for i in range(40)}
    texts = []
    for i in range(300):
        w = [f"a{rng.randint(0, 39)}"]
        while len(w) < 40:
            w.append(nxt[w[-1]] if rng.random() < 0.9 else f"a{rng.randint(0, 39)}")
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    s = lm.lm_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert s[1] > 0.8 * s[0]


def test_lm_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_scores(df, F.lit(False)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.lm_scores(some, F.lit(True)).first().train_tokens == 0


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return langid.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations(pieces):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    number = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i)):
            p = model.id_to_piece(i)
            number[bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode()] = i
    p = np.random.default_rng(0).random((pieces.size, 2))
    mark = langid.MARK.encode()
    data = np.frombuffer("the été abcab x configuration".encode(), np.uint8)
    starts, ends, _ = langid.words_of(data, np.array([0, len(data)]))
    got = np.exp(langid.word_log_probs(pieces, p, data, starts, ends))
    for k, (a, b) in enumerate(zip(starts, ends)):
        word = data[a:b].tobytes()
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[x:y] for x, y in zip(places, places[1:])]
            inner = [number.get(x) for x in parts]
            for first in (number.get(mark + parts[0]), "mark"):
                own = [number[mark]] + inner if first == "mark" else [first] + inner[1:]
                if None not in own:
                    total += np.prod([p[i] for i in own], axis=0)
        assert np.allclose(got[k], total)


def test_long_words_in_logarithms_are_the_same(pieces, monkeypatch):
    p = np.random.default_rng(1).dirichlet(np.ones(pieces.size), 3).T
    text = "Donaudampfschifffahrt été 日本語の文字列 internationalisation"
    data = langid._LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = langid.words_of(data, np.array([0, len(data)]))
    short = langid.word_log_probs(pieces, p, data, starts, ends)
    monkeypatch.setattr(langid, "SHORT", 2)
    assert np.allclose(short, langid.word_log_probs(pieces, p, data, starts, ends))
    a = langid.fit(pieces, [text, "some words"] * 3, ["x", "y"] * 3)[1]
    monkeypatch.undo()
    assert np.allclose(a, langid.fit(pieces, [text, "some words"] * 3, ["x", "y"] * 3)[1])
    long = np.frombuffer(("字" * 3000 + "q" * 20_000).encode(), np.uint8)  # far below the least number
    got = langid.word_log_probs(pieces, p, long, np.array([0]), np.array([len(long)]))
    assert np.isfinite(got).all() and (got < -700).all()


def test_signs_are_no_letters():
    text = "a—b «c» 字。字 ‘d’ ×e ª！f😀g"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = langid.words_of(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "字", "字", "d", "e", "ª", "f", "g"]


def test_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(langid, "HELD_WORDS", 20)
    memory, rng = langid.Memory(2), np.random.default_rng(3)
    for _ in range(50):
        keys = np.unique(rng.integers(0, 60, 15)).astype(np.uint64)
        assert (memory.look_up(keys, lambda new: np.stack([keys[new] * 2, keys[new] + 1], 1)) == np.stack([keys * 2, keys + 1], 1)).all()


def test_language(spark, pieces):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fitted(spark, docs)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 — 34"), (-4, "x" * 500)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("clash"))
    got = langid.identify(df, model).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id < 0}
    assert all(odd[k] == ("und", 0.0) for k in (-1, -2, -3)) and odd[-4][0] != "und"
    tested = [r for r in got if r.doc_id >= 0 and held(r.doc_id, 5, 0) and r.lang]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    nothing = langid.train(docs.limit(0), langid_path())
    assert {r.lang_pred for r in langid.identify(extra, nothing).collect()} == {"und"}


def langid_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_quality(spark):
    got = quality.op7_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality.fit(["good words here", "bad bad bad bad"] * 20, [1, 0] * 20)
    found = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert found[1] == found[2] and all(0 <= s <= 1 for s in found.values())
    assert quality.fit([], []).scores(np.empty(0, np.uint8), np.array([0, 0]))[0] == 0.5
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_score_is_the_mean_of_its_features():
    """By plain loops over the features; repeated rows have equal scores, and 0.7 itself is accepted."""
    model = quality.fit(["good words here", "bad bad bad bad"] * 20, [1, 0] * 20)
    texts = ["good words", "bad bad", "", "é words bad"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(b) for b in raw]))
    got = model.scores(data, offsets)
    own: list[list[int]] = [[] for _ in texts]
    for rows, of in quality.features(data, offsets):
        for r, k in zip(rows.tolist(), of.tolist()):
            own[k].append(r)
    for k, rows in enumerate(own):
        alone = quality.features(np.frombuffer(raw[k], np.uint8), np.array([0, len(raw[k])]))
        assert sorted(rows) == sorted(r for x, _ in alone for r in x.tolist())
        z = model.bias + (sum(model.numbers[r] for r in rows) / len(rows) if rows else 0.0)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9
    assert quality.Model(np.zeros(1 << quality.BITS), math.log(0.7 / 0.3)).scores(data, offsets)[0] >= quality.ACCEPT - 1e-12


def test_samples_keep_the_scan_apart(spark):
    """A fit runs in one task behind an exchange, at every size."""
    from bitloom.llm import sample

    df = spark.range(0, 1000, 1, 8)
    few = sample.bounded(df, F.col("id"), 5000)
    assert few.count() == 1000 and 20 < sample.bounded(df, F.col("id"), 50).count() <= 100
    tasks = spark.sparkContext.accumulator(0)

    def slow(batches):
        tasks.add(1)
        yield from batches

    assert sample.fit_in_task(df.mapInArrow(slow, df.schema), lambda t: t.num_rows) == 1000
    assert tasks.value == 8


def plain_links(vectors, threshold=0.9):
    ok = {i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root, links = list(range(len(vectors))), [0] * len(vectors)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return links, [find(i) for i in range(len(vectors))]


@pytest.mark.parametrize("leaf,block", [(512, 4096), (40, 4096), (80, 25)])
def test_embeddings(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(60, 16))
    vectors = [np.round(c + rng.normal(scale=0.18, size=16), 4).tolist() for c in centres for _ in range(5)]
    vectors += [np.round(centres[0] + rng.normal(scale=0.02, size=16), 4).tolist() for _ in range(60)] + [vectors[3]] * 4
    vectors += [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0], [2.0, 4.0], [-x for x in vectors[0]]]
    links, roots = plain_links(vectors)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, lead int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(vectors)
    assert all(got[i].n_links <= n for i, n in enumerate(links))
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links)
    if leaf == 512:
        assert [got[i].n_links for i in range(len(vectors))] == links and [got[i].component_id for i in range(len(vectors))] == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_of_many_lengths(spark):
    rows = [(2 * k + side, [float(side + 1)] * (k + 1)) for k in range(70) for side in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {(v, 1, v - v % 2) for v, _ in rows}


def test_embeddings_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 2.0]), (8, [3.0, 0.0]), (9, [5.0, 5.0]), (9, [5.0, 5.0]), (3, [0.0, 1.0])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)).collect()]
    assert sorted(got) == [(3, 2, 3, True), (5, 1, 3, False), (5, 2, 3, False), (7, 2, 3, False), (8, 1, 3, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_embeddings_with_a_hot_vector_and_near_the_threshold(spark, monkeypatch):
    """A third of the rows are one vector; of pairs just above the threshold at least 0.9 are found, in small cells."""
    monkeypatch.setattr(embeddings, "BLOCK", 200)
    monkeypatch.setattr(embeddings, "LEAF", 40)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x)
    vectors = []
    for _ in range(400):
        a = unit(rng.normal(size=24))
        b = rng.normal(size=24)
        b = unit(b - (a @ b) * a)
        cos = rng.uniform(0.902, 0.93)
        vectors += [a.tolist(), (cos * a + math.sqrt(1 - cos * cos) * b).tolist()]
    links, _ = plain_links(vectors)
    hot = unit(rng.normal(size=24)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors + [hot] * 400)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert all(got[i].n_links >= 399 and got[i].component_id <= 800 for i in range(800, 1200))
    assert sum(got[i].n_links for i in range(800)) >= 0.9 * sum(links) and all(got[i].n_links <= n + 400 for i, n in enumerate(links))


def test_embeddings_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got[1] == (1, True) and got[None][1] is False
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
