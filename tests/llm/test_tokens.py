"""Byte-level BPE against tiktoken, token-id files by exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from bitloom.llm import bpe, token_files

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "a", "  a  b ", "a\n b \n\n c", "\t\tx", "é ü　z", "a" * 5000, "ab" * 3000, " " * 3000, "word, word. Word.\nNext", "don't we'll 12,345.67", "<|endoftext|> x", "e\x1cf \x85 g"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def lists(codec, texts):
    ids, counts = codec.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def test_matches_tiktoken(codec, reference):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("etaoin  \n\t'sdé　1!?,. aaall") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    assert lists(codec, texts) == [reference.encode_ordinary(t) for t in texts]
    assert lists(codec, [None, "", None]) == [[], [], []]
    assert all(codec.decode(x) == t.encode() for t, x in zip(texts, lists(codec, texts)))


def test_forgetting_changes_nothing(reference):
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    small.memory.bound = 50
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde,.") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(5)]
        assert lists(small, texts) == [reference.encode_ordinary(t) for t in texts]


def test_frame(spark, reference):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (None, None, None), (2, "", "y"), (3, "long word " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(3)
    at = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(df, at, public_tokenizers.PATTERN), at, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    found = out.collect()
    assert len(found) == 5
    for r in found:
        assert r.token_ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), at, public_tokenizers.PATTERN).count() == 0
    both = bpe.encode(df, at, public_tokenizers.PATTERN, decoded="decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, found)) and both.columns == out.columns
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([60_000],)], "token_ids array<int>"), at, public_tokenizers.PATTERN).collect()


@pytest.mark.parametrize("bits", [4, 8, 16])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_levels(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 70_000, n).astype(np.uint32)
    ids[rng.random(n) < 0.7] %= 100
    levels = token_files.encode_levels(ids, bits)
    assert (token_files.decode_all(levels, bits, 0, n) == ids).all()
    for i in rng.integers(0, max(n, 1), 60 if n else 0).tolist():
        assert token_files.access(levels, bits, i) == ids[i]
        j = int(rng.integers(i, n + 1))
        assert (token_files.decode_all(levels, bits, i, j) == ids[i:j]).all()


@pytest.mark.parametrize("at_once", [False, True])
def test_files(spark, tmp_path, at_once):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["a <|endoftext|> b", "x<|endoftext|>y<|endoftext|>", "a\n<|endoftext|>\nb"] + [f"text number {i}, with words." for i in range(200)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (9, None), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "ids")
    at = public_tokenizers.path("byte_bpe_50k.json")
    if at_once:
        token_files.write_texts(token_files.ordered(df), path, at, end_id=2)
    else:
        token_files.write(token_files.encode(token_files.ordered(df), at, end_id=2), path)
    found = token_files.read(spark, path).orderBy("start").collect()
    assert len(found) == len(rows)
    assert [r.doc_id for r in found][1:] == sorted(r.doc_id for r in found[1:]) and found[0].doc_id is None
    start, want = 0, {}
    for d, t in rows:
        want.setdefault(d, []).append(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))
    for r in found:
        assert r.start == start and len(r.ids_le) == 4 * r.n_tokens
        want[r.doc_id].remove(zlib.crc32(bytes(r.ids_le)))
        start += r.n_tokens
    name = next(e for e in token_files.files.read_manifest(path) if e["docs"] > 3)
    f = token_files.TokenFile(f"{path}/{name['name']}")
    assert [f.token(i) for i in range(int(f.offsets[1]), int(f.offsets[3]))] == np.concatenate([f.document(1), f.document(2)]).tolist()


def test_end_mark_in_a_text():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = token_files.LibraryEncoder(f.read())
    assert own.memory.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_places_hold_under_ties(spark, tmp_path):
    rows = [(7, f"text {i % 40} of one id") for i in range(200)] + [(1, "first"), (None, "x"), (None, "y y")]
    found = []
    for k, parts in enumerate((2, 5)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("start", F.lit("clash")).withColumn("ids_le", F.lit(1))
        path = str(tmp_path / f"t{k}")
        token_files.write_texts(token_files.ordered(df), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
        found.append(sorted((r.start, r.doc_id, bytes(r.ids_le)) for r in token_files.read(spark, path).collect()))
    assert found[0] == found[1]


def test_other_tokenizers_and_patterns():
    from tokenizers import Tokenizer

    texts = [t for t in ODD if len(t) < 3000]
    at = public_tokenizers.path("word_bpe_49k.json")
    with open(at, encoding="utf-8") as f:
        own = token_files.LibraryEncoder(f.read())
    ids, counts = own.memory.encode(texts)
    library = Tokenizer.from_file(at)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for pattern in (r"\p{N}{1,3}|\p{L}+|[^\p{L}\p{N}]", r"(\w+|\s+)|[^\w\s]+", r"[^\r\n]+|\n"):
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
        assert lists(bpe.Codec(RANKS, pattern), texts) == [plain.encode_ordinary(t) for t in texts]


def test_a_token_is_read_without_its_file(tmp_path):
    ids = np.random.default_rng(2).integers(0, 60_000, 200_000).astype(np.uint32)
    path = str(tmp_path / "one.dac")
    token_files.write_file(path, [1, None], np.array([150_000, 50_000]), ids, 8)
    with token_files.TokenFile(path) as f:
        taken, read_at = [], f.source.read_at

        class Counting:
            def read_at(self, n, at):
                taken.append(n)
                return read_at(n, at)

            def close(self):
                f_source.close()

        f_source, f.source = f.source, Counting()
        for level in f.levels:
            for part in level:
                part.source = f.source
        assert [f.token(i) for i in (0, 99_999, 199_999)] == ids[[0, 99_999, 199_999]].tolist()
        assert sum(taken) < 2000 and (f.document(1) == ids[150_000:]).all()


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(token_files.encode(df, public_tokenizers.path("byte_bpe_50k.json"), end_id=2), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
