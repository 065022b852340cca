"""Decontamination, Jaccard join, secrets and archives against plain versions on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import automata, decontaminate, jaccard, secrets, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- decontamination ------------------------------------------------------------------------------


def plain_contamination(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(1)
    v = ["w%d" % i for i in range(12)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 5, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "  "), (52, "Ünï Côde 12"), (53, items_dup := "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (54, items_dup)]
    docs = [(i, " ".join(rng.choices(v, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"before, {t} after.".upper()) for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (1, "same id other text"), (None, items_dup), (202, items_dup), (202, items_dup)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == plain_contamination(docs, items)
    hits = [d for d in plain_contamination(docs, items) if d[2]]
    assert decontaminate.remove_documents(df, bench).count() == len(docs) - len(hits)
    cleaned = decontaminate.remove_spans(df, bench).select("doc_id", "text").collect()
    assert all(r.n_hit == 0 or len(r["items"]) for r in got.collect())
    assert [r.text for r in cleaned if r.doc_id == 202] == ["", ""]
    assert [r.text for r in cleaned if r.doc_id == 200] == [None]
    empty = bench.limit(0)
    assert decontaminate.contamination(df, empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_contamination_of_a_very_long_text_and_clashing_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    text = "filler words go here. " * 50_000 + passage + " and more filler." * 50_000
    docs = spark.createDataFrame([(1, text, 7, 8), (2, "clean text", 7, 8)], "doc_id long, text string, _hit_doc int, _pieces int")
    bench = spark.createDataFrame([(4, passage), (5, "no"), (6, "filler words go")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench.where("item_id = 4")).collect()}
    assert got == {1: (11, ["4"]), 2: (0, [])}
    assert [r.asDict() for r in decontaminate.remove_documents(docs, bench).collect()] == [{"doc_id": 2, "text": "clean text", "_hit_doc": 7, "_pieces": 8}]
    cleaned = {r.doc_id: (r.text, r["_hit_doc"], r["_pieces"]) for r in decontaminate.remove_spans(docs, bench.where("item_id = 4")).collect()}
    assert cleaned == {1: (text.replace(". " + passage, ""), 7, 8), 2: ("clean text", 7, 8)}


def test_contamination_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.contamination(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = [(1, "a b c d e f g h i j k")], [(7, "b c d e f g h i j k")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (got.n_hit, got["items"]) == (10, ["7"])


# -- Jaccard join ------------------------------------------------------------------------------------


def plain_components(rows, width=4, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    v = ["w%d" % i for i in range(200)]
    rows = []
    for _ in range(40):
        base = rng.choices(v, k=rng.choice([2, 4, 6, 8, 10, 12, 15, 20, 40, 80, 200]))
        for _ in range(rng.choice([1, 2, 5])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 20))):
                x[rng.randrange(len(x))] = rng.choice(v)
            rows.append(" ".join(x))
    hot = rng.choices(v, k=110)
    for _ in range(60):
        x = list(hot)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(v)
        rows.append("  ".join(x).upper())
    rows += ["", None, "a", "a", "A", "a b c", " a  b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block,seed", [(1024, 1), (16, 2), (7, 3)])
def test_components(spark, monkeypatch, block, seed):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lead", F.lit(1)).repartition(4)
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_components_edges(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (8, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 5), (8, 8)], key=repr)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_repeated_ids(spark):
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "p q r s t u"), (9, "P q r s t u"), (10, "x y"), (10, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 2, 3), (5, 2, 3), (5, 3, 3), (9, 3, 3), (10, 0, 10), (10, 1, 10)]


def test_components_of_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    near = list(long)
    for k in range(0, 30_000, 400):
        near[k] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[::-1])), (4, "short text of six words here")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_t_occurrence():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(40), rng.randint(0, 25)))) for _ in range(rng.randint(1, 8))]
        least = rng.randint(1, 5)
        count = {v: sum(v in x.tolist() for x in lists) for v in range(40)}
        assert jaccard.t_occurrence(lists, least) == [(v, c) for v, c in sorted(count.items()) if c >= least]


# -- secrets -----------------------------------------------------------------------------------------


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"[:36]
    texts = [
        f"ü password = '{'x1' * 5}' and {key}, then {'0a' * 16}.",
        "secret:token:abcdef  password=token  API_KEY=\"abcdefg\"",
        f"here is {token} in prose",
        "passwordſ=abcdefgh Token: short tokens=abcdefghi",
        "//ththre.example.com/fr/825?page=2 and internationalisation2024 is a long word",
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("secrets", F.lit("clash"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(df).collect()}
    pattern = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for d, t in enumerate(texts):
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(s for s in got[d] if s[0] != "grammar") == sorted(want)
    assert got[2] == [("grammar", 8, 8 + len(token))] and not got[4]
    hidden = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert hidden[2] == "here is [SECRET] in prose" and hidden[5] is None and hidden[6] == "" and hidden[4] == texts[4]
    assert key not in hidden[0] and hidden[0].startswith("ü [SECRET]")
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_secrets_in_long_runs_and_beside_base_spans(spark):
    rng = random.Random(6)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n, extra="": "".join(rng.choices(alnum + extra, k=n))
    access, git, hexes = "AKIA" + "Q7" * 8, "ghp_" + draw(36), "0a" * 12
    web = "eyJ" + draw(33) + ".eyJ" + draw(500) + "." + draw(43, "-_")
    body = draw(64, "+/") * 20
    texts = [f"see {web} here", f"see {body} here", f"see {access}/{draw(40)}. End", f"see {hexes}/{git} here", f"see {git}/{hexes}/{git} here", f"see {access}/short1 here", "see " + "interesting" * 60 + "7 here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    hidden = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert hidden[:2] == ["see [SECRET] here"] * 2
    assert hidden[2:5] == ["see [SECRET]/[SECRET]. End", "see [SECRET]/[SECRET] here", "see [SECRET]/[SECRET]/[SECRET] here"]
    assert hidden[5] == "see [SECRET]/short1 here" and hidden[6] == texts[6]


def test_every_candidate_is_scored(spark):
    """Keys of letters alone, a very long run, runs beside repeated rows; a user's column keeps its values."""
    rng = random.Random(3)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=40))
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=300_000))
    texts = [f"key {letters} end", f"key {body} end", "plain words " * 100_000, f"key {letters} end", "x 4417744280351547 1234567890123456789012 -----------------------------------"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id int, text string, _secrets string")
    got = {r.doc_id: (r.text, r["_secrets"]) for r in secrets.redact(df).collect()}
    assert got == {0: ("key [SECRET] end", "mine"), 1: ("key [SECRET] end", "mine"), 2: (texts[2], "mine"), 3: ("key [SECRET] end", "mine"), 4: (texts[4], "mine")}


def test_formats_are_learned_from_labelled_credentials(spark):
    """A format that no rule makes is found without its keyword once enough base spans have shown it."""
    rng = random.Random(4)
    draw = lambda: "#".join(["qz7"]) + "_" + "".join(rng.choices("0123456789", k=5)) + "=" + "".join(rng.choices("BDFHJ", k=20)) + "=" + "".join(rng.choices("0123456789", k=5))
    shown = [(i, f"token: {draw()} here") for i in range(60)]
    alone = draw()
    df = spark.createDataFrame([*shown, (100, f"found {alone} alone")], "doc_id int, text string")
    spans = {r.doc_id: r.secrets for r in secrets.find_secrets(df).collect()}
    assert [(s.kind, s.format, s.start, s.end) for s in spans[100]] == [("grammar", "labelled_assign", 6, 6 + len(alone))]


def test_scorer_equals_the_automata():
    models = automata.train(automata.labelled_samples(40))
    own = automata.Scorer(models)
    texts = [x for v in automata.labelled_samples(10, seed=5).values() for x in v] + ["x", "--==--", "AKIA"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = own.log_probs(data, ends - [len(t) for t in texts], ends)
    assert np.allclose(got, [[models[k].log_prob(t) for k in own.kinds] for t in texts])


def test_automata_tell_formats_apart():
    models = automata.train(automata.labelled_samples())
    unseen = automata.labelled_samples(40, seed=99)
    right = total = 0
    for kind, texts in unseen.items():
        for t in texts:
            if len(t) >= 20:
                found = automata.best_kind(models, t)
                right += (found[1] >= secrets.MARGIN) == (kind != "plain")
                total += 1
    assert right / total > 0.97
    assert automata.train(automata.labelled_samples())["hex_key"].log_prob("ab12" * 8) == models["hex_key"].log_prob("ab12" * 8)


# -- archives ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("zipped", [False, True])
def test_archive(spark, tmp_path, zipped):
    long = "<p>é WARC/1.1\r\n\r\n</p>" * 10
    rows = [(3, "u3", long), (1, "u1", long), (2, "u\r\n2", "short"), (5, None, "short"), (4, "u4", None), (None, "n", long), (7, "u7", ""), (8, "u8", long), (8, "u8", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    path = str(tmp_path / "w")
    warc.write(warc.records(df), path, zipped)
    back = {}
    for r in warc.read(spark, path).collect():
        back.setdefault(r.record_id, []).append(r)
    assert sum(map(len, back.values())) == len(rows)
    one = back["<urn:page:1>"][0]
    assert one.record_type == "response" and bytes(one.payload).decode() == long and one.payload_digest == "sha256:" + hashlib.sha256(long.encode()).hexdigest()
    assert {(r.record_type, r.refers_to, r.content_length) for k in (3, 8) for r in back[f"<urn:page:{k}>"]} == {("revisit", "<urn:page:1>", 0)}
    assert back["<urn:page:2>"][0].target_uri == "u  2" and back["<urn:page:5>"][0].target_uri is None and back["<urn:page:4>"][0].content_length == 0
    heads = warc.read(spark, path, ["record_type", "record_id"]).where("record_type = 'revisit' and record_id like '<urn:page:8%'")
    assert heads.count() == 2
    assert warc.read(spark, path).where(F.col("target_uri").isNull() | (F.col("record_type") == "none")).count() == 1


def test_filters_are_taken_over():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    reader = warc._Reader("/nowhere", ["record_type"])
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), StringStartsWith(("date",), "2024"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.wanted.passes({"record_type": "response", "target_uri": "a", "date": "2024-01"})
    assert not reader.wanted.passes({"record_type": "revisit", "target_uri": "a", "date": "2024-01"})


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(df), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
