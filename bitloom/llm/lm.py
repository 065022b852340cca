"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. The FREQUENT most frequent words have an entry each in the vocabulary; the others share
one by the hash of their last letters, times their own share of it by add-one counts, so every token goes through the model. Entries belong to
classes: those of the TOP most frequent words by rank, the others by last letters. A word's probability after two others is that of
its class, (r1[k1] + r2[k2]) . qc[c] + bc[c] normalised over the classes, times that of its entry in the class, u[k2] . q[w] + b[w] normalised
over the entries of the class; k is the word itself for the TOP ones, else its last letters. Counts are exact and cover all training texts.

The model is trained on the word triples of all training texts: each task takes its own triples, with their counts, through one pass of
STEPS batches from common starting values, and every row of the model is averaged over the tasks by the tokens that it had there. As normalisers
depend on (k1, k2) or (k2, c) alone, they are worked out once for all pairs by batched matrix products.

Rare words are too many to broadcast: only their (text, count) entries are shuffled, by word, and what comes back is a sum per text.
The FREQUENT most frequent words are broadcast, so no word that is shuffled makes up more than 1 / FREQUENT of the tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import Words, crc_mod, cut, documents, hash_bytes, map_texts, mix, text_slices

#: Words with an entry each; words that are contexts of their own, in classes of TOP // TOP_CLASSES; hashes of last letters; numbers in a vector.
FREQUENT, TOP, TOP_CLASSES, SUFFIXES, WIDTH = 65_536, 768, 64, 192, 16
CONTEXTS, CLASSES = TOP + SUFFIXES, TOP_CLASSES + SUFFIXES
#: Distinct words or triples that a task holds before it sends what it has.
HELD = 1_500_000
#: Noise classes of a batch, noise words of a triple, batches of a pass.
NOISE, NOISE_WORDS, STEPS, RATE = 64, 2, 300, 0.1
#: The end of a text, as a word that no text can hold.
END = int(hash_bytes([b"\n"])[0]) >> 8

_TEN = np.log(10.0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key per token, row per token, tokens per row); every row closes with END. A key holds the hash of the word's last two bytes in its first 8 bits."""
    w = Words(data, offsets)
    ends = np.cumsum(w.counts + 1) - 1
    h = np.full(int(ends[-1]) + 1, np.uint64(END))
    inside = np.ones(len(h), bool)
    inside[ends] = False
    last = w.data[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    suffix = mix(last << np.uint64(8) | before) % np.uint64(SUFFIXES)
    h[inside] = suffix << np.uint64(56) | w.hashes() >> np.uint64(8)
    return h, np.repeat(np.arange(len(w.counts)), w.counts + 1), w.counts + 1


# -- counts ---------------------------------------------------------------------------------------------


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of docs (doc, text, ...), summed within tasks first."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, counts = _tally(held)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                keys, counts = np.unique(tokens(data, offsets)[0], return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > HELD:
                    held = [_tally(held)]
                    if (size := len(held[0][0])) > HELD // 2:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return map_texts(docs, run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Counts:
    """Totals; the most frequent words in ascending order of key, with counts and entries; and the vocabulary's entries in order of class.

    Entries below TOP are the most frequent words by rank, END being the first. `rest` has the entry that the words without one of their own share, by last
    letters, and rest_tokens and rest_distinct count those.
    """

    tokens: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    rest: np.ndarray
    rest_tokens: np.ndarray
    rest_distinct: np.ndarray
    classes: np.ndarray
    contexts: np.ndarray
    bounds: np.ndarray
    unigram: np.ndarray

    @staticmethod
    def of(n: int, v: int, words: np.ndarray, c: np.ndarray, rest_tokens: np.ndarray, rest_distinct: np.ndarray) -> "Counts":
        """words and c: the frequent words, END first, then from the most frequent on."""
        own = np.where(np.arange(len(words)) < TOP, np.arange(len(words)) // (TOP // TOP_CLASSES), TOP_CLASSES + (words >> np.uint64(56)).astype(np.int64))
        classes = np.concatenate([own, TOP_CLASSES + np.arange(SUFFIXES)])
        weight = np.concatenate([c + 1.0, rest_tokens + rest_distinct + 1.0])
        order = np.argsort(classes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        top = min(len(words), TOP)  # these are their own places
        by_key = np.argsort(words, kind="stable")
        classes = classes[order]
        contexts = np.where(np.arange(len(order)) < top, np.arange(len(order)), TOP - TOP_CLASSES + classes)
        bounds = np.searchsorted(classes, np.arange(CLASSES + 1))
        return Counts(n, v, words[by_key], c[by_key], place[: len(words)][by_key], place[len(words) :], rest_tokens, rest_distinct, classes, contexts, bounds, weight[order] / weight.sum())

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether frequent, count, entry) per key."""
        rest = self.rest[np.minimum(h >> np.uint64(56), np.uint64(SUFFIXES - 1)).astype(np.int64)]
        if not len(self.words):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), rest
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return hit, np.where(hit, self.counts[at], 0), np.where(hit, self.numbers[at], rest)

    def rest_floor(self) -> np.ndarray:
        """log10 of the add-one total of the words that share an entry, by entry (0 for others)."""
        out = np.zeros(len(self.classes))
        out[self.rest] = np.log10(self.rest_tokens + self.rest_distinct + 1)
        return out


def gather_counts(training: DataFrame) -> Counts:
    """Totals and frequent words; no more than FREQUENT rows, and SUFFIXES sums, reach the driver."""
    counts = cut(word_counts(training))
    suffix = F.shiftrightunsigned("word", 56)
    sums = {int(r["s"]): (int(r["n"]), int(r["v"])) for r in counts.groupBy(suffix.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    top = counts.orderBy(F.when(F.col("word") == END, 0).otherwise(1), F.desc("c"), "word").limit(FREQUENT).toArrow()
    words, c = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    own = (words >> np.uint64(56)).astype(np.int64)
    tokens_, distinct = (np.array([sums.get(k, (0, 0))[i] for k in range(SUFFIXES)], np.int64) for i in (0, 1))
    rest_tokens = tokens_ - np.bincount(own, c, minlength=SUFFIXES).astype(np.int64)[:SUFFIXES]
    rest_distinct = distinct - np.bincount(own, minlength=SUFFIXES)[:SUFFIXES]
    return Counts.of(sum(n for n, _ in sums.values()), sum(v for _, v in sums.values()), words, c, rest_tokens, rest_distinct)


# -- model ------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Context vectors for classes by place, class vectors and biases; context vectors for entries, entry vectors and biases."""

    r1: np.ndarray
    r2: np.ndarray
    qc: np.ndarray
    bc: np.ndarray
    u: np.ndarray
    q: np.ndarray
    b: np.ndarray

    #: Tables of the model and the biases beside them, as (vectors, biases).
    TABLES = (("r1", None), ("r2", None), ("qc", "bc"), ("u", None), ("q", "b"))

    @staticmethod
    def start(counts: Counts, seed: int = 5) -> "Model":
        """Common starting values: small vectors, biases of the unigram."""
        rng = np.random.default_rng(seed)
        small = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        by_class = np.bincount(counts.classes, counts.unigram, minlength=CLASSES)
        with np.errstate(divide="ignore"):
            bc, b = np.maximum(np.log(by_class), -50.0), np.log(counts.unigram / by_class[counts.classes])
        return Model(small(CONTEXTS), small(CONTEXTS), small(CLASSES), bc.astype(np.float32), small(CONTEXTS), small(len(counts.unigram)), b.astype(np.float32))

    def class_normalisers(self, k1: int) -> np.ndarray:
        """Log of the sum of exp(score) over the classes after (k1, each context)."""
        return _log_sums((self.r1[k1] + self.r2) @ self.qc.T + self.bc)

    def entry_normalisers(self, lo: int, hi: int) -> np.ndarray:
        """The same over the entries lo .. hi-1 of a class, after each context."""
        return _log_sums(self.u @ self.q[lo:hi].T + self.b[lo:hi]) if hi > lo else np.zeros(CONTEXTS, np.float32)

    def log_probs(self, k1: np.ndarray, k2: np.ndarray, w: np.ndarray, counts: Counts, z: np.ndarray, zw: np.ndarray) -> np.ndarray:
        """Natural log probabilities of entries after contexts; z (context x context) and zw (class x context) are the normalisers."""
        c = counts.classes[w]
        of_class = np.einsum("ij,ij->i", self.r1[k1] + self.r2[k2], self.qc[c]) + self.bc[c] - z[k1, k2]
        return of_class.astype(np.float64) + (np.einsum("ij,ij->i", self.u[k2], self.q[w]) + self.b[w] - zw[c, k2])


def _log_sums(scores: np.ndarray) -> np.ndarray:
    z = scores.astype(np.float32)
    top = z.max(1, keepdims=True)
    return (top[:, 0] + np.log(np.exp(z - top).sum(1))).astype(np.float32)


class _Steps:
    """Adaptive steps of the rows of tables that have the same rows."""

    def __init__(self, *tables: np.ndarray):
        self.tables, self.squares = tables, [np.full(t.shape, 1e-8, np.float32) for t in tables]

    def __call__(self, rows: np.ndarray, rate: float, *gradients: np.ndarray) -> None:
        """Sums the gradients of equal rows and moves those."""
        keys = np.sort(rows << 32 | np.arange(len(rows)))
        order, rows = keys & 0xFFFFFFFF, keys >> 32
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows = rows[first]
        for table, squares, gradient in zip(self.tables, self.squares, gradients):
            d = np.add.reduceat(gradient[order], first, axis=0)
            s = squares[rows]
            s += d * d
            squares[rows] = s
            d *= rate
            d /= np.sqrt(s, out=s)
            table[rows] += d

    @staticmethod
    def of(model: "Model") -> dict[str, "_Steps"]:
        return {"k1": _Steps(model.r1), "k2": _Steps(model.r2, model.u), "class": _Steps(model.qc, model.bc), "entry": _Steps(model.q, model.b)}


def nce(model: Model, steps: dict[str, _Steps], triples: np.ndarray, weights: np.ndarray, counts: Counts, seed: int) -> None:
    """Weighted noise-contrastive estimation, one pass in STEPS batches: of classes against noise classes of the unigram, drawn per batch, and of entries
    against noise entries of their own class."""
    rng = np.random.default_rng(seed)
    n_entries = len(counts.classes)
    by_class = np.bincount(counts.classes, counts.unigram, minlength=CLASSES)
    with np.errstate(divide="ignore"):
        log_class = (np.log(by_class) + np.log(NOISE)).astype(np.float32)
        log_entry = (np.log(counts.unigram / by_class[counts.classes]) + np.log(NOISE_WORDS)).astype(np.float32)
    up_to = np.append(0, np.cumsum(counts.unigram))
    size = -(-len(triples) // STEPS)
    scale = len(triples) / size / weights.sum()
    order = rng.permutation(len(triples))
    for lo in range(0, len(order), size):
        own = order[lo : lo + size]
        rate = RATE * (1 - lo / len(order))
        pair, w = np.divmod(triples[own], n_entries)
        k1, k2 = np.divmod(pair, CONTEXTS)
        weight, c = (weights[own] * scale).astype(np.float32), counts.classes[w]
        h = model.r1[k1] + model.r2[k2]
        noise = rng.choice(CLASSES, NOISE, p=by_class)
        real = np.einsum("ij,ij->i", h, model.qc[c]) + model.bc[c] - log_class[c]
        fake = h @ model.qc[noise].T + model.bc[noise] - log_class[noise]
        g = weight / (1 + np.exp(np.clip(real, -30, 30)))
        f = -weight[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
        dh = g[:, None] * model.qc[c] + f @ model.qc[noise]
        rows, dq, db = np.concatenate([c, noise]), np.concatenate([g[:, None] * h, f.T @ h]), np.concatenate([g, f.sum(0)])
        # entries
        lows, highs = up_to[counts.bounds[c]], up_to[counts.bounds[c + 1]]
        other = np.searchsorted(up_to, lows[:, None] + rng.random((len(own), NOISE_WORDS)) * (highs - lows)[:, None], "right") - 1
        other = np.clip(other, counts.bounds[c][:, None], counts.bounds[c + 1][:, None] - 1)
        t, qw, qo = model.u[k2], model.q[w], model.q[other]
        real = np.einsum("ij,ij->i", t, qw) + model.b[w] - log_entry[w]
        fake = np.einsum("ij,ikj->ik", t, qo) + model.b[other] - log_entry[other]
        gw = weight / (1 + np.exp(np.clip(real, -30, 30)))
        fw = -weight[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
        dt = gw[:, None] * qw + np.einsum("ik,ikj->ij", fw, qo)
        entries = np.concatenate([w, other.ravel()])
        dw, dbw = np.concatenate([gw[:, None] * t, (fw[:, :, None] * t[:, None, :]).reshape(-1, WIDTH)]), np.concatenate([gw, fw.ravel()])
        steps["k1"](k1, rate, dh)
        steps["k2"](k2, rate, dh, dt)
        steps["class"](rows, rate, dq, db)
        steps["entry"](entries, rate, dw, dbw)


def _context(numbers: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the second last and last token before each; before a text there are ends."""
    one, two = np.full(len(numbers), end), np.full(len(numbers), end)
    first = np.cumsum(sizes) - sizes
    one[1:] = numbers[:-1]
    two[2:] = numbers[:-2]
    one[first], two[first] = end, end
    second = (first + 1)[sizes > 1]
    two[second] = end
    return two, one


def _triples(data: np.ndarray, offsets: np.ndarray, counts: Counts):
    """(keys, whether frequent, counts, entries, contexts k1 and k2, rows, sizes) of the tokens of a run of texts."""
    h, row, sizes = tokens(data, offsets)
    hit, count, number = counts.look_up(h)
    end = int(counts.contexts[counts.look_up(np.array([END], np.uint64))[2][0]])
    two, one = _context(counts.contexts[number], sizes, end)
    return h, hit, count, number, two, one, row, sizes


def train(training: DataFrame, counts: Counts) -> tuple[Model, np.ndarray, np.ndarray]:
    """(model, its normalisers of classes, and of entries). Each task returns the rows that it had tokens for, averaged by Spark."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    columns = [f"v{k}" for k in range(WIDTH)] + ["bias"]

    def run(batches):
        own = shared.value
        n_entries = len(own.classes)
        held, size, trained, steps = [], 0, None, {}
        had = {"r1": np.zeros(CONTEXTS), "r2": np.zeros(CONTEXTS), "qc": np.zeros(CLASSES), "q": np.zeros(n_entries)}

        def learn():
            nonlocal trained
            keys, weights = _tally(held)
            if trained is None:
                trained = Model.start(own)
                steps.update(_Steps.of(trained))
            nce(trained, steps, keys, weights.astype(np.float64), own, len(keys))
            pair, w = np.divmod(keys, n_entries)
            for name, at, n in (("r1", pair // CONTEXTS, CONTEXTS), ("r2", pair % CONTEXTS, CONTEXTS), ("qc", own.classes[w], CLASSES), ("q", w, n_entries)):
                had[name] += np.bincount(at, weights, minlength=n)

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                _, _, _, number, two, one, _, _ = _triples(data, offsets, own)
                held.append(np.unique((two * CONTEXTS + one) * n_entries + number, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_tally(held)]
                    if (size := len(held[0][0])) > HELD // 2:
                        learn()
                        held, size = [], 0
        if held:
            learn()
        if trained is not None:
            for number, (name, bias) in enumerate(Model.TABLES):
                weight = had["r2" if name == "u" else name]
                rows = np.flatnonzero(weight)
                values = getattr(trained, name)[rows]
                values = np.concatenate([values, (getattr(trained, bias)[rows] if bias else np.zeros(len(rows)))[:, None]], 1) * weight[rows, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), pa.array(rows), pa.array(weight[rows]), *(pa.array(x) for x in np.ascontiguousarray(values.T))], names=["part", "row", "weight", *columns])

    sums = map_texts(training, run, ", ".join(["part int, row bigint, weight double", *(f"{c} double" for c in columns)]))
    means = sums.groupBy("part", "row").agg(*((F.sum(c) / F.sum("weight")).alias(c) for c in columns)).toArrow()  # a row for each of the model's
    model = Model.start(counts)
    part, rows = means.column(0).to_numpy(), means.column(1).to_numpy()
    values = np.stack([means.column(c).to_numpy() for c in columns], 1) if len(means) else np.zeros((0, len(columns)))
    for number, (name, bias) in enumerate(Model.TABLES):
        of = part == number
        getattr(model, name)[rows[of]] = values[of, :WIDTH]
        if bias:
            getattr(model, bias)[rows[of]] = values[of, WIDTH]
    fixed = spark.sparkContext.broadcast((model, counts.bounds))

    def normalise(batches):
        m, bounds = fixed.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                z = m.class_normalisers(k) if k < CONTEXTS else m.entry_normalisers(int(bounds[k - CONTEXTS]), int(bounds[k - CONTEXTS + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["id", "z"])

    z = spark.range(0, CONTEXTS + CLASSES, 1, 12).mapInArrow(normalise, "id bigint, z binary").orderBy("id").toArrow()
    z = np.stack([np.frombuffer(x, np.float32) for x in z.column(1).to_pylist()])
    return model, z[:CONTEXTS], z[CONTEXTS:]


# -- scoring ------------------------------------------------------------------------------------------------

_DOC = np.dtype([("key", "<i8"), ("id", "<i8"), ("null", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("lm", "<f8")])
_SUM = np.dtype([("key", "<i8"), ("logs", "<f8"), ("known", "<i8")])


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of texts by key: 1024 neighbours go together."""
    return (mix((keys >> 10).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def lm_scores(docs: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Learns from rows whose held_out is false; rows where it is null are neither. base_score: add-one unigram; score: the model;
    both log10 of the whole text's probability with its end. A null or empty text is its end alone. With nothing to learn
    from, scores are those of untrained values. Repeated rows are scored one by one, and a very long text like any other: its rare words are sent in parts.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    training = own.where("not held")
    counts = gather_counts(training)
    model, z, zw = train(training, counts)
    shared = spark.sparkContext.broadcast((counts, model, z, zw))
    rare = counts.tokens - int(counts.counts.sum())
    buckets = max(int(rare * 1.3 / HELD) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    floor = np.log10(counts.tokens + counts.distinct + 1)

    def score(batches):
        c, m, norms, entry_norms = shared.value
        rest_floor = c.rest_floor()
        key = TaskContext.get().partitionId() << 34
        words, texts, times, first, size = [], [], [], key, 0

        def send():
            w, t, n = np.concatenate(words), np.concatenate(texts), np.concatenate(times)
            bucket = ((mix(w) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            for k, at in _by_bucket(bucket, buckets):
                at = at[np.argsort(w[at], kind="stable")]
                distinct, entries = np.unique(w[at], return_counts=True)
                blobs = [distinct.tobytes(), entries.astype("<u4").tobytes(), t[at].astype("<u4").tobytes(), n[at].astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([None], pa.binary())], names=_NAMES)

        for batch in batches:
            ids, flags = batch.column(0), batch.column(2)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                h, hit, count, number, two, one, row, sizes = _triples(data, offsets, c)
                s = m.log_probs(two, one, number, c, norms, entry_norms)
                logs = np.log10(count + 1.0)
                own_ids = ids.slice(lo, hi - lo)
                d = np.zeros(hi - lo, _DOC)
                d["key"] = key + np.arange(hi - lo)
                d["id"], d["null"] = np.array(own_ids.fill_null(0)), np.array(own_ids.is_null())
                d["held"] = np.array(flags.slice(lo, hi - lo))
                d["n"] = sizes
                d["known"] = np.bincount(row, count > 0, minlength=hi - lo)
                d["base"] = np.bincount(row, logs, minlength=hi - lo) - sizes * floor
                d["lm"] = np.bincount(row, s / _TEN - np.where(hit, 0.0, rest_floor[number]), minlength=hi - lo)
                for k, at in _by_bucket(_dealt(d["key"], buckets), buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0]), *(pa.array([None], pa.binary()) for _ in range(4)), pa.array([d[at].tobytes()], pa.binary())], names=_NAMES)
                if not hit.all():
                    order = np.lexsort((h[~hit], row[~hit]))
                    w, r = h[~hit][order], row[~hit][order]
                    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])))
                    words.append(w[new])
                    texts.append((key - first + r[new]) << 1 | ~d["held"][r[new]])
                    times.append(np.diff(np.append(new, len(w))))
                    size += len(new)
                key += hi - lo
                if size > HELD:
                    yield from send()
                    words, texts, times, first, size = [], [], [], key, 0
        if size:
            yield from send()

    def look_up(batches):
        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([row["docs"]], pa.binary()), pa.array([None], pa.binary())], names=["bucket", "docs", "sums"])
                    continue
                w = np.repeat(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["entries"], "<u4"))
                t = np.frombuffer(row["texts"], "<u4").astype(np.int64)
                parts.append((w, (t >> 1) + row["first"], (t & 1).astype(bool), np.frombuffer(row["times"], "<u4").astype(np.int64)))
        if not parts:
            return
        w, keys, learned, n = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        _, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, np.where(learned, n, 0))[at]
        texts, at = np.unique(keys, return_inverse=True)
        d = np.zeros(len(texts), _SUM)
        d["key"], d["logs"], d["known"] = texts, np.bincount(at, n * np.log10(c + 1.0)), np.bincount(at, np.where(c > 0, n, 0))
        for k, at in _by_bucket(_dealt(texts, buckets), buckets):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([None], pa.binary()), pa.array([d[at].tobytes()], pa.binary())], names=["bucket", "docs", "sums"])

    def add_up(batches):
        docs_, sums = [], []
        for batch in batches:
            docs_ += [np.frombuffer(x, _DOC) for x in batch.column(1).to_pylist() if x is not None]
            sums += [np.frombuffer(x, _SUM) for x in batch.column(2).to_pylist() if x is not None]
        if not docs_:
            return
        d = np.sort(np.concatenate(docs_), order="key")
        s = np.concatenate(sums) if sums else np.zeros(0, _SUM)
        at = np.searchsorted(d["key"], s["key"])
        logs = np.bincount(at, s["logs"], minlength=len(d))
        known = np.bincount(at, s["known"], minlength=len(d)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(d["id"], mask=d["null"]),
                pa.array(d["held"]),
                pa.array(d["n"]),
                pa.array(d["known"] + known),
                pa.array(np.full(len(d), counts_tokens)),
                pa.array(d["base"] + logs),
                pa.array(d["lm"] + logs),
            ],
            names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    counts_tokens = counts.tokens
    first = map_texts(own, score, _ROWS).repartition(buckets, "bucket").mapInArrow(look_up, "bucket int, docs binary, sums binary")
    out = first.repartition(buckets, "bucket").mapInArrow(add_up, "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("doc", doc)


_NAMES = ["bucket", "first", "words", "entries", "texts", "times", "docs"]
_ROWS = "bucket int, first bigint, words binary, entries binary, texts binary, times binary, docs binary"


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from those whose crc32 modulo 7 is not 2, one without an id among them."""
    return lm_scores(documents(spark, sf_dir, "doc_id", "text"), F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
