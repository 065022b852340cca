"""Quality classifier of supervised subword embeddings.

Words and character n-grams of a text are hashed to rows of a table of learned vectors, whose mean goes through a softmax layer.
Table and layer are trained together by stochastic gradient descent in numpy. As mean and layer are linear, a fitted model
is a number per hash row, and a text's score needs one look-up per feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import Words, crc_mod, documents, keep_columns, map_texts, mix, out_schema, prefix_hash, text_slices
from bitloom.llm.sample import bounded, fit_in_task

#: Labelled texts that the model is fitted on, at most twice as many.
SAMPLE_ROWS = 3000
BITS, WIDTH = 16, 8
GRAMS = (3, 5)
EPOCHS, STEP, BATCH = 12, 2.0, 32
ACCEPT = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash rows, text numbers), for words, for pairs of words, and for the character n-grams of each length (in bytes)."""
    shift = np.uint64(64 - BITS)
    w = Words(data, offsets, lower=False)
    h = w.hashes()
    out = [((h >> shift).astype(np.int32), w.row)]
    if len(h) > 1:  # word pairs; a word said twice is one feature, whatever the word
        pairs = np.where(h[1:] == h[:-1], np.uint64(1), mix(h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)))
        inside = w.row[1:] == w.row[:-1]
        out.append(((pairs >> shift).astype(np.int32)[inside], w.row[1:][inside]))
    sums, inverse = prefix_hash(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        if len(data) >= n:
            h = (sums[n:] - sums[:-n]) * inverse[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15)  # the high bits are well spread
            inside = row[: len(h)] == row[n - 1 :]
            out.append(((h >> shift).astype(np.int32)[inside], row[: len(h)][inside]))
    return out


@dataclass
class Model:
    """Score of a text: logistic of bias plus the mean of its features' numbers."""

    numbers: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for rows, texts in features(data, offsets):
            total += np.bincount(texts, self.numbers[rows], minlength=n)
            count += np.bincount(texts, minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """Trains vectors and a two-class softmax layer. With one class or no texts, the score is the share of label 1 (0.5 for none)."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.02), 0.98)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    held = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        rows, of = (np.concatenate(x) for x in zip(*features(data, offsets)))
        n = len(offsets) - 1
        keys, counts = np.unique(of.astype(np.int64) << BITS | rows, return_counts=True)
        cuts = np.searchsorted(keys >> BITS, np.arange(n + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            held.append(((keys[a:b] & ((1 << BITS) - 1)).astype(np.int32), (counts[a:b] / max(counts[a:b].sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    bias[1] = np.log(y.mean() / (1 - y.mean()))
    steps, done = EPOCHS * (-(-len(y) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo : lo + BATCH]
            rate = STEP * (1 - done / steps)
            done += 1
            rows = np.concatenate([held[k][0] for k in own])
            weights = np.concatenate([held[k][1] for k in own])
            of = np.repeat(np.arange(len(own)), [len(held[k][0]) for k in own])
            mean = np.zeros((len(own), WIDTH), np.float32)
            np.add.at(mean, of, table[rows] * weights[:, None])
            z = mean @ layer + bias
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(own)), y[own]] -= 1.0
            back = prob @ layer.T
            layer -= rate / len(own) * (mean.T @ prob)
            bias -= 0.1 * rate / len(own) * prob.sum(0)
            np.add.at(table, rows, back[of] * (-rate * weights)[:, None])
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(df: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on about sample_rows rows of df that have text and a label of 0 or 1."""
    own = df.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(key, text, label)
    rows = bounded(own, F.col(key), sample_rows).select(F.col(key).cast("string").alias("key"), text, F.col(label).cast("int").alias("label"))

    def run(table: pa.Table) -> Model:
        ids, texts, labels = (c.to_pylist() for c in table.columns)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] or "", texts[i]))
        return fit([texts[i] for i in order], [labels[i] for i in order])

    return fit_in_task(rows, run)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds the probability of label 1. A null or empty text has that of no evidence. Other columns pass through; one named like
    `out` is replaced. No row moves."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    schema = out_schema(df, () if keep_text else (text,), f"`{out}` double")
    names = schema.names[:-1]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                yield keep_columns(batch.slice(lo, hi - lo), names, {out: pa.array(shared.value.scores(data, offsets))})

    return map_texts(df, run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labelled documents that aren't held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    chosen = F.broadcast(bounded(labels, F.col("doc_id"), SAMPLE_ROWS))  # no more than twice SAMPLE_ROWS rows of 12 bytes
    found = score(docs, train(docs.join(chosen, "doc_id")), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
