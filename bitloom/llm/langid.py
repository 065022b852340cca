"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability per language. A word's probability is the sum over all its
segmentations into pieces, by a forward pass over its bytes, however long it is; a text's is the product over its words, and the
languages' shares of that are their scores. Piece probabilities come from expectation maximisation over the same
segmentations on a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import crc_mod, documents, hash_bytes, keep_columns, map_texts, mix, out_schema, prefix_hash, text_slices
from bitloom.llm.sample import bounded, fit_in_task

#: Labelled texts that the model is fitted on, at most twice as many.
SAMPLE_ROWS = 3000
#: Words of up to so many bytes go through the forward pass side by side, in plain numbers; longer ones one at a time, in logarithms.
SHORT = 24
#: Words whose log probabilities a task remembers.
HELD_WORDS = 150_000
ROUNDS = 5
#: Count that a piece of one byte has before any text, and its share for every further byte: a long piece that no text has is as unlikely as its bytes.
PRIOR, PRIOR_BYTE = 0.05, 1 / 16
UNKNOWN = "und"
#: Every so manyth sample text is held out for floors(); standard errors that a text's rate may be below its language's floor.
FLOOR_SHARE, FLOOR_ERRORS = 5, 2.0
MARK = "▁"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Pieces:
    """The vocabulary as sorted hashes with piece numbers: of pieces that begin a word, and of pieces inside one."""

    begin: tuple[np.ndarray, np.ndarray]
    inside: tuple[np.ndarray, np.ndarray]
    mark: int
    size: int
    longest: int
    prior: np.ndarray

    @staticmethod
    def load(path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        begin, inside, mark = {}, {}, 0  # a byte that is a piece of its own comes later and takes the place of the fallback
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                inside[bytes([int(piece[3:5], 16)])] = i
            elif piece == MARK:
                mark = i
            elif MARK not in piece[1:]:
                own = piece.removeprefix(MARK).encode()
                (begin if piece[0] == MARK else inside)[own] = i
        prior = np.full(model.get_piece_size(), PRIOR)
        for own, i in (*begin.items(), *inside.items()):
            prior[i] = PRIOR * PRIOR_BYTE ** (len(own) - 1)
        table = lambda x: (lambda h, n: (h[o := np.argsort(h, kind="stable")], n[o]))(hash_bytes(list(x)), np.array(list(x.values())))
        return Pieces(table(begin), table(inside), mark, model.get_piece_size(), max(map(len, [*begin, *inside])), prior)


def letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a letter: ASCII letters, and what isn't ASCII but for the signs, spaces and pictures of the larger blocks of those."""
    inside = _LETTER[data]
    if not (data >= 0xC2).any():
        return inside
    follow = lambda at, k: data[np.minimum(at + k, len(data) - 1)]
    # lead byte, width, whether the character is none by its second and third bytes
    for lead, width, other in (
        (0xC2, 2, lambda b, c: ~np.isin(b, (0xAA, 0xB5, 0xBA))),
        (0xC3, 2, lambda b, c: np.isin(b, (0x97, 0xB7))),
        (0xE2, 3, lambda b, c: np.isin(b, (0x80, 0x81, 0x82)) | ((b >= 0x86) & (b <= 0xAF))),
        (0xE3, 3, lambda b, c: (b == 0x80) & ~np.isin(c, (0x85, 0x86, 0x87))),
        (0xEF, 3, lambda b, c: ((b == 0xBC) & (c < 0xA1)) | ((b == 0xBB) & (c == 0xBF))),
        (0xF0, 4, lambda b, c: b == 0x9F),
    ):
        at = np.flatnonzero(data == lead)
        at = at[other(follow(at, 1), follow(at, 2))]
        for k in range(width):
            inside[np.minimum(at + k, len(data) - 1)] = False
    return inside


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of stretches of letters."""
    inside = letters(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def arcs(pieces: Pieces, sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(from, to, words, pieces, begins) for every piece found in the words, which must be in descending order of length."""
    found = []
    for i in range(int(lengths[0]) if len(lengths) else 0):
        for n in range(1, pieces.longest + 1):
            m = int(np.searchsorted(-lengths, -(i + n), "right"))
            if not m:
                break
            a = starts[:m] + i
            h = mix((sums[a + n] - sums[a]) * inverse[a])
            for begins, (keys, numbers) in ((True, pieces.begin), (False, pieces.inside)) if not i else ((False, pieces.inside),):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                if len(hit):
                    found.append((i, i + n, hit.astype(np.int32), numbers[at[hit]].astype(np.int32), begins))
    return found


def forward(found, p: np.ndarray, mark: int, n: int, longest: int) -> np.ndarray:
    """Sums over segmentations up to each place: words x places x languages."""
    a = np.zeros((n, longest + 1, p.shape[1]))
    for i, j, rows, numbers, begins in found:
        a[rows, j] += p[numbers] * (1.0 if begins else p[mark] if not i else a[rows, i])
    return a


class LongWord:
    """The pieces found in one word of any length, and sums over its segmentations in logarithms."""

    def __init__(self, pieces: Pieces, sums: np.ndarray, inverse: np.ndarray, start: int, length: int):
        found = []
        for n in range(1, min(pieces.longest, length) + 1):
            a = start + np.arange(length - n + 1)
            h = mix((sums[a + n] - sums[a]) * inverse[a])
            for begins, (keys, numbers), tried in ((True, pieces.begin, h[:1]), (False, pieces.inside, h)):
                at = np.minimum(np.searchsorted(keys, tried), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == tried)
                found.append((hit, hit + n, numbers[at[hit]], np.full(len(hit), begins)))
        self.first, self.last, self.numbers, begins = (np.concatenate(x) for x in zip(*found))
        self.length, self.marked = length, (self.first == 0) & ~begins
        self.mark = pieces.mark

    def _sums(self, logs: np.ndarray, source: np.ndarray, target: np.ndarray, places: range) -> np.ndarray:
        """Log sums over ways through the pieces, place by place."""
        out = np.full((self.length + 1, logs.shape[1]), -np.inf)
        out[places.start] = 0.0
        order = np.argsort(target, kind="stable")
        source, logs = source[order], logs[order]
        cuts = np.searchsorted(target[order], np.arange(self.length + 2))
        for j in places[1:]:
            own = slice(cuts[j], cuts[j + 1])
            v = logs[own] + out[source[own]]
            top = v.max(0)
            out[j] = top + np.log(np.exp(v - top).sum(0))
        return out

    def piece_logs(self, log_p: np.ndarray) -> np.ndarray:
        return log_p[self.numbers] + np.where(self.marked[:, None], log_p[self.mark], 0.0)

    def forward(self, logs: np.ndarray) -> np.ndarray:
        return self._sums(logs, self.first, self.last, range(0, self.length + 1))

    def expect(self, log_p: np.ndarray, weight: np.ndarray, expected: np.ndarray) -> None:
        """Adds the expected numbers of the word's pieces, times weight by language."""
        logs = self.piece_logs(log_p)
        a, b = self.forward(logs), self._sums(logs, self.last, self.first, range(self.length, -1, -1))
        share = np.exp(a[self.first] + logs + b[self.last] - a[self.length]) * weight
        np.add.at(expected, self.numbers, share)
        expected[self.mark] += share[self.marked].sum(0)


def word_log_probs(pieces: Pieces, p: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Natural log probabilities of words, words x languages."""
    sums, inverse = prefix_hash(data)
    order = np.argsort(starts - ends, kind="stable")
    out = np.empty((len(starts), p.shape[1]))
    long = int(np.searchsorted((starts - ends)[order], -SHORT))
    if long:
        log_p = np.log(p)
        for k in order[:long].tolist():
            word = LongWord(pieces, sums, inverse, int(starts[k]), int(ends[k] - starts[k]))
            out[k] = word.forward(word.piece_logs(log_p))[-1]
    for lo in range(long, len(order), step):
        own = order[lo : lo + step]
        lengths = ends[own] - starts[own]
        a = forward(arcs(pieces, sums, inverse, starts[own], lengths), p, pieces.mark, len(own), int(lengths[0]))
        out[own] = np.log(a[np.arange(len(own)), lengths])
    return out


def fit(pieces: Pieces, texts: list[str], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) from labelled texts."""
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    data = _LOWER[data]
    offsets = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts], dtype=np.int64))
    starts, ends, rows = words_of(data, np.minimum(offsets, len(data)))
    p = np.full((pieces.size, max(len(languages), 1)), 1.0 / pieces.size)
    if not len(starts):
        return languages, p
    sums, inverse = prefix_hash(data)
    _, first, same = np.unique(mix((sums[ends] - sums[starts]) * inverse[starts]), return_index=True, return_inverse=True)
    counts = np.zeros((len(first), len(languages)))
    np.add.at(counts, (same, np.array([number[x] for x in labels])[rows]), 1.0)
    starts, lengths = starts[first], (ends - starts)[first]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, counts = starts[order], lengths[order], counts[order]
    long = int(np.searchsorted(-lengths, -SHORT))
    apart = [(LongWord(pieces, sums, inverse, int(a), int(n)), c) for a, n, c in zip(starts[:long], lengths[:long], counts[:long])]
    parts = []
    for lo in range(long, len(starts), 16_384):
        own = slice(lo, lo + 16_384)
        parts.append((arcs(pieces, sums, inverse, starts[own], lengths[own]), lengths[own], counts[own]))
    for _ in range(ROUNDS):
        expected = np.zeros_like(p)
        log_p = np.log(p)
        for word, weight in apart:
            word.expect(log_p, weight, expected)
        for found, size, weight in parts:
            n, longest = len(size), int(size[0])
            a = forward(found, p, pieces.mark, n, longest)
            b = np.zeros_like(a)
            b[np.arange(n), size] = weight / a[np.arange(n), size]
            for i, j, rows, numbers, begins in reversed(found):
                share = p[numbers] * b[rows, j]
                if not i:
                    if not begins:
                        share = share * p[pieces.mark]
                        expected[pieces.mark] += share.sum(0)
                    np.add.at(expected, numbers, share)
                else:
                    np.add.at(expected, numbers, share * a[rows, i])
                    b[rows, i] += share
        p = expected + pieces.prior[:, None]
        p /= p.sum(0)
    return languages, p



def train(df: DataFrame, vocabulary_path: str, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[Pieces, list[str], np.ndarray]:
    """Fits piece probabilities on about sample_rows rows of df with text and label."""
    own = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    rows = bounded(own, F.col(key), sample_rows).select(text, label)
    pieces = Pieces.load(vocabulary_path)
    return pieces, *fit_in_task(rows, lambda t: fit(pieces, *_in_order(t)))


def _in_order(table: pa.Table) -> tuple[list[str], list[str]]:
    """(texts, labels) of a sample, in an order that doesn't hang on that of its rows."""
    rows = sorted(zip(table.column(1).to_pylist(), table.column(0).to_pylist()))
    return [t for _, t in rows], [x for x, _ in rows]


class Memory:
    """Log probabilities of the words that were met last, by hash; results don't depend on it."""

    def __init__(self, languages: int):
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, languages))

    def look_up(self, keys: np.ndarray, work_out) -> np.ndarray:
        """Values of ascending keys; work_out(numbers of keys) gives those of new ones."""
        if len(self.keys) > HELD_WORDS:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty((len(keys), self.values.shape[1]))
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = work_out(new)
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new], axis=0)
        return out


def rates(pieces: Pieces, p: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities, characters) of words, the former by language."""
    sums, inverse = prefix_hash(data)
    keys, first, same = np.unique(mix((sums[ends] - sums[starts]) * inverse[starts]), return_index=True, return_inverse=True)
    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    logs = (memory or Memory(p.shape[1])).look_up(keys, lambda new: word_log_probs(pieces, p, data, starts[first[new]], ends[first[new]]))
    return logs[same], np.maximum(heads[ends] - heads[starts], 1)


def learn_floors(pieces: Pieces, texts: list[str], labels: list[str]) -> np.ndarray:
    """(least log probability per character of a text in the language, spread of that of its words), per language of fit().

    A part of the texts is held out. The floor lies three quarters of the way from the median of the own texts to that of the likest noise: texts of another language or the own ones with the
    letters of each word in another order. Texts that mix learned languages lie above it.
    """
    languages = sorted(set(labels))
    learned = [k for k in range(len(texts)) if k % FLOOR_SHARE] or list(range(len(texts)))
    known, p = fit(pieces, [texts[k] for k in learned], [labels[k] for k in learned])
    out = np.full((max(len(languages), 1), 2), (-np.inf, 0.0))
    rng = np.random.default_rng(3)
    shuffled = lambda t: " ".join("".join(rng.permutation(list(w))) for w in t.lower().split())

    def measure(texts):
        data = _LOWER[np.frombuffer("\n".join(texts).encode(), np.uint8)]
        offsets = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts], dtype=np.int64))
        starts, ends, rows = words_of(data, np.minimum(offsets, len(data)))
        if not len(starts):
            return np.empty((0, len(known))), np.empty((0, len(known)))
        logs, n = rates(pieces, p, data, starts, ends)
        sums = np.stack([np.bincount(rows, x, minlength=len(texts)) for x in logs.T], 1)
        size = np.bincount(rows, n, minlength=len(texts))
        return sums[size > 0] / size[size > 0, None], logs / n[:, None]

    parts = {}
    for x in known:
        own = [k for k in range(len(texts)) if labels[k] == x]
        parts[x] = [texts[k] for k in own if k % FLOOR_SHARE == 0] or [texts[k] for k in own]
    found = {x: measure(own) for x, own in parts.items()}
    for g, x in enumerate(known):
        own, words = found[x]
        if not len(own):
            continue
        noise = [measure([shuffled(t) for t in parts[x]])[0], *(found[y][0] for y in known if y != x)]
        level = np.median(own[:, g])
        likest = max(float(np.median(r[:, g])) for r in noise if len(r))
        out[languages.index(x)] = (min((level + 3 * likest) / 4, level), words[:, g].std())
    return out


def floors(df: DataFrame, model: tuple[Pieces, list[str], np.ndarray], text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """learn_floors() on the rows that train() takes."""
    own = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    rows = bounded(own, F.col(key), sample_rows).select(text, label)
    pieces = model[0]
    return fit_in_task(rows, lambda t: learn_floors(pieces, *_in_order(t)))


def identify(df: DataFrame, model: tuple[Pieces, list[str], np.ndarray], text: str = "text", keep_text: bool = True, least: np.ndarray | None = None) -> DataFrame:
    """Adds lang_pred and score (the language's share of the text's probability, 0 to 1). Of languages of equal share, the first in the alphabet is taken.

    A null text, or one without a letter, is `und` with score 0, and so is, if `least` (of floors()) is given, one whose log probability per
    character is more than FLOOR_ERRORS standard errors of its words' mean below the language's floor. Other columns pass through; lang_pred and score are replaced. No row moves.
    """
    pieces, languages, p = model
    shared = df.sparkSession.sparkContext.broadcast((pieces, p, least))  # the vocabulary's size is fixed
    schema = out_schema(df, () if keep_text else (text,), "lang_pred string, score double")
    names = schema.names[:-2]

    def run(batches):
        own, prob, floor = shared.value
        memory = Memory(prob.shape[1])
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(text)):
                data = _LOWER[raw]
                starts, ends, rows = words_of(data, offsets)
                total, size = np.zeros((hi - lo, max(len(languages), 1))), np.ones(hi - lo)
                if len(starts):
                    logs, n = rates(own, prob, data, starts, ends, memory)
                    size = np.maximum(np.bincount(rows, n, minlength=hi - lo), 1)
                    for g in range(logs.shape[1]):
                        total[:, g] = np.bincount(rows, logs[:, g], minlength=hi - lo)
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                ascii_letters = np.bincount(rows[data[starts] < 128], minlength=hi - lo) > 0
                some = np.bincount(rows, minlength=hi - lo) > 0
                for k in np.flatnonzero(some & ~ascii_letters).tolist():
                    some[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
                some &= bool(languages)
                if floor is not None:
                    words = np.maximum(np.bincount(rows, minlength=hi - lo), 1)
                    some &= total[np.arange(hi - lo), best] / size >= floor[best, 0] - FLOOR_ERRORS * floor[best, 1] / np.sqrt(words)
                yield keep_columns(
                    batch.slice(lo, hi - lo),
                    names,
                    {
                        "lang_pred": pa.array([languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], pa.string()),
                        "score": pa.array(np.where(some, share[np.arange(hi - lo), best], 0.0)),
                    },
                )

    return map_texts(df, run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame) -> tuple[Pieces, list[str], np.ndarray]:
    import public_tokenizers

    return train(docs.where(~held_out(F.col("doc_id"))), public_tokenizers.path("piece_bpe_32k.model"))


def fitted_floors(docs: DataFrame, model: tuple[Pieces, list[str], np.ndarray]) -> np.ndarray:
    return floors(docs.where(~held_out(F.col("doc_id"))), model)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that aren't held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fitted(spark, docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
