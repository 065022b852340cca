"""Secret scans: three fixed patterns, and format likelihood under inferred automata for every other candidate.

Candidates are all maximal runs of characters of [A-Za-z0-9+/_.=-], whatever their length and make-up; where base spans lie in a
run, what is left of it beside and between them, without separators at the cut. A candidate is added where the automaton of some
credential format leads the one of ordinary strings by MARGIN nats a character and EVIDENCE nats in all. The formats are learned from
labelled credentials: the values of the base spans in a bounded sample of the corpus, by kind, beside examples of public
formats made by rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.automata import Scorer, labelled_samples, train, with_labelled
from bitloom.llm.common import documents, free_name, keep_columns, map_texts, mix, out_schema, prefix_hash, text_slices
from bitloom.llm.sample import bounded, fit_in_task

#: Fixed patterns, on UTF-8 bytes; ASCII letters of the assignment's keyword in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "grammar")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Least lead over ordinary strings, in nats a character and in all (the odds against a secret among the runs of a corpus).
MARGIN, EVIDENCE = 1.5, 30.0
#: Texts that labelled credentials are taken from, at most twice as many.
SAMPLE_ROWS = 6000
#: What parts a piece of a run from the base span beside it.
SEPARATORS = b"+/_.=-"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of `least` or more bytes of a kind, none across a row's end."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def places(data: bytes, needle: bytes) -> list[int]:
    found, at = [], data.find(needle)
    while at >= 0:
        found.append(at)
        at = data.find(needle, at + 1)
    return found


def _outside(lo: int, hi: int, spans: list[tuple]) -> list[tuple[int, int]]:
    """The parts of lo to hi that no span covers. Spans are in descending order; the last ones are taken off as far as they end before lo."""
    while spans and spans[-1][1] <= lo:
        spans.pop()
    out = []
    for s, e in reversed(spans):
        if s >= hi:
            break
        if e > lo:
            if s > lo:
                out.append((lo, s))
            lo = e
    return [*out, (lo, hi)] if lo < hi else out


def base_spans(data: np.ndarray, raw: bytes, offsets: np.ndarray) -> dict[int, list[tuple]]:
    """Spans of the fixed patterns by row: (start, kind's number, end, "", None), in bytes."""
    low = raw.lower()
    rows: dict[int, list[tuple]] = {}
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    for k in set(row_of(np.array([p for h in _HINTS for p in places(low, h)], np.int64)).tolist()):
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        own = [(m.start() + lo, 0, m.end() + lo, "", None) for m in ASSIGN.finditer(raw[lo:hi]) if len(m[2]) >= MIN_ASSIGN]
        if own:
            rows.setdefault(k, []).extend(own)
    for k in set(row_of(np.array(places(raw, b"AKIA"), np.int64)).tolist()):
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        own = [(m.start() + lo, 1, m.end() + lo, "", None) for m in ACCESS.finditer(raw[lo:hi]) if len(m[0]) >= MIN_ACCESS]
        if own:
            rows.setdefault(k, []).extend(own)
    starts, ends = runs(data, offsets, _HEX, MIN_HEX)
    for k, a, b in zip(row_of(starts).tolist(), starts.tolist(), ends.tolist()):
        rows.setdefault(k, []).append((a, 2, b, "", None))
    return rows


def labelled(texts: list[str | None]) -> dict[str, list[str]]:
    """Values of the base spans in texts, by kind."""
    out: dict[str, list[str]] = {k: [] for k in KINDS[:3]}
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        raw = data.tobytes()
        for spans in base_spans(data, raw, offsets).values():
            for a, n, b, *_ in spans:
                value = ASSIGN.match(raw[a:b])[2] if n == 0 else raw[a:b]
                if n or (re.search(b"[0-9]", value) and re.search(b"[A-Za-z]", value)):  # a word after "token:" is no credential
                    out[KINDS[n]].append(value.decode())
    return out


def learn(df: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """Samples for the automata: public formats, and the labelled credentials of about SAMPLE_ROWS texts of df, chosen by a hash of the text."""
    rows = bounded(df.where(F.col(text).isNotNull()).select(text), F.col(text), SAMPLE_ROWS)
    return with_labelled(labelled_samples(), fit_in_task(rows, lambda t: labelled(t.column(0).to_pylist())))


def candidates(data: np.ndarray, raw: bytes, offsets: np.ndarray, base: dict[int, list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of all runs of a secret's characters, base spans cut out."""
    starts, ends = runs(data, offsets, _RUN, 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    more: list[tuple[int, int, int]] = []
    if base:
        touched = np.isin(rows, list(base))
        spans = {k: sorted(((a, b) for a, _, b, *_ in own), reverse=True) for k, own in base.items()}
        for k, lo, hi in zip(rows[touched].tolist(), starts[touched].tolist(), ends[touched].tolist()):
            for a, b in _outside(lo, hi, spans[k]):
                text = raw[a:b]
                if a > lo:
                    text = text.lstrip(SEPARATORS)
                    a = b - len(text)
                more.append((a, a + len(text.rstrip(SEPARATORS if b < hi else b".=")), k))
        starts, ends, rows = starts[~touched], ends[~touched], rows[~touched]
    while (dot := (ends > starts) & ((data[ends - 1] == 0x2E) | (data[ends - 1] == 0x3D))).any():  # the sentence's, or padding
        ends = ends - dot
    if more:
        starts, ends, rows = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((starts, ends, rows), zip(*more)))
    some = ends > starts
    return starts[some], ends[some], rows[some]


def scan(data: np.ndarray, offsets: np.ndarray, scorer: Scorer) -> dict[int, list[tuple]]:
    """Spans by row: (start, kind's number, end, format, score), in code points, sorted."""
    raw = data.tobytes()
    rows = base_spans(data, raw, offsets)
    starts, ends, owners = candidates(data, raw, offsets, rows)
    if len(starts):
        sums, inverse = prefix_hash(data)
        _, first, same = np.unique(mix((sums[ends] - sums[starts]) * inverse[starts]), return_index=True, return_inverse=True)  # equal runs are scored once
        logs = scorer.log_probs(data, starts[first], ends[first])
        plain = scorer.kinds.index("plain")
        lead = logs - logs[:, plain : plain + 1]
        lead[:, plain] = -np.inf
        best = lead.argmax(1)
        lead = lead[np.arange(len(first)), best]
        secret = (lead >= MARGIN * (ends - starts)[first]) & (lead >= EVIDENCE)
        for i in np.flatnonzero(secret[same]).tolist():
            a, b, k = int(starts[i]), int(ends[i]), same[i]
            rows.setdefault(int(owners[i]), []).append((a, 3, b, scorer.kinds[best[k]], float(lead[k]) / (b - a)))
    out = {}
    for k, spans in rows.items():
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        points = np.append(0, np.cumsum((data[lo:hi] & 0xC0) != 0x80))
        out[k] = sorted((int(points[a - lo]), n, int(points[b - lo]), f, s) for a, n, b, f, s in spans)
    return out


_SPAN = "array<struct<kind:string,start:int,end:int,format:string,score:double>>"


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", samples: dict[str, list[str]] | None = None, keep_text: bool = True) -> DataFrame:
    """Adds the secrets of each text, sorted by start and kind: assign, access and hex from the fixed patterns, and
    grammar, with the format and its lead, from the automata. Starts and ends are code points, the end exclusive.

    samples: strings by format, "plain" among them; without, those of learn(df). Null and empty texts have none; a very long run is a candidate like any other,
    and repeated rows have equal spans. Other columns pass through; one named like `out` is replaced. No row moves.
    """
    models = df.sparkSession.sparkContext.broadcast(Scorer(train(samples or learn(df, text))))  # a few hundred states
    schema = out_schema(df, () if keep_text else (text,), f"`{out}` {_SPAN}")
    names = schema.names[:-1]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("format", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                found = scan(data, offsets, models.value)
                spans = [[{"kind": KINDS[n], "start": a, "end": b, "format": f or None, "score": s} for a, n, b, f, s in found.get(k, ())] for k in range(hi - lo)]
                yield keep_columns(batch.slice(lo, hi - lo), names, {out: pa.array(spans, kind)})

    return map_texts(df, run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", samples: dict[str, list[str]] | None = None) -> DataFrame:
    """df with every secret in its texts replaced by the mark; overlapping secrets count as one. Null stays null."""
    spans = free_name("_secrets", df)
    found = find_secrets(df, text, spans, samples)
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["to"], F.concat(a["done"], F.substring(F.col(text), a["to"] + 1, s["start"] - a["to"]), F.lit(mark))).otherwise(a["done"]).alias("done"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
        lambda a: F.concat(a["done"], F.substring(F.col(text), a["to"] + 1, F.length(text))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, merged).otherwise(F.col(text))).select(df.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    found = find_secrets(documents(spark, sf_dir, "doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_joined(F.filter("secrets", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
