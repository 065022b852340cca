"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a run form one linked list of byte runs; pairs across a pre-token's end never merge. Every
mergeable pair waits in the bucket of its merge rank, as its position in the list. A bitmap of non-empty buckets
with summary levels above it gives the lowest rank by find-first-set. A bucket's positions are merged in one numpy
step, leftmost first where they overlap; positions whose pair has changed since they were filed are stale and
skipped. The work is near linear in the bytes, so a pre-token of any length costs no more than many short ones.
"""

from __future__ import annotations

import base64
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import Numbering, UnitMemory, documents, gather, group_sums, held_by, in_order, joined_units, keep_columns, map_texts, out_schema, text_slices


#: Pre-token patterns whose matches never run across the cuts of `common.unit_offsets` (fixed values); texts under another pattern stay whole.
CUT_PATTERNS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})


class RankQueue:
    """Positions by rank: push() files an array of them, pop() hands out the lowest rank's bucket.

    Three levels of 64-bit words: `words` has a bit per rank, `groups` a bit per non-empty word, `top` one per group.
    """

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.words: dict[int, int] = {}
        self.groups: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        word, group = rank >> 6, rank >> 12
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 63)
        self.groups[group] = self.groups.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Files each position under its rank; a rank below 0 files nothing."""
        if (ranks < 0).any():
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
        elif len(ranks):
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lows = [0, *cuts.tolist()]
            for rank, lo, hi in zip(ranks[lows].tolist(), lows, [*lows[1:], len(ranks)]):
                self.push(rank, positions[lo:hi])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.groups[group] &= ~(1 << (word & 63))
            if not self.groups[group]:
                self.top &= ~(1 << group)
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class Codec:
    """Encoder and decoder for one table of ranks (token bytes -> id, which is also its merge rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        compiled = regex.compile(pattern)
        self.find = lambda text: [m[0] for m in compiled.finditer(text)] if compiled.groups else compiled.findall(text)
        self.apart = pattern not in CUT_PATTERNS
        self.widths = np.full(max(ranks.values()) + 1, -1, np.int64)
        by_id = sorted((i, t) for t, i in ranks.items())
        self.widths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.flat = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.at = np.cumsum(np.maximum(self.widths, 0)) - np.maximum(self.widths, 0)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        left, right = self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF
        #: Ranks whose merge can open a pair of lower rank; those are merged one at a time in each pre-token.
        self.careful = set(left[self.pair_ranks < left].tolist()) | set(right[self.pair_ranks < right].tolist())
        # Whole pre-tokens that are tokens are taken as they are; where merges reach the same, this changes nothing.
        self.whole = {t.decode("utf-8", "ignore"): i for t, i in ranks.items() if t.decode("utf-8", "ignore").encode() == t}
        self.memory = UnitMemory(self.encode_units, cuts=not self.apart)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, or -1; an id below 0 stands for the end of a pre-token."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of ids of each)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = int(sizes.sum())
        ids = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n  # position n ends every pre-token
        before[(ends - sizes)[sizes > 0]] = n
        waiting = np.append(self._rank(ids[:n], ids[after[:n]]), -1)
        queue = RankQueue()
        queue.push_all(waiting[:n], np.arange(n))
        while (best := queue.pop()) is not None:
            rank, at = best
            at = at[waiting[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                if rank in self.careful:
                    _, first = np.unique(owner[at], return_index=True)
                    if len(first) < len(at):
                        queue.push(rank, np.delete(at, first))
                        at = at[first]
                elif (joined := after[at[:-1]] == at[1:]).any():  # as in "aaa": every second one of a run
                    index = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.append(False, joined), 0, index))
                    at = at[(index - start) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            ids[at] = rank
            after[at] = follow
            before[follow] = at
            waiting[gone] = -1
            ids[gone] = -2
            near = before[at]
            near = near[near < n]
            touched = np.concatenate([at, near[waiting[near] != -3]])
            ranks = self._rank(ids[touched], ids[after[touched]])
            waiting[touched] = ranks
            queue.push_all(ranks, touched)
        alive = ids[:n] >= 0
        return ids[:n][alive], np.bincount(owner[alive], minlength=len(pieces))

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, by pre-token. Most units are searched for pre-tokens as one string, unless the pattern is an unknown one."""
        held, flags, apart = ([], np.zeros(len(units), bool), units) if self.apart else joined_units(units)
        found, more = self.find("".join(held)), [self.find(u) for u in apart]
        ends = np.cumsum([len(u) for u in held], dtype=np.int64)
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends, "right")
        first = np.append(0, last)[:-1].astype(np.int64)
        fed = np.array([u[0] == "\n" for u in held], bool)
        n = np.concatenate([last - first - fed, [len(f) for f in more]]).astype(np.int64)
        numbers = Numbering()
        at = np.delete(numbers.all(chain(found, chain.from_iterable(more)), len(found) + sum(map(len, more))), first[fed])
        pieces = numbers.new
        ids, counts = self.merge([b"" if p in self.whole else p.encode() for p in pieces])
        starts = np.cumsum(counts) - counts
        whole = np.array([self.whole.get(p, -1) for p in pieces], np.int64)
        starts = np.where(whole >= 0, len(ids) + np.arange(len(whole)), starts)
        counts = np.where(whole >= 0, 1, counts)
        ids = np.concatenate([ids, whole])
        return in_order(flags, gather(ids, starts[at], counts[at]), group_sums(counts[at], n))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        return self.memory.encode(texts)

    def decode_run(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Bytes of each run of ids, as a binary array."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.widths) and self.widths[ids].min() >= 0):
            raise ValueError("an id stands for no token")
        widths = self.widths[ids]
        offsets = np.append(0, np.cumsum(group_sums(widths, counts)))
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(gather(self.flat, self.at[ids], widths))]).cast(pa.binary())

    def decode(self, ids: list[int] | None) -> bytes:
        return self.decode_run(np.array(ids or [], np.int64), np.array([len(ids or ())], np.int64))[0].as_py()


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: base64 of the token's bytes, a space, its id, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _codec(spark: SparkSession, path: str, pattern: str):
    """A function that gives the worker's codec; later tasks of the call find it filled. The rank file's size is fixed, so it is broadcast."""
    shared, key = spark.sparkContext.broadcast(load_ranks(path)), (uuid.uuid4().hex, pattern)

    def get() -> Codec:
        codecs = held_by("bpe")
        if key not in codecs:
            codecs.clear()
            codecs[key] = Codec(shared.value, pattern)
        return codecs[key]

    return get


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """Adds the ids of each text as array<int>; with `decoded`, also a column of that name with the bytes that these ids decode to.

    With a pattern that isn't in CUT_PATTERNS, texts are searched for pre-tokens whole, and what the pattern doesn't match has no ids. Null and empty texts
    give an empty array; other columns pass through whatever they hold, except that a column named like `out` is replaced. Rows aren't moved between partitions, so ties and repeated rows stay as they are.
    """
    get = _codec(df.sparkSession, ranks_path, pattern)
    schema = out_schema(df, () if keep_text else (text,), f"`{out}` array<int>" + (f", `{decoded}` binary" if decoded else ""))
    names = [n for n in schema.names if n not in (out, decoded)]

    def run(batches):
        codec = get()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                ids, counts = codec.memory.encode_run(data, offsets)
                new = {out: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids.astype(np.int32)))}
                yield keep_columns(batch.slice(lo, hi - lo), names, new | ({decoded: codec.decode_run(ids, counts)} if decoded else {}))

    return map_texts(df, run, schema, "bpe")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (binary; a null array gives no bytes). An unknown id is an error."""
    get = _codec(df.sparkSession, ranks_path, pattern)
    schema = out_schema(df, (), f"`{out}` binary")
    names = schema.names[:-1]

    def run(batches):
        codec = get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                lists = part.column(ids)
                counts = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                yield keep_columns(part, names, {out: codec.decode_run(np.array(lists.flatten(), np.int64), counts)})

    return map_texts(df, run, schema, "bpe")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of both directions."""
    import public_tokenizers

    at, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(documents(spark, sf_dir, "doc_id", "text"), at, pattern, keep_text=False, decoded="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
