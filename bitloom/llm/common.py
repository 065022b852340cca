"""Helpers that several operators share: shared folders, Arrow text access, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        at = sc.getCheckpointDir()
        if not at:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="bitloom-"))
            at = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of an Arrow batch of texts at most (a longer text is a batch of its own).
BATCH_BYTES = 8 << 20


#: What operators keep in a Python worker between its tasks, by operator.
HELD: dict[str, dict] = {}


def held_by(operator: str | None) -> dict:
    """What the operator keeps in this worker; what others kept is let go, as workers serve one operator after another."""
    for other in [k for k in HELD if k != operator]:
        del HELD[other]
    return HELD.setdefault(operator, {}) if operator else {}


def map_texts(df: DataFrame, run, schema, operator: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of BATCH_BYTES: the session's own bound is lowered if it is above. operator: whose `held_by` the tasks use."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(key).removesuffix("b").isdigit() or int(conf.get(key).removesuffix("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def task(batches):
        held_by(operator)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ["*"]))


def lower_ascii(col):
    """A-Z to lower case, other characters untouched."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(col, n: int):
    """crc32 of the value's text, modulo n."""
    return F.crc32(col.cast("string")) % n


def free_name(name: str, *dfs: DataFrame) -> str:
    """name, or name with underscores before it if any of dfs has a column of that name (in either case of letters)."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# -- bytes of an Arrow text column -------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_rng.integers(2**40, 2**62)) * 8 + 5) % 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64, raised to 0 .. n-1."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.repeat(np.array([b], np.uint64), size - 1))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about `limit` bytes; a row is never cut. Null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of lower-cased texts: start, end, row of each, and n per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        power, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables (sums, inverse powers): the hash of data[a:b] is mix((sums[b] - sums[a]) * inverse[a])."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def hash_bytes(values: list[bytes]) -> np.ndarray:
    """The same hash for a list of byte strings."""
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    starts = ends - np.array([len(v) for v in values], np.int64)
    sums, inverse = prefix_hash(data)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def out_schema(df: DataFrame, drop: tuple[str, ...], add: str):
    """df's schema without `drop`, followed by the fields of the DDL string `add` (a field of the same name is replaced)."""
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(add)
    gone = {*drop, *new.names}
    return T.StructType([f for f in df.schema.fields if f.name not in gone] + new.fields)


def keep_columns(batch: pa.RecordBatch, names: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of batch, then the extra ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(extra.values()), names=names + list(extra))


# -- token ids of texts through a memory of repeated pieces -------------------------------------


def _bytes(*values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


#: White space and what some libraries take for it; no cut is made next to these.
_ODD_SPACE = _bytes(*range(0x09, 0x0E), *range(0x1C, 0x21))
#: First bytes of the characters among which the other white space is.
_WIDE_LEAD = _bytes(0xC2, 0xE1, 0xE2, 0xE3)
_PUNCTUATION = _bytes(*(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
_LETTER = _bytes(*(c for c in range(0x41, 0x7B) if chr(c).isalpha()))
#: Second bytes of letters after 0xC3 (all but the multiplication and division signs).
_LATIN_LETTER = _bytes(*(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)))


def unit_offsets(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Ascending places that cut the texts into units, text borders among them; none lies inside one of the strings `whole`.

    Cuts are before each single space or line feed that stands between two characters that aren't white space, after such a line feed, and
    between a Latin letter and ASCII punctuation. No match of the usual byte-level pre-tokenizer pattern (words, numbers or other
    characters with a space before them, contractions, white space) runs across such a place, so units can be encoded apart.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(3, np.uint8), data])  # before[i + 3 - k] is the byte k before i
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~edge[at] & ~edge[at + 1]]
    after = data[at + 1]
    odd = _ODD_SPACE[before[at + 2]] | _ODD_SPACE[after] | _WIDE_LEAD[after] | (before[at + 1] == 0xC2) | (_WIDE_LEAD[before[at]] & (before[at] != 0xC2))
    at = at[~odd]
    edge[at] = True
    edge[at[data[at] == 0x0A] + 1] = True
    marks = np.flatnonzero(_PUNCTUATION[data])
    last = before[marks + 2]
    edge[marks[_LETTER[last] | (_LATIN_LETTER[last] & (before[marks + 1] == 0xC3))]] = True
    if whole:
        raw, border = data.tobytes(), np.zeros(len(edge), bool)
        border[offsets] = True
        for w in whole:
            at = raw.find(w)
            while at >= 0:
                edge[at + 1 : at + len(w)] &= border[at + 1 : at + len(w)]
                at = raw.find(w, at + 1)
    return np.flatnonzero(edge)


class Numbering(dict):
    """Numbers its keys 0, 1, 2, ... in the order of first look-up; `new` lists the keys numbered since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at

    def all(self, keys, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, n)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[s : s + c] of each start and count, in a row."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def group_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes (0 for an empty one)."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


class UnitMemory:
    """Ids of texts, each distinct unit being encoded once while it is remembered.

    encode_units(list of units) -> (all their ids, number per unit). When more than `bound` units or eight times as many ids
    are held, the rarely used ones are forgotten; results don't depend on that. Without `cuts`, a unit is a whole text; strings in `whole` are never cut.
    """

    def __init__(self, encode_units, bound: int = 200_000, cuts: bool = True, whole: tuple[bytes, ...] = ()):
        self.encode_units, self.bound, self.cuts, self.whole = encode_units, bound, cuts, whole
        self.known = Numbering()
        self.ids = np.empty(0, np.int32)
        self.starts, self.counts, self.uses = (np.empty(0, np.int32) for _ in range(3))

    def forget(self) -> None:
        """Keeps the most used units, a third at most."""
        least = max(3, int(np.partition(self.uses, -len(self.uses) // 3)[-len(self.uses) // 3]) + 1)
        keep = self.uses >= least
        known = Numbering()
        known.update((u, i) for i, u in enumerate(u for u, k in zip(self.known, keep.tolist()) if k))
        self.ids = gather(self.ids, self.starts[keep], self.counts[keep])
        self.known, self.counts = known, self.counts[keep]
        self.starts = (np.cumsum(self.counts) - self.counts).astype(np.int32)
        self.uses = np.ones(len(self.counts), np.int32)

    def _learn(self) -> None:
        """Encodes the new keys."""
        new = self.known.new
        ids, counts = self.encode_units([u.decode() for u in new])
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.known.new = []

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text) of a run as text_slices gives it."""
        if len(self.known) > self.bound or len(self.ids) > 8 * self.bound:
            self.forget()
        cuts = unit_offsets(data, offsets, self.whole) if self.cuts else np.unique(offsets)
        n = len(cuts) - 1
        found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        own = found.indices.to_numpy(zero_copy_only=False)
        at = self.known.all(distinct, len(distinct))
        if self.known.new:
            self._learn()
        self.uses[at] += np.bincount(own, minlength=len(distinct)).astype(np.int32)
        counts = self.counts[at][own]
        return gather(self.ids, self.starts[at][own], counts), group_sums(counts, np.diff(np.searchsorted(cuts, offsets)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same of a list of texts; null has no ids."""
        runs = [self.encode_run(data, offsets) for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()))]
        return tuple(np.concatenate(x) for x in zip(*runs)) if runs else (np.empty(0, np.int32), np.empty(0, np.int64))


def joined_units(units: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
    """(units that can be encoded as one string, flags of those, the other units).

    A unit whose only white space is a space in front is taken as it is; one without white space gets a line feed in front. Where the units
    begin stays a place that no pre-token runs across, and the line feed is a pre-token.
    """
    held, flags, apart = [], [], []
    for u in units:
        if not u:
            flags.append(False)
            apart.append(u)
            continue
        body = u[1:] if u[0] == " " else u
        flags.append(joins := body.split() == [body])
        if joins:
            held.append(u if u[0] == " " else "\n" + u)
        else:
            apart.append(u)
    return held, np.array(flags, bool), apart


def in_order(flags: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of joined units and then the others, put back in the units' order."""
    back = np.empty(len(flags), np.int64)
    back[np.argsort(~flags, kind="stable")] = np.arange(len(flags))
    return gather(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]
