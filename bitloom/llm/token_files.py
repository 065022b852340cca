"""Token-id files of directly addressable codes.

Each id is cut into chunks of `bits` bits, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap
with a bit per chunk telling whether the id goes on in level k+1, and a rank directory (ones before each block of 512
bits). The place of an id's next chunk is the number of ones before its bit, so any token is found by a few look-ups,
with nothing decoded around it. Files hold documents in ascending doc_id order and a manifest lists files in that order.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bitloom.llm import files
from bitloom.llm.common import UnitMemory, documents, held_by, in_order, joined_units, keep_columns, map_texts, out_schema, shared_path, text_slices

BLOCK = 512
MAGIC = b"DACIDS1\n"
#: Tokens per file at most (a single longer document gets a file of its own).
FILE_TOKENS = 1 << 22


# -- the code ------------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level; always at least one level."""
    levels, rest = [], ids.astype(np.uint32)
    kind = np.uint8 if bits <= 8 else np.uint16
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.int64) if len(rest) else np.zeros(1, np.int64)
        levels.append(((rest & np.uint32((1 << bits) - 1)).astype(kind), np.packbits(goes_on, bitorder="little"), np.append(0, np.cumsum(ones)[:-1]).astype("<u4")))
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def decode_all(levels, bits: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo .. hi-1: one run in every level, placed by rank."""
    out = np.zeros(hi - lo, np.uint32)
    at = np.arange(hi - lo)
    for k, (chunks, bitmap, ranks) in enumerate(levels):
        out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(bits * k)
        flags = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
        if not flags.any():
            return out
        at = at[flags]
        lo = rank(bitmap, ranks, lo)
        hi = lo + len(at)
    return out


def rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
    """Ones before bit i: a directory entry, the popcount of whole bytes of its block, and that of a part of a byte."""
    block, byte = i // BLOCK, i // 8
    if block >= len(ranks):
        block = len(ranks) - 1
    part = int(bitmap[byte]) & ((1 << (i % 8)) - 1) if i % 8 else 0
    return int(ranks[block]) + int(np.bitwise_count(bitmap[block * BLOCK // 8 : byte]).sum()) + part.bit_count()


def access(levels, bits: int, i: int) -> int:
    """Id i alone."""
    out = 0
    for k, (chunks, bitmap, ranks) in enumerate(levels):
        out |= int(chunks[i]) << (bits * k)
        if not int(bitmap[i // 8]) >> (i % 8) & 1:
            break
        i = rank(bitmap, ranks, i)
    return out


# -- one file --------------------------------------------------------------------------------------


def write_file(path: str, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> None:
    """Writes header, document table and levels."""
    sections = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little"),
        np.append(0, np.cumsum(counts)).astype("<i8"),
        *(part for level in encode_levels(ids, bits) for part in level),
    ]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "bits": bits, "sections": [[s.dtype.str, len(s)] for s in sections]}).encode()
    with files.open_output(path) as f:
        f.write(MAGIC + len(header).to_bytes(4, "little") + header)
        for s in sections:
            f.write(np.ascontiguousarray(s).tobytes())


class Section:
    """An array in an open file; an index or a slice reads the bytes that it covers and no others."""

    def __init__(self, source, at: int, dtype: str, n: int):
        self.source, self.at, self.dtype, self.n = source, at, np.dtype(dtype), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, key):
        if isinstance(key, slice):
            lo, hi, _ = key.indices(self.n)
            return np.frombuffer(self.source.read_at(max(hi - lo, 0) * self.dtype.itemsize, self.at + lo * self.dtype.itemsize), self.dtype)
        return np.frombuffer(self.source.read_at(self.dtype.itemsize, self.at + int(key) * self.dtype.itemsize), self.dtype)[0]


class TokenFile:
    """One file opened for reading: header and document table are read at once; token(i) and document(k) read what they need of the levels."""

    def __init__(self, path: str):
        self.source = files.open_input(path)
        head = self.source.read_at(len(MAGIC) + 4, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        at, size = len(MAGIC) + 4, int.from_bytes(head[len(MAGIC) :], "little")
        header = json.loads(self.source.read_at(size, at))
        at += size
        parts = []
        for dtype, n in header["sections"]:
            parts.append(Section(self.source, at, dtype, n))
            at += n * parts[-1].dtype.itemsize
        self.bits, self.tokens = header["bits"], header["tokens"]
        known = np.unpackbits(parts[1][:], bitorder="little")[: header["docs"]]
        self.doc_ids = [int(d) if k else None for d, k in zip(parts[0][:], known)]
        self.offsets = parts[2][:]
        self.levels = [tuple(parts[i : i + 3]) for i in range(3, len(parts), 3)]

    def __enter__(self) -> "TokenFile":
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def token(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        return access(self.levels, self.bits, i)

    def document(self, k: int) -> np.ndarray:
        return decode_all(self.levels, self.bits, int(self.offsets[k]), int(self.offsets[k + 1]))


# -- Spark data source -----------------------------------------------------------------------------

SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_le binary"


@dataclass
class _Written(WriterCommitMessage):
    entries: list


@dataclass
class _File(InputPartition):
    path: str
    start: int


class TokenIdSource(DataSource):
    """format("token_ids"): writes rows (doc_id, token_ids) and reads rows of SCHEMA; ids_le holds 4 bytes per id.

    With the option tokenizer (a file of the tokenizers library, read by the driver), it writes rows (doc_id, text) and encodes them on the
    way, so that ids don't pass between processes; end_id is then put after each text's ids.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        model = None
        if "tokenizer" in self.options:
            with open(self.options["tokenizer"], encoding="utf-8") as f:
                model = f.read()  # a file of fixed size
        return _Writer(self.options["path"], int(self.options.get("bits", 8)), model, int(self.options["end_id"]) if "end_id" in self.options else None)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, model: str | None, end_id: int | None):
        self.path, self.bits, self.model, self.end_id = path.rstrip("/"), bits, model, end_id

    def _rows(self, batch: pa.RecordBatch):
        """(doc ids, ids of all rows, number per row) of runs of rows."""
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        if self.model is None:
            lists = batch.column(batch.schema.get_field_index("token_ids"))
            yield ids.to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.array(pc.fill_null(lists.value_lengths(), 0), np.int64)
            return
        own = encoder(self.model)
        for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
            flat, sizes = own.encode_run(data, offsets, self.end_id)
            yield ids.slice(lo, hi - lo).to_pylist(), flat.astype(np.uint32), sizes

    def write(self, iterator) -> _Written:
        entries: list[dict] = []
        docs, counts, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal docs, counts, held, size
            if docs:
                name = f"part-{uuid.uuid4().hex}.dac"
                write_file(f"{self.path}/{name}", docs, np.array(counts, np.int64), np.concatenate(held), self.bits)
                known = [d for d in docs if d is not None]
                entries.append({"name": name, "nulls": len(docs) - len(known), "first": known[0] if known else None, "docs": len(docs), "tokens": size, "order": len(entries)})
            docs, counts, held, size = [], [], [], 0

        for ids, flat, sizes in (x for batch in iterator for x in self._rows(batch)):
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(ids):
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + FILE_TOKENS - size, "right")))
                docs += ids[lo:hi]
                counts += sizes[lo:hi].tolist()
                held.append(flat[base : int(ends[hi - 1])])
                size += int(ends[hi - 1]) - base
                lo = hi
                if size >= FILE_TOKENS or lo < len(ids):
                    flush()
        flush()
        return _Written(entries)

    def commit(self, messages) -> None:
        found = [(m.entries[0]["first"] if m.entries[0]["first"] is not None else -(2**63), -m.entries[0]["nulls"], i, m.entries) for i, m in enumerate(messages) if m is not None and m.entries]
        entries = [e for *_, own in sorted(found, key=lambda x: x[:3]) for e in own]
        start = 0
        for e in entries:
            e["start"] = start
            start += e["tokens"]
        files.write_manifest(self.path, entries)

    def abort(self, messages) -> None:
        files.delete([f"{self.path}/{e['name']}" for m in messages if m is not None for e in m.entries])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        return [_File(f"{self.path}/{e['name']}", e["start"]) for e in files.read_manifest(self.path)] or [_File("", 0)]

    def read(self, partition: _File):
        if not partition.path:
            return
        with TokenFile(partition.path) as f:
            for lo in range(0, len(f.doc_ids), 256):
                hi = min(lo + 256, len(f.doc_ids))
                starts = f.offsets[lo : hi + 1]
                flat = decode_all(f.levels, f.bits, int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                cut = ((starts - starts[0]) * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.doc_ids[lo:hi], pa.int64()),
                        pa.array(starts[:-1] + partition.start, pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array([flat[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_le"],
                )


# -- encoding with the tokenizers library --------------------------------------------------------------


def _plain_byte_level(model: dict) -> bool:
    """Whether the usual byte-level pattern alone cuts texts, so that units can be encoded apart; added tokens may be in the texts."""
    cutter, added = model.get("pre_tokenizer") or {}, model.get("added_tokens") or []
    simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].isascii() and not any(c.isspace() for c in t["content"]) for t in added)
    return simple and model.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)


class LibraryEncoder:
    """The tokenizers library over distinct units: most go to it as one string, cut by byte length after.

    Strings of added tokens in a text (such as an end mark) get those tokens' ids, as the library's own call gives them. With a tokenizer that isn't plain
    byte-level, texts go to the library whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        size = self.tokenizer.get_vocab_size()
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        own = json.loads(model)
        self.apart = not _plain_byte_level(own)
        self.memory = UnitMemory(self.encode_units, cuts=not self.apart, whole=tuple(t["content"].encode() for t in own.get("added_tokens") or []))

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.apart:
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            return np.concatenate(found), np.array([len(e) for e in found], np.int64)
        held, flags, apart = joined_units(units)
        run = "".join(held)
        first, *rest = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([run, *apart], add_special_tokens=False)]
        raw = np.frombuffer(run.encode(), np.uint8)
        starts = np.flatnonzero((raw == 0x20) | (raw == 0x0A))  # of the units, which have one of these each, as their first character
        widths = self.widths[first]
        at = np.searchsorted(np.cumsum(widths) - widths, starts)
        fed = raw[starts] == 0x0A
        counts = np.diff(np.append(at, len(first))) - fed
        counts = np.concatenate([counts, [len(e) for e in rest]]).astype(np.int64)
        return in_order(flags, np.concatenate([np.delete(first, at[fed]), *rest]), counts)


    def encode_run(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a run of texts, each followed by end_id if there is one; number per text)."""
        ids, counts = self.memory.encode_run(data, offsets)
        return (ids, counts) if end_id is None else (np.insert(ids, np.cumsum(counts), end_id), counts + 1)


def encoder(model: str) -> LibraryEncoder:
    """The worker's encoder for a model; later tasks find it filled."""
    encoders = held_by("token_files")
    if model not in encoders:
        encoders.clear()
        encoders[model] = LibraryEncoder(model)
    return encoders[model]


def encode(df: DataFrame, tokenizer_path: str, end_id: int | None = None, text: str = "text", out: str = "token_ids", keep_text: bool = False) -> DataFrame:
    """Adds each text's ids (array<int>) by the tokenizers library, followed by end_id if one is given.

    Null and empty texts have end_id alone. Other columns pass through; one named like `out` is replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size
    schema = out_schema(df, () if keep_text else (text,), f"`{out}` array<int>")
    names = schema.names[:-1]

    def run(batches):
        own = encoder(model.value)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                ids, counts = own.encode_run(data, offsets, end_id)
                yield keep_columns(batch.slice(lo, hi - lo), names, {out: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))})

    return map_texts(df, run, schema, "token_files")


def write(df: DataFrame, path: str, bits: int = 8) -> None:
    """Writes (doc_id, token_ids), whose partitions must hold ascending ranges of doc_id, as in `ordered`."""
    df.sparkSession.dataSource.register(TokenIdSource)
    df.select("doc_id", F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids")).write.format("token_ids").mode("append").option("bits", bits).save(path)


def write_texts(df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, bits: int = 8) -> None:
    """Writes the ids of (doc_id, text), as `encode` and `write` would; null and empty texts have end_id alone."""
    df.sparkSession.dataSource.register(TokenIdSource)
    out = df.select("doc_id", "text").write.format("token_ids").mode("append").option("bits", bits).option("tokenizer", tokenizer_path)
    (out if end_id is None else out.option("end_id", end_id)).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA: start counts the ids of all documents before."""
    spark.dataSource.register(TokenIdSource)
    return spark.read.format("token_ids").load(path)


def ordered(df: DataFrame) -> DataFrame:
    """df ranged and sorted by doc_id (nulls first); rows that share an id by their text, so that equal input has equal places."""
    return df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes them in doc_id order as directly addressable codes and reads the files back."""
    import public_tokenizers

    path = shared_path(spark, "token-ids")
    write_texts(ordered(documents(spark, sf_dir, "doc_id", "text")), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
