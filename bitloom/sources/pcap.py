"""Packet captures: format("pcap") reads and writes capture files; packet layers are column expressions."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bitloom.functions.binary import uint

SCHEMA = "file string, packet bigint, ts timestamp, original_length bigint, data binary"
#: Magic numbers of microsecond and nanosecond captures (fixed values).
MICRO, NANO = 0xA1B2C3D4, 0xA1B23C4D


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class PcapSource(DataSource):
    """Options: path, a capture file or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        system, at = _resolve(self.path)
        if system.get_file_info(at).type == fs.FileType.File:
            return [_File(self.path)]
        found = system.get_file_info(fs.FileSelector(at))
        return [_File(f"{self.path.rstrip('/')}/{i.base_name}") for i in found if i.base_name.endswith(".pcap")] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, at = _resolve(partition.path)
        with system.open_input_file(at) as f:
            head = f.read(24)
            order = next((o for o in "<>" if len(head) == 24 and struct.unpack(o + "I", head[:4])[0] in (MICRO, NANO)), None)
            if order is None:
                raise ValueError(f"{partition.path} is no packet capture")
            unit = 1e-9 if struct.unpack(order + "I", head[:4])[0] == NANO else 1e-6
            number = 0
            while len(head := f.read(16)) == 16:
                seconds, part, kept, length = struct.unpack(order + "4I", head)
                data = f.read(kept)
                if len(data) < kept:
                    raise ValueError(f"{partition.path} ends within packet {number}")
                carry, micros = divmod(int(part * unit * 1e6 + 0.5), 1_000_000)
                yield partition.path, number, datetime.fromtimestamp(seconds + carry, timezone.utc).replace(microsecond=micros), length, data
                number += 1


class _Writer(DataSourceArrowWriter):
    """A capture file per task; columns ts and data."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        system, at = _resolve(self.path)
        system.create_dir(at, recursive=True)
        name, out = f"{at}/part-{uuid.uuid4().hex}", None
        for batch in iterator:
            out = out or system.open_output_stream(name)
            if out.tell() == 0:
                out.write(struct.pack("<IHHiIII", MICRO, 2, 4, 0, 0, 65535, 1))
            micros = batch.column(batch.schema.get_field_index("ts")).cast(pa.int64()).to_pylist()
            for t, data in zip(micros, batch.column(batch.schema.get_field_index("data")).to_pylist()):
                out.write(struct.pack("<4I", t // 1_000_000, t % 1_000_000, len(data), len(data)) + data)
        if out is not None:
            out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages) -> None:
        system, _ = _resolve(self.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, m.path + ".pcap")

    def abort(self, messages) -> None:
        system, _ = _resolve(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


def udp_frame(payload: Column, source: int = 0x7F000001, target: int = 0x7F000001, port: int = 8600) -> Column:
    """Ethernet, IPv4 and UDP headers around a payload of up to 65,507 bytes (checksum of the IP header filled in)."""
    from bitloom.operators.layers import ipv4_checksum

    n = F.octet_length(payload)
    two = lambda x: F.unhex(F.lpad(F.hex(x), 4, "0"))
    addresses = F.lit(struct.pack(">II", source, target))
    before = F.concat(F.lit(b"\x45\x00"), two(n + 28), F.lit(b"\x00\x00\x00\x00\x40\x11"))
    check = two(ipv4_checksum(F.concat(before, F.lit(b"\x00\x00"), addresses)))
    return F.concat(F.lit(b"\x00" * 12 + b"\x08\x00"), before, check, addresses, F.lit(struct.pack(">HH", port, port)), two(n + 8), F.lit(b"\x00\x00"), payload)


def udp_payload(frame: Column) -> Column:
    """Payload of a UDP packet over IPv4 in an Ethernet frame (with a VLAN tag or without); null for other frames."""
    tag = F.when(uint(frame, 12, 2) == 0x8100, 4).otherwise(0)
    head = uint(frame, 14 + tag, 1).bitwiseAND(F.lit(15)).cast("int") * 4
    at = tag + 14 + head
    size = uint(frame, at + 4, 2).cast("int")
    udp = (uint(frame, 12 + tag, 2) == 0x0800) & (uint(frame, 23 + tag, 1) == 17)
    return F.when(udp, F.substring(frame, at + 9, size - 8))


def blocks(df: DataFrame, data: str, out: str = "block") -> DataFrame:
    """A row per block of (category byte, big-endian length of the whole block, content); a last one that is cut short ends the packet."""

    at = df.columns.index(data)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, raw in enumerate(batch.column(at).to_pylist()):
                place = 0
                while raw and place + 3 <= len(raw):
                    size = int.from_bytes(raw[place + 1 : place + 3], "big")
                    if size < 3 or place + size > len(raw):
                        break
                    rows.append(k)
                    found.append({"category": raw[place], "content": raw[place + 3 : place + size]})
                    place += size
            kept = batch.take(pa.array(rows, pa.int64()))
            column = pa.array(found, pa.struct([("category", pa.int32()), ("content", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*kept.columns, column], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"{out} struct<category:int,content:binary>").fields]))
