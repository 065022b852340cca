"""WARC archives as a PySpark data source.

Reading plans partitions of whole files from the folder's manifest, takes filters on record type and header columns
from Spark, parses a record's header block first, and jumps over the payload by Content-Length unless the record is
wanted and a payload column is selected. Writing gives each task attempt files of its own, which count
once the driver's manifest names them.
"""

from __future__ import annotations

import gzip
import io
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from bitloom.llm import files
from bitloom.llm.common import shared_path

VERSION = b"WARC/1.1\r\n"
#: Columns of a read: column, WARC header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "payload_length": "X-Payload-Length",
}
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in HEADERS] + [T.StructField("content_length", T.LongType()), T.StructField("payload", T.BinaryType())])
#: Bytes after which a writer begins another file.
FILE_BYTES = 256 << 20
#: Revisit profile of the WARC 1.1 standard (a fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(values: dict[str, str | None], payload: bytes) -> bytes:
    """One record; a header value of None is left out, line ends in values become spaces."""
    lines = [f"{HEADERS[c]}: {v.replace('\r', ' ').replace('\n', ' ')}" for c, v in values.items() if v is not None]
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    return VERSION + "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def read_headers(stream) -> dict[str, str] | None:
    """Header block at the stream's place, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


@dataclass
class _Written(WriterCommitMessage):
    entries: list


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class Wanted:
    """Tests of header columns that a record must pass before its payload is looked at."""

    allowed: dict[str, list[set]] = field(default_factory=dict)
    prefixes: list[tuple[str, str]] = field(default_factory=list)
    present: list[tuple[str, bool]] = field(default_factory=list)

    def take(self, f) -> bool:
        """Takes the filter over if it is on a header column; False leaves it to Spark."""
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in HEADERS:
            return False
        if isinstance(f, EqualTo) or (isinstance(f, EqualNullSafe) and f.value is not None):
            self.allowed.setdefault(column[0], []).append({f.value})
        elif isinstance(f, In):
            self.allowed.setdefault(column[0], []).append({v for v in f.value if v is not None})
        elif isinstance(f, StringStartsWith):
            self.prefixes.append((column[0], f.value))
        elif isinstance(f, (IsNotNull, IsNull)):
            self.present.append((column[0], isinstance(f, IsNotNull)))
        else:
            return False
        return True

    def passes(self, row: dict[str, str | None]) -> bool:
        return (
            all((row[c] is not None) == there for c, there in self.present)
            and all(row[c] in s for c, sets in self.allowed.items() for s in sets)
            and all(row[c] is not None and row[c].startswith(p) for c, p in self.prefixes)
        )


class WarcSource(DataSource):
    """format("warc"). Write options: path, gzip (one member a record). The read schema may be any part of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("gzip", "false").lower() == "true")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, zipped: bool):
        self.path, self.zipped = path.rstrip("/"), zipped

    def write(self, iterator) -> _Written:
        entries, out, size = [], None, 0
        for batch in iterator:
            names = [c for c in batch.schema.names if c in HEADERS]
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                columns = [part.column(batch.schema.get_field_index(c)).to_pylist() for c in [*names, "payload"]]
                for *values, payload in zip(*columns):
                    if out is None:
                        entries.append({"name": f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped})
                        out, size = files.open_output(f"{self.path}/{entries[-1]['name']}"), 0
                    raw = record(dict(zip(names, values)), payload or b"")
                    raw = gzip.compress(raw, 1, mtime=0) if self.zipped else raw
                    out.write(raw)
                    size += len(raw)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(entries)

    def commit(self, messages) -> None:
        files.write_manifest(self.path, [e for m in messages if m is not None for e in m.entries])

    def abort(self, messages) -> None:
        files.delete([f"{self.path}/{e['name']}" for m in messages if m is not None for e in m.entries])


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path.rstrip("/"), columns, Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        return [_File(f"{self.path}/{e['name']}") for e in files.read_manifest(self.path)] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "content_length" else pa.string()) for c in self.columns])
        held, size = [], 0
        with files.open_input(partition.path) as source:
            stream = gzip.GzipFile(fileobj=source) if partition.path.endswith(".gz") else io.BufferedReader(source, 1 << 16)
            while (head := read_headers(stream)) is not None:
                length = int(head["content-length"])
                row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
                if not self.wanted.passes(row):
                    stream.seek(length, 1)
                    continue
                row["content_length"] = length
                if "payload" in self.columns:
                    row["payload"] = stream.read(length)
                    size += length
                else:
                    stream.seek(length, 1)
                held.append(tuple(row[c] for c in self.columns))
                if size > 4 << 20 or len(held) >= 2000:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    if not schema.names:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def write(df: DataFrame, path: str, zipped: bool = False) -> None:
    """Writes rows of header columns and payload."""
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode("append").option("gzip", str(zipped).lower()).save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of SCHEMA, or of the given columns of it; without "payload" no payload is read."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([SCHEMA[c] for c in columns]) if columns else SCHEMA
    return spark.read.format("warc").schema(schema).load(path)


def records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """A record per row of pages. Of equal payloads of `least` bytes or more, that of the smallest page is the response.

    A null html is an empty payload. Only (page, digest) is shuffled: its groups are reduced before the shuffle to
    (digest, smallest page), which is joined back. A row without a page id is always a response; rows that
    repeat a page id with an equal payload are all the response or all revisits.
    """
    p = pages.select(F.col(page).alias("page"), F.col(url).alias("target_uri"), F.coalesce(F.encode(html, "utf-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload"))
    keys = p.where((F.col("length") >= least) & F.col("page").isNotNull())
    firsts = keys.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    later = keys.select("page", "digest").join(firsts, "digest").where("page <> first").select("page", F.col("digest").alias("d"), "first").distinct()
    joined = p.join(later.withColumnRenamed("page", "pg"), (F.col("page") == F.col("pg")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(F.col("first").isNotNull(), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.lit("text/html").alias("content_type"),
        F.col("length").cast("string").alias("payload_length"),
        F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )


def _page(urn: str):
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC and reads them back: bytes and digest of a response come from its payload as read."""
    path = shared_path(spark, "warc")
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path, zipped=True)
    back = read(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "payload_length", "payload"])
    here = F.col("record_type") == "response"
    return back.select(
        _page("record_id").alias("page_id"),
        F.when(here, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(here, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY d)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, h.d AS payload_digest,
       CASE WHEN f.first < h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < h.page_id THEN f.first END AS refers_to
FROM h LEFT JOIN f ON h.d = f.d AND h.n >= 100
"""
