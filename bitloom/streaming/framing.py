"""Streams of framed messages: frames cut across chunks by keyed state, and files read to their end as a stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A frame longer than this is an error of the stream, so the state of a source stays bounded.
FRAME_BYTES = 1 << 20


def frames(stream: DataFrame, source: str, sequence: str, chunk: str, header: int, length: Callable[[bytes], int]) -> DataFrame:
    """(source, frame_no, frame) of chunked byte streams: `length` gives a whole frame's bytes by its first `header` bytes.

    Chunks of a source are taken in order of `sequence` within a micro-batch; what is left of a frame waits in the source's state.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, b"")
        rows = pd.concat(list(parts)).sort_values(sequence)
        data, at, found = bytes(rest) + b"".join(bytes(c) for c in rows[chunk] if c is not None), 0, []
        while len(data) - at >= header:
            n = length(data[at : at + header])
            if not header <= n <= FRAME_BYTES:
                raise ValueError(f"frame of {n} bytes in source {key[0]}")
            if len(data) - at < n:
                break
            found.append((key[0], number, data[at : at + n]))
            number, at = number + 1, at + n
        state.update((number, data[at:]))
        yield pd.DataFrame(found, columns=[source, "frame_no", "frame"])

    kind = stream.schema[source].dataType.simpleString()
    return (
        stream.select(source, sequence, chunk)
        .groupBy(source)
        .applyInPandasWithState(run, f"{source} {kind}, frame_no bigint, frame binary", "number bigint, rest binary", "append", GroupStateTimeout.NoTimeout)
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a local one where it is unset, as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="bitloom-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, written to and read from the shared folder.

    complete: every micro-batch writes the whole result in place of the one before.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)
    if mode == "complete":
        write = lambda batch, _number: batch.write.mode("overwrite").parquet(out)
        stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
