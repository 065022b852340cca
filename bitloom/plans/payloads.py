"""Test payloads: seeded values and anomalies, and the long form of parsed records for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def choose(row: Column, seed: int, options: list) -> Column:
    """One of the options by row number and seed, the same every time."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(len(options))) + 1).cast("int"))


def number(row: Column, seed: int, lo: int, hi: int) -> Column:
    """An integer from lo to hi by row number and seed."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(hi - lo + 1)) + lo


def generate(spark: SparkSession, n: int, fields: dict[str, Column], parts: int | None = None) -> DataFrame:
    """n rows with the given columns of `id`."""
    return spark.range(0, n, 1, parts).select("id", *[c.alias(k) for k, c in fields.items()])


#: Changes of a payload that a parser must report.
ANOMALIES = {
    "truncated": lambda p: F.substring(p, F.lit(1), (F.octet_length(p) / 2).cast("int")),
    "trailing": lambda p: F.concat(p, F.lit(b"\xde\xad")),
    "length_mismatch": lambda p: F.concat(F.substring(p, 1, 1), F.lit(b"\xff\xff"), F.substring(p, F.lit(4), F.octet_length(p))),
    "framing": lambda p: F.concat(F.lit(b"\x00"), F.substring(p, F.lit(2), F.octet_length(p))),
    "misaligned": lambda p: F.unhex(F.concat(F.lit("0"), F.substring(F.hex(p), F.lit(1), F.length(F.hex(p)) - 1))),
    "encoding": lambda p: F.concat(F.substring(p, F.lit(1), F.octet_length(p) - 1), F.lit(b"\xff")),
    "dispatch_key": lambda p: F.concat(F.lit(b"?"), F.substring(p, F.lit(2), F.octet_length(p))),
}


def with_anomaly(payload: Column, kind: Column) -> Column:
    """The payload changed by the named anomaly; other names leave it."""
    out = F.when(F.lit(False), payload)
    for name, change in ANOMALIES.items():
        out = out.when(kind == name, change(payload))
    return out.otherwise(payload)


def dissect(df: DataFrame, record: str, *keys: str) -> DataFrame:
    """(keys, seq, path, value) of the leaves of a struct column, in schema order; values as text, null ones left out."""
    leaves: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, at: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}/{f.name}", at[f.name])
        elif isinstance(kind, T.ArrayType):
            leaves.append((path, F.array_join(F.transform(at, lambda x: x.cast("string")), ",")))
        else:
            leaves.append((path, F.hex(at) if isinstance(kind, T.BinaryType) else at.cast("string")))

    walk(df.schema[record].dataType, record, F.col(record))
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("path"), v.alias("value")) for i, (p, v) in enumerate(leaves)])
    return df.select(*keys, F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r")).select(*keys, "r.seq", "r.path", "r.value")
