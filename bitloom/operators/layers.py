"""Byte-stream layers: transforms of a region of bytes before it is parsed. gzip runs by Arrow batches, the others as expressions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def swapped(data: Column, size: int) -> Column:
    """Bytes reversed within groups of 2 or 4; a last group may be shorter."""
    groups = F.regexp_extract_all(F.hex(data), F.lit(f".{{1,{2 * size}}}"), F.lit(0))
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.array_join(F.reverse(F.regexp_extract_all(g, F.lit(".."), F.lit(0))), "")), ""))


@F.pandas_udf(T.BinaryType())
def gunzip(column: pd.Series) -> pd.Series:
    """Inflated bytes; null where they aren't gzip."""

    def one(b):
        try:
            return None if b is None else zlib.decompress(bytes(b), 31)
        except zlib.error:
            return None

    return column.map(one)


@F.pandas_udf(T.BinaryType())
def gzip(column: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(bytes(b)) + z.flush()

    return column.map(one)


def base64_mime(data: Column) -> Column:
    """Base64 text with line ends after 76 characters."""
    return F.regexp_replace(F.regexp_replace(F.base64(data), "[\r\n]", ""), "(.{76})(?=.)", "$1\r\n")


def unbase64_mime(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, "[\r\n]", ""))


def unfolded(text: Column) -> Column:
    """Message header lines whose continuations begin with white space, made one line each."""
    return F.regexp_replace(text, "(?:\r\n|\r|\n)(?=[ \t])", "")


def folded(text: Column, width: int = 78) -> Column:
    """Lines folded before white space so that they stay within width where that can be."""
    return F.regexp_replace(text, f"(.{{1,{width}}})(?=[ \t])(?!$)", "$1\r\n")


def to_mark(text: Column, mark: str = "//") -> Column:
    """What stands before the mark; null without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, 1))


def check_digit(text: Column, length: int = 10) -> Column:
    """Sum of the digits among the first `length` characters, modulo 10."""
    digits = F.regexp_extract_all(F.substring(text, 1, length), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d.cast("int")) % 10


def ipv4_checksum(header: Column) -> Column:
    """One's-complement checksum of a 20-byte header, its own checksum field taken as zero."""
    words = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == 5, F.lit(0)).otherwise(F.conv(F.hex(F.substring(header, i * 2 + 1, F.lit(2))), 16, 10).cast("int")))
    total = F.aggregate(words, F.lit(0), lambda a, w: a + w)
    once = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(total, 16)
    return F.lit(0xFFFF) - (once.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(once, 16))


def ais_armor(text: Column) -> Column:
    """Bits (as 0 and 1) of six-bit armoured payload characters."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.ascii(c) - 48 > 40, F.ascii(c) - 56).otherwise(F.ascii(c) - 48))
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.conv(c.cast("string"), 10, 2), 6, "0")), "")
