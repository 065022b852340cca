"""Parsed records as XML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_xml(value: Column, kind: T.DataType, name: str) -> Column:
    """An element of the value without blanks between tags: a struct's fields inside it in order, an array's items each in a tag of the name; null gives nothing."""
    if isinstance(kind, T.StructType):
        inner = F.concat(*[to_xml(value[f.name], f.dataType, f.name) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(value, lambda x: to_xml(x, kind.elementType, name)), ""), F.lit(""))
    else:
        inner = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")):
            inner = F.replace(inner, F.lit(char), F.lit(entity))
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise("")
