"""The expression functions of format schemas, by their names there, as functions on columns.

`call("substring-before", text, sep)` gives a column; `FUNCTIONS` lists all. Where a schema's semantics and SQL's part ways, the schema's
hold: `round` goes half towards plus infinity, `matches` and `replace` take regular expressions, and a cast out of range is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.text import entities_decoded, entities_encoded

def _ranged(kind: str, lo: int, hi: int) -> Callable[[Column], Column]:
    def cast(x: Column) -> Column:
        wide = x.try_cast("decimal(38,0)")
        return F.when((wide >= F.lit(str(lo)).cast("decimal(38,0)")) & (wide <= F.lit(str(hi)).cast("decimal(38,0)")), wide.cast(kind))

    return cast



def _position(part: Column, text: Column) -> Column:
    return F.position(part, text)


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    first = F.floor(start + 0.5)
    end = F.floor(start + 0.5) + F.floor(length + 0.5) if length is not None else F.length(s) + 1
    lo = F.greatest(first, F.lit(1))
    return F.substring(s, lo.cast("int"), F.greatest(F.least(end, F.length(s) + 1) - lo, F.lit(0)).cast("int"))


def _look_ahead(data: Column, at: Column, offset: int, bits: int) -> Column:
    """The unsigned integer of 1 to 56 bits that stands `offset` bits after byte `at` of data (counted from 0); null beyond the end."""
    if not 1 <= bits <= 56:
        raise ValueError("1 to 56 bits")
    first, skip = divmod(offset, 8)
    n = -(-(skip + bits) // 8)
    low = min(n, 7)  # a last byte apart, where eight are touched
    part = F.substring(data, at.cast("int") + first + 1, F.lit(n))
    number = F.conv(F.hex(F.substring(part, F.lit(1), F.lit(low))), 16, 10).cast("bigint")
    if n == 8:
        rest = 8 * n - skip - bits
        head = number.bitwiseAND(F.lit((1 << (56 - skip)) - 1))
        last = F.conv(F.hex(F.substring(part, F.lit(8), F.lit(1))), 16, 10).cast("bigint")
        value = F.shiftleft(head, 8 - rest).bitwiseOR(F.shiftright(last, rest))
    else:
        value = F.shiftright(number, 8 * n - skip - bits).bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(F.octet_length(part) == n, value)


#: Name in schemas -> function on columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "concat": F.concat,
    "string-length": F.char_length,
    "substring": _substring,
    "substring-before": lambda s, d: F.when(F.contains(s, d) & (d != ""), F.substring(s, F.lit(1), _position(d, s) - 1)).otherwise(""),
    "substring-after": lambda s, d: F.when(F.contains(s, d), F.substring(s, _position(d, s) + F.length(d), F.length(s))).otherwise(""),
    "contains": F.contains,
    "starts-with": F.startswith,
    "ends-with": F.endswith,
    "upper-case": F.upper,
    "lower-case": F.lower,
    "matches": lambda s, p: F.rlike(s, p),
    "replace": lambda s, p, r: F.regexp_replace(s, p, r),
    "compare": lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0),
    "abs": F.abs,
    "ceiling": F.ceil,
    "floor": F.floor,
    "round": lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")),
    "round-half-to-even": lambda x, n=0: F.bround(x, n),
    "roundHalfToEven": lambda x, n=0: F.bround(x, n),
    "error": lambda *message: F.raise_error(message[0] if message else F.lit("error")),
    "valueLength": lambda x, unit="bytes": {"bytes": F.octet_length, "bits": F.bit_length, "characters": F.char_length}[unit](x),
    "contentLength": lambda x, unit="bytes": {"bytes": F.octet_length, "bits": F.bit_length, "characters": F.char_length}[unit](x),
    "lookAhead": _look_ahead,
    "encodeDFDLEntities": entities_encoded,
    "decodeDFDLEntities": entities_decoded,
    "time": lambda x: F.concat(F.lit("1970-01-01 "), x.cast("string")).try_cast("timestamp"),  # a time of the first day
    "hours-from-time": F.hour,
    "minutes-from-time": F.minute,
    "seconds-from-time": F.second,
    "exists": lambda x: x.isNotNull(),
    "empty": lambda x: x.isNull(),
    "count": F.size,
    "not": lambda x: ~x,
    "true": lambda: F.lit(True),
    "false": lambda: F.lit(False),
    "boolean": lambda x: x.cast("boolean"),
    "string": lambda x: x.cast("string"),
    "double": lambda x: x.try_cast("double"),
    "float": lambda x: x.try_cast("float"),
    "decimal": lambda x: x.try_cast("decimal(38,18)"),
    "integer": lambda x: x.try_cast("decimal(38,0)"),
    "nonNegativeInteger": _ranged("decimal(38,0)", 0, 10**38 - 1),
    "long": _ranged("bigint", -(2**63), 2**63 - 1),
    "int": _ranged("int", -(2**31), 2**31 - 1),
    "short": _ranged("smallint", -(2**15), 2**15 - 1),
    "byte": _ranged("tinyint", -(2**7), 2**7 - 1),
    "unsignedLong": _ranged("decimal(20,0)", 0, 2**64 - 1),
    "unsignedInt": _ranged("bigint", 0, 2**32 - 1),
    "unsignedShort": _ranged("int", 0, 2**16 - 1),
    "unsignedByte": _ranged("smallint", 0, 2**8 - 1),
    "hexBinary": F.unhex,
    "date": lambda x: x.try_cast("date"),
    "dateTime": lambda d, t=None: (d if t is None else F.concat_ws(" ", d.cast("string"), t.cast("string"))).try_cast("timestamp"),
    "year-from-date": F.year,
    "month-from-date": F.month,
    "day-from-date": F.dayofmonth,
    "year-from-dateTime": F.year,
    "month-from-dateTime": F.month,
    "day-from-dateTime": F.dayofmonth,
    "hours-from-dateTime": F.hour,
    "minutes-from-dateTime": F.minute,
    "seconds-from-dateTime": F.second,
    "bitAnd": lambda a, b: a.bitwiseAND(b),
    "bitOr": lambda a, b: a.bitwiseOR(b),
    "bitXor": lambda a, b: a.bitwiseXOR(b),
    "bitNot": F.bitwise_not,
    "leftShift": lambda a, n: F.shiftleft(a, n),
    "rightShift": lambda a, n: F.shiftright(a, n),
    "checkRangeInclusive": lambda x, lo, hi: (x >= lo) & (x <= hi),
    "checkRangeExclusive": lambda x, lo, hi: (x > lo) & (x < hi),
    "trace": lambda x, *_: x,
    # operators
    "div": lambda a, b: F.when(b != 0, a / b),
    "idiv": lambda a, b: F.when(b != 0, F.call_function("div", a, b)).cast("bigint"),
    "mod": lambda a, b: F.when(b != 0, a % b),
    "if": lambda test, yes, no: F.when(test, yes).otherwise(no),
}


def call(name: str, *args) -> Column:
    """The function's column; numbers and texts among the arguments are literals (shift widths and digits stay numbers)."""
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name!r}")
    plain = name in ("leftShift", "rightShift", "round-half-to-even", "roundHalfToEven", "lookAhead", "valueLength", "contentLength")
    return FUNCTIONS[name](*(a if isinstance(a, Column) or plain else F.lit(a) for a in args))
