"""Binary codecs as column expressions: each takes a binary column and places in it, and stays inside code generation.

Places and lengths count from 0 and may be numbers or columns. A place beyond the end gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Place = int | Column


def _col(x: Place) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def cut(data: Column, start: Place, length: Place) -> Column:
    """length bytes from start, or null where fewer are left. The bytes stand in one branch, so that they are taken once."""
    end = start + length if isinstance(start, int) and isinstance(length, int) else _col(start) + _col(length)
    enough = F.octet_length(data) >= end
    if isinstance(length, Column):
        enough = enough & (length >= 0)
    return F.when(enough, F.substring(data, _col(start + 1), _col(length)))


def reverse_bytes(part: Column, length: int) -> Column:
    """Bytes in the other order."""
    return part if length == 1 else F.concat(*[F.substring(part, i, 1) for i in range(length, 0, -1)])


def whole(part: Column, length: int, little: bool = False, signed: bool = False) -> Column:
    """Integer of all bytes of part, of which there are `length` (1 to 8): bigint, or decimal(20,0) for 8 unsigned ones. Names part once unless little."""
    digits = F.hex(reverse_bytes(part, length) if little else part)
    if length == 8:
        return F.conv(digits, 16, -10).cast("bigint") if signed else F.conv(digits, 16, 10).cast("decimal(20,0)")
    value = F.conv(digits, 16, 10).cast("bigint")
    return _signed(value, 8 * length) if signed else value


def uint(data: Column, start: Place, length: int, little: bool = False) -> Column:
    """Unsigned integer of 1 to 8 bytes: bigint, or decimal(20,0) for 8."""
    return whole(cut(data, start, length), length, little)


def sint(data: Column, start: Place, length: int, little: bool = False) -> Column:
    """Two's-complement integer of 1 to 8 bytes as bigint."""
    return whole(cut(data, start, length), length, little, True)


def _signed(u: Column, width: int) -> Column:
    """The two's-complement value of `width` bits that u holds unsigned; names u once."""
    top = F.lit(1 << (width - 1)).cast("bigint")
    return u.bitwiseXOR(top) - top


def bits(data: Column, start: int, length: int, lsb_first: bool = False) -> Column:
    """Unsigned integer of 1 to 56 bits from bit `start`; most significant bit first, or with lsb_first, numbered from each byte's low bit."""
    if not 1 <= length <= 56:
        raise ValueError("1 to 56 bits")
    first, last = start // 8, (start + length - 1) // 8
    n = last - first + 1
    mask = (1 << length) - 1
    if n <= 7:
        shift = start - 8 * first if lsb_first else 8 * n - (start - 8 * first) - length
        return F.shiftright(uint(data, first, n, little=lsb_first), shift).bitwiseAND(F.lit(mask))
    if lsb_first:
        low = 8 - start % 8
        return bits(data, start, low, True).bitwiseOR(F.shiftleft(bits(data, start + low, length - low, True), low))
    low = (start + length) % 8 or 8
    return F.shiftleft(bits(data, start, length - low), low).bitwiseOR(bits(data, start + length - low, low))


def signed_bits(data: Column, start: int, length: int, lsb_first: bool = False) -> Column:
    """Two's-complement integer of 2 to 56 bits."""
    return _signed(bits(data, start, length, lsb_first), length)


def ieee(data: Column, start: Place, length: int, little: bool = False) -> Column:
    """IEEE float (4 bytes, as float) or double (8 bytes), by its sign, exponent and fraction."""
    part = cut(data, start, length)
    part = reverse_bytes(part, length) if little else part
    if length == 4:
        u = uint(part, 0, 4)
        sign, power, fraction, top, width, low = F.shiftright(u, 31), F.shiftright(u, 23).bitwiseAND(F.lit(255)), u.bitwiseAND(F.lit((1 << 23) - 1)), 255, 23, -149
    else:
        head = uint(part, 0, 2)
        sign, power, top, width, low = F.shiftright(head, 15), F.shiftright(head, 4).bitwiseAND(F.lit(2047)), 2047, 52, -1074
        fraction = F.shiftleft(head.bitwiseAND(F.lit(15)), 48) + uint(part, 2, 6)
    bias = (top - 1) // 2
    size = F.when(power == 0, fraction * F.lit(2.0**low) if length == 4 else fraction * F.lit(5e-324)).otherwise((1 + fraction / float(1 << width)) * F.pow(F.lit(2.0), power - bias))
    value = F.when(power == top, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    value = F.when(sign == 1, -value).otherwise(value)
    return value.cast("float") if length == 4 else value


def _try_decimal(digits: Column, scale: int) -> Column:
    """Digits with a virtual point before the last `scale`, put into their text so that none is lost."""
    return with_point(digits, scale).try_cast(f"decimal(38,{scale})")


def with_point(digits: Column, scale: int) -> Column:
    """A text of digits with a point before its last `scale`."""
    if not scale:
        return digits
    filled = F.lpad(digits, F.greatest(F.length(digits), F.lit(scale + 1)), F.lit("0"))
    return F.concat(F.substring(filled, F.lit(1), F.length(filled) - scale), F.lit("."), F.right(filled, F.lit(scale)))


def bcd(part: Column, scale: int = 0) -> Column:
    """Binary-coded decimal; a nibble above 9 gives null."""
    return _try_decimal(F.hex(part), scale)


def packed(part: Column, scale: int = 0, positive: str = "ACEF", negative: str = "BD") -> Column:
    """Packed decimal with the sign in the last nibble; unknown signs and digits give null."""
    digits, sign = F.substring(F.hex(part), F.lit(1), F.length(F.hex(part)) - 1), F.right(F.hex(part), F.lit(1))
    value = _try_decimal(digits, scale)
    return F.when(sign.isin(*negative), -value).when(sign.isin(*positive), value)


def ibm4690(part: Column, scale: int = 0) -> Column:
    """IBM 4690 packed decimal: leading F nibbles fill, a D before the digits is minus."""
    digits = F.regexp_replace(F.hex(part), "^F+", "")
    return F.when(digits.startswith("D"), -_try_decimal(F.substring(digits, F.lit(2), F.length(digits)), scale)).otherwise(_try_decimal(digits, scale))


def boolean(value: Column, true: int, false: int | None = None) -> Column:
    """True and false representations; without `false`, anything else is false, and with it anything else is null."""
    return F.when(value == true, True).when(value == false, False) if false is not None else value == true


def enumerated(value: Column, names: dict[int, str], ranges: list[tuple[int, int, str]] = ()) -> Column:
    """Name of a value, by values or by inclusive ranges; null if there is none."""
    out = F.when(F.lit(False), F.lit(""))
    for v, name in names.items():
        out = out.when(value == v, name)
    for lo, hi, name in ranges:
        out = out.when(value.between(lo, hi), name)
    return out


# -- the other way --------------------------------------------------------------------------------


def put_uint(value: Column, length: int, little: bool = False) -> Column:
    """Bytes of a non-negative integer; one that doesn't fit gives null."""
    part = F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * length, "0"))
    if length < 8:
        part = F.when(value.cast("bigint").between(0, (1 << 8 * length) - 1), part)
    return reverse_bytes(part, length) if little else part


def put_sint(value: Column, length: int, little: bool = False) -> Column:
    """Bytes of a two's-complement integer."""
    wide = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    part = F.unhex(wide if length == 8 else F.right(wide, F.lit(2 * length)))
    return reverse_bytes(part, length) if little else part


def put_bcd(value: Column, length: int) -> Column:
    return F.unhex(F.lpad(value.cast("bigint").cast("string"), 2 * length, "0"))


def put_packed(value: Column, length: int) -> Column:
    return F.unhex(F.lpad(F.concat(F.abs(value.cast("bigint")).cast("string"), F.when(value < 0, "D").otherwise("C")), 2 * length, "0"))


def put_ibm4690(value: Column, length: int) -> Column:
    return F.unhex(F.lpad(F.concat(F.when(value < 0, "D").otherwise(""), F.abs(value.cast("bigint")).cast("string")), 2 * length, "F"))


def put_bits(fields: list[tuple[Column, int]]) -> Column:
    """Bit fields (value, width), most significant first; widths must add up to whole bytes, seven at most."""
    total = sum(n for _, n in fields)
    if total % 8 or total > 56:
        raise ValueError("whole bytes, seven at most")
    word = F.lit(0).cast("bigint")
    for value, n in fields:
        word = F.shiftleft(word, n).bitwiseOR(value.cast("bigint").bitwiseAND(F.lit((1 << n) - 1)))
    return put_uint(word, total // 8)
