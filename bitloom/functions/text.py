"""Text codecs as column expressions: numbers by pattern, zoned decimals, rounding, calendars, booleans, nils, escapes, encodings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.binary import with_point

# -- numbers ---------------------------------------------------------------------------------------


@dataclass
class NumberPattern:
    """A decimal pattern such as `#,##0.00;(#)`: affixes, grouping, digits; `%` scales by 100, V marks a virtual point."""

    pattern: str
    point: str = "."
    group: str = ","

    def __post_init__(self) -> None:
        positive, _, negative = self.pattern.partition(";")
        m = re.fullmatch(r"([^#0,.V]*)([#0,.V]+)([^#0,.V]*)", positive)
        if not m:
            raise ValueError(f"number pattern {self.pattern!r}")
        self.head, body, self.tail = m.groups()
        whole, _, part = body.replace("V", ".").partition(".")
        self.virtual = len(part) if "V" in body else 0
        self.grouped = len(whole) - whole.rfind(",") - 1 if "," in whole else 0
        self.least_whole = whole.count("0")
        self.least_part, self.most_part = part.count("0"), len(part)
        n = re.fullmatch(r"([^#0,.V]*)[#0,.V]+([^#0,.V]*)", negative) if negative else None
        self.minus_head, self.minus_tail = n.groups() if n else ("-" + self.head, self.tail)
        self.percent = "%" in self.head + self.tail

    def parse(self, text: Column, strict: bool = True) -> Column:
        """Value as decimal(38,10), or null if the text doesn't fit; lax parsing takes any grouping and blanks around."""
        e, g, p = re.escape, re.escape(self.group), re.escape(self.point)
        digits = rf"\d{{1,{self.grouped}}}(?:{g}\d{{{self.grouped}}})*" if self.grouped and strict else rf"[\d{g}]+" if self.grouped else r"\d+"
        fraction = "" if self.virtual or not self.most_part else rf"(?:{p}(\d{{{self.least_part},{self.most_part}}}))" + ("" if self.least_part else "?")
        body = rf"({digits})" + (fraction or "()")
        text = text if strict else F.trim(text)
        out = F.when(F.lit(False), F.lit(None).cast("decimal(38,10)"))
        for head, tail, sign in ((self.minus_head, self.minus_tail, -1), (self.head, self.tail, 1)):
            whole = f"^{e(head)}{body}{e(tail)}$"
            number = F.concat(F.regexp_replace(F.regexp_extract(text, whole, 1), g, ""), F.lit("."), F.regexp_extract(text, whole, 2))
            value = number.try_cast("decimal(38,10)") / F.lit(10**self.virtual * (100 if self.percent else 1))
            out = out.when(text.rlike(whole), (value * sign).cast("decimal(38,10)"))
        return out

    def format(self, value: Column) -> Column:
        """Text of a number, half-even rounded to the pattern's fraction digits."""
        scaled = value.cast("decimal(38,10)") * (100 if self.percent else 1)
        digits = F.bround(F.abs(scaled) * 10**self.most_part).cast("decimal(38,0)").cast("string")
        digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(self.most_part + self.least_whole)), "0")
        whole = F.substring(digits, F.lit(1), F.length(digits) - self.most_part)
        part = F.right(digits, F.lit(self.most_part)) if self.most_part else F.lit("")
        if self.grouped:
            whole = F.reverse(F.regexp_replace(F.reverse(whole), rf"(\d{{{self.grouped}}})(?=\d)", "$1" + self.group))
        if self.virtual:
            body = F.concat(whole, part)
        elif self.most_part:
            part = F.regexp_replace(part, rf"(?<=^\d{{{self.least_part},{self.most_part}}})0+$", "") if self.most_part > self.least_part else part
            body = F.concat(whole, F.when(part != "", F.concat(F.lit(self.point), part)).otherwise(""))
        else:
            body = whole
        minus = (scaled < 0) & (F.regexp_replace(digits, "0", "") != "")
        return F.when(minus, F.concat(F.lit(self.minus_head), body, F.lit(self.minus_tail))).otherwise(F.concat(F.lit(self.head), body, F.lit(self.tail)))


def radix(text: Column, base: int) -> Column:
    """Integer written in base 2 to 36; text with other digits gives null."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    return F.when(F.lower(text).rlike(f"^[{digits}]+$"), F.conv(text, base, 10).cast("bigint"))


#: Digits of overpunched last characters 0 to 9, by sign style (fixed values).
ZONED = {
    "standard": ("0123456789", "pqrstuvwxy"),
    "translated_ebcdic": ("{ABCDEFGHI", "}JKLMNOPQR"),
    "ca_realia": ("0123456789", " !\"#$%&'()"),
    "tandem": ("0123456789", "".join(chr(c) for c in range(0x80, 0x8A))),
}


def zoned(text: Column, style: str = "standard", scale: int = 0) -> Column:
    """Zoned decimal with the sign in its last character; anything else gives null."""
    plus, minus = ZONED[style]
    last = F.right(text, F.lit(1))
    both = plus + minus
    digit = F.translate(last, both, "0123456789" * 2)
    value = with_point(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), digit), scale).try_cast(f"decimal(38,{scale})")
    return F.when(last.isin(*minus), -value).when(last.isin(*plus), value)


def put_zoned(value: Column, width: int, style: str = "standard") -> Column:
    plus, minus = ZONED[style]
    digits = F.lpad(F.abs(value.cast("bigint")).cast("string"), width, "0")
    last = F.right(digits, F.lit(1))
    return F.concat(F.substring(digits, F.lit(1), F.lit(width - 1)), F.when(value < 0, F.translate(last, "0123456789", minus)).otherwise(F.translate(last, "0123456789", plus)))


def rounded(value: Column, digits: int, mode: str) -> Column:
    """A decimal column rounded to fraction digits: up, down, ceiling, floor, half_up, half_down, half_even, unnecessary (null if it would change)."""
    unit = F.lit(10**digits).cast("decimal(20,0)")
    x = value.cast("decimal(30,8)") * unit
    low = F.floor(F.abs(x))
    rest = F.abs(x) - low
    sign = F.when(x < 0, -1).otherwise(1)
    whole = {
        "up": F.ceil(F.abs(x)) * sign,
        "down": low * sign,
        "ceiling": F.ceil(x),
        "floor": F.floor(x),
        "half_up": F.when(rest >= 0.5, low + 1).otherwise(low) * sign,
        "half_down": F.when(rest > 0.5, low + 1).otherwise(low) * sign,
        "half_even": F.when((rest > 0.5) | ((rest == 0.5) & (low % 2 == 1)), low + 1).otherwise(low) * sign,
        "unnecessary": F.when(rest == 0, low * sign),
    }[mode]
    return (whole.cast("decimal(28,0)") / unit).cast(f"decimal(30,{digits})")


# -- booleans, nils, padding ------------------------------------------------------------------------


def boolean(text: Column, true: list[str], false: list[str], ignore_case: bool = False) -> Column:
    t = F.lower(text) if ignore_case else text
    own = [[v.lower() for v in x] if ignore_case else x for x in (true, false)]
    return F.when(t.isin(own[0]), True).when(t.isin(own[1]), False)


def nil(text: Column, literals: list[str]) -> Column:
    """Null where the text is one of the nil literals."""
    return F.when(~text.isin(literals), text)


def trimmed(text: Column, pad: str = " ", justification: str = "left") -> Column:
    """Text without its padding: trailing for left-justified text, leading for right, both for center."""
    out = text
    if justification in ("left", "center"):
        out = F.rtrim(out, F.lit(pad))
    if justification in ("right", "center"):
        out = F.ltrim(out, F.lit(pad))
    return out


def padded(text: Column, width: int, pad: str = " ", justification: str = "left") -> Column:
    """Text filled up to width; longer text is cut."""
    if justification == "center":
        left = F.lpad(text, F.length(text) + F.greatest(F.lit(0), F.floor((width - F.length(text)) / 2)).cast("int"), F.lit(pad))
        return F.rpad(left, width, pad)
    return F.rpad(text, width, pad) if justification == "left" else F.lpad(text, width, pad)


# -- calendars ------------------------------------------------------------------------------------------


def calendar(text: Column, pattern: str) -> Column:
    """Timestamp by a date pattern; text that doesn't fit gives null."""
    return F.try_to_timestamp(text, F.lit(pattern))


def calendar_bcd(part: Column, pattern: str = "yyyyMMddHHmmss") -> Column:
    return F.try_to_timestamp(F.hex(part), F.lit(pattern))


def calendar_epoch(value: Column, unit: str = "seconds", epoch: str = "1970-01-01 00:00:00") -> Column:
    """Timestamp of a count of seconds or milliseconds since epoch (UTC)."""
    micros = value.cast("bigint") * (1_000_000 if unit == "seconds" else 1000)
    return F.timestamp_micros(micros + F.unix_micros(F.lit(epoch).cast("timestamp")))


# -- delimiters, escapes, entities --------------------------------------------------------------------------

#: Character entities and the characters or patterns that they stand for (fixed values).
ENTITIES = {
    "NUL": "\x00",
    "HT": "\t",
    "LF": "\n",
    "VT": "\x0b",
    "FF": "\x0c",
    "CR": "\r",
    "SP": " ",
    "NEL": "\x85",
    "NBSP": "\xa0",
    "LS": " ",
}
CLASSES = {"NL": r"(?:\r\n|\n|\r|\x85| )", "WSP": r"[ \t\n\x0b\x0c\r\x85 \xa0]", "WSP*": r"[ \t\n\x0b\x0c\r\x85 \xa0]*", "WSP+": r"[ \t\n\x0b\x0c\r\x85 \xa0]+", "ES": ""}
_ENTITY = re.compile(r"%(?:%|#x([0-9A-Fa-f]+);|#([0-9]+);|#r([0-9A-Fa-f]{2});|([A-Z]+[*+]?);)")


def delimiter(spec: str, ignore_case: bool = False) -> str:
    """Regular expression of a delimiter: alternatives apart by spaces, the one of most characters first, with %entities; in them (each counts as one)."""

    def one(text: str) -> str:
        out, at = "", 0
        for m in _ENTITY.finditer(text):
            out += re.escape(text[at : m.start()])
            hexa, decimal, raw, name = m.groups()
            if m[0] == "%%":
                out += "%"
            elif name in CLASSES:
                out += CLASSES[name]
            elif name:
                out += re.escape(ENTITIES[name])
            else:
                out += re.escape(chr(int(hexa or raw, 16) if hexa or raw else int(decimal)))
            at = m.end()
        return out + re.escape(text[at:])

    return ("(?i)" if ignore_case else "") + "(?:" + "|".join(one(t) for t in sorted(spec.split(), key=lambda t: len(_ENTITY.sub("x", t)), reverse=True)) + ")"


def entities_decoded(text: Column) -> Column:
    """%entities; replaced by their characters; doubled percent signs part the text, so that one of them starts no entity."""

    def one(part: Column) -> Column:
        for name, char in (ENTITIES | {"NL": "\n"}).items():
            part = F.replace(part, F.lit(f"%{name};"), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, "%%", -1), one), "%")


def split_fields(text: Column, separator: str, escape: str | None = None, quote: str | None = None) -> Column:
    """Fields between separators (a delimiter expression); one after an odd number of escapes, or inside a quoted block, is text.

    A field may hold any character and be of any length: its pattern is possessive, which takes no stack.
    """
    if quote:
        q = re.escape(quote)
        block = rf"{q}(?:[^{q}]|{q}{q})*+{q}"
        return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?:\A|{separator})((?:{block}|(?!{separator}).)*+)"), F.lit(1)), lambda x: unquoted(x, quote))
    if escape:
        e = re.escape(escape)
        found = F.regexp_extract_all(text, F.lit(rf"(?s)(?:\A|{separator})((?:{e}.|(?!{separator}).)*+)"), F.lit(1))
        return F.transform(found, lambda x: F.regexp_replace(x, rf"(?s){e}(.)", "$1"))
    return F.split(text, separator, -1)


SUPPRESSION = ("never", "trailingEmpty", "trailingEmptyStrict", "anyEmpty")


def with_suppression(fields: Column, policy: str, count: int) -> Column:
    """Array of `count` fields (null where empty or suppressed) of those that stand between separators, or null where the policy forbids them.

    never: exactly `count` stand there. trailingEmpty: empty ones at the end may lack. trailingEmptyStrict: they must. anyEmpty: empty ones count nowhere.
    """
    if policy not in SUPPRESSION:
        raise ValueError(f"policy is one of {SUPPRESSION}")
    n = F.size(fields)
    kept = F.filter(fields, lambda x: x != "") if policy == "anyEmpty" else fields
    filled = F.slice(F.concat(F.transform(kept, lambda x: F.when(x != "", x)), F.array_repeat(F.lit(None).cast("string"), count)), 1, count)
    fits = {"never": n == count, "trailingEmpty": n <= count, "trailingEmptyStrict": (n <= count) & ((n == 1) | (F.element_at(fields, -1) != "")), "anyEmpty": F.size(kept) <= count}[policy]
    return F.when(fits, filled)


def joined_with_suppression(fields: list[Column], separator: str, policy: str) -> Column:
    """Text of fields (null or empty ones are empty) with separators, as the policy has them written."""
    texts = F.array(*[F.coalesce(f, F.lit("")) for f in fields])
    if policy == "anyEmpty":
        return F.array_join(F.filter(texts, lambda x: x != ""), separator)
    if policy == "never":
        return F.array_join(texts, separator)
    last = F.array_max(F.transform(texts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.array_join(F.slice(texts, F.lit(1), last), separator)


def entities_encoded(text: Column) -> Column:
    """Percent signs doubled and control characters, among ENTITIES, written as %entities;."""
    out = F.replace(text, F.lit("%"), F.lit("%%"))
    for name, char in ENTITIES.items():
        if name != "SP":
            out = F.replace(out, F.lit(char), F.lit(f"%{name};"))
    return out


def unquoted(text: Column, quote: str) -> Column:
    """A quoted block without its quotes, doubled ones made single."""
    inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(quote * 2), F.lit(quote))
    return F.when(text.startswith(quote) & text.endswith(quote) & (F.length(text) > 1), inner).otherwise(text)


def escaped(text: Column, separator: str, escape: str) -> Column:
    """Text with an escape before each separator character and escape."""
    return F.regexp_replace(text, f"([{re.escape(separator)}{re.escape(escape)}])", re.escape(escape).replace("\\\\", "\\\\") + "$1")


def quoted(text: Column, separator: str, quote: str = '"') -> Column:
    """Text as a quoted block if it holds a separator, quote or line end."""
    inner = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    return F.when(text.rlike(f"[{re.escape(separator)}{re.escape(quote)}\r\n]"), inner).otherwise(text)


# -- encodings ---------------------------------------------------------------------------------------------

_NATIVE = {"utf-8", "utf-16be", "utf-16le", "utf-16", "us-ascii", "iso-8859-1", "utf-32"}


def decoded(data: Column, encoding: str) -> Column:
    """Characters of bytes; encodings that Spark lacks (IBM037, ISO-8859-13, windows-1252 ...) go through the codecs of Python, by Arrow batches."""
    if encoding.lower() in _NATIVE:
        return F.decode(data, encoding)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return run(data)


def encoded(text: Column, encoding: str) -> Column:
    if encoding.lower() in _NATIVE:
        return F.encode(text, encoding)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else t.encode(encoding, "replace"))

    return run(text)


def bit_string(data: Column) -> Column:
    """The bits of the bytes as characters 0 and 1."""
    nibbles = F.regexp_extract_all(F.hex(data), F.lit("."), F.lit(0))
    return F.array_join(F.transform(nibbles, lambda n: F.lpad(F.conv(n, 16, 2), 4, "0")), "")


def sub_byte(data: Column, width: int, alphabet: str | None = None) -> Column:
    """Characters of 1 to 7 bits, most significant first; a rest of fewer bits is fill. Without an alphabet, the code is the character."""
    codes = F.transform(F.regexp_extract_all(bit_string(data), F.lit(f"[01]{{{width}}}"), F.lit(0)), lambda b: F.conv(b, 2, 10).cast("int"))
    if alphabet is None:
        return F.array_join(F.transform(codes, lambda c: F.char(c)), "")
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def put_sub_byte(text: Column, width: int, alphabet: str) -> Column:
    """Bytes of characters of an alphabet in `width` bits each, filled with zeros to a whole byte."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.lpad(F.conv((F.instr(F.lit(alphabet), c) - 1).cast("string"), 10, 2), width, "0"))
    joined = F.array_join(codes, "")
    filled = F.rpad(joined, (F.ceil(F.length(joined) / 8) * 8).cast("int"), F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(filled, F.lit("[01]{8}"), F.lit(0)), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))
