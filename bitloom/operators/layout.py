"""Record layouts, compiled to column expressions: parse(df, payload, layout) and build(df, layout).

A layout is a sequence of terms. Terms of fixed width have fixed places and stay plain expressions over the payload; after a term whose
length comes from the data, the running place is a column of its own, so that no expression repeats those before it. Nothing here
runs Python on rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.binary import cut
from bitloom.functions.facets import Facets

Fields = dict[str, Column]
Length = int | Callable[[Fields], Column]


@dataclass
class Element:
    """A value: `decode` makes it of its bytes. length: bytes, a function of earlier fields, or one of Prefixed, Pattern, Delimited and Rest.

    optional: it is there if its initiator is, or without one, if what stands there decodes; else it is null and takes no bytes.
    """

    name: str
    length: object
    decode: Callable[[Column], Column]
    encode: Callable[[Column], Column] | None = None
    hidden: bool = False
    facets: Facets | None = None
    default: object = None
    initiator: str | None = None
    align: int = 1
    optional: bool = False


@dataclass
class Group:
    """Terms that become a struct of their own; their functions see the fields before the group, too."""

    name: str
    terms: list


@dataclass
class Unordered:
    """Elements with initiators, in any order; each stands once at most, and once unless it is optional. Their lengths are bytes or Delimited."""

    elements: list


@dataclass
class Repeated:
    """Items of any width: `item(data, at)` gives an item's value and its bytes. kind: the value's type, as Spark writes it.

    count: a number, a function of earlier fields, or None for as many as there are up to the end.
    """

    name: str
    kind: str
    item: Callable[[Column, Column], tuple[Column, Column]]
    count: object = None


@dataclass
class Prefixed:
    """The length stands before the value, in `size` bytes; includes_prefix: counting those too."""

    size: int
    read: Callable[[Column], Column]
    includes_prefix: bool = False
    write: Callable[[Column], Column] | None = None


@dataclass
class Pattern:
    """As long as the regular expression matches, in ISO-8859-1 characters, from here."""

    regex: str


@dataclass
class Delimited:
    """Up to the delimiter (a regular expression), which is passed over, or to the end. `text` writes it."""

    regex: str
    text: str = ""


@dataclass
class Rest:
    """All that is left."""


@dataclass
class Skip:
    """Bytes passed over; `fill` writes them."""

    length: int
    fill: bytes = b"\x00"


@dataclass
class Array:
    """Items of `width` bytes. count: a number, a function of earlier fields, or None for as many as are left; stop ends before an item.

    With `valid`, as many as hold it, from `least` to `most`; the first that doesn't is left to the next term.
    """

    name: str
    width: int
    decode: Callable[[Column], Column]
    count: object = None
    stop: Callable[[Column], Column] | None = None
    encode: Callable[[Column], Column] | None = None
    valid: Callable[[Column], Column] | None = None
    least: int = 0
    most: int | None = None


@dataclass
class Choice:
    """The branch whose key equals `key` of the earlier fields; or without key, the first branch whose `test` of the bytes left holds.

    Each branch is a list of terms of fixed width and becomes a nullable struct; `<name>_branch` names the one taken. length: bytes that every branch takes up.
    """

    name: str
    branches: dict[str, list]
    key: Callable[[Fields], Column] | None = None
    tests: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    length: int | None = None


@dataclass
class Computed:
    """A value that isn't in the data, of the fields before it."""

    name: str
    value: Callable[[Fields], Column]


@dataclass
class Assert:
    """A test of the fields; where it isn't true, the record has the message as an error."""

    test: Callable[[Fields], Column]
    message: str


#: Items of a `Repeated` whose places a fold gathers at a time.
BLOCK = 64

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def _slice(data: Column, at, length) -> Column:
    return cut(data, at, length)


def _fixed(terms: list) -> int:
    return sum(t.length if isinstance(t, (Element, Skip)) else t.width * t.count for t in terms)


def parse(df: DataFrame, payload: str, layout: list, out: str = "record", mode: str = "PERMISSIVE", validate: bool = True) -> DataFrame:
    """df with the payload's fields as struct `out` and its errors as array `<out>_errors`; other columns stay.

    Fields that can't be read are null and reported. PERMISSIVE keeps all rows, DROPMALFORMED drops those with errors, FAILFAST raises at the first.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    made, given = 0, df.columns
    taken = {c.lower() for c in given}

    def helper(value: Column, barrier: bool = False) -> Column:
        """A column of its own for value. barrier: no filter is pushed through it, as that would put the value, and the payload's making, into the filter once for each mention."""
        nonlocal df, made
        made += 1
        while (name := f"_{out}_{made}").lower() in taken:
            made += 1
        df = df.withColumn(name, F.explode(F.array(value)) if barrier else value)
        return F.col(name)

    data = F.col(payload)
    fields: Fields = {}
    shown: list[str] = []
    errors: list[Column] = []
    at: int | Column = 0

    def step(length) -> None:
        nonlocal at
        at = at + length if isinstance(at, int) and isinstance(length, int) else helper(at + length)

    def unordered(elements: list, put: Callable) -> None:
        """As many rounds as there are elements: each takes the element whose initiator stands here and hasn't been before."""
        rounds = []
        for _ in elements:
            which = F.lit(None).cast("string")
            for e in elements:
                mark = e.initiator.encode()
                new = F.coalesce(_slice(data, at, len(mark)) == F.lit(mark), F.lit(False))
                for before, _part in rounds:
                    new = new & (F.coalesce(before, F.lit("")) != e.name)
                which = F.coalesce(which, F.when(new, e.name))
            which = helper(which)
            part, move = F.lit(None).cast("binary"), F.lit(0)
            for e in elements:
                own = at + len(e.initiator.encode())
                if isinstance(e.length, Delimited):
                    rest = F.decode(F.substring(data, F.lit(own + 1) if isinstance(own, int) else own + 1, F.octet_length(data)), "iso-8859-1")
                    upto = F.length(F.regexp_extract(rest, f"(?s)^(?:(?!{e.length.regex}).)*+", 0))
                    end = F.length(F.regexp_extract(rest, f"(?s)^(?:(?!{e.length.regex}).)*+(?:{e.length.regex})?", 0))
                else:
                    upto = end = F.lit(e.length)
                part = F.when(which == e.name, _slice(data, own, upto)).otherwise(part)
                move = F.when(which == e.name, end + len(e.initiator.encode())).otherwise(move)
            rounds.append((which, helper(part)))
            step(move)
        for e in elements:
            put(e.name, e.decode(F.coalesce(*[F.when(which == e.name, part) for which, part in rounds])), e.hidden)
            if not e.optional:
                here = F.lit(False)
                for which, part in rounds:
                    here = here | F.coalesce((which == e.name) & part.isNotNull(), F.lit(False))
                errors.append(F.when(~here, F.lit(f"{e.name}: missing")))

    def repeated(term: Repeated, fields: Fields, put: Callable) -> None:
        """Items one after the other: a fold finds their places, in blocks so that an item costs a copy of few places before it, then all are decoded."""
        start = (F.lit(at) if isinstance(at, int) else at).cast("int")
        size = F.octet_length(data)
        n = term.count(fields) if callable(term.count) else F.lit(term.count) if term.count is not None else F.greatest(size - start, F.lit(0))
        n = helper(n.cast("int"))
        numbers = lambda upto: F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))

        def add(places: Column, _number: Column) -> Column:
            """One place more: the end of the item at the last; none where that is at the payload's end or can't be read."""
            here = F.element_at(places, -1)
            width = F.when(here < size, term.item(data, here)[1]).cast("bigint")
            end = lambda p, w: F.least(F.element_at(p, -1) + w, size + 1).cast("int")
            return F.aggregate(F.array(width), places, lambda p, w: F.when(w > 0, F.array_append(p, end(p, w))).otherwise(p))

        def block(state: Column, number: Column) -> Column:
            left = F.when(state["at"] < size, F.least(F.lit(BLOCK), n - (number - 1) * BLOCK)).otherwise(0)
            places = F.aggregate(numbers(left), F.array(state["at"]), add)
            return F.aggregate(F.array(places), state, lambda s, p: F.struct(F.element_at(p, -1).alias("at"), F.array_append(s["starts"], F.slice(p, F.lit(1), F.size(p) - 1)).alias("starts")))

        zero = F.struct(start.alias("at"), F.array().cast("array<array<int>>").alias("starts"))
        found = helper(F.aggregate(numbers(F.ceil(n / BLOCK).cast("int")), zero, block), barrier=True)
        items = helper(F.transform(F.flatten(found["starts"]), lambda p: term.item(data, p)[0].cast(term.kind)), barrier=True)
        short = found["at"] > size
        if term.count is not None:
            short = short | (F.size(items) < n)
        else:
            short = short | (found["at"] < size)
        errors.append(F.when(F.coalesce(short, F.lit(True)), F.lit(f"{term.name}: too short")))
        put(term.name, items)
        step(found["at"] - (F.lit(at) if isinstance(at, int) else at))

    def walk(terms: list, fields: Fields, shown: list[str]) -> None:
        nonlocal at

        def put(name: str, value: Column, hidden: bool = False) -> None:
            fields[name] = helper(value)
            if not hidden:
                shown.append(name)

        for term in terms:
            if isinstance(term, Skip):
                step(term.length)
            elif isinstance(term, Computed):
                put(term.name, term.value(fields))
            elif isinstance(term, Assert):
                errors.append(F.when(~F.coalesce(term.test(fields), F.lit(False)), F.lit(term.message)))
            elif isinstance(term, Group):
                inner, own = dict(fields), []
                walk(term.terms, inner, own)
                put(term.name, F.struct(*[inner[n].alias(n) for n in own]))
            elif isinstance(term, Unordered):
                unordered(term.elements, put)
            elif isinstance(term, Repeated):
                repeated(term, fields, put)
            elif isinstance(term, Array):
                n = term.count(fields) if callable(term.count) else F.lit(term.count) if term.count is not None else F.floor((F.octet_length(data) - at) / term.width)
                n = helper(n.cast("int"))
                whole = F.octet_length(data) >= (F.lit(at) if isinstance(at, int) else at) + n * term.width
                index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
                start = F.lit(at) if isinstance(at, int) else at
                items = F.transform(index, lambda i: term.decode(F.substring(data, start + i * term.width + 1, F.lit(term.width))))
                if term.valid is not None:
                    n = helper(F.least(n, F.lit(term.most)) if term.most is not None else n)
                    items = helper(F.slice(items, F.lit(1), F.greatest(n, F.lit(0))), barrier=True)
                    bad = F.array_position(F.transform(items, lambda x: ~F.coalesce(term.valid(x), F.lit(False))), True).cast("int")
                    n = helper(F.when(bad > 0, bad - 1).otherwise(F.size(items)))
                    items = F.slice(items, F.lit(1), n)
                    whole = n >= term.least
                if term.stop is not None:
                    flags = helper(F.transform(items, term.stop))
                    end = F.array_position(flags, True)
                    items = F.when(end > 0, F.slice(items, F.lit(1), (end - 1).cast("int"))).otherwise(items)
                errors.append(F.when(~F.coalesce(whole, F.lit(False)), F.lit(f"{term.name}: too short")))
                put(term.name, F.when(whole, items))
                step(F.greatest(n, F.lit(0)) * term.width if callable(term.count) or term.count is None or term.valid is not None else term.count * term.width)
            elif isinstance(term, Choice):
                keys = list(term.branches)
                if term.key is not None:
                    key = helper(term.key(fields).cast("string"))
                    chosen = {k: key == k for k in keys}
                else:
                    rest = F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.octet_length(data))
                    tests = [F.coalesce(term.tests[k](rest), F.lit(False)) for k in keys]
                    first = helper(F.coalesce(*[F.when(t, k) for k, t in zip(keys, tests)]))
                    chosen = {k: first == k for k in keys}
                size = F.lit(0)
                branch = F.when(F.lit(False), F.lit(""))
                for k, branch_terms in term.branches.items():
                    own, place = [], at
                    for t in branch_terms:
                        if isinstance(t, Element):
                            own.append(t.decode(_slice(data, place, t.length)).alias(t.name))
                        place = place + (t.length if not isinstance(t, Array) else t.width * t.count)
                    put(f"{term.name}_{k}", F.when(chosen[k], F.struct(*own)))
                    branch = branch.when(chosen[k], k)
                    size = F.when(chosen[k], term.length if term.length is not None else _fixed(branch_terms)).otherwise(size)
                put(f"{term.name}_branch", branch)
                errors.append(F.when(fields[f"{term.name}_branch"].isNull(), F.lit(f"{term.name}: no branch")))
                step(term.length if term.length is not None else size)
            else:
                if term.align > 1:
                    if isinstance(at, int):
                        at = -(-at // term.align) * term.align
                    else:
                        at = helper((F.ceil(at / term.align) * term.align).cast("int"))
                start, there = F.lit(at) if isinstance(at, int) else at, None
                if term.initiator is not None:
                    size = len(term.initiator.encode())
                    marked = F.coalesce(_slice(data, at, size) == F.lit(term.initiator.encode()), F.lit(False))
                    if term.optional:
                        there = helper(marked)
                        step(F.when(there, size).otherwise(0))
                    else:
                        errors.append(F.when(~marked, F.lit(f"{term.name}: no initiator")))
                        step(size)
                    start = F.lit(at) if isinstance(at, int) else at
                length = term.length
                if isinstance(length, int):
                    part, move = _slice(data, at, length), length
                elif isinstance(length, Prefixed):
                    n = helper((length.read(_slice(data, at, length.size)) - (length.size if length.includes_prefix else 0)).cast("int"))
                    part, move = _slice(data, start + length.size, n), F.coalesce(n, F.lit(0)) + length.size
                elif isinstance(length, Rest):
                    part, move = F.substring(data, start + 1, F.octet_length(data)), F.greatest(F.octet_length(data) - start, F.lit(0))
                elif isinstance(length, (Pattern, Delimited)):
                    rest = F.decode(F.substring(data, start + 1, F.octet_length(data)), "iso-8859-1")
                    if isinstance(length, Pattern):
                        n = helper(F.length(F.regexp_extract(rest, f"^(?:{length.regex})", 0)))
                        part, move = _slice(data, start, n), n
                    else:
                        n = helper(F.length(F.regexp_extract(rest, f"(?s)^(?:(?!{length.regex}).)*+", 0)))  # possessive: takes no stack
                        part, move = F.substring(data, start + 1, n), n + F.length(F.regexp_extract(F.substring(rest, n + 1, F.length(rest)), f"^(?:{length.regex})", 0))
                else:
                    n = helper(length(fields).cast("int"))
                    part, move = _slice(data, start, n), F.coalesce(n, F.lit(0))
                value = term.decode(part)
                if term.optional:
                    if there is None:
                        value = helper(value)
                        there = helper(value.isNotNull())
                    value, move = F.when(there, value), F.when(there, move).otherwise(0)
                put(term.name, F.coalesce(value, F.lit(term.default)) if term.default is not None else value, term.hidden)
                errors.append(F.when(part.isNull() & (there if there is not None else F.lit(True)), F.lit(f"{term.name}: too short")))
                if validate and term.facets is not None:
                    errors.extend(term.facets.failures(fields[term.name], term.name))
                step(move)

    walk(layout, fields, shown)
    found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")
    names = [c for c in given if c.lower() not in (out.lower(), f"{out}_errors".lower())]
    df = df.select(*names, F.struct(*[fields[n].alias(n) for n in shown]).alias(out), found.alias(f"{out}_errors"))
    if mode == "DROPMALFORMED":
        return df.where(F.size(f"{out}_errors") == 0)
    if mode == "FAILFAST":
        checked = F.when(F.size(f"{out}_errors") > 0, F.raise_error(F.concat(F.lit("malformed record: "), F.array_join(f"{out}_errors", "; ")))).otherwise(F.col(out))
        return df.withColumn(out, checked)
    return df


def build(layout: list, values: Fields) -> Column:
    """The payload of values, by the elements' `encode`: lengths, initiators, delimiters, fill and alignment are written as they are read.

    A null value takes the element's default; without one the payload is null.
    """
    parts: list[Column] = []
    size: int | Column = 0

    def add(part: Column, n) -> None:
        nonlocal size
        parts.append(part)
        size = size + n

    for term in layout:
        if isinstance(term, (Computed, Assert)):
            continue
        if isinstance(term, Skip):
            add(F.lit((term.fill * term.length)[: term.length]), term.length)
        elif isinstance(term, Array):
            whole = F.aggregate(F.transform(values[term.name], lambda x: F.hex(term.encode(x))), F.lit(""), lambda a, x: F.concat(a, x))
            add(F.unhex(whole), F.size(values[term.name]) * term.width)
        elif isinstance(term, Choice):
            raise ValueError("a choice is built branch by branch")
        else:
            if term.align > 1:
                fill = F.pmod(F.lit(0) - size, F.lit(term.align)) if isinstance(size, Column) else -size % term.align
                add(F.unhex(F.repeat(F.lit("00"), fill.cast("int"))) if isinstance(fill, Column) else F.lit(b"\x00" * fill), fill)
            if term.initiator:
                add(F.lit(term.initiator.encode()), len(term.initiator.encode()))
            value = values[term.name]
            part = term.encode(F.coalesce(value, F.lit(term.default)) if term.default is not None else value)
            if isinstance(term.length, Prefixed):
                add(term.length.write(F.octet_length(part) + (term.length.size if term.length.includes_prefix else 0)), term.length.size)
            add(part, term.length if isinstance(term.length, int) else F.octet_length(part))
            if isinstance(term.length, Delimited):
                add(F.lit(term.length.text.encode()), len(term.length.text.encode()))
    return F.concat(*parts)
