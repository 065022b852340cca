"""Registered queries of the format operators: each packs a table's rows as payloads with built-in functions, reads them back
with the operator, and has SQL over the table itself to be held against."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions import binary as B
from bitloom.functions import text as X
from bitloom.functions.expressions import call
from bitloom.functions.facets import Facets
from bitloom.operators import infoset as I
from bitloom.operators import layers as Y
from bitloom.operators import layout as L
from bitloom.plans import payloads as P
from bitloom.sources import pcap
from bitloom.streaming import framing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(c: Column) -> Column:
    return F.encode(c, "utf-8")


def text(part: Column) -> Column:
    return F.decode(part, "utf-8")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def number(length: int, little: bool = False, signed: bool = False):
    """Decoder of an integer that fills its bytes."""
    return lambda part: B.whole(part, length, little, signed)


@F.pandas_udf(T.BinaryType())
def _pack_doubles(column: pd.Series) -> pd.Series:
    raw = column.to_numpy(np.float64).astype(">f8").tobytes()
    return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _pack_floats(column: pd.Series) -> pd.Series:
    raw = column.to_numpy(np.float64).astype("<f4").tobytes()
    return pd.Series([raw[i : i + 4] for i in range(0, len(raw), 4)], dtype=object)


# -- fixed binary ---------------------------------------------------------------------------------


def _line(little: bool) -> list:
    return [
        L.Element("orderkey", 8, number(8, little, True), lambda c: B.put_sint(c, 8, little)),
        L.Element("partkey", 4, number(4, little), lambda c: B.put_uint(c, 4, little)),
        L.Element("linenumber", 2, number(2, little), lambda c: B.put_uint(c, 2, little)),
        L.Skip(2, b"X"),
        L.Element("cents", 5, number(5, little), lambda c: B.put_uint(c, 5, little)),
        L.Element("flag", 1, text, utf8),
    ]


def _lines(spark: SparkSession, sf_dir: str, little: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    values = {"orderkey": F.col("l_orderkey"), "partkey": F.col("l_partkey"), "linenumber": F.col("l_linenumber"), "cents": cents(F.col("l_extendedprice")), "flag": F.col("l_returnflag")}
    return L.parse(rows.select(L.build(_line(little), values).alias("payload")), "payload", _line(little)).select("record.*")


_LINES_SQL = """SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orderkeys, CAST(sum(l_partkey) AS BIGINT) AS partkeys,
CAST(sum(l_linenumber) AS BIGINT) AS linenumbers, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1"""


def _line_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("flag").agg(F.count("*").alias("n"), *(F.sum(c).cast("bigint").alias(c + "s" if c != "cents" else c) for c in ("orderkey", "partkey", "linenumber", "cents")))


@query(_LINES_SQL)
def fixed_be_ints(spark, sf_dir):
    return _line_sums(_lines(spark, sf_dir))


@query(_LINES_SQL)
def fixed_le_ints(spark, sf_dir):
    return _line_sums(_lines(spark, sf_dir, True))


@query("SELECT l_orderkey % 1048576 AS a, CAST(l_linenumber AS BIGINT) AS b, l_suppkey % 65536 AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def bit_fields(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(B.put_bits([(F.col("l_orderkey") % 1048576, 20), (F.col("l_linenumber"), 4), (F.col("l_suppkey") % 65536, 16), (F.lit(5), 8)]).alias("p"))
    d = F.col("p")
    return p.select(B.bits(d, 0, 20).alias("a"), B.bits(d, 20, 4).alias("b"), B.bits(d, 24, 16).alias("c")).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS be, CAST(round(c_acctbal * 100) AS BIGINT) AS le, (c_custkey % 8) - (CASE WHEN c_custkey % 8 >= 4 THEN 8 ELSE 0 END) AS three_bits FROM customer")
def signed_ints(spark, sf_dir):
    v = cents(F.col("c_acctbal"))
    p = table(spark, sf_dir, "customer").select("c_custkey", F.concat(B.put_sint(v, 4), B.put_sint(v, 5, True), B.put_uint(F.col("c_custkey") % 8, 1)).alias("p"))
    d = F.col("p")
    return p.select("c_custkey", B.sint(d, 0, 4).alias("be"), B.sint(d, 4, 5, True).alias("le"), B.signed_bits(d, 77, 3).alias("three_bits"))


@query("SELECT o_orderkey, o_totalprice AS price, -o_totalprice / 1e6 AS small, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS single FROM orders")
def float_ieee(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(_pack_doubles("o_totalprice"), _pack_doubles(-F.col("o_totalprice") / 1e6), _pack_floats("o_totalprice")).alias("p"))
    d = F.col("p")
    return p.select("o_orderkey", B.ieee(d, 0, 8).alias("price"), B.ieee(d, 8, 8).alias("small"), B.ieee(d, 16, 4, True).cast("double").alias("single"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS packed, CAST(round(c_acctbal * 100) AS BIGINT) AS ibm4690, c_custkey AS bcd, CAST(round(c_acctbal * 100) AS BIGINT) AS zoned, CAST(round(c_acctbal * 100) AS BIGINT) AS zoned_ebcdic FROM customer")
def decimals(spark, sf_dir):
    v = cents(F.col("c_acctbal"))
    t = table(spark, sf_dir, "customer").select("c_custkey", B.put_packed(v, 6).alias("a"), B.put_ibm4690(v, 6).alias("b"), B.put_bcd(F.col("c_custkey"), 5).alias("c"), X.put_zoned(v, 9).alias("d"), X.put_zoned(v, 9, "translated_ebcdic").alias("e"))
    decoded = {"packed": B.packed(F.col("a")), "ibm4690": B.ibm4690(F.col("b")), "bcd": B.bcd(F.col("c")), "zoned": X.zoned(F.col("d")), "zoned_ebcdic": X.zoned(F.col("e"), "translated_ebcdic")}
    return t.select("c_custkey", *[c.cast("bigint").alias(k) for k, c in decoded.items()])


@query("SELECT s_suppkey, CAST(round(s_acctbal * 100) / 100 AS DOUBLE) AS balance FROM supplier")
def virtual_point(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", B.put_packed(cents(F.col("s_acctbal")), 6).alias("p"))
    return t.select("s_suppkey", B.packed(F.col("p"), 2).cast("double").alias("balance"))


@query("SELECT p_partkey, p_size > 25 AS large, p_size % 2 = 0 AS even, upper(to_hex(p_size::BIGINT)) AS hex FROM part")
def bool_and_hex(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(B.put_uint(F.when(F.col("p_size") > 25, 7).otherwise(0), 1), utf8(F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no ")), B.put_uint(F.col("p_size"), 1)).alias("p"))
    d = F.col("p")
    return t.select("p_partkey", B.boolean(B.uint(d, 0, 1), 7, 0).alias("large"), X.boolean(F.rtrim(text(B.cut(d, 1, 3))), ["YES"], ["NO"], True).alias("even"), F.ltrim(F.hex(B.cut(d, 4, 1)), F.lit("0")).alias("hex"))


@query("SELECT CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CASE WHEN p_size BETWEEN 3 AND 20 THEN 'few' WHEN p_size BETWEEN 21 AND 40 THEN 'many' ELSE 'other' END END AS name, count(*) AS n FROM part GROUP BY 1")
def enum_values_ranges(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(B.put_uint(F.col("p_size"), 2).alias("p"))
    return t.select(F.coalesce(B.enumerated(B.uint(F.col("p"), 0, 2), {1: "one", 2: "two"}, [(3, 20, "few"), (21, 40, "many")]), F.lit("other")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# -- choices ------------------------------------------------------------------------------------------

_EVENT_SQL = """SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'purchase' ELSE 'other' END AS branch,
CASE WHEN event_type = 'click' THEN user_id END AS click_user, CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END AS purchase_cents,
CASE WHEN event_type NOT IN ('click', 'purchase') THEN event_type[1] END AS other_kind FROM events"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    body = F.when(kind == "click", F.concat(F.lit(b"C"), B.put_uint(F.col("user_id"), 6))).when(kind == "purchase", F.concat(F.lit(b"P"), B.put_sint(cents(F.col("value")), 6))).otherwise(F.concat(F.lit(b"O"), utf8(F.substring(kind, 1, 1)), F.lit(b"\x00" * 5)))
    return table(spark, sf_dir, "events").select("event_id", body.alias("payload"))


_BRANCHES = {
    "click": [L.Element("user", 6, number(6))],
    "purchase": [L.Element("cents", 6, number(6, signed=True))],
    "other": [L.Element("kind", 1, text), L.Skip(5)],
}


def _branches(df: DataFrame) -> DataFrame:
    r = "record.body_"
    return df.select("event_id", F.col(r + "branch").alias("branch"), F.col(r + "click.user").alias("click_user"), F.col(r + "purchase.cents").alias("purchase_cents"), F.col(r + "other.kind").alias("other_kind"))


@query(_EVENT_SQL)
def dispatch_choice(spark, sf_dir):
    key = lambda f: F.when(f["tag"] == 67, "click").when(f["tag"] == 80, "purchase").when(f["tag"] == 79, "other")
    return _branches(L.parse(_events(spark, sf_dir), "payload", [L.Element("tag", 1, number(1), hidden=True), L.Choice("body", _BRANCHES, key=key, length=6)]))


@query(_EVENT_SQL)
def initiated_choice(spark, sf_dir):
    branches = {k: [L.Element("initiator", 1, text), *v] for k, v in _BRANCHES.items()}
    tests = {k: (lambda c: lambda rest: F.substring(rest, 1, 1) == F.lit(c))(c) for k, c in (("click", b"C"), ("purchase", b"P"), ("other", b"O"))}
    return _branches(L.parse(_events(spark, sf_dir), "payload", [L.Choice("body", branches, tests=tests)]))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'digits' WHEN c_custkey % 3 = 1 THEN 'word' ELSE 'raw' END AS branch, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10000 END AS digits, c_nationkey AS after FROM customer")
def speculative_choice(spark, sf_dir):
    k = F.col("c_custkey")
    part = F.when(k % 3 == 0, utf8(F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 3 == 1, F.lit(b"abcd")).otherwise(F.lit(b"\xff\xfe\xfd\xfc"))
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(part, B.put_uint(F.col("c_nationkey"), 1)).alias("payload"))
    digits = lambda p: text(p).try_cast("bigint")
    branches = {"digits": [L.Element("value", 4, digits)], "word": [L.Element("value", 4, text)], "raw": [L.Element("value", 4, lambda p: p)]}
    tests = {"digits": lambda r: F.hex(F.substring(r, 1, 4)).rlike("^(3[0-9]){4}$"), "word": lambda r: F.hex(F.substring(r, 1, 4)).rlike("^([46][1-9A-F]|[57][0-9A])+$"), "raw": lambda r: F.octet_length(r) > 0}
    d = L.parse(t, "payload", [L.Choice("body", branches, tests=tests), L.Element("after", 1, lambda p: B.uint(p, 0, 1).cast("int"))])
    return d.select("c_custkey", F.col("record.body_branch").alias("branch"), F.col("record.body_digits.value").alias("digits"), F.col("record.after").alias("after"))


# -- occurrences ----------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))


def _bytes(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("bigint")), 4, "0")), ""))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(max(l_linenumber) AS BIGINT) AS last, 7 AS after FROM lineitem GROUP BY 1")
def occurs_expression(spark, sf_dir):
    t = _orders(spark, sf_dir).select("l_orderkey", F.concat(B.put_uint(F.size("lines"), 1), _bytes(F.col("lines")), F.lit(b"\x07")).alias("payload"))
    layout = [L.Element("n", 1, number(1)), L.Array("items", 2, number(2), count=lambda f: f["n"]), L.Element("after", 1, lambda p: B.uint(p, 0, 1).cast("int"))]
    d = L.parse(t, "payload", layout)
    items = F.col("record.items")
    return d.select("l_orderkey", F.col("record.n").alias("n"), F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max(items).alias("last"), F.col("record.after").alias("after"))


@query("SELECT l_orderkey, count(*) AS filled, count(*) FILTER (l_linenumber < 3) AS before_three FROM lineitem GROUP BY 1")
def occurs_parsed_and_stop(spark, sf_dir):
    t = _orders(spark, sf_dir).select("l_orderkey", _bytes("lines").alias("payload"))
    a = L.parse(t, "payload", [L.Array("items", 2, number(2))], "filled")
    b = L.parse(a, "payload", [L.Array("items", 2, number(2), stop=lambda x: x >= 3)], "stopped")
    return b.select("l_orderkey", F.size("filled.items").cast("bigint").alias("filled"), F.size("stopped.items").cast("bigint").alias("before_three"))


@query("SELECT s_suppkey, s_suppkey % 100 AS first, s_nationkey AS second, CAST(1 AS BIGINT) AS position FROM supplier")
def occurs_fixed(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(B.put_uint(F.col("s_suppkey") % 100, 2), B.put_uint(F.col("s_nationkey"), 2)).alias("payload"))
    d = L.parse(t, "payload", [L.Array("pair", 2, number(2), count=2)])
    p = F.col("record.pair")
    return d.select("s_suppkey", F.element_at(p, 1).alias("first"), F.element_at(p, 2).cast("int").alias("second"), F.array_position(F.transform(p, lambda x, i: i), 0).alias("position"))


# -- delimiters --------------------------------------------------------------------------------------------

_CUSTOMER = "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer"


def _fields(df: DataFrame, fields: Column) -> DataFrame:
    return df.select("c_custkey", fields.alias("f")).select("c_custkey", F.element_at("f", 1).alias("name"), F.element_at("f", 2).alias("segment"), F.element_at("f", 3).cast("int").alias("nation"))


def _joined(spark: SparkSession, sf_dir: str, join) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", join("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("t"))


@query(_CUSTOMER)
def sep_infix(spark, sf_dir):
    return _fields(_joined(spark, sf_dir, lambda *c: F.concat_ws("|", *c)), X.split_fields(F.col("t"), X.delimiter("|")))


@query(_CUSTOMER)
def sep_prefix_postfix(spark, sf_dir):
    d = _joined(spark, sf_dir, lambda a, b, c: F.concat(F.lit("\t"), F.concat_ws("\t", a, b, c), F.lit("\r\n")))
    body = F.regexp_replace(F.regexp_replace("t", "^" + X.delimiter("%HT;"), ""), X.delimiter("%NL;") + "$", "")
    return _fields(d, X.split_fields(body, X.delimiter("%HT;")))


@query(_CUSTOMER)
def sep_alternatives(spark, sf_dir):
    d = _joined(spark, sf_dir, lambda a, b, c: F.concat(a, F.lit(";;"), b, F.lit(" End "), c))
    return _fields(d, X.split_fields(F.col("t"), "(?i:" + X.delimiter("; ;; %WSP+;END%WSP+;") + ")"))


@query("""SELECT o_orderkey, p.policy, p.policy = 'never' OR o_orderkey % 3 <> 2 OR p.policy <> 'trailingEmptyStrict' AS fits, o_orderstatus AS first,
CASE WHEN p.policy = 'anyEmpty' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'x' END WHEN o_orderkey % 3 = 2 AND p.policy = 'trailingEmptyStrict' THEN NULL END AS second,
CASE WHEN p.policy <> 'anyEmpty' AND o_orderkey % 3 = 0 THEN 'x' END AS third
FROM orders, (SELECT unnest(['never', 'trailingEmpty', 'trailingEmptyStrict', 'anyEmpty']) AS policy) p""")
def sep_suppression(spark, sf_dir):
    """Three fields, the second empty and the third in one of three orders, written and read by each policy; one order has an end that the strict policy forbids."""
    t = table(spark, sf_dir, "orders").withColumn("third", F.when(F.col("o_orderkey") % 3 == 0, "x"))
    fields = [F.col("o_orderstatus"), F.lit(""), F.col("third")]
    out = None
    for policy in X.SUPPRESSION:
        line = X.joined_with_suppression(fields, ",", policy)
        if policy == "trailingEmptyStrict":
            line = F.when(F.col("o_orderkey") % 3 == 2, F.concat(line, F.lit(","))).otherwise(line)
        got = X.with_suppression(F.split(line, ",", -1), policy, 3)
        one = t.select("o_orderkey", "o_orderstatus", F.lit(policy).alias("policy"), got.alias("f"))
        out = one if out is None else out.union(one)
    return out.select("o_orderkey", "policy", F.col("f").isNotNull().alias("fits"), F.coalesce(F.col("f")[0], F.col("o_orderstatus")).alias("first"), F.col("f")[1].alias("second"), F.col("f")[2].alias("third"))


@query("SELECT c_custkey, c_name || ',' || c_mktsegment AS name, '\"' || c_mktsegment || '\"' AS segment, c_nationkey AS nation FROM customer")
def escape_character(spark, sf_dir):
    c = lambda a, b, n: F.concat_ws(",", X.escaped(F.concat_ws(",", a, b), ",", "\\"), X.escaped(F.concat(F.lit('"'), F.col(b), F.lit('"')), ",", "\\"), n)
    return _fields(_joined(spark, sf_dir, c), X.split_fields(F.col("t"), ",", escape="\\"))


@query("SELECT c_custkey, c_name || ',' || c_mktsegment AS name, '\"' || c_mktsegment || '\"' AS segment, c_nationkey AS nation FROM customer")
def escape_block(spark, sf_dir):
    c = lambda a, b, n: F.concat_ws(",", X.quoted(F.concat_ws(",", a, b), ","), X.quoted(F.concat(F.lit('"'), F.col(b), F.lit('"')), ","), n)
    return _fields(_joined(spark, sf_dir, c), X.split_fields(F.col("t"), ",", quote='"'))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def init_term_delimited(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(b"N:"), utf8("n_name"), F.lit(b"//R="), utf8(F.col("n_regionkey").cast("string")), F.lit(b";")).alias("payload"))
    layout = [L.Element("name", L.Delimited("//", "//"), text, initiator="N:"), L.Element("region", L.Delimited(";", ";"), lambda p: text(p).cast("int"), initiator="R=")]
    return L.parse(t, "payload", layout).select("n_nationkey", "record.name", "record.region")


@query("SELECT n_nationkey, n_name AS prefixed, n_name AS inclusive, regexp_extract(n_name, '^[A-Z]*[A-Za-z]', 0) AS pattern, substring(n_name, 1, n_regionkey + 1) AS sized, 'end' AS rest FROM nation")
def length_kinds(spark, sf_dir):
    size = F.length("n_name")
    word = F.regexp_extract("n_name", "^[A-Z]*[A-Za-z]", 0)
    payload = F.concat(B.put_uint(size, 2), utf8("n_name"), B.put_uint(size + 1, 1), utf8("n_name"), utf8(word), F.lit(b"#"), B.put_uint(F.col("n_regionkey") + 1, 1), utf8(F.substring("n_name", F.lit(1), (F.col("n_regionkey") + 1).cast("int"))), F.lit(b"end"))
    layout = [
        L.Element("prefixed", L.Prefixed(2, number(2)), text),
        L.Element("inclusive", L.Prefixed(1, number(1), True), text),
        L.Element("pattern", L.Pattern("[A-Za-z]+"), text),
        L.Skip(1),
        L.Element("k", 1, number(1), hidden=True),
        L.Element("sized", lambda f: f["k"], text),
        L.Element("rest", L.Rest(), text),
    ]
    return L.parse(table(spark, sf_dir, "nation").select("n_nationkey", payload.alias("payload")), "payload", layout).select("n_nationkey", "record.*")


@query("SELECT r_regionkey, r_name AS name, r_regionkey AS aligned FROM region")
def alignment_skip(spark, sf_dir):
    layout = [L.Skip(3), L.Element("name", L.Delimited("\\.", "."), text, utf8), L.Element("aligned", 4, lambda p: B.uint(p, 0, 4).cast("int"), lambda c: B.put_uint(c, 4), align=4)]
    t = table(spark, sf_dir, "region").select("r_regionkey", L.build(layout, {"name": F.col("r_name"), "aligned": F.col("r_regionkey")}).alias("payload"))
    return L.parse(t, "payload", layout).select("r_regionkey", "record.*")


# -- checks -----------------------------------------------------------------------------------------------


@query("SELECT count(*) AS valid, (SELECT count(*) FROM lineitem WHERE l_quantity > 45) AS too_many, (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) AS bad_flag FROM lineitem WHERE l_quantity <= 45 AND l_returnflag IN ('A', 'N')")
def facets_asserts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.concat(B.put_uint(F.col("l_quantity"), 1), utf8("l_returnflag")).alias("payload"))
    layout = [L.Element("quantity", 1, number(1), facets=Facets(max_inclusive=45)), L.Element("flag", 1, text, facets=Facets(pattern="[A-Z]", length=1)), L.Assert(lambda f: f["flag"].isin("A", "N"), "flag")]
    e = L.parse(t, "payload", layout).select("record_errors")
    has = lambda m: F.count_if(F.array_contains("record_errors", m))
    return e.agg(F.count_if(F.size("record_errors") == 0).alias("valid"), has("quantity: maxInclusive").alias("too_many"), has("flag").alias("bad_flag"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1")
def drop_malformed(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") <= 5, F.concat(utf8("l_returnflag"), B.put_uint(F.col("l_linenumber"), 2))).otherwise(utf8("l_returnflag")).alias("payload"))
    d = L.parse(t, "payload", [L.Element("flag", 1, text), L.Element("line", 2, number(2))], mode="DROPMALFORMED")
    return d.groupBy(F.col("record.flag").alias("flag")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size <= 30 AND p_brand LIKE 'Brand#1%' AND length(p_type) >= 4 AS ok FROM part")
def check_constraints(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    ok = Facets(max_inclusive=30).hold(F.col("p_size")) & Facets(pattern="Brand#1.*").hold(F.col("p_brand")) & Facets(min_length=4).hold(F.col("p_type"))
    return t.select("p_partkey", ok.alias("ok"))


# -- nested and repeating records ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, length(o_orderpriority) AS size, o_orderpriority AS priority FROM orders")
def nested_complex(spark, sf_dir):
    """A header struct with a struct of its own inside, then a body whose length stands in the header."""
    layout = [
        L.Group("header", [L.Element("id", 5, number(5)), L.Group("party", [L.Element("customer", 4, number(4)), L.Element("status", 1, text)]), L.Element("size", 1, number(1))]),
        L.Element("priority", lambda f: f["header"]["size"], text),
    ]
    body = F.concat(B.put_uint(F.col("o_orderkey"), 5), B.put_uint(F.col("o_custkey"), 4), utf8("o_orderstatus"), B.put_uint(F.octet_length("o_orderpriority"), 1), utf8("o_orderpriority"))
    r = L.parse(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("payload")), "payload", layout)
    h = "record.header"
    return r.select("o_orderkey", f"{h}.id", f"{h}.party.customer", f"{h}.party.status", F.col(f"{h}.size").alias("size"), "record.priority")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_returnflag AS flag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def repeated_structs(spark, sf_dir):
    """Lines of an order as a counted array of structs of varying width: number, flag and a text with its length before it."""
    quantity = utf8(F.col("l_quantity").cast("bigint").cast("string"))
    line = F.hex(F.concat(B.put_uint(F.col("l_linenumber"), 4), utf8("l_returnflag"), B.put_uint(F.octet_length(quantity), 1), quantity))
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    packed = orders.select(F.concat(B.put_uint(F.col("l_orderkey"), 5), B.put_uint(F.size("lines"), 4), F.unhex(F.array_join("lines", ""))).alias("payload"))

    def item(data, at):
        size = B.uint(data, at + 5, 1)
        return F.struct(B.uint(data, at, 4).cast("int").alias("linenumber"), text(B.cut(data, at + 4, 1)).alias("flag"), text(B.cut(data, at + 6, size)).alias("quantity")), size + 6

    layout = [L.Element("orderkey", 5, number(5)), L.Element("count", 4, number(4)), L.Repeated("lines", "struct<linenumber:int,flag:string,quantity:string>", item, lambda f: f["count"])]
    r = L.parse(packed, "payload", layout).where(F.size("record_errors") == 0)
    return r.select("record.orderkey", F.inline("record.lines")).groupBy("orderkey", "linenumber", "flag", "quantity").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS occurs FROM customer")
def csv_rows(spark, sf_dir):
    """A text file a nation: a header of names and a row a customer, read as one payload into an array of rows with their occurrence index."""
    row = F.concat_ws(",", F.lpad(F.col("c_custkey").cast("string"), 12, "0"), X.quoted(F.col("c_name"), ","), "c_mktsegment")
    files = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    files = files.select("nation", utf8(F.concat(F.lit("key,name,segment\n"), "rows")).alias("payload"))
    layout = [L.Element("names", L.Delimited(X.delimiter("%NL;"), "\n"), lambda p: X.split_fields(text(p), ",")), L.Element("rows", L.Rest(), lambda p: F.transform(F.split(text(p), "\n", -1), lambda x: X.split_fields(x, ",", quote='"')))]
    r = L.parse(files, "payload", layout, mode="FAILFAST").select("nation", "record.names", F.posexplode("record.rows").alias("at", "row"))
    r = r.select("nation", F.map_from_arrays("names", "row").alias("m"), (F.col("at") + 1).alias("occurs"))
    return r.select("nation", F.col("m")["key"].cast("bigint").alias("key"), F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), "occurs")


@query("SELECT o_orderkey, CAST(least(o_orderkey % 5, 3) AS INTEGER) AS digits, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 4 THEN '7' END AS digit, o_orderpriority AS rest FROM orders")
def occurs_implicit(spark, sf_dir):
    """At most three digits, an optional element by its initiator, an optional one by what decodes, and the rest."""
    digits = F.repeat(F.lit("7"), (F.col("o_orderkey") % 5).cast("int"))
    over = F.when(F.length(digits) > 3, F.substring(digits, 4, 1)).otherwise("")
    status = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S="), "o_orderstatus")).otherwise("")
    t = table(spark, sf_dir, "orders").select("o_orderkey", utf8(F.concat(F.substring(digits, 1, 3), F.lit("|"), status, over, F.lit("!"), "o_orderpriority")).alias("payload"))
    digit = lambda p: F.when(text(p).rlike("^[0-9]$"), text(p))
    layout = [
        L.Array("digits", 1, text, valid=lambda x: x.rlike("^[0-9]$"), most=3),
        L.Skip(1),
        L.Element("status", 1, text, initiator="S=", optional=True),
        L.Element("digit", 1, digit, optional=True),
        L.Element("rest", L.Rest(), text, initiator="!"),
    ]
    r = L.parse(t, "payload", layout, mode="FAILFAST")
    return r.select("o_orderkey", F.size("record.digits").alias("digits"), "record.status", "record.digit", "record.rest")


@query("SELECT s_suppkey, s_suppkey AS key, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS nation, CASE WHEN s_suppkey % 7 = 0 THEN 'name: missing' ELSE '' END AS errors FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS s_name, s_nationkey FROM supplier)")
def unordered_sequence(spark, sf_dir):
    """Three elements in an order that turns from row to row; one of them optional, and the name lacks at times."""
    key, name = F.concat(F.lit("K"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")), F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("N:"), "s_name", F.lit(";"))).otherwise("")
    nation = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("C:"), F.col("s_nationkey").cast("string"), F.lit(";"))).otherwise("")
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(key, name, nation)).otherwise(F.concat(nation, name, key))
    end = L.Delimited(";", ";")
    layout = [L.Unordered([L.Element("key", 8, lambda p: text(p).cast("bigint"), initiator="K"), L.Element("name", end, text, initiator="N:"), L.Element("nation", end, lambda p: text(p).cast("int"), initiator="C:", optional=True)])]
    r = L.parse(table(spark, sf_dir, "supplier").select("s_suppkey", utf8(line).alias("payload")), "payload", layout)
    return r.select("s_suppkey", "record.*", F.array_join("record_errors", ";").alias("errors"))


# -- text values ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(-round(o_totalprice * 100) AS BIGINT) AS minus, CAST(round(o_totalprice * 100) AS BIGINT) AS virtual, format('{:,.2f}', round(o_totalprice * 100) / 100.0) AS printed FROM orders")
def number_patterns(spark, sf_dir):
    price = (cents(F.col("o_totalprice")) / 100).cast("decimal(18,2)")
    a, b, v = X.NumberPattern("#,##0.00"), X.NumberPattern("#,##0.00;(#,##0.00)"), X.NumberPattern("0000000V00")
    t = table(spark, sf_dir, "orders").select("o_orderkey", a.format(price).alias("a"), b.format(-price).alias("b"), v.format(price).alias("v"))
    whole = lambda c: (c * 100).cast("bigint")
    return t.select("o_orderkey", whole(a.parse(F.col("a"))).alias("cents"), whole(b.parse(F.col("b"))).alias("minus"), whole(v.parse(F.col("v"))).alias("virtual"), F.col("a").alias("printed"))


@query("""SELECT m.mode, CAST(sum(CASE m.mode WHEN 'up' THEN ceil(abs(x)) * sign(x) WHEN 'down' THEN trunc(x) WHEN 'ceiling' THEN ceil(x) WHEN 'floor' THEN floor(x)
WHEN 'half_up' THEN floor(abs(x) + 0.5) * sign(x) WHEN 'half_down' THEN ceil(abs(x) - 0.5) * sign(x) ELSE round_even(x, 0) END) AS BIGINT) AS total
FROM (SELECT (CAST(c_custkey AS DOUBLE) - 700) / 4 AS x FROM customer), (SELECT unnest(['up', 'down', 'ceiling', 'floor', 'half_up', 'half_down', 'half_even']) AS mode) m GROUP BY 1""")
def rounding_modes(spark, sf_dir):
    modes = ["up", "down", "ceiling", "floor", "half_up", "half_down", "half_even"]
    x = ((F.col("c_custkey") - 700) / 4).cast("decimal(18,2)")
    sums = table(spark, sf_dir, "customer").agg(*[F.sum(X.rounded(x, 0, m)).cast("bigint").alias(m) for m in modes])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("total")) for m in modes])).alias("r")).select("r.*")


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS octal, CAST(p_partkey AS BIGINT) AS hexa, CAST(p_size AS BIGINT) AS bits FROM part")
def radix_text(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    t = table(spark, sf_dir, "part").select("p_partkey", F.conv(k, 10, 8).alias("a"), F.conv(k, 10, 16).alias("b"), F.bin("p_size").alias("c"))
    return t.select("p_partkey", X.radix(F.col("a"), 8).alias("octal"), X.radix(F.col("b"), 16).alias("hexa"), X.radix(F.col("c"), 2).alias("bits"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS by_text, strftime(o_orderdate, '%Y-%m-%d') AS by_bcd, epoch_us(date_trunc('second', o_orderdate)) AS by_epoch, year(o_orderdate) AS y FROM orders")
def calendars(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("a"), F.unhex(F.date_format("o_orderdate", "yyyyMMdd")).alias("b"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 946684800).alias("c"))
    epoch = X.calendar_epoch(F.col("c"), "seconds", "2000-01-01 00:00:00")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.select("o_orderkey", day(X.calendar(F.col("a"), "dd.MM.yyyy")).alias("by_text"), day(X.calendar_bcd(F.col("b"), "yyyyMMdd")).alias("by_bcd"), F.unix_micros(epoch).alias("by_epoch"), F.year(epoch).cast("bigint").alias("y"))


@query("SELECT doc_id, length(text) AS utf16, length(text) AS utf32, upper(substr(lang, 1, 2)) AS ebcdic, upper(lang) AS six_bit FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def encodings(spark, sf_dir):
    alphabet = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"
    t = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    t = t.select("doc_id", F.encode("text", "utf-16le").alias("a"), F.encode("text", "utf-32").alias("b"), X.encoded(F.upper(F.substring("lang", 1, 2)), "cp037").alias("c"), X.put_sub_byte(F.upper("lang"), 6, alphabet).alias("d"))
    return t.select("doc_id", F.length(X.decoded(F.col("a"), "utf-16le")).cast("bigint").alias("utf16"), F.length(X.decoded(F.col("b"), "utf-32")).cast("bigint").alias("utf32"), X.decoded(F.col("c"), "cp037").alias("ebcdic"), F.substring(X.sub_byte(F.col("d"), 6, alphabet), 1, 2).alias("six_bit"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS nil, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS filled, c_name AS trimmed FROM customer")
def nil_default_pad(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.rpad("c_mktsegment", 12, " ").alias("a"), X.padded(F.col("c_name"), 30, "*", "center").alias("b"))
    n = X.nil(X.trimmed(F.col("a")), ["BUILDING", "-"])
    return t.select("c_custkey", n.alias("nil"), F.coalesce(n, F.lit("none")).alias("filled"), X.trimmed(F.col("b"), "*", "center").alias("trimmed"))


# -- expressions ---------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, upper(c_name) AS a, substr(c_name, 2, 4) AS b, split_part(c_name, '#', 1) AS c, split_part(c_name, '#', 2) AS d, contains(c_mktsegment, 'IL') AS e,
starts_with(c_mktsegment, 'A') AS f, length(c_mktsegment) AS g, CASE WHEN c_mktsegment < 'C' THEN -1 ELSE 1 END AS h, regexp_matches(c_name, '0{3,}1') AS i, c_name || '/' || c_mktsegment AS j FROM customer""")
def expr_strings(spark, sf_dir):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        call("upper-case", name).alias("a"),
        call("substring", name, 1.5, 4.4).alias("b"),
        call("substring-before", name, "#").alias("c"),
        call("substring-after", name, "#").alias("d"),
        call("contains", seg, "IL").alias("e"),
        call("starts-with", seg, "A").alias("f"),
        call("string-length", seg).cast("bigint").alias("g"),
        call("compare", seg, "C").alias("h"),
        call("matches", name, "0{3,}1").alias("i"),
        call("concat", name, "/", seg).alias("j"),
    )


@query("""SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, (p_size - 25) // 4 AS d, (p_size - 25) % 4 AS e,
p_partkey & 12 AS f, p_partkey | 3 AS g, xor(p_partkey, 5) AS h, p_partkey << 2 AS i, p_partkey >> 1 AS j, p_size BETWEEN 5 AND 9 AS k, p_size > 5 AND p_size < 9 AS l, CASE WHEN p_size <= 127 THEN p_size END AS m, CASE WHEN p_partkey <= 255 THEN p_partkey END AS n FROM part""")
def expr_numbers(spark, sf_dir):
    size, key, price = F.col("p_size"), F.col("p_partkey"), F.col("p_retailprice")
    out = [
        call("abs", size - 25).cast("int"),
        call("ceiling", price),
        call("floor", price),
        call("idiv", size - 25, 4).cast("int"),
        call("mod", size - 25, 4),
        call("bitAnd", key, F.lit(12)),
        call("bitOr", key, F.lit(3)),
        call("bitXor", key, F.lit(5)),
        call("leftShift", key, 2),
        call("rightShift", key, 1),
        call("checkRangeInclusive", size, 5, 9),
        call("checkRangeExclusive", size, 5, 9),
        call("byte", size).cast("int"),
        call("unsignedByte", key).cast("bigint"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(out, "abcdefghijklmn")])


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CASE WHEN value > 0 THEN 'pos' ELSE 'neg' END AS s FROM events")
def expr_dates(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("x", call("dateTime", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")))
    parts = [("year", "y"), ("month", "m"), ("day", "d"), ("hours", "h"), ("minutes", "mi")]
    return t.select("event_id", *[call(f"{p}-from-dateTime", F.col("x")).cast("bigint").alias(n) for p, n in parts], call("if", F.col("value") > 0, "pos", "neg").alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_quantity) AS BIGINT) * 2 AS doubled, 'L' || l_linenumber AS label FROM lineitem")
def computed_fields(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(B.put_uint(F.col("l_linenumber"), 1), B.put_uint(F.col("l_quantity"), 1)).alias("payload"))
    layout = [L.Element("l_linenumber", 1, lambda p: B.uint(p, 0, 1).cast("int")), L.Element("q", 1, number(1), hidden=True), L.Computed("doubled", lambda f: f["q"] * 2), L.Computed("label", lambda f: call("concat", "L", call("string", f["l_linenumber"])))]
    return L.parse(t, "payload", layout).select("l_orderkey", "record.*")


@query("""SELECT p_partkey, p_partkey % 4096 AS ahead, CAST(length(p_name) AS INTEGER) AS chars, CAST(strlen(p_name) * 8 AS INTEGER) AS bits, ends_with(p_name, 'e') AS ends, lower(p_brand) AS low,
replace(p_brand, 'Brand', 'B') AS swapped, p_size % 24 AS hour, 7 AS minute, p_size AS second, round_even(p_size / 4, 0)::BIGINT AS even, CAST(p_partkey AS VARCHAR) AS label, p_size <= 20 AS small, p_brand || '%%' || '%HT;' AS coded, p_brand || '%\t' AS plain
FROM part""")
def expr_lengths_times(spark, sf_dir):
    """Functions that look ahead, measure, and take times apart."""
    size, key, name = F.col("p_size"), F.col("p_partkey"), F.col("p_name")
    clock = call("time", F.format_string("%02d:07:%02d", (size % 24).cast("int"), size.cast("int")))
    coded = call("encodeDFDLEntities", F.concat("p_brand", F.lit("%\t")))
    out = {
        "ahead": call("lookAhead", B.put_uint(key % 4096, 4), F.lit(1), 12, 12),
        "chars": call("valueLength", name, "characters"),
        "bits": call("contentLength", name, "bits"),
        "ends": call("ends-with", name, "e"),
        "low": call("lower-case", F.col("p_brand")),
        "swapped": call("replace", F.col("p_brand"), "Brand", "B"),
        "hour": call("hours-from-time", clock),
        "minute": call("minutes-from-time", clock),
        "second": call("seconds-from-time", clock),
        "even": call("roundHalfToEven", (size / 4).cast("decimal(10,2)")).cast("bigint"),
        "label": call("string", call("long", key)),
        "small": call("not", size > 20),
        "coded": coded,
        "plain": call("decodeDFDLEntities", coded),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in out.items()])


# -- layers ----------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name AS swapped, n_name AS zipped, n_name AS armored, n_name || ' ' || n_name AS unfolded, n_name AS marked, CAST(list_sum([CAST(c AS INTEGER) FOR c IN string_split(CAST(n_nationkey * 37 AS VARCHAR), '')]) % 10 AS INTEGER) AS digit FROM nation")
def layer_transforms(spark, sf_dir):
    name = utf8("n_name")
    t = table(spark, sf_dir, "nation")
    return t.select(
        "n_nationkey",
        text(Y.swapped(Y.swapped(name, 4), 4)).alias("swapped"),
        text(Y.gunzip(Y.gzip(name))).alias("zipped"),
        text(Y.unbase64_mime(Y.base64_mime(name))).alias("armored"),
        Y.unfolded(F.concat(F.col("n_name"), F.lit("\r\n "), F.col("n_name"))).alias("unfolded"),
        Y.to_mark(F.concat(F.col("n_name"), F.lit("//rest"))).alias("marked"),
        Y.check_digit((F.col("n_nationkey") * 37).cast("string")).alias("digit"),
    )


@query("SELECT s_suppkey, 65535 - (t % 65536 + t // 65536) AS checksum FROM (SELECT s_suppkey, CAST(17664 + 48 + s_suppkey % 65536 + 16384 + 16401 + 32512 + 1 + 32512 + 2 AS BIGINT) AS t FROM supplier)")
def layer_ipv4_checksum(spark, sf_dir):
    h = F.concat(F.lit(bytes.fromhex("45000030")), B.put_uint(F.col("s_suppkey") % 65536, 2), F.lit(bytes.fromhex("40004011ffff7f0000017f000002")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", Y.ipv4_checksum(h).cast("bigint").alias("checksum"))


# -- sinks, captures, tools ---------------------------------------------------------------------------------------


@query("SELECT n_nationkey, '[' || n_name || '|' || lpad(CAST(n_regionkey AS VARCHAR), 4, '0') || ']' AS line FROM nation")
def unparse_text(spark, sf_dir):
    layout = [L.Element("name", L.Delimited("\\|", "|"), text, utf8, initiator="["), L.Element("region", 4, text, lambda c: utf8(F.lpad(c.cast("string"), 4, "0"))), L.Skip(1, b"]")]
    return table(spark, sf_dir, "nation").select("n_nationkey", text(L.build(layout, {"name": F.col("n_name"), "region": F.col("n_regionkey")})).alias("line"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS same FROM lineitem")
def round_trip(spark, sf_dir):
    read = _lines(spark, sf_dir)
    again = L.parse(read.select(F.struct("*").alias("a"), L.build(_line(False), {c: F.col(c) for c in read.columns}).alias("payload")), "payload", _line(False))
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("record")).alias("same"))


@query("SELECT event_id, user_id AS number, epoch_us(ts) AS us, 36 + 28 + 14 - 36 + 8 AS size FROM events")
def pcap_scan(spark, sf_dir):
    """Frames written as capture files and read back; ids from their UDP payloads."""
    spark.dataSource.register(pcap.PcapSource)
    path = framing.shared_path(spark, "captures")
    body = F.concat(F.lit(b"\x22\x00\x0b"), B.put_uint(F.col("event_id"), 4), B.put_uint(F.col("user_id"), 4))
    frames = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), pcap.udp_frame(F.substring(body, 1, 11)).alias("data"))
    frames.write.format("pcap").mode("append").save(path)
    read = spark.read.format("pcap").load(path).select("ts", F.octet_length("data").alias("n"), pcap.udp_payload(F.col("data")).alias("payload"))
    b = pcap.blocks(read, "payload").where("block.category = 34")
    return b.select(B.uint(F.col("block.content"), 0, 4).alias("event_id"), B.uint(F.col("block.content"), 4, 4).alias("number"), F.unix_micros("ts").alias("us"), (F.col("n") - 3).cast("int").alias("size"))


@query("SELECT l_orderkey, l_linenumber, u.seq, u.path, u.value FROM (SELECT l_orderkey, l_linenumber, unnest([{'seq': 0, 'path': 'record/line', 'value': CAST(l_linenumber AS VARCHAR)}, {'seq': 1, 'path': 'record/flag', 'value': l_returnflag}]) AS u FROM lineitem)")
def dissect_long(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(B.put_uint(F.col("l_linenumber"), 1), utf8("l_returnflag")).alias("payload"))
    d = L.parse(t, "payload", [L.Element("line", 1, number(1)), L.Element("flag", 1, text)])
    return P.dissect(d, "record", "l_orderkey", "l_linenumber")


@query("SELECT k AS kind, CAST(count(*) AS BIGINT) AS n, CAST(CASE WHEN k = 'none' THEN 0 ELSE count(*) END AS BIGINT) AS found FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'truncated' WHEN 1 THEN 'dispatch_key' ELSE 'none' END AS k FROM orders) GROUP BY 1")
def payload_anomalies(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("truncated"), F.lit("dispatch_key"), F.lit("none")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    t = table(spark, sf_dir, "orders").select(kind.alias("kind"), P.with_anomaly(F.concat(F.lit(b"T"), B.put_uint(F.col("o_orderkey"), 7)), kind).alias("payload"))
    key = lambda f: F.when(f["tag"] == "T", "track")
    d = L.parse(t, "payload", [L.Element("tag", 1, text), L.Choice("body", {"track": [L.Element("id", 7, number(7))]}, key=key), L.Assert(lambda f: f["body_track"]["id"].isNotNull(), "body")])
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("record_errors") > 0).alias("found"))


# -- relational work on parsed records -------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def parsed_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(B.put_uint(F.col("o_orderkey"), 7), utf8("o_orderstatus")).alias("payload"))
    o = L.parse(o, "payload", [L.Element("orderkey", 7, number(7)), L.Element("status", 1, text)]).select("record.*")
    return _lines(spark, sf_dir).join(o, "orderkey").groupBy("status", "flag").agg(F.count("*").alias("n"), F.sum("cents").cast("bigint").alias("cents"))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lineitem")
def parsed_window(spark, sf_dir):
    w = Window.partitionBy("orderkey")
    return _lines(spark, sf_dir).select("orderkey", F.col("linenumber").cast("int").alias("linenumber"), F.row_number().over(w.orderBy(F.desc("cents"), "linenumber")).cast("bigint").alias("place"), F.sum("cents").over(w.orderBy("linenumber", "cents").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("running"))


@query("SELECT l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
def parsed_rollup(spark, sf_dir):
    return _lines(spark, sf_dir).rollup("flag", "linenumber").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'N'")
def parsed_setops(spark, sf_dir):
    d = _lines(spark, sf_dir)
    keys = lambda c: d.where(c).select("partkey")
    return keys("flag = 'A'").intersect(keys("flag = 'R'")).subtract(keys("linenumber = 3 AND flag = 'N'"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def parsed_semi_anti(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumnRenamed("orderkey", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(d.where("flag = 'R'"), "o_orderkey", "left_anti").join(d.where("linenumber = 1"), "o_orderkey", "left_semi")


@query("SELECT orderkey, cents FROM (SELECT l_orderkey AS orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_linenumber FROM lineitem) ORDER BY cents DESC, orderkey, l_linenumber LIMIT 20")
def parsed_top(spark, sf_dir):
    return _lines(spark, sf_dir).orderBy(F.desc("cents"), "orderkey", "linenumber").limit(20).select("orderkey", "cents")


@query("SELECT * FROM (SELECT e.event_id, (SELECT max(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id < e.event_id) AS last_purchase FROM events e WHERE e.event_type = 'click')")
def parsed_asof(spark, sf_dir):
    """Last purchase of the user before each click, by one window and no join."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w))
    return e.where("event_type = 'click'").select("event_id", "last_purchase")


@query("SELECT l_returnflag AS flag, true AS near_distinct, true AS near_median FROM lineitem GROUP BY 1")
def parsed_approximate(spark, sf_dir):
    """Sketches of parsed fields, held against exact values: distinct keys within 5 %, the median's rank within 1 %.

    The sketches are of a fixed size; the exact side is counted by flag and key, with the ranks of the sketched median, so that no flag's values come together in a task.
    """
    d = _lines(spark, sf_dir)
    sketches = d.groupBy(F.col("flag").alias("of")).agg(F.approx_count_distinct("partkey", 0.01).alias("a"), F.percentile_approx("cents", 0.5, 10000).alias("m"))
    ranks = [F.count("cents").alias("rows"), F.count_if(F.col("cents") < F.col("m")).alias("below"), F.count_if(F.col("cents") <= F.col("m")).alias("upto")]
    keys = d.join(F.broadcast(sketches), F.col("flag").eqNullSafe(F.col("of"))).groupBy("flag", "a", "m", "partkey").agg(*ranks)
    s = keys.groupBy("flag", "a").agg(F.count("partkey").alias("n"), *[F.sum(c).alias(c) for c in ("rows", "below", "upto")])
    last = F.col("rows") - 1
    near = (F.ceil(last * 0.49) < F.col("upto")) & (F.floor(last * 0.51) >= F.col("below"))
    return s.select("flag", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("near_distinct"), F.when(F.col("rows") > 0, near).alias("near_median"))


@query("SELECT kind, status, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'binary' ELSE 'text' END AS kind, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY 1, 2")
def parsed_union(spark, sf_dir):
    """Records of two formats brought to one schema: half of the orders in binary, half as delimited text."""
    t = table(spark, sf_dir, "orders").withColumn("cents", cents(F.col("o_totalprice")))
    b = t.where("o_orderkey % 2 = 0").select(F.concat(utf8("o_orderstatus"), B.put_sint(F.col("cents"), 6)).alias("payload"))
    c = t.where("o_orderkey % 2 <> 0").select(utf8(F.concat_ws(";", "o_orderstatus", F.col("cents").cast("string"))).alias("payload"))
    b = L.parse(b, "payload", [L.Element("status", 1, text), L.Element("cents", 6, number(6, signed=True))])
    c = L.parse(c, "payload", [L.Element("status", L.Delimited(";", ";"), text), L.Element("cents", L.Rest(), lambda p: text(p).cast("bigint"))])
    both = b.select(F.lit("binary").alias("kind"), "record.*").unionByName(c.select(F.lit("text").alias("kind"), "record.*"))
    return both.groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("cents").cast("bigint").alias("cents"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) > (SELECT avg(CAST(round(l_extendedprice * 100) AS BIGINT)) FROM lineitem WHERE l_linenumber = 1) GROUP BY 1")
def parsed_scalar_subquery(spark, sf_dir):
    """Lines dearer than the mean of first lines, by a scalar subquery over the parsed records."""
    d = _lines(spark, sf_dir)
    return d.where(F.col("cents") > d.where("linenumber = 1").agg(F.avg("cents")).scalar()).groupBy("flag").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS json, '<record><key>' || n_nationkey || '</key><name>' || n_name || '&amp;&lt;</name></record>' AS xml, n_name || '&<' AS again FROM nation""")
def infoset_text(spark, sf_dir):
    """Parsed records as JSON and as XML, and read back from XML."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(B.put_uint(F.col("n_nationkey"), 1), utf8("n_name")).alias("payload"))
    r = L.parse(t, "payload", [L.Element("key", 1, number(1)), L.Element("name", L.Rest(), text)])
    xml = I.to_xml(F.col("record").withField("name", F.concat("record.name", F.lit("&<"))), r.schema["record"].dataType, "record")
    r = r.select("n_nationkey", F.to_json("record").alias("json"), xml.alias("xml"))
    return r.select("*", F.from_xml("xml", "key bigint, name string", {"rowTag": "record"})["name"].alias("again"))


# -- streams -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id AS number FROM events WHERE event_type <> 'error'")
def stream_parsed(spark, sf_dir):
    """Payloads parsed in a stream, without state."""
    s = framing.read_files(spark, sf_dir, "events.parquet").where("event_type <> 'error'")
    s = s.select(F.concat(B.put_uint(F.col("event_id"), 5), B.put_uint(F.col("user_id"), 5)).alias("payload"))
    d = L.parse(s, "payload", [L.Element("event_id", 5, number(5)), L.Element("number", 5, number(5))])
    return framing.run_to_end(d.select("record.*"), "stream-parsed")


@query("SELECT user_id % 16 AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_framed(spark, sf_dir):
    """Length-prefixed frames put together by keyed state; a chunk is two bytes longer or shorter than its frame in turn."""
    s = framing.read_files(spark, sf_dir, "events.parquet")
    frame = F.concat(F.lit(b"\x00\x07"), B.put_uint(F.col("event_id"), 5))
    s = s.select((F.col("user_id") % 16).alias("source"), F.col("event_id").alias("sequence"), frame.alias("chunk"))
    f = framing.frames(s, "source", "sequence", "chunk", 2, lambda head: int.from_bytes(head, "big"))
    out = framing.run_to_end(f, "stream-framed")
    return out.groupBy("source").agg(F.count("*").alias("n"), F.sum(B.uint(F.col("frame"), 2, 5)).cast("bigint").alias("ids"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, event_type AS kind, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 HOUR, max(ts)) FROM events) GROUP BY 1, 2")
def stream_windowed(spark, sf_dir):
    """Counts by hour under a watermark; windows still open at the end aren't out yet, and the last hour is left out."""
    s = framing.read_files(spark, sf_dir, "events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    counts = s.withWatermark("t", "0 seconds").groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = framing.run_to_end(counts.select(F.col("w.start").alias("start"), F.col("event_type").alias("kind"), "n"), "stream-windowed")
    last = table(spark, sf_dir, "events").agg(F.date_trunc("hour", F.max(F.col("ts").cast("timestamp"))).alias("last"))
    return out.join(F.broadcast(last), F.col("start") < F.col("last")).select(F.unix_micros("start").alias("hour"), "kind", "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - g.i * 1800000000 AS start, event_type AS kind, count(*) AS n FROM (SELECT ts, event_type, epoch_us(ts) % 3600000000 AS within FROM events) e, (SELECT unnest([-1, 0, 1]) AS i) g WHERE within + g.i * 1800000000 >= 0 AND within + g.i * 1800000000 < 3600000000 GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    """Windows of an hour each half hour, counted in a stream; those still open at its end are out too, in complete mode."""
    s = framing.read_files(spark, sf_dir, "events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    counts = s.groupBy(F.window("t", "1 hour", "30 minutes").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return framing.run_to_end(counts.select(F.unix_micros("w.start").alias("start"), "kind", "n"), "stream-sliding", "complete")


@query("""SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Sessions of a user that half an hour without events ends, in a stream."""
    s = framing.read_files(spark, sf_dir, "events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    sessions = s.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return framing.run_to_end(sessions.select("user_id", F.unix_micros("w.start").alias("start"), "n"), "stream-sessions", "complete")


@query("SELECT user_id, event_type AS kind FROM events GROUP BY 1, 2")
def stream_distinct(spark, sf_dir):
    """The first event of each user and kind, by state that a watermark bounds."""
    s = framing.read_files(spark, sf_dir, "events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    d = s.withWatermark("t", "36500 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return framing.run_to_end(d.select("user_id", F.col("event_type").alias("kind")), "stream-distinct")
