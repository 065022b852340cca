"""Codecs and layouts on chosen values, edge cases and failures included."""

import datetime
import math
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bitloom.functions import binary as B
from bitloom.functions import text as X
from bitloom.functions.expressions import FUNCTIONS, call
from bitloom.functions.facets import Facets
from bitloom.operators import layers as Y
from bitloom.operators import layout as L
from bitloom.plans import payloads as P
from bitloom.sources import pcap


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def of_bytes(spark, data, f):
    return spark.createDataFrame([(data,)], "p binary").select(f(F.col("p")).alias("x")).first().x


def of_text(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("length", range(1, 9))
@pytest.mark.parametrize("little", [False, True])
def test_integers(spark, length, little):
    raw = bytes(range(0xF1, 0xF1 + length))
    order = "little" if little else "big"
    assert int(of_bytes(spark, raw, lambda p: B.uint(p, 0, length, little))) == int.from_bytes(raw, order)
    assert of_bytes(spark, raw, lambda p: B.sint(p, 0, length, little)) == int.from_bytes(raw, order, signed=True)
    assert of_bytes(spark, raw[:-1], lambda p: B.uint(p, 0, length, little)) is None


@pytest.mark.parametrize("start,length", [(0, 1), (3, 5), (7, 2), (5, 56), (1, 53), (8, 8), (9, 31)])
def test_bits(spark, start, length):
    raw = bytes([0xA5, 0x3C, 0x7E, 0x81, 0xFF, 0x00, 0x99, 0x5A])
    if start + length > 64:
        pytest.skip("beyond the payload")
    whole = int.from_bytes(raw, "big")
    assert of_bytes(spark, raw, lambda p: B.bits(p, start, length)) == whole >> (64 - start - length) & ((1 << length) - 1)
    low = int.from_bytes(raw, "little")
    assert of_bytes(spark, raw, lambda p: B.bits(p, start, length, True)) == low >> start & ((1 << length) - 1)


@pytest.mark.parametrize("value", [0.0, -0.0, 1.5, -2.25, 1e300, 5e-324, 2.2e-310, math.inf, -math.inf, 0.1])
def test_doubles(spark, value):
    assert of_bytes(spark, struct.pack(">d", value), lambda p: B.ieee(p, 0, 8)) == value
    assert of_bytes(spark, struct.pack("<d", value), lambda p: B.ieee(p, 0, 8, True)) == value


def test_floats(spark):
    for value in (0.0, 1.5, -3.25, 1e-45, math.inf):
        small = struct.unpack(">f", struct.pack(">f", value))[0]
        assert of_bytes(spark, struct.pack(">f", value), lambda p: B.ieee(p, 0, 4)) == small
    assert math.isnan(of_bytes(spark, struct.pack(">f", math.nan), lambda p: B.ieee(p, 0, 4)))


def test_packed_numbers(spark):
    assert of_bytes(spark, bytes.fromhex("12345D"), lambda p: B.packed(p, 2)) == Decimal("-123.45")
    assert of_bytes(spark, bytes.fromhex("123456"), B.packed) is None
    assert of_bytes(spark, bytes.fromhex("1A3C"), B.packed) is None
    assert of_bytes(spark, bytes.fromhex("0123"), B.bcd) == 123
    assert of_bytes(spark, bytes.fromhex("01A3"), B.bcd) is None
    assert of_bytes(spark, bytes.fromhex("FFD123"), B.ibm4690) == -123
    assert of_text(spark, "12p", X.zoned) == -120
    assert of_text(spark, "12{", lambda t: X.zoned(t, "translated_ebcdic")) == 120
    assert of_text(spark, "12\x81", lambda t: X.zoned(t, "tandem", 1)) == Decimal("-12.1")
    assert of_text(spark, "1x2", X.zoned) is None


def test_number_patterns(spark):
    p = X.NumberPattern("#,##0.00;(#,##0.00)")
    assert of_text(spark, "(1,234.50)", p.parse) == Decimal("-1234.5")
    assert of_text(spark, "12,34.50", p.parse) is None
    assert of_text(spark, " 12,34.50 ", lambda t: p.parse(t, False)) == Decimal("1234.5")
    assert of_text(spark, None, p.parse) is None
    assert of_text(spark, "-1234567.895", lambda t: p.format(t.cast("decimal(20,3)"))) == "(1,234,567.90)"
    assert of_text(spark, "0.5", lambda t: X.NumberPattern("#0.##%").format(t.cast("decimal(20,3)"))) == "50%"
    assert of_text(spark, "12.5%", X.NumberPattern("0.0%").parse) == Decimal("0.125")


@pytest.mark.parametrize("mode,want", [("up", [3, -3]), ("down", [2, -2]), ("ceiling", [3, -2]), ("floor", [2, -3]), ("half_up", [3, -3]), ("half_down", [2, -2]), ("half_even", [2, -2]), ("unnecessary", [None, None])])
def test_rounding(spark, mode, want):
    df = spark.createDataFrame([(Decimal("2.5"),), (Decimal("-2.5"),)], "x decimal(10,2)")
    assert [r.x for r in df.select(X.rounded(F.col("x"), 0, mode).alias("x")).collect()] == want


def test_delimiters_and_escapes(spark):
    assert of_text(spark, "a\r\nb\nc", lambda t: X.split_fields(t, X.delimiter("%NL;"))) == ["a", "b", "c"]
    assert of_text(spark, "a;;b;c", lambda t: X.split_fields(t, X.delimiter("; ;;"))) == ["a", "b", "c"]
    assert of_text(spark, r"a\,b,c\\", lambda t: X.split_fields(t, ",", escape="\\")) == ["a,b", "c\\"]
    assert of_text(spark, '"a,""b""",c,', lambda t: X.split_fields(t, ",", quote='"')) == ['a,"b"', "c", ""]
    assert of_text(spark, "50%%%SP;x%NL;", X.entities_decoded) == "50% x\n"
    assert of_text(spark, "", lambda t: X.split_fields(t, ",")) == [""]


@pytest.mark.parametrize("size", [2_000, 1_000_000])
def test_fields_of_any_length_and_character(spark, size):
    odd = "".join(map(chr, range(1, 32))) + "\x7f\x85é😀"
    long = "x" * size
    assert of_text(spark, f"{long},a\\,{odd},", lambda t: X.split_fields(t, ",", escape="\\")) == [long, "a," + odd, ""]
    assert of_text(spark, f'"{long},{odd}",{long}', lambda t: X.split_fields(t, ",", quote='"')) == [f"{long},{odd}", long]
    assert of_text(spark, "a\x1fb,c", lambda t: X.split_fields(t, ",", escape="\\")) == ["a\x1fb", "c"]
    assert of_text(spark, "", lambda t: X.split_fields(t, ",", quote='"')) == [""]
    layout = [L.Element("a", L.Delimited(";"), lambda p: p), L.Element("b", L.Pattern("[a-z]*+"), lambda p: p)]
    got = L.parse(spark.createDataFrame([((long + odd.replace(";", "") + ";" + long).encode(),)], "payload binary"), "payload", layout).first().record
    assert bytes(got.a) == (long + odd).encode() and bytes(got.b) == long.encode()


def test_delimiters_of_most_characters_first(spark):
    assert of_text(spark, "a;;b c", lambda t: X.split_fields(t, X.delimiter("%WSP+; ; ;;"))) == ["a", "b", "c"]


def test_digits_beyond_six_stay(spark):
    assert of_bytes(spark, bytes.fromhex("123456789C"), lambda p: B.packed(p, 8)) == Decimal("1.23456789")
    assert of_bytes(spark, bytes.fromhex("05"), lambda p: B.bcd(p, 4)) == Decimal("0.0005")
    assert of_text(spark, "12345678y", lambda t: X.zoned(t, scale=8)) == Decimal("-1.23456789")
    assert one(spark, call("idiv", F.lit(9007199254740993), 1)) == 9007199254740993


@pytest.mark.parametrize("offset,bits", [(0, 8), (3, 5), (12, 56), (5, 52), (17, 1)])
def test_look_ahead(spark, offset, bits):
    raw = bytes([0xFF, *range(0x91, 0x9F)])
    want = int.from_bytes(raw[1:], "big") >> (8 * 14 - offset - bits) & ((1 << bits) - 1)
    assert of_bytes(spark, raw, lambda p: call("lookAhead", p, F.lit(1), offset, bits)) == want
    assert of_bytes(spark, raw[:2], lambda p: call("lookAhead", p, F.lit(1), 10, 20)) is None


def test_times_lengths_and_errors(spark):
    assert of_text(spark, "12:34:56", lambda t: call("hours-from-time", call("time", t))) == 12
    assert of_text(spark, "12:34:56", lambda t: call("minutes-from-time", call("time", t))) == 34
    assert of_text(spark, "é", lambda t: call("valueLength", t)) == 2 and of_text(spark, "é", lambda t: call("contentLength", t, "characters")) == 1
    with pytest.raises(Exception, match="wrong here"):
        one(spark, call("error", "wrong here"))


def test_columns_of_a_user_stay(spark):
    df = spark.createDataFrame([(b"\x01", 5)], "payload binary, _record_1 int")
    assert L.parse(df.withColumn("_record_key", F.lit(7)), "payload", [L.Element("n", 1, lambda p: B.uint(p, 0, 1))]).select("_record_1", "_record_key", "record.n").first() == (5, 7, 1)


def test_text_values(spark):
    assert of_text(spark, "..ab..", lambda t: X.trimmed(t, ".", "center")) == "ab"
    assert of_text(spark, "ab", lambda t: X.padded(t, 5, "*", "center")) == "*ab**"
    assert of_text(spark, "zz", lambda t: X.radix(t, 36)) == 1295
    assert of_text(spark, "12", lambda t: X.radix(t, 2)) is None
    assert of_text(spark, "2024-02-30", lambda t: X.calendar(t, "yyyy-MM-dd")) is None
    assert of_bytes(spark, bytes.fromhex("20240229123456"), X.calendar_bcd) == datetime.datetime(2024, 2, 29, 12, 34, 56)
    assert of_bytes(spark, "äé".encode("cp037", "replace"), lambda p: X.decoded(p, "cp037")) == "äé"
    assert of_bytes(spark, bytes([0b11110000]), X.bit_string) == "11110000"
    assert of_text(spark, "ABC", lambda t: X.sub_byte(X.put_sub_byte(t, 5, "ABCDEFGH"), 5, "ABCDEFGH")) == "ABC"


def test_layers(spark):
    head = bytes.fromhex("45000073000040004011b861c0a80001c0a800c7")
    assert of_bytes(spark, head, Y.ipv4_checksum) == 0xB861
    carried = bytes.fromhex("450000303cbb40004011ffff7f0000017f000002")  # its words add up to 0x1FFFF, whose first fold carries again
    assert of_bytes(spark, carried, Y.ipv4_checksum) == 0xFFFE
    assert of_bytes(spark, b"abcde", lambda p: Y.swapped(p, 2)) == b"badce"
    assert of_bytes(spark, b"not gzip", Y.gunzip) is None
    assert of_bytes(spark, bytes(100), Y.base64_mime).split("\r\n")[0].__len__() == 76
    assert of_text(spark, "no mark", Y.to_mark) is None
    assert of_text(spark, "15", Y.ais_armor) == "000001000101"


def test_expressions(spark):
    assert of_text(spark, "abc", lambda t: call("substring", t, 0, 2)) == "a"
    assert of_text(spark, "a-b-c", lambda t: call("substring-before", t, "-")) == "a"
    assert of_text(spark, "abc", lambda t: call("substring-after", t, "x")) == ""
    assert one(spark, call("round", F.lit(-2.5))) == -2
    assert one(spark, call("idiv", F.lit(-7), 2)) == -3
    assert one(spark, call("mod", F.lit(-7), 2)) == -1
    assert one(spark, call("div", F.lit(1), 0)) is None
    assert of_text(spark, "300", lambda t: call("unsignedByte", t)) is None
    with pytest.raises(ValueError):
        call("no-such", 1)
    assert len(FUNCTIONS) > 60


def test_facets(spark):
    df = spark.createDataFrame([(Decimal("12.34"), "ab"), (None, None)], "n decimal(10,2), t string")
    ok = Facets(total_digits=4, fraction_digits=2, min_exclusive=12, max_exclusive=13)
    assert [r[0] for r in df.select(ok.hold(F.col("n"))).collect()] == [True, True]
    assert df.select(Facets(total_digits=3).hold(F.col("n"))).first()[0] is False
    assert df.select(Facets(enumeration=["x"], min_length=3).hold(F.col("t"))).first()[0] is False


LAYOUT = [L.Element("n", 1, lambda p: B.uint(p, 0, 1)), L.Array("a", 1, lambda p: B.uint(p, 0, 1), count=lambda f: f["n"]), L.Element("t", L.Rest(), lambda p: F.decode(p, "utf-8"))]


def test_layout_errors_and_modes(spark):
    df = spark.createDataFrame([(1, b"\x02\x05\x06xy"), (2, b"\x09\x01"), (3, b""), (4, None), (5, b"\x00")], "record_id int, payload binary")
    rows = {r.record_id: r for r in L.parse(df, "payload", LAYOUT).collect()}
    assert rows[1].record.a == [5, 6] and rows[1].record.t == "xy" and rows[1].record_errors == []
    assert rows[2].record.a is None and rows[2].record_errors == ["a: too short"]
    assert rows[3].record_errors and rows[4].record_errors
    assert rows[5].record.a == [] and rows[5].record.t == ""
    assert L.parse(df, "payload", LAYOUT, mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="malformed"):
        L.parse(df, "payload", LAYOUT, mode="FAILFAST").collect()
    assert L.parse(df.limit(0), "payload", LAYOUT).count() == 0
    with pytest.raises(ValueError):
        L.parse(df, "payload", LAYOUT, mode="OTHER")


def test_repeated_items(spark):
    """Many blocks of items, none, too few, one that says to be longer than any payload; and no filter on errors makes the payload again."""

    def item(data, at):
        size = B.uint(data, at, 4)
        return F.decode(B.cut(data, at + 4, size), "utf-8"), size + 4

    packed = lambda *texts: b"".join(len(t).to_bytes(4, "big") + t.encode() for t in texts)
    many = [str(i) for i in range(2 * L.BLOCK + 5)]
    raw = [(1, len(many), packed(*many)), (2, 0, b""), (3, 3, packed("a", "b")), (4, 1, b"\xff\xff\xff\xffab"), (5, 1, packed("a") + b"z"), (6, 64, packed(*many[:64])), (7, 1, None)]
    df = spark.createDataFrame([(i, None if p is None else (n.to_bytes(2, "big") + p).hex()) for i, n, p in raw], "id int, h string").select("id", F.unhex("h").alias("payload"))
    counted = L.parse(df, "payload", [L.Element("n", 2, lambda p: B.uint(p, 0, 2)), L.Repeated("t", "string", item, lambda f: f["n"]), L.Element("rest", L.Rest(), lambda p: p)])
    rows = {r.id: r for r in counted.collect()}
    assert rows[1].record.t == many and rows[2].record.t == [] and rows[6].record.t == many[:64]
    assert rows[5].record.t == ["a"] and bytes(rows[5].record.rest) == b"z" and rows[5].record_errors == []
    assert rows[3].record_errors == ["t: too short"] and "t: too short" in rows[4].record_errors and rows[7].record_errors
    to_end = L.parse(df, "payload", [L.Skip(2), L.Repeated("t", "string", item)], mode="DROPMALFORMED")
    assert {r.id: r.record.t for r in to_end.collect()} == {1: many, 2: [], 3: ["a", "b"], 6: many[:64]}
    whole = counted.where(F.size("record_errors") == 0).select("record.t")
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("unhex(") == 1


def test_anomalies_and_generator(spark):
    made = P.generate(spark, 50, {"kind": P.choose(F.col("id"), 1, [*P.ANOMALIES, "none"]), "n": P.number(F.col("id"), 2, 5, 9)})
    assert made.collect() == P.generate(spark, 50, {"kind": P.choose(F.col("id"), 1, [*P.ANOMALIES, "none"]), "n": P.number(F.col("id"), 2, 5, 9)}).collect()
    assert {r.n for r in made.collect()} <= set(range(5, 10))
    changed = made.select("kind", P.with_anomaly(F.lit(b"ABCDEF"), F.col("kind")).alias("p")).collect()
    assert all((bytes(r.p) == b"ABCDEF") == (r.kind == "none") for r in changed)


def test_packets(spark, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([(when, b"\x22\x00\x05ab\x30\x00\x03\x99"), (when, b"")], "ts timestamp, body binary")
    df.select("ts", pcap.udp_frame(F.col("body")).alias("data")).write.format("pcap").mode("append").save(str(tmp_path / "c"))
    back = spark.read.format("pcap").load(str(tmp_path / "c")).select("ts", pcap.udp_payload(F.col("data")).alias("body"))
    assert sorted((r.ts, bytes(r.body)) for r in back.collect()) == [(when, b""), (when, b"\x22\x00\x05ab\x30\x00\x03\x99")]
    found = pcap.blocks(back, "body").select("block.*").collect()
    assert sorted((r.category, bytes(r.content)) for r in found) == [(0x22, b"ab"), (0x30, b"")]
    assert back.select(pcap.udp_payload(F.lit(bytes(60))).alias("x")).first().x is None
