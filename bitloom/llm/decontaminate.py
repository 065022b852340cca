"""Benchmark decontamination with DataFrame functions only.

A window is n consecutive words of a benchmark item (a shorter item is one window). Any run of L words holds a whole block
of b = (L + 1) // 2 words that starts at a multiple of b. So documents are probed block by block, not word by word: a block whose hash
isn't in a bitmap of the benchmark's b-grams, which has a fixed size, is passed over where it stands. Each text is cut into words once; what is kept of it is
the number of words and, for the blocks that the bitmap lets through, the words around them. From these, whole windows are built and looked
up in the hash set of the benchmark's windows, which also verifies them. The set is broadcast up to BROADCAST_ROWS rows; beyond
that the same join shuffles those few windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import cut, documents, free_name, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same with upper-case letters, for texts that weren't lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: At most about 200 bytes a row: 100 MB.
BROADCAST_ROWS = 500_000
#: Bits of the filter of blocks: half a megabyte for any benchmark.
FILTER_BITS = 1 << 22


def words(text: Column) -> Column:
    """Lower-cased words; none of a null text."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """(size, window, items): the windows' words joined by a space, and the sorted ids of the items that have them, as strings."""
    w = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.lit(n), F.size("w")))
    w = w.select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
    w = w.select("size", "item", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("window"))
    return w.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _block(w: Column, start: Column, b: int) -> Column:
    return F.xxhash64(*[F.get(w, start + j) for j in range(b)])


def _bitmap(windows: DataFrame, sizes: list[int]) -> Column:
    """FILTER_BITS bits as an array of longs, as a scalar subquery: those of the hashes of every block of the windows are set."""
    grams = []
    for size in sizes:
        b = (size + 1) // 2
        v = windows.where(F.col("size") == size).select(F.split("window", " ").alias("v"))
        grams.append(v.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(b - 1, size - b))), lambda k: _block(F.col("v"), k, b))).alias("h")))
    place, bit = _place(F.col("h"))
    words_ = reduce(DataFrame.unionByName, grams).groupBy(place.alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    every = windows.sparkSession.range(0, FILTER_BITS // 64, 1, 1).select(F.col("id").alias("place")).join(words_, "place", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"])).scalar()


def _place(h: Column) -> tuple[Column, Column]:
    """(word, bit in it) of a hash in the bitmap."""
    at = F.pmod(h, F.lit(FILTER_BITS))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def probed(docs: DataFrame, windows: DataFrame, sizes: list[int], keys: list[str], text: str) -> DataFrame:
    """(keys, n_words, near) per row of docs. near: (size, place, low, part) of each block that the bitmap lets through: its place, counted
    in words from 0, and the words from `low` on that a window with the block may have."""
    w = docs.select(*keys, words(F.col(text)).alias("w")).select(*keys, "w", F.size("w").alias("n"))
    if not sizes:
        return w.select(*keys, F.col("n").cast("long").alias("n_words"), F.array().cast("array<struct<size:int,place:int,low:int,part:array<string>>>").alias("near"))
    bits = _bitmap(windows, sizes)

    def through(h: Column) -> Column:
        place, bit = _place(h)
        return F.call_function("getbit", F.get("bits", place.cast("int")), bit) == 1

    def blocks(size: int) -> Column:
        b = (size + 1) // 2
        hashed = F.transform(F.sequence(F.lit(0), F.expr(f"n div {b}").cast("int") - 1), lambda k: F.struct((k * b).alias("at"), _block(F.col("w"), k * b, b).alias("h")))
        low = lambda x: F.greatest(x["at"] - (b - 1), F.lit(0))
        part = lambda x: F.struct(F.lit(size).alias("size"), x["at"].alias("place"), low(x).alias("low"), F.slice("w", low(x) + 1, x["at"] - low(x) + size).alias("part"))
        return F.when(F.col("n") >= size, F.transform(F.filter(hashed, lambda x: through(x["h"])), part))

    near = [blocks(size) for size in sizes]
    empty = F.array().cast("array<struct<size:int,place:int,low:int,part:array<string>>>")
    return w.withColumn("bits", bits).select(*keys, F.col("n").cast("long").alias("n_words"), F.concat(*[F.coalesce(x, empty) for x in near]).alias("near"))


def matches(near: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, size, items) for each occurrence of a window in a row of `probed`; start counts words from 0."""
    hint = F.broadcast if windows.count() <= BROADCAST_ROWS else lambda df: df
    x = near.select(*keys, "n_words", F.explode("near").alias("x")).select(*keys, "n_words", "x.*")
    starts = F.sequence(F.greatest("low", F.lit(0)), F.least(F.col("place"), F.col("n_words").cast("int") - F.col("size")))
    at = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("part", s - F.col("low") + 1, F.col("size")), " ").alias("window")))
    at = F.filter(at, lambda v: (v["start"] + F.col("size") <= F.col("n_words")) & (v["start"] + F.expr("(size + 1) div 2") > F.col("place")))
    tried = x.where(F.col("low") <= F.col("n_words") - F.col("size")).select(*keys, "size", F.explode(at).alias("v")).select(*keys, "size", "v.start", "v.window")
    return tried.join(hint(windows), ["size", "window"]).select(*keys, "start", "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, key, n_words, n_hit, ranges, items) of every row of docs.

    ranges: sorted (start, end) in words of the windows that occur; n_hit: words inside any; items: sorted ids of items with
    an occurring window. key: hash of id and text, so repeated rows get equal results and rows that share an id (or have none)
    but differ in text are judged apart. Null and empty texts have no words; an empty benchmark hits nothing. Items without an id are left out. A very long text
    is a row like any other: only the words around blocks that may hit are copied.
    """
    keyed = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(doc), F.col(text)).alias("key"), F.col(text).alias("text"))
    windows = cut(benchmark_windows(benchmark, n, item, item_text))
    sizes = sorted(r["size"] for r in windows.groupBy("size").agg(F.count("*").alias("k")).collect())  # n values at most
    near = cut(probed(keyed, windows, sizes, ["doc", "key"], "text"))
    found = matches(near.where(F.size("near") > 0), windows, ["doc", "key"])
    per_doc = found.groupBy("doc", "key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "ranges",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["to"]))).alias("n"), F.greatest(a["to"], r["end"]).alias("to")),
        lambda a: a["n"],
    )
    per_doc = per_doc.select(F.col("doc").alias("d"), F.col("key").alias("k"), "ranges", "items", covered.alias("hit"))
    return near.select("doc", "key", "n_words").join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select(
        F.col("doc").alias(doc),
        "key",
        "n_words",
        F.coalesce(F.col("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _hit_rows(docs: DataFrame, benchmark: DataFrame, n: int, doc: str, text: str, *more: str) -> tuple[DataFrame, Column]:
    """(distinct rows with a hit, under names that docs hasn't; the condition that joins them to docs)."""
    names = {c: free_name(f"_hit_{c}", docs) for c in ("doc", "key", *more)}
    found = contamination(docs, benchmark, n, doc, text).where("n_hit > 0").select(F.col(doc).alias(names["doc"]), F.col("key").alias(names["key"]), *(F.col(c).alias(names[c]) for c in more)).distinct()
    return found, F.col(doc).eqNullSafe(F.col(names["doc"])) & (F.xxhash64(F.col(doc), F.col(text)) == F.col(names["key"]))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    bad, same = _hit_rows(docs, benchmark, n, doc, text)
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words inside windows cut from the texts, each with what stands between it and the word before."""
    found, same = _hit_rows(docs, benchmark, n, doc, text, "ranges")
    ranges, pieces = found.columns[-1], free_name("_pieces", docs)
    other = "[" + WORD_ANY_CASE[2:]  # one character that is in no word
    cut_up = F.regexp_extract_all(text, F.lit(f"(?s){other}*+{WORD_ANY_CASE}++"), F.lit(0))
    rest = F.regexp_extract(text, f"(?s)({other}*+)$", 1)
    joined = docs.join(found, same, "left").withColumn(pieces, F.when(F.col(ranges).isNotNull(), cut_up))
    kept = F.filter(pieces, lambda p, i: ~F.exists(ranges, lambda r: (i >= r["start"]) & (i < r["end"])))
    return joined.withColumn(text, F.when(F.col(ranges).isNull(), F.col(text)).otherwise(F.concat(F.array_join(kept, ""), rest))).select(docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by windows of ten words of every benchmark item."""
    found = contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1], ' ') AS k
       FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i+l-1], ' ') AS k
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS h
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, coalesce(it.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
