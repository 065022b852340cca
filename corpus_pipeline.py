"""Corpus cleaning in five stages; each takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last adds ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import bpe, decontaminate, jaccard, langid, secrets
from bitloom.llm.common import cut, free_name, shared_path
from bitloom.llm.files import delete_folder

#: A text is rejected by the first stage if it has no letter, is too unlikely a character in its likeliest language, or that language's share is below this.
LANGUAGE_SHARE = 0.5
#: Near duplicates: words of a shingle, and the least Jaccard similarity as num / den.
SHINGLE = {"width": 5, "num": 80, "den": 100}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a known language."""
    model = langid.fitted(spark, docs)
    clash = {c: free_name(f"_kept_{c}", docs) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    own = docs.withColumnsRenamed(clash)
    found = langid.identify(own, model, least=langid.fitted_floors(docs, model))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({kept_as: c for c, kept_as in clash.items()}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of similar documents, and one of rows that are equal in all columns; other rows without a doc_id stay."""
    found = jaccard.jaccard_components(docs, **SHINGLE).where("doc_id is not null")
    marks = found.groupBy("doc_id").agg(F.max(F.expr("doc_id <> component_id")).alias("gone"), (F.count("*") > 1).alias("again"))
    marks = cut(marks.where("gone or again"))
    once = docs.where("doc_id is not null").join(marks, "doc_id", "left_anti")
    more = docs.join(marks.where("not gone"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).dropDuplicates()
    return once.select(docs.columns).unionByName(more.select(docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the byte-level BPE ids of the texts; round_trip tells whether decoding them gives the text's bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = free_name("_decoded", docs)
    out = bpe.encode(docs, path, pattern, decoded=decoded)
    same = F.col(decoded) == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    own = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]  # columns of these names are replaced
    return out.select(*own, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_spans", secret_spans),
    ("token_ids", token_ids),
]

#: SQL can't express the first stage's model, nor the last one's merges; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result being written to the shared folder and read again; what the stage before left is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(before)
        before = path
    return docs
