"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII masking, byte-level BPE encoding.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps with the columns of `docs`; the last one returns the ids of
their tokens in place of the text. Stages work on what they are given: each learns from, compares and counts all rows of `docs`.

Defined results: null, empty and letterless texts go in the first stage (the others let them pass); rows without an id are kept unless they copy
another row; rows that repeat an id and its text become one in the second stage; further columns are carried along, whatever their names, but
`lang`, which the first stage replaces, and `ids` and `n_tokens`, which the last one does; empty tables give empty results.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, decontam, langid, ngram_join, pii
from riskspark.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: no text or no letter, or none to learn from. The others carry the language found as `lang` from here on."""
    return langid.with_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity of 0.75 or more) the document with the smallest id stays."""
    return ngram_join.without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: at least a twentieth of the words inside benchmark windows."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids instead of their texts, and their number; decoding the ids gives the text back."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("pii", personal_data),
    ("bpe_encoding", tokens),
]
#: No SQL expresses the learned stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied in order to the documents of `sf_dir`; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
