"""Exact duplicates by a 128-bit content hash, with a comparison of bytes; DataFrame operations only.

1. Texts are grouped by hash; each group's least and greatest text are compared byte by byte. Where they differ the hash has collided, and the
   rows of that hash are told apart by their text instead.
2. Every row is written once without its text, under a row number that a lost executor cannot change: id, class key, digest.
3. Classes are counted over these rows; the row with the largest id stays. Only classes of two or more rows are joined back. Classes
   of more than one `hot_share`-th of all rows, fewer than `hot_share` by arithmetic, are broadcast, so that a class of a third of all rows is
   joined where its rows lie; the other classes are joined by a shuffle of short rows.

Defined results: a null text counts as empty, and empty texts are equal to each other; texts are not normalised, so case, white space and
Unicode form count; a row without an id goes if an equal text has an id, otherwise one of the rows without id stays and keep_id is null; of rows
that repeat both id and text exactly one stays; ids may be of any type with an order; other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import shared_folder, stage


def digest128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text (as bytes) and the key of its class: the hash, or the hash with the text where a hash stands for several texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text"), digest(text).alias("key"))
    mixed = stage(rows.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("greatest")).where("least != greatest").select("key", F.lit(True).alias("mixed")))
    if mixed.isEmpty():
        return rows
    return rows.join(mixed, "key", "left").select("doc_id", "text", F.when(F.col("mixed"), F.concat("key", "text")).otherwise(F.col("key")).alias("key"))


def equal_texts(docs: DataFrame, digest: Callable[[Column], Column] = digest128, hot_share: int = 100_000, hot_rows: int = 1000) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    A class is joined by broadcast where it has more than `hot_rows` rows and more than one `hot_share`-th of all rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "content-keys")
    _keyed(docs, digest).select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    limit = max(hot_rows, rows.count() // hot_share)
    copies = stage(rows.groupBy("key").agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row")).where("group_size > 1"))
    is_hot = (F.col("group_size") > limit) & (F.length("key") <= 16)
    hot = F.broadcast(copies.where(is_hot))  # fewer than hot_share rows of some 50 bytes
    spread = rows.join(F.broadcast(copies.where(is_hot).select("key")), "key", "left_anti").join(copies.where(~is_hot), "key", "left")
    both = rows.join(hot, "key").unionByName(spread)
    alone = F.col("group_size").isNull()
    return both.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")
