"""Reads and key-merge writes of the stored tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def read_ledger(df: DataFrame, institution: str | None = None, signal_type: str | None = None,
                domain: str | None = None, contradictory_only: bool = False, order: list[str] | None = None) -> DataFrame:
    """Filtered, ordered read; the filters reach the Parquet scan."""
    if institution is not None:
        df = df.where(F.col("institution_id") == institution)
    if signal_type is not None:
        df = df.where(F.col("signal_type") == signal_type)
    if domain is not None:
        df = df.where(F.col("domain") == domain)
    if contradictory_only:
        df = df.where("is_contradictory")
    return df.orderBy(*order) if order else df


def search(df: DataFrame, text: str | None, fields: list[str], exact: dict | None = None,
           array_fields: list[str] | None = None, order: list | None = None, limit: int | None = None,
           offset: int = 0) -> DataFrame:
    """Exact filters plus a case-insensitive substring over several columns and array columns."""
    for c, v in (exact or {}).items():
        df = df.where(F.col(c) == v)
    if text:
        q = text.lower()
        hit: Column = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
        for c in array_fields or []:
            hit = hit | F.coalesce(F.exists(c, lambda x: F.lower(x).contains(q)), F.lit(False))
        df = df.where(hit)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def newest_per_key(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last write per key as a hash aggregation with map-side combine, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_by_id(stored: DataFrame, incoming: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Upsert: the incoming row replaces the stored row of the same key; the last incoming one wins."""
    u = stored.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    u = u.withColumn("_w", F.struct("_o", seq))
    return newest_per_key(u, keys, "_w").drop("_o", "_w")


def merge_snapshots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge_by_id(stored, incoming, ["institution_id", "academic_year", "department", "signal_type"])


def append_signals(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of ``incoming`` whose id and fingerprint are neither stored nor earlier in the batch; first wins.

    Ids derive from fingerprints, so the first row per id and then per fingerprint is the first accepted row.
    """
    def first(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r")).select(
            key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    fresh = incoming.join(stored.select("signal_id"), "signal_id", "left_anti").join(
        stored.select("fingerprint"), "fingerprint", "left_anti")
    return first(first(fresh, "signal_id"), "fingerprint").select(*incoming.columns)


def merge_memory(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by memory_id that keeps category and creation time of a stored entry."""
    new = newest_per_key(incoming, ["memory_id"], "seq")
    j = stored.alias("s").join(new.alias("n"), "memory_id", "full")
    fixed = ["institution_id", "category", "created_at"]
    updated = ["statement", "confidence", "evidence_refs", "payload"]
    both = lambda a, b, c: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return j.select("memory_id", *[both("s", "n", c) for c in fixed], *[both("n", "s", c) for c in updated],
                    both("n", "s", "seq"))


def delete_dataset(signals: DataFrame, snapshots: DataFrame, ingestions: DataFrame, ingestion_ids: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining signals, remaining snapshots, next active ingestion per institution)."""
    gone = ingestion_ids.select("ingestion_id")
    left = ingestions.join(gone, "ingestion_id", "left_anti")
    return (
        signals.join(gone, "ingestion_id", "left_anti"),
        snapshots.join(gone.withColumnRenamed("ingestion_id", "provenance_id"), "provenance_id", "left_anti"),
        left.groupBy("institution_id").agg(
            F.max_by("ingestion_id", F.struct("created_at", "ingestion_id")).alias("active_id")),
    )


def stale_assessments(assessments: DataFrame, signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Assessments of institutions that have no data left."""
    return assessments.join(signals, "institution_id", "left_anti").join(snapshots, "institution_id", "left_anti")


def drop_seen_content(files: DataFrame, ingestions: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content hash this institution has not ingested; the first of equal files in the batch stays."""
    h = files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    fresh = h.join(ingestions.select("institution_id", "content_hash"), ["institution_id", "content_hash"], "left_anti")
    rest = [c for c in fresh.columns if c not in ("institution_id", "content_hash")]
    return fresh.groupBy("institution_id", "content_hash").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_r")).select(
        "institution_id", "content_hash", *[F.col(f"_r.{c}").alias(c) for c in rest])
