"""Centroid clustering of vectors by a tournament of bisectors, in whole numbers.

For every pair of centroids i < j the bisecting plane is kept as an integer normal 2 (c_j - c_i) and an integer threshold |c_j|^2 - |c_i|^2:
a vector x is nearer to j exactly where normal . x - threshold > 0, and on the plane the smaller number wins. A vector's nearest centroid is
the winner of k - 1 such tests, each of which eliminates one centroid; only the winner's distance is computed, and exactly.

Every round sends the k centroids to the tasks; a task returns one row of sums for each centroid, and Spark adds up these rows. No round
shuffles vectors, so a third of all vectors in one cluster costs what they would in several. The vectors are written once as whole numbers.

Defined results: vectors that are null, hold null or non-finite components or have another number of components than `width` take no part; null
ids take part with an empty id text; rows that repeat an id are vectors of their own; first centroids with equal hashes go by their components;
with fewer than k vectors there are as many centroids; equal centroids leave the greater number empty; empty centroids stay; components beyond
2**62 are held there; distances and sums beyond a long are given as the largest long; other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.vectors import LONG_MAX, exact_type, rows_of, whole
from riskspark.session import shared_folder

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Tournament:
    """Bisectors of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object)
        square = [sum(v * v for v in c) for c in centroids]
        self.normal = {(i, j): 2 * (self.centroids[j] - self.centroids[i]) for j in range(len(centroids)) for i in range(j)}
        self.threshold = {(i, j): square[j] - square[i] for i, j in self.normal}
        self.largest = max(max(map(abs, c), default=0) for c in centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance (at most the largest long) of every row's nearest centroid."""
        most = max(int(np.abs(x).max(initial=0)), self.largest, 1)
        kind = exact_type(8 * x.shape[1] * most * most)
        x = x.astype(kind)
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            for i in np.unique(winner).tolist():
                rows = np.flatnonzero(winner == i)
                side = x[rows] @ self.normal[i, j].astype(kind) - self.threshold[i, j]
                winner[rows[(side > 0).astype(bool)]] = j
        away = x - self.centroids.astype(kind)[winner]
        distance = (away * away).sum(axis=1) if len(x) else np.zeros(0, kind)
        return winner, np.minimum(distance, LONG_MAX).astype(np.int64) if kind is object else distance.astype(np.int64)


def _sums(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[tuple[int, int, list[int]]]:
    """(count, distance sum, component sums) of every cluster; at most k rows reach the driver."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament, count, inertia, total = Tournament(centroids), [0] * k, [0] * k, np.zeros((k, width), object)
        for batch in batches:
            x = rows_of(batch.column(0), width)
            winner, distance = tournament.nearest(x)
            kind = exact_type(len(x) * max(int(np.abs(x).max(initial=0)), 1))
            for c in np.unique(winner).tolist():
                rows = winner == c
                count[c] += int(rows.sum())
                inertia[c] += int(distance[rows].sum(dtype=exact_type(len(x) * int(distance[rows].max()))))
                total[c] += [int(v) for v in x[rows].astype(kind).sum(axis=0)]
        number = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
        yield pa.record_batch({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(count, pa.int64()), "inertia": number(inertia),
                               "sums": pa.ListArray.from_arrays(pa.array(range(0, (k + 1) * width, width), pa.int32()), number(total.ravel()))})
    parts = vectors.select("x").mapInArrow(run, "cluster int, n long, inertia decimal(38,0), sums array<decimal(38,0)>")
    rows = parts.groupBy("cluster").agg(F.sum("n"), F.sum("inertia"), *[F.sum(F.col("sums")[d]) for d in range(width)]).collect()
    found = {r[0]: (r[1], int(r[2]), [int(v) for v in r[3:]]) for r in rows}
    return [found.get(c, (0, 0, [0] * width)) for c in range(k)]


def first_centroids(vectors: DataFrame, k: int, key: Column) -> list[list[int]]:
    """Components of the k vectors with the smallest keys, ties by components."""
    return [list(r.x) for r in vectors.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector after `rounds` rounds.

    Components are floor(scale * x). The first centroids are the k vectors with the smallest sha256 of "seed:vec_id".
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", whole("embedding", scale).alias("x")).where(F.size("x") == width)
    folder = shared_folder(spark, "whole-vectors")
    kept.write.parquet(folder)
    kept = spark.read.parquet(folder)
    centroids = first_centroids(kept, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    if not centroids:
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        moved = [[s // n for s in sums] if n else c for c, (n, _, sums) in zip(centroids, _sums(kept, centroids, width), strict=True)]
        if moved == centroids:  # further rounds would change nothing
            break
        centroids = moved
    inertia = [i for _, i, _ in _sums(kept, centroids, width)]
    of_all, of_each = min(sum(inertia), LONG_MAX), np.array([min(i, LONG_MAX) for i in inertia], np.int64)
    digest = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for batch in batches:
            winner, distance = tournament.nearest(rows_of(batch.column(1), width))
            yield pa.record_batch({"vec_id": batch.column(0).cast(pa.int64()), "cluster": winner.astype(np.int32), "distance": distance, "cluster_inertia": of_each[winner],
                                   "inertia": np.full(len(winner), of_all, np.int64), "centroid_sha256": pa.array(digest[winner], pa.string())})
    return kept.mapInArrow(run, RESULT)
