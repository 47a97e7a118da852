"""Exact top-k search by integer inner product with MaxScore over sharded postings.

Terms are the signed dimensions of the vectors: dimension d has one posting list of the vectors with a positive component and
one of those with a negative component. A query weighs the lists by its own component, so on each list it only gains or only loses.
A list's bound for a query is the weight times the list's largest value (0 for lists on which it loses). In each shard the lists are ordered by bound; the
longest head whose bounds sum up to less than the k-th best score so far is non-essential: a vector on no essential list cannot
enter the result. Essential postings are traversed, the candidates found probe the other lists from the highest bound down and are dropped when their
partial score and the bounds left miss the k-th best score. The shards' results are merged.

Vectors are dealt to shards of about `shard_rows` and queries to blocks of about `block_rows` by id hash, both numbers following
the row counts; every shard meets every block once.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0 with every other; shorter
vectors have zeros at the missing places; components beyond 32 bits are clamped; ties go to the smaller id; rows that repeat an id are candidates
of their own, but never of a query of that id; null ids take no part; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null where the vector takes no part."""
    x = F.transform(column, lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v * scale), F.lit(-(1 << 31))), F.lit((1 << 31) - 1)).cast("int"))
    return F.when(F.col(column).isNotNull() & F.coalesce(usable, F.lit(False)), whole)


class Shard:
    """Postings of one shard: for every signed dimension the rows and the absolute components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].T)  # one row per dimension
        self.postings = []
        for d in range(len(self.vectors)):
            for sign in (1, -1):
                rows = np.flatnonzero(self.vectors[d] * sign > 0)
                self.postings.append((d, sign, rows, np.abs(self.vectors[d, rows])))
        self.largest = np.array([v.max() if len(v) else 0 for *_, v in self.postings], np.int64)
        self.of = np.array([d for d, *_ in self.postings], np.int64)
        self.sign = np.array([s for _, s, *_ in self.postings], np.int64)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best by score, then by id (rows are in id order)."""
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors of this shard, other than the query's own id."""
        other = self.ids != query_id
        if not other.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weight = query[self.of] * self.sign if len(self.of) else np.zeros(0, np.int64)
        bound = np.maximum(weight, 0) * self.largest
        gains = np.flatnonzero(bound > 0)
        gains = gains[np.argsort(bound[gains], kind="stable")]
        # First threshold: exact scores of the vectors that lead the strongest lists.
        seeds = [np.zeros(0, np.int64)]
        for t in gains[::-1][:4]:
            rows, values = self.postings[t][2:]
            top = np.argpartition(values, len(values) - min(4 * k, len(values)))[-4 * k:]
            seeds.append(rows[top])
        seed = np.unique(np.concatenate(seeds))
        seed = seed[other[seed]]
        least = -np.inf  # the k-th best score so far
        if len(seed) >= k:
            scores = query @ self.vectors[:, seed]
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
        head = np.cumsum(bound[gains])
        essential = int(np.searchsorted(head, least, "left")) if least > 0 else 0  # a vector on no gaining list scores at most 0
        score, met = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for t in gains[essential:]:
            rows, values = self.postings[t][2:]
            score[rows] += weight[t] * values
            met[rows] = True
        if least <= 0:
            met[:] = True
        rows = np.flatnonzero(met & other)
        score = score[rows]
        for i in range(essential - 1, -1, -1):  # probe the non-essential lists, the highest bound first
            alive = score + head[i] >= least
            rows, score = rows[alive], score[alive]
            d = self.of[gains[i]]
            score = score + weight[gains[i]] * np.maximum(self.vectors[d, rows] * self.sign[gains[i]], 0)
        for t in np.flatnonzero(weight < 0)[np.argsort(weight[weight < 0] * self.largest[weight < 0], kind="stable")]:  # lists on which the query only loses
            alive = score >= least
            rows, score = rows[alive], score[alive]
            score = score + weight[t] * np.maximum(self.vectors[self.of[t], rows] * self.sign[t], 0)
        rows, score = self._best(rows, score, k)
        return self.ids[rows], score


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows, filled with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    length = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(length), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(np.arange(len(length)), length), at] = flat
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row that `queries` selects."""
    rows = vectors.select("vec_id", quantised("embedding", scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(F.size("v")).alias("w")).first()
    shards, blocks, width = max(1, -(-size["n"] // shard_rows)), max(1, -(-size["q"] // block_rows)), size["w"] or 0
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    stored = rows.select("vec_id", "v", F.lit(False).alias("probe"), part(shards).alias("shard"), F.explode(each(blocks)).alias("block"))
    probing = rows.where("is_query").select("vec_id", "v", F.lit(True).alias("probe"), F.explode(each(shards)).alias("shard"), part(blocks).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        probe = np.asarray(table.column("probe").to_numpy(), bool)
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), width)
        shard = Shard(ids[~probe], v[~probe])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        asked = np.flatnonzero(probe)
        for q in asked.tolist():
            out.append(shard.search(int(ids[q]), v[q], k))
        counts = [len(i) for i, _ in out]
        return pa.table({"query_id": np.repeat(ids[asked], counts).astype(np.int64), "vec_id": np.concatenate([i for i, _ in out] or [np.zeros(0, np.int64)]).astype(np.int64),
                         "score": np.concatenate([s for _, s in out] or [np.zeros(0, np.int64)]).astype(np.int64), "row": np.repeat(asked, counts).astype(np.int64)})
    found = stored.unionByName(probing).groupBy("shard", "block").applyInArrow(run, "query_id long, vec_id long, score long, row long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each shard
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
