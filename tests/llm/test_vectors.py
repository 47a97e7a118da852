"""Centroid clustering and whitening against brute force, and their defined results of odd vectors."""
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import centroids, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute_clusters(rows, k, rounds, width, scale=1024, seed=3):
    """Lloyd's rounds in Python's whole numbers over rows of (id, whole vector)."""
    del scale
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [r[1] for r in sorted(rows, key=key)[:k]]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda: [min(range(len(c)), key=lambda j: (away(x, c[j]), j)) for _, x in rows]
    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            mine = [x for (_, x), w in zip(rows, a) if w == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    a = assign()
    top = (1 << 63) - 1
    d = [min(away(x, c[w]), top) for (_, x), w in zip(rows, a)]
    own = [min(sum(e for e, v in zip(d, a) if v == w), top) for w in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, w, e, own[w], min(sum(d), top), sha[w]) for (i, _), w, e in zip(rows, a, d)], key=repr)


def whole(v):
    return [max(-(1 << 62), min(1 << 62, math.floor(x * 1024))) for x in v]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Ties, repeated rows and ids, null ids, and vectors that take no part, of width 4; columns with clashing names."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4) / 4]) for i in range(60)]  # many ties and equal vectors
    rows += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (None, [0.25, 0.0, 0.0, 1.0]), (None, None), (100, None), (101, [1.0, None, 0.0, 0.0]),
             (102, [1.0, float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("x", "row", "part", "key", "n", "cluster", "w", "id", "place", "block", "start", "d")])


def test_clusters_of_odd_vectors(spark, odd_vectors):
    more = spark.createDataFrame([(200, [1.0, 2.0]), (201, [0.0] * 5), (202, [])], SCHEMA)  # other widths take no part
    df = odd_vectors.unionByName(more, allowMissingColumns=True)
    rows = [(r.vec_id, whole(r.embedding)) for r in df.collect() if r.embedding and len(r.embedding) == 4 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    for k, rounds in ((8, 10), (3, 1), (200, 2)):
        got = sorted(map(tuple, centroids.cluster(df, k=k, rounds=rounds, width=4).collect()), key=repr)
        assert got == brute_clusters(rows, k, rounds, 4) and len(got) == 63
    assert centroids.cluster(df.limit(0), width=4).count() == 0 and centroids.cluster(df, width=9).count() == 0


@pytest.mark.parametrize("size", [1.0, 2.0 ** 18, 2.0 ** 40, 1e300])
def test_clusters_of_large_components(spark, size):
    """Doubles, longs and Python's own numbers give the same result; beyond 2**62 components and beyond a long distances are held."""
    r = np.random.default_rng(6)
    rows = [(i, [float(x) * size for x in r.integers(-5, 6, 3)]) for i in range(30)]
    got = sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=4, width=3).collect()), key=repr)
    assert got == brute_clusters([(i, whole(v)) for i, v in rows], 4, 10, 3)


def test_tournament_keeps_the_smaller_number_on_a_bisector():
    t = centroids.Tournament([[0, 0], [4, 0], [0, 4], [4, 0]])
    winner, distance = t.nearest(np.array([[2, 0], [2, 2], [4, 0], [0, 3], [3, 3]]))
    assert winner.tolist() == [0, 0, 1, 2, 1] and distance.tolist() == [4, 8, 0, 1, 10]


def brute_whitening(x, components):
    """Covariance, eigenvectors and deviations of whole vectors by numpy and Python's whole numbers."""
    n = len(x)
    s = [sum(col) for col in zip(*x)]
    centred = np.array([[(n * v - t) / n for v, t in zip(row, s)] for row in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    deviation = [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    return centred @ vector[:, :components] / np.sqrt(value[:components]), deviation, value[:components] / value.sum()


def check_whitening(got, rows, components):
    w, deviation, explained = brute_whitening([x for _, x in rows], components)
    assert len(got) == len(rows) * components and {r.n for r in got} == {len(rows)}
    assert all(r.identity_error < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-9 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    want = {}
    for (i, _), d, v in zip(rows, deviation, w):
        want.setdefault((i, min(d, vectors.LONG_MAX)), []).append(v)
    assert set(by) == set(want)
    for c in range(1, components + 1):
        pairs = [(sorted(by[k][c]), sorted(v[c - 1] for v in want[k]), sorted(-v[c - 1] for v in want[k])) for k in want]
        assert any(all(np.allclose(p[0], p[s], atol=1e-7) for p in pairs) for s in (1, 2))  # one sign for all rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "panel_blocks": 5}])
def test_whitening_equals_numpy(spark, sizes):
    """One block, and several panels of several blocks with a short last one."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)
    rows = [(r.vec_id, [math.floor(v * 1024) + 100000 for v in r.embedding]) for r in df.collect()]
    check_whitening(whitening.whiten(df, **sizes).collect(), rows, 8)


def test_whitening_of_odd_vectors(spark, odd_vectors):
    short = spark.createDataFrame([(200, [1.0, 2.0]), (201, [])], SCHEMA)  # missing places are zero
    df = odd_vectors.unionByName(short, allowMissingColumns=True)
    usable = [r for r in df.collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    rows = [(r.vec_id, [math.floor(v * 1024) + 100000 for v in r.embedding + [0.0] * (4 - len(r.embedding))]) for r in usable]
    check_whitening(whitening.whiten(df, block_rows=8).collect(), rows, 4)
    check_whitening(whitening.whiten(df, components=2).collect(), rows, 2)
    for nothing in (df.limit(0), df.where("vec_id = 200"), df.where("vec_id = 7 AND embedding = array(0.5D, 0.5D, 0.5D, 0.5D)"), df.where("vec_id = 201")):
        assert whitening.whiten(nothing).count() == 0


def test_whitening_of_large_entries_and_low_rank(spark):
    big = spark.createDataFrame([(i, [float(i * 2 ** 30), float(i % 3 * 2 ** 30)]) for i in range(40)], SCHEMA)
    rows = [(r.vec_id, [math.floor(v * 1024) + 100000 for v in r.embedding]) for r in big.collect()]
    check_whitening(whitening.whiten(big).collect(), rows, 2)  # decimals; deviations beyond a long are held
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(40)], SCHEMA)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
