"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1- and 2-grams (runs without white space, A-Z lower-cased) and of byte 3-grams, hashed to a fixed number of
slots. Each indicator is scaled by its class log-count ratio, each text's vector to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. A logistic curve over cross-fitted margins turns margins into probabilities at the classes' true shares.

The model is fitted on at most `per_class` labelled texts of each class (those with the smallest hash of the id); every text is scored whole.

Defined results: null and empty texts get the score of a text without features; a document whose label rows disagree, or with a null label
or id, is not learned from; with one class or none to learn from every score is that class's share (0.5 if none); repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.text import byte_class, chunks, fold_of, grams, map_arrow, utf8, words

WORD = byte_class(r"[^\x20\x09-\x0D]")
#: log2 of the slots of word n-grams and of byte 3-grams.
WORD_BITS, BYTE_BITS = 18, 17
SLOTS = (1 << WORD_BITS) + (1 << BYTE_BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of every text, in text order, and their offsets."""
    value, _, _, at = words(data, offsets, WORD)
    docs = len(offsets) - 1
    keys = []
    for n in (1, 2):
        g, go = grams(value, at, n)
        keys.append((np.repeat(np.arange(docs), np.diff(go)) << WORD_BITS) | (g >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    word_doc, word_slot = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    flags = np.zeros(1 << BYTE_BITS, bool)
    byte_slots = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        x = data[a:b].astype(np.uint32)
        code = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BYTE_BITS) if len(x) > 2 else x[:0]
        flags[code] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        byte_slots.append(found + (1 << WORD_BITS))
    count = np.array([len(s) for s in byte_slots], np.int64)
    doc = np.concatenate((word_doc, np.repeat(np.arange(docs), count)))
    slot = np.concatenate((word_slot, *byte_slots))
    order = np.argsort(doc, kind="stable")
    return slot[order], np.searchsorted(doc[order], np.arange(docs + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the classes' smoothed, normalised indicator counts."""
    p, q = np.ones(SLOTS), np.ones(SLOTS)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over scaled, unit-length indicator rows."""
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])  # 1 for the bias, learned as a constant feature
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([ratio[x] @ w[x] / max(np.sqrt(ratio[x] @ ratio[x]), 1e-12) + bias if len(x) else bias for x in rows])


def logistic_curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of labels on margins, by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    t = (y > 0).astype(float)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([g @ m + 1e-2 * a, g.sum()])
        hess = np.array([[h @ (m * m) + 1e-2, h @ m], [h @ m, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, c: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """(slot weights already scaled by the ratio, bias, slope, offset); `share` is the true share of class +1."""
    part = np.where(y > 0, share, 1 - share) / np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    cost = c / np.where(y > 0, 2 * (y > 0).mean(), 2 * (y < 0).mean())

    def model(keep: np.ndarray):
        some = [rows[i] for i in keep]
        ratio = log_count_ratio(some, y[keep])
        return ratio, *dual_coordinate_descent(some, y[keep], ratio, cost[keep])
    fold = np.random.default_rng(11).integers(0, 3, len(rows))
    held = np.zeros(len(rows))
    for k in range(3):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[inside])) < 2:
            continue
        held[outside] = margins([rows[i] for i in outside], *model(inside))
    slope, offset = logistic_curve(held, y, part)
    ratio, w, bias = model(np.arange(len(rows)))
    return np.stack((ratio * w, ratio * ratio)).astype(np.float32), bias, slope, offset


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Features and labels (+1, -1) of the bounded sample, and the share of +1 among all labelled rows outside the held-out fold."""
    known = labels.where(fold_of("doc_id", 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.count("*").alias("n"), F.count("quality").alias("m")) \
        .where("q = q2 AND n = m AND doc_id IS NOT NULL AND q IN (0, 1)").select("doc_id", "q")
    counts = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}
    sample = [r for q in (0, 1) for r in known.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    if not sample:
        return [], np.zeros(0), share
    small = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["q"])) for r in sample], "doc_id long, q int")
    texts = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * per_class rows on the small side

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        for i, j in chunks(offsets):
            slot, at = features(data, offsets[i:j + 1])
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                                   pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "q", "x"])
    got = sorted(map_arrow(texts.select("doc_id", "text", "q"), run, "doc_id long, q int, x binary").collect())
    return [np.frombuffer(r["x"], np.int32) for r in got], np.array([1.0 if r["q"] else -1.0 for r in got]), share


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted of every whole text."""
    rows, y, share = training_rows(docs, labels, per_class)
    if len(set(y.tolist())) < 2:
        constant = F.lit(float(share))
        return docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), constant.alias("score"), (constant >= 0.5).cast("int").alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, y, share))  # two tables of SLOTS numbers

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (weight, square), bias, slope, offset = model.value
        data, offsets = utf8(batch.column(2))
        for i, j in chunks(offsets):
            slot, at = features(data, offsets[i:j + 1])
            margin = _sums(weight[slot], at) / np.sqrt(np.maximum(_sums(square[slot], at), 1e-24)) + bias
            score = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score),
                                   pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return map_arrow(docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
