"""Language identification with a byte convolutional network.

A text is cut into windows of WINDOW bytes. Filters of several widths slide over a window's embedded bytes; each filter's maximum over
the window goes through a rectifier into a softmax layer. The network is trained with numpy on windows of a bounded sample of
labelled texts (about `per_language` documents of each language, `windows_per_text` windows of each). Every window of every text is then judged; a text's
language has the highest mean log-probability over its windows, weighted by their bytes.

For prediction the first layer is folded into tables over byte pairs, so that a position costs two look-ups.

Defined results: a null text, and a text without a letter, is `und` with score 0; without anything to learn from every text is `und`;
repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.bpe import release
from riskspark.llm.text import chunks, drawn, fold_of, map_arrow, once, utf8

#: Bytes of a window; filter widths; filters of each width; numbers of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 12


class ByteNet:
    """Embedding, filters of widths 2, 3 and 4 with max pooling, and a softmax layer."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED))} | {f"K{w}": rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS} | {"W": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)), "c": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Filter maxima of windows (n, WINDOW) and where they stand."""
        out, where = [], {}
        for w in WIDTHS:
            table = [self.p["E"] @ self.p[f"K{w}"][k] for k in range(w)]
            z = sum(table[k][x[:, k:x.shape[1] - w + 1 + k]] for k in range(w))
            where[w] = z.argmax(1)
            out.append(np.take_along_axis(z, where[w][:, None], 1)[:, 0] + self.p[f"b{w}"])
        return np.concatenate(out, 1), where

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy; only a filter's best position passes one on."""
        m, where = self.pooled(x)
        h = np.maximum(m, 0)
        logits = h @ self.p["W"] + self.p["c"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        g = {"W": h.T @ q, "c": q.sum(0), "E": np.zeros_like(self.p["E"])}
        back = (q @ self.p["W"].T) * (m > 0)
        rows, cols = np.repeat(np.arange(len(y)), FILTERS), np.tile(np.arange(FILTERS), len(y))
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(0)
            g[f"K{w}"] = np.zeros_like(self.p[f"K{w}"])
            for k in range(w):
                byte = x[rows, where[w].ravel() + k]
                table = np.bincount(byte.astype(np.int64) * FILTERS + cols, d.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                g[f"K{w}"][k] = self.p["E"].T @ table
                g["E"] += table @ self.p[f"K{w}"][k].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 600, size: int = 64, rate: float = 4e-3, seed: int = 3) -> "ByteNet":
        """Adam on random batches; a third of the windows is shortened at random, so that short texts are met too."""
        rng = np.random.default_rng(seed)
        first, second = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), size)
            batch = x[pick].copy()
            cut = np.where(rng.random(size) < 0.33, rng.integers(4, WINDOW, size), WINDOW)
            batch[np.arange(WINDOW)[None] >= cut[:, None]] = 0
            step = rate * (1 - t / (steps + 1))
            for k, g in self.gradients(batch, y[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.p[k] -= (step * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self


class FoldedNet:
    """The same network with its first layer as two tables over byte pairs."""

    def __init__(self, p: dict[str, np.ndarray]):
        t = {(w, k): p["E"] @ p[f"K{w}"][k] for w in WIDTHS for k in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.here = np.concatenate([pair(t[2, 0], t[2, 1]), pair(t[3, 0], t[3, 1]), pair(t[4, 0], t[4, 1])], 1)
        self.ahead = np.concatenate([pair(t[3, 2], np.zeros_like(t[3, 2])), pair(t[4, 2], t[4, 3])], 1)
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        self.dense, self.offset = p["W"], p["c"]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows (n, WINDOW)."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        z = self.here[pairs]  # (n, WINDOW - 1, 3 * FILTERS)
        ahead = self.ahead[pairs[:, 2:]]
        two = z[:, :, :FILTERS].max(1)
        # The last place of a width-3 filter has no pair ahead of it, only the window's last byte.
        three = z[:, :-2, FILTERS:2 * FILTERS] + ahead[:, :, :FILTERS]
        last = z[:, -2, FILTERS:2 * FILTERS] + self.ahead[x[:, -1].astype(np.int32) << 8, :FILTERS]
        four = (z[:, :-2, 2 * FILTERS:] + ahead[:, :, FILTERS:]).max(1)
        h = np.maximum(np.concatenate((two, np.maximum(three.max(1), last), four), 1) + self.bias, 0)
        logits = h @ self.dense + self.offset
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def windows(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The windows of one text, the last one filled with zeros."""
    n = -(-(b - a) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[:b - a] = data[a:b]
    return out.reshape(n, WINDOW)


def training_windows(docs: DataFrame, per_language: int, windows_per_text: int = 6) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and classes of about `per_language` texts of each language, drawn by id and text, and the languages in order."""
    known = docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", 4) != 2) & F.col("text").rlike("\\p{L}"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    sample = drawn(known.select("doc_id", "lang", "text"), per_language, 41, "lang").select("doc_id", "lang", "text", "__k")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(2))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            w = windows(data, a, b)
            out.append(w[np.unique(np.linspace(0, len(w) - 1, windows_per_text).astype(int))].tobytes())
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], names=["doc_id", "lang", "__k", "x"])
    found = once(map_arrow(sample, run, "doc_id long, lang string, __k long, x binary"), int(1.5 * per_language * len(languages)) + 10)
    rows = sorted(found.collect(), key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], r["x"]))
    x = [np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW) for r in rows]
    y = [np.full(len(w), languages.index(r["lang"])) for r, w in zip(rows, x, strict=True)]
    return (np.concatenate(x), np.concatenate(y), languages) if x else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])


def _balanced(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every class in equal number, by repeating the smaller classes."""
    most = np.bincount(y, minlength=classes).max()
    pick = np.concatenate([np.resize(np.flatnonzero(y == c), most) for c in range(classes) if (y == c).any()])
    return x[pick], y[pick]


def identify(docs: DataFrame, per_language: int = 800, keep: list[str] | None = None, windows_per_text: int = 6) -> DataFrame:
    """doc_id, held_out, lang_pred and score (probability of lang_pred) of every whole text, and the columns in `keep`."""
    keep = keep or []
    own = [c for c in keep if c != "text"]  # a kept text is the one judged: it goes to the workers once
    x, y, languages = training_windows(docs, per_language, windows_per_text)
    held_out = (fold_of("doc_id", 4) == 2).alias("held_out")
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if not len(x):
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *keep)
    net = docs.sparkSession.sparkContext.broadcast(ByteNet(len(languages)).train(*_balanced(x, y, len(languages))).p)  # a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        folded = FoldedNet(net.value)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in chunks(offsets, 1 << 18):
                size = np.diff(offsets[i:j + 1])
                first = np.concatenate(([0], np.cumsum(-(-size // WINDOW))))
                total = np.zeros((j - i, len(languages)))
                parts = [windows(data, int(a), int(b)) for a, b in zip(offsets[i:j], offsets[i + 1:j + 1], strict=True)]
                stack = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)
                owner = np.repeat(np.arange(j - i), np.diff(first))
                weight = np.minimum(WINDOW, size[owner] - (np.arange(len(stack)) - first[owner]) * WINDOW)
                for a in range(0, len(stack), 64):  # small enough for the cache
                    np.add.at(total, owner[a:a + 64], folded.log_probabilities(stack[a:a + 64]) * weight[a:a + 64, None])
                mean = total / np.maximum(size, 1)[:, None]
                q = np.exp(mean - mean.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                letters = np.array(batch.column(3).slice(i, j - i).to_pylist(), bool)
                best = q.argmax(1)
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([languages[b] if k else "und" for b, k in zip(best, letters, strict=True)]),
                    pa.array(np.where(letters, q[np.arange(j - i), best], 0.0)),
                    *(batch.column(2 if c == "text" else 4 + own.index(c)).slice(i, j - i) for c in keep)],
                    names=["doc_id", "held_out", "lang_pred", "score", *keep])
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters")
    return docs.select("doc_id", held_out, "text", letters, *own).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + more)


def with_language(docs: DataFrame, least: float = 0.0, per_language: int = 800) -> DataFrame:
    """Rows of `docs` with an identifiable language, found with a probability of at least `least`, with all their columns; `lang` becomes the language found."""
    kept = {c: "text" if c == "text" else f"__{i}" for i, c in enumerate(docs.columns) if c != "lang"}  # columns may bear the names of results
    given = docs.select("doc_id", "text", "lang", *[F.col(f"`{c}`").alias(n) for c, n in kept.items() if c != "text"])
    found = identify(given, per_language, list(kept.values())).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col(kept.get(c, "lang_pred")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
