"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of whole documents (up to SHARD_BYTES of text). Its words become the symbols of a text: words that occur in the
benchmark keep an id, any other word and every document end is a terminator of its own. The suffixes are sorted by prefix doubling; the
Burrows-Wheeler transform is held in a wavelet matrix with bit ranks. All distinct benchmark windows are searched backward at
once, surviving row intervals are located by walking to sampled suffix positions, and the located windows are merged to removal spans.

The benchmark's phrases are broadcast in blocks of at most `block_windows` windows (plus one item); a larger benchmark takes several
passes whose hits are merged. Words are compared by 64-bit fingerprints.

Defined results: a null or empty text has no words, no hits and is clean; items without words have no windows; an item with a null id
hits words but is not listed; repeated rows and repeated item ids are judged alike, an id counts once; extra columns are ignored; an empty
table gives an empty result, an empty benchmark gives clean documents.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.text import byte_class, chunks, map_arrow, minus, text_key, utf8, words

#: A word is a run of ASCII letters, digits and non-ASCII characters; A-Z are lower-cased.
WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
WINDOW = 13
SHARD_BYTES = 4 << 20
#: Every so many positions one suffix position is kept in the index.
SAMPLE = 8


class Phrases:
    """Distinct benchmark windows as word ids, and the items that hold each."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        value, _, _, at = words(*utf8(pa.array([t or "" for _, t in items], pa.string())), WORD)
        self.vocabulary = np.unique(value)
        ids = np.searchsorted(self.vocabulary, value) + 1
        holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for (item, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist(), strict=True):
            w = ids[a:b].tolist()
            for k in range(max(len(w) - window + 1, min(len(w), 1))):
                key = tuple(w[k:k + window])
                if item is None:
                    holders[key]
                else:
                    holders[key].add(str(item))
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for key in holders:
            by_length[len(key)].append(key)
        self.groups = [(m, np.array(keys, np.int64), [sorted(holders[k]) for k in keys]) for m, keys in sorted(by_length.items())]


class WaveletMatrix:
    """Rank of a symbol before a position, by one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> s.dtype.type(level)) & s.dtype.type(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            rest = s[~bit]
            self.zeros.append(len(rest))
            s = np.concatenate((rest, s[bit]))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i."""
        return self._down(symbol, i) - self._down(symbol, np.zeros_like(i))


def _sorted_by(high: np.ndarray, low: np.ndarray, high_bits: int, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (high, low), and where a key differs from the one before it."""
    n = len(high)
    index_bits = int(n).bit_length()
    if high_bits + low_bits + index_bits <= 64:  # the index rides in the low bits: a plain sort is much faster than an argsort
        key = np.sort((high.astype(np.uint64) << np.uint64(low_bits + index_bits)) | (low.astype(np.uint64) << np.uint64(index_bits)) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << index_bits) - 1)).astype(np.int64)
        key >>= np.uint64(index_bits)
        return order, np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    order = np.lexsort((low, high))
    h, v = high[order], low[order]
    return order, np.concatenate(([True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])))


class FMIndex:
    """Index of one shard; symbol 0 is a terminator, each different from all others."""

    def __init__(self, text: np.ndarray, largest: int):
        n = len(text)
        ends, known = np.flatnonzero(text == 0), np.flatnonzero(text)
        rank = np.empty(n + 1, np.int64)
        rank[ends] = np.arange(len(ends))
        rank[known] = len(ends) + text[known]
        rank[n] = 0
        bits = int(n + largest + 2).bit_length()
        suffix = known
        order, new = _sorted_by(text[suffix], rank[suffix + 1], int(largest).bit_length(), bits)
        suffix = suffix[order]
        start = len(ends) + np.flatnonzero(new)  # first row of every group of suffixes that are equal so far
        size = np.diff(np.append(start, n))
        rank[suffix] = np.repeat(start, size)
        rows = np.concatenate((ends, suffix))
        depth = 2
        open_rows = len(ends) + np.flatnonzero(np.repeat(size, size) > 1)
        while len(open_rows):
            s = rows[open_rows]
            order, new = _sorted_by(rank[s], rank[s + depth], bits, bits)
            s = s[order]
            rows[open_rows] = s  # groups keep their rows, so ascending ranks fall on ascending rows
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(s)))
            rank[s] = np.repeat(open_rows[at], size)
            open_rows = open_rows[np.repeat(size, size) > 1]
            depth *= 2
        kind = np.uint16 if largest < 1 << 16 else np.uint32
        before = np.where(rows > 0, text[rows - 1], 0)
        self.last = before.astype(kind)
        self.wavelet = WaveletMatrix(self.last, largest)
        self.first = len(ends) + np.concatenate(([0, 0], np.cumsum(np.bincount(text[known], minlength=largest + 1)[1:])))
        sampled = (rows % SAMPLE == 0) | (before == 0)  # a walk never crosses a terminator
        self.sampled, self.position = sampled, rows[sampled]
        self.samples_before = np.cumsum(sampled) - sampled

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: indexes of those that occur and their row intervals."""
        who, c = np.arange(len(patterns)), patterns[:, -1]
        low, high = self.first[c], self.first[c + 1]
        for k in range(patterns.shape[1] - 2, -2, -1):
            alive = low < high
            who, low, high = who[alive], low[alive], high[alive]
            if k < 0 or not len(who):
                break
            c = patterns[who, k]
            low, high = self.first[c] + self.wavelet.rank(c, low), self.first[c] + self.wavelet.rank(c, high)
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.sampled[r]
            out[todo[done]] = self.position[self.samples_before[r[done]]] + steps
            todo, r = todo[~done], r[~done]
            c = self.last[r].astype(np.int64)
            rows[todo] = self.first[c] + self.wavelet.rank(c, r)
            steps += 1
        return out


def search_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[list[dict]]]:
    """Words, hit words, items and removal spans (byte ranges) of every document of a shard."""
    value, start, end, at = words(data, offsets, WORD)
    docs, count = len(offsets) - 1, np.diff(at)
    items: list[set[str]] = [set() for _ in range(docs)]
    spans: list[list[dict]] = [[] for _ in range(docs)]
    if not len(value) or not len(phrases.vocabulary):
        return count, np.zeros(docs, np.int64), items, spans
    place = np.minimum(np.searchsorted(phrases.vocabulary, value), len(phrases.vocabulary) - 1)
    ids = np.where(phrases.vocabulary[place] == value, place + 1, 0)
    base = at + np.arange(docs + 1)  # one terminator after each document
    text = np.zeros(int(base[-1]), np.int64)
    text[np.arange(len(value)) + np.repeat(np.arange(docs), count)] = ids
    index = FMIndex(text, len(phrases.vocabulary))
    edge = np.zeros(len(text) + 1, np.int64)
    for m, patterns, holders in phrases.groups:
        who, low, high = index.search(patterns)
        if not len(who):
            continue
        many = high - low
        position = index.locate(np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum())))
        np.add.at(edge, position, 1)
        np.add.at(edge, position + m, -1)
        doc = np.searchsorted(base, position, "right") - 1
        for d, w in np.unique(np.stack((doc, np.repeat(who, many)), 1), axis=0).tolist():
            items[d].update(holders[w])
    hit = (np.cumsum(edge)[:-1] > 0)[np.arange(len(value)) + np.repeat(np.arange(docs), count)]
    sums = np.concatenate(([0], np.cumsum(hit)))
    hits = sums[at[1:]] - sums[at[:-1]]
    for d in np.flatnonzero(hits).tolist():
        h = np.flatnonzero(hit[at[d]:at[d + 1]])
        first = np.flatnonzero(np.concatenate(([True], np.diff(h) > 1)))
        last = np.append(first[1:] - 1, len(h) - 1)
        shift = int(offsets[d] - offsets[0])
        spans[d] = [{"start": int(a) - shift, "end": int(b) - shift, "words": int(k)} for a, b, k in
                    zip(start[at[d] + h[first]], end[at[d] + h[last]], last - first + 1, strict=True)]
    return count, hits, items, spans


def _one_pass(rows: DataFrame, items: list[tuple[object, str]], window: int) -> DataFrame:
    phrases = rows.sparkSession.sparkContext.broadcast(Phrases(items, window))
    names = rows.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        for i, j in chunks(offsets, SHARD_BYTES):
            n, hits, found, spans = search_shard(data, offsets[i:j + 1], phrases.value)
            yield pa.record_batch([
                batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(s) for s in found], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))),
                *(c.slice(i, j - i) for c in batch.columns[2:])], names=[names[0], "n_words", "n_hit", "items", "spans", *names[2:]])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [names[0], *names[2:]])
    first, _, rest = kinds.partition(", ")
    return map_arrow(rows, run, f"{first}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long,words:long>>" + (", " + rest if rest else ""))


def _merged(spans):
    """Union of the byte ranges of one document (the caller counts their words anew)."""
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:long,end:long,words:long>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), s["words"].alias("words")))),
    ).otherwise(F.concat(a, F.array(s))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = 200_000, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Words, hit words, hit items and removal spans (UTF-8 byte ranges) of every document, and the verdict n_hit * share >= n_words.

    `keep` names further columns of `docs` to carry along.
    """
    keep = keep or []
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)))
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").withColumn("n", n_words)
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_windows))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = docs.select("doc_id", "text", *keep)
    block = lambda k: [tuple(r) for r in items.where(part == k).select("item_id", "text").collect()]  # noqa: E731  bounded by block_windows on average
    if blocks == 1:
        found = _one_pass(rows, block(0), window)
        n_hit = F.col("n_hit")
    else:
        # Ids may be null or repeated, so rows are matched over the passes by id and text digest.
        keyed = rows.withColumn("_key", text_key())
        passes = [_one_pass(keyed.select("doc_id", "text", "_key"), block(k), window).distinct() for k in range(blocks)]
        every = passes[0]
        for p in passes[1:]:
            every = every.unionByName(p)
        every = every.groupBy("doc_id", "_key").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                                    F.flatten(F.collect_list("spans")).alias("spans"))
        every = every.withColumn("spans", _merged(F.col("spans"))).withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k")
        found = keyed.join(every, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
        # Blocks' spans may overlap: count the words of the union in the text itself.
        inside = F.transform("spans", lambda s: F.size(F.regexp_extract_all(
            F.decode(F.substring(F.encode("text", "utf-8"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "utf-8"),
            F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))).cast("long"))
        n_hit = F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x)
        found = found.withColumn("n_hit", n_hit)
        n_hit = F.col("n_hit")
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
                        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), "items", *keep)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs` that are not contaminated, with all their columns."""
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    found = contamination(rows, benchmark, keep=["key"], **options)
    return minus(docs, found.where("contaminated").select("doc_id", "key").distinct())
