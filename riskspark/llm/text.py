"""Helpers shared by the text operators: byte views of Arrow batches, word fingerprints and pre-tokens.

All functions work on whole texts. A null text counts as empty unless an operator says otherwise.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20


def fold_of(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo `folds` (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_key(column: str = "text") -> Column:
    """Digest of a text that, with the id, names a row in joins that must not carry the text."""
    return F.xxhash64(column)


def drawn(docs: DataFrame, want: int, seed: int, by: str | None = None) -> DataFrame:
    """About `want` different rows (of every value of `by`), drawn by a hash `__k` of id and text; rows equal in both are drawn together.

    Rows that share an id, or have none, are drawn one by one, since their texts differ. The share follows the number of different
    rows, so that one row that makes up most of a table does not hide the others. `once` then keeps one of equal rows.
    """
    group = [] if by is None else [by]
    part = lambda n: int(min(1.0, want / max(n, 1)) * (1 << 30))
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text", F.lit(seed)))
    counts = keyed.groupBy(*group).agg(F.approx_count_distinct("__k", 0.02).alias("n")).collect()
    limit = F.lit(part(counts[0]["n"])) if by is None else F.coalesce(*[F.when(F.col(by) == r[by], part(r["n"])) for r in counts if r[by] is not None], F.lit(0))
    return keyed.where(F.pmod("__k", F.lit(1 << 30)) < limit)


def once(rows: DataFrame, most: int) -> DataFrame:
    """One row for every `__k`, and of them at most the `most` with the smallest keys."""
    return rows.groupBy("__k").agg(*[F.first(c).alias(c) for c in rows.columns if c != "__k"]).orderBy("__k").limit(most)


def minus(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of `docs` whose id and text digest are not (left_semi: are) among those of `rows` (doc_id, key); null ids match each other."""
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["__id"]) & text_key().eqNullSafe(rows["__key"]), how)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str, text: int | None = None) -> DataFrame:
    """Apply `fn` to every Arrow batch of `df` inside the tasks; rows stay where they are.

    With `text`, the position of a string column, batches are cut into rows of about CHUNK_BYTES of it, so that memory does
    not grow with the rows of a batch.
    """
    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if text is None:
            yield batch
        else:
            for i, j in chunks(utf8(batch.column(text))[1]):
                yield batch.slice(i, j - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in parts(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column without copying; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, 2 * CHUNK_BYTES), self.base, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values[:n]


_UP, _DOWN = _Powers(_P), _Powers(_P_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(pattern: str) -> np.ndarray:
    """Table of 256 flags: bytes that match after A-Z are lower-cased; bytes from 0x80 on match if any non-ASCII character does."""
    r = re.compile(pattern)
    return np.array([bool(r.fullmatch(chr(b if b < 128 else 0xE9).lower())) for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of `is_word` bytes, A-Z lower-cased) of consecutive texts.

    Returns 64-bit fingerprints, start and end byte positions, and the n+1 word offsets of the texts.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    bounds = offsets - lo
    if not len(b):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    m = is_word[b]
    first = np.empty(len(b), bool)
    first[0] = m[0]
    np.logical_and(m[1:], ~m[:-1], out=first[1:])
    last = np.empty(len(b), bool)
    last[-1] = m[-1]
    np.logical_and(m[:-1], ~m[1:], out=last[:-1])
    cut = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[cut] = m[cut]
    last[(cut - 1)[cut > 0]] = m[(cut - 1)[cut > 0]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LOWER[b] * _UP.upto(len(b)), out=sums[1:])
    value = mix((sums[ends] - sums[starts]) * _DOWN.upto(len(b))[starts] + (ends - starts).astype(np.uint64))
    return value, starts, ends, np.searchsorted(starts, bounds)


_LOWER = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)
_GRAM = _Powers(np.uint64(0xD6E8FEB86659FD93))


def grams(value: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams of every text and their offsets; texts of fewer, but not none, give one gram of all their words."""
    if n == 1:
        return value, offsets
    length = np.diff(offsets)
    weights = _GRAM.upto(n)
    size = max(len(value) - n + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for k in range(n):
        rolled += value[k:k + size] * weights[k]
    count = np.maximum(length - n + 1, (length > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(out_offsets[-1]), np.uint64)
    full = length >= n
    inside = np.repeat(full, length) if len(value) else np.zeros(0, bool)
    position = np.arange(len(value)) - np.repeat(offsets[:-1], length)
    take = inside & (position <= np.repeat(length - n, length))
    target = np.repeat(full, count)
    out[target] = rolled[np.flatnonzero(take)]
    for i in np.flatnonzero(~full & (length > 0)):
        v = value[offsets[i]:offsets[i + 1]]
        out[out_offsets[i]] = np.sum(v * weights[:len(v)], dtype=np.uint64) + np.uint64(len(v))
    return mix(out), out_offsets


def distinct_sorted(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's values in ascending order without repeats, and the new offsets."""
    v = value.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[heads] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return v[keep], total[offsets]


# Letters, numbers and white space below U+0100.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = " \t\n\r\f\v\x85\xa0"
_NARROW = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


@lru_cache(maxsize=4)
def pretokenizer(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a tokenizer's split pattern; texts within Latin-1 take an equivalent, faster expression."""
    import public_tokenizers
    import regex
    wide = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return wide
    narrow = _NARROW.findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return narrow(text)
    return split
