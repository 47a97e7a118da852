"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoding: the bytes of a pre-token are halved recursively down to leaves of at most two bytes; two encoded halves are joined by re-encoding a window of
tokens around the boundary. The window grows until its outermost tokens are the ones that stood there before. Every pair of
adjacent tokens in the result is then one that also arises when the pair is encoded alone, and a sequence with that
property is the encoding of the whole (a merge across two tokens would also happen in the pair alone). Decoding
concatenates the tokens' bytes up the same tree.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty result; texts and pre-tokens of any length are encoded whole.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.llm.text import map_arrow, pretokenizer

#: Windows up to so many bytes are re-encoded by a scan, longer ones with a heap; the shortest ones are remembered.
SHORT, TINY = 64, 12
#: Pre-tokens remembered by one task, in two halves: a full new half becomes the old one, from which those used again move on.
REMEMBERED = 400_000
#: Pairs of tokens, and windows, remembered by one task; a full table is emptied.
REMEMBERED_WINDOWS = 100_000


class TreeCodec:
    """Encoder and decoder for the ranks of a byte-level vocabulary (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, pretokenizer(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[int, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}

    def short_window(self, data: bytes) -> list[int]:
        """Re-encode a short window: merge the lowest-ranked adjacent pair, leftmost on ties, while there is one."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None and len(data) == 1:
            return [whole]
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def window(self, data: bytes) -> list[int]:
        """Re-encode a window of any length, with a heap where it is too long for a scan; very short ones are remembered."""
        if len(data) <= SHORT:
            if len(data) > TINY:
                return self.short_window(data)
            out = self.windows.get(data)
            if out is None:
                out = self.short_window(data)
                if len(self.windows) >= REMEMBERED_WINDOWS:
                    self.windows.clear()
                self.windows[data] = out
            return out
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at i and ends at end[i]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                r = ranks.get(data[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0:
                r = ranks.get(data[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def pair(self, left: int, right: int) -> list[int]:
        """Encoding of two tokens' bytes, remembered: the smallest window of a join."""
        out = self.window(self.bytes_of[left] + self.bytes_of[right])
        if len(self.pairs) >= REMEMBERED_WINDOWS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = out
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded spans."""
        a, b = left[-1], right[0]
        window = self.pairs.get(a << 32 | b) or self.pair(a, b)
        if window[0] == a and window[-1] == b and len(window) == 2:  # both tokens stand as they did
            return left + right
        if len(left) == 1 and len(right) == 1:
            return window
        i = j = 1
        back = self.bytes_of
        while True:
            keeps_left = i == len(left) or window[0] == left[-i]
            keeps_right = j == len(right) or window[-1] == right[j - 1]
            if keeps_left and keeps_right:
                return left[:-i] + window + right[j:]
            i, j = (i if keeps_left else min(2 * i, len(left))), (j if keeps_right else min(2 * j, len(right)))
            window = self.window(b"".join([back[t] for t in left[-i:]] + [back[t] for t in right[:j]]))

    def leaf(self, data: bytes) -> list[int]:
        """Encoding of one or two bytes, remembered (there are 65,792 such leaves)."""
        out = self.leaves.get(data)
        if out is None:
            out = self.leaves[data] = self.short_window(data)
        return out

    def piece(self, data: bytes) -> list[int]:
        """Encode one pre-token: at most two bytes are a leaf; one level of the tree after the other joins neighbours, an odd last span moves up."""
        leaf, join = self.leaf, self.join
        spans = [leaf(data[k:k + 2]) for k in range(0, len(data), 2)]
        while len(spans) > 1:
            rest = spans[-1:] if len(spans) % 2 else []
            spans = [*map(join, spans[:-1:2] if rest else spans[::2], spans[1::2]), *rest]
        return spans[0] if spans else []

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        seen, pieces = self.seen, self.split(text)
        try:
            return b"".join(map(seen.__getitem__, pieces))
        except KeyError:
            out = []
            for p in pieces:
                ids = self.seen.get(p)
                if ids is None:
                    ids = self.old.get(p)
                    if ids is None:
                        ids = b"".join(t.to_bytes(4, "little") for t in self.piece(p.encode()))
                    if len(p) <= 64:
                        if len(self.seen) >= REMEMBERED // 2:
                            self.old, self.seen = self.seen, {}
                        self.seen[p] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids: token bytes at the leaves, concatenated level by level."""
        values = array("I")
        values.frombytes(ids)
        back = self.bytes_of
        level = [b"".join(map(back.__getitem__, values[k:k + 4096])) for k in range(0, len(values), 4096)]
        while len(level) > 1:
            level = [b"".join(level[k:k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank per line, base64, as published."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(read_ranks(path), pattern)


def release() -> None:
    """Drop the tables that this worker remembers: workers serve all stages of a session, and a step that needs the memory should not stand beside them."""
    codec.cache_clear()


def _column(values: list[bytes]) -> pa.Array:
    """Packed ids as list<int>."""
    offsets = [0]
    for v in values:
        offsets.append(offsets[-1] + len(v) // 4)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(values))]))


def _mapped(docs: DataFrame, source: str, target: str, kind: str, fn, by_text: bool) -> DataFrame:
    """`docs` with `source` replaced by the column `target` that `fn` makes of a batch's source column."""
    keep = [c for c in docs.columns if c not in (source, target)]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns[:-1], fn(batch.columns[-1])], names=[*keep, target])
    return map_arrow(docs.select(*[f"`{c}`" for c in keep], f"`{source}`"), run, f"{kinds}`{target}` {kind}", len(keep) if by_text else None)


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """All columns of `docs` with the text replaced by the ids of its tokens (array<int>)."""
    def ids(column: pa.Array) -> pa.Array:
        enc = codec(path, pattern).encode
        return _column([enc(t or "") for t in column.to_pylist()])
    return _mapped(docs, text_column, ids_column, "array<int>", ids, True)


def decode(docs: DataFrame, path: str, pattern: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """All columns of `docs` with the ids replaced by the text that they stand for (null ids: null)."""
    def text(column: pa.Array) -> pa.Array:
        dec = codec(path, pattern).decode
        return pa.array([None if v is None else dec(array("I", v).tobytes()).decode() for v in column.to_pylist()], pa.string())
    return _mapped(docs, ids_column, text_column, "string", text, False)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        n, a, b = [], [], []
        for t in batch.column(1).to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                               names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, text_column), run, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", 1)
