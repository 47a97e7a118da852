"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A pre-token starts as one symbol per byte. The lowest-ranked adjacent pair (leftmost on ties) is popped from a heap and
merged in a doubly linked list until no pair has a rank; the count is initial symbols minus merges. Distinct pre-tokens
recur, so a task remembers their counts in a table of bounded size.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; extra columns are
ignored; an empty table gives an empty result; texts of any length are counted whole.
"""
from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.llm.text import map_arrow, pretokenizer

#: Pre-tokens remembered by one task; a full table is emptied.
REMEMBERED = 400_000


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


class MergeCounter:
    """Counts tokens of texts under the merges of a byte-level vocabulary file (.json)."""

    def __init__(self, spec: dict):
        import public_tokenizers
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without normalizer or prefix space are supported")
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self.start = [vocab[symbols[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], k << 32 | vocab[a + b])
        special = [t for t in spec.get("added_tokens", [])]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in special):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"])))) if special else None
        self.split = pretokenizer(public_tokenizers.PATTERN)
        self.seen: dict[str, int] = {}

    def piece(self, data: bytes) -> int:
        """Symbols left of one pre-token after all merges."""
        n = len(data)
        if n < 2:
            return n
        rank = self.rank
        symbol = [self.start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                heap.append((r >> 32) << 32 | i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            r = rank.get(symbol[i] << 32 | symbol[j])
            if r is None or r >> 32 != top >> 32:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbol[i], symbol[j] = r & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbol[i] << 32 | symbol[k])
                if r is not None:
                    heapq.heappush(heap, (r >> 32) << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbol[h] << 32 | symbol[i])
                if r is not None:
                    heapq.heappush(heap, (r >> 32) << 32 | h)
        return n - merges

    def text(self, text: str) -> int:
        """Tokens of one text; a special string in it counts as one token."""
        total = 0
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        seen = self.seen
        for part in parts:
            pieces = self.split(part)
            try:
                total += sum(map(seen.__getitem__, pieces))
            except KeyError:
                for p in pieces:
                    c = seen.get(p)
                    if c is None:
                        c = self.piece(p.encode())
                        if len(p) <= 64:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[p] = c
                    total += c
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    with open(path, encoding="utf-8") as f:
        return MergeCounter(json.load(f))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed `limit`. The vocabulary is read from `path` by each worker."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter: Callable[[str], int] = _counter(path).text
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [counter(t) for t in texts]
        return pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                                pa.array([t > limit for t in tokens], pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])
    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(id_column, text_column), count, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean", 1)
