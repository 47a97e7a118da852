"""Token counts and the BPE codec against the public libraries, and exact round trips."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskspark.llm import bpe, token_count

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    out = ["", "a" * 20001, "ab" * 3000 + "a", " " * 999, "<|endoftext|>x<|endoftext|>", "<|endo<|endoftext|>ftext|>", "it's we'll\x1c\x1f\x85\xa0", "　 日本語テキスト" * 40, "😀" * 300, "é" * 1501, "!?" * 2000]
    for _ in range(600):
        letters = rnd.choice(["ab", "abcdefgh", "theaninonerst", "0123456789", " \n\tab", "éüñß日本", "!#$%", "'sltrem "])
        out.append("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))))
    return out


def test_counts_equal_the_library(texts):
    counter, library = token_count._counter(JSON), Tokenizer.from_file(JSON)
    for t in texts:
        assert counter.text(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_ids_equal_the_library_and_round_trip(texts):
    codec = bpe.codec(RANKS, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_joining_any_two_halves_gives_the_encoding_of_the_whole():
    codec, rnd = bpe.codec(RANKS, P.PATTERN), random.Random(5)
    for _ in range(2000):
        data = "".join(rnd.choice("aethinor éß") for _ in range(rnd.randint(2, 90))).encode()
        cut = rnd.randint(1, len(data) - 1)
        assert codec.join(codec.window(data[:cut]), codec.window(data[cut:])) == codec.window(data) == codec.piece(data)


def test_odd_rows(odd_docs, no_docs):
    rows = token_count.token_counts(odd_docs, JSON).collect()
    assert len(rows) == odd_docs.count() and next(r for r in rows if r.doc_id == 1)[1:] == (0, 0, False)
    assert next(r for r in rows if r.doc_id == 7).n_bytes == 200000
    assert sorted(r.over_limit for r in rows if r.doc_id in (5, 6)) == [True, True]
    rows = bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    digest = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == digest
    assert token_count.token_counts(no_docs, JSON).count() == bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0


def test_frames_round_trip(odd_docs):
    encoded = bpe.encode(odd_docs, RANKS, P.PATTERN)
    assert "text" not in encoded.columns
    back = bpe.decode(encoded, RANKS, P.PATTERN)
    assert sorted([(r.doc_id, r.text or "") for r in odd_docs.collect()], key=str) == sorted([(r.doc_id, r.text) for r in back.collect()], key=str)
    assert set(back.columns) == set(odd_docs.columns) - {"ids"}  # the name is taken by the tokens


def test_every_pair_of_neighbours_goes_through_a_join(texts):
    """A pre-token of n bytes has a leaf for every two and takes one join less; remembered pre-tokens take none."""
    class Counting(bpe.TreeCodec):
        joins = 0

        def join(self, left, right):
            self.joins += 1
            return super().join(left, right)
    codec = Counting(bpe.read_ranks(RANKS), P.PATTERN)
    for t in texts:
        codec.joins, fresh = 0, [p for p in dict.fromkeys(codec.split(t)) if p not in codec.seen and p not in codec.old]
        again = [p for p in codec.split(t) if len(p) > 64]  # these are not remembered
        codec.encode(t)
        sizes = [len(p.encode()) for p in fresh if len(p) <= 64] + [len(p.encode()) for p in again]
        assert codec.joins == sum((n + 1) // 2 - 1 for n in sizes)
