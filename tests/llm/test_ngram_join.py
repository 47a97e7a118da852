"""The prefix-tree join against all pairs, and the pipeline's stage that keeps one document of each component."""
import random
import re

import pytest

from riskspark.llm import ngram_join as J
from riskspark.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(None, None), (1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (None, "a b c d e"), (6, "a b c d e")]
    words = [f"w{i}" for i in range(50)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(5, 80))] for _ in range(12)]
    line = [rnd.choice(words) for _ in range(30)]
    for k in range(7, 420):
        b = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice(words) if rnd.random() < .5 else f"u{k}"
        out.append((k, " ".join(b + line if rnd.random() < .3 else b)))
    return out


def test_equals_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 48)  # several blocks and salted pivots even here
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted([tuple(r) for r in J.jaccard_components(df).collect()], key=repr) == brute(rows)


def test_one_of_each_component_stays(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    heads = {c for d, n, c in want if n and d == c}
    kept = J.without_near_copies(df).collect()
    assert sorted(r.doc_id for r in kept if shingles(r.text)) == sorted(heads)
    assert sorted(str(r.doc_id) for r in kept if not shingles(r.text)) == sorted(str(d) for d, n, _ in want if not n)


def test_trie_probe_counts_and_prunes():
    import numpy as np
    rnd = random.Random(9)
    for _ in range(200):
        sets = [np.array(sorted(rnd.sample(range(30), rnd.randint(0, 20))), np.int64) for _ in range(rnd.randint(1, 25))]
        sizes = np.array([len(s) + rnd.randint(0, 2) for s in sets])
        trie, flags = J.Trie(sets, sizes, 75), np.zeros(30, bool)
        q = np.array(sorted(rnd.sample(range(30), rnd.randint(1, 20))))
        found, overlap = trie.probe(q, len(q), flags)
        got = dict(zip(found.tolist(), overlap.tolist()))
        assert len(got) == len(found) and not flags.any()
        for k, s in enumerate(sets):
            o = len(set(s.tolist()) & set(q.tolist()))
            if k in got:
                assert got[k] == o
            elif len(q):
                assert 100 * o < 75 * (sizes[k] + len(q) - o)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 1), (10, 9), (9, 10), (7, 7), (None, 2), (20, 21), (21, 22), (22, 23), (23, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 9, 20: 20, 21: 20, 22: 20, 23: 20} | {100 + i: 100 for i in range(41)}


def test_odd_rows(odd_docs, no_docs):
    got = J.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1][1:] == (0, 1) and by_id[2][1:] == (0, 2) and by_id[6].component_id == 5 and by_id[9].component_id == 8 and by_id[7].n_shingles == 1
    kept = J.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "5", "7", "8", "10", "11"])
    assert J.jaccard_components(no_docs).collect() == [] and J.without_near_copies(no_docs).count() == 0


class _Caught:
    """Stands for a table: gives the function that a step runs in its tasks."""

    def select(self, *columns):
        return self
    groupBy = select

    def mapInArrow(self, fn, kind):
        return fn
    applyInArrow = mapInArrow


def test_the_join_stands_beside_no_tokenizer_tables():
    """A worker that has encoded texts frees the tokenizer's tables when it packs grams, and when it gathers them."""
    import public_tokenizers
    import pyarrow as pa

    from riskspark.llm import bpe
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b c d e f", "a b c d e g"])], names=["doc_id", "text"])
    encode = lambda: bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode("a text of some words")
    encode()
    packed = list(J.gram_blocks(_Caught(), 3)(iter([batch])))
    assert bpe.codec.cache_info().currsize == 0
    encode()
    J.shared_grams(_Caught(), 3)(pa.Table.from_batches(packed))
    assert bpe.codec.cache_info().currsize == 0


def test_gathering_grams_takes_few_bytes_each():
    """Grams that only one class holds go before anything is counted: at most 40 bytes a gram beside the given ones."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    n, each = 2000, 250
    token = np.random.default_rng(1).integers(0, 1 << 63, n * each).astype(np.uint64)
    token[:each] = token[each:2 * each]  # the first two classes share their grams
    sig = np.arange(1, n + 1, dtype=np.uint64)
    count = np.full(n, each, np.int32)
    table = pa.table({"part": pa.array([0]), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("tokens", token), ("sigs", sig), ("sizes", count), ("counts", count))}})
    run = J.shared_grams(_Caught(), 3)
    tracemalloc.start()
    out = run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x in out.column("tokens").to_pylist()) == 2 * each * 8
    assert peak <= 40 * n * each, peak / n / each
