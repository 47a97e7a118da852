"""The FM-index search against direct window search, in one pass and in several blocks."""
import hashlib
import random
import re

import numpy as np
import pytest

from riskspark.llm import decontam as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 12, min(len(w), 1))):
            windows.setdefault(tuple(w[k:k + 13]), set()).update([] if i is None else [str(i)])
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k:k + m])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(2)
    vocabulary = [f"W{i}" for i in range(25)] + ["é", "日本"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 13, 14, 40])))) for k in range(40)]
    items += [(100, None), (101, " .,- "), (None, "null id item words here"), (3, items[3][1])]
    docs = [(None, None), (0, ""), (1, "...")]
    for k in range(2, 250):
        t = [rnd.choice(vocabulary) if rnd.random() < .8 else f"x{k}" for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            passage = words(rnd.choice(items)[1])
            a = rnd.randrange(len(passage) + 1)
            t[rnd.randrange(len(t) + 1):0] = passage[a:] if rnd.random() < .4 else passage
        docs.append((k, rnd.choice([" ", ", "]).join(t)))
    return docs + docs[-3:], items


@pytest.mark.parametrize("block", [200_000, 150])
def test_equals_direct_search(spark, case, block):
    docs, items = case
    found = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_windows=block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found], key=repr) == brute(docs, items)
    text = dict(docs)
    for r in found:  # removal spans cover exactly the hit words
        raw = (text[r.doc_id] or "").encode()
        assert sum(len(words(raw[s.start:s.end].decode())) for s in r.spans) == r.n_hit


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = rng.integers(0, rng.integers(2, 6), rng.integers(1, 300))
        text = np.append(text, 0)
        index = D.FMIndex(text, int(text.max()) or 1)
        for m in (1, 2, 5):
            patterns = np.unique(rng.integers(1, (int(text.max()) or 1) + 1, (20, m)), axis=0)
            who, low, high = index.search(patterns)
            got = {(int(w), int(p)) for w, a, b in zip(who, low, high) for p in index.locate(np.arange(a, b))}
            want = {(k, i) for k, p in enumerate(patterns) for i in range(len(text) - m + 1) if (text[i:i + m] == p).all()}
            assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "three four five six"), (2, None), (2, "")], "item_id long, text string")
    found = {r.doc_id: r for r in D.contamination(odd_docs, bench).collect() if r.doc_id}
    assert found[8].contaminated and found[9].n_hit == 4 and not found[5].contaminated and found[1].n_words == 0
    kept = D.without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert D.without_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count() and D.contamination(no_docs, bench).count() == 0
