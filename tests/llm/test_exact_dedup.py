"""Exact duplicates against brute force, also with a hash that collides and with hot classes."""
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskspark.llm import exact_dedup

SF = "/root/testdata/sf0.001"
WAYS = [{}, {"hot_rows": 1, "hot_share": 10**9}, {"digest": lambda t: F.lit(b"same")},
        {"digest": lambda t: F.unhex(F.hex(F.length(t) % 7)), "hot_rows": 1, "hot_share": 10**9}]


def brute(rows):
    """Rows of (doc_id, keep_id, group_size, text_sha256), and the number of rows that stay for every text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return Counter((i, keep[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in rows), {sha(t): keep[t] for t in groups}


def check(got, rows):
    want, keep = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    stays = [r for r in got if r.kept]
    assert len(stays) == len(keep) and all(r.doc_id == r.keep_id for r in stays) and {r.text_sha256: r.keep_id for r in stays} == keep


@pytest.mark.parametrize("way", range(len(WAYS)))
def test_odd_rows(spark, odd_docs, no_docs, way):
    """Null ids and texts, repeated rows, ties, very long texts and clashing names."""
    check(exact_dedup.equal_texts(odd_docs, **WAYS[way]).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert exact_dedup.equal_texts(no_docs, **WAYS[way]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("way", range(len(WAYS)))
def test_whole_table(spark, way):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(exact_dedup.equal_texts(docs, **WAYS[way]).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_text_is_not_normalised_and_ids_may_be_strings(spark):
    rows = [("a", "Word"), ("b", "word"), ("c", "word "), ("d", "\u00e9"), ("e", "e\u0301"), ("f", "word"), ("10", "Word")]
    check(exact_dedup.equal_texts(spark.createDataFrame(rows, "doc_id string, text string")).collect(), rows)


def test_no_python_in_the_plan(spark, odd_docs):
    plan = exact_dedup.equal_texts(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
