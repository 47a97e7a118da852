import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that carry names the operators use themselves.
CLASHING = ("n_words", "n_hit", "items", "spans", "score", "sig", "key", "component", "ids", "n_tokens", "tokens", "label", "rule", "verdict", "digest", "rank", "v", "part", "__id")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, blank and very long texts, repeated rows, ties, and columns with clashing names."""
    long = "alpha beta gamma delta epsilon zeta eta theta " * 6000
    rows = [(None, None), (None, "a text without an id here and there"), (None, "a text without an id here and there"), (1, None), (2, ""), (3, " \n\t "), (4, "12345 678 !!!"), (5, long), (6, long), (7, "x" * 200000),
            (8, "One two THREE four five six seven."), (8, "One two THREE four five six seven."), (9, "one two three four five six seven."), (10, "日本語 テキスト 😀 é́"),
            (11, "<|endoftext|> it's <|endoftext|>")]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t, None if i is None else ("en", "de", None)[i % 3], None, None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
