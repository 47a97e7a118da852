"""Delimited text against Python's csv module, and texts of very many quotes."""
import csv
import io
import random
import time

from pyspark.sql import functions as F

from riskspark.sources import readers as RD


def cells(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, content string")
    got = {}
    for r in RD.parse_delimited(df).collect():
        got.setdefault(int(r.doc), {})[r.row, r.col] = r.text
    return [got.get(i, {}) for i in range(len(texts))]


def by_csv(text):
    first = next((x for x in text.replace("\r\n", "\n").split("\n") if x.strip()), "")
    n = first.count
    sep = "\t" if n("\t") > n(",") else ";" if n(";") > n(",") else ","
    out = {}
    for i, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=sep), 1):
        if len(row) > 1 or row and row[0].strip():
            out |= {(i, j): x for j, x in enumerate(row, 1)}
    return out


def test_equals_csv_on_random_text(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(['"', '"', '""', ",", ";", "\t", "\n", "\r\n", "a", "b c", "é", " "]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    texts += ["", "\n", ",", '"', '""', '"""', '""""', 'a,"b\nc",d\n', 'a\n"x', '"a"b"c,d"', "\n\n x \n", "a,b\n,\n", '"a""",b', "é;ü\n1;2"]
    blank = lambda d: {k: v for k, v in d.items() if v.strip()}  # noqa: E731  (a row of one quoted empty cell: kept here)
    for text, got in zip(texts, cells(spark, texts), strict=True):
        want = by_csv(text)
        # cells are trimmed outside of quotes only
        assert {k: v.strip(" ") for k, v in blank(got).items()} == {k: v.strip(" ") for k, v in blank(want).items()}, text
        assert set(want) <= set(got), text


def test_quotes_by_the_thousand(spark):
    """2,000, 40,000 and 300,000 quoted rows: three cells a row, in time that follows the length."""
    took = []
    for n in (2000, 40000, 300000):
        row = F.concat(F.col("id"), F.lit(',"x,""y""\n'), F.col("id"), F.lit('","z"'))
        df = spark.range(n).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("content")).select(F.lit("d").alias("doc"), "content")
        began = time.time()
        got = RD.parse_delimited(df).agg(F.count("*"), F.max("row"), F.max("col"), F.count_if(F.col("text").contains(',"y"\n')), F.count_if(F.col("text") == "z")).first()
        took.append(time.time() - began)
        assert tuple(got) == (3 * n, n, 3, n, n)
    assert took[2] < 30 * max(took[1], 1)


def test_one_field_of_many_quotes_and_equal_names(spark):
    text = 'a,"' + '""' * 200000 + '",b'
    df = spark.createDataFrame([("same", text), ("same", text), ("same", None), ("same", "")], "doc string, content string")
    got = sorted((r.col, len(r.text)) for r in RD.parse_delimited(df).collect())
    assert got == [(1, 1), (1, 1), (2, 200000), (2, 200000), (3, 1), (3, 1)]
