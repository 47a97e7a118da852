"""A few registered queries against their check SQL on the smallest scale."""
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["c04_assess", "b16_significance", "q06_flagged_rows", "x05_key_value_lines", "g02_geofence_wide", "e13_related_articles", "n08_compare_metrics"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=repr)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert got == sorted([tuple(norm(x) for x in r) for r in want], key=repr)


def test_every_check_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 140
