"""Canonical views over raw tables of a few rows."""
import statistics

from riskspark.sources.views import Views


def test_placements_without_buffers_of_prices(spark, tmp_path):
    """Medians of odd, even, repeated and missing prices, and recruiters with a missing one, without a buffer of a cell's prices."""
    prices = {1: [10.01, 10.01, 7.5, None], 2: [3.0, 1.0, 2.0], 3: [None], 4: [5.25, 4.0, 4.0, 4.0, 9.99, 100.0]}
    rows = [(o, None if k == 0 else 1 + k % 2, p, "R" if k % 3 == 0 else "N") for o, ps in prices.items() for k, p in enumerate(ps)]
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("nation", [(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int")
    save("customer", [(o, 0, f"D{o}") for o in prices], "c_custkey long, c_nationkey int, c_mktsegment string")
    save("orders", [(o, o, "F", 1.0, "1-URGENT", "2000-05-01") for o in prices], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate string")
    save("lineitem", rows, "l_orderkey long, l_suppkey long, l_extendedprice double, l_returnflag string")
    df = Views(spark, str(tmp_path)).placements()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
    got = {r.department: r for r in df.collect()}
    for o, ps in prices.items():
        r, known = got[f"D{o}"], [p for p in ps if p is not None]
        assert (r.eligible_students, r.placed_students) == (len(ps), sum(k % 3 != 0 for k in range(len(ps))))
        assert r.top_tier_recruiters == len({x[1] for x in rows if x[0] == o})
        assert r.median_salary_lpa == (round(statistics.median(known) * 100, 6) / 1000000 if known else None)
