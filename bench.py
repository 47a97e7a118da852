"""Time the headline queries on one scale and print one JSON line: seconds, the median of three runs of each, and the shuffled MB.

Runs two and three are left out for queries that start after BENCH_BUDGET_S seconds (`runs` says how many each had).
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f04_department_features", "a01_admissions_anomalies", "c02_cri_rollup", "c04_assess", "c06_risk_trend",
    "b12_baselines", "b16_significance", "b24_relationship_changes", "t07_hindcast",
    "p05_classify_metrics", "p11_content_hash", "x03_wide_table", "q04_single_domain", "q06_flagged_rows",
    "e02_pair_similarity", "e04_resolve_duplicates", "e12_trend_terms", "e13_related_articles", "g02_geofence_wide",
    "g11_graph_edges", "v06_ground_claims", "n09_network_totals", "s06_html_pages", "r01_dedup_content",
]


def main() -> None:
    from riskspark.plans import registry
    from riskspark.session import build_session
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    times, runs, shuffled = {}, {}, {}
    budget, began = float(os.environ.get("BENCH_BUDGET_S", "900")), time.time()
    status = spark.sparkContext._jsc.sc().statusStore()

    def written() -> float:
        """MB of shuffle data that all stages so far have written."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in list_of(status.executorList(False))) / 1e6

    def list_of(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("f08_yearly_rollup")  # warms the session and the file listings
    for name in HEADLINE:
        took, before = [], written()
        for _ in range(3 if time.time() - began < budget else 1):
            t = time.time()
            run(name)
            took.append(time.time() - t)
        times[name], runs[name] = round(statistics.median(took), 3), len(took)
        shuffled[name] = round((written() - before) / len(took), 1)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "runs": runs, "shuffle_mb": shuffled, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
