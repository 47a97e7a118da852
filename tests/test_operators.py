"""Hand-made inputs for branches the generated tables rarely reach."""
import pytest
from pyspark.sql import functions as F

from riskspark.functions import text as T
from riskspark.functions.num import pct_change
from riskspark.operators import anomalies as A, baseline as B, extract as X, features as FT, forecast as FC, geo as G, intel as I, quality as Q, risk as R
from riskspark.sources import feeds as FD, ledger as L, readers as RD
from riskspark.streaming import stream as ST

ADM = "institution_id string, department string, academic_year int, sanctioned_intake int, enrolled_count int, vacancy_rate double"
PLC = ("institution_id string, department string, academic_year int, graduation_year int, eligible_students int, placed_students int, "
       "placement_percentage double, unplaced_count int")
CET = "institution_id string, department string, academic_year int, closing_rank int, percentile_cutoff double"
SIG = ("institution_id string, domain string, metric_name string, metric_label string, department string, academic_year int, value double, "
       "unit string, polarity string, risk_contribution double, is_contradictory boolean, is_duplicate boolean, confidence double, seq bigint, document string")


def adm(spark, enrolled, inst="I", dept="CSE", first=2022):
    return spark.createDataFrame([(inst, dept, first + i, 100, e, (100 - e) / 100) for i, e in enumerate(enrolled)], ADM)


def plc(spark, placed, inst="I", dept="CSE", first=2022):
    return spark.createDataFrame([(inst, dept, first + i, first + i, 100, p, float(p), 100 - p) for i, p in enumerate(placed)], PLC)


def cet(spark, ranks, inst="I", dept="CSE", first=2022):
    return spark.createDataFrame([(inst, dept, first + i, r, 90.0 - i) for i, r in enumerate(ranks)], CET)


def test_feature_vector(spark):
    f = FT.department_features(adm(spark, [90, 80, 70]), plc(spark, [80, 60, 40]), cet(spark, [10000, 15000, 25000])).first()
    assert f.vacancy_rate_slope == 0.10 and f.placement_pct_slope == -20.0 and f.closing_rank_slope == 7500.0
    assert not f.sparse_flag
    g = FT.department_features(adm(spark, [100, 100]), plc(spark, [80, 20]), cet(spark, [10])).first()
    assert g.sparse_flag and g.intake_to_placed_divergence == 0.75
    h = FT.department_features(adm(spark, [90]), plc(spark, []), cet(spark, [])).first()
    assert h.unplaced_ratio_current == 1.0 and h.closing_rank_current == 0.0


def test_percent_change_of_zero_base(spark):
    r = spark.range(1).select(pct_change(F.lit(0.0), F.lit(0.0)).alias("a"), pct_change(F.lit(0.0), F.lit(50.0)).alias("b")).first()
    assert (r.a, r.b) == (0.0, 100.0)


@pytest.mark.parametrize("ranks,severity", [([8000, 12000, 16000], "HIGH"), ([8000, 12000, 18000], "CRITICAL"), ([10000, 10100, 10200], None)])
def test_rank_anomaly(spark, ranks, severity):
    rows = A.rank_anomalies(cet(spark, ranks), ["institution_id", "department"]).collect()
    assert [r.severity for r in rows] == ([severity] if severity else [])


def test_cross_signal_divergence_amplifies_the_index(spark):
    a, p, c = adm(spark, [100, 100]), plc(spark, [80, 20]), cet(spark, [10, 10])
    d = A.divergence_anomalies(a, p, ["institution_id"]).first()
    assert d.severity == "CRITICAL" and d.observed_value == 0.75 and d.deviation_zscore == -3.0
    s = R.cri_single(a, p, c, ["institution_id", "department"]).first()
    assert s.cri == 0.70 and s.driver.startswith("Cross-Signal")


def test_baseline_statuses(spark):
    def rows(metric, vals, dom="placements"):
        return [("I", dom, metric, metric, "CSE", 2021 + i, v, "%", "higher_is_better", None, False, False, 0.95, i, "d") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows("pct", [84.0, 82.0, 80.0, 52.0]) + rows("intern", [75.0, 55.0], "internships") + rows("lib", [10.0], "infrastructure"), SIG)
    b = {r.metric_name: r for r in B.build_baselines(B.yearly_series(df)).collect()}
    assert b["pct"].baseline_status == "ESTABLISHED"
    assert (b["pct"].baseline_mean, b["pct"].baseline_std, b["pct"].baseline_median) == (82.0, 2.0, 82.0)
    assert b["intern"].baseline_status == "TWO_PERIOD_COMPARISON_ONLY" and b["intern"].baseline_mean is None
    assert b["lib"].baseline_status == "INSUFFICIENT_HISTORY"


def test_dimensions_and_confirmation(spark):
    def rows(dom, metric, dept, vals, seq):
        return [("I", dom, metric, metric, dept, 2021 + i, float(v), "%", "higher_is_better", None, False, False, 0.95, seq + i, "d") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows("placements", "pct", "CSE", [85, 83, 68, 45], 0) + rows("internships", "share", "CSE", [78, 72, 48], 10)
                               + rows("placements", "pct", "ECE", [80, 81, 82], 20), SIG)
    _, base, ev = B.evaluate(df, adm(spark, [90, 80]))
    r = {(x.domain, x.dept_key): x for x in ev.collect()}[("placements", "CSE")]
    assert r.persistence == 3 and r.coverage == 0.5 and r.magnitude > 0.70 and r.zscore < -2
    assert r.confirming == ["internships.share (CSE)"]
    text = I.explain(ev).where("domain = 'placements'").first()
    assert "declined" in text.what_changed
    lines = [x.evidence for x in I.explanation_evidence(ev, df).where("domain = 'placements' AND dept_key = 'CSE'").orderBy("academic_year").collect()]
    assert lines == [f"[d] pct = {v:.2f} (confidence 0.95)" for v in (85, 83, 68, 45)]  # every observation, not the last three
    assert I.early_warnings(base, ev).where("domain = 'placements'").first().stage_index == 4


def test_contradictions_and_duplicates_keep_every_row(spark):
    cols = ("signal_id string, institution_id string, department string, program string, academic_year int, metric_name string, domain string, "
            "value double, raw_value string, is_new boolean")
    rows = [("a", "I", "CSE", None, 2024, "pass", "academics", 88.0, "88%", False), ("b", "I", "CSE", None, 2024, "pass", "academics", 88.0, "88%", False),
            ("c", "I", "CSE", None, 2024, "pass", "academics", 51.5, "51.5%", True)]
    b = Q.bucketed(spark.createDataFrame(rows, cols))
    g = Q.value_groups(b)
    assert Q.duplicate_issues(g).count() == 1 and Q.contradiction_issues(g).count() == 1
    flagged = Q.flag_contradictions(b, g).collect()
    assert len(flagged) == 3 and all(r.is_contradictory for r in flagged)


def test_contradictions_list_every_value_with_its_source(spark):
    cols = ("signal_id string, institution_id string, department string, program string, academic_year int, metric_name string, domain string, "
            "value double, raw_value string, is_new boolean, document string, location string")
    rows = [(k, "I", d, None, 2024, "pass", "academics", x, f"{x}%", k == "c", f"doc_{k}", f"B{n}")
            for n, (k, d, x) in enumerate([("a", "CSE", 88.0), ("b", "CSE", 70.25), ("c", "CSE", 51.5), ("d", "CSE", 70.25), ("e", "ECE", 1.0), ("f", "ECE", 2.0)])]
    b = Q.bucketed(spark.createDataFrame(rows, cols))
    g = Q.value_groups(b)
    issue = Q.contradiction_issues(g).collect()
    got = Q.contradiction_values(b, g).collect()
    assert len(issue) == 1 and {r.contradiction_group_id for r in got} == {issue[0].contradiction_group_id}
    assert sorted((r.signal_id, r.val_repr, r.document, r.location) for r in got) == [
        ("a", "88.0000", "doc_a", "B0"), ("b", "70.2500", "doc_b", "B1"), ("c", "51.5000", "doc_c", "B2"), ("d", "70.2500", "doc_d", "B3")]


def test_items_and_articles_keep_their_entities(spark):
    cols = ("arrival long, title string, summary string, category string, severity string, country string, city string, latitude double, longitude double, "
            "published_s long, confidence double, entities array<struct<name: string, type: string>>")
    items = [(1, "A", "x", "cyber", "LOW", "India", "Ballari", 15.1, 76.9, 10, 0.9, [("State <b>Grid</b>", "Infrastructure"), ("Board", None)]),
             (2, "B", "y", "cyber", "LOW", "India", "Pune", None, None, 20, 0.7, [("state  grid", "infrastructure"), (None, None)]), (3, "C", "z", None, None, None, None, None, None, 30, None, None)]
    out = FD.normalize_feed_items(spark.createDataFrame(items, cols))
    named = {r.name: r for r in out["item_entities"].collect()}
    assert {(r.entity_type, r.arrival, r.confidence, r.latitude) for r in named.values()} == {
        ("Infrastructure", 1, 0.9, 15.1), ("Organization", 1, 0.9, 15.1), ("Organization", 2, 0.7, None)} and set(named) == {"State Grid", "Board", "Unknown Entity"}
    assert out["entities"].count() == 6 and out["event_entities"].count() == 7 and out["relationships"].count() == 3 + 4
    assert FD.normalize_feed_items(spark.createDataFrame(items, cols).drop("entities"))["entities"].count() == 3
    arts = [(1, "A", "x", "P", None, "u", "India", "Ballari", "e", "LOW", 10, 15.1, 76.9, ["State University", "Pune"]),
            (2, "B", "y", "P", None, "u", "India", "Pune", "e", "LOW", 20, 18.5, 73.9, None), (3, "C", "z", "P", None, "u", None, None, "e", "LOW", 30, None, None, [])]
    df = spark.createDataFrame(arts, "arrival long, title string, summary string, publisher string, wire_origin string, url string, country string, city string, "
                               "event_type string, severity string, published_s long, latitude double, longitude double, entities array<string>")
    out = FD.normalize_articles(df)
    assert sorted((r.name, r.entity_type, r.arrival, r.latitude) for r in out["entities"].collect()) == [("Pune", "Location", 1, 15.1), ("State University", "Organization", 1, 15.1)]
    assert out["event_entities"].count() == 3 and {r.arrival: r.latitude for r in out["events"].collect()} == {1: 15.1, 2: 18.5, 3: None}
    assert FD.normalize_articles(df.drop("entities", "latitude", "longitude"))["entities"].count() == 2


def test_wide_sheet(spark):
    head = ["Department", "Program", "Academic Year", "Faculty Attrition Rate", "Research Grants", "Student Attendance %", "Pending Grievances"]
    body = [["CSE", "B.E. CSE", "2024", "22.5%", "45.0 Lakhs", "~71.0%", "14"], ["ECE", "B.E. ECE", "2024", "12.0%", "28.5 Lakhs", "", "1"]]
    cells = [("d", "S", i + 1, j + 1, t) for i, row in enumerate([head] + body) for j, t in enumerate(row)]
    rows = X.tabulate(spark.createDataFrame(cells, "doc string, sheet string, row int, col int, text string"))
    s = {(r.department, r.metric_name): r for r in X.extract_wide_table(rows).collect()}
    assert s[("CSE", "faculty_attrition_rate")].risk_contribution == 0.563
    assert s[("CSE", "research_grants_lakhs")].unit == "INR_Lakhs" and s[("CSE", "student_attendance_pct")].confidence == 0.80
    assert s[("ECE", "pending_grievances")].academic_year == 2024 and len(s) == 7
    assert {r.issue_type for r in X.table_issues(rows).collect()} == {"incomplete_coverage", "ambiguous_values"}


def test_prose_metrics_use_the_window_without_years(spark):
    t = [("d", 1, "", "In AY 2022 the placement rate reached 75.3% overall while faculty attrition was about 12 percent"),
         ("d", 2, "", "no metric here 15"), ("d", 3, "", "the pass rate 2023 remained unchanged")]
    got = X.extract_prose_metrics(X.classify_lines(spark.createDataFrame(t, "doc string, line_no int, ctx string, text string"))).collect()
    # the second phrase has 75.3 within the 25 characters before it, so that is its first number
    assert {(r.metric_name, r.value) for r in got} == {("placement_percentage", 75.3), ("faculty_attrition_rate", 75.3)}


def test_trajectory_closed_form_equals_stepwise(spark):
    base = spark.createDataFrame([("I", 0.3, 0.0), ("J", 0.5, 0.2), ("K", 0.1, -0.07)], "institution_id string, cri double, drift double")
    for r in FC.project(base, 5).collect():
        c, d = {"I": (.3, 0.), "J": (.5, .2), "K": (.1, -.07)}[r.institution_id]
        for _ in range(r.year_offset):
            c = max(0.0, min(1.0, c + d))
        assert abs(r.projected_cri - c) < 1e-6


def test_geofence_across_the_date_line_and_near_a_pole(spark):
    q = spark.createDataFrame([("q1", 0.0, 179.9, 300.0, 24), ("q2", 89.5, 10.0, 300.0, 24)], "query_id string, q_lat double, q_lon double, radius_km double, hours_back int")
    e = spark.createDataFrame([("a", 100, 0.0, -179.9, "LOW"), ("b", 100, 88.0, -170.0, "LOW"), ("c", 100, 0.0, 170.0, "LOW")],
                              "event_id string, published_s bigint, latitude double, longitude double, severity string")
    assert {(r.query_id, r.event_id) for r in G.geofence(q, e, 100).collect()} == {("q1", "a"), ("q2", "b")}


def test_text_helpers(spark):
    d = spark.createDataFrame([("<p>Hi &amp; <script>x</script>you</p>", "http://10.1.2.3/x"), ("a  b", "https://example.com/")], "t string, url string")
    r = T.check_urls(d).withColumn("s", T.sanitize_text(F.col("t"))).collect()
    assert [x.s for x in r] == ["Hi & you", "a b"] and [x.allowed for x in r] == [False, True]


def test_memory_merge_keeps_category(spark):
    c = ("memory_id string, institution_id string, category string, created_at int, statement string, confidence double, evidence_refs array<string>, "
         "payload string, seq bigint")
    old = spark.createDataFrame([("m", "I", "inference", 1, "old", 0.4, ["a"], "{}", 1)], c)
    new = spark.createDataFrame([("m", "I", "outcome", 9, "new", 0.8, ["b"], "{1}", 2), ("n", "I", "unknown", 9, "x", 0.1, [], "{}", 3)], c)
    r = {x.memory_id: x for x in L.merge_memory(old, new).collect()}
    assert (r["m"].category, r["m"].created_at, r["m"].statement) == ("inference", 1, "new") and r["n"].category == "unknown"


def test_feed_refuses_entities_and_reads_both_formats(spark):
    docs = [("r", "<rss><channel><item><title>A</title><link>u1</link></item><item><title>B</title><link>u2</link></item></channel></rss>"),
            ("a", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link href="u3"/></entry></feed>'), ("x", "<!DOCTYPE x><rss/>")]
    got = RD.parse_feed(spark.createDataFrame(docs, "doc string, content string")).collect()
    assert {(r.doc, r.title, r.url) for r in got} == {("r", "A", "u1"), ("r", "B", "u2"), ("a", "C", "u3")}


def test_html_metadata_prefers_meta_tags(spark):
    html = ('<html lang="EN-us"><head><title>plain</title><meta property="og:title" content="Best"><meta name="author" content="Ann">'
            '<meta name="date" content="2024-01-05T10:00:00Z"></head><a href="/x">x</a><a href="mailto:q">m</a><a href="y?z">y</a></html>')
    r = RD.extract_html(spark.createDataFrame([(1, "http://h.org/a/b", html)], "page_id int, url string, html string")).first()
    assert (r.language, r.title, r.author) == ("en-us", "Best", "Ann") and r.published_at is not None
    assert r.links == ["http://h.org/x", "http://h.org/a/y?z"]


def test_content_dedup_window_restarts_after_an_accepted_copy(spark):
    ts = [0, 1000, 3600, 3601, 4000, 7202, 7203, 20000]
    df = spark.createDataFrame([("x", t, i) for i, t in enumerate(ts)], "content string, ts_s bigint, seq bigint")
    want, last = [], None
    for t in ts:
        if last is None or t - last > 3600:
            want.append(t)
            last = t
    assert sorted(r.ts_s for r in ST.batch_dedup_content(df).collect()) == want


def test_files_are_read_with_either_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name;Wert\r\nÄ;1\r\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Name,Wert\nÄ,\"1,5\"\n".encode("latin-1"))
    c = {(r.doc, r.row, r.col): r.text for r in RD.parse_delimited(RD.read_documents(spark, str(tmp_path))).collect()}
    assert c[("a.csv", 1, 1)] == "Name" and c[("a.csv", 2, 1)] == "Ä" and c[("b.csv", 2, 1)] == "Ä" and c[("b.csv", 2, 2)] == "1,5"


def test_undated_signals_name_their_first_locations(spark):
    rows = [("A", k, f"R{k}", None, None) for k in (9, 3, 7, 1, 5, 8)] + [("A", 2, "R2", "2020", None), ("B", 1, "R1", None, 2021), ("C", None, None, None, None), (None, 4, "R4", None, None)]
    d = spark.createDataFrame(rows, "institution_id string, seq long, location string, time_period string, academic_year int").repartition(3)
    got = {r.institution_id: (r.n_undated, r.refs) for r in Q.undated_signals(d).collect()}
    assert got == {"A": (6, ["R1", "R3", "R5", "R7", "R8"]), "C": (1, [None]), None: (1, ["R4"])}
