"""Check SQL of the canonical views (FIXTURES.md, part B)."""
from riskspark.plans.oracle import cte, r
from riskspark.sources.views import EVENT_TYPES, SEVERITIES

cte("v_inst", """
SELECT n_name AS institution_id, r_name AS organization_id,
  CASE n_nationkey % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'engineering' WHEN 2 THEN 'medical' ELSE 'college' END
    AS institution_type,
  (n_nationkey*5-60)::double AS latitude, (n_nationkey*13-160)::double AS longitude, n_nationkey AS inst_no
FROM nation JOIN region ON n_regionkey = r_regionkey""")

cte("v_slots", """
SELECT n_name AS institution_id, c_mktsegment AS department, (year(o_orderdate)+23)::int AS academic_year,
  o_orderkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

cte("v_adm", f"""
SELECT institution_id, department, academic_year, count(*)::int AS sanctioned_intake,
  count(*) FILTER (o_orderstatus <> 'O')::int AS enrolled_count,
  count(*) FILTER (o_orderstatus = 'O')::int AS vacancy_count,
  {r("count(*) FILTER (o_orderstatus = 'O')::double / count(*)", 4)} AS vacancy_rate
FROM v_slots GROUP BY ALL""")

cte("v_cet", f"""
SELECT *, greatest(opening_rank, hi) AS closing_rank FROM (
SELECT institution_id, department, academic_year,
  greatest(1, floor(min(o_totalprice)/100)::int) AS opening_rank, floor(max(o_totalprice)/100)::int AS hi,
  {r("100.0::double * count(*) FILTER (o_orderpriority[1] IN ('1','2')) / count(*)", 2)} AS percentile_cutoff
FROM v_slots GROUP BY ALL)""")

cte("v_plc", f"""
SELECT institution_id, department, academic_year, academic_year AS graduation_year,
  count(*)::int AS eligible_students,
  count(*) FILTER (l_returnflag <> 'R')::int AS placed_students,
  {r("100.0::double * count(*) FILTER (l_returnflag <> 'R') / count(*)", 2)} AS placement_percentage,
  median(round(l_extendedprice*100)::bigint)/1000000.0::double AS median_salary_lpa,
  {r("max(round(l_extendedprice*100)::bigint)/1000000.0::double", 4)} AS max_salary_lpa,
  count(DISTINCT l_suppkey)::int AS top_tier_recruiters,
  count(*) FILTER (l_returnflag = 'R')::int AS unplaced_count
FROM lineitem JOIN v_slots ON l_orderkey = o_orderkey GROUP BY institution_id, department, academic_year""")

cte("v_eslots", """
SELECT n_name AS institution_id,
  CASE event_type WHEN 'view' THEN 'attendance' WHEN 'click' THEN 'feedback' WHEN 'purchase' THEN 'finance'
    WHEN 'signup' THEN 'internships' WHEN 'error' THEN 'grievances' END AS domain,
  event_type || '_value' AS metric_name,
  upper(event_type[1]) || event_type[2:] || ' Value' AS metric_label,
  (2019 + (day(ts)-1)//5)::int AS academic_year,
  CASE WHEN event_type = 'error' THEN 'lower_is_better' ELSE 'higher_is_better' END AS polarity,
  event_id, value, ts, user_id
FROM events JOIN nation ON user_id % 25 = n_nationkey""")

cte("v_sig", f"""
SELECT institution_id || ':' || metric_name || ':' || academic_year AS signal_id,
  institution_id, domain, metric_name, metric_label, NULL::varchar AS department, academic_year, v AS value,
  'count' AS unit, polarity,
  CASE WHEN polarity = 'lower_is_better' THEN {r("least(1.0::double, v/100.0::double)", 3)}
       ELSE {r("greatest(0.0::double, (60.0::double-v)/60.0::double)", 3)} END AS risk_contribution,
  false AS is_contradictory, false AS is_duplicate,
  {r("0.80::double + 0.01::double*(n % 20)", 2)} AS confidence, seq, 'doc_' || domain AS document
FROM (SELECT institution_id, domain, metric_name, metric_label, academic_year, polarity,
        {r("avg(value)", 4)} AS v, count(*) AS n, min(event_id) AS seq
      FROM v_eslots GROUP BY ALL)""")

cte("v_dup", f"""
SELECT event_id::varchar AS signal_id, institution_id, domain, metric_name, metric_label,
  'D' || (user_id % 4) AS department, NULL::varchar AS program, academic_year,
  floor(value/10)::double AS value, floor(value/10)::bigint::varchar AS raw_value, 'count' AS unit, polarity,
  event_id % 2 = 1 AS is_new, event_id AS seq, 'ing_' || (user_id % 7) AS ingestion_id,
  {r("0.80::double + 0.01::double*(event_id % 20)", 2)} AS confidence, 'R' || event_id AS location, ts
FROM v_eslots""")

_et = "[" + ",".join(f"'{x}'" for x in EVENT_TYPES) + "]"
_sv = "[" + ",".join(f"'{x}'" for x in SEVERITIES) + "]"
cte("v_art", f"""
SELECT doc_id AS arrival,
  trim(split_part(text, chr(10), 1)) AS title, text AS summary, source AS publisher,
  'https://' || source || '.example.com/' || doc_id AS url, lang AS country, 'c' || (doc_id % 7) AS city,
  1704067200 + doc_id*1020 AS published_s, {_et}[(doc_id % 9 + 1)::int] AS event_type,
  {_sv}[((doc_id % 10)//3 + 1)::int] AS severity,
  CASE WHEN doc_id % 7 <> 0 THEN (doc_id*37 % 1200)/10.0::double - 60 END AS latitude,
  CASE WHEN doc_id % 7 <> 0 THEN (doc_id*91 % 3600)/10.0::double - 180 END AS longitude,
  CASE WHEN doc_id % 11 = 0 THEN 'RESOLVED' ELSE 'ACTIVE' END AS status
FROM documents""")

cte("v_evt", """
SELECT 'evt_' || arrival AS event_id, arrival, title, summary AS description, event_type, published_s,
  country, city, latitude, longitude, severity, status, publisher AS source_id,
  sha256(summary)[1:16] AS origin_hash, 0.75::double AS confidence,
  CASE WHEN arrival % 3 = 0 THEN []::varchar[] ELSE ['org_' || arrival % 5, 'place_' || arrival % 11] END AS entities
FROM v_art""")

cte("v_src", f"""
SELECT source AS source_id, 'g' || (no % 8) AS independence_group, no % 5 = 0 AS is_official_source,
  {r("0.70::double + 0.01::double*no", 2)} AS reliability
FROM (SELECT DISTINCT source, regexp_replace(source, '[^0-9]', '', 'g')::int AS no FROM documents)""")

cte("v_gq", """
SELECT institution_id AS query_id, latitude AS q_lat, longitude AS q_lon, 500.0::double AS radius_km,
  240 AS hours_back FROM v_inst""")
