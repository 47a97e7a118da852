"""Queries for event resolution, signals, articles, geography and the graph."""
from pyspark.sql import functions as F

from riskspark.functions.num import rnd
from riskspark.operators import dedup as D, geo as G, graph as GR, signals as S
from riskspark.plans.oracle import cte, r, r9
from riskspark.plans.registry import query
from riskspark.session import stage
from riskspark.sources.views import Views

_stop = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
cte("o_tok", f"""SELECT *, lower(country) AS country_l, lower(city) AS city_l,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ({_stop})))) AS tokens FROM v_evt""")


@query("e01_title_tokens", "SELECT event_id, array_to_string(tokens, ' ') AS tokens FROM o_tok")
def e01(v: Views):
    return v.events().select("event_id", F.array_join(D.title_tokens(F.col("title")), " ").alias("tokens"))


cte("o_shp", "SELECT country_l, city_l, event_type, tokens, list_sort(entities) AS entities, min(arrival) AS first_arrival FROM o_tok GROUP BY ALL")
_jaccard = lambda c: (f"CASE WHEN len(a.{c}) = 0 OR len(b.{c}) = 0 THEN 0.0 ELSE len(list_intersect(a.{c}, b.{c}))::double"
                      f"/(len(a.{c}) + len(b.{c}) - len(list_intersect(a.{c}, b.{c}))) END")
_type = "CASE WHEN a.event_type = b.event_type THEN 1.0 ELSE 0.0 END::double"
_base = (f"(0.5::double*({_jaccard('tokens')}) + 0.25::double*CASE WHEN a.country_l = b.country_l AND a.country_l <> '' THEN CASE WHEN a.city_l = b.city_l AND a.city_l <> '' THEN 1.0 ELSE 0.4 END ELSE 0.0 END::double"
         f" + 0.15::double*CASE WHEN len(a.entities) > 0 AND len(b.entities) > 0 THEN 0.6::double*{_type} + 0.4::double*({_jaccard('entities')}) ELSE {_type} END)")
cte("o_sim", f"SELECT a.first_arrival AS shape_a, b.first_arrival AS shape_b, {_base} AS base FROM o_shp a JOIN o_shp b ON a.first_arrival <> b.first_arrival AND a.country_l = b.country_l")


def _shape_pairs(v: Views):
    """Shape pairs by the first arrival of each shape, which names it independently of hashing."""
    sh = D.with_shape(v.events()).groupBy("shape", "country_l", "city_l", "event_type", "tokens", "ents").agg(F.min("arrival").alias("first_arrival"))
    return D.similar_shapes(sh, "first_arrival").withColumn("base", rnd(F.col("base"), 6))


@query("e02_pair_similarity", f"SELECT shape_a, shape_b, {r('base', 6)} AS base FROM o_sim WHERE base + 0.10::double >= 0.7795")
def e02(v: Views):
    return _shape_pairs(v)


@query("e03_pair_classes", f"""SELECT shape_a, shape_b, CASE WHEN s >= .78 THEN 'confirmed_duplicate' WHEN s >= .55 THEN 'probable_duplicate' WHEN s >= .36 THEN 'candidate_duplicate' ELSE 'unique' END AS duplicate_class
FROM (SELECT shape_a, shape_b, {r(r9(r('base', 6)), 3)} AS s FROM o_sim WHERE base + 0.10::double >= 0.7795)""")
def e03(v: Views):
    """Class each similar pair has when the reports lie more than three days apart (no time credit)."""
    from riskspark.functions.num import key9
    return _shape_pairs(v).select("shape_a", "shape_b", D.classify(rnd(key9(F.col("base")), 3)).alias("duplicate_class"))


_time = "CASE WHEN abs(a.published_s - b.published_s) <= 86400 THEN 1.0 WHEN abs(a.published_s - b.published_s) > 259200 THEN 0.0 ELSE 0.5 END::double"
#: Scores of all pairs of an earlier report a and a later one b; which reports become canonical, round by round; each report's best earlier canonical one.
E04 = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.arrival AS a, b.arrival AS b, a.event_id AS matched_id, {r(r9(f'{_base} + 0.1::double*{_time}'), 3)} AS s FROM o_tok a JOIN o_tok b ON a.arrival < b.arrival),
e AS MATERIALIZED (SELECT a, b FROM p WHERE s >= .78),
st(k, id, state) AS (
  SELECT 0, arrival, 0 FROM o_tok
  UNION ALL
  SELECT k + 1, id, CASE WHEN state <> 0 THEN state WHEN merged THEN 2 WHEN waits = 0 THEN 1 ELSE 0 END
  FROM (SELECT st.k, st.id, st.state, coalesce(bool_or(x.state = 1), FALSE) AS merged, count(x.id) FILTER (x.state = 0) AS waits, bool_or(st.state = 0) OVER () AS more
        FROM st LEFT JOIN e ON e.b = st.id LEFT JOIN st x ON x.id = e.a GROUP BY st.k, st.id, st.state) WHERE more),
c AS (SELECT id FROM st WHERE k = (SELECT max(k) FROM st) AND state = 1),
m AS (SELECT p.b, arg_max(p.matched_id, [p.s, -p.a]) AS matched_id, max(p.s) AS similarity FROM p JOIN c ON c.id = p.a GROUP BY p.b)
SELECT t.event_id, t.arrival, CASE WHEN similarity >= .36 THEN matched_id END AS matched_id, CASE WHEN similarity >= .36 THEN similarity END AS similarity,
  CASE WHEN similarity >= .78 THEN 'confirmed_duplicate' WHEN similarity >= .55 THEN 'probable_duplicate' WHEN similarity >= .36 THEN 'candidate_duplicate' ELSE 'unique' END AS duplicate_status
FROM o_tok t LEFT JOIN m ON m.b = t.arrival"""


@query("e04_resolve_duplicates", E04)
def e04(v: Views):
    return D.resolve_duplicates(v.events())


def resolved_chain(v: Views):
    """(resolved links, conflict links, corroborated canonical events)."""
    ev = stage(v.events())
    res = stage(D.resolve_duplicates(ev))
    linked = stage(D.linked_events(ev, res, v.sources()))
    conf = stage(D.resolve_conflicts(linked))
    return ev, res, conf, D.corroborate(linked, conf)


_says = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(description, '')), '{w}')" for w in words) + ")"
cte("o_res", E04)
cte("o_claim", f"""
SELECT e.event_id, e.arrival, e.status, e.source_id, {_says(D.RESTORED)} AS rest, {_says(D.DISRUPTED)} AS disr,
  coalesce(CASE e.severity {' '.join(f"WHEN '{k}' THEN {n}" for k, n in D.SEVERITY_RANK.items())} END, 2) AS sev, e.origin_hash, e.confidence,
  coalesce(s.independence_group, e.source_id) AS grp, coalesce(s.is_official_source, FALSE) AS official FROM v_evt e LEFT JOIN v_src s ON s.source_id = e.source_id""")
cte("o_ln", """
SELECT c.*, row_number() OVER (ORDER BY c.arrival) AS k, r.matched_id, p.arrival AS up, r.duplicate_status AS dup
FROM o_claim c JOIN o_res r USING (event_id) LEFT JOIN o_claim p ON p.event_id = r.matched_id""")
# The rule told step by step: report k changes the record that it matched and, unless merged, starts one of its own.
cte("o_fold", """
WITH RECURSIVE ln AS MATERIALIZED (SELECT * FROM o_ln),
st(id, k, canon, status, corr, conf, srcs, grps, hashes, official, n_conflicts, n_merged, topic) USING KEY (id) AS (
  SELECT -1::bigint, 0::bigint, FALSE, ''::varchar, ''::varchar, 0::double, []::varchar[], []::varchar[], []::varchar[], FALSE, 0::bigint, 0::bigint, NULL::varchar
  UNION
  SELECT CASE w WHEN 0 THEN -1 WHEN 1 THEN arrival ELSE up END, k, w = 2 OR (w = 1 AND NOT merge),
    CASE w WHEN 1 THEN CASE WHEN dup = 'unique' AND official THEN 'CONFIRMED' WHEN NOT merge AND topic IS NOT NULL THEN 'CONTESTED' ELSE status END
      WHEN 2 THEN CASE WHEN NOT merge THEN p_status WHEN nc > 0 THEN 'CONTESTED' WHEN off2 OR ind >= 2 THEN 'CONFIRMED' ELSE p_status END ELSE '' END,
    CASE w WHEN 1 THEN CASE WHEN dup = 'unique' AND official THEN 'Official-source confirmation' WHEN NOT merge AND topic IS NOT NULL THEN 'Conflicting-source signal' ELSE 'Single-source signal' END
      WHEN 2 THEN CASE WHEN NOT merge AND topic IS NULL THEN p_corr WHEN nc > 0 THEN 'Conflicting-source signal' WHEN off2 THEN 'Official-source confirmation'
        WHEN ind >= 2 THEN 'Multi-source corroborated signal' ELSE 'Single-source signal' END ELSE '' END,
    CASE w WHEN 1 THEN confidence WHEN 2 THEN CASE WHEN NOT merge THEN p_conf WHEN nc > 0 THEN greatest(0.45::double, p_conf - 0.15::double) WHEN off2 AND ind >= 2 THEN least(0.98::double, p_conf + 0.08::double)
      WHEN NOT off2 AND ind >= 2 THEN least(0.95::double, p_conf + 0.06::double*(ind - 1)) ELSE p_conf END ELSE 0 END,
    CASE w WHEN 1 THEN [source_id] WHEN 2 THEN s2 ELSE [] END, CASE w WHEN 1 THEN [grp] WHEN 2 THEN g2 ELSE [] END, CASE w WHEN 1 THEN [origin_hash] WHEN 2 THEN h2 ELSE [] END,
    CASE w WHEN 1 THEN official WHEN 2 THEN off2 ELSE FALSE END, CASE w WHEN 1 THEN CASE WHEN NOT merge AND topic IS NOT NULL THEN 1 ELSE 0 END WHEN 2 THEN nc ELSE 0 END,
    CASE w WHEN 2 THEN p_merged + CASE WHEN merge THEN 1 ELSE 0 END ELSE 0 END, CASE w WHEN 1 THEN topic WHEN 2 THEN p_topic END
  FROM (SELECT *, least(len(g2), greatest(1, len(h2))) AS ind FROM (SELECT *, p_nc + CASE WHEN topic IS NULL THEN 0 ELSE 1 END AS nc,
      CASE WHEN merge THEN list_distinct(list_append(p_srcs, source_id)) ELSE p_srcs END AS s2, CASE WHEN merge THEN list_distinct(list_append(p_grps, grp)) ELSE p_grps END AS g2,
      CASE WHEN merge THEN list_distinct(list_append(p_hashes, origin_hash)) ELSE p_hashes END AS h2, p_off OR (merge AND official) AS off2
    FROM (SELECT e.*, e.dup = 'confirmed_duplicate' AS merge, p.status AS p_status, p.corr AS p_corr, p.conf AS p_conf, p.srcs AS p_srcs, p.grps AS p_grps, p.hashes AS p_hashes, p.official AS p_off,
        p.n_conflicts AS p_nc, p.n_merged AS p_merged, p.topic AS p_topic,
        CASE WHEN e.up IS NULL THEN NULL WHEN ((e.rest OR e.status = 'RESOLVED') AND q.disr AND p.status = 'ACTIVE') OR ((q.rest OR p.status = 'RESOLVED') AND e.disr AND e.status = 'ACTIVE')
          THEN 'operational_status_and_impact' WHEN abs(q.sev - e.sev) >= 2 THEN 'severity_assessment' END AS topic
      FROM st t JOIN ln e ON t.id = -1 AND e.k = t.k + 1 LEFT JOIN recurring.st p ON p.id = e.up LEFT JOIN ln q ON q.arrival = e.up))), (VALUES (0), (1), (2)) z(w)
  WHERE w < 2 OR up IS NOT NULL)
SELECT * FROM st WHERE id >= 0""")


@query("e05_claim_conflicts", """
SELECT 'conf_' || sha256(concat_ws(':', lower(l.matched_id), lower(l.event_id), f.topic))[1:12] AS conflict_id, l.matched_id AS event_id, l.event_id AS other_event_id, f.topic,
  p.source_id AS source_a_id, l.source_id AS source_b_id, 0.60::double AS confidence, 'UNRESOLVED' AS resolution_status
FROM o_fold f JOIN o_ln l ON l.arrival = f.id JOIN o_claim p ON p.event_id = l.matched_id WHERE f.topic IS NOT NULL""")
def e05(v: Views):
    _, _, conf, _ = resolved_chain(v)
    return D.claim_conflicts(conf)


@query("e06_corroborate", f"""
SELECT l.event_id, f.status, f.corr AS corroboration_status, {r(r9('f.conf'), 3)} AS confidence, len(f.srcs)::int AS source_count,
  CASE WHEN f.n_merged > 0 THEN least(len(f.grps), len(f.hashes)) ELSE 1 END::int AS independent_source_count, f.n_conflicts::int AS n_conflicts, f.n_merged::int AS n_merged
FROM o_fold f JOIN o_ln l ON l.arrival = f.id WHERE f.canon""")
def e06(v: Views):
    return resolved_chain(v)[3]


CORR = ["Single-source signal", "Multi-source corroborated signal", "Official-source confirmation", "Conflicting-source signal"]
DUPS = ["unique", "unique", "probable_duplicate", "candidate_duplicate"]


def scored(v: Views):
    """Events with every combination of corroboration, streams and duplicate class, set by arrival."""
    i = F.col("arrival")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return v.events().withColumns({
        "corroboration_status": pick(CORR, F.floor(i / 3)), "independent_source_count": (i % 3 + 1).cast("int"),
        "duplicate_status": pick(DUPS, F.floor(i / 5)), "n_conflicts": F.when(F.floor(i / 3) % 4 == 3, 1).otherwise(0)})


def _l(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


cte("o_scored_e", f"""SELECT *, {_l(CORR)}[(arrival//3 % 4 + 1)::int] AS corr, (arrival % 3 + 1)::int AS ind, {_l(DUPS)}[(arrival//5 % 4 + 1)::int] AS dup,
  CASE WHEN arrival//3 % 4 = 3 THEN 1 ELSE 0 END AS nc, lower(country) || ':' || lower(city) AS place,
  CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS sev, count(*) OVER (PARTITION BY lower(country), lower(city)) AS cs FROM v_evt""")
_stage = """CASE WHEN corr LIKE 'Confl%' THEN CASE WHEN sev >= 3 THEN 'DEVELOPING_EVENT' ELSE 'SIGNAL' END WHEN sev = 1 AND ind = 1 THEN 'OBSERVATION'
  WHEN sev = 2 AND ind = 1 AND corr NOT LIKE 'Offi%' THEN 'SIGNAL' WHEN sev >= 3 AND (ind >= 2 OR corr LIKE 'Offi%') THEN CASE WHEN sev = 4 OR (ind >= 2 AND cs >= 2) THEN 'CRISIS_CANDIDATE' ELSE 'SIGNIFICANT_EVENT' END
  WHEN sev >= 3 OR ind >= 2 OR cs >= 2 THEN 'DEVELOPING_EVENT' ELSE 'SIGNAL' END"""
cte("o_sigs", f"SELECT *, {_stage} AS stage FROM o_scored_e")


@query("e07_event_stage", "SELECT event_id, stage FROM o_sigs")
def e07(v: Views):
    return S.crisis_signals(scored(v)).select("event_id", "stage")


_cat = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in S.CATEGORY.items()) + " END"


@query("e08_crisis_signals", f"SELECT 'sig_' || event_id AS signal_id, event_id, title, place, {_cat} AS category, stage, severity, confidence, cs - 1 AS n_related, nc > 0 AS has_conflicting_sources FROM o_sigs")
def e08(v: Views):
    return S.crisis_signals(scored(v))


@query("e09_cluster_signals", f"""
SELECT 'sig_cluster_' || sha256(place)[1:10] AS signal_id, place, 'geographic_clustering' AS category, CASE WHEN max(sev) >= 3 THEN 'SIGNIFICANT_EVENT' ELSE 'DEVELOPING_EVENT' END AS stage,
  ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(sev)] AS severity, {r(r9('avg(confidence)'), 3)} AS confidence, count(*) AS n_events, count(DISTINCT source_id) AS n_sources, arg_min(event_id, arrival) AS first_event_id
FROM o_scored_e WHERE dup = 'unique' GROUP BY place HAVING count(*) >= 2""")
def e09(v: Views):
    return S.cluster_signals(scored(v))


@query("e10_merge_bundles", """
WITH u AS (SELECT origin_hash, arrival, title, 0 AS p, NULL AS organization_id FROM v_evt UNION ALL SELECT sha256(html)[1:16], page_id, url, 1, NULL FROM pages),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY origin_hash, p ORDER BY arrival) = 1)
SELECT origin_hash, arrival, title, 'org-1' AS organization_id FROM f QUALIFY row_number() OVER (PARTITION BY origin_hash ORDER BY p DESC) = 1""")
def e10(v: Views):
    none = F.lit(None).cast("string").alias("organization_id")
    first = lambda d: d.groupBy("origin_hash").agg(F.min_by(F.struct("arrival", "title", "organization_id"), "arrival").alias("_r")).select("origin_hash", "_r.*")
    a = first(v.events().select("origin_hash", "arrival", "title", none))
    b = first(v.table("pages").select(F.substring(F.sha2("html", 256), 1, 16).alias("origin_hash"),
                                      F.col("page_id").alias("arrival"), F.col("url").alias("title"), none))
    return S.merge_bundles([a, b], "origin_hash", organization_id="org-1")


@query("e11_brief_stats", f"""
WITH s AS (SELECT country, count(*) AS n_signals, max(list_position({_l(S.STAGES)}, stage)) AS rk, {r(r9('avg(confidence)'), 3)} AS mean_confidence FROM o_sigs GROUP BY 1)
SELECT country, count(*) AS n_events, any_value(n_signals) AS n_signals, {_l(S.STAGES)}[any_value(rk)::int] AS highest_stage, any_value(mean_confidence) AS mean_confidence,
  count(*) FILTER (corr LIKE 'Single%') AS n_single_source, sum(nc)::bigint AS n_conflicts, count(*) FILTER (latitude IS NULL) AS n_without_coordinates FROM o_scored_e JOIN s USING (country) GROUP BY 1""")
def e11(v: Views):
    ev = scored(v)
    sig = S.crisis_signals(ev).join(ev.select("event_id", "country"), "event_id")
    return S.brief_stats(sig, ev, "country")


_ts = ", ".join(f"'{w}'" for w in S.TREND_STOP_WORDS)
cte("o_at", f"SELECT arrival, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || summary), '[a-z]{{4,}}'), lambda w: w NOT IN ({_ts})))) AS tokens FROM v_art")


@query("e12_trend_terms", f"""
SELECT term, count(*) AS article_frequency, {r('count(*)/greatest(1.0::double, (SELECT count(*) FROM v_art)*0.35::double)', 2)} AS burst_ratio FROM (SELECT unnest(tokens) AS term FROM o_at) GROUP BY term""")
def e12(v: Views):
    return S.trend_terms(v.articles())


cte("o_rel", f"""
WITH s AS (SELECT tokens, len(tokens) AS n, min(arrival) AS f, count(*) AS c FROM o_at WHERE len(tokens) > 0 GROUP BY 1, 2),
p AS (SELECT a.f AS article_a, b.f AS article_b, a.c AS copies_a, b.c AS copies_b, len(list_intersect(a.tokens, b.tokens))::double AS i, a.n + b.n AS nn FROM s a JOIN s b ON a.f < b.f AND a.n >= 0.22*b.n AND b.n >= 0.22*a.n)
SELECT article_a, article_b, copies_a, copies_b, {r('i/(nn-i)', 6)} AS jaccard FROM p WHERE {r9('i/(nn-i)')} >= 0.22""")


@query("e13_related_articles", "SELECT * FROM o_rel")
def e13(v: Views):
    return S.related_articles(v.articles())


@query("e13_article_copies", "SELECT min(arrival) AS first_article, count(*) AS copies FROM o_at WHERE len(tokens) > 0 GROUP BY tokens")
def e13c(v: Views):
    return S.article_copies(v.articles())


@query("e14_refresh_delta", """
WITH a AS (SELECT 'event' AS kind, event_id AS record_id FROM v_evt UNION ALL SELECT DISTINCT 'evidence', origin_hash FROM v_evt), b AS (SELECT 'event' AS kind, event_id AS record_id FROM v_evt WHERE status = 'RESOLVED' UNION ALL SELECT DISTINCT 'evidence', origin_hash FROM v_evt WHERE status = 'RESOLVED'),
n AS (SELECT * FROM a ANTI JOIN b USING (kind, record_id))
SELECT count(*) FILTER (kind = 'event') AS new_events, count(*) FILTER (kind = 'evidence') AS new_evidence, (SELECT count(*) FROM v_src) AS n_providers, (SELECT count(*) FROM v_src WHERE is_official_source) AS n_failed, 'PARTIAL_FAILURE' AS status FROM n""")
def e14(v: Views):
    rec = lambda e: e.select(F.lit("event").alias("kind"), F.col("event_id").alias("record_id")).unionByName(
        e.select(F.lit("evidence").alias("kind"), F.col("origin_hash").alias("record_id")).distinct())
    e = v.events()
    prov = v.sources().select(F.when(F.col("is_official_source"), "DEGRADED").otherwise("ONLINE").alias("status"))
    return S.refresh_delta(rec(e.where("status = 'RESOLVED'")), rec(e), prov)


ETYPES = ["Threat Actor", "Organization", "Malware", "Location", "Infrastructure", "Asset", "Indicator", "Person"]


def entities(v: Views):
    """Parts as entities with a type, a name and coordinates."""
    k = F.col("p_partkey")
    return v.table("part").select(
        F.concat(F.lit("ent_"), k.cast("string")).alias("entity_id"), k.alias("arrival"), F.col("p_name").alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in ETYPES]), (k % 8 + 1).cast("int")).alias("entity_type"),
        ((k * 53 % 1700) / 10.0 - 85).alias("latitude"), ((k * 131 % 3600) / 10.0 - 180).alias("longitude"),
        F.lit(0.85).alias("confidence"))


cte("o_ent", f"""SELECT 'ent_' || p_partkey AS entity_id, p_partkey AS arrival, p_name AS name, {_l(ETYPES)}[(p_partkey % 8 + 1)::int] AS entity_type,
  (p_partkey*53 % 1700)/10.0::double - 85 AS latitude, (p_partkey*131 % 3600)/10.0::double - 180 AS longitude, 0.85::double AS confidence FROM part""")


@query("e15_threat_entities", f"SELECT entity_id, name, entity_type FROM o_ent WHERE entity_type IN ({', '.join(repr(x) for x in S.THREAT_TYPES)})")
def e15(v: Views):
    return S.threat_entities(entities(v)).select("entity_id", "name", "entity_type")


# ---- geography ----------------------------------------------------------------------------------
def hav_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c}-{a})/2.0::double), 2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2.0::double), 2))"
    return r(r9(f"6371.0088::double*2.0::double*atan2(sqrt({x}), sqrt(greatest(0.0::double, 1.0::double-{x})))"), 2)


@query("g01_haversine",
       f"SELECT event_id, {hav_sql('latitude', 'longitude', '(0.0::double)', '(arrival % 360 - 180.0::double)')} AS distance_km FROM v_evt WHERE latitude IS NOT NULL")
def g01(v: Views):
    e = v.events().where("latitude IS NOT NULL")
    return e.select("event_id", G.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(0.0),
                                               F.col("arrival") % 360 - F.lit(180.0)).alias("distance_km"))


AS_OF = "(SELECT max(published_s) FROM v_evt)"


def _as_of(v: Views):
    return v.table("documents").agg(F.max(F.lit(1704067200) + F.col("doc_id") * 1020)).scalar()


@query("g02_geofence", f"""
WITH j AS (SELECT query_id, event_id, severity, radius_km, {hav_sql('q_lat', 'q_lon', 'latitude', 'longitude')} AS distance_km FROM v_gq, v_evt WHERE latitude IS NOT NULL AND published_s >= {AS_OF} - hours_back*3600)
SELECT query_id, event_id, severity, distance_km FROM j WHERE distance_km <= radius_km""")
def g02(v: Views):
    return G.geofence(v.geo_queries(), v.events(), _as_of(v))


@query("g02_geofence_wide", f"""
WITH j AS (SELECT query_id, event_id, severity, {hav_sql('q_lat', 'q_lon', 'latitude', 'longitude')} AS distance_km FROM v_gq, v_evt WHERE latitude IS NOT NULL AND published_s >= {AS_OF} - hours_back*3600 AND severity IN ('HIGH', 'CRITICAL'))
SELECT query_id, event_id, severity, distance_km FROM j WHERE distance_km <= 4000""")
def g02w(v: Views):
    return G.geofence(v.geo_queries().withColumn("radius_km", F.lit(4000.0)), v.events(), _as_of(v), "HIGH")


@query("g03_nearby_assets", f"""
WITH a AS (SELECT entity_id AS asset_id, entity_type AS asset_type, latitude, longitude FROM o_ent WHERE entity_type IN ('Infrastructure', 'Organization', 'Asset')
  UNION ALL SELECT institution_id, 'Registered Institution', CASE WHEN inst_no % 3 = 0 THEN 15.3647 ELSE latitude END, CASE WHEN inst_no % 3 = 0 THEN 75.1240 ELSE longitude END FROM v_inst),
j AS (SELECT query_id, asset_id, asset_type, {hav_sql('q_lat', 'q_lon', 'latitude', 'longitude')} AS distance_km FROM v_gq, a)
SELECT * FROM j WHERE distance_km <= 500""")
def g03(v: Views):
    i = v.institutions()
    known = F.col("inst_no") % 3 != 0
    inst = i.select("institution_id", F.when(known, F.col("latitude")).alias("latitude"),
                    F.when(known, F.col("longitude")).alias("longitude"), F.when(~known, " Hubballi").alias("city"))
    return G.nearby_assets(v.geo_queries(), entities(v), inst)


@query("g04_density_clusters", f"""
SELECT 'cluster_' || sha256(lower(country || ':' || city))[1:10] AS cluster_id, country, city, {r(r9('avg(latitude)'), 4)} AS center_latitude, {r(r9('avg(longitude)'), 4)} AS center_longitude, count(*) AS event_count,
  ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(sev)] AS max_severity, {_l(S.STAGES)}[max(list_position({_l(S.STAGES)}, stage))::int] AS highest_stage FROM o_sigs WHERE latitude IS NOT NULL GROUP BY country, city""")
def g04(v: Views):
    ev = scored(v)
    return G.density_clusters(ev.join(S.crisis_signals(ev).select("event_id", "stage"), "event_id"))


# ---- graph --------------------------------------------------------------------------------------
def graph_inputs(v: Views):
    e = v.events().withColumn("evidence_id", F.concat(F.lit("ev_"), "origin_hash"))
    evid = e.groupBy("evidence_id").agg(F.min_by(F.struct("arrival", "title", "source_id"), "arrival").alias("_r")).select(
        "evidence_id", "_r.*").withColumn("confidence", F.lit(0.85))
    return v.sources(), evid, entities(v), e


cte("o_evid", "SELECT 'ev_' || origin_hash AS evidence_id, min(arrival) AS arrival, arg_min(title, arrival) AS title, arg_min(source_id, arrival) AS source_id, 0.85::double AS confidence FROM v_evt GROUP BY 1")
cte("o_ge", "SELECT *, 'ev_' || origin_hash AS evidence_id, strftime(make_timestamp(published_s*1000000), '%Y-%m-%d') AS dy FROM v_evt")


@query("g10_graph_nodes", """
WITH u AS (SELECT 0 AS b, 0 AS s, source_id AS node_id, 'Source' AS node_type, source_id AS label, reliability AS confidence FROM v_src
 UNION ALL SELECT 1, arrival, evidence_id, 'Evidence', title, confidence FROM o_evid
 UNION ALL SELECT 2, arrival, entity_id, CASE entity_type WHEN 'Threat Actor' THEN 'Threat Actor' WHEN 'Organization' THEN 'Organization' WHEN 'Infrastructure' THEN 'Infrastructure' WHEN 'Indicator' THEN 'Indicator' WHEN 'Location' THEN 'Location' ELSE 'Entity' END, name, confidence FROM o_ent
 UNION ALL SELECT 3, arrival, event_id, 'Event', title, confidence FROM o_ge UNION ALL SELECT 3, arrival, 'tl_' || dy, 'Timeline', 'Timeline ' || dy, 1.0 FROM o_ge
 UNION ALL SELECT 3, arrival, 'loc_country_' || replace(lower(country), ' ', '_'), 'Location', country, 0.95 FROM o_ge)
SELECT node_id, arg_min(node_type, b::bigint*1000000000+s) AS node_type, arg_min(label, b::bigint*1000000000+s) AS label, arg_min(confidence, b::bigint*1000000000+s) AS confidence, count(*) AS n_mentions FROM u GROUP BY 1""")
def g10(v: Views):
    return GR.graph_nodes(*graph_inputs(v))


cte("o_edge", """
WITH u AS (SELECT 1 AS b, arrival AS s, source_id AS f, 'supported-by' AS t, evidence_id AS g, confidence AS c FROM o_evid WHERE source_id IN (SELECT source_id FROM v_src)
 UNION ALL SELECT 3, arrival, event_id, 'occurred-on', 'tl_' || dy, 1.0 FROM o_ge UNION ALL SELECT 3, arrival, 'loc_country_' || replace(lower(country), ' ', '_'), 'affected-by', event_id, confidence FROM o_ge
 UNION ALL SELECT 3, arrival, event_id, 'reported-by', source_id, confidence FROM o_ge)
SELECT 'kge_' || sha256(lower(f || ':' || t || ':' || g))[1:12] AS edge_id, arg_min(f, b::bigint*1000000000+s) AS source_node_id, arg_min(t, b::bigint*1000000000+s) AS relationship_type, arg_min(g, b::bigint*1000000000+s) AS target_node_id, arg_min(c, b::bigint*1000000000+s) AS confidence FROM u GROUP BY 1""")


@query("g11_graph_edges", "SELECT * FROM o_edge")
def g11(v: Views):
    s, ev, _, e = graph_inputs(v)
    return GR.graph_edges(s, ev, e)


@query("g12_two_hop", """
WITH s AS (SELECT source_id AS seed, source_id AS node_id FROM v_src WHERE is_official_source), ends AS (SELECT edge_id, source_node_id AS n FROM o_edge UNION ALL SELECT edge_id, target_node_id FROM o_edge),
h1 AS (SELECT DISTINCT seed, edge_id FROM s JOIN ends ON n = node_id), nn AS (SELECT seed, n FROM h1 JOIN ends USING (edge_id) UNION SELECT seed, node_id FROM s)
SELECT DISTINCT seed, edge_id FROM nn JOIN ends USING (n)""")
def g12(v: Views):
    s, ev, _, e = graph_inputs(v)
    edges = stage(GR.graph_edges(s, ev, e))
    seeds = s.where("is_official_source").select(F.col("source_id").alias("seed"), F.col("source_id").alias("node_id"))
    return GR.two_hop(edges, seeds)


@query("g13_timeline", """
WITH m AS (SELECT event_id, published_s AS f, unnest([{'p': 'first_observed', 't': published_s}, {'p': 'reported', 't': published_s + 3600}, {'p': 'confirmed', 't': CASE WHEN arrival % 3 = 0 THEN published_s + 7200 END},
  {'p': 'last_updated', 't': published_s + 9000}, {'p': 'resolved', 't': CASE WHEN status = 'RESOLVED' THEN published_s + 86400 END}]) AS x, generate_subscripts([1,2,3,4,5], 1) AS i FROM v_evt)
SELECT event_id, f AS first_s, row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS position, x.p AS phase, x.t AS ts_s FROM m WHERE x.t IS NOT NULL""")
def g13(v: Views):
    p = F.col("published_s")
    ts = lambda d: F.timestamp_seconds(p + d)
    e = v.events().withColumns({
        "reported_at": ts(3600), "confirmed_at": F.when(F.col("arrival") % 3 == 0, ts(7200)), "last_updated": ts(9000),
        "resolved_at": F.when(F.col("status") == "RESOLVED", ts(86400))})
    return GR.timeline(e).select("event_id", F.unix_timestamp("first_observed").alias("first_s"), "position", "phase",
                                 F.unix_timestamp("ts").alias("ts_s"))
