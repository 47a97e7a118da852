"""Queries for sources, evidence, network, memory and streaming operators."""
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskspark.functions.num import rnd
from riskspark.operators import evidence as V5, forecast as T, intel as I, memory as ME, network as N, risk as R, signals as S
from riskspark.plans import q_intel as QI
from riskspark.plans.oracle import clamp, clone, cte, r, r9
from riskspark.plans.q_data import plain_sql, reading_signals
from riskspark.plans.q_risk import CORE_DEPTS, _nations
from riskspark.plans.registry import ORACLES, query
from riskspark.session import shared_folder, stage
from riskspark.sources import feeds as FD, readers as RD
from riskspark.sources.views import Views
from riskspark.streaming import stream as ST

DEPT = ["institution_id", "department"]
CELL = [*DEPT, "academic_year"]


# ---- S01-S12 ------------------------------------------------------------------------------------
def canonical_docs(v: Views):
    """One JSON upload per institution and year with its admissions and ranking rows."""
    a, _, c = v.canonical()
    ja = a.groupBy("institution_id", "academic_year").agg(F.collect_list(F.struct(*[F.col(x) for x in a.columns])).alias("admissions"))
    jc = c.groupBy("institution_id", "academic_year").agg(F.collect_list(F.struct(*[F.col(x) for x in c.columns])).alias("cet_ranking"))
    return ja.join(jc, ["institution_id", "academic_year"]).select(
        F.concat_ws("_", "institution_id", "academic_year").alias("doc"), F.to_json(F.struct("admissions", "cet_ranking")).alias("content"))


@query("s01_canonical_json", """
SELECT a.institution_id || '_' || a.academic_year AS source_id, a.institution_id, a.department, a.academic_year, sanctioned_intake, enrolled_count, vacancy_rate, closing_rank
FROM v_adm a JOIN v_cet c USING (institution_id, department, academic_year)""")
def s01(v: Views):
    a, _, c = RD.parse_canonical_json(canonical_docs(v))
    return a.select(F.col("provenance.source_id").alias("source_id"), *CELL, "sanctioned_intake", "enrolled_count", "vacancy_rate").join(
        c.select(*CELL, "closing_rank"), CELL)


def signal_docs(v: Views):
    """JSON uploads of one signal each, alternating between the accepted spellings of metric and period."""
    rd = v.readings()
    k = F.col("rid")
    item = F.struct(F.when(k % 2 == 0, F.col("label")).alias("metric"), F.when(k % 2 == 1, F.col("label")).alias("name"), F.col("raw_value").alias("value"),
                    F.when(k % 5 == 0, "Finance").alias("domain"), F.when(k % 3 == 0, "2023-24").alias("period"), F.col("institution_id").alias("institution_id"))
    return rd.select(F.concat(F.lit("up_"), k.cast("string")).alias("doc"), F.to_json(F.struct(F.array(item).alias("signals"))).alias("content"))


@query("s02_signals_json", """
SELECT 'up_' || rid AS doc, CASE WHEN rid % 5 = 0 THEN 'finance' ELSE domain END AS domain, metric_name, value, unit, CASE WHEN rid % 3 = 0 THEN 2023 END AS academic_year, 'JSON $.signals[0]' AS location FROM o_rsig WHERE raw_value <> ''""")
def s02(v: Views):
    return RD.parse_signals_json(signal_docs(v)).select("doc", "domain", "metric_name", "value", "unit", "academic_year", "location")


def _csv_docs(v: Views):
    """Delimited uploads of up to 200 customers, with tab, semicolon or comma by number; names hold the delimiter, notes line breaks and quotes."""
    n = F.floor(F.col("c_custkey") / 200)
    c = v.table("customer").select("c_custkey", n.alias("n"), "c_name", "c_mktsegment", F.round("c_acctbal", 2).cast("decimal(12,2)").alias("bal"))
    sep = F.when(F.col("n") % 3 == 0, "\t").when(F.col("n") % 3 == 1, ";").otherwise(",")
    line = F.concat(F.col("c_custkey"), sep, F.lit('"'), F.col("c_name"), sep, F.lit('x"'), sep, F.lit('"a ""'), F.col("c_mktsegment"), F.lit('""\r\nb"'), sep, F.lit('5" '), F.col("bal"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n")
    return c.groupBy("n", sep.alias("s")).agg(rows.alias("rows")).select(
        F.concat(F.lit("cust_"), F.col("n")).alias("doc"), F.concat(F.lit("\r\n"), F.array_join(F.array(F.lit("Key"), F.lit("Name"), F.lit("Note"), F.lit("Balance")), "|"), F.lit("\r\n \n"), "rows", F.lit("\n\n")).alias("content"), "s").select(
        "doc", F.replace("content", F.lit("|"), F.col("s")).alias("content"))


@query("s03_delimited", """
WITH c AS (SELECT c_custkey // 200 AS n, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) + 3 AS r, c_custkey, c_name, c_mktsegment,
    printf('%.2f', round(c_acctbal, 2)) AS bal, CASE c_custkey // 200 % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ';' ELSE ',' END AS s FROM customer),
h AS (SELECT n, 2 AS r, unnest([1, 2, 3, 4]) AS c, unnest(['Key', 'Name', 'Note', 'Balance']) AS t FROM (SELECT DISTINCT n FROM c)),
u AS (SELECT n, r, unnest([1, 2, 3, 4]) AS c, unnest([c_custkey::varchar, c_name || s || 'x', 'a "' || c_mktsegment || '"' || chr(13) || chr(10) || 'b', '5" ' || bal]) AS t FROM c)
SELECT 'cust_' || n AS doc, r AS "row", c AS col, t AS text FROM h UNION ALL SELECT 'cust_' || n, r, c, t FROM u""")
def s03(v: Views):
    return RD.parse_delimited(_csv_docs(v)).drop("sheet")


@query("s04_text_lines", r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM documents)),
m AS (SELECT doc_id, n, trim(t) AS t FROM l WHERE trim(t) <> ''),
h AS (SELECT *, t LIKE '#%' OR (length(t) < 75 AND t LIKE '%:' AND NOT regexp_matches(t, '\d')) AS hd FROM m),
s AS (SELECT *, last_value(CASE WHEN hd THEN trim(ltrim(t, '#'), ': ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM h)
SELECT doc_id::varchar AS doc, n AS line_no, coalesce(sec, 'Section 1') AS ctx, t AS text FROM s WHERE NOT hd""")
def s04(v: Views):
    return RD.parse_text_lines(v.table("documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("content")))


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def feed_docs(v: Views):
    """One feed document per article: RSS for two thirds, Atom for the rest, some with a refused declaration."""
    a = v.articles()
    i = F.col("arrival")
    item = F.concat(F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><description>"), _xml(F.col("summary")), F.lit("</description><link>"),
                    F.col("url"), F.lit("</link>"), F.when(i % 2 == 0, F.concat(F.lit("<source url=\"u\">"), F.col("publisher"), F.lit("</source>"))).otherwise(""), F.lit("</item>"))
    rss = F.concat(F.lit("<rss version=\"2.0\"><channel><title>c</title>"), item, F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>"), _xml(F.col("title")), F.lit("</title><summary>s</summary><link href=\""),
                    F.col("url"), F.lit("\"/></entry></feed>"))
    body = F.when(i % 3 == 2, atom).otherwise(rss)
    return a.select(i.cast("string").alias("doc"), F.when(i % 10 == 9, F.concat(F.lit("<!DOCTYPE x>"), body)).otherwise(body).alias("content"))


@query("s05_feed_xml", """
SELECT arrival::varchar AS doc, url, CASE WHEN arrival % 3 <> 2 AND arrival % 2 = 0 THEN publisher ELSE 'RSS Feed' END AS publisher FROM v_art WHERE arrival % 10 <> 9""")
def s05(v: Views):
    return RD.parse_feed(feed_docs(v)).select("doc", "url", "publisher")


@query("s06_html_pages", r"""
WITH p AS (SELECT page_id, url, html, lower(coalesce(nullif(regexp_extract(html, '<html[^>]*\blang=["'']?([a-zA-Z\-]+)["'']?', 1, 'i'), ''), 'en')) AS language,
  list_filter(list_transform(regexp_extract_all(html, '<a[^>]+href=["'']([^"''#]+)["'']', 1, 'i'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|tel:|data:)')) AS h,
  regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages)
SELECT page_id, language, len(list_distinct(list_transform(h, lambda x: CASE WHEN x LIKE 'http%' THEN x WHEN x LIKE '/%' THEN root || x ELSE url || '//' || x END))) AS n_links FROM p""")
def s06(v: Views):
    return RD.extract_html(v.table("pages")).select("page_id", "language", F.size("links").alias("n_links"))


@query("s06_html_content", r"""
WITH p AS (SELECT page_id, url, html, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS t, lower(coalesce(nullif(regexp_extract(html, '<html[^>]*\blang=["'']?([a-zA-Z\-]+)["'']?', 1, 'i'), ''), 'en')) AS language,
  list_filter(list_transform(regexp_extract_all(html, '<a[^>]+href=["'']([^"''#]+)["'']', 1, 'i'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(javascript:|mailto:|tel:|data:)')) AS h,
  regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages)
SELECT page_id, url, language, coalesce(nullif(""" + plain_sql("t") + r""", ''), url) AS title, NULL::varchar AS author, NULL::timestamp AS published_at, """ + plain_sql("html") + r""" AS content,
  array_to_string(list_filter(list_distinct_ordered, lambda x: regexp_matches(x, '^https?://')), ' ') AS links
FROM (SELECT *, list_transform(h, lambda x: CASE WHEN x LIKE 'http%' THEN x WHEN x LIKE '/%' THEN root || x ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || x END) AS l FROM p),
LATERAL (SELECT list(x ORDER BY i) AS list_distinct_ordered FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY x))""")
def s06c(v: Views):
    return RD.extract_html(v.table("pages")).withColumn("links", F.array_join("links", " "))


def stix_bundles(v: Views):
    """One bundle per part: an indicator, a report for every fourth, and a relationship to the next part's object."""
    p = v.table("part")
    k = F.col("p_partkey")
    ident = F.concat(F.when(k % 4 == 0, "report--").otherwise("malware--"), k.cast("string"))
    obj = F.struct(F.when(k % 4 == 0, "report").otherwise("malware").alias("type"), ident.alias("id"), F.col("p_name").alias("name"),
                   F.col("p_size").cast("double").alias("confidence"), F.lit("2024-01-05T00:00:00Z").alias("created"),
                   F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("target_ref"), F.lit(None).cast("string").alias("relationship_type"))
    none = F.lit(None)
    rel = F.struct(F.lit("relationship").alias("type"), none.cast("string").alias("id"), none.cast("string").alias("name"), F.lit(88.0).alias("confidence"),
                   none.cast("string").alias("created"), ident.alias("source_ref"), F.lit("external--1").alias("target_ref"), F.lit("Targets").alias("relationship_type"))
    return p.select(k.cast("string").alias("bundle_id"), F.to_json(F.struct(F.array(obj, rel).alias("objects"))).alias("content"))


@query("s07_stix_bundles", f"""
WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'report--' ELSE 'malware--' END || p_partkey AS id, p_size::double AS c FROM part)
SELECT p_partkey::varchar AS bundle_id, 'ent_octi_' || sha256(lower(id))[1:12] AS source_entity, 'targets' AS relationship_type, 'external--1' AS target_entity, 0.88::double AS confidence,
  CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN {r(r9('CASE WHEN c > 1 THEN c/100.0::double ELSE c END'), 3)} >= .85 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity FROM o""")
def s07(v: Views):
    n = FD.normalize_stix(stage(FD.read_stix_objects(stix_bundles(v))))
    return n["relationships"].select("bundle_id", "source_entity", "relationship_type", "target_entity", "confidence").join(
        n["events"].select("bundle_id", "severity"), "bundle_id", "left")


def misp_docs(v: Views):
    p = v.table("part")
    k = F.col("p_partkey")
    at = lambda t, val, ids: F.struct(F.lit(t).alias("type"), val.alias("value"), F.lit(ids).alias("to_ids"))
    ev = F.struct(k.cast("string").alias("uuid"), F.col("p_name").alias("info"), F.array(
        at("ip-dst", F.col("p_brand"), True), at("domain", F.when(k % 2 == 0, "").otherwise(F.col("p_type")), False)).alias("Attribute"))
    return p.select(F.to_json(F.struct(ev.alias("Event"))).alias("content"))


@query("s08_misp_to_stix", """
WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type FROM part)
SELECT 'bundle--misp-' || k AS bundle_id, 0 AS position, 'report' AS type, p_name AS name, 88.0::double AS confidence FROM p
UNION ALL SELECT 'bundle--misp-' || k, 1, 'indicator', 'MISP Attribute (ip-dst): ' || p_brand, 90.0 FROM p UNION ALL SELECT 'bundle--misp-' || k, 2, 'relationship', NULL, 88.0 FROM p
UNION ALL SELECT 'bundle--misp-' || k, 3, 'indicator', 'MISP Attribute (domain): ' || p_type, 70.0 FROM p WHERE k % 2 = 1 UNION ALL SELECT 'bundle--misp-' || k, 4, 'relationship', NULL, 88.0 FROM p WHERE k % 2 = 1""")
def s08(v: Views):
    return FD.misp_to_stix(misp_docs(v)).select("bundle_id", "position", "type", "name", "confidence")


CATS = ["geopolitical", "cyber", "climate", "infrastructure", "Military", "sports", "supply_chain"]


def feed_items(v: Views):
    a = v.articles()
    return a.select("arrival", "title", "summary", F.element_at(F.array(*[F.lit(x) for x in CATS]), (F.col("arrival") % 7 + 1).cast("int")).alias("category"),
                    F.when(F.col("arrival") % 6 == 0, "unknown").otherwise(F.lower("severity")).alias("severity"), "country", "city", "latitude", "longitude",
                    "published_s", F.lit(0.86).alias("confidence"))


_clean = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '<(script|style|iframe|object|embed|applet|meta|link)\b[^>]*>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s ]+', ' ', 'g'))"
_nrm = r"regexp_replace(lower(trim({})), '\s+', ' ', 'g')"


@query("s09_feed_items", f"""
WITH t AS (SELECT *, {_clean.format('title')} AS ti, {_clean.format('summary')} AS su FROM v_art),
h AS (SELECT *, sha256({_nrm.format("ti || ':' || su || ':' || country || ':' || city")}) AS ch, sha256({_nrm.format("country || ':' || city")}) AS ph FROM t),
e AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ch ORDER BY arrival) = 1)
SELECT 'evt_wi_' || ch[1:12] AS event_id, arrival, CASE ['geopolitical', 'cyber', 'climate', 'infrastructure', 'military', 'sports', 'supply_chain'][(arrival % 7 + 1)::int] WHEN 'cyber' THEN 'cyber_threat' WHEN 'climate' THEN 'climate_environmental'
  WHEN 'infrastructure' THEN 'infrastructure_disruption' WHEN 'military' THEN 'military' WHEN 'supply_chain' THEN 'supply_chain' ELSE 'geopolitical' END AS event_type,
  CASE WHEN arrival % 6 = 0 THEN 'MEDIUM' ELSE severity END AS severity, 'ev_wi_' || ch[1:12] AS evidence_id, 'ent_loc_' || ph[1:10] AS place_id FROM e""")
def s09(v: Views):
    return FD.normalize_feed_items(feed_items(v))["events"].select("event_id", "arrival", "event_type", "severity", "evidence_id", "place_id")


@query("s09_item_entities", f"""
WITH m AS (SELECT *, unnest([struct_pack(n := publisher, t := NULL::varchar), struct_pack(n := '<b>' || city || '</b> Grid', t := 'Infrastructure'), struct_pack(n := title, t := 'Event')]) AS e
  FROM v_art WHERE arrival % 3 <> 0),
c AS (SELECT *, {_clean.format("coalesce(nullif(e.n, ''), 'Unknown Entity')")} AS name, coalesce(e.t, 'Organization') AS entity_type FROM m),
h AS (SELECT *, 'ent_wi_' || sha256({_nrm.format("entity_type || ':' || name")})[1:10] AS entity_id FROM c)
SELECT entity_id, arrival, name, entity_type, 0.86::double AS confidence, country, city, latitude, longitude FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY arrival, name, entity_type) = 1""")
def s09e(v: Views):
    """Named entities of feed items: two thirds of the items name their publisher, a grid and their title."""
    a = v.articles().withColumn("entities", F.when(F.col("arrival") % 3 != 0, F.array(
        F.struct(F.col("publisher").alias("name"), F.lit(None).cast("string").alias("type")),
        F.struct(F.concat(F.lit("<b>"), "city", F.lit("</b> Grid")).alias("name"), F.lit("Infrastructure").alias("type")),
        F.struct(F.col("title").alias("name"), F.lit("Event").alias("type")))))
    items = FD.normalize_feed_items(a.withColumns({"category": F.lit("cyber"), "confidence": F.lit(0.86)}))["item_entities"]
    return items.select("entity_id", "arrival", "name", "entity_type", "confidence", "country", "city", "latitude", "longitude")


def _articles_in(v: Views):
    return v.articles().withColumn("wire_origin", F.col("summary"))


cte("o_s10", f"""
WITH h AS (SELECT *, sha256({_nrm.format(f"publisher || ':' || {_clean.format('title')} || ':' || {_clean.format('summary')}")}) AS ch, sha256({_nrm.format('publisher')}) AS sh FROM v_art),
e AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ch ORDER BY arrival) = 1)
SELECT * FROM e""")


@query("s10_articles", r"""
SELECT 'evt_tr_' || ch[1:12] AS event_id, arrival, 'src_news_' || sh[1:10] AS source_id, 'ev_tr_' || ch[1:12] AS evidence_id, sha256(regexp_replace(lower(regexp_replace(summary, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS origin_hash FROM o_s10""")
def s10(v: Views):
    return FD.normalize_articles(_articles_in(v))["events"].select("event_id", "arrival", "source_id", "evidence_id", "origin_hash")


@query("s10_article_entities", f"""
WITH m AS (SELECT *, unnest(CASE WHEN arrival % 3 = 0 THEN [city] ELSE [publisher || ' University', title] END) AS n FROM v_art),
c AS (SELECT *, {_clean.format('n')} AS name FROM m),
h AS (SELECT *, 'ent_tr_' || sha256({_nrm.format('name')})[1:10] AS entity_id FROM c)
SELECT entity_id, arrival, name, CASE WHEN regexp_matches(lower(name), 'university|network|board') THEN 'Organization' ELSE 'Location' END AS entity_type,
  0.85::double AS confidence, country, city, latitude, longitude FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY arrival, name) = 1""")
def s10e(v: Views):
    """Entities of articles: two thirds name a university and their title, the others stand for their city."""
    a = _articles_in(v).withColumn("entities", F.when(F.col("arrival") % 3 != 0, F.array(F.concat("publisher", F.lit(" University")), "title")))
    return FD.normalize_articles(a)["entities"].select("entity_id", "arrival", "name", "entity_type", "confidence", "country", "city", "latitude", "longitude")


@query("s10_article_context", """
WITH n AS (SELECT arrival, count(*) AS n FROM (SELECT unnest([article_a, article_b]) AS arrival FROM o_rel) GROUP BY 1),
t AS (SELECT term, count(*) AS c FROM (SELECT unnest(tokens) AS term FROM o_at) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT 'evt_tr_' || ch[1:12] AS event_id, arrival, coalesce(n.n, 0) AS n_related, (SELECT string_agg(term, ', ' ORDER BY c DESC, term) FROM t) AS trend_terms FROM o_s10 LEFT JOIN n USING (arrival)""")
def s10c(v: Views):
    """Articles with the eight leading trend terms and the number of related article groups."""
    a = v.articles()
    ev = FD.normalize_articles(_articles_in(v))["events"]
    return FD.with_article_context(ev, S.trend_terms(a), S.related_articles(a), 8).select("event_id", "arrival", "n_related", "trend_terms")


@query("s11_web_documents", r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) || CASE page_id % 5 WHEN 0 THEN '.gov' WHEN 1 THEN '.nic.in' WHEN 2 THEN '.ac.in' ELSE '' END AS host FROM pages)
SELECT DISTINCT 'src_web_' || sha256(host)[1:10] AS source_id, host AS publisher, regexp_matches(host, '\.(gov|gov\.in|nic\.in|edu|ac\.in)$') AS is_official_source,
  CASE WHEN regexp_matches(host, '\.(gov|gov\.in|edu|ac\.in)$') THEN 0.88 ELSE 0.76 END::double AS reliability FROM p""")
def s11(v: Views):
    k = F.col("page_id") % 5
    sfx = F.when(k == 0, ".gov").when(k == 1, ".nic.in").when(k == 2, ".ac.in").otherwise("")
    d = RD.extract_html(v.table("pages")).withColumn("url", F.regexp_replace("url", r"^([a-z]+://[^/]+)", F.concat(F.lit("$1"), sfx)))
    return FD.web_docs_to_events(d)["sources"].select("source_id", "publisher", "is_official_source", "reliability")


MAGIC = ["255044462D312E34", "504B030414000600", "89504E470D0A1A0A", "4D5A900003000000", "49443303000000", "41424344", "D0CF11E0A1B11AE1", "474946383961"]
EXTS = ["pdf", "xlsx", "png", "csv", "mp3", "txt", "zip", "json", "exe"]


def _ls(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("s12_file_inventory", f"""
WITH f AS (SELECT p_partkey, 'f' || p_partkey || '.' || {_ls(EXTS)}[(p_partkey // 8 % {len(EXTS)} + 1)::int] AS path, {_ls(EXTS)}[(p_partkey // 8 % {len(EXTS)} + 1)::int] AS e, {_ls(MAGIC)}[(p_partkey % {len(MAGIC)} + 1)::int] AS x FROM part),
g AS (SELECT *, CASE WHEN x LIKE '255044462D%' THEN 'PDF' WHEN x LIKE '504B0304%' THEN CASE WHEN e = 'xlsx' THEN 'XLSX' ELSE 'UNSUPPORTED' END WHEN x LIKE 'D0CF%' OR x LIKE '4D5A%' THEN 'UNSUPPORTED'
  WHEN x LIKE '89504E47%' OR x LIKE '474946%' OR e = 'png' THEN 'IMAGE' WHEN x LIKE '494433%' OR e = 'mp3' THEN 'AUDIO_VIDEO' WHEN e = 'csv' THEN 'CSV' WHEN e IN ('txt', 'json') THEN 'TXT' WHEN e = 'pdf' THEN 'PDF' WHEN e = 'xlsx' THEN 'XLSX' ELSE 'UNSUPPORTED' END AS f FROM f)
SELECT path, f AS format, CASE WHEN x LIKE '504B0304%' AND f = 'UNSUPPORTED' THEN 'generic ZIP archive' WHEN x LIKE 'D0CF%' THEN 'legacy Office container' WHEN x LIKE '4D5A%' THEN 'executable' WHEN f = 'UNSUPPORTED' THEN 'unsupported format' END AS reason FROM g""")
def s12(v: Views):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    files = v.table("part").select(F.concat(F.lit("f"), k, F.lit("."), pick(EXTS, F.floor(k / 8))).alias("path"), F.unhex(pick(MAGIC, k)).alias("content"))
    return RD.inventory_files(files)


# ---- V01-V06 ------------------------------------------------------------------------------------
@query("v01_signal_provenance", f"""
SELECT 'prov_dyn_sig_' || fingerprint AS evidence_id, 'UNIVERSAL_INGESTION_PIPELINE' AS source, document, 'Primary Section' AS page_or_section, location AS cell_or_range, label || ': ' || raw_value AS excerpt, 0.9::double AS extraction_confidence,
  coalesce(time_period, CASE WHEN academic_year IS NOT NULL THEN 'AY ' || academic_year END, 'Period unspecified') || CASE WHEN department IS NOT NULL THEN ', Dept: ' || department ELSE '' END || ' (' || institution_id || ')' AS date_or_context,
  domain, metric_name, value AS observed_value FROM o_rsig""")
def v01(v: Views):
    none = F.lit(None).cast("string")
    d = reading_signals(v).withColumns({"source": none, "page_or_section": none, "excerpt": none, "metric_label": F.col("label"), "confidence": F.lit(0.9)})
    return V5.signal_provenance(d)


def _all_anomalies(v: Views):
    """Department-level statistical anomalies and dynamic-signal anomalies of the nation institutions."""
    from riskspark.operators import anomalies as A
    a, p, c = v.canonical()
    s = v.staged("signals")
    cols = ["institution_id", "department", *A.COLS]
    dynamic = A.dynamic_anomalies(s).withColumn("department", F.lit(None).cast("string"))
    an = R.all_anomalies(a, p, c, DEPT, cross=True).select(cols).unionByName(dynamic.select(cols))
    return stage(an), s


_an = "institution_id, department, signal_name, academic_year, metric_name, observed_value, baseline_value, severity"
cte("o_anoms", " UNION ALL ".join([*(f"SELECT {_an} FROM d_a{k}" for k in (1, 2, 3, 4)),
                                  f"SELECT {_an.replace('department', 'NULL::varchar AS department')} FROM {clone('o_dyn', 'vd_', {'w_sig': 'v_sig'})}"]))


@query("v02_anomaly_provenance", """
WITH c AS (SELECT institution_id, academic_year, 'admissions' AS st, min(department) AS d FROM v_adm GROUP BY 1, 2 UNION ALL SELECT institution_id, academic_year, 'placements', min(department) FROM v_plc GROUP BY 1, 2
  UNION ALL SELECT institution_id, academic_year, 'ranking', min(department) FROM v_cet GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN contains(lower(signal_name), 'admission') THEN 'admissions' WHEN contains(lower(signal_name), 'placement') THEN 'placements' WHEN regexp_matches(lower(signal_name), 'cet|rank') THEN 'ranking' END AS st FROM o_anoms),
m AS (SELECT k.institution_id, k.signal_name, k.academic_year, k.metric_name, arg_min(s.signal_id, s.seq) AS signal_id, arg_min(s.document, s.seq) AS document
  FROM (SELECT DISTINCT institution_id, signal_name, academic_year, metric_name FROM a) k JOIN v_sig s ON s.institution_id = k.institution_id AND s.academic_year = k.academic_year
    AND (contains(k.metric_name, s.metric_name) OR contains(s.metric_name, k.metric_name) OR contains(lower(k.signal_name), lower(s.domain))) GROUP BY 1, 2, 3, 4)
SELECT institution_id, signal_name, academic_year, metric_name, observed_value, baseline_value, CASE WHEN signal_id IS NOT NULL THEN 'signal' WHEN d IS NOT NULL THEN 'canonical' ELSE 'ledger' END AS matched,
  coalesce(document, institution_id || '_canonical_ledger') AS document,
  coalesce(signal_id, upper(st[1]) || st[2:] || '[' || d || ', AY' || academic_year || ']', 'Table[' || metric_name || ']') AS cell_or_range
FROM a LEFT JOIN m USING (institution_id, signal_name, academic_year, metric_name) LEFT JOIN c USING (institution_id, academic_year, st)""")
def v02(v: Views):
    an, s = _all_anomalies(v)
    a, p, c = v.canonical()
    tagged = lambda d, n: d.select(*CELL, F.lit(n).alias("domain"))
    canon = tagged(a, "admissions").unionByName(tagged(p, "placements")).unionByName(tagged(c, "ranking"))
    return V5.anomaly_provenance(an, s, canon)


@query("v03_dossiers", """
WITH dm AS (SELECT institution_id, 'admissions' AS d FROM v_adm UNION SELECT institution_id, 'placements' FROM v_plc UNION SELECT institution_id, 'ranking' FROM v_cet UNION SELECT institution_id, domain FROM v_sig),
h AS (SELECT institution_id, list_sort(list(d)) AS l FROM dm GROUP BY 1),
n AS (SELECT institution_id, count(*) AS n FROM o_anoms GROUP BY 1),
k AS (SELECT institution_id, string_agg(m, ',' ORDER BY m) AS s FROM (SELECT DISTINCT institution_id, domain || '.' || metric_name AS m FROM v_sig) GROUP BY 1),
x AS (SELECT institution_id, count(*) AS c FROM v_sig WHERE is_contradictory GROUP BY 1)
SELECT institution_id, cri, risk_level, coalesce(n, 0) AS n_anomalies, coalesce(array_to_string(l, ','), '') AS covered_domains,
  array_to_string(list_filter(['admissions', 'placements', 'ranking'], lambda q: NOT list_contains(coalesce(l, []), q)), ',') AS missing_domains, coalesce(s, '') AS sampled_metrics, coalesce(c, 0) AS n_contradictions
FROM nat_o_assess LEFT JOIN h USING (institution_id) LEFT JOIN n USING (institution_id) LEFT JOIN k USING (institution_id) LEFT JOIN x USING (institution_id)""")
def v03(v: Views):
    an, s = _all_anomalies(v)
    a, p, c = v.canonical()
    canon = a.select("institution_id", F.lit("admissions").alias("domain")).unionByName(
        p.select("institution_id", F.lit("placements").alias("domain"))).unionByName(c.select("institution_id", F.lit("ranking").alias("domain")))
    d = V5.dossier(R.assess(a, p, c, s, CORE_DEPTS), an, s, canon)
    return d.withColumns({x: F.array_join(x, ",") for x in ("covered_domains", "missing_domains", "sampled_metrics")})


@query("v04_insight_catalog", """
WITH g AS (SELECT institution_id, department, signal_name, metric_name, count(DISTINCT academic_year) AS n_periods, count(*) AS n_records,
    min(struct_pack(y := academic_year, v := observed_value)).v AS first_value, max(struct_pack(y := academic_year, v := observed_value)).v AS last_value,
    min(academic_year) AS first_year, max(academic_year) AS last_year, min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS rk FROM o_anoms GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY institution_id ORDER BY rk, n_records DESC, signal_name, metric_name, department NULLS FIRST) AS position,
  CASE WHEN n_periods >= 2 THEN 'trend' ELSE 'single_period' END AS kind, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][rk + 1] AS severity FROM g""")
def v04(v: Views):
    an, _ = _all_anomalies(v)
    return V5.insight_catalog(an)


@query("v06_ground_claims", f"""
WITH t AS (SELECT institution_id, institution_id || ':' || department || ':' || academic_year AS text_id, unnest([vacancy_rate, {r('vacancy_rate*100', 2)}, {r('vacancy_rate*730 + 8.5', 2)}]) AS claim, unnest([0, 1, 2]) AS position FROM v_adm),
a AS (SELECT institution_id, {r('avg(vacancy_rate)*100', 2)} AS al FROM v_adm GROUP BY 1 UNION ALL SELECT institution_id, {r('max(vacancy_rate)*730', 2)} FROM v_adm GROUP BY 1 UNION ALL SELECT institution_id, {r('min(vacancy_rate)', 4)} FROM v_adm GROUP BY 1)
SELECT institution_id, text_id, position, claim, EXISTS (SELECT 1 FROM a WHERE a.institution_id = t.institution_id AND abs(claim - al) <= greatest(0.15::double, abs(al)*0.02::double)) AS grounded FROM t""")
def v06(v: Views):
    a = v.admissions()
    x = F.col("vacancy_rate")
    dec = lambda c, k: F.format_string(f"%.{k}f", c)
    texts = a.select("institution_id", F.concat_ws(":", *CELL).alias("text_id"), F.concat(
        F.lit("Vacancy of "), dec(x, 4), F.lit(" means "), dec(rnd(x * 100, 2), 2), F.lit("% (v2.x index "), dec(rnd(x * 730 + 8.5, 2), 2), F.lit(").")).alias("text"))
    g = a.groupBy("institution_id").agg(F.array(rnd(F.avg("vacancy_rate") * 100, 2), rnd(F.max("vacancy_rate") * 730, 2), rnd(F.min("vacancy_rate"), 4)).alias("_a"))
    return V5.ground_claims(texts, g.select("institution_id", F.explode("_a").alias("allowed")))


# ---- N01-N10 ------------------------------------------------------------------------------------
cte("o_hier", "SELECT n_name AS institution_id, unnest(['AUTOMOBILE', 'archive ', 'Building']) AS code, unnest(['Automobile dept', 'Archive', 'Building dept']) AS node_name, unnest(['department', 'program', 'department']) AS node_type FROM nation")


def _hierarchy(v: Views):
    item = lambda c, n, t: F.struct(F.lit(c).alias("code"), F.lit(n).alias("node_name"), F.lit(t).alias("node_type"))
    return v.table("nation").select(F.col("n_name").alias("institution_id"), F.inline(F.array(
        item("AUTOMOBILE", "Automobile dept", "department"), item("archive ", "Archive", "program"), item("Building", "Building dept", "department"))))


@query("n01_hierarchy_summary", """
WITH c AS (SELECT institution_id, department AS node_code, count(*) AS na, max(academic_year) AS ya, arg_max(vacancy_rate, academic_year) AS vacancy_rate, arg_max(enrolled_count, academic_year)::double AS enrolled_count FROM v_adm GROUP BY 1, 2),
p AS (SELECT institution_id, department AS node_code, count(*) AS np, max(academic_year) AS yp, arg_max(placement_percentage, academic_year) AS pp, arg_max(median_salary_lpa, academic_year) AS ms FROM v_plc GROUP BY 1, 2),
k AS (SELECT institution_id, department AS node_code, count(*) AS nc, max(academic_year) AS yc, arg_max(closing_rank, academic_year)::double AS cr FROM v_cet GROUP BY 1, 2),
s AS (SELECT institution_id, 'INSTITUTIONAL' AS node_code, count(*) AS ns, max(academic_year) AS ys, count(DISTINCT domain) AS ds FROM v_sig GROUP BY 1, 2),
h AS (SELECT institution_id, upper(trim(code)) AS node_code, node_name, node_type FROM o_hier),
x AS (SELECT institution_id, department AS node_code, count(*) AS ac FROM d_a1 GROUP BY 1, 2)
SELECT institution_id, node_code, coalesce(node_name, node_code) AS node_name, coalesce(node_type, 'department') AS node_type, coalesce(na, 0)+coalesce(np, 0)+coalesce(nc, 0)+coalesce(ns, 0) AS signal_count,
  (coalesce(na, 0) > 0)::int + (coalesce(np, 0) > 0)::int + (coalesce(nc, 0) > 0)::int + coalesce(ds, 0) AS n_domains, greatest(ya, yp, yc, ys) AS latest_year, vacancy_rate, enrolled_count,
  CASE WHEN yp >= ya OR ya IS NULL THEN pp END AS placement_percentage, CASE WHEN yp >= ya OR ya IS NULL THEN ms END AS median_salary_lpa, CASE WHEN yc >= greatest(ya, yp) OR greatest(ya, yp) IS NULL THEN cr END AS closing_rank, coalesce(ac, 0) AS anomaly_count
FROM c FULL JOIN p USING (institution_id, node_code) FULL JOIN k USING (institution_id, node_code) FULL JOIN s USING (institution_id, node_code) FULL JOIN h USING (institution_id, node_code) LEFT JOIN x USING (institution_id, node_code)""")
def n01(v: Views):
    from riskspark.operators import anomalies as A
    a, p, c = v.canonical()
    return N.hierarchy_summary(_hierarchy(v), a, p, c, v.signals(), A.admissions_anomalies(a, DEPT))


def net_institutions(v: Views):
    """Nations as institutions of their region plus one new institution per region without any data."""
    i = v.institutions().select("organization_id", "institution_id", "institution_type")
    new = v.table("region").select(F.col("r_name").alias("organization_id"), F.concat(F.col("r_name"), F.lit("/new")).alias("institution_id"), F.lit("school").alias("institution_type"))
    return i.unionByName(new)


cte("o_net", "SELECT organization_id, institution_id, institution_type FROM v_inst UNION ALL SELECT r_name, r_name || '/new', 'school' FROM region")
cte("o_ladder", """WITH g AS (SELECT institution_id, count(*) FILTER (stage = 'Anomaly') AS n_a, count(*) FILTER (stage = 'Emerging Risk') AS n_e, count(*) FILTER (stage = 'Institutional Risk') AS n_i, count(*) FILTER (stage = 'Crisis') AS n_c FROM o_items GROUP BY 1)
SELECT a.institution_id, CASE WHEN n_c > 0 OR (cri >= .70 AND n_i > 0) THEN 'Crisis' WHEN n_i > 0 OR (cri >= .55 AND n_e >= 2) THEN 'Institutional Risk' WHEN n_e > 0 THEN 'Emerging Risk' WHEN n_a > 0 THEN 'Anomaly' ELSE 'Observation' END AS overall_stage
FROM nat_o_assess a JOIN g USING (institution_id)""")
cte("o_sum", """
SELECT organization_id, i.institution_id, institution_type, coalesce(nc, 0) + coalesce(nd, 0) > 0 AS has_data, coalesce(nc, 0) + coalesce(nd, 0) AS signal_count, CASE WHEN coalesce(nc, 0) + coalesce(nd, 0) > 0 THEN coalesce(n_periods, 0) ELSE 0 END AS n_periods,
  a.cri, coalesce(a.risk_level, 'INSUFFICIENT_DATA') AS risk_level, coalesce(overall_stage, 'insufficient_evidence') AS risk_stage, coalesce(a.driver, 'No data ingested yet') AS driver,
  coalesce(n_anomalies, 0) AS n_anomalies, coalesce(f.status, 'INSUFFICIENT_EVIDENCE') AS forecast_status, terminal_cri AS year3_cri
FROM o_net i LEFT JOIN nat_o_assess a USING (institution_id) LEFT JOIN o_ladder USING (institution_id) LEFT JOIN o_fc f USING (institution_id)
LEFT JOIN (SELECT institution_id, count(*) AS nc FROM v_adm GROUP BY 1) x USING (institution_id) LEFT JOIN (SELECT institution_id, count(*) AS nd FROM v_sig GROUP BY 1) y USING (institution_id)""")


def summaries(v: Views):
    """(network institutions, constituent summaries, baselines, evaluated anomalies, series)."""
    series, base, ev = QI.evaluated(v)
    a, cov, s = _nations(v)
    a = stage(a)
    adm, _, _ = v.canonical()
    cnt = lambda d, n: d.groupBy("institution_id").agg(F.count("*").alias(n))
    inst = net_institutions(v)
    out = N.constituent_summary(inst, a, I.stage_ladder(base, ev, a), T.explainable_forecast(a, cov, s), cnt(adm, "n_canonical"), cnt(s, "n_dynamic"))
    return inst, stage(out), base, ev, series


@query("n02_constituent_summary", "SELECT * FROM o_sum")
def n02(v: Views):
    return summaries(v)[1]


cte("o_n03", """SELECT r_name AS organization_id, r_name AS institution_id, 'educational_group_network' AS entity_category, 'group' AS entity_type FROM region
UNION ALL SELECT r_name, n_name, 'single', 'college' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, s_name, 'private_organization', 'college' FROM supplier""")


@query("n03_constituents", "SELECT organization_id, institution_id FROM o_n03 i WHERE NOT (institution_id = organization_id AND EXISTS (SELECT 1 FROM o_n03 c WHERE c.organization_id = i.organization_id AND c.institution_id <> c.organization_id))")
def n03(v: Views):
    rg, n, s = v.table("region"), v.table("nation"), v.table("supplier")
    row = lambda d, o, i, cat, typ: d.select(F.col(o).alias("organization_id"), F.col(i).alias("institution_id"), F.lit(cat).alias("entity_category"), F.lit(typ).alias("entity_type"))
    u = row(rg, "r_name", "r_name", "educational_group_network", "group").unionByName(
        row(n.join(rg, n.n_regionkey == rg.r_regionkey), "r_name", "n_name", "single", "college")).unionByName(row(s, "s_name", "s_name", "private_organization", "college"))
    return N.constituents(u).select("organization_id", "institution_id")


cte("o_n04", """SELECT organization_id, lower(trim(domain)) AS domain, metric_name, count(DISTINCT institution_id) AS n_institutions, count(*) AS n_anomalies, min(latest_period) AS first_year, max(latest_period) AS last_year, 'CO_OCCURRING_ANOMALY' AS pattern_type
FROM o_eval JOIN o_net USING (institution_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT institution_id) >= 2""")


@query("n04_metric_cooccurrence", "SELECT * FROM o_n04")
def n04(v: Views):
    _, _, ev = QI.evaluated(v)
    return N.metric_cooccurrence(ev, net_institutions(v))


@query("n05_domain_pressure", """
WITH ws AS (SELECT institution_id, domain, metric_name FROM o_last WHERE NOT (ny < 2 OR (prev_year IS NULL AND academic_year = y1)) AND abs(floor((last_value-prev_value)*1e4+0.5)/1e4) > 1e-5 AND ((polarity = 'higher_is_better' AND last_value < prev_value) OR (polarity = 'lower_is_better' AND last_value > prev_value))),
u AS (SELECT institution_id, domain, metric_name FROM o_eval UNION ALL SELECT * FROM ws ANTI JOIN o_eval USING (institution_id, domain))
SELECT organization_id, domain, count(DISTINCT institution_id) AS n_institutions, count(DISTINCT metric_name) AS n_metrics, 'SHARED_DOMAIN_PRESSURE' AS pattern_type FROM u JOIN o_net USING (institution_id)
WHERE (organization_id, domain) NOT IN (SELECT (organization_id, domain) FROM o_n04) GROUP BY 1, 2 HAVING count(DISTINCT institution_id) >= 2""")
def n05(v: Views):
    series, base, ev = QI.evaluated(v)
    inst = net_institutions(v)
    return N.domain_pressure(ev, I.signal_changes(series, base), inst, N.metric_cooccurrence(ev, inst))


@query("n06_divergent_network", """
SELECT organization_id, count(*) AS n_populated, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS n_elevated, count(*) FILTER (risk_level = 'LOW') AS n_low FROM (
  SELECT organization_id, institution_id, risk_level FROM o_sum WHERE has_data UNION ALL SELECT n.organization_id, a.institution_id, a.risk_level FROM o_assess a JOIN o_net n ON n.institution_id = split_part(a.institution_id, '/', 1) WHERE a.mode = 'single_stream')
GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) > 0 AND count(*) FILTER (risk_level = 'LOW') > 0""")
def n06(v: Views):
    """Nations and their single-department institutions together, where levels differ more."""
    from riskspark.plans.q_risk import network
    a = R.assess(*network(v), CORE_DEPTS).where("mode <> 'dynamic_only'")
    org = v.institutions().select("organization_id", F.col("institution_id").alias("_n"))
    s = a.withColumn("_n", F.split("institution_id", "/")[0]).join(org, "_n").withColumn("has_data", F.lit(True))
    return N.divergent_network(s)


@query("n07_compare_cri", f"""
SELECT organization_id, count(cri) AS n_compared, {r('min(cri)', 4)} AS min_value, {r('max(cri)', 4)} AS max_value, {r(r9('avg(cri)'), 4)} AS mean_value, {r('max(cri)-min(cri)', 4)} AS spread, count(*) FILTER (cri IS NULL) AS n_excluded FROM o_sum GROUP BY 1 HAVING count(cri) >= 2""")
def n07(v: Views):
    return N.compare_cri(summaries(v)[1])


cte("o_lm", f"""
WITH b AS (SELECT institution_id, domain, metric_name, arg_max(latest_value, dept_key) AS bv, arg_max(latest_period, dept_key) AS bp FROM o_base WHERE latest_value IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT institution_id, domain, metric_name, arg_max(value, struct_pack(y := academic_year, q := seq)) AS sv, max(academic_year) AS sy FROM v_sig GROUP BY 1, 2, 3)
SELECT institution_id, domain, metric_name, CASE WHEN sv IS NOT NULL AND (bv IS NULL OR sy >= bp) THEN sv ELSE bv END AS observed_value FROM b FULL JOIN s USING (institution_id, domain, metric_name)""")
cte("o_cmp", f"""SELECT organization_id, domain, metric_name, count(*) AS n_compared, {r('min(x)', 4)} AS min_value, {r('max(x)', 4)} AS max_value, {r(r9('avg(x)'), 4)} AS mean_value, {r('max(x)-min(x)', 4)} AS spread
FROM (SELECT *, {r('observed_value', 4)} AS x FROM o_lm) JOIN o_net USING (institution_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")


def _metrics(v: Views):
    series = B_series(v)
    from riskspark.operators import baseline as B
    return N.latest_metrics(B.build_baselines(series), v.staged("signals")), net_institutions(v)


def B_series(v: Views):
    from riskspark.operators import baseline as B
    return stage(B.yearly_series(QI.unified(v)))


@query("n08_compare_metrics", "SELECT * FROM o_cmp")
def n08(v: Views):
    return N.compare_metrics(*_metrics(v))


@query("n08_metric_exclusions", "SELECT organization_id, institution_id, domain, metric_name FROM o_cmp JOIN o_net USING (organization_id) ANTI JOIN o_lm USING (institution_id, domain, metric_name)")
def n08x(v: Views):
    m, inst = _metrics(v)
    m = stage(m)
    return N.metric_exclusions(m, inst, N.compare_metrics(m, inst)).select("organization_id", "institution_id", "domain", "metric_name")


@query("n09_network_totals", f"""
WITH g AS (SELECT organization_id, count(*) AS n_institutions, count(*) FILTER (has_data) AS n_with_data, count(*) FILTER (n_periods >= 2) AS n_multi_year, count(*) FILTER (n_periods < 3) AS n_gaps, sum(signal_count)::bigint AS n_signals, count(DISTINCT institution_type) AS n_types,
  count(*) FILTER (risk_level = 'CRITICAL') AS n_critical, count(*) FILTER (risk_level = 'HIGH') AS n_high, count(*) FILTER (risk_level = 'MEDIUM') AS n_medium, count(*) FILTER (risk_level = 'LOW') AS n_low,
  {r(r9('avg(cri)'), 4)} AS mean_cri, {r('max(cri)', 4)} AS max_cri, arg_max(institution_id, struct_pack(a := cri, b := institution_id)) FILTER (cri IS NOT NULL) AS highest_institution FROM o_sum GROUP BY 1)
SELECT *, {r('n_with_data::double/n_institutions', 4)} AS coverage_ratio, CASE WHEN max_cri IS NULL THEN 'INSUFFICIENT_DATA' WHEN max_cri >= .75 THEN 'CRITICAL' WHEN max_cri >= .55 THEN 'HIGH' WHEN max_cri >= .35 THEN 'MEDIUM' ELSE 'LOW' END AS network_level FROM g""")
def n09(v: Views):
    return N.network_totals(summaries(v)[1])


@query("n10_org_signal_listing", """
SELECT organization_id, institution_id, coalesce(n, 0) AS n_snapshots, coalesce(d, 0) AS n_discovered, coalesce(n, 0) + coalesce(d, 0) AS n_total FROM o_net LEFT JOIN (SELECT institution_id, count(*) AS n FROM v_adm GROUP BY 1) USING (institution_id) LEFT JOIN (SELECT institution_id, count(*) AS d FROM v_dup GROUP BY 1) USING (institution_id)""")
def n10(v: Views):
    return N.org_signal_listing(net_institutions(v), v.admissions(), v.signals_dup())


# ---- T08-T10, C07 -------------------------------------------------------------------------------
def _memory(v: Views):
    st = stage(QI.statements(v))
    return stage(ME.memory_entries(st, QI.t07_comparisons(v)))


def _feedback(v: Views, mem):
    """Labels as reviewer feedback: on inferences by rank, or on findings nobody stored."""
    # An inference gets the feedback whose id falls in its hash slot; the institution comes from the target.
    inf = mem.where("category = 'inference'").select("memory_id", "institution_id", F.pmod(F.conv(F.substring(F.sha2("memory_id", 256), 1, 8), 16, 10).cast("long"), F.lit(1000)).alias("k"))
    inf = inf.groupBy("k").agg(F.min(F.struct("memory_id", "institution_id")).alias("_m")).select("k", "_m.*")
    lab = v.table("labels").select(F.col("doc_id").alias("feedback_id"), "quality", "toxic")
    j = lab.join(inf, lab.feedback_id == inf.k, "left").withColumn("institution_id", F.coalesce("institution_id", F.lit("UNASSIGNED")))
    return j.select("feedback_id", F.coalesce("memory_id", F.concat(F.lit("finding_"), F.col("feedback_id"))).alias("target_id"), "institution_id",
                    F.when(F.col("quality") == 1, "Confirmed").when(F.col("toxic") == 1, "Incorrect").otherwise("Insufficient Evidence").alias("verdict"),
                    F.when(F.col("feedback_id") % 5 != 0, F.concat(F.lit("reviewed against document "), F.col("feedback_id"))).alias("comment"))


_cat = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in ME.CATEGORY.items())
cte("o_mem", f"""
SELECT memory_id, arg_max(institution_id, confidence) AS institution_id, any_value(domain) AS domain, any_value(metric_name) AS metric_name, any_value(dept_key) AS dept_key,
  any_value(category) AS category, any_value(statement) AS statement, any_value(payload) AS payload, max(confidence) AS confidence
FROM (SELECT 'mem_' || sha256(concat_ws('|', institution_id, coalesce(domain, ''), coalesce(metric_name, ''), coalesce(dept_key, ''), statement_class, statement))[1:16] AS memory_id,
    institution_id, domain, metric_name, dept_key, CASE statement_class {_cat} END AS category, statement, '{{"statement_class":"' || statement_class || '"}}' AS payload, confidence FROM o_stmt
  UNION ALL SELECT 'out_' || institution_id || '_' || target_year || '_' || metric_name, institution_id, NULL, metric_name, NULL, 'outcome',
    metric_name || ' in ' || target_year || ': predicted ' || {QI._fixed('predicted_value', 4)} || ', observed ' || {QI._fixed('observed_value', 4)},
    '{{"target_year":' || target_year || ',"within_band":' || within_band || '}}', accuracy FROM ({QI._outc.format('o_hind')}))
GROUP BY memory_id""")
cte("o_fb", """
WITH inf AS (SELECT ('0x' || sha256(memory_id)[1:8])::bigint % 1000 AS k, min(struct_pack(memory_id, institution_id)) AS m FROM o_mem WHERE category = 'inference' GROUP BY 1)
SELECT doc_id AS feedback_id, coalesce(m.memory_id, 'finding_' || doc_id) AS target_id, coalesce(m.institution_id, 'UNASSIGNED') AS institution_id,
  CASE WHEN quality = 1 THEN 'Confirmed' WHEN toxic = 1 THEN 'Incorrect' ELSE 'Insufficient Evidence' END AS verdict, CASE WHEN doc_id % 5 <> 0 THEN 'reviewed against document ' || doc_id END AS comment
FROM labels LEFT JOIN inf ON k = doc_id""")


@query("t08_memory_entries", "SELECT * FROM o_mem")
def t08(v: Views):
    return _memory(v)


@query("t08_memory_references", """
SELECT memory_id, document, academic_year, seq FROM o_mem JOIN (SELECT institution_id, domain, metric_name, coalesce(department, '') AS dept_key, document, academic_year, seq FROM o_uni
  WHERE value IS NOT NULL AND NOT is_duplicate) USING (institution_id, domain, metric_name, dept_key)""")
def t08_references(v: Views):
    return ME.memory_references(_memory(v), QI.unified(v))


_verdict = " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in ME.VERDICTS.items())


@query("t09_memory_view", f"""
WITH last AS (SELECT target_id, arg_max(struct_pack(verdict, comment, institution_id), feedback_id) AS f FROM o_fb GROUP BY 1)
SELECT memory_id, institution_id, category, statement, CASE WHEN category <> 'inference' THEN 'RECORDED' ELSE coalesce(CASE f.verdict {_verdict} END, 'UNDER_REVIEW') END AS status
FROM o_mem LEFT JOIN last ON target_id = memory_id AND category = 'inference'
UNION ALL SELECT target_id, f.institution_id, 'inference', coalesce(f.comment, 'Reviewed finding ' || target_id), coalesce(CASE f.verdict {_verdict} END, 'INSUFFICIENT_EVIDENCE')
FROM last WHERE target_id NOT IN (SELECT memory_id FROM o_mem WHERE category = 'inference')""")
def t09(v: Views):
    mem = _memory(v)
    return ME.memory_view(mem, _feedback(v, mem))


@query("t10_append_feedback", f"""
SELECT institution_id, category, count(*) AS n_entries, {r(r9('avg(confidence)'), 3)} AS mean_confidence
FROM (SELECT institution_id, category, confidence FROM o_mem UNION ALL SELECT institution_id, 'user_feedback', 0.5 FROM o_fb) GROUP BY 1, 2""")
def t10(v: Views):
    mem = _memory(v)
    return ME.category_counts(ME.append_feedback(mem, _feedback(v, mem)))


_year = lambda i: r(r9(clamp(f"cri + {i}*(drift)")), 6)


@query("c07_overview", f"""
WITH d AS (SELECT a.*, 0.15::double*(0.0::double + 0.40::double*coalesce(w.vacancy_rate_slope, 0.0) + -0.35::double*coalesce(w.placement_pct_slope, 0.0) + 0.25::double*coalesce(w.closing_rank_slope, 0.0)) AS drift
  FROM nat_o_assess a LEFT JOIN o_wslopes w USING (institution_id)),
f AS (SELECT institution_id, count(*) AS n_findings, string_agg(concat_ws(': ', severity, signal_name, metric_name), ' | ' ORDER BY position) AS top_findings FROM ({ORACLES['v04_insight_catalog']}) GROUP BY 1)
SELECT institution_id, cri, risk_level, CASE WHEN cri >= .70 THEN 'critical' WHEN cri >= .50 THEN 'elevated' WHEN cri >= .30 THEN 'watch' ELSE 'stable' END AS status_band, n_anomalies,
  {_year(1)} AS year1_cri, {_year(2)} AS year2_cri, {_year(3)} AS year3_cri, coalesce(n_findings, 0) AS n_findings, coalesce(top_findings, '') AS top_findings
FROM d LEFT JOIN f USING (institution_id)""")
def c07(v: Views):
    from riskspark.operators import features as FT
    an, s = _all_anomalies(v)
    a, p, c = v.canonical()
    ass = stage(R.assess(a, p, c, s, CORE_DEPTS))
    pts = T.project(T.with_drift(ass, FT.weighted_slopes(FT.department_features(a, p, c), a)), 3)
    return ME.overview(ass, pts, V5.insight_catalog(an)).withColumn("top_findings", F.array_join("top_findings", " | "))


# ---- R01-R03 ------------------------------------------------------------------------------------
_r01 = """
WITH RECURSIVE e AS (SELECT sha256(event_type || ':' || (user_id % 20)) AS h, floor(epoch(ts))::bigint AS t, min(event_id) AS seq FROM events GROUP BY 1, 2),
acc AS (SELECT h, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT h, t FROM (SELECT acc.h, (SELECT min(e.t) FROM e WHERE e.h = acc.h AND e.t > acc.t + 3600) AS t FROM acc) WHERE t IS NOT NULL)
SELECT h AS content_hash, t AS ts_s, seq FROM acc JOIN e USING (h, t)"""


@query("r01_dedup_content", _r01)
def r01(v: Views):
    e = v.table("events").select(F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_s"),
                                 F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("content"))
    return ST.batch_dedup_content(e)


def _event_stream(v: Views):
    """The events table as a stream (the folder holds one file per table)."""
    schema = v.table("events").schema
    s = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _arriving_files(v: Views, rows: DataFrame, folder: str, per_file: int = 2_000_000) -> DataFrame:
    """The rows as a stream of files that arrive one after the other, every row up to two hours after its time stamp.

    The rows are split by arrival in one pass. A micro-batch takes two arrivals, however many files of ``per_file`` rows they fill, so larger tables make
    larger micro-batches and not more of them. The last file holds one row a year later, which closes all windows before it.
    """
    came = F.floor((F.unix_timestamp("ts") + F.pmod(F.xxhash64("seq"), F.lit(7200))) / (4 * 86400))
    rows.withColumn("came", came).write.partitionBy("came").parquet(f"{folder}-split")
    split = v.spark.read.schema(StructType([*rows.schema, StructField("came", LongType())])).parquet(f"{folder}-split")
    sizes = split.where("came IS NOT NULL").groupBy("came").agg(F.count("*").alias("n")).orderBy("came").collect()  # a row for every four days
    files = max([1, *(-(-r["n"] // per_file) for r in sizes)])
    for r in sizes:
        split.where(F.col("came") == r["came"]).drop("came").repartition(files).write.mode("append").parquet(folder)
    rows.agg(F.lit(-1).cast("long").alias("seq"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit("end").alias("content")).write.mode("append").parquet(folder)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(folder)


@query("r01_stream_dedup", _r01)
def r01s(v: Views):
    """Several micro-batches with late and reordered rows."""
    e = v.table("events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("content"))
    root = shared_folder(v.spark, "dedup")
    s = _arriving_files(v, e, f"{root}/in")
    ST.stream_dedup_content(s, f"{root}/data", f"{root}/log", late="10 days").awaitTermination()
    return v.spark.read.parquet(f"{root}/data").select("content_hash", "ts_s", "seq")


@query("r02_stream_refresh", """
WITH f AS (SELECT sha256(lower(concat_ws(':', 'u' || (user_id % 25), event_type, floor(value)::bigint)))[1:24] AS fingerprint, event_id FROM events)
SELECT fingerprint, min(event_id) AS seq FROM f GROUP BY 1""")
def r02(v: Views):
    """Two refreshes of one stream into a ledger: the second, with a new log, replays everything and adds nothing."""
    key = F.lower(F.concat_ws(":", F.concat(F.lit("u"), F.col("user_id") % 25), "event_type", F.floor("value").cast("string")))
    s = _event_stream(v).select(F.substring(F.sha2(key, 256), 1, 24).alias("fingerprint"), F.col("event_id").alias("seq"))
    s = s.withColumn("signal_id", F.concat(F.lit("sig_"), "fingerprint"))
    root = shared_folder(v.spark, "refresh")
    for run in ("first", "again"):
        ST.stream_refresh(s, f"{root}/ledger", f"{root}/log-{run}").awaitTermination()
    return v.spark.read.parquet(f"{root}/ledger").select("fingerprint", "seq")


_r03 = """
WITH w AS (SELECT 'u' || (user_id % 25) AS place, unnest(range(0, 24)) AS k, floor(epoch(ts))::bigint // 3600 * 3600 AS h FROM events)
SELECT h - k*3600 AS window_start_s, place, count(*) AS n_events FROM w GROUP BY 1, 2"""


@query("r03_place_density", _r03)
def r03(v: Views):
    e = v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id") % 25).alias("place"))
    return ST.batch_place_density(e)


@query("r03_stream_density", _r03)
def r03s(v: Views):
    s = _event_stream(v).select("ts", F.concat(F.lit("u"), F.col("user_id") % 25).alias("place"))
    root = shared_folder(v.spark, "density")
    ST.stream_place_density(s, f"{root}/data", f"{root}/log").awaitTermination()
    return ST.current_density(v.spark.read.parquet(f"{root}/data"))
