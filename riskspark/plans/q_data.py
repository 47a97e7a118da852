"""Queries for validation, scalar rules, extraction, quality and ledger operators."""
from pyspark.sql import Window as W, functions as F

from riskspark.functions import metric_rules as M, text as T
from riskspark.functions.num import key9, rnd
from riskspark.operators import extract as X, quality as Q, validate as V
from riskspark.plans.oracle import clamp, cte, r, r9
from riskspark.plans.registry import query
from riskspark.session import stage
from riskspark.sources import ledger as L
from riskspark.sources.views import CONTEXTS, LABELS, Views

DEPT = ["institution_id", "department"]
CELL = [*DEPT, "academic_year"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


cte("v_read", f"""
SELECT rid, institution_id, label, ctx, document,
  [dec || '%', n::varchar, '~' || dec || '%', n || ' - ' || (n+7), dec || ' LPA', '1,' || lpad(n::varchar, 3, '0') || ' lakhs', 'TBD', '', 'approx ' || n, '2023-24'][(cents % 10 + 1)::int] AS raw_value
FROM (SELECT p_partkey AS rid, 'I' || p_size AS institution_id, cents, cents % 1000 AS n, (cents % 97) || '.' || (cents % 10) AS dec,
  {lst(LABELS)}[(p_partkey % {len(LABELS)} + 1)::int] || CASE WHEN p_partkey % 4 = 0 THEN ' - ' || replace(p_brand, '#', ' ') ELSE '' END AS label,
  {lst(CONTEXTS)}[(p_partkey // 7 % {len(CONTEXTS)} + 1)::int] AS ctx, 'doc_' || (p_partkey % 40) || '_report (2).xlsx' AS document
  FROM (SELECT *, floor(p_retailprice*100)::bigint AS cents FROM part))""")


def has_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def classify_sql(label: str) -> dict[str, str]:
    low = f"lower(trim({label}))"
    def case(i, default):
        return "CASE " + " ".join(f"WHEN regexp_matches({low}, {q(x[1])}) THEN {q(x[i])}" for x in M.METRIC_RULES) + f" ELSE {default} END"
    dom = "CASE " + " ".join(f"WHEN {has_any(low, ws)} THEN {q(d)}" for d, ws in M.DOMAIN_WORDS) + " ELSE 'general_institutional' END"
    slug = f"trim(regexp_replace({low}, '[^a-z0-9]+', '_', 'g'), '_')"
    unit = (f"CASE WHEN contains({label}, '%') OR {has_any(low, ['percent', 'rate', 'ratio'])} THEN '%' WHEN {has_any(low, ['lakh', 'inr', 'rs'])} THEN 'INR_Lakhs' "
            f"WHEN contains({low}, 'lpa') THEN 'LPA' WHEN {has_any(low, ['count', 'number', 'total'])} THEN 'count' END")
    pol = f"CASE WHEN {has_any(low, M.DOWN_WORDS)} THEN 'lower_is_better' WHEN {has_any(low, M.UP_WORDS)} THEN 'higher_is_better' ELSE 'neutral' END"
    return {"domain": case(0, dom), "metric_name": case(2, slug), "unit": case(3, unit), "polarity": case(4, pol)}


def parse_sql(raw: str) -> dict[str, str]:
    s = f"trim(coalesce({raw}, ''))"
    return {
        "value": f"try_cast(nullif(regexp_extract(replace({s}, ',', ''), '[-+]?\\d+(?:\\.\\d+)?'), '') AS double)",
        "is_ambiguous": f"({has_any(f'lower({s})', M.AMBIGUOUS)} OR (regexp_matches({s}, '^\\d+(?:\\.\\d+)?\\s*-\\s*\\d+(?:\\.\\d+)?%?$') AND NOT regexp_matches({s}, '^20\\d{{2}}\\s*-\\s*\\d{{2,4}}$')))",
        "unit": f"CASE WHEN contains({s}, '%') THEN '%' WHEN regexp_matches({s}, '\\blpa\\b', 'i') THEN 'LPA' WHEN regexp_matches({s}, '\\b(?:lakhs?|lacs?)\\b', 'i') THEN 'INR_Lakhs' END",
    }


def ctx_sql(t: str) -> dict[str, str]:
    return {
        "department": "CASE " + " ".join(f"WHEN regexp_matches({t}, {q(p)}, 'i') THEN {q(c)}" for p, c in M.DEPARTMENT_PATTERNS) + " END",
        "program": f"nullif(trim(regexp_extract({t}, {q(M.PROGRAM_PATTERN)}, 0, 'i')), '')",
        "time_period": f"nullif(trim(regexp_extract({t}, {q(M.PERIOD_PATTERN)}, 1, 'i')), '')",
        "academic_year": f"try_cast(regexp_extract({t}, {q(M.PERIOD_PATTERN)}, 1, 'i')[1:4] AS int)",
    }


def risk_sql(m: str, v: str, u: str, p: str) -> str:
    sh = f"(CASE WHEN {v} > 1 THEN {v} ELSE {v}*100.0::double END)"
    inn = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
    x = (f"CASE WHEN {m} = 'vacancy_rate' THEN (CASE WHEN {v} > 1 THEN {v}/100.0::double ELSE {v} END)*1.5::double WHEN {m} = 'placement_percentage' THEN (100.0::double-{v})/100.0::double "
         f"WHEN {m} IN {inn(M.FALLING_BASE_40)} THEN {sh}/40.0::double WHEN {m} IN {inn(M.RISING_BASE_60)} THEN (100.0::double-{sh})/60.0::double "
         f"WHEN {m} IN {inn(M.COUNT_BASE_25)} THEN {v}/25.0::double WHEN {p} = 'lower_is_better' AND {u} = '%' THEN {sh}/50.0::double "
         f"WHEN {p} = 'higher_is_better' AND {u} = '%' THEN (100.0::double-{sh})/100.0::double END")
    return f"CASE WHEN {v} IS NOT NULL AND ({x}) IS NOT NULL THEN {r(r9(clamp(x)), 3)} END"


_c, _p, _x = classify_sql("label"), parse_sql("raw_value"), ctx_sql("ctx")
cte("o_rsig", f"""
SELECT *, {risk_sql('metric_name', 'value', 'unit', 'polarity')} AS risk_contribution,
  sha256(lower(concat_ws(':', trim(institution_id), domain, metric_name, coalesce(academic_year::varchar, time_period, ''), coalesce(department, ''), location, trim(raw_value))))[1:24] AS fingerprint
FROM (SELECT rid, institution_id, label, raw_value, 'R' || rid AS location, document, {_p['value']} AS value, {_p['is_ambiguous']} AS is_ambiguous,
  {_c['domain']} AS domain, {_c['metric_name']} AS metric_name, coalesce({_p['unit']}, {_c['unit']}) AS unit, {_c['polarity']} AS polarity,
  {_x['department']} AS department, {_x['program']} AS program, {_x['time_period']} AS time_period, {_x['academic_year']} AS academic_year FROM v_read)""")


def reading_signals(v: Views):
    d = T.with_classification(v.readings(), "label").withColumn("_p", T.parse_numeric(F.col("raw_value")))
    d = T.with_context(d, "ctx").withColumns({
        "value": F.col("_p.value"), "is_ambiguous": F.col("_p.is_ambiguous"), "unit": F.coalesce("_p.unit", "unit"),
        "location": F.concat(F.lit("R"), F.col("rid")), "seq": F.col("rid")})
    d = d.withColumn("risk_contribution", T.risk_contribution(F.col("metric_name"), F.col("value"), F.col("unit"), F.col("polarity")))
    fp = T.fingerprint(F.col("institution_id"), F.col("domain"), F.col("metric_name"), F.col("academic_year"),
                       F.col("time_period"), F.col("department"), F.col("location"), F.col("raw_value"))
    return d.withColumn("fingerprint", fp).withColumn("signal_id", F.concat(F.lit("sig_"), F.col("fingerprint"))).drop("_p")


# ---- P ------------------------------------------------------------------------------------------
def failed_sql(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


_base = {"academic_year": "academic_year BETWEEN 2000 AND 2100"}


@query("p01_validate_admissions", f"""
WITH d AS (SELECT * REPLACE (sanctioned_intake - academic_year % 3 AS sanctioned_intake, vacancy_rate + (academic_year % 2)*0.02::double AS vacancy_rate) FROM v_adm)
SELECT institution_id, department, academic_year, {failed_sql({**_base, 'intake_positive': 'sanctioned_intake > 0', 'enrolled_range': 'enrolled_count >= 0', 'vacancy_range': 'vacancy_count >= 0',
 'rate_range': 'vacancy_rate BETWEEN 0 AND 1', 'enrolled_within_intake': 'enrolled_count <= sanctioned_intake', 'vacancy_matches': 'vacancy_count = sanctioned_intake - enrolled_count',
 'rate_matches': f"abs(vacancy_rate - {r('vacancy_count::double/nullif(sanctioned_intake, 0)', 4)}) <= 0.01"})} AS failed FROM d""")
def p01(v: Views):
    y = F.col("academic_year")
    d = v.admissions().withColumns({"sanctioned_intake": F.col("sanctioned_intake") - y % 3,
                                    "vacancy_rate": F.col("vacancy_rate") + (y % 2) * 0.02})
    return V.validate_admissions(d).select(*CELL, F.array_join("failed_rules", ",").alias("failed"))


@query("p02_validate_placements", f"""
WITH d AS (SELECT * REPLACE (eligible_students - (academic_year % 3)*40 AS eligible_students, max_salary_lpa - (academic_year % 4)*3 AS max_salary_lpa) FROM v_plc)
SELECT institution_id, department, academic_year, {failed_sql({**_base, 'graduation_year': 'graduation_year BETWEEN 2000 AND 2100', 'eligible_positive': 'eligible_students > 0', 'placed_range': 'placed_students >= 0',
 'percentage_range': 'placement_percentage BETWEEN 0 AND 100', 'salary_range': 'median_salary_lpa >= 0 AND max_salary_lpa >= 0', 'placed_within_eligible': 'placed_students <= eligible_students',
 'unplaced_matches': 'unplaced_count = eligible_students - placed_students', 'max_above_median': 'max_salary_lpa >= median_salary_lpa'})} AS failed FROM d""")
def p02(v: Views):
    y = F.col("academic_year")
    d = v.placements().withColumns({"eligible_students": F.col("eligible_students") - (y % 3) * 40,
                                    "max_salary_lpa": F.col("max_salary_lpa") - (y % 4) * 3})
    return V.validate_placements(d).select(*CELL, F.array_join("failed_rules", ",").alias("failed"))


@query("p03_validate_ranking", f"""
WITH d AS (SELECT * REPLACE (opening_rank - 5 AS opening_rank, percentile_cutoff*2.5::double AS percentile_cutoff) FROM v_cet)
SELECT institution_id, department, academic_year, {failed_sql({**_base, 'opening_rank': 'opening_rank >= 1', 'closing_rank': 'closing_rank >= 1', 'percentile_range': 'percentile_cutoff BETWEEN 0 AND 100'})} AS failed FROM d""")
def p03(v: Views):
    d = v.ranking().withColumns({"opening_rank": F.col("opening_rank") - 5, "percentile_cutoff": F.col("percentile_cutoff") * 2.5})
    return V.validate_ranking(d).select(*CELL, F.array_join("failed_rules", ",").alias("failed"))


@query("p04_payload_defaults", f"""
WITH d AS (SELECT institution_id, department, academic_year, CASE WHEN academic_year % 2 = 0 THEN sanctioned_intake END AS i, CASE WHEN academic_year % 3 <> 0 THEN enrolled_count END AS e FROM v_adm),
f AS (SELECT *, coalesce(i, 120) AS ii, coalesce(e, coalesce(i, 120)) AS ee FROM d),
a AS (SELECT institution_id, department, academic_year, ii AS sanctioned_intake, ee AS enrolled_count, greatest(0, ii-ee) AS vacancy_count, {r('greatest(0, ii-ee)::double/ii', 4)} AS vacancy_rate FROM f),
p0 AS (SELECT *, CASE WHEN academic_year % 3 <> 0 THEN placed_students ELSE 0 END AS pp FROM v_plc),
p AS (SELECT *, greatest(CASE WHEN academic_year % 2 = 0 THEN eligible_students ELSE greatest(100, pp) END, pp) AS el FROM p0),
c AS (SELECT institution_id, department, academic_year, CASE WHEN academic_year % 2 = 0 THEN opening_rank ELSE 1000 END AS o, CASE WHEN academic_year % 3 = 0 THEN closing_rank END AS cr FROM v_cet)
SELECT a.*, el AS eligible_students, {r('least(100.0::double, pp::double/el*100.0::double)', 2)} AS placement_percentage, median_salary_lpa*1.5::double AS max_salary_lpa,
  coalesce(cr, greatest(o, 5000)) AS closing_rank, greatest(1.0::double, least(99.9::double, {r('100.0::double - coalesce(cr, greatest(o, 5000))/1500.0::double', 2)})) AS percentile_cutoff
FROM a JOIN p USING (institution_id, department, academic_year) JOIN c USING (institution_id, department, academic_year)""")
def p04(v: Views):
    a, p, c = v.canonical()
    y = F.col("academic_year")
    none = lambda t="int": F.lit(None).cast(t)
    pa = a.select(*CELL, F.when(y % 2 == 0, F.col("sanctioned_intake")).alias("sanctioned_intake"),
                  F.when(y % 3 != 0, F.col("enrolled_count")).alias("enrolled_count"), none().alias("admitted_students"),
                  none().alias("vacancy_count"), none("double").alias("vacancy_rate"))
    pp = p.select(*CELL, none().alias("graduation_year"), F.when(y % 3 != 0, F.col("placed_students")).alias("placed_students"),
                  F.when(y % 2 == 0, F.col("eligible_students")).alias("eligible_students"),
                  none().alias("graduating_cohort_size"), none().alias("unplaced_count"),
                  none("double").alias("placement_percentage"), "median_salary_lpa",
                  none("double").alias("average_package_lpa"), none("double").alias("max_salary_lpa"))
    pc = c.select(*CELL, none("string").alias("quota_category"), F.when(y % 2 == 0, F.col("opening_rank")).alias("opening_rank"),
                  F.when(y % 3 == 0, F.col("closing_rank")).alias("closing_rank"), none("double").alias("percentile_cutoff"))
    return V.default_admissions(pa).join(
        V.default_placements(pp).select(*CELL, "eligible_students", "placement_percentage", "max_salary_lpa"), CELL).join(
        V.default_ranking(pc).select(*CELL, "closing_rank", "percentile_cutoff"), CELL)


@query("p05_classify_metrics", f"SELECT DISTINCT label, {', '.join(f'{e} AS {n}' for n, e in _c.items())} FROM v_read")
def p05(v: Views):
    return T.classify_metrics(v.readings())


@query("p06_parse_numeric", f"SELECT rid, {', '.join(f'{e} AS {n}' for n, e in _p.items())} FROM v_read")
def p06(v: Views):
    return v.readings().select("rid", T.parse_numeric(F.col("raw_value")).alias("_p")).select("rid", "_p.*")


@query("p07_risk_contribution", "SELECT rid, metric_name, value, unit, polarity, risk_contribution FROM o_rsig")
def p07(v: Views):
    return reading_signals(v).select("rid", "metric_name", "value", "unit", "polarity", "risk_contribution")


@query("p08_context", f"""SELECT rid, department, program, time_period, academic_year,
  concat_ws(',', CASE WHEN department IS NOT NULL THEN 'department' END, CASE WHEN program IS NOT NULL THEN 'program' END, CASE WHEN time_period IS NOT NULL THEN 'time_period' END) AS evidenced FROM o_rsig""")
def p08(v: Views):
    d = T.with_context(v.readings(), "ctx")
    return d.select("rid", "department", "program", "time_period", "academic_year",
                    F.array_join(F.array_sort(F.map_keys("context_evidence")), ",").alias("evidenced"))


_h = "trim(regexp_replace(lower(trim(header)), '[^a-z0-9_]+', '_', 'g'), '_')"


@query("p09_header_roles", f"""
WITH h AS (SELECT unnest(string_split(label || ' ' || ctx, ' ')) AS header FROM v_read)
SELECT header, CASE {' '.join(f"WHEN {_h} IN ({', '.join(q(n) for n in ns)}) THEN {q(role)}" for role, ns in M.HEADER_ROLES)} END AS role, count(*) AS n FROM h GROUP BY 1, 2""")
def p09(v: Views):
    h = v.readings().select(F.explode(F.split(F.concat_ws(" ", "label", "ctx"), " ")).alias("header"))
    return X.header_roles(h.groupBy("header").agg(F.count("*").alias("n")))


@query("p10_fingerprint", "SELECT rid, fingerprint, 'sig_' || fingerprint AS signal_id FROM o_rsig")
def p10(v: Views):
    return reading_signals(v).select("rid", "fingerprint", "signal_id")


@query("p11_content_hash", r"""SELECT doc_id, sha256(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS content_hash FROM documents""")
def p11(v: Views):
    return v.table("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def plain_sql(c: str) -> str:
    """Plain text of markup in check SQL; of the character references only those that the test pages hold."""
    for tag in T.ACTIVE_TAGS.split("|"):
        c = rf"regexp_replace({c}, '<{tag}\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    c = rf"regexp_replace(regexp_replace({c}, '<({T.ACTIVE_TAGS})\b[^>]*>', ' ', 'gi'), '<[^>]+>', ' ', 'g')"
    for ref, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        c = f"replace({c}, '{ref}', {char})"
    return rf"trim(regexp_replace(regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[\s\x{{00a0}}]+', ' ', 'g'))"


@query("p12_sanitize_text", f"SELECT page_id, {plain_sql('html')} AS content FROM pages")
def p12(v: Views):
    return v.table("pages").select("page_id", T.sanitize_text(F.col("html")).alias("content"))


cte("o_urls", """
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'ftp://files.example.com/' || page_id WHEN 1 THEN 'http://user:pw@example.com/' || page_id
  WHEN 2 THEN 'http://10.0.' || (page_id % 200) || '.7/x' WHEN 3 THEN 'https://localhost:8080/' WHEN 4 THEN 'http://192.168.1.' || (page_id % 250)
  WHEN 5 THEN 'http://db.internal/x' WHEN 6 THEN '' WHEN 7 THEN 'http://172.' || (page_id % 40) || '.0.1/a' ELSE url END AS url FROM pages""")


@query("p13_check_urls", r"""
WITH a AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS au FROM o_urls),
b AS (SELECT *, lower(regexp_replace(regexp_replace(au, '^.*@', ''), ':\d*$', '')) AS host FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$') THEN list_transform(string_split(host, '.'), lambda x: x::int) END AS o FROM b)
SELECT page_id, url, reason IS NULL AS allowed, coalesce(reason, 'ok') AS reason FROM (SELECT *, CASE WHEN url = '' THEN 'empty' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(au, '@') THEN 'credentials'
  WHEN host = '' THEN 'no_host' WHEN host IN ('localhost', 'metadata', '169.254.169.254', '0.0.0.0') OR host LIKE '%.local' OR host LIKE '%.internal' OR host LIKE '%.localhost' THEN 'restricted_host'
  WHEN o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254) THEN 'restricted_address' END AS reason FROM c)""")
def p13(v: Views):
    i, s = F.col("page_id"), lambda c: c.cast("string")
    u = (
        F.when(i % 10 == 0, F.concat(F.lit("ftp://files.example.com/"), s(i)))
        .when(i % 10 == 1, F.concat(F.lit("http://user:pw@example.com/"), s(i)))
        .when(i % 10 == 2, F.concat(F.lit("http://10.0."), s(i % 200), F.lit(".7/x"))).when(i % 10 == 3, "https://localhost:8080/")
        .when(i % 10 == 4, F.concat(F.lit("http://192.168.1."), s(i % 250))).when(i % 10 == 5, "http://db.internal/x")
        .when(i % 10 == 6, "").when(i % 10 == 7, F.concat(F.lit("http://172."), s(i % 40), F.lit(".0.1/a"))).otherwise(F.col("url")))
    return T.check_urls(v.table("pages").select("page_id", u.alias("url")))


@query("p15_humanize_source", r"""
WITH d AS (SELECT rid, document, coalesce(time_period, '') AS p, trim(regexp_replace(regexp_replace(trim(translate(regexp_replace(document, '\.(xlsx|xls|csv|pdf|docx|doc)', '', 'g'), '_', ' ')), '\s*\(\d+\)$', ''), '\s+', ' ', 'g')) AS n FROM o_rsig)
SELECT rid, CASE WHEN p <> '' AND NOT contains(n, p) THEN n || ' · ' || p ELSE n END AS source_name FROM d""")
def p15(v: Views):
    return reading_signals(v).select("rid", T.humanize_source(F.col("document"), F.col("time_period")).alias("source_name"))


TYPES = ["High School", "PUC / Junior College", "Engineering College", "Degree College", "University", "Polytechnic Institute", "Research-Centre", ""]
DOMS = ["k-12", "technical education", "nursing", "arts and commerce", "law", "health sciences"]
cte("o_types", f"SELECT p_partkey AS rid, {lst(TYPES)}[(p_size % {len(TYPES)} + 1)::int] AS t, {lst(DOMS)}[(p_partkey % {len(DOMS)} + 1)::int] AS d FROM part")


def _pick(xs, i):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))


@query("p16_institution_type", """
WITH x AS (SELECT rid, t, lower(t) AS l, lower(t) || ' ' || lower(d) AS b FROM o_types),
s AS (SELECT *, CASE WHEN contains(l, 'school') OR contains(b, 'k-12') OR contains(b, 'k12') THEN 'school' WHEN contains(l, 'puc') OR contains(l, 'junior college') THEN 'puc'
  WHEN contains(b, 'engineering') OR contains(b, 'technical') OR contains(b, 'polytechnic') THEN 'engineering'
  WHEN contains(b, 'med') OR contains(b, 'health') OR contains(b, 'dental') OR contains(b, 'nursing') OR contains(b, 'pharmacy') THEN 'medical'
  WHEN contains(l, 'university') THEN 'university' WHEN contains(l, 'college') OR contains(l, 'degree') THEN 'college'
  WHEN l <> '' THEN replace(replace(l, ' ', '_'), '-', '_') ELSE 'institution' END AS type_slug FROM x)
SELECT rid, type_slug, CASE type_slug WHEN 'school' THEN 'High School / K-12' WHEN 'puc' THEN 'Pre-University (PUC / Junior College)' WHEN 'engineering' THEN 'Engineering & Technical Institution'
  WHEN 'medical' THEN 'Medical & Health Sciences Institution' WHEN 'college' THEN 'Degree College' WHEN 'university' THEN 'University' ELSE CASE WHEN t <> '' THEN t ELSE 'Educational Institution' END END AS type_label FROM s""")
def p16(v: Views):
    d = v.table("part").select(F.col("p_partkey").alias("rid"), _pick(TYPES, F.col("p_size")).alias("institution_type"),
                               _pick(DOMS, F.col("p_partkey")).alias("academic_domain"))
    return V.institution_type(d).select("rid", "type_slug", "type_label")


CATS = ["educational_group_network", "Government_Public_Body", "single", "", "private_organization"]
ETYPES = ["university", "institute", "nonprofit_trust_society", ""]
EDU = ["University", "College Group", "school", "educational trust", "degree college", ""]


@query("p17_structural_archetype", f"""
WITH d AS (SELECT p_partkey AS rid, {lst(CATS)}[(p_partkey % {len(CATS)} + 1)::int] AS c, {lst(ETYPES)}[(p_size % {len(ETYPES)} + 1)::int] AS t, {lst(EDU)}[(p_partkey // 11 % {len(EDU)} + 1)::int] AS e FROM part)
SELECT rid, CASE WHEN lower(e) = 'university' OR t = 'university' THEN 'university' WHEN lower(c) IN ('educational_group_network', 'government_public_body', 'private_organization')
  OR t = 'nonprofit_trust_society' OR lower(e) IN ('college group', 'educational trust') THEN 'organization_group' ELSE 'institution' END AS archetype FROM d""")
def p17(v: Views):
    d = v.table("part").select(F.col("p_partkey").alias("rid"), _pick(CATS, F.col("p_partkey")).alias("entity_category"),
                               _pick(ETYPES, F.col("p_size")).alias("entity_type"),
                               _pick(EDU, F.floor(F.col("p_partkey") / 11)).alias("education_entity_type"))
    return V.structural_archetype(d).select("rid", "archetype")


def policies(v: Views):
    """Suppliers as users: by key they hold an organization, an institution or a department grant."""
    n, rg, s = v.table("nation"), v.table("region"), v.table("supplier")
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
    k = F.col("s_suppkey")
    d = s.join(n, s.s_nationkey == n.n_nationkey).join(rg, n.n_regionkey == rg.r_regionkey)
    return d.select(
        k.alias("user_id"), F.when(k % 3 == 0, "organization").when(k % 3 == 1, "institution").otherwise("department").alias("scope"),
        F.col("r_name").alias("organization_id"), F.col("n_name").alias("institution_id"),
        F.concat(F.lit(" "), F.lower(_pick(segs, k))).alias("department"))


@query("p18_apply_scope", """
WITH pol AS (SELECT s_suppkey AS user_id, s_suppkey % 3 AS k, r_name, n_name, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][(s_suppkey % 5 + 1)::int] AS seg
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rws AS (SELECT a.institution_id, department, academic_year, organization_id FROM v_adm a JOIN v_inst USING (institution_id))
SELECT DISTINCT user_id, institution_id, department, academic_year FROM pol JOIN rws ON (k = 0 AND organization_id = r_name) OR (k = 1 AND institution_id = n_name) OR (k = 2 AND institution_id = n_name AND upper(department) = seg)""")
def p18(v: Views):
    rows = v.admissions().select(*CELL).join(v.institutions().select("institution_id", "organization_id"), "institution_id")
    return V.apply_scope(rows, policies(v)).select("user_id", *CELL)


@query("p19_normalize", f"""
SELECT c_custkey, {r(r9(clamp('CASE WHEN x > 1 THEN x/100.0::double ELSE x END')), 3)} AS confidence, epoch(ts)::bigint AS ts_s FROM (
  SELECT c_custkey, c_acctbal/50.0::double AS x, CASE WHEN c_custkey % 5 <> 0 THEN make_timestamp(2024, (c_custkey % 12 + 1)::bigint, (c_custkey % 28 + 1)::bigint, 10, 30, 0.0) END AS ts FROM customer)""")
def p19(v: Views):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.when(k % 5 == 0, "not a time").otherwise(F.concat(F.lit("2024-"), two(k % 12 + 1), F.lit("-"), two(k % 28 + 1), F.lit("T10:30:00Z")))
    return v.table("customer").select("c_custkey", T.normalize_confidence(F.col("c_acctbal") / 50.0).alias("confidence"),
                                      F.unix_timestamp(T.parse_ts(s)).alias("ts_s"))


# ---- X ------------------------------------------------------------------------------------------
def _numbered(a):
    return a.withColumn("row", F.row_number().over(W.partitionBy("institution_id").orderBy("academic_year", "department")) + 1)


def _cells(rows, headers: list[str], values: list):
    """Cell table of one sheet per institution: a header row and one row per record."""
    item = lambda i, t: F.struct(F.lit(i + 1).alias("col"), t.cast("string").alias("text"))
    body = rows.select(F.col("institution_id").alias("doc"), "row", F.inline(F.array(*[item(i, x) for i, x in enumerate(values)])))
    head = rows.select(F.col("institution_id").alias("doc"), F.lit(1).alias("row")).distinct().select(
        "doc", "row", F.inline(F.array(*[item(i, F.lit(h)) for i, h in enumerate(headers)])))
    return head.unionByName(body).withColumn("sheet", F.lit("Sheet1"))


_SIG = ["doc", "domain", "metric_name", "value", "unit", "polarity", "risk_contribution", "department", "academic_year", "location", "confidence"]
cte("o_rows", "SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY academic_year, department) + 1 AS rw FROM v_adm")


@query("x01_long_table", f"""
SELECT institution_id AS doc, 'finance' AS domain, 'sanctioned_intake' AS metric_name, sanctioned_intake::double AS value, 'seats' AS unit, 'neutral' AS polarity, NULL::double AS risk_contribution, department,
  academic_year, 'Sheet1!R' || rw || 'C4' AS location, CASE WHEN academic_year % 2 = 0 THEN 0.82 ELSE 0.96 END::double AS confidence FROM o_rows""")
def x01(v: Views):
    rows = _numbered(v.admissions())
    val = F.concat(F.when(F.col("academic_year") % 2 == 0, "~").otherwise(""), F.col("sanctioned_intake").cast("string"))
    c = _cells(rows, ["Dept", "Year", "Metric", "Value", "Unit", "Domain"],
               [F.col("department"), F.col("academic_year"), F.lit("Sanctioned Intake"), val, F.lit("seats"), F.lit("Finance ")])
    return X.extract_long_table(X.tabulate(c)).select(*_SIG)


@query("x02_key_value_table", f"""
SELECT institution_id AS doc, 'admissions' AS domain, 'vacancy_rate' AS metric_name, vacancy_rate AS value, 'ratio' AS unit, 'lower_is_better' AS polarity, {r(r9('least(1.0::double, vacancy_rate*1.5::double)'), 3)} AS risk_contribution,
  CASE WHEN academic_year % 2 = 0 THEN 'CSE' END AS department, academic_year, 'Sheet1!R' || rw || 'C2' AS location, 0.95::double AS confidence FROM o_rows""")
def x02(v: Views):
    rows = _numbered(v.admissions())
    lab = F.concat(F.lit("Seat vacancy AY "), F.col("academic_year"), F.when(F.col("academic_year") % 2 == 0, " CSE").otherwise(""))
    c = _cells(rows, ["Item", "Reading"], [lab, F.col("vacancy_rate").cast("decimal(6,4)")])
    return X.extract_key_value_table(X.tabulate(c)).select(*_SIG)


@query("x03_wide_table", f"""
SELECT institution_id AS doc, 'admissions' AS domain, 'vacancy_rate' AS metric_name, {r('vacancy_rate*100', 2)} AS value, '%' AS unit, 'lower_is_better' AS polarity,
  {r(r9(f"least(1.0::double, (CASE WHEN {r('vacancy_rate*100', 2)} > 1 THEN {r('vacancy_rate*100', 2)}/100.0::double ELSE {r('vacancy_rate*100', 2)} END)*1.5::double)"), 3)} AS risk_contribution,
  department, academic_year, 'Sheet1!R' || rw || 'C3' AS location, 0.96::double AS confidence FROM o_rows
UNION ALL SELECT institution_id, 'admissions', 'sanctioned_intake', sanctioned_intake::double, 'count', 'neutral', NULL, department, academic_year, 'Sheet1!R' || rw || 'C4', 0.80::double FROM o_rows WHERE academic_year % 3 <> 0""")
def x03(v: Views):
    return X.extract_wide_table(X.tabulate(_wide(v))).select(*_SIG)


def _wide(v: Views):
    rows = _numbered(v.admissions())
    pct = F.concat(rnd(F.col("vacancy_rate") * 100, 2).cast("decimal(8,2)").cast("string"), F.lit("%"))
    cap = F.when(F.col("academic_year") % 3 == 0, "").otherwise(F.concat(F.lit("about "), F.col("sanctioned_intake").cast("string")))
    return _cells(rows, ["Department", "Academic Year", "Seat Vacancy", "Sanctioned Intake"],
                  [F.col("department"), F.col("academic_year"), pct, cap])


@query("x03_table_issues", """
SELECT institution_id AS doc, 'Sanctioned Intake' AS affected_metric, CASE WHEN academic_year % 3 = 0 THEN 'incomplete_coverage' ELSE 'ambiguous_values' END AS issue_type,
  CASE WHEN academic_year % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'Sheet1!R' || rw || 'C4' AS location FROM o_rows""")
def x03i(v: Views):
    return X.table_issues(X.tabulate(_wide(v))).drop("sheet")


cte("v_lines", """SELECT institution_id AS doc, rid AS line_no, ctx, CASE rid % 3 WHEN 0 THEN '- ' || replace(label, ' - ', ' / ') || ': ' || raw_value
  WHEN 1 THEN '| ' || label || ' | ' || raw_value || ' |' ELSE 'In AY 2022 the reported ' || lower(label) || ' reached ' || raw_value || ' overall' END AS text FROM v_read""")
_lc, _lp, _lx = classify_sql("label"), parse_sql("raw_value"), ctx_sql("(ctx || ' ' || text)")


def line_sql(src: str, where: str) -> str:
    return f"""SELECT doc, line_no, domain, metric_name, value, unit, polarity, {risk_sql('metric_name', 'value', 'unit', 'polarity')} AS risk_contribution, department, academic_year, confidence
FROM (SELECT doc, line_no, {_lc['domain']} AS domain, {_lc['metric_name']} AS metric_name, {_lp['value']} AS value, coalesce({_lp['unit']}, {_lc['unit']}) AS unit, {_lc['polarity']} AS polarity,
 {_lx['department']} AS department, {_lx['academic_year']} AS academic_year, {r(f"0.90::double - CASE WHEN {_lp['is_ambiguous']} THEN 0.10 ELSE 0.0 END::double", 2)} AS confidence FROM {src} WHERE {where})"""


cte("o_pipe", "SELECT doc, line_no, ctx, trim(text) AS text, trim(string_split(trim(text, '|'), '|')[1]) AS label, trim(string_split(trim(text, '|'), '|')[2]) AS raw_value FROM v_lines WHERE text LIKE '| %'")
_kv = q(M.KEY_VALUE_PATTERN)
cte("o_kv", f"""SELECT doc, line_no, ctx, trim(text) AS text, trim(regexp_extract(trim(text), {_kv}, 1)) AS label, trim(regexp_extract(trim(text), {_kv}, 2)) AS raw_value FROM v_lines
WHERE (text NOT LIKE '| %' OR {parse_sql("trim(string_split(trim(text, '|'), '|')[2])")['value']} IS NULL) AND regexp_matches(trim(text), {_kv})""")
_LS = ["doc", "line_no", "domain", "metric_name", "value", "unit", "polarity", "risk_contribution", "department", "academic_year", "confidence"]


def _line_out(d):
    return d.withColumn("line_no", F.regexp_extract("location", r"\d+", 0).cast("bigint")).select(*_LS)


@query("x04_pipe_rows", line_sql("o_pipe", f"raw_value <> '' AND {_lp['value']} IS NOT NULL"))
def x04(v: Views):
    return _line_out(X.extract_pipe_rows(stage(X.classify_lines(v.lines()))))


@query("x05_key_value_lines", line_sql("o_kv", f"lower(label) NOT IN ({', '.join(q(x) for x in M.CONTEXT_LABELS)}) AND ({_lp['value']} IS NOT NULL OR {_lp['is_ambiguous']})"))
def x05(v: Views):
    return _line_out(X.extract_key_value_lines(stage(X.classify_lines(v.lines()))))


@query("x06_prose_metrics")
def x06(v: Views):
    return _line_out(X.extract_prose_metrics(stage(X.classify_lines(v.lines()))))


cte("o_long", f"""
SELECT institution_id, department, academic_year, 'admissions' AS domain, 'sanctioned_intake' AS metric_name, sanctioned_intake::double AS value, 'count' AS unit, 'neutral' AS polarity, NULL::double AS risk_contribution FROM v_adm
UNION ALL SELECT institution_id, department, academic_year, 'admissions', 'admitted_students', enrolled_count::double, 'count', 'higher_is_better', NULL FROM v_adm
UNION ALL SELECT institution_id, department, academic_year, 'admissions', 'vacancy_rate', vacancy_rate, 'ratio', 'lower_is_better', {r('least(1.0::double, vacancy_rate*1.5::double)', 3)} FROM v_adm
UNION ALL SELECT institution_id, department, academic_year, 'placements', 'placement_percentage', placement_percentage, '%', 'higher_is_better', {r('greatest(0.0::double, least(1.0::double, (100.0::double-placement_percentage)/100.0::double))', 3)} FROM v_plc
UNION ALL SELECT institution_id, department, academic_year, 'ranking', 'closing_rank', closing_rank::double, 'rank', 'lower_is_better', NULL FROM v_cet""")


@query("x07_canonical_to_long", "SELECT * FROM o_long")
def x07(v: Views):
    return X.canonical_to_long(*v.canonical())


@query("x08_long_to_canonical", f"""
WITH a AS (SELECT *, {r('100*(1.0::double - vacancy_rate)', 0)}::int AS en FROM v_adm), p AS (SELECT *, {r('100*(placement_percentage/100.0::double)', 0)}::int AS pl FROM v_plc)
SELECT a.institution_id, a.department, a.academic_year, 100 AS sanctioned_intake, en AS enrolled_count, {r('(100-en)/100.0::double', 4)} AS vacancy_rate, pl AS placed_students,
  {r('pl/100.0::double*100.0::double', 2)} AS placement_percentage, least(greatest(1, closing_rank//2), closing_rank) AS opening_rank, closing_rank, true AS is_imputed
FROM a JOIN p USING (institution_id, department, academic_year) JOIN v_cet USING (institution_id, department, academic_year)""")
def x08(v: Views):
    """Bridge of the ratio metrics only, so intake and cohort take their defaults."""
    s = X.canonical_to_long(*v.canonical()).where(F.col("metric_name").isin("vacancy_rate", "placement_percentage", "closing_rank"))
    s = stage(s.withColumn("seq", F.lit(1)))
    a, p, c = X.long_to_admissions(s), X.long_to_placements(s), X.long_to_ranking(s)
    return a.where("sanctioned_intake IS NOT NULL").join(p.drop("is_imputed"), CELL).join(c.drop("is_imputed"), CELL).select(
        *CELL, "sanctioned_intake", "enrolled_count", "vacancy_rate", "placed_students", "placement_percentage",
        "opening_rank", "closing_rank", "is_imputed")


@query("x09_year_blocks", f"""
SELECT institution_id, department, academic_year, sanctioned_intake, enrolled_count, sanctioned_intake - enrolled_count AS vacancy_count,
  {r('(sanctioned_intake - enrolled_count)::double/sanctioned_intake', 4)} AS vacancy_rate FROM v_adm WHERE enrolled_count > 0""")
def x09(v: Views):
    """Sheets with one banner row per year followed by one row per department, then parsed back."""
    a = v.admissions()
    w = W.partitionBy("institution_id").orderBy("academic_year", "department")
    pos = F.row_number().over(w) + F.dense_rank().over(W.partitionBy("institution_id").orderBy("academic_year"))
    body = a.withColumn("row", pos)
    ban = body.groupBy("institution_id", "academic_year").agg((F.min("row") - 1).alias("row")).select(
        F.col("institution_id").alias("doc"), "row", F.lit(1).alias("col"),
        F.concat(F.lit("DATA "), F.col("academic_year")).alias("text"))
    item = lambda i, t: F.struct(F.lit(i).alias("col"), t.cast("string").alias("text"))
    cells = body.select(F.col("institution_id").alias("doc"), "row", F.inline(F.array(
        item(2, F.col("department")), item(3, F.col("institution_id")), item(5, F.col("sanctioned_intake")),
        item(6, F.lit(None)), item(8, F.col("enrolled_count")))))
    return X.blocks_to_admissions(X.extract_year_blocks(ban.unionByName(cells).withColumn("sheet", F.lit("Sheet1"))))


@query("x10_ocr_noise", r"""SELECT doc_id, n AS has_noise, CASE WHEN n THEN 0.72 ELSE 0.91 END::double AS base_confidence, CASE WHEN n THEN 'ocr_uncertainty' END AS issue_type
FROM (SELECT doc_id, regexp_matches(text, '(\?\?\?|\[ocr_low_conf\]|\[illegible\]|\x{FFFD})', 'i') AS n FROM documents)""")
def x10(v: Views):
    return X.flag_ocr_noise(v.table("documents")).select("doc_id", "has_noise", "base_confidence", "issue_type")


# ---- Q ------------------------------------------------------------------------------------------
@query("q01_undated_signals", """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY rid) AS rn FROM o_rsig WHERE time_period IS NULL AND academic_year IS NULL)
SELECT institution_id, 'missing_periods' AS issue_type, 'MEDIUM' AS severity, count(*) AS n_undated, string_agg(location, ',' ORDER BY rid) FILTER (rn <= 5) AS refs FROM u GROUP BY 1""")
def q01(v: Views):
    named = F.when(F.exists("refs", lambda x: x.isNotNull()), F.array_join("refs", ","))
    return Q.undated_signals(reading_signals(v)).withColumn("refs", named)


@query("q01_undated_locations", "SELECT institution_id, rid AS seq, location FROM o_rsig WHERE time_period IS NULL AND academic_year IS NULL")
def q01_locations(v: Views):
    return Q.undated_locations(reading_signals(v))


def customer_years(v: Views):
    """Customers as institutions with one observation per order, so histories have gaps and stale ends."""
    return v.table("orders").select(F.col("o_custkey").alias("institution_id"), F.year("o_orderdate").alias("academic_year"))


@query("q02_year_gaps", """
WITH y AS (SELECT DISTINCT o_custkey AS i, year(o_orderdate) AS y FROM orders), s AS (SELECT i, unnest(range(min(y), max(y)+1)) AS y FROM y GROUP BY 1)
SELECT i AS institution_id, 'missing_periods' AS issue_type, y AS missing_year FROM s ANTI JOIN y USING (i, y)""")
def q02(v: Views):
    return Q.year_gaps(customer_years(v))


@query("q03_outdated", """SELECT o_custkey AS institution_id, 'outdated_data' AS issue_type, max(year(o_orderdate)) AS latest_year, 2003 - max(year(o_orderdate)) AS years_behind FROM orders GROUP BY 1 HAVING max(year(o_orderdate)) <= 2000""")
def q03(v: Views):
    return Q.outdated(customer_years(v), 2003)


@query("q04_single_domain", """
WITH s AS (SELECT l_orderkey AS i, CASE l_returnflag WHEN 'R' THEN 'finance' WHEN 'A' THEN 'placements' ELSE 'admissions' END AS d FROM lineitem)
SELECT i AS institution_id, 'incomplete_coverage' AS issue_type, min(d) AS affected_domain FROM s GROUP BY 1 HAVING count(DISTINCT d) = 1""")
def q04(v: Views):
    f = F.col("l_returnflag")
    return Q.single_domain(v.table("lineitem").select(
        F.col("l_orderkey").alias("institution_id"),
        F.when(f == "R", "finance").when(f == "A", "placements").otherwise("admissions").alias("domain")))


BK = "institution_id, department, program, period, metric_name"
cte("o_bk", "SELECT * EXCLUDE (program), 'ALL' AS program, academic_year::varchar AS period, printf('%.4f', value) AS val_repr FROM v_dup")
cte("o_vg", f"SELECT {BK}, val_repr, count(*) AS n, count(*) FILTER (is_new) AS n_new, min(domain) AS domain FROM o_bk GROUP BY {BK}, val_repr")


def _buckets(v: Views):
    b = Q.bucketed(v.signals_dup())
    return b, Q.value_groups(b)


@query("q05_duplicates", f"""
SELECT {BK}, val_repr, 'duplicates' AS issue_type, 'LOW' AS severity, n AS n_observations, n_new FROM o_vg
WHERE n >= 2 AND ({BK}) IN (SELECT ({BK}) FROM o_vg GROUP BY {BK} HAVING sum(n_new) > 0)""")
def q05(v: Views):
    _, g = _buckets(v)
    return Q.duplicate_issues(g)


@query("q05_flagged_rows", f"SELECT signal_id, n >= 2 AS is_duplicate FROM o_bk JOIN o_vg USING ({BK}, val_repr) WHERE is_new")
def q05f(v: Views):
    return Q.flag_duplicates(*_buckets(v)).select("signal_id", "is_duplicate")


_gid = "'contra_' || sha256(concat_ws('|', institution_id, department, program, period, metric_name))[1:10]"


@query("q06_contradictions", f"""
SELECT {BK}, count(*) AS n_values, sum(n)::bigint AS n_observations, min(domain) AS domain, min(val_repr) AS first_value, max(val_repr) AS last_value, 'contradictory_sources' AS issue_type, 'HIGH' AS severity,
  {_gid} AS contradiction_group_id FROM o_vg GROUP BY {BK} HAVING count(*) >= 2 AND sum(n_new) > 0""")
def q06(v: Views):
    _, g = _buckets(v)
    return Q.contradiction_issues(g)


@query("q06_contradiction_values", f"""
SELECT g AS contradiction_group_id, {BK}, signal_id, val_repr, value, raw_value, unit, ingestion_id, location, confidence
FROM o_bk JOIN (SELECT {BK}, {_gid} AS g FROM o_vg GROUP BY {BK} HAVING count(*) >= 2 AND sum(n_new) > 0) USING ({BK})""")
def q06v(v: Views):
    return Q.contradiction_values(*_buckets(v))


@query("q06_flagged_rows", f"""
SELECT signal_id, g IS NOT NULL AS is_contradictory, g AS contradiction_group_id FROM o_bk LEFT JOIN (SELECT {BK}, {_gid} AS g FROM o_vg GROUP BY {BK} HAVING count(*) >= 2 AND sum(n_new) > 0) USING ({BK})""")
def q06f(v: Views):
    return Q.flag_contradictions(*_buckets(v)).select("signal_id", "is_contradictory", "contradiction_group_id")


@query("q08_quality_report", f"""
WITH t AS (SELECT {BK}, count(*) >= 2 AND sum(n_new) > 0 AS contra, sum(n_new) > 0 AS touched FROM o_vg GROUP BY {BK}),
s AS (SELECT institution_id, count(*) AS n_signals, count(*) FILTER (contra) AS n_contradictory, count(*) FILTER (is_new AND n >= 2) AS n_duplicate, count(DISTINCT b.domain) AS n_domains FROM o_bk b JOIN o_vg USING ({BK}, val_repr) JOIN t USING ({BK}) GROUP BY 1),
i AS (SELECT institution_id, count(*) AS n_issues FROM (SELECT institution_id FROM o_vg JOIN t USING ({BK}) WHERE n >= 2 AND touched UNION ALL SELECT institution_id FROM t WHERE contra) GROUP BY 1),
c AS (SELECT institution_id, count(*) AS n_snapshots FROM v_adm GROUP BY 1)
SELECT institution_id, coalesce(n_snapshots, 0) AS n_snapshots, coalesce(n_signals, 0) AS n_signals, coalesce(n_contradictory, 0) AS n_contradictory, coalesce(n_duplicate, 0) AS n_duplicate,
  coalesce(n_domains, 0) AS n_domains, coalesce(n_issues, 0) AS n_issues FROM s FULL JOIN c USING (institution_id) FULL JOIN i USING (institution_id)""")
def q08(v: Views):
    b, g = _buckets(v)
    dup = g.where("n >= 2").select(*Q.BUCKET, "val_repr", F.lit(True).alias("_d"))
    sig = Q.flag_contradictions(b, g).join(dup, [*Q.BUCKET, "val_repr"], "left").withColumn(
        "is_duplicate", F.col("is_new") & F.coalesce("_d", F.lit(False)))
    issues = Q.duplicate_issues(g).select("institution_id").unionByName(Q.contradiction_issues(g).select("institution_id"))
    return Q.quality_report(sig, v.admissions(), issues)


@query("q09_list_datasets", """
WITH p AS (SELECT institution_id, ingestion_id, count(*) AS total_signals, count(DISTINCT domain) AS n_domains, string_agg(DISTINCT academic_year::varchar, ',' ORDER BY academic_year::varchar) AS periods, max(ts) AS m FROM v_dup GROUP BY 1, 2),
s AS (SELECT institution_id, 'ing_3' AS sel FROM v_inst WHERE inst_no % 2 = 0), n AS (SELECT institution_id, arg_max(ingestion_id, struct_pack(a := m, b := ingestion_id)) AS nw FROM p GROUP BY 1)
SELECT institution_id, ingestion_id, total_signals, n_domains, periods, ingestion_id = coalesce(sel, nw) AS is_active FROM p JOIN n USING (institution_id) LEFT JOIN s USING (institution_id)""")
def q09(v: Views):
    sel = v.institutions().where("inst_no % 2 = 0").select("institution_id", F.lit("ing_3").alias("selected_id"))
    return Q.list_datasets(v.signals_dup(), sel)


@query("q10_ingestion_stats", f"""SELECT ingestion_id, count(*) AS n_signals, count(department) AS n_department, count(academic_year) AS n_period, {r(r9('avg(confidence)'), 3)} AS mean_confidence, count(DISTINCT domain) AS n_domains FROM v_dup GROUP BY 1""")
def q10(v: Views):
    return Q.ingestion_stats(v.signals_dup())


# ---- S13-S20 ------------------------------------------------------------------------------------
@query("s13_read_ledger", f"""SELECT signal_id, institution_id, domain, academic_year, value FROM o_bk WHERE domain = 'finance' AND ({BK}) IN (SELECT ({BK}) FROM o_vg GROUP BY {BK} HAVING count(*) >= 2 AND sum(n_new) > 0)""")
def s13(v: Views):
    d = Q.flag_contradictions(*_buckets(v))
    return L.read_ledger(d, domain="finance", contradictory_only=True, order=["institution_id", "academic_year", "seq"]).select(
        "signal_id", "institution_id", "domain", "academic_year", "value")


@query("s14_search", """SELECT event_id, severity, source_id FROM v_evt WHERE severity = 'HIGH' AND (contains(lower(title), 'the') OR contains(lower(description), 'tion') OR contains(lower(country), 'the') OR contains(lower(city), 'the'))""")
def s14(v: Views):
    e = v.events().withColumn("aliases", F.array("country", "city"))
    hits = L.search(e, "the", ["title"], {"severity": "HIGH"}, ["aliases"])
    more = L.search(e, "TION", ["description"], {"severity": "HIGH"})
    return hits.unionByName(more).select("event_id", "severity", "source_id").distinct()


def _snapshots(v: Views):
    return v._order_slots().select("institution_id", "department", "academic_year", F.lit("admissions").alias("signal_type"),
                                   F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("payload"), "o_orderstatus")


@query("s15_merge_snapshots", """
SELECT institution_id, department, academic_year, 'admissions' AS signal_type, o_orderkey AS seq, o_totalprice AS payload FROM v_slots
QUALIFY row_number() OVER (PARTITION BY institution_id, department, academic_year ORDER BY (o_orderstatus <> 'F')::int DESC, o_orderkey DESC) = 1""")
def s15(v: Views):
    d = _snapshots(v)
    old, new = d.where("o_orderstatus = 'F'").drop("o_orderstatus"), d.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return L.merge_snapshots(old, new)


cte("o_fp", """SELECT *, sha256(lower(concat_ws(':', institution_id, domain, metric_name, academic_year::varchar, department, '', raw_value)))[1:24] AS fingerprint FROM v_dup""")


@query("s16_append_signals", """
SELECT fingerprint, min(seq) AS seq FROM o_fp WHERE is_new AND fingerprint NOT IN (SELECT fingerprint FROM o_fp WHERE NOT is_new) GROUP BY 1""")
def s16(v: Views):
    d = v.signals_dup()
    fp = T.fingerprint(F.col("institution_id"), F.col("domain"), F.col("metric_name"), F.col("academic_year"),
                       F.lit(None).cast("string"), F.col("department"), F.lit(""), F.col("raw_value"))
    d = d.withColumn("fingerprint", fp).withColumn("signal_id", F.concat(F.lit("sig_"), F.col("fingerprint")))
    return L.append_signals(d.where("NOT is_new"), d.where("is_new")).select("fingerprint", "seq")


@query("s17_merge_by_id", """
SELECT origin_hash, arrival AS seq, title, severity, status FROM v_evt QUALIFY row_number() OVER (PARTITION BY origin_hash ORDER BY (status = 'RESOLVED')::int DESC, arrival DESC) = 1""")
def s17(v: Views):
    e = v.events().select("origin_hash", F.col("arrival").alias("seq"), "title", "severity", "status")
    return L.merge_by_id(e.where("status = 'ACTIVE'"), e.where("status = 'RESOLVED'"), ["origin_hash"])


@query("s18_merge_memory", """
WITH m AS (SELECT institution_id || ':' || domain || ':' || department AS memory_id, * FROM v_dup),
o AS (SELECT * FROM m WHERE NOT is_new QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) = 1),
n AS (SELECT * FROM m WHERE is_new QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) = 1)
SELECT memory_id, coalesce(o.metric_label, n.metric_label) AS category, coalesce(o.seq, n.seq) AS created_at, coalesce(n.raw_value, o.raw_value) AS statement, coalesce(n.confidence, o.confidence) AS confidence
FROM o FULL JOIN n USING (memory_id)""")
def s18(v: Views):
    m = v.signals_dup().select(
        F.concat_ws(":", "institution_id", "domain", "department").alias("memory_id"), "institution_id",
        F.col("metric_label").alias("category"), F.col("seq").alias("created_at"), F.col("raw_value").alias("statement"),
        "confidence", F.array("location").alias("evidence_refs"), F.lit("{}").alias("payload"), "seq", "is_new")
    old = L.newest_per_key(m.where("NOT is_new").drop("is_new"), ["memory_id"])
    return L.merge_memory(old, m.where("is_new").drop("is_new")).select("memory_id", "category", "created_at", "statement", "confidence")


@query("s19_delete_dataset", """
WITH l AS (SELECT * FROM v_dup WHERE ingestion_id NOT IN ('ing_2', 'ing_5')), g AS (SELECT institution_id, ingestion_id, min(ts) AS c FROM l GROUP BY 1, 2)
SELECT institution_id, n AS n_signals, a AS active_id FROM (SELECT institution_id, count(*) AS n FROM l GROUP BY 1) JOIN (SELECT institution_id, arg_max(ingestion_id, struct_pack(c := c, i := ingestion_id)) AS a FROM g GROUP BY 1) USING (institution_id)""")
def s19(v: Views):
    from riskspark.plans.q_risk import ingestions
    gone = v.signals_dup().where(F.col("ingestion_id").isin("ing_2", "ing_5")).select("ingestion_id").distinct()
    snaps = v.admissions().withColumn("provenance_id", F.concat(F.lit("ing_"), (F.col("academic_year") % 7).cast("string")))
    sig, _, active = L.delete_dataset(v.signals_dup(), snaps, ingestions(v), gone)
    return sig.groupBy("institution_id").agg(F.count("*").alias("n_signals")).join(active, "institution_id")


@query("s20_drop_seen_content", """
WITH d AS (SELECT source, doc_id, sha256(text) AS h FROM documents), s AS (SELECT DISTINCT source, h FROM d JOIN labels USING (doc_id))
SELECT source AS institution_id, h AS content_hash, min(doc_id) AS seq FROM d ANTI JOIN s USING (source, h) GROUP BY 1, 2""")
def s20(v: Views):
    d = v.table("documents").select(F.col("source").alias("institution_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    seen = d.join(v.table("labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi").select(
        "institution_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return L.drop_seen_content(d, seen).select("institution_id", "content_hash", "seq")
