"""Queries for baselines, anomaly evaluation, findings, deltas and backtests."""
from pyspark.sql import functions as F

from riskspark.functions.num import rnd
from riskspark.functions.rules import DEFAULT_DOMAIN_WEIGHT, DOMAIN_WEIGHT, RELATED_DOMAINS
from riskspark.operators import baseline as B, forecast as T, intel as I, risk as R
from riskspark.plans.oracle import clamp, clone, cte, r, r9
from riskspark.plans.q_risk import CORE_DEPTS, DRIFT, _plain, pct_sql
from riskspark.plans.registry import query
from riskspark.session import stage
from riskspark.sources.views import Views

SK = "institution_id, domain, metric_name, dept_key"

cte("v_full", f"""
SELECT institution_id, domain, metric_name, metric_label, department, academic_year, value, unit, polarity,
  risk_contribution, is_contradictory, is_duplicate, confidence, seq, document FROM v_sig
UNION ALL
SELECT institution_id, 'admissions', 'vacancy_rate', 'Seat vacancy', department, academic_year, val, 'ratio',
  'lower_is_better', least(1.0::double, val*1.5::double), false, false, 0.90::double, -1, 'doc_admissions'
FROM (SELECT *, {r('vacancy_rate', 1)} AS val FROM v_adm)""")

cte("o_canon", """
SELECT institution_id, 'admissions' AS domain, 'enrolled_count' AS metric_name, 'Enrolled Students' AS metric_label, department, academic_year,
  enrolled_count::double AS value, 'count' AS unit, 'higher_is_better' AS polarity, least(1.0::double, vacancy_rate*1.5::double) AS risk_contribution, 0 AS o FROM v_adm
UNION ALL SELECT institution_id, 'admissions', 'vacancy_rate', 'Seat Vacancy Rate', department, academic_year,
  vacancy_rate, 'ratio', 'lower_is_better', least(1.0::double, vacancy_rate*1.5::double), 1 FROM v_adm
UNION ALL SELECT institution_id, 'placements', 'placement_percentage', 'Placement Percentage', department, graduation_year,
  placement_percentage, '%', 'higher_is_better', greatest(0.0::double, least(1.0::double, (100.0::double-placement_percentage)/100.0::double)), 2 FROM v_plc
UNION ALL SELECT institution_id, 'ranking', 'closing_rank', 'Entrance Closing Rank', department, academic_year,
  closing_rank::double, 'rank', 'lower_is_better', NULL, 3 FROM v_cet""")

cte("o_uni", f"""
SELECT * FROM v_full UNION ALL
SELECT institution_id, domain, metric_name, metric_label, department, academic_year, value, unit, polarity, risk_contribution,
  false, false, 0.98::double, 1099511627776 + o, 'canonical_' || domain FROM o_canon c
WHERE NOT EXISTS (SELECT 1 FROM v_full f WHERE f.institution_id = c.institution_id AND f.domain = c.domain
  AND f.metric_name = c.metric_name AND upper(coalesce(f.department, 'INSTITUTIONAL')) = upper(coalesce(c.department, 'INSTITUTIONAL'))
  AND f.academic_year = c.academic_year AND {r('f.value', 4)} = {r('c.value', 4)})""")

cte("o_ser", f"""
SELECT institution_id, domain, metric_name, coalesce(department, '') AS dept_key, academic_year,
  arg_max(value, struct_pack(c := confidence, s := -seq)) AS rep_value, arg_min(value, seq) AS first_value,
  arg_max(value, seq) AS last_value, arg_max(struct_pack(x := risk_contribution), seq).x AS last_risk,
  bool_or(is_contradictory) OR max(value) - min(value) > 1e-4 AS has_conflict,
  arg_min(struct_pack(l := metric_label, u := unit, p := polarity), seq) AS attrs, min(seq) AS first_seq
FROM o_uni WHERE value IS NOT NULL AND NOT is_duplicate GROUP BY ALL""")

cte("o_base", f"""
SELECT {SK}, attrs.l AS metric_label, attrs.u AS unit, attrs.p AS polarity,
  CASE WHEN n >= 3 THEN 'ESTABLISHED' WHEN hc THEN 'CONTRADICTORY_HISTORY' WHEN n = 2 THEN 'TWO_PERIOD_COMPARISON_ONLY'
    ELSE 'INSUFFICIENT_HISTORY' END AS baseline_status, n::int AS n_years,
  CASE WHEN n >= 3 THEN {r(r9('m'), 4)} END AS baseline_mean, CASE WHEN n >= 3 THEN {r(r9('coalesce(sd, 0)'), 4)} END AS baseline_std,
  CASE WHEN n >= 3 THEN {r(r9('md'), 4)} END AS baseline_median, CASE WHEN n >= 3 THEN {r(r9('mn'), 4)} END AS baseline_min,
  CASE WHEN n >= 3 THEN {r(r9('mx'), 4)} END AS baseline_max, CASE WHEN n >= 2 THEN {r(r9('sl'), 4)} END AS trend_slope,
  ly AS latest_period, {r('lv', 4)} AS latest_value, CASE WHEN n >= 2 THEN py END AS prior_period,
  CASE WHEN n >= 2 THEN {r('pv', 4)} END AS prior_value, hc AS has_contradictions
FROM (SELECT {SK}, count(*) AS n, arg_min(attrs, first_seq) AS attrs, bool_or(has_conflict) AS hc,
    avg(rep_value) FILTER (rn > 1) AS m, stddev_samp(rep_value) FILTER (rn > 1) AS sd, median(rep_value) FILTER (rn > 1) AS md,
    min(rep_value) FILTER (rn > 1) AS mn, max(rep_value) FILTER (rn > 1) AS mx,
    CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope(rep_value, -rn) END AS sl,
    max(academic_year) AS ly, max(rep_value) FILTER (rn = 1) AS lv, max(rep_value) FILTER (rn = 2) AS pv,
    max(academic_year) FILTER (rn = 2) AS py
  FROM (SELECT *, row_number() OVER (PARTITION BY {SK} ORDER BY academic_year DESC) AS rn FROM o_ser) GROUP BY {SK})""")


def unfav_sql(o: str, n: str, pol: str, unit: str) -> str:
    d = f"({n}-{o})"
    return (f"CASE WHEN {o} IS NULL OR abs{d} < 1e-9 OR NOT (CASE {pol} WHEN 'higher_is_better' THEN {d} < 0 WHEN 'lower_is_better' THEN {d} > 0 ELSE false END) THEN 0.0 "
            f"WHEN coalesce({unit}, '') = 'ratio' AND abs({o}) <= 1 AND abs({n}) <= 1 THEN abs{d}*100.0 "
            f"WHEN abs({o}) < 1e-6 THEN CASE WHEN abs{d} <= 1 THEN abs{d}*100.0 ELSE abs{d} END ELSE abs{d}/abs({o})*100.0 END")


cte("o_cand", f"""
WITH st AS (SELECT *, row_number() OVER w AS pos, first_value - lag(first_value) OVER w AS d,
    row_number() OVER (PARTITION BY {SK} ORDER BY academic_year DESC) AS rn
  FROM o_ser JOIN (SELECT {SK}, polarity FROM o_base) USING ({SK}) WINDOW w AS (PARTITION BY {SK} ORDER BY academic_year)),
run AS (SELECT {SK}, (max(pos) - max(pos) FILTER (NOT coalesce(abs(d) >= 1e-9 AND CASE polarity WHEN 'higher_is_better' THEN d < 0 WHEN 'lower_is_better' THEN d > 0 ELSE false END, false)))::int AS streak,
    max(last_value) FILTER (rn = 1) AS observed_value, coalesce(max(last_risk) FILTER (rn = 1), 0.0) AS risk FROM st GROUP BY {SK}),
j AS (SELECT b.*, streak, observed_value, risk, coalesce(baseline_mean, prior_value) AS comparison_value,
    CASE WHEN baseline_mean IS NULL THEN NULL WHEN baseline_std > 1e-6 THEN {r(r9('(observed_value-baseline_mean)/baseline_std'), 2)}
      WHEN abs(observed_value-baseline_mean) > 1e-4 THEN CASE WHEN observed_value > baseline_mean THEN 3.0 ELSE -3.0 END ELSE 0.0 END::double AS zscore
  FROM o_base b JOIN run USING ({SK})),
k AS (SELECT *, {r9(unfav_sql('comparison_value', 'observed_value', 'polarity', 'unit'))} AS unfav_pct,
    {r('observed_value-comparison_value', 4)} AS absolute_delta, {r(r9(pct_sql('comparison_value', 'observed_value')), 2)} AS relative_pct_change,
    CASE WHEN (polarity = 'higher_is_better' AND zscore < 0) OR (polarity = 'lower_is_better' AND zscore > 0) THEN abs(zscore) ELSE 0.0 END::double AS unfav_z FROM j),
m AS (SELECT *, unfav_pct >= 10 OR unfav_z >= 1.8 OR {r9('risk')} >= .45 OR (streak >= 2 AND unfav_pct >= 5) AS is_meaningful,
    unfav_pct >= 4 OR unfav_z >= 1.0 OR {r9('risk')} >= .30 OR streak >= 1 AS is_notable FROM k)
SELECT *, greatest(streak, is_meaningful::int) AS persistence FROM m WHERE is_meaningful OR is_notable""")

_w = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DOMAIN_WEIGHT.items()) + f" ELSE {DEFAULT_DOMAIN_WEIGHT} END::double"
cte("o_scored", f"""
WITH nd AS (SELECT institution_id, count(DISTINCT dept_key) AS nd FROM o_ser WHERE dept_key <> '' GROUP BY 1),
iw AS (SELECT institution_id, department AS dept_key, arg_max(sanctioned_intake, academic_year) AS w FROM v_adm GROUP BY 1, 2),
tw AS (SELECT institution_id, sum(w)::double AS tw FROM iw GROUP BY 1),
hit AS (SELECT institution_id, domain, metric_name, count(*) AS hit FROM o_cand WHERE is_meaningful AND dept_key <> '' GROUP BY 1, 2, 3),
x AS (SELECT c.*, {r(r9('greatest(least(1.0::double, unfav_pct/35.0::double), risk)'), 3)} AS magnitude, nd, hit, w/tw AS share, {_w} AS base
  FROM o_cand c LEFT JOIN nd USING (institution_id) LEFT JOIN hit USING (institution_id, domain, metric_name)
  LEFT JOIN iw USING (institution_id, dept_key) LEFT JOIN tw USING (institution_id) WHERE is_meaningful)
SELECT * REPLACE (CASE WHEN baseline_status = 'INSUFFICIENT_HISTORY' THEN 1 ELSE persistence END AS persistence),
  CASE WHEN zscore IS NOT NULL THEN {r(r9('least(1.0::double, unfav_z/3.5::double)'), 3)} ELSE {r(r9('least(0.75::double, magnitude*0.8::double)'), 3)} END AS deviation,
  CASE WHEN baseline_status = 'INSUFFICIENT_HISTORY' THEN 0.20 WHEN persistence >= 3 THEN 1.0 WHEN persistence = 2 THEN 0.68 ELSE 0.28 END::double AS persistence_score,
  CASE WHEN dept_key = '' THEN 1.0 ELSE {r(r9('least(1.0::double, coalesce(hit, 1)::double/greatest(coalesce(nd, 1), 1))'), 3)} END::double AS coverage,
  CASE WHEN share IS NOT NULL THEN {r(r9('least(1.0::double, base*(0.75::double + 0.50::double*least(0.5::double, share)))'), 3)} ELSE {r('base', 3)} END AS materiality
FROM x""")

_edges = ", ".join(f"('{k}', '{v}')" for k, vs in RELATED_DOMAINS.items() for v in vs)
cte("o_edges", f"SELECT * FROM (VALUES {_edges}) e(d0, d1)")
cte("o_conf", f"""
SELECT a.{SK.replace(', ', ', a.')}, string_agg(DISTINCT t.domain || '.' || t.metric_name || CASE WHEN t.dept_key = '' THEN '' ELSE ' (' || t.dept_key || ')' END, ';'
    ORDER BY t.domain || '.' || t.metric_name || CASE WHEN t.dept_key = '' THEN '' ELSE ' (' || t.dept_key || ')' END) AS confirming
FROM o_scored a JOIN o_edges ON a.domain = d0 JOIN o_scored t ON t.institution_id = a.institution_id AND t.domain = d1
  AND (t.dept_key = a.dept_key OR t.dept_key = '' OR a.dept_key = '') GROUP BY 1, 2, 3, 4""")
_sig = r(r9("least(1.0::double, 0.25::double*magnitude + 0.20::double*deviation + 0.20::double*persistence_score + 0.15::double*coverage + 0.10::double*materiality + 0.10::double*x::int)"), 3)
cte("o_eval", f"""
SELECT *, CASE WHEN risk_stage = 'Crisis' THEN 'CRITICAL' WHEN risk_stage = 'Institutional Risk' THEN CASE WHEN significance >= .78 THEN 'CRITICAL' ELSE 'HIGH' END
  WHEN risk_stage = 'Emerging Risk' THEN 'HIGH' WHEN risk_stage = 'Anomaly' THEN CASE WHEN significance < .58 THEN 'MEDIUM' ELSE 'HIGH' END ELSE 'LOW' END AS severity
FROM (SELECT *, CASE WHEN baseline_status = 'INSUFFICIENT_HISTORY' THEN
      CASE WHEN magnitude < .55 THEN 'Observation' WHEN x AND magnitude >= .75 AND coverage >= .5 THEN 'Emerging Risk' ELSE 'Anomaly' END
    WHEN persistence >= 2 AND x AND coverage >= .5 AND magnitude >= .75 AND significance >= .78 THEN 'Crisis'
    WHEN persistence >= 2 AND (x OR coverage >= .5) AND materiality >= .74 AND significance >= .62 THEN 'Institutional Risk'
    WHEN persistence >= 2 OR (x AND magnitude >= .5) OR (coverage >= .5 AND magnitude >= .6) THEN 'Emerging Risk'
    WHEN magnitude >= .30 OR deviation >= .45 THEN 'Anomaly' ELSE 'Observation' END AS risk_stage
  FROM (SELECT *, {_sig} AS significance FROM (SELECT s.*, coalesce(confirming, '') AS confirming, confirming IS NOT NULL AS x
    FROM o_scored s LEFT JOIN o_conf USING ({SK}))))""")


def unified(v: Views):
    a, p, c = v.canonical()
    return B.unify_signals(a, p, c, v.signals_full())


def evaluated(v: Views):
    """(series, baselines, evaluated anomalies), each staged because the later steps read them several times."""
    a, _, _ = v.canonical()
    series = stage(B.yearly_series(unified(v)))
    base = stage(B.build_baselines(series))
    cand = B.anomaly_candidates(series, base)
    ev = stage(B.classify_significance(B.cross_confirm(B.dimension_scores(cand, series, a))))
    return series, base, ev


SKL = SK.split(", ")


@query("b10_unify_signals", "SELECT institution_id, domain, metric_name, coalesce(department, '') AS dept_key, academic_year, value, unit, polarity, coalesce(risk_contribution, -1.0)::double AS risk, confidence, document FROM o_uni")
def b10(v: Views):
    return unified(v).select(
        "institution_id", "domain", "metric_name", F.coalesce("department", F.lit("")).alias("dept_key"),
        "academic_year", "value", "unit", "polarity", F.coalesce("risk_contribution", F.lit(-1.0)).alias("risk"),
        "confidence", "document")


@query("b11_yearly_representative", f"SELECT {SK}, academic_year, rep_value FROM o_ser")
def b11(v: Views):
    return B.yearly_representative(unified(v))


@query("b12_baselines", "SELECT * FROM o_base")
def b12(v: Views):
    return B.build_baselines(B.yearly_series(unified(v)))


_CAND = [*SKL, "observed_value", "comparison_value", "zscore", "unfav_pct", "absolute_delta", "relative_pct_change",
         "streak", "is_meaningful", "is_notable", "persistence"]


@query("b13_anomaly_candidates", f"SELECT {', '.join(_CAND)} FROM o_cand")
def b13(v: Views):
    s = B.yearly_series(unified(v))
    return B.anomaly_candidates(s, B.build_baselines(s)).select(*_CAND)


_DIM = [*SKL, "magnitude", "deviation", "persistence", "persistence_score", "coverage", "materiality"]


@query("b14_dimension_scores", f"SELECT {', '.join(_DIM)} FROM o_scored")
def b14(v: Views):
    a, _, _ = v.canonical()
    s = stage(B.yearly_series(unified(v)))
    return B.dimension_scores(B.anomaly_candidates(s, B.build_baselines(s)), s, a).select(*_DIM)


@query("b15_cross_confirm", f"SELECT {SK}, x AS cross_confirmed, confirming FROM o_eval")
def b15(v: Views):
    _, _, ev = evaluated(v)
    return ev.select(*SKL, "cross_confirmed", F.array_join("confirming", ";").alias("confirming"))


@query("b16_significance", f"SELECT {SK}, significance, risk_stage, severity FROM o_eval")
def b16(v: Views):
    _, _, ev = evaluated(v)
    return ev.select(*SKL, "significance", "risk_stage", "severity")


def _fixed(x: str, digits: int = 2, sign: str = "") -> str:
    return f"printf('%{sign}.{digits}f', {r(r9(x), digits)})"


_sfx = "CASE WHEN unit = '%' THEN '%' WHEN unit IN ('count', 'ratio') THEN '' ELSE ' ' || coalesce(unit, '') END"


@query("b17_explanations", f"""
SELECT {SK}, metric_label || CASE WHEN dept_key = '' THEN '' ELSE ' in ' || dept_key END || ' ' ||
    CASE polarity WHEN 'higher_is_better' THEN 'declined' WHEN 'lower_is_better' THEN 'increased' ELSE 'shifted' END || '.' AS what_changed,
  CASE WHEN comparison_value IS NULL THEN 'Observed ' || {_fixed('observed_value')} || {_sfx} || ' (single period)'
    ELSE 'Observed ' || {_fixed('observed_value')} || {_sfx} || ' against ' || {_fixed('comparison_value')} || {_sfx} || ' (' || {_fixed('relative_pct_change', 1, '+')} || '%' ||
      CASE WHEN zscore IS NULL THEN '' ELSE ', z ' || {_fixed('zscore', 2, '+')} END || ')' END AS by_how_much,
  CASE WHEN latest_period IS NULL THEN 'undated' ELSE 'AY ' || latest_period || CASE WHEN persistence >= 2 THEN ' (' || persistence || ' consecutive periods)' ELSE '' END END AS "when",
  CASE WHEN baseline_mean IS NOT NULL THEN 'historical mean ' || {_fixed('baseline_mean')} || ', deviation ' || {_fixed('baseline_std')}
    WHEN prior_value IS NOT NULL THEN 'previous period ' || prior_period || ' = ' || {_fixed('prior_value')} ELSE 'single observation against domain thresholds' END AS comparison_basis,
  risk_stage || ' (' || {_fixed('significance')} || ', ' || severity || '): magnitude ' || {_fixed('magnitude')} || ', deviation ' || {_fixed('deviation')} || ', coverage ' ||
    CASE WHEN dept_key = '' THEN 'institution-wide' ELSE coalesce(hit, 0) || ' department(s)' END || ', materiality ' || {_fixed('materiality')} || ', confirmed by ' ||
    CASE WHEN confirming = '' THEN 0 ELSE len(string_split(confirming, ';')) END || ' signal(s)' AS significance_text
FROM o_eval""")
def b17(v: Views):
    _, _, ev = evaluated(v)
    return I.explain(ev).select(*SKL, "what_changed", "by_how_much", "when", "comparison_basis", "significance_text")


@query("b17_explanation_evidence", f"""
SELECT {SK}, academic_year, seq, '[' || coalesce(document, '') || '] ' || metric_name || ' = ' || {_fixed('value')} || ' (confidence ' || {_fixed('confidence')} || ')' AS evidence
FROM (SELECT *, coalesce(department, '') AS dept_key FROM o_uni WHERE value IS NOT NULL AND NOT is_duplicate) SEMI JOIN o_eval USING ({SK})""")
def b17_evidence(v: Views):
    _, _, ev = evaluated(v)
    return I.explanation_evidence(ev, unified(v))


clone("o_assess", "nat_", {"w_adm": "v_adm", "w_plc": "v_plc", "w_cet": "v_cet", "w_sig": "v_sig"})
cte("o_items", f"""SELECT {SK}, 'Observation' AS stage, 0.15::double AS significance FROM o_base ANTI JOIN o_eval USING ({SK})
UNION ALL SELECT {SK}, risk_stage, significance FROM o_eval""")


@query("b18_stage_ladder", """
WITH g AS (SELECT institution_id, count(*) FILTER (stage = 'Observation')::int AS n_observation, count(*) FILTER (stage = 'Anomaly')::int AS n_anomaly,
  count(*) FILTER (stage = 'Emerging Risk')::int AS n_emerging_risk, count(*) FILTER (stage = 'Institutional Risk')::int AS n_institutional_risk,
  count(*) FILTER (stage = 'Crisis')::int AS n_crisis FROM o_items GROUP BY 1)
SELECT a.institution_id, cri, n_observation, n_anomaly, n_emerging_risk, n_institutional_risk, n_crisis,
  CASE WHEN n_crisis > 0 OR (cri >= .70 AND n_institutional_risk > 0) THEN 'Crisis'
    WHEN n_institutional_risk > 0 OR (cri >= .55 AND n_emerging_risk >= 2) THEN 'Institutional Risk'
    WHEN n_emerging_risk > 0 THEN 'Emerging Risk' WHEN n_anomaly > 0 THEN 'Anomaly' ELSE 'Observation' END AS overall_stage
FROM nat_o_assess a JOIN g USING (institution_id)""")
def b18(v: Views):
    _, base, ev = evaluated(v)
    a, p, c = v.canonical()
    return I.stage_ladder(base, ev, R.assess(a, p, c, v.staged("signals"), CORE_DEPTS))


cte("o_find", f"""
WITH ask AS (SELECT institution_id, domain AS p_domain, metric_name AS p_metric, dept_key AS p_dept, d1 AS r_domain FROM o_eval JOIN o_edges ON domain = d0),
b AS (SELECT b.*, e.domain IS NOT NULL AS is_anomaly, coalesce(baseline_mean, prior_value) AS comp,
    row_number() OVER (PARTITION BY b.institution_id, b.domain ORDER BY b.metric_name, b.dept_key) AS rn
  FROM o_base b LEFT JOIN (SELECT {SK} FROM o_eval) e USING ({SK})),
hit AS (SELECT ask.*, b.* EXCLUDE (institution_id) FROM ask JOIN b ON ask.institution_id = b.institution_id AND b.domain = r_domain
  AND (b.dept_key = '' OR p_dept = '' OR b.dept_key = p_dept)),
unmet AS (SELECT * FROM ask ANTI JOIN hit USING (institution_id, p_domain, p_metric, p_dept, r_domain)),
u AS (SELECT * FROM hit UNION ALL SELECT unmet.*, b.* EXCLUDE (institution_id) FROM unmet JOIN b ON unmet.institution_id = b.institution_id AND b.domain = r_domain),
q AS (SELECT *, {r(r9(pct_sql('comp', 'latest_value')), 2)} AS rel, coalesce(abs(latest_value-comp) >= 1e-9 AND CASE polarity WHEN 'higher_is_better' THEN latest_value < comp
   WHEN 'lower_is_better' THEN latest_value > comp ELSE false END, false) AS bad FROM u)
SELECT institution_id, p_domain, p_metric, p_dept, r_domain, metric_name AS r_metric, dept_key AS r_dept, rel AS relative_pct_change,
  CASE WHEN has_contradictions THEN 'CONTRADICTORY_SOURCE' WHEN is_anomaly THEN 'CORROBORATING_CHANGE' WHEN comp IS NULL THEN 'STABLE_NO_CHANGE'
    WHEN bad AND abs(rel) >= 4 THEN 'CORROBORATING_CHANGE' WHEN NOT bad AND abs(rel) >= 5 THEN 'DIVERGENT_TREND' ELSE 'STABLE_NO_CHANGE' END AS relationship FROM q
UNION ALL SELECT unmet.institution_id, p_domain, p_metric, p_dept, r_domain, NULL, NULL, NULL, 'MISSING_DOMAIN' FROM unmet
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.institution_id = unmet.institution_id AND b.domain = r_domain)""")


@query("b19_cross_signal_findings", "SELECT * FROM o_find")
def b19(v: Views):
    _, base, ev = evaluated(v)
    return I.cross_signal_findings(ev, base)


cte("o_contra", f"""
SELECT institution_id, domain, metric_name, coalesce(department, '') AS dept_key, coalesce(academic_year::varchar, 'undated') AS period,
  count(*) AS n_observations, min(value) AS min_value, max(value) AS max_value FROM o_uni WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5
HAVING count(*) >= 2 AND (bool_or(is_contradictory) OR (max(value) - min(value) > 1e-4 AND {r9('(max(value)-min(value))/greatest(abs(min(value)), 1.0::double)')} > 0.01))""")


@query("q07_surface_contradictions", "SELECT * FROM o_contra")
def q07(v: Views):
    return I.surface_contradictions(unified(v))


_conf20 = clamp("""0.78::double + CASE baseline_status WHEN 'ESTABLISHED' THEN 0.12 WHEN 'TWO_PERIOD_COMPARISON_ONLY' THEN -0.06 ELSE -0.18 END::double
  + CASE WHEN n_related > 0 THEN 0.05 ELSE 0.0 END::double - least(0.12::double, 0.03::double*n_missing) - CASE WHEN has_contradictions THEN 0.20 ELSE 0.0 END::double""", "0.15", "0.98")


cte("o_inv", f"""
WITH f AS (SELECT institution_id, p_domain AS domain, p_metric AS metric_name, p_dept AS dept_key, count(*) FILTER (relationship <> 'MISSING_DOMAIN') AS n_related,
  count(*) FILTER (relationship = 'MISSING_DOMAIN') AS n_missing FROM o_find GROUP BY 1, 2, 3, 4),
j AS (SELECT e.* , coalesce(n_related, 0) AS n_related, coalesce(n_missing, 0) AS n_missing FROM o_eval e LEFT JOIN f USING ({SK}))
SELECT {SK}, 'anomaly' AS kind, risk_stage, {r(r9(_conf20), 2)} AS confidence, n_related, n_missing FROM j
UNION ALL SELECT {SK}, 'contradiction', 'Anomaly', 0.55::double, 0, 0 FROM o_contra ANTI JOIN o_eval USING ({SK})""")


@query("b20_investigations", "SELECT * FROM o_inv")
def b20(v: Views):
    _, base, ev = evaluated(v)
    return I.investigations(ev, I.cross_signal_findings(ev, base), I.surface_contradictions(unified(v)))


@query("b21_early_warnings", f"""
SELECT {SK}, latest_period, CASE WHEN persistence >= 2 AND x THEN 'emerging_risk' WHEN x THEN 'cross_signal_confirmation'
  WHEN persistence >= 2 THEN 'repeated_anomaly' ELSE 'weak_signal' END AS warning_stage,
  CASE WHEN persistence >= 2 AND x THEN 4 WHEN x THEN 3 WHEN persistence >= 2 THEN 2 ELSE 1 END AS stage_index FROM o_eval
UNION ALL SELECT {SK}, latest_period, 'weak_signal', 1 FROM
 (SELECT *, {r9(unfav_sql('coalesce(baseline_mean, prior_value)', 'latest_value', 'polarity', 'unit'))} AS u FROM o_base ANTI JOIN o_eval USING ({SK}))
 WHERE u >= 4 AND u < 10""")
def b21(v: Views):
    _, base, ev = evaluated(v)
    return I.early_warnings(base, ev)


cte("o_last", f"""
SELECT s.*, b.polarity, b.unit, ny, y1 FROM (SELECT *, lag(last_value) OVER w AS prev_value, lag(academic_year) OVER w AS prev_year, lag(last_risk) OVER w AS prev_risk,
   lag(last_value, 2) OVER w AS prev2_value, lead(1) OVER w AS nx FROM o_ser WINDOW w AS (PARTITION BY {SK} ORDER BY academic_year)) s
JOIN o_base b USING ({SK}) JOIN (SELECT institution_id, count(DISTINCT academic_year) AS ny, max(academic_year) AS y1 FROM o_ser GROUP BY 1) USING (institution_id)
WHERE nx IS NULL""")


@query("b22_signal_changes", f"""
WITH d AS (SELECT *, {r('last_value-prev_value', 4)} AS delta FROM o_last),
e AS (SELECT *, CASE WHEN ny < 2 OR (prev_year IS NULL AND academic_year = y1) THEN 'NEW' WHEN abs(delta) <= 1e-5 THEN NULL
  WHEN (polarity = 'higher_is_better' AND delta < 0) OR (polarity = 'lower_is_better' AND delta > 0) THEN 'WORSENING'
  WHEN polarity <> 'neutral' AND delta IS NOT NULL THEN 'IMPROVING' END AS direction FROM d)
SELECT {SK}, direction, prev_year, academic_year, prev_value, last_value AS current_value, delta, {r(r9(pct_sql('prev_value', 'last_value')), 2)} AS pct_change
FROM e WHERE direction IS NOT NULL""")
def b22(v: Views):
    series = stage(B.yearly_series(unified(v)))
    return I.signal_changes(series, B.build_baselines(series))


@query("b23_risk_changes", f"""
WITH d AS (SELECT l.*, e.risk_stage, e.persistence, {r9('coalesce(prev_risk, 0.0)')} >= .45 OR {r9(unfav_sql('prev2_value', 'prev_value', 'l.polarity', 'l.unit'))} >= 12 AS was
  FROM o_last l LEFT JOIN o_eval e USING ({SK})),
c AS (SELECT *, CASE WHEN ny < 2 THEN CASE WHEN risk_stage IS NOT NULL THEN 'NEW_RISK' END
  WHEN prev_year IS NULL THEN CASE WHEN risk_stage IS NOT NULL AND academic_year = y1 THEN 'NEW_RISK' END
  WHEN was AND risk_stage IS NULL THEN 'RESOLVED_RISK' WHEN NOT was AND risk_stage IS NOT NULL THEN 'NEW_RISK'
  WHEN was AND persistence >= 2 THEN 'ESCALATED_RISK' END AS change_type FROM d)
SELECT {SK}, change_type, coalesce(risk_stage, 'Observation') AS current_stage FROM c WHERE change_type IS NOT NULL""")
def b23(v: Views):
    series, base, ev = evaluated(v)
    return I.risk_changes(series, base, ev)


def bad_sql(d: str, p: str) -> str:
    return f"(abs({d}) >= 1e-9 AND CASE {p} WHEN 'higher_is_better' THEN {d} < 0 WHEN 'lower_is_better' THEN {d} > 0 ELSE false END)"


_rel = lambda a, b: f"CASE WHEN {a} AND {b} THEN 'Co-deteriorating' WHEN NOT {a} AND NOT {b} THEN 'Co-improving/Stable' ELSE 'Divergent' END"
_pk = "institution_id, domain_a, metric_a, dept_a, domain_b, metric_b, dept_b"


@query("b24_relationship_changes", f"""
WITH s AS (SELECT o_ser.*, b.polarity FROM o_ser JOIN o_base b USING ({SK}) WHERE n_years >= 2),
j AS (SELECT a.institution_id, a.domain AS domain_a, a.metric_name AS metric_a, a.dept_key AS dept_a, b.domain AS domain_b, b.metric_name AS metric_b, b.dept_key AS dept_b,
    a.polarity AS pa, b.polarity AS pb, a.academic_year AS y, a.last_value AS va, b.last_value AS vb
  FROM s a JOIN o_edges ON a.domain = d0 JOIN s b ON b.institution_id = a.institution_id AND b.domain = d1 AND b.academic_year = a.academic_year
    AND b.domain > a.domain AND (a.dept_key = b.dept_key OR a.dept_key = '' OR b.dept_key = '')),
k AS (SELECT *, row_number() OVER (PARTITION BY {_pk} ORDER BY y DESC) AS rn FROM j),
g AS (SELECT {_pk}, any_value(pa) AS pa, any_value(pb) AS pb, count(*) AS n,
    max(va) FILTER (rn=1) - max(va) FILTER (rn=2) AS da, max(vb) FILTER (rn=1) - max(vb) FILTER (rn=2) AS db,
    max(va) FILTER (rn=2) - max(va) FILTER (rn=3) AS ea, max(vb) FILTER (rn=2) - max(vb) FILTER (rn=3) AS eb FROM k GROUP BY {_pk} HAVING count(*) >= 2),
h AS (SELECT *, {bad_sql('da', 'pa')} AS ua, {bad_sql('db', 'pb')} AS ub, {bad_sql('ea', 'pa')} AS wa, {bad_sql('eb', 'pb')} AS wb FROM g),
o AS (SELECT {_pk}, CASE WHEN n >= 3 THEN {_rel('wa', 'wb')} ELSE 'Baseline' END AS previous_relationship,
  CASE WHEN n >= 3 THEN {_rel('ua', 'ub')} WHEN ua <> ub THEN 'Divergent movement' WHEN ua AND ub THEN 'Coupled co-deterioration' END AS current_relationship FROM h)
SELECT * FROM o WHERE current_relationship IS NOT NULL AND previous_relationship <> current_relationship""")
def b24(v: Views):
    series = stage(B.yearly_series(unified(v)))
    return I.relationship_changes(series, B.build_baselines(series))


# ---- states at earlier cutoffs: B25, T05, T07 ---------------------------------------------------
cte("o_years", "SELECT DISTINCT institution_id, academic_year AS cutoff FROM (SELECT institution_id, academic_year FROM v_adm UNION ALL "
    "SELECT institution_id, academic_year FROM v_plc UNION ALL SELECT institution_id, academic_year FROM v_cet UNION ALL SELECT institution_id, academic_year FROM v_sig)")
for _t in ("adm", "plc", "cet", "sig"):
    cte(f"k_{_t}", f"SELECT * EXCLUDE (cutoff) REPLACE (institution_id || '@' || cutoff AS institution_id) FROM v_{_t} JOIN o_years USING (institution_id) WHERE academic_year <= cutoff")
_src = {f"{x}_{t}": f"k_{t}" for x in "vw" for t in ("adm", "plc", "cet", "sig")}
clone("o_state", "kk_", _src)
clone("o_wslopes", "kk_", _src)
cte("kk_state", "SELECT s.* REPLACE (split_part(institution_id, '@', 1) AS institution_id), split_part(institution_id, '@', 2)::int AS cutoff FROM kk_o_state s")
cte("kk_two", "SELECT * FROM kk_state QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY cutoff DESC) <= 2")


def _states(v: Views, min_years: int, n: int, outlook: bool = False):
    a, p, c = v.canonical()
    s = v.staged("signals")
    cut = stage(T.last_cutoffs(T.observed_years(a, p, c, s), n, min_years))
    return stage(T.state_at_cutoffs(a, p, c, s, cut, CORE_DEPTS, outlook))


_in = ["cri", *T.SLOPE_WEIGHTS]


@query("t05_change_explanation", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT institution_id, cutoff, '{'current_cri' if c == 'cri' else c}' AS input_name, {c} AS v, {T.SLOPE_WEIGHTS.get(c, 'NULL')}::double AS w FROM kk_two" for c in _in) + f"""),
g AS (SELECT institution_id, input_name, arg_min(v, cutoff) AS previous_value, arg_max(v, cutoff) AS current_value, max(w) AS w FROM l GROUP BY 1, 2 HAVING count(*) = 2),
d AS (SELECT *, {r('current_value-previous_value', 6)} AS delta FROM g)
SELECT institution_id, input_name, previous_value, current_value, delta, CASE WHEN w IS NULL THEN delta ELSE {r(r9('3*0.15::double*w*delta'), 4)} END AS impact
FROM d WHERE abs(delta) > 1e-6 AND institution_id IN (SELECT institution_id FROM o_years GROUP BY 1 HAVING count(*) >= 3)""")
def t05(v: Views):
    return T.explain_change(_states(v, 3, 2))


_outc = f"""SELECT *, abs(signed_error) AS absolute_error, observed_value >= band_low - 1e-6 AND observed_value <= band_high + 1e-6 AS within_band,
  {r(r9('greatest(0.0::double, 1.0::double - abs(signed_error))'), 4)} AS accuracy FROM (SELECT *, {r(r9('observed_value-predicted_value'), 4)} AS signed_error FROM {{}})"""
_d1 = DRIFT.format(**_plain)
cte("o_hind", f"""
SELECT s.institution_id, s.cutoff, n.cutoff AS target_year, 'composite_risk_index' AS metric_name, {r(r9('s.p'), 6)} AS predicted_value, n.cri AS observed_value,
  {r(r9(clamp('s.p - 0.08::double')), 6)} AS band_low, {r(r9(clamp('s.p + 0.08::double')), 6)} AS band_high
FROM (SELECT *, {clamp(f'cri + 1*({_d1})')} AS p, lead(cutoff) OVER (PARTITION BY institution_id ORDER BY cutoff) AS nc FROM kk_state) s
JOIN kk_state n ON n.institution_id = s.institution_id AND n.cutoff = s.nc WHERE s.is_sufficient""")


def t07_comparisons(v: Views):
    a, p, c = v.canonical()
    s = v.staged("signals")
    cut = T.observed_years(a, p, c, s).select("institution_id", F.col("academic_year").alias("cutoff"))
    return T.hindcast(stage(T.state_at_cutoffs(a, p, c, s, stage(cut), CORE_DEPTS)))


@query("t07_hindcast", _outc.format("o_hind"))
def t07(v: Views):
    return t07_comparisons(v)


_acc = "CASE WHEN predicted_value BETWEEN 0 AND 1 AND observed_value BETWEEN 0 AND 1 THEN 1.0 - a ELSE 1.0 - a/greatest(abs(observed_value), abs(predicted_value), 1.0::double) END"


@query("t06_outcome_comparison", f"""
WITH p AS (SELECT institution_id, department, academic_year, 'placement_percentage' AS metric_name, placement_percentage AS observed_value,
    lag(placement_percentage) OVER (PARTITION BY institution_id, department ORDER BY academic_year) AS predicted_value FROM v_plc
  UNION ALL SELECT institution_id, department, academic_year, 'vacancy_rate', vacancy_rate,
    lag(vacancy_rate) OVER (PARTITION BY institution_id, department ORDER BY academic_year) FROM v_adm),
e AS (SELECT *, {r(r9('observed_value-predicted_value'), 4)} AS signed_error, greatest(0.0::double, predicted_value-0.08::double) AS lo,
  least(1.0::double, predicted_value+0.08::double) AS hi FROM p WHERE predicted_value IS NOT NULL),
f AS (SELECT *, abs(signed_error) AS a FROM e)
SELECT institution_id, department, academic_year, metric_name, predicted_value, observed_value, signed_error, a AS absolute_error,
  observed_value >= lo - 1e-6 AND observed_value <= hi + 1e-6 AS within_band, {r(r9(f'greatest(0.0::double, {_acc})'), 4)} AS accuracy FROM f""")
def t06(v: Views):
    """Persistence forecasts (last year's value) of two metrics against what was observed."""
    from pyspark.sql import Window as W
    a, p, _ = v.canonical()
    w = W.partitionBy("institution_id", "department").orderBy("academic_year")
    pairs = lambda d, m: d.select("institution_id", "department", "academic_year", F.lit(m).alias("metric_name"),
                                  F.lag(m).over(w).alias("predicted_value"), F.col(m).alias("observed_value"))
    u = pairs(p, "placement_percentage").unionByName(pairs(a, "vacancy_rate")).where("predicted_value IS NOT NULL")
    none = F.lit(None).cast("double")
    return T.compare_outcomes(u.withColumns({"band_low": none, "band_high": none})).drop("band_low", "band_high")


@query("b25_outlook_changes", f"""
WITH s AS (SELECT k.institution_id, k.cutoff, {r(r9(clamp('k.cri + 3*(0.15::double*(0.0::double + 0.40::double*coalesce(w.vacancy_rate_slope, 0.0) + -0.35::double*coalesce(w.placement_pct_slope, 0.0) + 0.25::double*coalesce(w.closing_rank_slope, 0.0)))')), 4)} AS y3
  FROM kk_two k LEFT JOIN kk_o_wslopes w ON w.institution_id = k.institution_id || '@' || k.cutoff),
g AS (SELECT institution_id, max(cutoff) AS as_of_year, arg_min(y3, cutoff) AS previous_outlook, arg_max(y3, cutoff) AS current_outlook FROM s GROUP BY 1 HAVING count(*) = 2),
d AS (SELECT *, {r('current_outlook-previous_outlook', 4)} AS delta FROM g)
SELECT *, CASE WHEN delta > .02 THEN 'WORSENED' WHEN delta < -.02 THEN 'IMPROVED' ELSE 'STABLE' END AS direction FROM d""")
def b25(v: Views):
    return T.outlook_changes(_states(v, 2, 2, outlook=True))


def statements(v: Views):
    """Tagged statements with every input they draw on."""
    from riskspark.plans.q_risk import _nations
    series, base, ev = evaluated(v)
    contra = stage(I.surface_contradictions(unified(v)))
    finds = stage(I.cross_signal_findings(ev, base))
    a, cov, s = _nations(v)
    return I.epistemic_statements(series, base, ev, finds, I.investigations(ev, finds, contra),
                                  T.explainable_forecast(a, cov, s), contra)


_name = "domain || '.' || metric_name"
_place = "CASE WHEN dept_key = '' THEN 'Institution-Wide' ELSE dept_key END"
_here = f"{_name} || ' (' || {_place} || ')'"
cte("o_stmt", f"""
WITH miss AS (SELECT institution_id, p_domain AS domain, p_metric AS metric_name, p_dept AS dept_key, string_agg(DISTINCT r_domain, ', ' ORDER BY r_domain) AS absent
  FROM o_find WHERE relationship = 'MISSING_DOMAIN' GROUP BY 1, 2, 3, 4),
rated AS (SELECT * FROM o_fc WHERE status = 'SUFFICIENT_EVIDENCE')
SELECT {SK}, 'OBSERVED_FACT' AS statement_class, {_here} || ' was ' || {_fixed('last_value')} || ' in ' || academic_year AS statement, 0.95::double AS confidence FROM o_last
UNION ALL SELECT {SK}, 'ANALYSIS', {_here} || ' has a baseline of ' || {_fixed('baseline_mean')} || ' with deviation ' || {_fixed('baseline_std')} || ' over ' || n_years || ' years', 0.95 FROM o_base WHERE baseline_status = 'ESTABLISHED'
UNION ALL SELECT institution_id, NULL, NULL, NULL, 'ANALYSIS', 'composite index computed at ' || {_fixed('current_cri', 4)}, confidence FROM rated
UNION ALL SELECT {SK}, 'STATISTICAL_INFERENCE', {_here} || ' is staged ' || risk_stage, significance FROM o_eval
UNION ALL SELECT DISTINCT institution_id, p_domain, p_metric, p_dept, 'CORRELATION', p_domain || '.' || p_metric || ' moves together with ' || r_domain || '.' || r_metric, 0.6 FROM o_find WHERE relationship = 'CORROBORATING_CHANGE'
UNION ALL SELECT {SK}, 'HYPOTHESIS', 'possible factors behind ' || {_name} || ' at ' || {_place}, confidence FROM o_inv WHERE kind = 'anomaly'
UNION ALL SELECT institution_id, NULL, NULL, NULL, 'FORECAST', 'index expected at ' || {_fixed('terminal_cri', 4)} || ' after three years', confidence FROM rated
UNION ALL SELECT {SK}, 'RECOMMENDATION', 'review ' || {_here} || ', staged ' || risk_stage || CASE WHEN absent IS NULL THEN ', and watch related domains' ELSE ', and collect evidence on ' || absent END, confidence
  FROM o_inv LEFT JOIN miss USING ({SK})
UNION ALL SELECT {SK}, 'UNKNOWN', 'no established baseline for ' || {_here} || ': ' || baseline_status, 1.0 FROM o_base WHERE baseline_status <> 'ESTABLISHED'
UNION ALL SELECT {SK}, 'UNKNOWN', 'no signals on ' || absent || ' to judge ' || {_here}, 1.0 FROM miss
UNION ALL SELECT {SK}, 'UNKNOWN', 'sources disagree on ' || {_here} || ' in ' || period, 1.0 FROM o_contra""")


@query("b26_epistemic_statements", "SELECT * FROM o_stmt")
def b26(v: Views):
    return statements(v)
