"""Queries for features, anomalies, the risk index and forecasts."""
from pyspark.sql import functions as F

from riskspark.functions.num import rnd, key9, unfavourable_pct
from riskspark.operators import anomalies as A, features as FT, forecast as T, risk as R
from riskspark.plans.oracle import clone, clamp, cte, r, r9
from riskspark.plans.registry import query
from riskspark.sources.views import Views

DEPT = ["institution_id", "department"]
# Departments whose CRITICAL state adds the roll-up penalty; in the test tables one market segment plays that role.
CORE_DEPTS = ["MACHINERY"]
K = "institution_id, department"
SEPARATE = "/"


# ---- F01-F11 ------------------------------------------------------------------------------------
@query("f01_zscore", f"""
SELECT {K}, academic_year, hist_n, CASE WHEN sd > 1e-9 THEN {r("(x-m)/sd", 6)} ELSE 0.0::double END AS zscore FROM (
SELECT {K}, academic_year, enrolled_count::double AS x, count(*) OVER w AS hist_n, avg(enrolled_count) OVER w AS m,
  stddev_samp(enrolled_count) OVER w AS sd FROM v_adm
WINDOW w AS (PARTITION BY {K} ORDER BY academic_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def f01(v: Views):
    z = FT.zscore_vs_history(v.admissions(), DEPT, ["academic_year"], "enrolled_count")
    return z.select(*DEPT, "academic_year", "hist_n", rnd(F.col("zscore"), 6).alias("zscore"))


@query("f02_pct_change", f"""
SELECT {K}, academic_year, {r("coalesce(CASE WHEN p = 0 THEN CASE WHEN x = 0 THEN 0.0 ELSE 100.0 END ELSE (x-p)/abs(p)*100.0 END, 0.0)::double", 4)} AS pct_change
FROM (SELECT *, placed_students::double AS x, lag(placed_students::double) OVER (PARTITION BY {K} ORDER BY academic_year) AS p FROM v_plc)""")
def f02(v: Views):
    d = FT.period_change(v.placements(), DEPT, ["academic_year"], "placed_students")
    return d.select(*DEPT, "academic_year", rnd(F.col("pct_change"), 4).alias("pct_change"))


cte("o_pos_adm", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY academic_year) - 1 AS pos, "
                 f"lag(enrolled_count) OVER (PARTITION BY {K} ORDER BY academic_year) AS prev FROM v_adm")
cte("o_pos_plc", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY graduation_year) - 1 AS pos FROM v_plc")
cte("o_pos_cet", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY academic_year) - 1 AS pos FROM v_cet")


def slope_sql(y: str, x: str = "pos") -> str:
    return f"CASE WHEN count(*) < 2 THEN 0.0 ELSE regr_slope({y}, {x}) END"


@query("f03_ols_slope", f"""
SELECT {K}, {r(slope_sql('vacancy_rate'), 6)} AS slope, count(*) AS n_points FROM o_pos_adm GROUP BY {K}""")
def f03(v: Views):
    d = FT.ols_slope(v.admissions(), DEPT, ["academic_year"], "vacancy_rate")
    return d.select(*DEPT, rnd(F.col("slope"), 6).alias("slope"), "n_points")


def pct_sql(old: str, new: str) -> str:
    return (f"CASE WHEN {old} = 0 THEN CASE WHEN {new} = 0 THEN 0.0 ELSE 100.0 END "
            f"ELSE ({new}-{old})::double/abs({old})*100.0 END")


cte("o_feat", f"""
SELECT a.institution_id, a.department, a.academic_year, vac AS vacancy_rate_current,
  {r('vs', 6)} AS vacancy_rate_slope,
  {r(f"CASE WHEN na >= 2 THEN {pct_sql('ep', 'e1')} ELSE 0.0 END", 2)} AS enrollment_delta_pct,
  coalesce(pct, 0.0)::double AS placement_pct_current, {r('coalesce(ps, 0.0)', 4)} AS placement_pct_slope,
  {r('coalesce(unp, 1.0)', 4)} AS unplaced_ratio_current, coalesce(rk, 0)::double AS closing_rank_current,
  {r('coalesce(rs, 0.0)', 2)} AS closing_rank_slope, {r('coalesce(pd, 0.0)', 2)} AS percentile_delta,
  {r(f"CASE WHEN na >= 2 AND np >= 2 THEN ({pct_sql('e0', 'e1')} - {pct_sql('p0', 'p1')})/100.0 ELSE 0.0 END", 4)} AS intake_to_placed_divergence,
  na < 3 AS sparse_flag
FROM (SELECT {K}, max(academic_year) AS academic_year, count(*) AS na, arg_max(vacancy_rate, academic_year) AS vac,
        {slope_sql('vacancy_rate')} AS vs, arg_min(enrolled_count, academic_year) AS e0,
        arg_max(enrolled_count, academic_year) AS e1, arg_max(prev, academic_year) AS ep FROM o_pos_adm GROUP BY {K}) a
LEFT JOIN (SELECT {K}, count(*) AS np, arg_max(placement_percentage, graduation_year) AS pct,
        {slope_sql('placement_percentage')} AS ps,
        arg_max(unplaced_count::double/eligible_students, graduation_year) AS unp,
        arg_min(placed_students, graduation_year) AS p0, arg_max(placed_students, graduation_year) AS p1
      FROM o_pos_plc GROUP BY {K}) p ON a.institution_id = p.institution_id AND a.department = p.department
LEFT JOIN (SELECT {K}, arg_max(closing_rank, academic_year) AS rk, {slope_sql('closing_rank')} AS rs,
        arg_max(percentile_cutoff, academic_year) - arg_min(percentile_cutoff, academic_year) AS pd
      FROM o_pos_cet GROUP BY {K}) c ON a.institution_id = c.institution_id AND a.department = c.department""")


@query("f04_department_features", "SELECT * FROM o_feat")
def f04(v: Views):
    a, p, c = v.canonical()
    return FT.department_features(a, p, c)


cte("o_intake", f"SELECT {K}, arg_max(sanctioned_intake, academic_year) AS w FROM v_adm GROUP BY {K}")


def weighted_sql(x: str, k: int) -> str:
    return r(r9(f"sum({x}*w)/sum(w)::double"), k)


cte("o_wslopes", f"""
SELECT institution_id, {weighted_sql('vacancy_rate_slope', 6)} AS vacancy_rate_slope,
  {weighted_sql('placement_pct_slope', 4)} AS placement_pct_slope,
  {weighted_sql('(closing_rank_slope/1000.0::double)', 4)} AS closing_rank_slope, count(*) AS n_departments
FROM o_feat JOIN o_intake USING (institution_id, department) GROUP BY institution_id""")


@query("f05_weighted_slopes", "SELECT * FROM o_wslopes")
def f05(v: Views):
    a, p, c = v.canonical()
    return FT.weighted_slopes(FT.department_features(a, p, c), a)


cte("o_cov", f"""
WITH obs AS (SELECT institution_id, academic_year, 'admissions' AS domain FROM v_adm
  UNION ALL SELECT institution_id, academic_year, 'placements' FROM v_plc
  UNION ALL SELECT institution_id, academic_year, 'admissions' FROM v_cet
  UNION ALL SELECT institution_id, academic_year, domain FROM v_sig),
c AS (SELECT institution_id, count(DISTINCT academic_year) AS n_periods, count(DISTINCT domain) AS n_domains,
  count(*) AS n_observations FROM obs GROUP BY 1),
s AS (SELECT institution_id, {weighted_sql('(vacancy_rate_slope*10.0::double)', 6)} AS vs,
  {weighted_sql('placement_pct_slope', 4)} AS ps, {weighted_sql('(closing_rank_slope/1000.0::double)', 4)} AS rs
  FROM o_feat JOIN o_intake USING (institution_id, department) GROUP BY 1),
d AS (SELECT institution_id, {r(r9("CASE WHEN count(*) >= 2 THEN (arg_max(m, academic_year) - arg_min(m, academic_year))/(max(academic_year)-min(academic_year))::double ELSE 0.0 END"), 6)} AS ds
  FROM (SELECT institution_id, academic_year, avg(risk_contribution) AS m FROM v_sig GROUP BY 1, 2) GROUP BY 1)
SELECT c.institution_id, coalesce(vs, 0.0)::double AS vacancy_rate_slope, coalesce(ps, 0.0)::double AS placement_pct_slope,
  coalesce(rs, 0.0)::double AS closing_rank_slope, coalesce(ds, 0.0)::double AS dynamic_risk_slope,
  n_periods, n_domains, n_observations, {r("least(1.0::double, n_periods/3.0::double)", 4)} AS coverage_ratio,
  n_periods >= 2 AS is_sufficient
FROM c LEFT JOIN s USING (institution_id) LEFT JOIN d USING (institution_id)""")


@query("f06_slopes_and_coverage", "SELECT * FROM o_cov")
def f06(v: Views):
    a, p, c = v.canonical()
    return FT.slopes_and_coverage(a, p, c, v.staged("signals"))


def network(v: Views):
    """Canonical rows at two grains plus dynamic-only institutions, so all evaluation modes occur.

    Every nation is a multi-department institution; every nation/segment pair is also an institution of one
    department; event signals additionally form '<nation>/online' institutions without canonical rows.
    """
    a, p, c = v.canonical()
    s = v.staged("signals")
    solo = lambda d: d.unionByName(d.withColumn("institution_id", F.concat_ws(SEPARATE, "institution_id", "department")))
    online = s.withColumn("institution_id", F.concat_ws(SEPARATE, F.col("institution_id"), F.lit("online")))
    return solo(a), solo(p), solo(c), s.unionByName(online)


for _t in ("adm", "plc", "cet"):
    cte(f"w_{_t}", f"SELECT * FROM v_{_t} UNION ALL BY NAME "
                   f"SELECT * REPLACE (institution_id || '/' || department AS institution_id) FROM v_{_t}")
cte("w_sig", "SELECT * FROM v_sig UNION ALL BY NAME SELECT * REPLACE (institution_id || '/online' AS institution_id) FROM v_sig")


@query("f07_slopes_with_fallback", f"""
WITH y AS (SELECT institution_id, academic_year, avg(risk_contribution) AS m,
    row_number() OVER (PARTITION BY institution_id ORDER BY academic_year) - 1 AS pos FROM w_sig GROUP BY 1, 2),
f AS (SELECT institution_id, {slope_sql('m')} AS s FROM y GROUP BY 1)
SELECT institution_id, vacancy_rate_slope, placement_pct_slope, closing_rank_slope FROM o_wslopes
UNION ALL SELECT institution_id || '/' || department, vacancy_rate_slope, placement_pct_slope,
  {r(r9('closing_rank_slope/1000.0::double'), 4)} FROM o_feat
UNION ALL SELECT institution_id, {r(r9('s'), 4)}, {r(r9('s * -20.0::double'), 4)}, 0.0::double FROM f
WHERE institution_id NOT IN (SELECT institution_id FROM w_adm)""")
def f07(v: Views):
    return FT.slopes_with_fallback(*network(v))


@query("f08_yearly_rollup", f"""
SELECT a.institution_id, a.academic_year, {r('(i-e)*100.0::double/i', 2)} AS vacancy_pct, {r('q*100.0::double/g', 2)} AS placement_pct
FROM (SELECT institution_id, academic_year, sum(sanctioned_intake) AS i, sum(enrolled_count) AS e FROM v_adm GROUP BY 1, 2) a
FULL JOIN (SELECT institution_id, graduation_year AS academic_year, sum(eligible_students) AS g, sum(placed_students) AS q
  FROM v_plc GROUP BY 1, 2) p USING (institution_id, academic_year)""")
def f08(v: Views):
    return FT.yearly_rollup(v.admissions(), v.placements())


@query("f09_latest_per_key", f"""
SELECT {K}, academic_year, closing_rank, percentile_cutoff FROM v_cet
QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY academic_year DESC) = 1""")
def f09(v: Views):
    return FT.latest_per_key(v.ranking(), DEPT, ["academic_year"],
                             ["academic_year", "closing_rank", "percentile_cutoff"])


@query("f10_worsening_streak", f"""
WITH d AS (SELECT {K}, row_number() OVER w AS pos, vacancy_rate - lag(vacancy_rate) OVER w AS d FROM v_adm
  WINDOW w AS (PARTITION BY {K} ORDER BY academic_year))
SELECT {K}, (max(pos) - max(pos) FILTER (NOT coalesce(d > 1e-9, false)))::int AS streak, count(*) AS n_periods FROM d GROUP BY {K}""")
def f10(v: Views):
    return FT.worsening_streak(v.admissions(), DEPT, "academic_year", "vacancy_rate", F.lit("lower_is_better"))


@query("f11_unfavourable_pct", f"""
WITH d AS (SELECT {K}, academic_year, vacancy_rate AS n, lag(vacancy_rate) OVER w AS o,
  enrolled_count::double AS n2, lag(enrolled_count::double) OVER w AS o2 FROM v_adm
  WINDOW w AS (PARTITION BY {K} ORDER BY academic_year))
SELECT {K}, academic_year, {r("CASE WHEN n - o < 1e-9 THEN 0.0 ELSE (n-o)*100.0 END", 4)} AS vacancy_worse_pct,
  {r("CASE WHEN n2 - o2 > -1e-9 THEN 0.0 WHEN o2 < 1e-6 THEN 0.0 ELSE (o2-n2)/o2*100.0 END", 4)} AS enrolment_worse_pct
FROM d WHERE o IS NOT NULL""")
def f11(v: Views):
    from pyspark.sql import Window as W
    w = W.partitionBy(*DEPT).orderBy("academic_year")
    d = v.admissions().withColumns({
        "o": F.lag("vacancy_rate").over(w), "n2": F.col("enrolled_count").cast("double"),
        "o2": F.lag(F.col("enrolled_count").cast("double")).over(w)}).where("o IS NOT NULL")
    return d.select(
        *DEPT, "academic_year",
        rnd(unfavourable_pct(F.col("o"), F.col("vacancy_rate"), F.lit("lower_is_better"), F.lit("ratio")), 4)
        .alias("vacancy_worse_pct"),
        rnd(unfavourable_pct(F.col("o2"), F.col("n2"), F.lit("higher_is_better"), F.lit("count")), 4)
        .alias("enrolment_worse_pct"))


# ---- A01-A05 ------------------------------------------------------------------------------------
def _hist_cte(name: str, src: str, keys: str, year: str, val: str) -> None:
    cte(name, f"""
SELECT *, CASE WHEN sd > 1e-9 THEN ({val}-m)/sd ELSE 0.0 END AS z FROM (
SELECT *, count(*) OVER w AS hn, avg({val}) OVER w AS m, stddev_samp({val}) OVER w AS sd,
  row_number() OVER (PARTITION BY {keys} ORDER BY {year} DESC, department DESC) AS rn FROM {src}
WINDOW w AS (PARTITION BY {keys} ORDER BY {year}, department ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE rn = 1 AND hn >= 1""")


def _anom_ctes(prefix: str, src: str, keys: str) -> None:
    _hist_cte(f"{prefix}_ha", f"{src}_adm", keys, "academic_year", "enrolled_count")
    _hist_cte(f"{prefix}_hp", f"{src}_plc", keys, "graduation_year", "placement_percentage")
    _hist_cte(f"{prefix}_hc", f"{src}_cet", keys, "academic_year", "closing_rank")
    z = r9("z")
    cte(f"{prefix}_a1", f"""SELECT {keys}, 'Admissions' AS signal_name, academic_year, 'enrolled_count' AS metric_name,
  enrolled_count::double AS observed_value, {r('m', 4)} AS baseline_value, {r('z', 2)} AS deviation_zscore,
  CASE WHEN {z} <= -3 OR vacancy_rate >= .55 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM {prefix}_ha WHERE ({z} <= -2 AND vacancy_rate >= .15) OR vacancy_rate >= .40""")
    p = "placement_percentage"
    cte(f"{prefix}_a2", f"""SELECT {keys}, 'Placements' AS signal_name, graduation_year AS academic_year, '{p}' AS metric_name,
  {p} AS observed_value, {r('m', 4)} AS baseline_value, {r('z', 2)} AS deviation_zscore,
  CASE WHEN {z} <= -3 OR {p} < 35 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM {prefix}_hp WHERE ({z} <= -2 AND {p} < 75) OR {p} < 50""")
    s = r9("(closing_rank-m)/m")
    cte(f"{prefix}_a3", f"""SELECT {keys}, 'CET / Ranking' AS signal_name, academic_year, 'closing_rank' AS metric_name,
  closing_rank::double AS observed_value, {r('m', 4)} AS baseline_value, {r('z', 2)} AS deviation_zscore,
  CASE WHEN ({z} >= 3 AND {s} >= .30) OR {s} >= .75 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM {prefix}_hc WHERE ({z} >= 2 AND {s} >= .15) OR {s} >= .50""")
    g = lambda a, b: f"CASE WHEN {a} > 0 THEN ({b}-{a})::double/{a}*100.0 ELSE 0.0 END"
    oa, op = "struct_pack(y := academic_year, d := department)", "struct_pack(y := graduation_year, d := department)"
    cte(f"{prefix}_a4", f"""SELECT {keys}, 'Cross-Signal Divergence' AS signal_name, yr AS academic_year,
  'intake_to_placed_divergence' AS metric_name, {r('dv', 2)} AS observed_value, 0.0::double AS baseline_value,
  {r('-4.0::double*abs(dv)', 2)} AS deviation_zscore, CASE WHEN dv >= .60 OR pct < 30 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM (SELECT *, {r(f"({g('e0', 'e1')} - {g('p0', 'p1')})/100.0", 4)} AS dv FROM
  (SELECT {keys}, count(*) AS na, arg_min(enrolled_count, {oa}) AS e0, arg_max(enrolled_count, {oa}) AS e1,
     arg_max(vacancy_rate, {oa}) AS vac FROM {src}_adm GROUP BY {keys}) a
  JOIN (SELECT {keys}, count(*) AS np, arg_min(placed_students, {op}) AS p0, arg_max(placed_students, {op}) AS p1,
     arg_max({p}, {op}) AS pct, max(graduation_year) AS yr FROM {src}_plc GROUP BY {keys}) b USING ({keys}))
WHERE na >= 2 AND np >= 2 AND vac < .20 AND pct < 45 AND dv >= .40""")


_anom_ctes("d", "v", K)
_anom_ctes("n", "w", "institution_id")


def _no_text(df):
    return df.drop("description")


@query("a01_admissions_anomalies", "SELECT * FROM d_a1")
def a01(v: Views):
    return _no_text(A.admissions_anomalies(v.admissions(), DEPT))


@query("a02_placement_anomalies", "SELECT * FROM d_a2")
def a02(v: Views):
    return _no_text(A.placement_anomalies(v.placements(), DEPT))


@query("a03_rank_anomalies", "SELECT * FROM d_a3")
def a03(v: Views):
    return _no_text(A.rank_anomalies(v.ranking(), DEPT))


@query("a04_divergence_anomalies", "SELECT * FROM d_a4")
def a04(v: Views):
    return _no_text(A.divergence_anomalies(v.admissions(), v.placements(), DEPT))


class CustomerViews(Views):
    """The same canonical rows with every customer as a department: small cells, in which ranks and ratios move."""

    def _order_slots(self):
        c = self.table("customer").select("c_custkey", "c_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        o = self.table("orders")
        return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("n_name").alias("institution_id"), F.concat(F.lit("C"), "c_custkey").alias("department"),
            (F.year("o_orderdate") + 23).alias("academic_year"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _by_customer(v: Views) -> CustomerViews:
    return CustomerViews(v.spark, v.dir)


cte("k_slots", """
SELECT n_name AS institution_id, 'C' || c_custkey AS department, (year(o_orderdate)+23)::int AS academic_year,
  o_orderkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


@query("a03_rank_anomalies_by_customer", f"SELECT * FROM {clone('d_a3', 'k_', {'v_slots': 'k_slots'})}")
def a03k(v: Views):
    return _no_text(A.rank_anomalies(_by_customer(v).ranking(), DEPT))


@query("a04_divergence_anomalies_by_customer", f"SELECT * FROM {clone('d_a4', 'k_', {'v_slots': 'k_slots'})}")
def a04k(v: Views):
    k = _by_customer(v)
    return _no_text(A.divergence_anomalies(k.admissions(), k.placements(), DEPT))


cte("o_dyn", f"""
SELECT institution_id, signal_id, domain,
  CASE WHEN is_contradictory THEN 'Contradictory Source (' || upper(domain[1]) || domain[2:] || ')'
    ELSE upper(domain[1]) || domain[2:] || ' Intelligence' END AS signal_name,
  coalesce(academic_year, 2025) AS academic_year, metric_name, value AS observed_value,
  CASE WHEN is_contradictory THEN value WHEN polarity = 'higher_is_better' THEN 85.0 ELSE 10.0 END::double AS baseline_value,
  CASE WHEN is_contradictory THEN -2.5 ELSE {r("(value - CASE WHEN polarity = 'higher_is_better' THEN 85.0 ELSE 10.0 END)/10.0::double", 2)} END::double AS deviation_zscore,
  CASE WHEN is_contradictory THEN 'HIGH' WHEN risk_contribution >= .75 THEN 'CRITICAL'
    WHEN risk_contribution >= .60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM w_sig WHERE value IS NOT NULL AND (is_contradictory OR (risk_contribution >= .45
  AND domain NOT IN ('admissions', 'placements', 'ranking')))""")


@query("a05_dynamic_anomalies", "SELECT * FROM o_dyn WHERE institution_id NOT LIKE '%/online'")
def a05(v: Views):
    return _no_text(A.dynamic_anomalies(v.signals()))


# ---- C01-C08 ------------------------------------------------------------------------------------
def _threat_cte(name: str, src: str, keys: str) -> None:
    oa, op = "struct_pack(y := academic_year, d := department)", "struct_pack(y := graduation_year, d := department)"
    cte(name, f"""
SELECT {keys}, coalesce(ta, 0.0)::double AS ta, coalesce(tp, 0.0)::double AS tp, coalesce(tr, 0.0)::double AS tr,
  coalesce(na, 0) AS na, coalesce(w, 60) AS w, coalesce(nd, 0) AS nd
FROM (SELECT {keys}, least(1.0::double, arg_max(vacancy_rate, {oa})*1.5::double) AS ta, count(*) AS na,
        arg_max(sanctioned_intake, {oa}) AS w, count(DISTINCT department) AS nd FROM {src}_adm GROUP BY {keys}) a
FULL JOIN (SELECT {keys}, {clamp(f"(100.0::double - arg_max(placement_percentage, {op}))/100.0::double")} AS tp
      FROM {src}_plc GROUP BY {keys}) p USING ({keys})
FULL JOIN (SELECT {keys}, CASE WHEN count(*) >= 2 THEN {clamp(f"(arg_max(closing_rank, {oa}) - arg_min(closing_rank, {oa}))::double/arg_min(closing_rank, {oa})")} ELSE 0.0 END AS tr
      FROM {src}_cet GROUP BY {keys}) c USING ({keys})""")


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= .70 THEN 'CRITICAL' WHEN {x} >= .50 THEN 'HIGH' WHEN {x} >= .30 THEN 'MEDIUM' ELSE 'LOW' END"


def score_sql(src: str, keys: str, cross: str = "false", crit: str = "false") -> str:
    base = "(0.40::double*ta + 0.35::double*tp + 0.25::double*tr)"
    top = "greatest(ta, tp, tr)"
    cri = (f"CASE WHEN {cross} THEN greatest({base}, 0.50::double + 0.25::double*{top}) "
           f"WHEN {crit} AND {r9(top)} >= .70 THEN greatest({base}, 0.65::double*{top} + 0.35::double*{base}) ELSE {base} END")
    ca, cp, cr = r9("0.40::double*ta"), r9("0.35::double*tp"), r9("0.25::double*tr")
    return f"""SELECT *, {band_sql('cri')} AS risk_level,
  CASE WHEN {cross} AND ta < .25 AND tp >= .55 THEN 'Cross-Signal Divergence (Intake vs. Placements)'
    WHEN {ca} >= {cp} AND {ca} >= {cr} THEN 'Admissions Collapse' WHEN {cp} >= {cr} THEN 'Placement Degradation'
    ELSE 'Ranking & Cutoff Drift' END AS driver,
  CASE WHEN na >= 3 THEN 0.92 ELSE 0.75 END::double AS confidence
FROM (SELECT *, {r(clamp(r9(cri)), 3)} AS cri FROM {src})"""


_threat_cte("o_thr_d", "v", K)
_threat_cte("o_thr_n", "w", "institution_id")
_threat_cte("o_thr_nd", "w", K)
cte("d_flags", f"""SELECT {K}, bool_or(signal_name LIKE '%Cross-Signal%') AS hx, bool_or(severity = 'CRITICAL') AS hc
FROM (SELECT {K}, signal_name, severity FROM d_a1 UNION ALL SELECT {K}, signal_name, severity FROM d_a2
  UNION ALL SELECT {K}, signal_name, severity FROM d_a3 UNION ALL SELECT {K}, signal_name, severity FROM d_a4) GROUP BY {K}""")
cte("o_single_in", f"SELECT t.*, coalesce(hx, false) AS hx, coalesce(hc, false) AS hc FROM o_thr_d t LEFT JOIN d_flags USING ({K})")
_c01_cols = f"{K}, ta AS adm_threat, tp AS plc_threat, tr AS rnk_threat, cri, risk_level, driver, confidence"


@query("c01_cri_single", f"""SELECT {K}, {r('ta', 6)} AS adm_threat, {r('tp', 6)} AS plc_threat, {r('tr', 6)} AS rnk_threat,
  cri, risk_level, driver, confidence FROM ({score_sql('o_single_in', K, 'hx', 'hc')})""")
def c01(v: Views):
    a, p, c = v.canonical()
    d = R.cri_single(a, p, c, DEPT)
    return d.select(*DEPT, *[rnd(F.col(x), 6).alias(x) for x in ("adm_threat", "plc_threat", "rnk_threat")],
                    "cri", "risk_level", "driver", "confidence")


def rollup_sql(src: str, keys: str) -> str:
    core = ",".join(f"'{x}'" for x in CORE_DEPTS)
    return f"""SELECT {keys}, cri, {band_sql('cri')} AS risk_level,
  CASE WHEN wa >= wp AND wa >= wr THEN 'Admissions Degradation' WHEN wp >= wr THEN 'Placements Degradation'
    ELSE 'Ranking Degradation' END AS driver, 0.94::double AS confidence, n_depts, total_intake
FROM (SELECT {keys}, {r(r9(f"CASE WHEN bool_or(risk_level = 'CRITICAL' AND department IN ({core})) THEN least(1.0::double, sum(cri*w)/sum(w)::double + 0.05::double) ELSE sum(cri*w)/sum(w)::double END"), 3)} AS cri,
  sum(CASE WHEN driver LIKE '%Admissions%' THEN w ELSE 0 END) AS wa,
  sum(CASE WHEN driver LIKE '%Placement%' AND driver NOT LIKE '%Admissions%' THEN w ELSE 0 END) AS wp,
  sum(CASE WHEN driver NOT LIKE '%Placement%' AND driver NOT LIKE '%Admissions%' THEN w ELSE 0 END) AS wr,
  count(*) AS n_depts, sum(w)::bigint AS total_intake FROM {src} GROUP BY {keys})"""


cte("o_dept_scores", score_sql("o_thr_d", K))


@query("c02_cri_rollup", rollup_sql("o_dept_scores", "institution_id"))
def c02(v: Views):
    a, p, c = v.canonical()
    return R.cri_rollup(R.score_single(R.threats(a, p, c, DEPT)), CORE_DEPTS)


cte("o_cri_dyn", f"""
SELECT institution_id, cri, {band_sql('cri')} AS risk_level,
  CASE WHEN top IS NULL THEN 'General Institutional Monitoring' ELSE upper(top[1]) || top[2:] || ' Domain Risk' END AS driver,
  {clamp(r(r9('conf'), 2), '0.5')} AS confidence, n_domains
FROM (SELECT institution_id, {r(clamp(r9('avg(m)')), 3)} AS cri,
    arg_max(domain, struct_pack(a := {r9('m')}, b := -s)) AS top, count(*) AS n_domains, sum(c)/sum(n) AS conf
  FROM (SELECT institution_id, domain, avg(risk_contribution) AS m, min(seq) AS s, sum(confidence) AS c, count(*) AS n
        FROM w_sig GROUP BY 1, 2) GROUP BY 1)""")


@query("c03_cri_dynamic", "SELECT * FROM o_cri_dyn WHERE institution_id NOT LIKE '%/online'")
def c03(v: Views):
    return R.cri_dynamic(v.signals())


cte("n_flags", """SELECT institution_id, count(*) AS na3, bool_or(severity = 'CRITICAL') AS hc FROM (
  SELECT institution_id, severity FROM n_a1 UNION ALL SELECT institution_id, severity FROM n_a2
  UNION ALL SELECT institution_id, severity FROM n_a3) GROUP BY 1""")
cte("o_one_in", """SELECT t.*, x.institution_id IS NOT NULL AS hx,
  coalesce(f.hc, false) OR coalesce(x.severity = 'CRITICAL', false) AS hc,
  coalesce(f.na3, 0) + CASE WHEN x.institution_id IS NOT NULL THEN 1 ELSE 0 END AS n_anom
FROM o_thr_n t LEFT JOIN n_flags f ON t.institution_id = f.institution_id
LEFT JOIN n_a4 x ON t.institution_id = x.institution_id WHERE t.nd <= 1""")
cte("o_multi_dept", score_sql("(SELECT * FROM o_thr_nd WHERE na > 0 AND institution_id IN (SELECT institution_id FROM o_thr_n WHERE nd > 1))", K))
cte("o_ndyn", "SELECT institution_id, count(*) AS nd FROM o_dyn GROUP BY 1")
cte("o_assess", f"""
SELECT c.institution_id, cri, risk_level, driver, confidence, n_anomalies + coalesce(nd, 0) AS n_anomalies, mode FROM (
  SELECT institution_id, cri, risk_level, driver, confidence, n_anom AS n_anomalies, 'single_stream' AS mode
    FROM ({score_sql('o_one_in', 'institution_id', 'hx', 'hc')})
  UNION ALL
  SELECT m.institution_id, cri, risk_level, driver, confidence, coalesce(na3, 0), 'department_rollup'
    FROM ({rollup_sql('o_multi_dept', 'institution_id')}) m LEFT JOIN n_flags USING (institution_id)
  UNION ALL
  SELECT institution_id, cri, risk_level, driver, confidence, 0, 'dynamic_only' FROM o_cri_dyn
    WHERE institution_id NOT IN (SELECT institution_id FROM o_thr_n)) c
LEFT JOIN o_ndyn USING (institution_id)""")


@query("c04_assess", "SELECT * FROM o_assess")
def c04(v: Views):
    return R.assess(*network(v), CORE_DEPTS)


@query("c05_weight_profiles", " UNION ALL ".join(
    f"""SELECT '{n}' AS profile, institution_id, department, {r(clamp(r9(f'{wa}::double*ta + {wp}::double*tp + {wr}::double*tr')), 3)} AS cri FROM o_thr_d"""
    for n, wa, wp, wr in (("default", .40, .35, .25), ("placement_led", .25, .55, .20), ("intake_led", .60, .25, .15))))
def c05(v: Views):
    a, p, c = v.canonical()
    t = R.threats(a, p, c, DEPT)
    rows = F.array(*[
        F.struct(F.lit(n).alias("profile"), F.lit(x).alias("wa"), F.lit(y).alias("wp"), F.lit(z).alias("wr"))
        for n, x, y, z in (("default", .40, .35, .25), ("placement_led", .25, .55, .20), ("intake_led", .60, .25, .15))])
    return R.score_profiles(t, rows).select("profile", *DEPT, "cri")


KY = "institution_id, academic_year"
_threat_cte("o_thr_y", "v", "institution_id, academic_year, department")
CTE_Y = f"""
SELECT y.institution_id, y.academic_year, CASE WHEN k = 1 THEN c1 ELSE cri END AS cri FROM ({{roll}}) y
JOIN (SELECT {KY}, count(*) AS k, min(cri) AS c1 FROM o_y_dept GROUP BY {KY}) o USING ({KY})"""
cte("o_y_dept", score_sql("(SELECT * FROM o_thr_y WHERE na > 0)", KY))
cte("o_yearly", CTE_Y.format(roll=rollup_sql("o_y_dept", KY)))


@query("c06_risk_trend", f"""
WITH p AS (SELECT *, {band_sql('cri')} AS risk_level FROM o_yearly),
d AS (SELECT institution_id, {r('arg_max(cri, academic_year) - arg_min(cri, academic_year)', 3)} AS delta FROM p GROUP BY 1)
SELECT p.institution_id, p.academic_year, cri, risk_level, avg_vacancy, avg_placement, delta,
  CASE WHEN delta > .03 THEN 'worsening' WHEN delta < -.03 THEN 'improving' ELSE 'stable' END AS direction
FROM p JOIN d USING (institution_id)
LEFT JOIN (SELECT {KY}, {r(r9('avg(vacancy_rate)'), 4)} AS avg_vacancy FROM v_adm GROUP BY {KY}) USING ({KY})
LEFT JOIN (SELECT institution_id, graduation_year AS academic_year, {r(r9('avg(placement_percentage)'), 2)} AS avg_placement FROM v_plc GROUP BY 1, 2) USING ({KY})""")
def c06(v: Views):
    a, p, c = v.canonical()
    return R.risk_trend(R.yearly_scores(a, p, c, CORE_DEPTS), a, p)


cte("o_ing", """SELECT institution_id, ingestion_id, min(ts) AS created_at, count(*) AS n_signals
FROM v_dup GROUP BY 1, 2""")


def ingestions(v: Views):
    return v.signals_dup().groupBy("institution_id", "ingestion_id").agg(
        F.min("ts").alias("created_at"), F.count("*").alias("n_signals"))


@query("c08_assessment_versions", """
SELECT a.institution_id, cri, risk_level,
  sha256(concat_ws(':', a.institution_id, coalesce(nc, 0), coalesce(na, 0), coalesce(np, 0), coalesce(ns, 0), coalesce(li, '')))[1:16] AS version_key
FROM o_assess a
LEFT JOIN (SELECT institution_id, count(*) AS nc FROM w_cet GROUP BY 1) c ON a.institution_id = c.institution_id
LEFT JOIN (SELECT institution_id, count(*) AS na FROM w_adm GROUP BY 1) d ON a.institution_id = d.institution_id
LEFT JOIN (SELECT institution_id, count(*) AS np FROM w_plc GROUP BY 1) p ON a.institution_id = p.institution_id
LEFT JOIN (SELECT institution_id, count(*) AS ns FROM w_sig GROUP BY 1) s ON a.institution_id = s.institution_id
LEFT JOIN (SELECT institution_id, arg_max(ingestion_id, struct_pack(a := created_at, b := ingestion_id)) AS li FROM o_ing GROUP BY 1) i
  ON a.institution_id = i.institution_id""")
def c08(v: Views):
    a, p, c, s = network(v)
    d = R.version_assessments(R.assess(a, p, c, s, CORE_DEPTS), a, p, c, s, ingestions(v))
    return d.select("institution_id", "cri", "risk_level", "version_key")


# ---- T01-T07, T11, B25 --------------------------------------------------------------------------
SC = [("balanced", 0.05, 2.0, 0.10, 0.02), ("placement_drive", 0.0, 5.0, 0.0, 0.0), ("seat_cut", 0.10, 0.0, 0.0, 0.0)]
DRIFT = "0.15::double*(0.0::double + 0.40::double*{v} + -0.35::double*{p} + 0.25::double*{r} + 0.30::double*{d})"
_plain = dict(v="vacancy_rate_slope", p="placement_pct_slope", r="closing_rank_slope", d="dynamic_risk_slope")
cte("o_state", f"""SELECT a.institution_id, a.cri, a.confidence AS aconf, coalesce(vacancy_rate_slope, 0.0)::double AS vacancy_rate_slope,
  coalesce(placement_pct_slope, 0.0)::double AS placement_pct_slope, coalesce(closing_rank_slope, 0.0)::double AS closing_rank_slope,
  coalesce(dynamic_risk_slope, 0.0)::double AS dynamic_risk_slope, n_periods, n_domains, n_observations, coverage_ratio, is_sufficient
FROM o_assess a JOIN o_cov USING (institution_id)""")


def points_sql(src: str, drift: str, years: int, scenario: str, extra: str = "") -> str:
    p = clamp(f"cri + year_offset*({drift})")
    return f"""SELECT institution_id, {extra} year_offset, {r(r9('p'), 6)} AS projected_cri,
  {r(r9(clamp('p - year_offset*0.08::double')), 6)} AS band_low, {r(r9(clamp('p + year_offset*0.08::double')), 6)} AS band_high,
  '{scenario}' AS scenario
FROM (SELECT *, {p} AS p FROM (SELECT *, unnest(range(1, {years + 1}))::int AS year_offset FROM {src}))"""


def _nations(v: Views):
    """Assessment and coverage of the nation institutions."""
    a, p, c = v.canonical()
    s = v.staged("signals")
    return R.assess(a, p, c, s, CORE_DEPTS), FT.slopes_and_coverage(a, p, c, s), s


_PT = ["year_offset", "projected_cri", "band_low", "band_high", "scenario"]


@query("t01_trajectory", points_sql("o_state", DRIFT.format(**_plain), 5, "STATUS_QUO"))
def t01(v: Views):
    a, cov, _ = _nations(v)
    return T.project(T.with_drift(a, cov), 5).select("institution_id", *_PT)


_adj = dict(v="(vacancy_rate_slope - s1)", p="(placement_pct_slope + s2)", r="(closing_rank_slope - s3)", d="(dynamic_risk_slope - s4)")
_vals = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {d}::double)" for n, a, b, c, d in SC)


@query("t02_what_if", points_sql(
    f"(SELECT * FROM o_state, (VALUES {_vals}) s(intervention, s1, s2, s3, s4))", DRIFT.format(**_adj), 3,
    "WITH_INTERVENTION", "intervention,"))
def t02(v: Views):
    a, cov, _ = _nations(v)
    return T.what_if(a, cov, SC, 3).select("institution_id", "intervention", *_PT)


@query("t03_slopes_from_features", f"""
SELECT {K}, {r(r9('vacancy_rate_slope*10.0::double'), 6)} AS vacancy_rate_slope, placement_pct_slope,
  {r('closing_rank_slope/1000.0::double', 6)} AS closing_rank_slope, 0.0::double AS dynamic_risk_slope FROM o_feat""")
def t03(v: Views):
    a, p, c = v.canonical()
    d = T.slopes_from_features(FT.department_features(a, p, c))
    return d.select(*DEPT, rnd(key9(F.col("vacancy_rate_slope")), 6).alias("vacancy_rate_slope"), "placement_pct_slope",
                    rnd(F.col("closing_rank_slope"), 6).alias("closing_rank_slope"), "dynamic_risk_slope")


cte("o_fc", f"""
SELECT institution_id, CASE WHEN is_sufficient THEN 'SUFFICIENT_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
  CASE WHEN is_sufficient THEN cri END AS current_cri,
  CASE WHEN is_sufficient THEN {r(r9(clamp(f"cri + 3*({DRIFT.format(**_plain)})")), 4)} END AS terminal_cri,
  CASE WHEN is_sufficient THEN {r(r9(clamp("0.45::double + least(0.35::double, (n_periods-1)*0.15::double) + least(0.20::double, n_domains*0.06::double)", "0.35", "0.92")), 2)} ELSE 0.0 END::double AS confidence,
  n_periods, n_domains, n_observations, coverage_ratio, vacancy_rate_slope, placement_pct_slope, closing_rank_slope, dynamic_risk_slope
FROM o_state""")


@query("t04_explainable_forecast", "SELECT * FROM o_fc")
def t04(v: Views):
    a, cov, s = _nations(v)
    return T.explainable_forecast(a, cov, s)


@query("t04_forecast_drivers", f"""
SELECT *, CASE WHEN contribution > .0005 THEN 'WORSENING_RISK' WHEN contribution < -.0005 THEN 'IMPROVING_RISK' ELSE 'NEUTRAL' END AS direction
FROM (SELECT institution_id, driver, slope_value, weight, {r(r9('0.15::double*weight*slope_value'), 6)} AS contribution FROM (""" +
       " UNION ALL ".join(f"SELECT institution_id, '{n}' AS driver, {n} AS slope_value, {w}::double AS weight FROM o_fc WHERE status LIKE 'SUFF%'"
                          for n, w in T.SLOPE_WEIGHTS.items()) + "))")
def t04d(v: Views):
    a, cov, s = _nations(v)
    return T.drivers(T.explainable_forecast(a, cov, s))


@query("t11_prediction_headline", f"""
WITH n AS (SELECT institution_id, count(DISTINCT academic_year) AS n_periods FROM (
  SELECT institution_id, academic_year FROM v_adm UNION ALL SELECT institution_id, academic_year FROM v_plc
  UNION ALL SELECT institution_id, academic_year FROM v_cet UNION ALL SELECT institution_id, academic_year FROM v_sig) GROUP BY 1),
b AS (SELECT a.institution_id, a.cri, a.confidence AS cf, n_periods,
  {r(r9(clamp("a.cri + 3*(0.15::double*(0.0::double + 0.40::double*coalesce(vacancy_rate_slope,0) + -0.35::double*coalesce(placement_pct_slope,0) + 0.25::double*coalesce(closing_rank_slope,0)))")), 6)} AS y3
  FROM o_assess a JOIN n USING (institution_id) LEFT JOIN o_wslopes USING (institution_id))
SELECT institution_id, CASE WHEN n_periods >= 2 THEN 'SUCCESS' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
  CASE WHEN n_periods < 2 THEN 'insufficient history' WHEN {r(r9('y3-cri'), 3)} > .03 THEN 'projected to increase'
    WHEN {r(r9('y3-cri'), 3)} < -.03 THEN 'projected to decline' ELSE 'projected to remain stable' END AS headline,
  CASE WHEN n_periods >= 2 THEN cri ELSE 0.0 END::double AS current_cri, CASE WHEN n_periods >= 2 THEN y3 END AS year3_cri,
  CASE WHEN n_periods >= 2 THEN {r('cf', 2)} ELSE 0.0 END::double AS confidence, n_periods FROM b""")
def t11(v: Views):
    a, p, c = v.canonical()
    s = v.staged("signals")
    years = a.select("institution_id", "academic_year").unionByName(p.select("institution_id", "academic_year")) \
        .unionByName(c.select("institution_id", "academic_year")).unionByName(s.select("institution_id", "academic_year"))
    return T.prediction_headline(R.assess(a, p, c, s, CORE_DEPTS),
                                 FT.weighted_slopes(FT.department_features(a, p, c), a), years)
