"""Composite risk index: single stream, department roll-up, dynamic-only, dispatcher, trend."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from riskspark.functions.num import clamp, key9, risk_band, rnd
from riskspark.operators import anomalies as A

INST = ["institution_id"]
DEPT = ["institution_id", "department"]


@dataclass(frozen=True)
class WeightProfile:
    admissions: float = 0.40
    placements: float = 0.35
    ranking: float = 0.25


DEFAULT_PROFILE = WeightProfile()


def threats(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Threat level 0..1 of each stream from its latest (and, for ranks, first) observation."""
    ao, po = F.struct("academic_year", "department"), F.struct("graduation_year", "department")
    a = admissions.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.max_by("vacancy_rate", ao) * 1.5).alias("adm_threat"),
        F.count("*").alias("n_adm"), F.max_by("sanctioned_intake", ao).alias("latest_intake"),
        F.countDistinct("department").alias("n_depts"))
    p = placements.groupBy(*keys).agg(
        clamp((F.lit(100.0) - F.max_by("placement_percentage", po)) / 100.0).alias("plc_threat"))
    first = F.min_by("closing_rank", ao)
    r = ranking.groupBy(*keys).agg(
        F.when(F.count("*") >= 2, clamp((F.max_by("closing_rank", ao) - first) / first)).otherwise(0.0)
        .alias("rnk_threat"))
    out = a.join(p, keys, "full").join(r, keys, "full")
    return out.select(
        *keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("adm_threat", "plc_threat", "rnk_threat")],
        F.coalesce("n_adm", F.lit(0)).alias("n_adm"), F.coalesce("latest_intake", F.lit(60)).alias("latest_intake"),
        F.coalesce("n_depts", F.lit(0)).alias("n_depts"))


def score_single(t: DataFrame, profile: WeightProfile = DEFAULT_PROFILE) -> DataFrame:
    """Weighted index with cross-signal and critical-shock amplification, level, driver and confidence.

    Reads ``has_cross`` / ``has_critical`` when the caller joined anomaly flags, else none are assumed.
    """
    for flag in ("has_cross", "has_critical"):
        if flag not in t.columns:
            t = t.withColumn(flag, F.lit(False))
    wa, wp, wr = F.lit(profile.admissions), F.lit(profile.placements), F.lit(profile.ranking)
    a, p, r = F.col("adm_threat"), F.col("plc_threat"), F.col("rnk_threat")
    base = wa * a + wp * p + wr * r
    top = F.greatest(a, p, r)
    cri = (
        F.when(F.col("has_cross"), F.greatest(base, F.lit(0.50) + F.lit(0.25) * top))
        .when(F.col("has_critical") & (key9(top) >= 0.70),
              F.greatest(base, F.lit(0.65) * top + F.lit(0.35) * base))
        .otherwise(base)
    )
    ca, cp, cr = key9(wa * a), key9(wp * p), key9(wr * r)
    t = t.withColumn("cri", rnd(clamp(key9(cri)), 3))
    return t.withColumns({
        "risk_level": risk_band(F.col("cri")),
        "driver": F.when(F.col("has_cross") & (a < 0.25) & (p >= 0.55), "Cross-Signal Divergence (Intake vs. Placements)")
        .when((ca >= cp) & (ca >= cr), "Admissions Collapse")
        .when(cp >= cr, "Placement Degradation").otherwise("Ranking & Cutoff Drift"),
        "confidence": F.when(F.col("n_adm") >= 3, 0.92).otherwise(0.75),
    })


def score_profiles(t: DataFrame, profiles) -> DataFrame:
    """Un-amplified index under several weight profiles (array of structs profile, wa, wp, wr)."""
    return t.withColumn("_w", F.explode(profiles)).withColumns({
        "profile": F.col("_w.profile"),
        "cri": rnd(clamp(key9(F.col("_w.wa") * F.col("adm_threat") + F.col("_w.wp") * F.col("plc_threat")
                              + F.col("_w.wr") * F.col("rnk_threat"))), 3)}).drop("_w")


def cri_single(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, keys: list[str],
               profile: WeightProfile = DEFAULT_PROFILE, with_anomalies: bool = True) -> DataFrame:
    t = threats(admissions, placements, ranking, keys)
    if with_anomalies:
        t = t.join(anomaly_flags(all_anomalies(admissions, placements, ranking, keys, cross=True), keys), keys, "left")
        t = t.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_cross", "has_critical")})
    return score_single(t, profile)


def all_anomalies(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, keys: list[str],
                  cross: bool) -> DataFrame:
    cols = [*keys, *A.COLS]
    out = (
        A.admissions_anomalies(admissions, keys).select(cols)
        .unionByName(A.placement_anomalies(placements, keys).select(cols))
        .unionByName(A.rank_anomalies(ranking, keys).select(cols))
    )
    return out.unionByName(A.divergence_anomalies(admissions, placements, keys).select(cols)) if cross else out


def anomaly_flags(anoms: DataFrame, keys: list[str]) -> DataFrame:
    return anoms.groupBy(*keys).agg(
        F.bool_or(F.col("signal_name").contains("Cross-Signal")).alias("has_cross"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("has_critical"),
        F.count("*").alias("n_anomalies"))


def cri_rollup(dept_scores: DataFrame, critical_depts: list[str], keys: list[str] = INST) -> DataFrame:
    """Intake-weighted mean of department indices, +.05 when a named core department is CRITICAL."""
    w = F.col("latest_intake")
    group = (F.when(F.col("driver").contains("Admissions"), "A").when(F.col("driver").contains("Placement"), "P")
             .otherwise("R"))
    share = lambda g: F.sum(F.when(group == g, w).otherwise(0)).alias(f"_{g}")
    g = dept_scores.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("cri") * w), F.sum(w).cast("double")).alias("_m"),
        F.bool_or((F.col("risk_level") == "CRITICAL") & F.col("department").isin(critical_depts)).alias("_crit"),
        F.count("*").alias("n_depts"), F.sum(w).alias("total_intake"), share("A"), share("P"), share("R"))
    m = F.coalesce("_m", F.lit(0.0))
    cri = F.when(F.col("_crit"), F.least(F.lit(1.0), m + 0.05)).otherwise(m)
    return g.withColumn("cri", rnd(key9(cri), 3)).select(
        *keys, "cri", risk_band(F.col("cri")).alias("risk_level"),
        F.when((F.col("_A") >= F.col("_P")) & (F.col("_A") >= F.col("_R")), "Admissions Degradation")
        .when(F.col("_P") >= F.col("_R"), "Placements Degradation").otherwise("Ranking Degradation").alias("driver"),
        F.lit(0.94).alias("confidence"), "n_depts", "total_intake")


def cri_dynamic(signals: DataFrame) -> DataFrame:
    """Mean over domains of the mean risk contribution; .22 when nothing carries a risk value."""
    dom = signals.groupBy(*INST, "domain").agg(
        F.avg("risk_contribution").alias("_m"), F.min("seq").alias("_s"),
        F.sum("confidence").alias("_c"), F.count("*").alias("_n"))
    m9 = key9(F.col("_m"))
    g = dom.groupBy(*INST).agg(
        F.avg("_m").alias("_cri"),
        F.max_by(F.when(m9.isNotNull(), F.col("domain")), F.struct(m9, -F.col("_s"))).alias("_top"),
        F.count("*").alias("n_domains"), (F.sum("_c") / F.sum("_n")).alias("_conf"))
    return g.withColumn("cri", F.when(F.col("_cri").isNull(), 0.22).otherwise(rnd(clamp(key9(F.col("_cri"))), 3))).select(
        *INST, "cri", risk_band(F.col("cri")).alias("risk_level"),
        F.when(F.col("_cri").isNull(), "General Institutional Monitoring")
        .otherwise(F.concat(F.initcap(F.translate("_top", "_", " ")), F.lit(" Domain Risk"))).alias("driver"),
        clamp(rnd(key9(F.col("_conf")), 2), 0.5, 1.0).alias("confidence"), "n_domains")


def assess(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame,
           critical_depts: list[str], profile: WeightProfile = DEFAULT_PROFILE) -> DataFrame:
    """One assessment per institution: roll-up, single stream, or dynamic-only, by what data it has."""
    anoms = all_anomalies(admissions, placements, ranking, INST, cross=False)
    cross = A.divergence_anomalies(admissions, placements, INST).select(*INST, *A.COLS)
    t = threats(admissions, placements, ranking, INST)
    flags = anomaly_flags(anoms, INST)
    flags_x = anomaly_flags(anoms.unionByName(cross), INST)

    single = score_single(
        t.where("n_depts <= 1").join(flags_x, INST, "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_cross", "has_critical")}), profile
    ).select(*INST, "cri", "risk_level", "driver", "confidence",
             F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"), F.lit("single_stream").alias("mode"))

    multi_ids = t.where("n_depts > 1").select(*INST)
    dept = score_single(threats(admissions, placements, ranking, DEPT).where("n_adm > 0"), profile)
    multi = (
        cri_rollup(dept.join(multi_ids, INST, "left_semi"), critical_depts).join(flags, INST, "left")
        .select(*INST, "cri", "risk_level", "driver", "confidence",
                F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"), F.lit("department_rollup").alias("mode"))
    )
    dyn_anoms = A.dynamic_anomalies(signals)
    n_dyn = dyn_anoms.groupBy(*INST).agg(F.count("*").alias("_nd"))
    non_canonical = signals.where(~F.col("domain").isin("admissions", "placements", "ranking")).select(*INST).distinct()
    canonical = single.unionByName(multi).join(
        n_dyn.join(non_canonical, INST, "left_semi"), INST, "left"
    ).select(*INST, "cri", "risk_level", "driver", "confidence",
             (F.col("n_anomalies") + F.coalesce("_nd", F.lit(0))).alias("n_anomalies"), "mode")
    dynamic = (
        cri_dynamic(signals).join(t.select(*INST), INST, "left_anti").join(n_dyn, INST, "left")
        .select(*INST, "cri", "risk_level", "driver", "confidence",
                F.coalesce("_nd", F.lit(0)).alias("n_anomalies"), F.lit("dynamic_only").alias("mode"))
    )
    return canonical.unionByName(dynamic)


def yearly_scores(admissions: DataFrame, placements: DataFrame, ranking: DataFrame,
                  critical_depts: list[str], profile: WeightProfile = DEFAULT_PROFILE) -> DataFrame:
    """Index of every (institution, year) computed from that year's rows alone, all years in one job.

    Departments carry one row per year, so no history exists inside a slice and ranks add no threat.
    """
    ky = [*INST, "academic_year"]
    a = admissions
    p = placements.withColumn("academic_year", F.col("graduation_year"))
    td = threats(a, p, ranking, [*ky, "department"]).where("n_adm > 0")
    d = score_single(td, profile)
    multi = cri_rollup(d, critical_depts, ky)
    one = d.groupBy(*ky).agg(F.count("*").alias("_k"), F.first("cri").alias("_c"), F.first("risk_level").alias("_l"))
    return multi.join(one, ky).select(
        *ky, F.when(F.col("_k") == 1, F.col("_c")).otherwise(F.col("cri")).alias("cri"),
        F.when(F.col("_k") == 1, F.col("_l")).otherwise(F.col("risk_level")).alias("risk_level"))


def risk_trend(yearly: DataFrame, admissions: DataFrame, placements: DataFrame, last_years: int | None = None) -> DataFrame:
    """The years (or the last few) per institution with average vacancy and placement, and the overall direction."""
    ky = [*INST, "academic_year"]
    a = admissions.groupBy(*ky).agg(rnd(key9(F.avg("vacancy_rate")), 4).alias("avg_vacancy"))
    p = placements.groupBy(*INST, F.col("graduation_year").alias("academic_year")).agg(
        rnd(key9(F.avg("placement_percentage")), 2).alias("avg_placement"))
    w = W.partitionBy(*INST)
    if last_years is not None:
        yearly = yearly.withColumn("_rk", F.row_number().over(w.orderBy(F.desc("academic_year")))).where(F.col("_rk") <= last_years).drop("_rk")
    pts = yearly.join(a, ky, "left").join(p, ky, "left")
    full = w.orderBy("academic_year").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    delta = rnd(F.last("cri").over(full) - F.first("cri").over(full), 3)
    return pts.withColumn("delta", delta).withColumn(
        "direction", F.when(F.col("delta") > 0.03, "worsening").when(F.col("delta") < -0.03, "improving")
        .otherwise("stable"))


def version_assessments(assessments: DataFrame, admissions: DataFrame, placements: DataFrame, ranking: DataFrame,
                        signals: DataFrame, ingestions: DataFrame) -> DataFrame:
    """Attach the dataset state key (hash of counts and latest ingestion) that identifies an assessment version."""
    parts = [admissions.select(*INST, F.lit("adm").alias("k")), placements.select(*INST, F.lit("plc").alias("k")),
             ranking.select(*INST, F.lit("cet").alias("k")), signals.select(*INST, F.lit("sig").alias("k"))]
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    n = lambda k: F.count_if(F.col("k") == k).alias(f"n_{k}")
    counts = u.groupBy(*INST).agg(n("adm"), n("plc"), n("cet"), n("sig"))
    last = ingestions.groupBy(*INST).agg(F.max_by("ingestion_id", F.struct("created_at", "ingestion_id")).alias("last_ing"))
    state = F.concat_ws(":", "institution_id", "n_cet", "n_adm", "n_plc", "n_sig", F.coalesce("last_ing", F.lit("")))
    return assessments.join(counts, INST).join(last, INST, "left").withColumn(
        "version_key", F.substring(F.sha2(state, 256), 1, 16))
