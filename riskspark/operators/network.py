"""Organization-wide summaries, patterns and comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.functions.num import key9, rnd

INST = ["institution_id"]
ORG = ["organization_id"]
GROUP_CATEGORIES = ["educational_group_network", "nonprofit_trust_society_foundation", "government_public_body",
                    "private_organization"]
GROUP_TYPES = ["organization", "group", "educational_group_network"]


def hierarchy_summary(hierarchy: DataFrame, admissions: DataFrame, placements: DataFrame, ranking: DataFrame,
                      signals: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Department and program nodes with counts and latest metrics; nodes without data stay.

    A later stream's metrics count as latest only when its last year is not before that of the earlier streams.
    """
    code = lambda c, d: F.upper(F.trim(F.coalesce(c, F.lit(d))))
    k = [*INST, "node_code"]
    y = F.col("academic_year")
    a = admissions.groupBy(*INST, code("department", "GENERAL").alias("node_code")).agg(
        F.count("*").alias("_na"), F.max(y).alias("_ya"), F.max_by("vacancy_rate", y).alias("vacancy_rate"),
        F.max_by("enrolled_count", y).cast("double").alias("enrolled_count"))
    p = placements.groupBy(*INST, code("department", "GENERAL").alias("node_code")).agg(
        F.count("*").alias("_np"), F.max(y).alias("_yp"), F.max_by("placement_percentage", y).alias("placement_percentage"),
        F.max_by("median_salary_lpa", y).alias("median_salary_lpa"))
    c = ranking.groupBy(*INST, code("department", "GENERAL").alias("node_code")).agg(
        F.count("*").alias("_nc"), F.max(y).alias("_yc"), F.max_by("closing_rank", y).cast("double").alias("closing_rank"))
    s = signals.groupBy(*INST, code("department", "INSTITUTIONAL").alias("node_code")).agg(
        F.count("*").alias("_ns"), F.max(y).alias("_ys"), F.countDistinct("domain").alias("_ds"))
    x = anomalies.where("department IS NOT NULL").groupBy(*INST, code("department", "").alias("node_code")).agg(
        F.count("*").alias("anomaly_count"))
    h = hierarchy.select(*INST, code("code", "").alias("node_code"), "node_name", "node_type")
    d = a.join(p, k, "full").join(c, k, "full").join(s, k, "full").join(h, k, "full").join(x, k, "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    has = lambda n: (zero(n) > 0).cast("int")
    y1, y2 = F.col("_ya"), F.greatest("_ya", "_yp")
    later = lambda c, y0: F.coalesce(c >= y0, c.isNotNull())
    plc, cet = later(F.col("_yp"), y1), later(F.col("_yc"), y2)
    return d.select(
        *k, F.coalesce("node_name", "node_code").alias("node_name"), F.coalesce("node_type", F.lit("department")).alias("node_type"),
        (zero("_na") + zero("_np") + zero("_nc") + zero("_ns")).alias("signal_count"),
        (has("_na") + has("_np") + has("_nc") + zero("_ds")).alias("n_domains"),
        F.greatest("_ya", "_yp", "_yc", "_ys").alias("latest_year"), "vacancy_rate", "enrolled_count",
        F.when(plc, F.col("placement_percentage")).alias("placement_percentage"),
        F.when(plc, F.col("median_salary_lpa")).alias("median_salary_lpa"),
        F.when(cet, F.col("closing_rank")).alias("closing_rank"), zero("anomaly_count").alias("anomaly_count"))


def constituent_summary(institutions: DataFrame, assessments: DataFrame, ladder: DataFrame, forecasts: DataFrame,
                        canonical_counts: DataFrame, signal_counts: DataFrame) -> DataFrame:
    """One row per institution of the network, also for those without data."""
    d = (
        institutions.join(assessments.select(*INST, "cri", "risk_level", "driver", "n_anomalies"), INST, "left")
        .join(ladder.select(*INST, "overall_stage"), INST, "left")
        .join(forecasts.select(*INST, F.col("status").alias("forecast_status"), "terminal_cri", "n_periods"), INST, "left")
        .join(canonical_counts, INST, "left").join(signal_counts, INST, "left")
    )
    n = F.coalesce("n_canonical", F.lit(0)) + F.coalesce("n_dynamic", F.lit(0))
    has = n > 0
    return d.select(
        *ORG, *INST, "institution_type", has.alias("has_data"), n.alias("signal_count"),
        F.when(has, F.coalesce("n_periods", F.lit(0))).otherwise(0).cast("bigint").alias("n_periods"),
        F.when(has, F.col("cri")).alias("cri"),
        F.when(has, F.col("risk_level")).otherwise("INSUFFICIENT_DATA").alias("risk_level"),
        F.when(has, F.col("overall_stage")).otherwise("insufficient_evidence").alias("risk_stage"),
        F.when(has, F.col("driver")).otherwise("No data ingested yet").alias("driver"),
        F.when(has, F.col("n_anomalies")).otherwise(0).cast("bigint").alias("n_anomalies"),
        F.when(has, F.col("forecast_status")).otherwise("INSUFFICIENT_EVIDENCE").alias("forecast_status"),
        F.when(has, F.col("terminal_cri")).alias("year3_cri"))


def constituents(institutions: DataFrame) -> DataFrame:
    """Institutions of every organization without its own container row, where it has other members."""
    is_org = F.col("institution_id") == F.col("organization_id")
    box = is_org & (F.col("entity_category").isin(GROUP_CATEGORIES) | F.col("entity_type").isin(GROUP_TYPES))
    kids = institutions.where(~is_org).select(*ORG).distinct().withColumn("_kids", F.lit(True))
    d = institutions.withColumn("_box", F.coalesce(box, F.lit(False))).join(kids, ORG, "left")
    return d.where(~F.col("_box") | F.col("_kids").isNull()).drop("_box", "_kids")


def metric_cooccurrence(evaluated: DataFrame, institutions: DataFrame) -> DataFrame:
    """Metrics anomalous in two or more institutions of an organization."""
    e = evaluated.join(institutions.select(*INST, *ORG), INST)
    g = e.groupBy(*ORG, F.lower(F.trim("domain")).alias("domain"), "metric_name").agg(
        F.countDistinct("institution_id").alias("n_institutions"), F.count("*").alias("n_anomalies"),
        F.min("latest_period").alias("first_year"), F.max("latest_period").alias("last_year"))
    return g.where("n_institutions >= 2").withColumn("pattern_type", F.lit("CO_OCCURRING_ANOMALY"))


def domain_pressure(evaluated: DataFrame, changes: DataFrame, institutions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Domains under pressure in two or more institutions that no metric pattern covers."""
    dom = F.lower(F.trim("domain")).alias("domain")
    an = evaluated.select(*INST, dom, "metric_name")
    ws = changes.where("direction = 'WORSENING'").select(*INST, dom, "metric_name")
    # worsening signals count only where the institution has no anomaly in the domain
    extra = ws.join(an.select(*INST, "domain").distinct(), [*INST, "domain"], "left_anti")
    u = an.unionByName(extra).join(institutions.select(*INST, *ORG), INST)
    g = u.groupBy(*ORG, "domain").agg(F.countDistinct("institution_id").alias("n_institutions"),
                                      F.countDistinct("metric_name").alias("n_metrics"))
    return g.where("n_institutions >= 2").join(patterns.select(*ORG, "domain").distinct(), [*ORG, "domain"], "left_anti").withColumn(
        "pattern_type", F.lit("SHARED_DOMAIN_PRESSURE"))


def divergent_network(summaries: DataFrame) -> DataFrame:
    """Organizations with both elevated and LOW institutions among two or more with data."""
    s = summaries.where("has_data AND cri IS NOT NULL")
    g = s.groupBy(*ORG).agg(
        F.count("*").alias("n_populated"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_elevated"),
        F.count_if(F.col("risk_level") == "LOW").alias("n_low"))
    return g.where("n_populated >= 2 AND n_elevated > 0 AND n_low > 0")


def _stats(v: str):
    x = F.col(v)
    return [F.count(x).alias("n_compared"), rnd(F.min(x), 4).alias("min_value"), rnd(F.max(x), 4).alias("max_value"),
            rnd(key9(F.avg(x)), 4).alias("mean_value"), rnd(F.max(x) - F.min(x), 4).alias("spread")]


def compare_cri(summaries: DataFrame) -> DataFrame:
    """Range and mean of the index per organization and how many institutions are excluded for lack of data."""
    v = F.when(F.col("has_data"), F.col("cri"))
    g = summaries.withColumn("_v", v).groupBy(*ORG).agg(
        *_stats("_v"), F.count_if(F.col("_v").isNull()).alias("n_excluded"))
    return g.where("n_compared >= 2")


def latest_metrics(baselines: DataFrame, signals: DataFrame) -> DataFrame:
    """One value per (institution, domain, metric): the baseline's latest, replaced by a signal of the same or a later year."""
    k = [*INST, "domain", "metric_name"]
    dom = F.lower(F.trim("domain")).alias("domain")
    b = baselines.where("latest_value IS NOT NULL").groupBy(*INST, dom, "metric_name").agg(
        F.max_by(F.struct("latest_value", "latest_period"), F.col("dept_key")).alias("_b"))
    s = signals.where("value IS NOT NULL AND academic_year IS NOT NULL").groupBy(*INST, dom, "metric_name").agg(
        F.max_by(F.struct("value", "academic_year"), F.struct("academic_year", "seq")).alias("_s"))
    d = b.join(s, k, "full")
    newer = F.col("_s").isNotNull() & (F.col("_b").isNull() | F.col("_b.latest_period").isNull()
                                       | (F.col("_s.academic_year") >= F.col("_b.latest_period")))
    return d.select(*k, F.when(newer, F.col("_s.value")).otherwise(F.col("_b.latest_value")).alias("observed_value"),
                    F.when(newer, F.col("_s.academic_year")).otherwise(F.col("_b.latest_period")).alias("academic_year"))


def compare_metrics(metrics: DataFrame, institutions: DataFrame) -> DataFrame:
    """Metrics reported by two or more institutions of an organization, with range, mean and spread."""
    m = metrics.join(institutions.select(*INST, *ORG), INST).withColumn("_v", rnd(F.col("observed_value"), 4))
    return m.groupBy(*ORG, "domain", "metric_name").agg(*_stats("_v")).where("n_compared >= 2")


def metric_exclusions(metrics: DataFrame, institutions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Institutions that do not report a compared metric of their organization."""
    want = comparisons.select(*ORG, "domain", "metric_name").join(institutions.select(*ORG, *INST), ORG)
    return want.join(metrics, [*INST, "domain", "metric_name"], "left_anti")


def network_totals(summaries: DataFrame) -> DataFrame:
    """Counts, coverage, gaps and the network level per organization."""
    n = lambda c: F.count_if(c)
    g = summaries.groupBy(*ORG).agg(
        F.count("*").alias("n_institutions"), n(F.col("has_data")).alias("n_with_data"),
        n(F.col("n_periods") >= 2).alias("n_multi_year"), n(F.col("n_periods") < 3).alias("n_gaps"),
        F.sum("signal_count").alias("n_signals"), F.countDistinct("institution_type").alias("n_types"),
        *[n(F.col("risk_level") == x).alias("n_" + x.lower()) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        rnd(key9(F.avg("cri")), 4).alias("mean_cri"), rnd(F.max("cri"), 4).alias("max_cri"),
        F.max_by("institution_id", F.struct("cri", "institution_id")).alias("_top"))
    c = F.col("max_cri")
    return g.select(
        "*", rnd(F.col("n_with_data") / F.col("n_institutions"), 4).alias("coverage_ratio"),
        F.when(c.isNull(), "INSUFFICIENT_DATA").when(c >= 0.75, "CRITICAL").when(c >= 0.55, "HIGH").when(c >= 0.35, "MEDIUM")
        .otherwise("LOW").alias("network_level"), F.when(c.isNotNull(), F.col("_top")).alias("highest_institution")).drop("_top")


def org_signal_listing(institutions: DataFrame, snapshots: DataFrame, signals: DataFrame) -> DataFrame:
    """Canonical and reported signal counts of every institution of an organization."""
    c = snapshots.groupBy(*INST).agg(F.count("*").alias("n_snapshots"))
    s = signals.groupBy(*INST).agg(F.count("*").alias("n_discovered"))
    d = institutions.select(*ORG, *INST).join(c, INST, "left").join(s, INST, "left").fillna(0, ["n_snapshots", "n_discovered"])
    return d.withColumn("n_total", F.col("n_snapshots") + F.col("n_discovered"))
