"""Provenance records, dossiers, insight catalog and claim grounding."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions.num import rnd

INST = ["institution_id"]


def signal_provenance(signals: DataFrame) -> DataFrame:
    """Seven-field record of each signal with the documented fallbacks."""
    period = F.coalesce(F.col("time_period"), F.when(F.col("academic_year").isNotNull(), F.concat(F.lit("AY "), F.col("academic_year"))),
                        F.lit("Period unspecified"))
    dept = F.when(F.col("department").isNotNull(), F.concat(F.lit(", Dept: "), F.col("department"))).otherwise("")
    return signals.select(
        F.concat_ws("_", F.lit("prov_dyn"), "signal_id").alias("evidence_id"),
        F.coalesce("source", F.lit("UNIVERSAL_INGESTION_PIPELINE")).alias("source"),
        F.coalesce("document", F.lit("Uploaded Institutional Document")).alias("document"),
        F.coalesce("page_or_section", F.lit("Primary Section")).alias("page_or_section"),
        F.coalesce("location", F.lit("Document Body / Structured Table")).alias("cell_or_range"),
        F.coalesce("excerpt", F.concat_ws(": ", "metric_label", "raw_value")).alias("excerpt"),
        rnd(F.col("confidence"), 4).alias("extraction_confidence"),
        F.concat(period, dept, F.lit(" ("), F.coalesce("institution_id", F.lit("Institutional Record")), F.lit(")")).alias("date_or_context"),
        "domain", "metric_name", F.col("value").alias("observed_value"))


def anomaly_provenance(anomalies: DataFrame, signals: DataFrame, canonical: DataFrame) -> DataFrame:
    """Best source of each anomaly: first matching signal, else the canonical row of its year, else the ledger.

    Signals collapse to the first per (institution, year, metric, domain) before the name test, so the join size is
    bounded by the metric vocabulary and not by the number of observations.
    """
    a = anomalies.withColumn("_id", F.xxhash64("institution_id", "signal_name", "academic_year", "metric_name"))
    vocab = signals.groupBy(*INST, F.col("academic_year").alias("_y"), F.col("metric_name").alias("_m"),
                            F.lower("domain").alias("_dom")).agg(F.min_by(F.struct("signal_id", "document"), F.col("seq")).alias("_s"),
                                                                F.min("seq").alias("_q"))
    m, x = F.col("metric_name"), F.col("_m")
    fits = (m == x) | F.contains(m, x) | F.contains(x, m) | F.contains(F.lower("signal_name"), F.col("_dom"))
    # Dated signals meet anomalies of their year; undated ones, which fit any year, are a second, small join.
    dated = a.join(vocab.where("_y IS NOT NULL"), [a["institution_id"] == vocab["institution_id"], a["academic_year"] == vocab["_y"]]).drop(vocab["institution_id"])
    dyn = dated.unionByName(a.join(vocab.where("_y IS NULL"), INST)).where(fits)
    best = dyn.groupBy("_id").agg(F.min_by("_s", "_q").alias("_s")).select("_id", "_s.*")
    stream = (F.when(F.lower("signal_name").contains("admission"), "admissions")
              .when(F.lower("signal_name").contains("placement"), "placements")
              .when(F.lower("signal_name").rlike("cet|rank"), "ranking"))
    first = canonical.groupBy(*INST, "academic_year", F.col("domain").alias("_stream")).agg(F.min("department").alias("_dept"))
    d = a.join(best, "_id", "left").withColumn("_stream", stream).join(first, [*INST, "academic_year", "_stream"], "left")
    return d.select(
        *INST, "signal_name", "academic_year", "metric_name", "observed_value", "baseline_value",
        F.when(F.col("signal_id").isNotNull(), "signal").when(F.col("_dept").isNotNull(), "canonical").otherwise("ledger").alias("matched"),
        F.coalesce("document", F.concat("institution_id", F.lit("_canonical_ledger"))).alias("document"),
        F.coalesce("signal_id", F.concat(F.initcap("_stream"), F.lit("["), F.col("_dept"), F.lit(", AY"), F.col("academic_year"), F.lit("]")),
                   F.concat(F.lit("Table["), F.col("metric_name"), F.lit("]"))).alias("cell_or_range"))


def dossier(assessments: DataFrame, anomalies: DataFrame, signals: DataFrame, canonical: DataFrame, samples: int | None = None) -> DataFrame:
    """Coverage, anomaly and contradiction counts, metrics (the first ones seen, if `samples` is given) and missing domains per institution."""
    cov = (
        canonical.select(*INST, "domain").unionByName(signals.select(*INST, "domain")).distinct()
        .groupBy(*INST).agg(F.collect_set("domain").alias("_have"))
    )
    n_anom = anomalies.groupBy(*INST).agg(F.count("*").alias("n_anomalies"))
    kinds = signals.groupBy(*INST, "domain", "metric_name").agg(F.min("seq").alias("_q"))
    if samples is not None:
        kinds = kinds.withColumn("_n", F.row_number().over(W.partitionBy(*INST).orderBy("_q"))).where(F.col("_n") <= samples)
    smp = kinds.groupBy(*INST).agg(F.array_sort(F.collect_list(F.concat_ws(".", "domain", "metric_name"))).alias("sampled_metrics"))
    con = signals.where("is_contradictory").groupBy(*INST).agg(F.count("*").alias("n_contradictions"))
    need = F.array(F.lit("admissions"), F.lit("placements"), F.lit("ranking"))
    d = assessments.select(*INST, "cri", "risk_level").join(cov, INST, "left").join(n_anom, INST, "left").join(smp, INST, "left").join(con, INST, "left")
    have = F.coalesce("_have", F.array().cast("array<string>"))
    return d.select(
        *INST, "cri", "risk_level", F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"),
        F.array_sort(have).alias("covered_domains"), F.array_except(need, have).alias("missing_domains"),
        F.coalesce("sampled_metrics", F.array().cast("array<string>")).alias("sampled_metrics"),
        F.coalesce("n_contradictions", F.lit(0)).alias("n_contradictions"))


SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def insight_catalog(anomalies: DataFrame, k: int | None = None) -> DataFrame:
    """Insights per (department, signal, metric): a trend over two or more periods or a single observation, worst first.

    ``k`` keeps the worst k of each institution; by default all stay.
    """
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv])
    g = anomalies.groupBy(*INST, "department", "signal_name", "metric_name").agg(
        F.countDistinct("academic_year").alias("n_periods"), F.count("*").alias("n_records"),
        F.min(F.struct("academic_year", "observed_value"))["observed_value"].alias("first_value"), F.max(F.struct("academic_year", "observed_value"))["observed_value"].alias("last_value"),
        F.min("academic_year").alias("first_year"), F.max("academic_year").alias("last_year"),
        F.min(rank[F.col("severity")]).alias("_r"))
    order = W.partitionBy(*INST).orderBy("_r", F.desc("n_records"), "signal_name", "metric_name", "department")
    out = g.withColumn("position", F.row_number().over(order))
    if k is not None:
        out = out.where(F.col("position") <= k)
    return out.withColumns({
        "kind": F.when(F.col("n_periods") >= 2, "trend").otherwise("single_period"),
        "severity": F.element_at(F.array(*[F.lit(x) for x in SEVERITY_ORDER]), F.col("_r") + 1)}).drop("_r")


def _slot(v: Column) -> Column:
    """Bucket of a number: half units below 8, 5 % steps above; an allowed range touches at most three buckets."""
    big = F.signum(v) * (F.floor(F.log(F.abs(v)) / F.log(F.lit(1.05))) + 1000)
    return F.when(F.abs(v) < 8.0, F.floor(v * 2.0).cast("double")).otherwise(big).cast("int")


def ground_claims(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every decimal number of a text and whether some allowed number of its institution lies within max(.15, 2 %).

    Range join on number buckets: each allowed value is filed under the buckets its range touches.
    """
    num = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])-?\d+\.\d+"), F.lit(0))
    claims = texts.select(*INST, "text_id", F.posexplode(num).alias("position", "_c")).withColumn("claim", F.col("_c").cast("double")).drop("_c")
    a = F.col("allowed")
    tol = F.greatest(F.lit(0.15), F.abs(a) * 0.02)
    ranges = allowed.select(*INST, "allowed").distinct().withColumns({"_lo": a - tol, "_hi": a + tol})
    mid = lambda edge: F.when((F.col("_lo") < edge) & (F.col("_hi") > edge), _slot(F.lit(edge)))
    slots = F.array_distinct(F.filter(F.array(_slot(F.col("_lo")), _slot(a), _slot(F.col("_hi")), mid(8.0), mid(-8.0)),
                                      lambda x: x.isNotNull()))
    ranges = ranges.withColumn("_b", F.explode(slots))
    c = claims.withColumn("_b", _slot(F.col("claim")))
    ok = c.join(ranges, [*INST, "_b"]).where(F.abs(F.col("claim") - a) <= tol).select("text_id", "position").distinct()
    return claims.join(ok.withColumn("_ok", F.lit(True)), ["text_id", "position"], "left").select(
        *INST, "text_id", "position", "claim", F.coalesce("_ok", F.lit(False)).alias("grounded"))
