"""Institutional memory: extraction, hypotheses from feedback, overview."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.functions.num import key9, rnd
from riskspark.operators.baseline import SERIES
from riskspark.operators.intel import fixed

INST = ["institution_id"]
# Memory category of each statement class, and the hypothesis status a verdict gives.
CATEGORY = {"OBSERVED_FACT": "observed_fact", "STATISTICAL_INFERENCE": "inference", "CORRELATION": "analysis", "ANALYSIS": "analysis",
            "HYPOTHESIS": "inference", "FORECAST": "prediction", "RECOMMENDATION": "recommendation", "UNKNOWN": "unknown"}
VERDICTS = {"Confirmed": "VALIDATED", "Incorrect": "REJECTED", "Insufficient Evidence": "INSUFFICIENT_EVIDENCE"}


def memory_entries(statements: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Statements and outcome comparisons as keyed ledger entries with the series they are about and a JSON payload.

    The key is a hash of institution, series, class and text; of entries with one key the most confident stays.
    """
    cat = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    text = lambda c: F.coalesce(c, F.lit(""))
    s = statements.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "institution_id", text("domain"), text("metric_name"), text("dept_key"), "statement_class", "statement"), 256), 1, 16)).alias("memory_id"),
        *SERIES, cat[F.col("statement_class")].alias("category"), "statement", "confidence", F.to_json(F.struct("statement_class")).alias("payload"))
    o = comparisons.select(
        F.concat_ws("_", F.lit("out"), "institution_id", "target_year", "metric_name").alias("memory_id"), *INST,
        F.lit(None).cast("string").alias("domain"), "metric_name", F.lit(None).cast("string").alias("dept_key"), F.lit("outcome").alias("category"),
        F.format_string("%s in %d: predicted %s, observed %s", "metric_name", "target_year", fixed("predicted_value", 4), fixed("observed_value", 4)).alias("statement"),
        F.col("accuracy").alias("confidence"), F.to_json(F.struct("target_year", "within_band")).alias("payload"))
    cols = [*SERIES, "category", "statement", "payload"]
    return s.unionByName(o).groupBy("memory_id").agg(F.max_by(F.struct(*cols), "confidence").alias("_r"), F.max("confidence").alias("confidence")).select(
        "memory_id", *[F.col(f"_r.{c}").alias(c) for c in cols], "confidence")


def memory_references(memory: DataFrame, signals: DataFrame) -> DataFrame:
    """The observations behind every entry on a series: one row each with document and year."""
    seen = signals.where("value IS NOT NULL AND NOT is_duplicate").select(
        "institution_id", "domain", "metric_name", F.coalesce("department", F.lit("")).alias("dept_key"), "document", "academic_year", "seq")
    return memory.select("memory_id", *SERIES).join(seen, SERIES).select("memory_id", "document", "academic_year", "seq")


def append_feedback(memory: DataFrame, feedback: DataFrame) -> DataFrame:
    """Store feedback in its own category, with its target and verdict as payload; it never becomes an observation."""
    none = F.lit(None).cast("string")
    f = feedback.select(
        F.concat(F.lit("fb_"), F.col("feedback_id").cast("string")).alias("memory_id"), *INST, none.alias("domain"), none.alias("metric_name"), none.alias("dept_key"),
        F.lit("user_feedback").alias("category"), F.col("comment").alias("statement"), F.to_json(F.struct("target_id", "verdict")).alias("payload"), F.lit(0.5).alias("confidence"))
    return memory.unionByName(f)


def memory_view(memory: DataFrame, feedback: DataFrame, category: str | None = None) -> DataFrame:
    """Entries with category and status (of one category, if given): inferences take the status that their latest feedback gives.

    Without feedback they are under review; entries of other categories are recorded as they are; feedback on nothing known becomes an inference.
    """
    verdict = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    last = feedback.groupBy("target_id").agg(F.max_by(F.struct("verdict", "comment", "institution_id"), F.col("feedback_id")).alias("_f")).select(
        "target_id", F.col("_f.verdict").alias("verdict"), F.col("_f.comment").alias("comment"), F.col("_f.institution_id").alias("_i"))
    inferred = F.col("category") == "inference"
    known = memory.join(last, inferred & (memory.memory_id == last.target_id), "left").select(
        "memory_id", *INST, "category", "statement", F.when(~inferred, "RECORDED").otherwise(F.coalesce(verdict[F.col("verdict")], F.lit("UNDER_REVIEW"))).alias("status"))
    orphan = last.join(memory.where(inferred).select(F.col("memory_id").alias("target_id")), "target_id", "left_anti").select(
        F.col("target_id").alias("memory_id"), F.col("_i").alias("institution_id"), F.lit("inference").alias("category"),
        F.coalesce("comment", F.concat(F.lit("Reviewed finding "), F.col("target_id"))).alias("statement"),
        F.coalesce(verdict[F.col("verdict")], F.lit("INSUFFICIENT_EVIDENCE")).alias("status"))
    view = known.unionByName(orphan)
    return view if category is None else view.where(F.col("category") == category)


def category_counts(memory: DataFrame) -> DataFrame:
    return memory.groupBy(*INST, "category").agg(F.count("*").alias("n_entries"), rnd(key9(F.avg("confidence")), 3).alias("mean_confidence"))


def overview(assessments: DataFrame, forecast_points: DataFrame, insights: DataFrame, k: int | None = None) -> DataFrame:
    """Status band, outlook now and after one to three years, and the findings of each institution, worst first (the k worst, if given)."""
    at = lambda i: F.max(F.when(F.col("year_offset") == i, F.col("projected_cri"))).alias(f"year{i}_cri")
    pts = forecast_points.groupBy(*INST).agg(at(1), at(2), at(3))
    top = (insights if k is None else insights.where(F.col("position") <= k)).groupBy(*INST).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "position", F.concat_ws(": ", "severity", "signal_name", "metric_name").alias("t")))), lambda x: x["t"]).alias("top_findings"))
    n = insights.withColumn("_n", F.lit(1)).groupBy(*INST).agg(F.count("*").alias("n_findings"))
    band = (F.when(F.col("cri") >= 0.70, "critical").when(F.col("cri") >= 0.50, "elevated").when(F.col("cri") >= 0.30, "watch")
            .otherwise("stable"))
    return assessments.join(pts, INST, "left").join(top, INST, "left").join(n, INST, "left").select(
        *INST, "cri", "risk_level", band.alias("status_band"), "n_anomalies", "year1_cri", "year2_cri", "year3_cri",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("top_findings", F.array().cast("array<string>")).alias("top_findings"))
