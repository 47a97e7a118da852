"""Statistical anomalies of the latest observation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.functions.num import key9, rnd
from riskspark.operators.features import zscore_vs_history

COLS = ["signal_name", "academic_year", "metric_name", "observed_value", "baseline_value",
        "deviation_zscore", "severity", "description"]


def _emit(df: DataFrame, keys: list[str], name: str, year: str, metric: str, value, critical, desc) -> DataFrame:
    return df.select(
        *keys, F.lit(name).alias("signal_name"), F.col(year).alias("academic_year"),
        F.lit(metric).alias("metric_name"), value.cast("double").alias("observed_value"),
        rnd(F.col("hist_mean"), 4).alias("baseline_value"), rnd(F.col("zscore"), 2).alias("deviation_zscore"),
        F.when(critical, "CRITICAL").otherwise("HIGH").alias("severity"), desc.alias("description"))


def _latest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return zscore_vs_history(df, keys, order, value).where("is_last AND hist_n >= 1")


def admissions_anomalies(admissions: DataFrame, keys: list[str]) -> DataFrame:
    """Enrolment drops: z <= -2 with vacancy >= 15 %, or vacancy >= 40 % outright."""
    d = _latest(admissions, keys, ["academic_year", "department"], "enrolled_count")
    z, v = key9(F.col("zscore")), F.col("vacancy_rate")
    return _emit(
        d.where(((z <= -2.0) & (v >= 0.15)) | (v >= 0.40)), keys, "Admissions", "academic_year", "enrolled_count",
        F.col("enrolled_count"), (z <= -3.0) | (v >= 0.55),
        F.format_string("Enrolment fell to %d (vacancy %.1f%%, z %.2f)", "enrolled_count", v * 100, "zscore"))


def placement_anomalies(placements: DataFrame, keys: list[str]) -> DataFrame:
    """Placement collapse: z <= -2 below 75 %, or below 50 % outright."""
    d = _latest(placements, keys, ["graduation_year", "department"], "placement_percentage")
    z, p = key9(F.col("zscore")), F.col("placement_percentage")
    return _emit(
        d.where(((z <= -2.0) & (p < 75.0)) | (p < 50.0)), keys, "Placements", "graduation_year",
        "placement_percentage", p, (z <= -3.0) | (p < 35.0),
        F.format_string("Placement rate fell to %.1f%% (z %.2f)", p, "zscore"))


def rank_anomalies(ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Closing-rank slippage against the historical mean; a higher rank number is worse."""
    d = _latest(ranking, keys, ["academic_year", "department"], "closing_rank")
    z = key9(F.col("zscore"))
    slip = key9(F.when(F.col("hist_mean") > 0, (F.col("closing_rank") - F.col("hist_mean")) / F.col("hist_mean"))
                .otherwise(0.0))
    return _emit(
        d.where(((z >= 2.0) & (slip >= 0.15)) | (slip >= 0.50)), keys, "CET / Ranking", "academic_year",
        "closing_rank", F.col("closing_rank"), ((z >= 3.0) & (slip >= 0.30)) | (slip >= 0.75),
        F.format_string("Cut-off slipped to %d (z %.2f)", "closing_rank", "zscore"))


def divergence_anomalies(admissions: DataFrame, placements: DataFrame, keys: list[str]) -> DataFrame:
    """Seats stay full while placements collapse: growth gap between enrolled and placed students."""
    ao, po = F.struct("academic_year", "department"), F.struct("graduation_year", "department")
    a = admissions.groupBy(*keys).agg(
        F.count("*").alias("_na"), F.min_by("enrolled_count", ao).alias("e0"),
        F.max_by("enrolled_count", ao).alias("e1"), F.max_by("vacancy_rate", ao).alias("vac"))
    p = placements.groupBy(*keys).agg(
        F.count("*").alias("_np"), F.min_by("placed_students", po).alias("p0"),
        F.max_by("placed_students", po).alias("p1"), F.max_by("placement_percentage", po).alias("pct"),
        F.max("graduation_year").alias("year"))
    growth = lambda x0, x1: F.when(F.col(x0) > 0, (F.col(x1) - F.col(x0)) / F.col(x0) * 100.0).otherwise(0.0)
    d = a.join(p, keys).where("_na >= 2 AND _np >= 2").withColumn(
        "div", rnd((growth("e0", "e1") - growth("p0", "p1")) / 100.0, 4))
    hit = d.where((F.col("vac") < 0.20) & (F.col("pct") < 45.0) & (F.col("div") >= 0.40))
    return hit.select(
        *keys, F.lit("Cross-Signal Divergence").alias("signal_name"), F.col("year").alias("academic_year"),
        F.lit("intake_to_placed_divergence").alias("metric_name"), rnd(F.col("div"), 2).alias("observed_value"),
        F.lit(0.0).alias("baseline_value"), rnd(F.abs("div") * -4.0, 2).alias("deviation_zscore"),
        F.when((F.col("div") >= 0.60) | (F.col("pct") < 30.0), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.format_string("Seats %.1f%% filled but placements at %.1f%%", 100.0 - F.col("vac") * 100, "pct")
        .alias("description"))


def dynamic_anomalies(signals: DataFrame) -> DataFrame:
    """Contradictory or high-risk observations of any domain; canonical domains only when contradictory."""
    val, risk = F.col("value"), F.col("risk_contribution")
    canonical = F.col("domain").isin("admissions", "placements", "ranking")
    contra = F.col("is_contradictory") & val.isNotNull()
    base = F.when(contra, val).when(F.col("polarity") == "higher_is_better", 85.0).otherwise(10.0)
    title = F.initcap("domain")
    return signals.where(
        (~canonical | F.col("is_contradictory")) & val.isNotNull() & (contra | (risk >= 0.45))
    ).select(
        "institution_id", "signal_id", "domain",
        F.when(contra, F.concat(F.lit("Contradictory Source ("), title, F.lit(")")))
        .otherwise(F.concat(title, F.lit(" Intelligence"))).alias("signal_name"),
        F.coalesce("academic_year", F.lit(2025)).alias("academic_year"), "metric_name",
        val.alias("observed_value"), base.alias("baseline_value"),
        F.when(contra, -2.5).otherwise(rnd((val - base) / 10.0, 2)).alias("deviation_zscore"),
        F.when(contra, "HIGH").when(risk >= 0.75, "CRITICAL").when(risk >= 0.60, "HIGH").otherwise("MEDIUM")
        .alias("severity"),
        F.concat_ws(" ", "metric_label", F.lit("observed at"), "raw_value", F.lit("in"), "document")
        .alias("description"))
