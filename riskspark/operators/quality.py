"""Data-quality audit of long signals (Q01-Q06, Q08-Q10)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskspark.functions.num import key9, rnd

BUCKET = ["institution_id", "department", "program", "period", "metric_name"]


UNDATED = "time_period IS NULL AND academic_year IS NULL"


def undated_signals(signals: DataFrame, refs: int = 5) -> DataFrame:
    """Per institution: how many signals carry neither period nor year, and the locations of the first ``refs`` of them.

    ``undated_locations`` lists all of them. Spark keeps the first rows of every institution within each partition, so no step gathers a whole group.
    """
    u = signals.where(UNDATED)
    w = W.partitionBy("institution_id").orderBy(F.asc_nulls_last("seq"), F.asc_nulls_last("location"))
    first = u.select("institution_id", "seq", "location").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= refs)
    first = first.groupBy("institution_id").agg(F.array_sort(F.collect_list(F.struct("_n", "location"))).alias("_r"))
    n = u.groupBy("institution_id").agg(F.count("*").alias("n_undated"))
    n = n.join(first, n.institution_id.eqNullSafe(first.institution_id)).drop(first.institution_id)
    return n.select("institution_id", F.lit("missing_periods").alias("issue_type"), F.lit("MEDIUM").alias("severity"), "n_undated",
                    F.transform("_r", lambda x: x["location"]).alias("refs"))


def undated_locations(signals: DataFrame) -> DataFrame:
    """Where the undated signals stand: one row each, with the number that orders them."""
    return signals.where(UNDATED).select("institution_id", "seq", "location")


def year_gaps(signals: DataFrame) -> DataFrame:
    """Missing years between the first and last observed year of each institution."""
    y = signals.where("academic_year IS NOT NULL").select("institution_id", "academic_year").distinct()
    span = y.groupBy("institution_id").agg(F.min("academic_year").alias("a"), F.max("academic_year").alias("b"))
    full = span.select("institution_id", F.explode(F.sequence("a", "b")).alias("academic_year"))
    return full.join(y, ["institution_id", "academic_year"], "left_anti").select(
        "institution_id", F.lit("missing_periods").alias("issue_type"), F.col("academic_year").alias("missing_year"))


def outdated(signals: DataFrame, as_of_year: int) -> DataFrame:
    """Institutions whose latest year is three or more years before ``as_of_year``."""
    return signals.groupBy("institution_id").agg(F.max("academic_year").alias("latest_year")).where(
        F.col("latest_year") <= as_of_year - 3).select(
        "institution_id", F.lit("outdated_data").alias("issue_type"), "latest_year",
        (F.lit(as_of_year) - F.col("latest_year")).alias("years_behind"))


def single_domain(signals: DataFrame) -> DataFrame:
    return signals.groupBy("institution_id").agg(
        F.min("domain").alias("affected_domain"), F.max("domain").alias("_x")).where(
        F.col("affected_domain") == F.col("_x")).select(
        "institution_id", F.lit("incomplete_coverage").alias("issue_type"), "affected_domain")


def bucketed(signals: DataFrame) -> DataFrame:
    """Existing and new signals with bucket keys and the value's text form."""
    val = F.when(F.col("value").isNotNull(), F.format_string("%.4f", rnd(F.col("value"), 4))).otherwise(
        F.lower(F.trim("raw_value")))
    period = F.coalesce(F.col("academic_year").cast("string"), F.col("time_period"), F.lit("UNSPECIFIED")) \
        if "time_period" in signals.columns else F.coalesce(F.col("academic_year").cast("string"), F.lit("UNSPECIFIED"))
    return signals.withColumns({
        "institution_id": F.coalesce("institution_id", F.lit("UNSCOPED")),
        "department": F.coalesce("department", F.lit("INSTITUTIONAL")), "program": F.coalesce("program", F.lit("ALL")),
        "period": period, "val_repr": val})


def value_groups(b: DataFrame) -> DataFrame:
    """Counts per bucket and value: the combined form that every duplicate and contradiction rule reads."""
    return b.groupBy(*BUCKET, "val_repr").agg(
        F.count("*").alias("n"), F.count_if("is_new").alias("n_new"), F.min("domain").alias("domain"))


def duplicate_issues(groups: DataFrame) -> DataFrame:
    """Values repeated in a bucket that received at least one new row."""
    touched = groups.groupBy(*BUCKET).agg(F.sum("n_new").alias("_t"))
    return groups.where("n >= 2").join(touched.where("_t > 0"), BUCKET, "left_semi").select(
        *BUCKET, "val_repr", F.lit("duplicates").alias("issue_type"), F.lit("LOW").alias("severity"),
        F.col("n").alias("n_observations"), "n_new")


def flag_duplicates(b: DataFrame, groups: DataFrame) -> DataFrame:
    """New rows with ``is_duplicate`` set where their value occurs twice or more in the bucket."""
    dup = groups.where("n >= 2").select(*BUCKET, "val_repr", F.lit(True).alias("is_duplicate"))
    return b.where("is_new").join(dup, [*BUCKET, "val_repr"], "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def contradiction_issues(groups: DataFrame) -> DataFrame:
    """Buckets with two or more distinct values and at least one new row; ``contradiction_values`` lists all their values."""
    g = groups.groupBy(*BUCKET).agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_observations"), F.sum("n_new").alias("_new"),
        F.min("domain").alias("domain"), F.min("val_repr").alias("first_value"), F.max("val_repr").alias("last_value"))
    gid = F.concat(F.lit("contra_"), F.substring(F.sha2(F.concat_ws("|", *BUCKET), 256), 1, 10))
    return g.where("n_values >= 2 AND _new > 0").drop("_new").withColumns({
        "issue_type": F.lit("contradictory_sources"), "severity": F.lit("HIGH"), "contradiction_group_id": gid})


def contradiction_values(b: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row, old and new, of the contradictory buckets with its value and where it was found, under the issue's group id."""
    source = [c for c in ("unit", "document", "ingestion_id", "location", "confidence") if c in b.columns]
    return flag_contradictions(b, groups).where("is_contradictory").select(
        "contradiction_group_id", *BUCKET, "signal_id", "val_repr", "value", "raw_value", *source)


def flag_contradictions(b: DataFrame, groups: DataFrame) -> DataFrame:
    """All rows, old and new, with the shared group id of a contradictory bucket."""
    c = contradiction_issues(groups).select(*BUCKET, "contradiction_group_id")
    return b.join(c, BUCKET, "left").withColumn("is_contradictory", F.col("contradiction_group_id").isNotNull())


def quality_report(signals: DataFrame, snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per institution over flagged signals, canonical snapshots and issues."""
    s = signals.groupBy("institution_id").agg(
        F.count("*").alias("n_signals"), F.count_if("is_contradictory").alias("n_contradictory"),
        F.count_if("is_duplicate").alias("n_duplicate"), F.countDistinct("domain").alias("n_domains"))
    c = snapshots.groupBy("institution_id").agg(F.count("*").alias("n_snapshots"))
    i = issues.groupBy("institution_id").agg(F.count("*").alias("n_issues"))
    d = s.join(c, "institution_id", "full").join(i, "institution_id", "full")
    return d.select("institution_id", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in (
        "n_snapshots", "n_signals", "n_contradictory", "n_duplicate", "n_domains", "n_issues")])


def list_datasets(signals: DataFrame, selections: DataFrame) -> DataFrame:
    """One row per ingestion; the selected one is active, else the newest of the institution."""
    per = signals.groupBy("institution_id", "ingestion_id").agg(
        F.count("*").alias("total_signals"), F.countDistinct("domain").alias("n_domains"),
        F.array_join(F.array_sort(F.collect_set(F.col("academic_year").cast("string"))), ",").alias("periods"),
        F.max("ts").alias("_ts"))
    newest = per.groupBy("institution_id").agg(F.max_by("ingestion_id", F.struct("_ts", "ingestion_id")).alias("_new"))
    d = per.join(newest, "institution_id").join(selections, "institution_id", "left")
    return d.withColumn("is_active", F.col("ingestion_id") == F.coalesce("selected_id", "_new")).drop(
        "_ts", "_new", "selected_id")


def ingestion_stats(signals: DataFrame) -> DataFrame:
    """Evidenced context, mean confidence and domain count per ingestion."""
    return signals.groupBy("ingestion_id").agg(
        F.count("*").alias("n_signals"), F.count("department").alias("n_department"),
        F.count("academic_year").alias("n_period"), rnd(key9(F.avg("confidence")), 3).alias("mean_confidence"),
        F.countDistinct("domain").alias("n_domains"))
