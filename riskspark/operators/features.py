"""Per-department trend features and institution-level slopes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions.num import key9, pct_change, rnd, slope, unfavourable

INST = ["institution_id"]
DEPT = ["institution_id", "department"]


def zscore_vs_history(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """z-score of each row against the rows before it (sample deviation), plus history size and mean."""
    w = W.partitionBy(*keys).orderBy(*order)
    hist = w.rowsBetween(W.unboundedPreceding, -1)
    v = F.col(value).cast("double")
    mean, sd = F.avg(v).over(hist), F.stddev_samp(v).over(hist)
    return df.withColumns({
        "hist_n": F.count(v).over(hist),
        "hist_mean": mean,
        "zscore": F.when(sd > 1e-9, (v - mean) / sd).otherwise(0.0),
        "is_last": F.lead(F.lit(1)).over(w).isNull(),
    })


def period_change(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Percent change against the previous period."""
    v = F.col(value).cast("double")
    prev = F.lag(v).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("pct_change", F.coalesce(pct_change(prev, v), F.lit(0.0)))


def ols_slope(df: DataFrame, keys: list[str], order: list, value: str, out: str = "slope") -> DataFrame:
    """Slope over positions 0..n-1 in the given order (gaps between years are ignored)."""
    pos = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return (
        df.withColumn("_pos", pos)
        .groupBy(*keys)
        .agg(slope(F.col(value).cast("double"), F.col("_pos")).alias(out), F.count("*").alias("n_points"))
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Last row per key under a total order, as one hash aggregation instead of a sort."""
    rest = [c for c in cols if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def department_features(admissions: DataFrame, placements: DataFrame, ranking: DataFrame) -> DataFrame:
    """Feature vector for every department that has admissions rows.

    The three aggregations use the same keys, so their exchanges line up and the two joins add none.
    """
    def positioned(df: DataFrame, year: str) -> DataFrame:
        return df.withColumn("_pos", F.row_number().over(W.partitionBy(*DEPT).orderBy(year)) - 1)

    a = positioned(admissions, "academic_year").withColumn(
        "_prev", F.lag("enrolled_count").over(W.partitionBy(*DEPT).orderBy("academic_year")))
    y = F.col("academic_year")
    fa = a.groupBy(*DEPT).agg(
        F.max(y).alias("academic_year"), F.count("*").alias("n_adm"),
        F.max_by("vacancy_rate", y).alias("vac"),
        slope(F.col("vacancy_rate"), F.col("_pos")).alias("vac_slope"),
        F.min_by("enrolled_count", y).alias("enr_first"),
        F.max_by("enrolled_count", y).alias("enr_last"),
        F.max_by("_prev", y).alias("enr_prev"),
    )
    g = F.col("graduation_year")
    fp = positioned(placements, "graduation_year").groupBy(*DEPT).agg(
        F.count("*").alias("n_plc"),
        F.max_by("placement_percentage", g).alias("pct"),
        slope(F.col("placement_percentage"), F.col("_pos")).alias("pct_slope"),
        F.max_by(F.col("unplaced_count") / F.nullif(F.col("eligible_students"), F.lit(0)), g).alias("unplaced"),
        F.min_by("placed_students", g).alias("placed_first"),
        F.max_by("placed_students", g).alias("placed_last"),
    )
    fc = positioned(ranking, "academic_year").groupBy(*DEPT).agg(
        F.max_by(F.col("closing_rank").cast("double"), y).alias("rank"),
        slope(F.col("closing_rank").cast("double"), F.col("_pos")).alias("rank_slope"),
        (F.max_by("percentile_cutoff", y) - F.min_by("percentile_cutoff", y)).alias("pctl_delta"),
    )
    d = lambda c: F.col(c).cast("double")
    intake_growth = pct_change(d("enr_first"), d("enr_last"))
    placed_growth = pct_change(d("placed_first"), d("placed_last"))
    zero = F.lit(0.0)
    return fa.join(fp, DEPT, "left").join(fc, DEPT, "left").select(
        *DEPT, "academic_year",
        rnd(F.col("vac"), 4).alias("vacancy_rate_current"),
        rnd(F.col("vac_slope"), 6).alias("vacancy_rate_slope"),
        rnd(F.when(F.col("n_adm") >= 2, pct_change(d("enr_prev"), d("enr_last"))).otherwise(zero), 2)
        .alias("enrollment_delta_pct"),
        rnd(F.coalesce("pct", zero), 2).alias("placement_pct_current"),
        rnd(F.coalesce("pct_slope", zero), 4).alias("placement_pct_slope"),
        rnd(F.when(F.col("n_plc").isNull(), 1.0).otherwise(F.coalesce("unplaced", zero)), 4)
        .alias("unplaced_ratio_current"),
        F.coalesce("rank", zero).alias("closing_rank_current"),
        rnd(F.coalesce("rank_slope", zero), 2).alias("closing_rank_slope"),
        rnd(F.coalesce("pctl_delta", zero), 2).alias("percentile_delta"),
        rnd(F.when((F.col("n_adm") >= 2) & (F.col("n_plc") >= 2), (intake_growth - placed_growth) / 100.0)
            .otherwise(zero), 4).alias("intake_to_placed_divergence"),
        (F.col("n_adm") < 3).alias("sparse_flag"),
    )


def weighted_slopes(features: DataFrame, admissions: DataFrame, vacancy_scale: float = 1.0) -> DataFrame:
    """Institution slopes as the intake-weighted mean of its departments' slopes.

    With one department the weights cancel, so the shortcut of the definition needs no branch.
    """
    intake = admissions.groupBy(*DEPT).agg(F.max_by("sanctioned_intake", "academic_year").alias("_w"))
    f = features.join(intake, DEPT)
    mean = lambda c: F.coalesce(
        F.try_divide(F.sum(c * F.col("_w")), F.sum("_w").cast("double")), F.lit(0.0))
    return f.groupBy(*INST).agg(
        rnd(key9(mean(F.col("vacancy_rate_slope") * vacancy_scale)), 6).alias("vacancy_rate_slope"),
        rnd(key9(mean(F.col("placement_pct_slope"))), 4).alias("placement_pct_slope"),
        rnd(key9(mean(F.col("closing_rank_slope") / 1000.0)), 4).alias("closing_rank_slope"),
        F.count("*").alias("n_departments"),
    )


def dynamic_slope(signals: DataFrame) -> DataFrame:
    """(mean risk of the last year - mean risk of the first) / span, per institution, duplicates excluded."""
    yearly = (
        signals.where(~F.col("is_duplicate") & F.col("risk_contribution").isNotNull()
                      & F.col("academic_year").isNotNull())
        .groupBy(*INST, "academic_year").agg(F.avg("risk_contribution").alias("_m"))
    )
    y = F.col("academic_year")
    return yearly.groupBy(*INST).agg(
        rnd(key9(F.when(F.count("*") >= 2, F.try_divide(F.max_by("_m", y) - F.min_by("_m", y),
                                                        (F.max(y) - F.min(y)).cast("double")))
                 .otherwise(0.0)), 6).alias("dynamic_risk_slope"))


def slopes_and_coverage(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame,
                        features: DataFrame | None = None) -> DataFrame:
    """Forecast inputs per institution: slopes (vacancy x10), distinct periods, domains, observation count."""
    features = features if features is not None else department_features(admissions, placements, ranking)
    s = weighted_slopes(features, admissions, vacancy_scale=10.0).drop("n_departments")
    obs = (
        admissions.select(*INST, "academic_year", F.lit("admissions").alias("domain"))
        .unionByName(placements.select(*INST, "academic_year", F.lit("placements").alias("domain")))
        .unionByName(ranking.select(*INST, "academic_year", F.lit("admissions").alias("domain")))
        .unionByName(signals.select(*INST, "academic_year", "domain"))
    )
    # partial counts first: one small row per (institution, year, domain) reaches the second shuffle
    cov = (
        obs.groupBy(*INST, "academic_year", "domain").agg(F.count("*").alias("_n"))
        .groupBy(*INST).agg(
            F.countDistinct("academic_year").alias("n_periods"),
            F.countDistinct("domain").alias("n_domains"),
            F.sum("_n").alias("n_observations"))
    )
    zero = F.lit(0.0)
    return (
        cov.join(s, INST, "left").join(dynamic_slope(signals), INST, "left")
        .select(
            *INST,
            *[F.coalesce(c, zero).alias(c) for c in
              ("vacancy_rate_slope", "placement_pct_slope", "closing_rank_slope", "dynamic_risk_slope")],
            "n_periods", "n_domains", "n_observations",
            rnd(F.least(F.lit(1.0), F.col("n_periods") / 3.0), 4).alias("coverage_ratio"),
            (F.col("n_periods") >= 2).alias("is_sufficient"),
        )
    )


def slopes_with_fallback(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame
                         ) -> DataFrame:
    """Weighted slopes, or for institutions without features the slope of yearly mean risk."""
    have = weighted_slopes(department_features(admissions, placements, ranking), admissions).drop("n_departments")
    yearly = signals.where(F.col("risk_contribution").isNotNull() & F.col("academic_year").isNotNull()).groupBy(
        *INST, "academic_year").agg(F.avg("risk_contribution").alias("m"))
    dyn = ols_slope(yearly, INST, ["academic_year"], "m", "_s")
    fallback = dyn.join(have, INST, "left_anti").select(
        *INST, rnd(key9(F.col("_s")), 4).alias("vacancy_rate_slope"),
        rnd(key9(F.col("_s") * -20.0), 4).alias("placement_pct_slope"),
        F.lit(0.0).alias("closing_rank_slope"))
    return have.unionByName(fallback)


def yearly_rollup(admissions: DataFrame, placements: DataFrame) -> DataFrame:
    """Institution totals per year: vacancy and placement percent."""
    a = admissions.groupBy(*INST, "academic_year").agg(
        F.sum("sanctioned_intake").alias("_i"), F.sum("enrolled_count").alias("_e"))
    p = placements.groupBy(*INST, F.col("graduation_year").alias("academic_year")).agg(
        F.sum("eligible_students").alias("_g"), F.sum("placed_students").alias("_p"))
    return a.join(p, [*INST, "academic_year"], "full").select(
        *INST, "academic_year",
        rnd(F.try_divide((F.col("_i") - F.col("_e")) * 100.0, F.col("_i")), 2).alias("vacancy_pct"),
        rnd(F.try_divide(F.col("_p") * 100.0, F.col("_g")), 2).alias("placement_pct"))


def worsening_streak(series: DataFrame, keys: list[str], order: str, value: str, polarity: Column) -> DataFrame:
    """Length of the trailing run of unfavourable period-over-period moves (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    pos = F.row_number().over(w)
    bad = F.coalesce(unfavourable(d, polarity), F.lit(False))
    return (
        series.withColumns({"_bad": bad, "_pos": pos})
        .groupBy(*keys)
        .agg((F.max("_pos") - F.max(F.when(~F.col("_bad"), F.col("_pos")))).cast("int").alias("streak"),
             F.count("*").alias("n_periods"))
    )
