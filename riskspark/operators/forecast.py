"""Index trajectories, what-if, change explanation, outcome comparison and hindcast."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions.num import clamp, key9, rnd
from riskspark.operators import features as FT, risk as R

INST = ["institution_id"]
MOMENTUM, SPREAD = 0.15, 0.08
# Weight of each slope in the yearly drift of the index.
SLOPE_WEIGHTS = {
    "vacancy_rate_slope": 0.40,
    "placement_pct_slope": -0.35,
    "closing_rank_slope": 0.25,
    "dynamic_risk_slope": 0.30,
}
SLOPES = list(SLOPE_WEIGHTS)


def drift(cols: dict[str, Column]) -> Column:
    """Yearly change of the index."""
    total = F.lit(0.0)
    for name, c in cols.items():
        total = total + F.lit(SLOPE_WEIGHTS[name]) * c
    return F.lit(MOMENTUM) * total


def project(base: DataFrame, years: int, cri: str = "cri", drift_col: str = "drift",
            scenario: str = "STATUS_QUO") -> DataFrame:
    """Trajectory points. The drift is constant, so the step-wise clamped recursion equals clamp(c0 + k*d)."""
    k = F.col("year_offset")
    pt = clamp(F.col(cri) + k * F.col(drift_col))
    band = k * SPREAD
    return (
        base.withColumn("year_offset", F.explode(F.sequence(F.lit(1), F.lit(years))))
        .withColumn("_p", pt)
        .withColumns({
            "projected_cri": rnd(key9(F.col("_p")), 6),
            "band_low": rnd(key9(clamp(F.col("_p") - band)), 6),
            "band_high": rnd(key9(clamp(F.col("_p") + band)), 6),
            "scenario": F.lit(scenario),
        }).drop("_p")
    )


def with_drift(assessments: DataFrame, slopes: DataFrame) -> DataFrame:
    s = slopes
    for c in SLOPES:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(0.0))
    s = s.select(*INST, *SLOPES)
    j = assessments.join(s, INST, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in SLOPES})
    return j.withColumn("drift", drift({c: F.col(c) for c in SLOPES}))


def what_if(assessments: DataFrame, slopes: DataFrame, scenarios: list[tuple], years: int) -> DataFrame:
    """Apply every intervention scenario to every institution.

    ``scenarios`` holds (name, vacancy_reduction, placement_boost, rank_stabilization, dynamic_reduction); the
    short literal list travels inside the plan and is exploded per row, so nothing is joined.
    """
    names = ["name", *SLOPES]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in scenarios])
    d = with_drift(assessments, slopes).withColumn("_s", F.explode(rows))
    sign = {"vacancy_rate_slope": -1, "placement_pct_slope": 1, "closing_rank_slope": -1, "dynamic_risk_slope": -1}
    d = d.withColumns({c: F.col(c) + F.lit(float(sign[c])) * F.col(f"_s.{c}") for c in SLOPES})
    d = d.withColumns({"intervention": F.col("_s.name"), "drift": drift({c: F.col(c) for c in SLOPES})}).drop("_s")
    return project(d, years, scenario="WITH_INTERVENTION")


def slopes_from_features(features: DataFrame) -> DataFrame:
    """Department feature vector to forecast slopes (vacancy x10, rank /1000)."""
    return features.select(
        *INST, "department", rnd(F.col("vacancy_rate_slope") * 10.0, 6).alias("vacancy_rate_slope"),
        "placement_pct_slope", (F.col("closing_rank_slope") / 1000.0).alias("closing_rank_slope"),
        F.lit(0.0).alias("dynamic_risk_slope"))


def explainable_forecast(assessments: DataFrame, coverage: DataFrame, signals: DataFrame, years: int = 3) -> DataFrame:
    """Status, terminal projection and confidence per institution; no projection below two periods."""
    contra = signals.where("is_contradictory").groupBy(*INST).agg(F.count("*").alias("_x"))
    d = with_drift(assessments.select(*INST, "cri"), coverage).join(
        coverage.select(*INST, "n_periods", "n_domains", "n_observations", "coverage_ratio", "is_sufficient"), INST
    ).join(contra, INST, "left")
    conf = (
        F.lit(0.45) + F.least(F.lit(0.35), (F.col("n_periods") - 1) * 0.15)
        + F.least(F.lit(0.20), F.col("n_domains") * 0.06)
        - F.least(F.lit(0.20), F.coalesce("_x", F.lit(0)) * 0.05)
    )
    ok = F.col("is_sufficient")
    return d.select(
        *INST, F.when(ok, "SUFFICIENT_EVIDENCE").otherwise("INSUFFICIENT_EVIDENCE").alias("status"),
        F.when(ok, F.col("cri")).alias("current_cri"),
        F.when(ok, rnd(key9(clamp(F.col("cri") + years * F.col("drift"))), 4)).alias("terminal_cri"),
        F.when(ok, rnd(key9(clamp(conf, 0.35, 0.92)), 2)).otherwise(0.0).alias("confidence"),
        "n_periods", "n_domains", "n_observations", "coverage_ratio", *SLOPES)


def drivers(forecasts: DataFrame) -> DataFrame:
    """One row per slope with its yearly contribution and direction."""
    items = F.array(*[
        F.struct(F.lit(n).alias("driver"), F.col(n).alias("slope_value"), F.lit(w).alias("weight"))
        for n, w in SLOPE_WEIGHTS.items()])
    c = rnd(key9(F.lit(MOMENTUM) * F.col("weight") * F.col("slope_value")), 6)
    return (
        forecasts.where("status = 'SUFFICIENT_EVIDENCE'").select(*INST, F.inline(items))
        .withColumn("contribution", c)
        .withColumn("direction", F.when(F.col("contribution") > 0.0005, "WORSENING_RISK")
                    .when(F.col("contribution") < -0.0005, "IMPROVING_RISK").otherwise("NEUTRAL"))
    )


# ---- histories cut at earlier years -----------------------------------------------------------

SEP = "@"


def cut_histories(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame,
                  cutoffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Replicate each history once per (institution, cutoff), keeping the years up to the cutoff.

    The pair becomes the institution key, so every downstream operator evaluates all cutoffs in one job.
    The growth is the number of cutoffs per institution, i.e. of distinct years.
    """
    def cut(df: DataFrame, year: str) -> DataFrame:
        j = df.join(cutoffs, INST).where(F.col(year) <= F.col("cutoff"))
        return j.withColumn("institution_id", F.concat("institution_id", F.lit(SEP), F.col("cutoff"))).drop("cutoff")
    return (cut(admissions, "academic_year"), cut(placements, "academic_year"),
            cut(ranking, "academic_year"), cut(signals, "academic_year"))


def split_cutoff(df: DataFrame) -> DataFrame:
    parts = F.split("institution_id", SEP)
    return df.withColumns({"cutoff": parts[1].cast("int"), "institution_id": parts[0]})


def observed_years(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame) -> DataFrame:
    y = [x.select(*INST, "academic_year") for x in (admissions, placements, ranking, signals)]
    return y[0].unionByName(y[1]).unionByName(y[2]).unionByName(y[3]).distinct()


def last_cutoffs(years: DataFrame, n: int = 2, min_years: int = 2) -> DataFrame:
    """The last ``n`` observed years of every institution with at least ``min_years`` of them."""
    w = W.partitionBy(*INST)
    return years.select(*INST, "academic_year").distinct().withColumns({
        "_n": F.row_number().over(w.orderBy(F.desc("academic_year"))), "_k": F.count("*").over(w)}).where(
        (F.col("_n") <= n) & (F.col("_k") >= min_years)).select(*INST, F.col("academic_year").alias("cutoff"))


def state_at_cutoffs(admissions, placements, ranking, signals, cutoffs: DataFrame, critical_depts: list[str],
                     outlook_slopes: bool = False) -> DataFrame:
    """Index, slopes and coverage of every (institution, cutoff).

    ``outlook_slopes`` selects the slopes without vacancy scaling and dynamic term that the outlook rule uses.
    """
    a, p, c, s = cut_histories(admissions, placements, ranking, signals, cutoffs)
    cov = FT.slopes_and_coverage(a, p, c, s)
    if outlook_slopes:
        slopes = FT.slopes_with_fallback(a, p, c, s)
        return split_cutoff(with_drift(R.assess(a, p, c, s, critical_depts).select(*INST, "cri"), slopes))
    return split_cutoff(with_drift(R.assess(a, p, c, s, critical_depts).select(*INST, "cri"), cov).join(
        cov.select(*INST, "n_periods", "is_sufficient"), INST))


def explain_change(states: DataFrame, years: int = 3) -> DataFrame:
    """Inputs that moved between the last two cutoffs and their effect on the terminal index.

    ``states`` carries two cutoffs per institution; institutions with fewer are left out.
    """
    items = F.array(
        F.struct(F.lit("current_cri").alias("input_name"), F.col("cri").alias("v"), F.lit(None).cast("double").alias("w")),
        *[F.struct(F.lit(n).alias("input_name"), F.col(n).alias("v"), F.lit(w).alias("w"))
          for n, w in SLOPE_WEIGHTS.items()])
    long = states.select(*INST, "cutoff", F.inline(items))
    g = long.groupBy(*INST, "input_name").agg(
        F.count("*").alias("_n"), F.min_by("v", "cutoff").alias("previous_value"),
        F.max_by("v", "cutoff").alias("current_value"), F.max("w").alias("w"))
    delta = rnd(F.col("current_value") - F.col("previous_value"), 6)
    return g.where("_n = 2").withColumn("delta", delta).where(F.abs("delta") > 1e-6).select(
        *INST, "input_name", "previous_value", "current_value", "delta",
        F.when(F.col("w").isNull(), F.col("delta"))
        .otherwise(rnd(key9(years * F.lit(MOMENTUM) * F.col("w") * F.col("delta")), 4)).alias("impact"))


def compare_outcomes(pairs: DataFrame) -> DataFrame:
    """Errors, band hit and accuracy of predicted against observed values."""
    p, o = F.col("predicted_value"), F.col("observed_value")
    lo = F.coalesce("band_low", F.greatest(F.lit(0.0), p - 0.08))
    hi = F.coalesce("band_high", F.least(F.lit(1.0), p + 0.08))
    err = rnd(key9(o - p), 4)
    a = F.abs(F.col("signed_error"))
    as_index = (F.col("metric_name") == "composite_risk_index") | (p.between(0.0, 1.0) & o.between(0.0, 1.0))
    return pairs.withColumn("signed_error", err).withColumns({
        "absolute_error": a,
        "within_band": (o >= lo - 1e-6) & (o <= hi + 1e-6),
        "accuracy": rnd(key9(F.greatest(F.lit(0.0), F.when(as_index, 1.0 - a).otherwise(
            1.0 - a / F.greatest(F.abs(o), F.abs(p), F.lit(1.0))))), 4),
    })


def hindcast(states: DataFrame) -> DataFrame:
    """Forecast one step from every cutoff with two or more periods and compare with the next observed index."""
    order = W.partitionBy(*INST).orderBy("cutoff")  # a row for each observed year
    base = states.withColumns({"target_year": F.lead("cutoff").over(order), "observed_value": F.lead("cri").over(order)})
    j = project(base.where("is_sufficient AND target_year IS NOT NULL"), 1).select(
        *INST, "cutoff", "target_year", F.lit("composite_risk_index").alias("metric_name"),
        F.col("projected_cri").alias("predicted_value"), "observed_value", "band_low", "band_high")
    return compare_outcomes(j)


def prediction_headline(assessments: DataFrame, slopes: DataFrame, years_seen: DataFrame) -> DataFrame:
    """Direction of the three-year outlook per institution, or INSUFFICIENT_EVIDENCE below two periods."""
    n = years_seen.groupBy(*INST).agg(F.countDistinct("academic_year").alias("n_periods"))
    d = with_drift(assessments.select(*INST, "cri", "confidence"), slopes).join(n, INST)
    y3 = rnd(key9(clamp(F.col("cri") + 3 * F.col("drift"))), 6)
    ok = F.col("n_periods") >= 2
    d = d.withColumns({"year3_cri": y3}).withColumn("shift", rnd(key9(F.col("year3_cri") - F.col("cri")), 3))
    return d.select(
        *INST, F.when(ok, "SUCCESS").otherwise("INSUFFICIENT_EVIDENCE").alias("status"),
        F.when(~ok, "insufficient history").when(F.col("shift") > 0.03, "projected to increase")
        .when(F.col("shift") < -0.03, "projected to decline").otherwise("projected to remain stable").alias("headline"),
        F.when(ok, F.col("cri")).otherwise(0.0).alias("current_cri"),
        F.when(ok, F.col("year3_cri")).alias("year3_cri"),
        F.when(ok, rnd(F.col("confidence"), 2)).otherwise(0.0).alias("confidence"), "n_periods")


def outlook_changes(states: DataFrame) -> DataFrame:
    """Three-year outlook of the full history against the history one year shorter; moves beyond .02."""
    out = states.withColumn("_y3", rnd(key9(clamp(F.col("cri") + 3 * F.col("drift"))), 4))
    g = out.groupBy(*INST).agg(
        F.count("*").alias("_n"), F.min_by("_y3", "cutoff").alias("previous_outlook"),
        F.max_by("_y3", "cutoff").alias("current_outlook"), F.max("cutoff").alias("as_of_year"))
    d = rnd(F.col("current_outlook") - F.col("previous_outlook"), 4)
    return g.where("_n = 2").withColumn("delta", d).select(
        *INST, "as_of_year", "previous_outlook", "current_outlook", "delta",
        F.when(F.col("delta") > 0.02, "WORSENED").when(F.col("delta") < -0.02, "IMPROVED").otherwise("STABLE")
        .alias("direction"))
