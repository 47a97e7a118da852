"""Signal unification, historical baselines and multi-dimensional anomaly evaluation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions.num import key9, pct_change, rnd, slope, unfavourable, unfavourable_pct
from riskspark.functions.rules import domain_weight, related_domains

INST = ["institution_id"]
# Department is nullable ("institution-wide"); series are keyed by dept_key = coalesce(department, '').
SERIES = ["institution_id", "domain", "metric_name", "dept_key"]
SIGNAL_COLS = ["institution_id", "domain", "metric_name", "metric_label", "department", "academic_year", "value",
               "unit", "polarity", "risk_contribution", "is_contradictory", "is_duplicate", "confidence", "seq",
               "document"]
CANONICAL_SEQ = 1 << 40  # canonical rows arrive after every reported signal


def canonical_signals(admissions: DataFrame, placements: DataFrame, ranking: DataFrame) -> DataFrame:
    """Canonical rows as long signals: two admissions metrics, one placement and one ranking metric."""
    def row(domain, metric, label, value, unit, polarity, risk, order):
        return F.struct(
            F.lit(domain).alias("domain"), F.lit(metric).alias("metric_name"), F.lit(label).alias("metric_label"),
            value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(polarity).alias("polarity"),
            risk.cast("double").alias("risk_contribution"), F.lit(CANONICAL_SEQ + order).alias("seq"))
    none = F.lit(None)
    vac_risk = F.least(F.lit(1.0), F.col("vacancy_rate") * 1.5)
    a = admissions.select(*INST, "department", "academic_year", F.inline(F.array(
        row("admissions", "enrolled_count", "Enrolled Students", F.col("enrolled_count"), "count",
            "higher_is_better", vac_risk, 0),
        row("admissions", "vacancy_rate", "Seat Vacancy Rate", F.col("vacancy_rate"), "ratio",
            "lower_is_better", vac_risk, 1))))
    pct = F.col("placement_percentage")
    p = placements.select(*INST, "department", F.col("graduation_year").alias("academic_year"), F.inline(F.array(
        row("placements", "placement_percentage", "Placement Percentage", pct, "%", "higher_is_better",
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(100.0) - pct) / 100.0)), 2))))
    r = ranking.select(*INST, "department", "academic_year", F.inline(F.array(
        row("ranking", "closing_rank", "Entrance Closing Rank", F.col("closing_rank"), "rank",
            "lower_is_better", none, 3))))
    return a.unionByName(p).unionByName(r).withColumns({
        "is_contradictory": F.lit(False), "is_duplicate": F.lit(False), "confidence": F.lit(0.98),
        "document": F.concat(F.lit("canonical_"), F.col("domain"))})


def unify_signals(admissions: DataFrame, placements: DataFrame, ranking: DataFrame, signals: DataFrame) -> DataFrame:
    """Reported signals plus canonical rows that do not repeat an identical observation."""
    ident = ["institution_id", "domain", "metric_name", "_d", "academic_year", "_v"]
    keyed = lambda df: df.withColumns({
        "_d": F.upper(F.coalesce("department", F.lit("INSTITUTIONAL"))), "_v": rnd(F.col("value"), 4)})
    rep = signals.select(*SIGNAL_COLS)
    known = keyed(rep.where("value IS NOT NULL AND academic_year IS NOT NULL")).select(*ident).distinct()
    canon = keyed(canonical_signals(admissions, placements, ranking).select(*SIGNAL_COLS))
    first = W.partitionBy(*ident).orderBy("seq")
    fresh = (
        canon.join(known, ident, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .select(*SIGNAL_COLS)
    )
    return rep.unionByName(fresh)


def yearly_series(signals: DataFrame) -> DataFrame:
    """One row per series and year with every per-year pick the later rules need.

    Representative = highest extraction confidence, first on ties; ``first_value`` and ``last_value`` by arrival.
    """
    s = signals.where("value IS NOT NULL AND NOT is_duplicate").withColumn(
        "dept_key", F.coalesce("department", F.lit("")))
    return s.groupBy(*SERIES, "academic_year").agg(
        F.max_by("value", F.struct("confidence", -F.col("seq"))).alias("rep_value"),
        F.min_by("value", "seq").alias("first_value"),
        F.max_by(F.struct("value", "risk_contribution"), F.col("seq")).alias("_last"),
        (F.bool_or("is_contradictory") | (F.max("value") - F.min("value") > 1e-4)).alias("has_conflict"),
        F.bool_or("is_contradictory").alias("has_flag"),
        F.min_by(F.struct("metric_label", "unit", "polarity"), F.col("seq")).alias("_attrs"),
        F.min("seq").alias("first_seq"),
        F.count("*").alias("n_obs"),
    ).select("*", F.col("_last.value").alias("last_value"), F.col("_last.risk_contribution").alias("last_risk")).drop("_last")


def yearly_representative(signals: DataFrame) -> DataFrame:
    return yearly_series(signals).where("academic_year IS NOT NULL").select(*SERIES, "academic_year", "rep_value")


def build_baselines(series: DataFrame) -> DataFrame:
    """Historical baseline of every series from its yearly rows (at most one row per year and series)."""
    w = W.partitionBy(*SERIES).orderBy(F.col("academic_year").asc_nulls_first())
    dated = F.col("academic_year").isNotNull()
    y, rep = F.col("academic_year"), F.col("rep_value")
    pos = F.count(F.when(dated, 1)).over(w) - 1
    d = series.withColumns({
        "_pos": F.when(dated, pos), "_is_last": F.lead(F.lit(1)).over(w).isNull(),
        "_prev": F.lag(F.when(dated, rep)).over(w), "_prev_year": F.lag("academic_year").over(w)})
    prior = lambda c: F.when(dated & ~F.col("_is_last"), c)
    g = d.groupBy(*SERIES).agg(
        F.count("academic_year").alias("n_years"),
        F.min_by("_attrs", "first_seq").alias("_attrs"),
        F.bool_or(F.when(dated, F.col("has_conflict")).otherwise(F.col("has_flag"))).alias("has_contradictions"),
        F.avg(prior(rep)).alias("_mean"), F.stddev_samp(prior(rep)).alias("_std"),
        F.median(prior(rep)).alias("_med"), F.min(prior(rep)).alias("_min"), F.max(prior(rep)).alias("_max"),
        slope(F.when(dated, rep), F.col("_pos")).alias("_slope"),
        F.max(y).alias("latest_period"),
        F.max(F.when(F.col("_is_last"), rep)).alias("_latest_rep"),
        F.max(F.when(F.col("_is_last"), F.col("last_value"))).alias("_latest_any"),
        F.max(F.when(F.col("_is_last"), F.col("_prev"))).alias("_prior"),
        F.max(F.when(F.col("_is_last"), F.col("_prev_year"))).alias("_prior_year"),
    )
    n = F.col("n_years")
    est = lambda c, k=4: F.when(n >= 3, rnd(key9(c), k))
    return g.select(
        *SERIES, F.col("_attrs.metric_label").alias("metric_label"), F.col("_attrs.unit").alias("unit"),
        F.col("_attrs.polarity").alias("polarity"),
        F.when(n >= 3, "ESTABLISHED").when(F.col("has_contradictions"), "CONTRADICTORY_HISTORY")
        .when(n == 2, "TWO_PERIOD_COMPARISON_ONLY").otherwise("INSUFFICIENT_HISTORY").alias("baseline_status"),
        n.cast("int").alias("n_years"), est(F.col("_mean")).alias("baseline_mean"),
        est(F.coalesce("_std", F.lit(0.0))).alias("baseline_std"), est(F.col("_med")).alias("baseline_median"),
        est(F.col("_min")).alias("baseline_min"), est(F.col("_max")).alias("baseline_max"),
        F.when(n >= 2, rnd(key9(F.col("_slope")), 4)).alias("trend_slope"), "latest_period",
        rnd(F.when(n >= 1, F.col("_latest_rep")).otherwise(F.col("_latest_any")), 4).alias("latest_value"),
        F.when(n >= 2, F.col("_prior_year")).alias("prior_period"),
        F.when(n >= 2, rnd(F.col("_prior"), 4)).alias("prior_value"), "has_contradictions")


def anomaly_candidates(series: DataFrame, baselines: DataFrame) -> DataFrame:
    """Latest observation of every series against its comparison value; flags meaningful and notable moves."""
    w = W.partitionBy(*SERIES).orderBy(F.col("academic_year").asc_nulls_first())
    s = series.join(baselines.select(*SERIES, F.col("polarity").alias("_pol")), SERIES)
    step = F.col("first_value") - F.lag(F.when(F.col("academic_year").isNotNull(), F.col("first_value"))).over(w)
    s = s.withColumns({
        "_pos": F.row_number().over(w), "_bad": F.coalesce(unfavourable(step, F.col("_pol")), F.lit(False)),
        "_is_last": F.lead(F.lit(1)).over(w).isNull()})
    run = s.groupBy(*SERIES).agg(
        (F.max("_pos") - F.max(F.when(~F.col("_bad"), F.col("_pos")))).cast("int").alias("streak"),
        F.max(F.when(F.col("_is_last"), F.col("last_value"))).alias("observed_value"),
        F.coalesce(F.max(F.when(F.col("_is_last"), F.col("last_risk"))), F.lit(0.0)).alias("risk"))
    d = baselines.join(run, SERIES)
    obs, mean, sd = F.col("observed_value"), F.col("baseline_mean"), F.col("baseline_std")
    comp = F.coalesce(mean, F.col("prior_value"))
    z = F.when(mean.isNull(), None).when(sd > 1e-6, rnd(key9((obs - mean) / sd), 2)).when(
        F.abs(obs - mean) > 1e-4, F.when(obs > mean, 3.0).otherwise(-3.0)).otherwise(0.0)
    d = d.withColumns({
        "comparison_value": comp, "zscore": z,
        "unfav_pct": key9(F.coalesce(unfavourable_pct(comp, obs, F.col("polarity"), F.col("unit")), F.lit(0.0))),
        "absolute_delta": rnd(obs - comp, 4), "relative_pct_change": rnd(key9(pct_change(comp, obs)), 2)})
    worse = ((F.col("polarity") == "higher_is_better") & (F.col("zscore") < 0)) | (
        (F.col("polarity") == "lower_is_better") & (F.col("zscore") > 0))
    d = d.withColumn("unfav_z", F.when(worse, F.abs("zscore")).otherwise(0.0))
    u, uz, rk, st = F.col("unfav_pct"), F.col("unfav_z"), key9(F.col("risk")), F.col("streak")
    d = d.withColumns({
        "is_meaningful": (u >= 10.0) | (uz >= 1.8) | (rk >= 0.45) | ((st >= 2) & (u >= 5.0)),
        "is_notable": (u >= 4.0) | (uz >= 1.0) | (rk >= 0.30) | (st >= 1)})
    return d.where("is_meaningful OR is_notable").withColumn(
        "persistence", F.greatest(st, F.col("is_meaningful").cast("int")))


def dimension_scores(candidates: DataFrame, series: DataFrame, admissions: DataFrame) -> DataFrame:
    """Magnitude, deviation, persistence, coverage and materiality of the meaningful candidates."""
    depts = series.where("dept_key <> ''").groupBy(*INST).agg(F.countDistinct("dept_key").alias("_nd"))
    intake = admissions.groupBy(*INST, F.col("department").alias("dept_key")).agg(
        F.max_by("sanctioned_intake", "academic_year").alias("_w"))
    total = intake.groupBy(*INST).agg(F.sum("_w").alias("_tw"))
    m = candidates.where("is_meaningful")
    hit = m.where("dept_key <> ''").groupBy("institution_id", "domain", "metric_name").agg(
        F.count("*").alias("_hit"))
    d = (
        m.join(depts, INST, "left").join(hit, ["institution_id", "domain", "metric_name"], "left")
        .join(intake, ["institution_id", "dept_key"], "left").join(total, INST, "left")
    )
    mag = rnd(key9(F.greatest(F.least(F.lit(1.0), F.col("unfav_pct") / 35.0), F.col("risk"))), 3)
    short = F.col("baseline_status") == "INSUFFICIENT_HISTORY"
    p = F.when(short, 1).otherwise(F.col("persistence"))
    wide = (F.col("dept_key") == "") | (F.upper("dept_key") == "INSTITUTIONAL")
    base = domain_weight(F.col("domain"))
    share = F.col("_w") / F.col("_tw")
    return d.withColumn("magnitude", mag).withColumns({
        "deviation": F.when(F.col("zscore").isNotNull(), rnd(key9(F.least(F.lit(1.0), F.col("unfav_z") / 3.5)), 3))
        .otherwise(rnd(key9(F.least(F.lit(0.75), F.col("magnitude") * 0.8)), 3)),
        "persistence": p,
        "persistence_score": F.when(short, 0.20).when(p >= 3, 1.0).when(p == 2, 0.68).otherwise(0.28),
        "coverage": F.when(wide, 1.0).otherwise(
            rnd(key9(F.least(F.lit(1.0), F.coalesce("_hit", F.lit(1)) / F.greatest(F.coalesce("_nd", F.lit(1)), F.lit(1)))), 3)),
        "n_affected": F.when(wide, 0).otherwise(F.coalesce("_hit", F.lit(1))).cast("int"),
        "materiality": F.when(share.isNotNull(), rnd(key9(F.least(F.lit(1.0), base * (
            F.lit(0.75) + F.lit(0.50) * F.least(F.lit(0.5), share)))), 3)).otherwise(rnd(base, 3)),
    }).drop("_nd", "_hit", "_w", "_tw")


def tag(domain: str = "domain", metric: str = "metric_name", dept: str = "dept_key") -> Column:
    base = F.concat_ws(".", domain, metric)
    return F.when(F.col(dept) == "", base).otherwise(F.concat(base, F.lit(" ("), F.col(dept), F.lit(")")))


def dept_lookups(dept: str = "dept_key") -> Column:
    """Keys under which an item finds department-compatible partners: its own and the institution-wide ones,
    or every department ('*') for an institution-wide item. Turns the OR-ed match into an equi-join."""
    return F.when(F.col(dept) == "", F.array(F.lit("*"))).otherwise(F.array(F.col(dept), F.lit("")))


def cross_confirm(scored: DataFrame) -> DataFrame:
    """Attach the meaningful anomalies of related domains whose department is compatible.

    Tags are collected once per (institution, domain, department) before the join, so its size grows with the
    anomalies and not with their pairs.
    """
    tags = scored.select("institution_id", F.col("domain").alias("r_domain"),
                         F.explode(F.array(F.col("dept_key"), F.lit("*"))).alias("lk"), tag().alias("_t"))
    book = tags.groupBy("institution_id", "r_domain", "lk").agg(F.collect_set("_t").alias("_ts"))
    asks = (
        scored.select(*SERIES, F.explode(related_domains(F.col("domain"))).alias("r_domain"))
        .withColumn("lk", F.explode(dept_lookups()))
    )
    found = asks.join(book, ["institution_id", "r_domain", "lk"]).groupBy(*SERIES).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ts")))).alias("confirming"))
    return scored.join(found, SERIES, "left").withColumns({
        "confirming": F.coalesce("confirming", F.array().cast("array<string>")),
        "cross_confirmed": F.col("confirming").isNotNull()})


def classify_significance(confirmed: DataFrame) -> DataFrame:
    """Composite significance, five-step stage and severity."""
    x = F.col("cross_confirmed")
    m, d, p = F.col("magnitude"), F.col("deviation"), F.col("persistence")
    c, t, s = F.col("coverage"), F.col("materiality"), F.col("significance")
    sig = rnd(key9(F.least(F.lit(1.0), F.lit(0.25) * m + F.lit(0.20) * d + F.lit(0.20) * F.col("persistence_score")
                           + F.lit(0.15) * c + F.lit(0.10) * t + F.lit(0.10) * x.cast("double"))), 3)
    short = F.col("baseline_status") == "INSUFFICIENT_HISTORY"
    stage = (
        F.when(short & (m < 0.55), "Observation")
        .when(short & x & (m >= 0.75) & (c >= 0.5), "Emerging Risk")
        .when(short, "Anomaly")
        .when((p >= 2) & x & (c >= 0.50) & (m >= 0.75) & (s >= 0.78), "Crisis")
        .when((p >= 2) & (x | (c >= 0.50)) & (t >= 0.74) & (s >= 0.62), "Institutional Risk")
        .when((p >= 2) | (x & (m >= 0.50)) | ((c >= 0.50) & (m >= 0.60)), "Emerging Risk")
        .when((m >= 0.30) | (d >= 0.45), "Anomaly").otherwise("Observation")
    )
    g = F.col("risk_stage")
    sev = (
        F.when(g == "Crisis", "CRITICAL")
        .when(g == "Institutional Risk", F.when(s >= 0.78, "CRITICAL").otherwise("HIGH"))
        .when(g == "Emerging Risk", "HIGH")
        .when(g == "Anomaly", F.when(s < 0.58, "MEDIUM").otherwise("HIGH")).otherwise("LOW")
    )
    return confirmed.withColumn("significance", sig).withColumn("risk_stage", stage).withColumn("severity", sev)


def evaluate(signals: DataFrame, admissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(yearly series, baselines, evaluated anomalies) of a unified signal table."""
    series = yearly_series(signals)
    base = build_baselines(series)
    scored = dimension_scores(anomaly_candidates(series, base), series, admissions)
    return series, base, classify_significance(cross_confirm(scored))
