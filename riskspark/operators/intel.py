"""Explanations, ladder, cross-signal findings, investigations, warnings and deltas."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskspark.functions.num import clamp, key9, pct_change, rnd, unfavourable, unfavourable_pct
from riskspark.functions.rules import related_domains
from riskspark.operators.baseline import SERIES, dept_lookups

INST = ["institution_id"]


def place(dept: str = "dept_key"):
    return F.when(F.col(dept) == "", "Institution-Wide").otherwise(F.col(dept))


def fixed(c, digits: int = 2, sign: str = ""):
    """A number as text with so many decimals, rounded half up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"%{sign}.{digits}f", rnd(key9(c), digits))


def explanation_evidence(evaluated: DataFrame, signals: DataFrame) -> DataFrame:
    """The observations behind every anomaly, one row each, with a line that cites document, value and confidence."""
    line = F.concat(F.lit("["), F.coalesce("document", F.lit("")), F.lit("] "), "metric_name", F.lit(" = "), fixed("value"), F.lit(" (confidence "), fixed("confidence"), F.lit(")"))
    seen = signals.where("value IS NOT NULL AND NOT is_duplicate").withColumn("dept_key", F.coalesce("department", F.lit("")))
    return seen.join(evaluated.select(*SERIES), SERIES, "left_semi").select(*SERIES, "academic_year", "seq", line.alias("evidence"))


def explain(evaluated: DataFrame) -> DataFrame:
    """Readable statements per anomaly: what, by how much, when, on which basis, how significant. ``explanation_evidence`` lists the evidence."""
    word = (F.when(F.col("polarity") == "higher_is_better", "declined")
            .when(F.col("polarity") == "lower_is_better", "increased").otherwise("shifted"))
    where = F.when(F.col("dept_key") == "", "").otherwise(F.concat(F.lit(" in "), F.col("dept_key")))
    sfx = (F.when(F.col("unit") == "%", "%").when(F.col("unit").isin("count", "ratio"), "")
           .otherwise(F.concat(F.lit(" "), F.coalesce("unit", F.lit("")))))
    zs = F.when(F.col("zscore").isNull(), "").otherwise(F.concat(F.lit(", z "), fixed("zscore", sign="+")))
    amount = F.when(F.col("comparison_value").isNull(), F.format_string("Observed %s%s (single period)", fixed("observed_value"), sfx)) \
        .otherwise(F.format_string("Observed %s%s against %s%s (%s%%%s)", fixed("observed_value"), sfx,
                                   fixed("comparison_value"), sfx, fixed("relative_pct_change", 1, "+"), zs))
    basis = (F.when(F.col("baseline_mean").isNotNull(),
                    F.format_string("historical mean %s, deviation %s", fixed("baseline_mean"), fixed("baseline_std")))
             .when(F.col("prior_value").isNotNull(),
                   F.format_string("previous period %d = %s", "prior_period", fixed("prior_value")))
             .otherwise("single observation against domain thresholds"))
    scope = (F.when(F.col("n_affected") == 0, "institution-wide")
             .otherwise(F.format_string("%d department(s)", "n_affected")))
    return evaluated.withColumns({
        "what_changed": F.concat(F.col("metric_label"), where, F.lit(" "), word, F.lit(".")),
        "by_how_much": amount,
        "when": F.when(F.col("latest_period").isNull(), "undated").otherwise(
            F.concat(F.lit("AY "), F.col("latest_period"), F.when(
                F.col("persistence") >= 2, F.format_string(" (%d consecutive periods)", "persistence")).otherwise(""))),
        "comparison_basis": basis,
        "significance_text": F.format_string(
            "%s (%s, %s): magnitude %s, deviation %s, coverage %s, materiality %s, confirmed by %d signal(s)",
            "risk_stage", fixed("significance"), "severity", fixed("magnitude"), fixed("deviation"), scope, fixed("materiality"),
            F.size("confirming")),
    })


STAGES = ["Observation", "Anomaly", "Emerging Risk", "Institutional Risk", "Crisis"]


def ladder_items(baselines: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Baselines without an anomaly stay observations; anomalies take their own stage."""
    obs = baselines.join(evaluated.select(*SERIES), SERIES, "left_anti").select(
        *SERIES, F.lit("Observation").alias("stage"), F.lit(0.15).alias("significance"))
    return obs.unionByName(evaluated.select(*SERIES, F.col("risk_stage").alias("stage"), "significance"))


def stage_ladder(baselines: DataFrame, evaluated: DataFrame, assessments: DataFrame) -> DataFrame:
    """Counts per stage and the overall stage of every institution."""
    n = lambda s: F.count_if(F.col("stage") == s).cast("int").alias("n_" + s.lower().replace(" ", "_"))
    g = ladder_items(baselines, evaluated).groupBy(*INST).agg(*[n(s) for s in STAGES])
    d = assessments.select(*INST, "cri").join(g, INST)
    cri = F.col("cri")
    return d.withColumn(
        "overall_stage",
        F.when((F.col("n_crisis") > 0) | ((cri >= 0.70) & (F.col("n_institutional_risk") > 0)), "Crisis")
        .when((F.col("n_institutional_risk") > 0) | ((cri >= 0.55) & (F.col("n_emerging_risk") >= 2)), "Institutional Risk")
        .when(F.col("n_emerging_risk") > 0, "Emerging Risk").when(F.col("n_anomaly") > 0, "Anomaly")
        .otherwise("Observation"))


def cross_signal_findings(evaluated: DataFrame, baselines: DataFrame, stand_ins: int | None = None) -> DataFrame:
    """For each anomaly and related domain: the compatible series with their relation, or MISSING_DOMAIN.

    Department compatibility is an equi-join on lookup keys. Where a domain has series but no compatible one, all its
    series stand in (or its first ``stand_ins`` ones by metric and department).
    """
    pk = ["institution_id", "p_domain", "p_metric", "p_dept"]
    asks = evaluated.select(
        "institution_id", F.col("domain").alias("p_domain"), F.col("metric_name").alias("p_metric"),
        F.col("dept_key").alias("p_dept"), F.explode(related_domains(F.col("domain"))).alias("r_domain"))
    comp = F.coalesce("baseline_mean", "prior_value")
    anom = evaluated.select(*SERIES, F.lit(True).alias("_anom"))
    b = baselines.join(anom, SERIES, "left").select(
        "institution_id", F.col("domain").alias("r_domain"), F.col("metric_name").alias("r_metric"),
        F.col("dept_key").alias("r_dept"), "polarity", "has_contradictions", "latest_value", comp.alias("comp"),
        F.coalesce("_anom", F.lit(False)).alias("is_anomaly"))
    rd = ["institution_id", "r_domain"]
    keyed = b.withColumn("lk", F.explode(F.array("r_dept", F.lit("*"))))
    hits = asks.withColumn("lk", F.explode(dept_lookups("p_dept"))).join(keyed, [*rd, "lk"]).drop("lk")
    others = b
    if stand_ins is not None:
        others = b.withColumn("_n", F.row_number().over(W.partitionBy(*rd).orderBy("r_metric", "r_dept"))).where(F.col("_n") <= stand_ins).drop("_n")
    unmet = asks.join(hits.select(*pk, "r_domain").distinct(), [*pk, "r_domain"], "left_anti")
    fallback = unmet.join(others, rd)
    missing = unmet.join(b.select(*rd).distinct(), rd, "left_anti")
    rel = rnd(key9(pct_change(F.col("comp"), F.col("latest_value"))), 2)
    bad = unfavourable(F.col("latest_value") - F.col("comp"), F.col("polarity"))
    both = hits.unionByName(fallback).withColumn("relative_pct_change", rel).withColumn(
        "relationship",
        F.when(F.col("has_contradictions"), "CONTRADICTORY_SOURCE")
        .when(F.col("is_anomaly"), "CORROBORATING_CHANGE")
        .when(F.col("comp").isNull(), "STABLE_NO_CHANGE")
        .when(bad & (F.abs("relative_pct_change") >= 4.0), "CORROBORATING_CHANGE")
        .when(~bad & (F.abs("relative_pct_change") >= 5.0), "DIVERGENT_TREND").otherwise("STABLE_NO_CHANGE"))
    cols = [*pk, "r_domain", "r_metric", "r_dept", "relative_pct_change", "relationship"]
    return both.select(*cols).unionByName(missing.select(
        *pk, "r_domain", F.lit(None).cast("string").alias("r_metric"), F.lit(None).cast("string").alias("r_dept"),
        F.lit(None).cast("double").alias("relative_pct_change"), F.lit("MISSING_DOMAIN").alias("relationship")))


def investigations(evaluated: DataFrame, findings: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One investigation with graded confidence per anomaly, plus one per contradiction not yet covered."""
    f = findings.groupBy(
        "institution_id", F.col("p_domain").alias("domain"), F.col("p_metric").alias("metric_name"),
        F.col("p_dept").alias("dept_key")).agg(
        F.count_if(F.col("relationship") != "MISSING_DOMAIN").alias("n_related"),
        F.count_if(F.col("relationship") == "MISSING_DOMAIN").alias("n_missing"),
        F.count_if(F.col("relationship") == "DIVERGENT_TREND").alias("n_divergent"),
        F.count_if(F.col("relationship") == "CORROBORATING_CHANGE").alias("n_corroborating"))
    d = evaluated.join(f, SERIES, "left").fillna(0, ["n_related", "n_missing", "n_divergent", "n_corroborating"])
    s = F.col("baseline_status")
    conf = (
        F.lit(0.78)
        + F.when(s == "ESTABLISHED", 0.12).when(s == "TWO_PERIOD_COMPARISON_ONLY", -0.06).otherwise(-0.18)
        + F.when(F.col("n_related") > 0, 0.05).otherwise(0.0)
        - F.least(F.lit(0.12), F.lit(0.03) * F.col("n_missing"))
        - F.when(F.col("has_contradictions"), 0.20).otherwise(0.0)
    )
    cols = ["kind", "risk_stage", "confidence", "n_related", "n_missing"]
    found = d.select(*SERIES, F.lit("anomaly").alias("kind"), "risk_stage",
                     rnd(key9(clamp(conf, 0.15, 0.98)), 2).alias("confidence"), "n_related", "n_missing")
    uncovered = contradictions.select(*SERIES).join(evaluated.select(*SERIES), SERIES, "left_anti").select(
        *SERIES, F.lit("contradiction").alias("kind"), F.lit("Anomaly").alias("risk_stage"),
        F.lit(0.55).alias("confidence"), F.lit(0).cast("bigint").alias("n_related"),
        F.lit(0).cast("bigint").alias("n_missing"))
    return found.select(*SERIES, *cols).unionByName(uncovered.select(*SERIES, *cols))


def surface_contradictions(signals: DataFrame) -> DataFrame:
    """Slots whose numeric observations disagree by more than 1 % or carry a contradiction flag."""
    s = signals.where("value IS NOT NULL").withColumns({
        "dept_key": F.coalesce("department", F.lit("")),
        "period": F.coalesce(F.col("academic_year").cast("string"), F.lit("undated"))})
    g = s.groupBy(*SERIES, "period").agg(
        F.count("*").alias("n_observations"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.bool_or("is_contradictory").alias("_flag"))
    spread = F.col("max_value") - F.col("min_value")
    return g.where((F.col("n_observations") >= 2) & (F.col("_flag") | (
        (spread > 1e-4) & (key9(spread / F.greatest(F.abs("min_value"), F.lit(1.0))) > 0.01)))).drop("_flag")


def early_warnings(baselines: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Position of each series on the chain weak signal, repeated, cross-confirmed, emerging."""
    p, x = F.col("persistence") >= 2, F.col("cross_confirmed")
    a = evaluated.select(
        *SERIES, "latest_period",
        F.when(p & x, "emerging_risk").when(x, "cross_signal_confirmation").when(p, "repeated_anomaly")
        .otherwise("weak_signal").alias("warning_stage"),
        F.when(p & x, 4).when(x, 3).when(p, 2).otherwise(1).alias("stage_index"))
    comp = F.coalesce("baseline_mean", "prior_value")
    u = key9(unfavourable_pct(comp, F.col("latest_value"), F.col("polarity"), F.col("unit")))
    weak = baselines.join(evaluated.select(*SERIES), SERIES, "left_anti").where(u.between(4.0, 9.9999999999)).select(
        *SERIES, "latest_period", F.lit("weak_signal").alias("warning_stage"), F.lit(1).alias("stage_index"))
    return a.unionByName(weak)


def _last_years(series: DataFrame) -> DataFrame:
    """Latest dated row of each series with its two predecessors."""
    w = W.partitionBy(*SERIES).orderBy("academic_year")
    v, y = F.col("last_value"), F.col("academic_year")
    return series.where("academic_year IS NOT NULL").withColumns({
        "prev_value": F.lag(v).over(w), "prev_year": F.lag(y).over(w), "prev_risk": F.lag("last_risk").over(w),
        "prev2_value": F.lag(v, 2).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()}).where("_last")


def signal_changes(series: DataFrame, baselines: DataFrame) -> DataFrame:
    """NEW, WORSENING or IMPROVING between the last two present years of each series."""
    inst = series.groupBy(*INST).agg(F.max("academic_year").alias("_y1"), F.countDistinct("academic_year").alias("_ny"))
    d = _last_years(series).join(baselines.select(*SERIES, "polarity"), SERIES).join(inst, INST)
    delta = rnd(F.col("last_value") - F.col("prev_value"), 4)
    d = d.withColumn("delta", delta)
    direction = (
        F.when((F.col("_ny") < 2) | (F.col("prev_year").isNull() & (F.col("academic_year") == F.col("_y1"))), "NEW")
        .when(F.abs("delta") <= 1e-5, None)
        .when(unfavourable(F.col("delta"), F.col("polarity")), "WORSENING")
        .when(F.col("polarity").isin("higher_is_better", "lower_is_better"), "IMPROVING"))
    return d.withColumn("direction", direction).where("direction IS NOT NULL").select(
        *SERIES, "direction", "prev_year", "academic_year", "prev_value", F.col("last_value").alias("current_value"),
        "delta", rnd(key9(pct_change(F.col("prev_value"), F.col("last_value"))), 2).alias("pct_change"))


def risk_changes(series: DataFrame, baselines: DataFrame, evaluated: DataFrame) -> DataFrame:
    """NEW, RESOLVED or ESCALATED risk, from the previous period's state against the current anomaly."""
    inst = series.groupBy(*INST).agg(F.max("academic_year").alias("_y1"), F.countDistinct("academic_year").alias("_ny"))
    d = (
        _last_years(series).join(baselines.select(*SERIES, "polarity", "unit"), SERIES)
        .join(evaluated.select(*SERIES, "risk_stage", "persistence"), SERIES, "left").join(inst, INST)
    )
    was = (key9(F.coalesce("prev_risk", F.lit(0.0))) >= 0.45) | F.coalesce(
        key9(unfavourable_pct(F.col("prev2_value"), F.col("prev_value"), F.col("polarity"), F.col("unit"))) >= 12.0,
        F.lit(False))
    now = F.col("risk_stage").isNotNull()
    single = F.col("prev_year").isNull()
    change = (
        F.when(F.col("_ny") < 2, F.when(now, "NEW_RISK"))
        .when(single, F.when(now & (F.col("academic_year") == F.col("_y1")), "NEW_RISK"))
        .when(was & ~now, "RESOLVED_RISK").when(~was & now, "NEW_RISK")
        .when(was & now & (F.col("persistence") >= 2), "ESCALATED_RISK"))
    return d.withColumn("change_type", change).where("change_type IS NOT NULL").select(
        *SERIES, "change_type", F.coalesce("risk_stage", F.lit("Observation")).alias("current_stage"))


def relationship_changes(series: DataFrame, baselines: DataFrame, limit: int | None = None) -> DataFrame:
    """Linked metric pairs whose joint movement changed between their last common years; first ``limit`` per institution.

    Each series carries its years as a small map (a contract-bounded number of years), so a pair is one row.
    """
    m = series.where("academic_year IS NOT NULL").groupBy(*SERIES).agg(
        F.map_from_entries(F.collect_list(F.struct("academic_year", "last_value"))).alias("pts"))
    b = baselines.where("n_years >= 2").select(*SERIES, "polarity").join(m, SERIES)
    left = (
        b.select("institution_id", F.col("domain").alias("domain_a"), F.col("metric_name").alias("metric_a"),
                 F.col("dept_key").alias("dept_a"), F.col("polarity").alias("pol_a"), F.col("pts").alias("pts_a"),
                 F.explode(F.filter(related_domains(F.col("domain")), lambda x: x > F.col("domain"))).alias("domain_b"))
        .withColumn("lk", F.explode(dept_lookups("dept_a")))
    )
    right = b.select(
        "institution_id", F.col("domain").alias("domain_b"), F.col("metric_name").alias("metric_b"),
        F.col("dept_key").alias("dept_b"), F.col("polarity").alias("pol_b"), F.col("pts").alias("pts_b"),
        F.explode(F.array("dept_key", F.lit("*"))).alias("lk"))
    p = left.join(right, ["institution_id", "domain_b", "lk"]).drop("lk")
    yrs = F.reverse(F.array_sort(F.array_intersect(F.map_keys("pts_a"), F.map_keys("pts_b"))))
    p = p.withColumn("_y", yrs).where(F.size("_y") >= 2)
    at = lambda pts, i: F.element_at(F.col(pts), F.get("_y", F.lit(i)))
    bad = lambda pts, pol, i: unfavourable(at(pts, i) - at(pts, i + 1), F.col(pol))
    p = p.withColumns({
        "_a": bad("pts_a", "pol_a", 0), "_b": bad("pts_b", "pol_b", 0),
        "_pa": F.when(F.size("_y") >= 3, bad("pts_a", "pol_a", 1)),
        "_pb": F.when(F.size("_y") >= 3, bad("pts_b", "pol_b", 1))})
    rel = lambda a, b: (F.when(F.col(a) & F.col(b), "Co-deteriorating")
                        .when(~F.col(a) & ~F.col(b), "Co-improving/Stable").otherwise("Divergent"))
    three = F.size("_y") >= 3
    p = p.withColumns({
        "previous_relationship": F.when(three, rel("_pa", "_pb")).otherwise("Baseline"),
        "current_relationship": F.when(three, rel("_a", "_b"))
        .when(F.col("_a") != F.col("_b"), "Divergent movement").when(F.col("_a") & F.col("_b"), "Coupled co-deterioration")})
    p = p.where("current_relationship IS NOT NULL AND previous_relationship <> current_relationship")
    if limit is not None:  # a report of the first pairs of each institution
        order = W.partitionBy(*INST).orderBy("domain_a", "metric_a", "dept_a", "domain_b", "metric_b", "dept_b")
        p = p.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return p.select(
        "institution_id", "domain_a", "metric_a", "dept_a", "domain_b", "metric_b", "dept_b",
        "previous_relationship", "current_relationship")


def epistemic_statements(series: DataFrame, baselines: DataFrame, evaluated: DataFrame, findings: DataFrame, cases: DataFrame,
                         forecasts: DataFrame, contradictions: DataFrame, facts: int | None = None, first_cases: int | None = None
                         ) -> DataFrame:
    """Statements tagged by how they are known: fact, analysis, inference, correlation, hypothesis, forecast, recommendation, unknown.

    Analysis are established baselines and the index itself; unknown are series with too little or contradictory history, related domains
    without any signal, and contradictions. Domain, metric and department tell the series that a statement is about. ``facts`` and ``first_cases`` limit the facts, hypotheses and recommendations of an institution; by default all are given.
    """
    def out(df, kind, text, conf):
        about = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SERIES]
        return df.select(*about, F.lit(kind).alias("statement_class"), text.alias("statement"), conf.cast("double").alias("confidence"))

    def top(df, n, *order):
        if n is None:
            return df
        return df.withColumn("_n", F.row_number().over(W.partitionBy(*INST).orderBy(*order))).where(
            F.col("_n") <= n).drop("_n")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.concat_ws(".", "domain", "metric_name")
    here = say(name, " (", place(), ")")
    latest = top(_last_years(series), facts, "domain", "metric_name", "dept_key")
    missing = findings.where("relationship = 'MISSING_DOMAIN'").groupBy(
        "institution_id", F.col("p_domain").alias("domain"), F.col("p_metric").alias("metric_name"), F.col("p_dept").alias("dept_key")).agg(
        F.array_join(F.array_sort(F.collect_set("r_domain")), ", ").alias("absent"))
    order = (F.desc("confidence"), "domain", "metric_name", "dept_key")
    reviews = top(cases, first_cases, *order).join(missing, SERIES, "left")
    rated = forecasts.where("status = 'SUFFICIENT_EVIDENCE'")
    status = F.col("baseline_status")
    return (
        out(latest, "OBSERVED_FACT", say(here, " was ", fixed("last_value"), " in ", F.col("academic_year").cast("string")), F.lit(0.95))
        .unionByName(out(baselines.where(status == "ESTABLISHED"), "ANALYSIS", say(
            here, " has a baseline of ", fixed("baseline_mean"), " with deviation ", fixed("baseline_std"), " over ", F.col("n_years").cast("string"), " years"), F.lit(0.95)))
        .unionByName(out(rated, "ANALYSIS", say("composite index computed at ", fixed("current_cri", 4)), F.col("confidence")))
        .unionByName(out(evaluated, "STATISTICAL_INFERENCE", say(here, " is staged ", F.col("risk_stage")), F.col("significance")))
        .unionByName(out(findings.where("relationship = 'CORROBORATING_CHANGE'").withColumns({"domain": F.col("p_domain"), "metric_name": F.col("p_metric"), "dept_key": F.col("p_dept")}), "CORRELATION", say(
            F.concat_ws(".", "p_domain", "p_metric"), " moves together with ", F.concat_ws(".", "r_domain", "r_metric")), F.lit(0.6)).distinct())
        .unionByName(out(top(cases.where("kind = 'anomaly'"), first_cases, *order), "HYPOTHESIS", say(
            "possible factors behind ", name, " at ", place()), F.col("confidence")))
        .unionByName(out(rated, "FORECAST", say("index expected at ", fixed("terminal_cri", 4), " after three years"), F.col("confidence")))
        .unionByName(out(reviews, "RECOMMENDATION", say("review ", here, ", staged ", F.col("risk_stage"), F.when(F.col("absent").isNull(), ", and watch related domains").otherwise(
            say(", and collect evidence on ", F.col("absent")))), F.col("confidence")))
        .unionByName(out(baselines.where(status != "ESTABLISHED"), "UNKNOWN", say("no established baseline for ", here, ": ", status), F.lit(1.0)))
        .unionByName(out(missing, "UNKNOWN", say("no signals on ", F.col("absent"), " to judge ", here), F.lit(1.0)))
        .unionByName(out(contradictions, "UNKNOWN", say("sources disagree on ", here, " in ", F.col("period")), F.lit(1.0)))
    )
