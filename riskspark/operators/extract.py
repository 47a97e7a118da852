"""Signals from cell tables, text lines and canonical rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions import metric_rules as M
from riskspark.functions.num import rnd
from riskspark.functions.text import (context_from_text, fingerprint, parse_numeric,
                                      risk_contribution, with_classification)

SHEET = ["doc", "sheet"]


def header_role(header: Column) -> Column:
    """Role of a column header by its normalized spelling, null for a metric column."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(header)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    out = None
    for role, names in M.HEADER_ROLES:
        c = h.isin(names)
        out = F.when(c, role) if out is None else out.when(c, role)
    return out


def header_roles(headers: DataFrame) -> DataFrame:
    return headers.withColumn("role", header_role(F.col("header")))


def _finish(df: DataFrame, location: Column, confidence: Column) -> DataFrame:
    """Signal columns from label, raw text and context."""
    unit = F.coalesce("explicit_unit", "parsed_unit", "unit")
    d = df.withColumn("unit", unit).withColumns({"location": location, "confidence": confidence})
    fp = fingerprint(F.col("doc"), F.col("domain"), F.col("metric_name"), F.col("academic_year"), F.col("time_period"),
                     F.col("department"), F.col("location"), F.col("raw_value"))
    return d.withColumn("fingerprint", fp).select(
        F.concat(F.lit("sig_"), F.col("fingerprint")).alias("signal_id"), "doc", "domain", "metric_name",
        F.col("label").alias("metric_label"), "value", "raw_value", "unit", "polarity",
        risk_contribution(F.col("metric_name"), F.col("value"), F.col("unit"), F.col("polarity")).alias("risk_contribution"),
        "department", "program", "time_period", "academic_year", "location", "confidence", "is_ambiguous")


def sheet_layout(cells: DataFrame) -> DataFrame:
    """Header row and table kind (long, key_value, wide) of every sheet."""
    filled = cells.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    rows = filled.groupBy(*SHEET, "row").agg(F.count("*").alias("_n"))
    top = rows.groupBy(*SHEET).agg(
        F.coalesce(F.min(F.when(F.col("_n") >= 2, F.col("row"))), F.min("row")).alias("header_row"))
    # the header row decides; its trailing empty cells still count as columns
    h = cells.join(top, SHEET).where("row = header_row").withColumn("role", header_role(F.col("text")))
    return h.groupBy(*SHEET, "header_row").agg(
        F.count("*").alias("_cols"), F.count("role").alias("_roles"),
        F.bool_or(F.col("role") == "metric").alias("_m"), F.bool_or(F.col("role") == "value").alias("_v"),
    ).select(*SHEET, "header_row", F.when(F.coalesce("_m", F.lit(False)) & F.coalesce("_v", F.lit(False)), "long")
             .when((F.col("_cols") == 2) & (F.col("_roles") == 0), "key_value").otherwise("wide").alias("kind"))


def tabulate(cells: DataFrame) -> DataFrame:
    """Data rows with their context columns and the remaining cells as an array (bounded by the sheet's columns)."""
    lay = sheet_layout(cells)
    head = cells.join(lay, SHEET).where("row = header_row").select(
        *SHEET, "col", F.trim("text").alias("header"), header_role(F.col("text")).alias("role"))
    body = cells.join(lay, SHEET).where("row > header_row").join(head, [*SHEET, "col"]).withColumn(
        "text", F.trim(F.coalesce("text", F.lit(""))))
    role = lambda r: F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("role") == r, F.col("col")))
    return body.groupBy(*SHEET, "row", "kind").agg(
        *[role(r).alias(f"x_{r}") for r in ("department", "program", "period", "domain", "metric", "value", "unit")],
        F.min(F.when(F.col("role") == "value", F.col("col"))).alias("value_col"),
        F.array_sort(F.collect_list(F.when(F.col("role").isNull() & (F.col("header") != ""),
                                           F.struct("col", "header", "text")))).alias("cells"),
        F.count_if(F.col("text") != "").alias("n_filled"))


def _context(df: DataFrame, text: Column) -> DataFrame:
    c = context_from_text(text)
    period = F.col("x_period")
    year = F.regexp_extract(period, r"\b(20\d{2})\b", 1)
    return df.withColumns({
        "department": F.coalesce("x_department", c["department"]), "program": F.coalesce("x_program", c["program"]),
        "time_period": F.coalesce(period, c["time_period"]),
        "academic_year": F.when(period.isNotNull(), F.when(year != "", year).cast("int")).otherwise(c["academic_year"])})


def _coord(col: Column) -> Column:
    return F.concat(F.col("sheet"), F.lit("!R"), F.col("row"), F.lit("C"), col)


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", parse_numeric(F.col("raw_value"))).withColumns({
        "value": F.col("_p.value"), "is_ambiguous": F.col("_p.is_ambiguous"), "parsed_unit": F.col("_p.unit")}).drop("_p")


def extract_long_table(rows: DataFrame) -> DataFrame:
    """Tables with metric and value columns: one signal per row; explicit domain and unit win."""
    d = rows.where("kind = 'long' AND x_metric IS NOT NULL AND x_value IS NOT NULL").withColumns({
        "label": F.col("x_metric"), "raw_value": F.col("x_value"), "explicit_unit": F.col("x_unit")})
    d = _context(_parsed(with_classification(d, "label")), F.col("sheet"))
    d = d.withColumn("domain", F.coalesce(F.lower(F.trim("x_domain")), "domain"))
    return _finish(d, _coord(F.col("value_col")), F.when(F.col("is_ambiguous"), 0.82).otherwise(0.96))


def extract_key_value_table(rows: DataFrame) -> DataFrame:
    """Two-column tables without known headers: label left, value right."""
    d = rows.where("kind = 'key_value' AND n_filled = 2").withColumns({
        "label": F.col("cells")[0]["text"], "raw_value": F.col("cells")[1]["text"], "_c": F.col("cells")[1]["col"],
        "explicit_unit": F.lit(None).cast("string")})
    d = _parsed(with_classification(d, "label")).where("value IS NOT NULL")
    d = _context(d, F.concat_ws(" ", "sheet", "label"))
    return _finish(d, _coord(F.col("_c")), F.when(F.col("is_ambiguous"), 0.82).otherwise(0.95))


def _wide_cells(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'wide'").select("*", F.explode("cells").alias("_x")).withColumns({
        "label": F.col("_x.header"), "raw_value": F.col("_x.text"), "_c": F.col("_x.col")}).drop("_x", "cells")


def extract_wide_table(rows: DataFrame) -> DataFrame:
    """Every column without a role is a metric; blank cells give issues instead of signals."""
    d = _parsed(_wide_cells(rows).where("raw_value <> ''").withColumn("explicit_unit", F.lit(None).cast("string")))
    d = with_classification(d.where("value IS NOT NULL OR is_ambiguous"), "label")
    d = _context(d, F.concat_ws(" ", "sheet", "label"))
    return _finish(d, _coord(F.col("_c")), F.when(F.col("is_ambiguous"), 0.80).otherwise(0.96))


def table_issues(rows: DataFrame) -> DataFrame:
    """incomplete_coverage for blank metric cells, ambiguous_values for doubtful ones, per sheet kind."""
    w = _wide_cells(rows)
    long = rows.where("kind = 'long' AND x_metric IS NOT NULL AND x_value IS NOT NULL").select(
        *SHEET, "row", F.col("x_metric").alias("label"), F.col("x_value").alias("raw_value"), F.col("value_col").alias("_c"))
    cells = w.select(*SHEET, "row", "label", "raw_value", "_c").unionByName(long)
    amb = parse_numeric(F.col("raw_value"))["is_ambiguous"]
    kind = F.when(F.col("raw_value") == "", "incomplete_coverage").when(amb, "ambiguous_values")
    return cells.withColumn("issue_type", kind).where("issue_type IS NOT NULL").select(
        *SHEET, F.col("label").alias("affected_metric"), "issue_type",
        F.when(F.col("issue_type") == "ambiguous_values", "MEDIUM").otherwise("LOW").alias("severity"),
        _coord(F.col("_c")).alias("location"))


# ---- text lines ---------------------------------------------------------------------------------

def classify_lines(lines: DataFrame) -> DataFrame:
    """Split lines by precedence: pipe row, key-value line, else prose."""
    t = F.trim("text")
    parts = F.filter(F.transform(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)),
                     lambda x: x != "")
    ruler = F.forall(parts, lambda x: x.rlike(r"^[-:]+$"))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 2
    d = lines.withColumns({"text": t, "_parts": parts, "_pipe": pipes & (F.size(parts) >= 2) & ~ruler})
    d = d.withColumns({
        "_a_label": F.when(F.col("_pipe"), F.get("_parts", F.lit(0))), "_a_raw": F.when(F.col("_pipe"), F.get("_parts", F.lit(1))),
        "_k_label": F.trim(F.regexp_extract("text", M.KEY_VALUE_PATTERN, 1)),
        "_k_raw": F.trim(F.regexp_extract("text", M.KEY_VALUE_PATTERN, 2))})
    d = d.withColumns({"_pa": parse_numeric(F.col("_a_raw")), "_pk": parse_numeric(F.col("_k_raw"))})
    is_a = F.col("_a_label").isNotNull() & F.col("_pa.value").isNotNull()
    is_k = (F.col("_k_label") != "") & ~F.lower("_k_label").isin(M.CONTEXT_LABELS) & (
        F.col("_pk.value").isNotNull() | F.col("_pk.is_ambiguous"))
    d = d.withColumn("form", F.when(is_a, "pipe").when(is_k, "key_value").otherwise("prose"))
    pick = lambda a, k: F.when(F.col("form") == "pipe", F.col(a)).when(F.col("form") == "key_value", F.col(k))
    return d.withColumns({"label": pick("_a_label", "_k_label"), "raw_value": pick("_a_raw", "_k_raw")}).drop(
        "_parts", "_pipe", "_a_label", "_a_raw", "_k_label", "_k_raw", "_pa", "_pk")


def _line_context(d: DataFrame) -> DataFrame:
    return d.withColumns(context_from_text(F.concat_ws(" ", "ctx", "text"))).withColumn(
        "explicit_unit", F.lit(None).cast("string"))


def _line_signals(d: DataFrame, base: float) -> DataFrame:
    d = _line_context(_parsed(with_classification(d, "label")))
    return _finish(d, F.concat(F.lit("line "), F.col("line_no")),
                   rnd(F.lit(base) - F.when(F.col("is_ambiguous"), 0.10).otherwise(0.0), 2))


def extract_pipe_rows(classified: DataFrame, base: float = 0.90) -> DataFrame:
    return _line_signals(classified.where("form = 'pipe'"), base)


def extract_key_value_lines(classified: DataFrame, base: float = 0.90) -> DataFrame:
    return _line_signals(classified.where("form = 'key_value'"), base)


def extract_prose_metrics(classified: DataFrame, base: float = 0.90) -> DataFrame:
    """Every vocabulary match in prose with a number near it (25 characters before to 55 after, years removed).

    The rules travel as literal expressions; a combined pattern skips lines without any vocabulary word.
    """
    t = F.col("text")
    any_rule = "(?i)" + "|".join(f"(?:{p})" for _, p, _, _, _ in M.METRIC_RULES)

    def hits(rule: tuple) -> Column:
        dom, pat, metric, unit, pol = rule
        return F.when(t.rlike("(?i)" + pat), F.struct(
            F.lit(dom).alias("domain"), F.lit(metric).alias("metric_name"), F.lit(unit).alias("unit"),
            F.lit(pol).alias("polarity"), F.regexp_extract_all(t, F.lit(f"(?i)({pat})"), 1).alias("m"),
            F.split(t, "(?i)" + pat, -1).alias("gap")))
    d = classified.where("form = 'prose'").drop("label", "raw_value").where(t.rlike(any_rule)).withColumn(
        "_h", F.explode(F.filter(F.array(*[hits(x) for x in M.METRIC_RULES]), lambda x: x.isNotNull())))
    d = d.select("*", F.posexplode("_h.m").alias("_i", "label"))
    # start of the i-th match = all gaps up to it plus all earlier matches
    start = F.length(F.array_join(F.slice("_h.gap", F.lit(1), F.col("_i") + 1), "")) + F.length(
        F.array_join(F.slice("_h.m", F.lit(1), F.col("_i")), ""))
    d = d.withColumn("_s", start)
    lo = F.greatest(F.lit(0), F.col("_s") - 25)
    window = F.substring(t, lo + 1, F.col("_s") + F.length("label") + 55 - lo)
    cleaned = F.regexp_replace(window, r"(?i)\b(?:AY\s*)?20[12]\d(?:\s*-\s*\d{2,4})?\b", " ")
    d = d.withColumn("raw_value", F.trim(F.regexp_extract(cleaned, r"(~?\s*\d+(?:\.\d+)?\s*%?)", 1))).where("raw_value <> ''")
    d = d.withColumns({c: F.col(f"_h.{c}") for c in ("domain", "metric_name", "unit", "polarity")}).drop("_h")
    d = _line_context(_parsed(d))
    return _finish(d, F.concat(F.lit("line "), F.col("line_no")),
                   rnd(F.lit(base - 0.04) - F.when(F.col("is_ambiguous"), 0.10).otherwise(0.0), 2))


# ---- canonical <-> long -------------------------------------------------------------------------

def canonical_to_long(admissions: DataFrame, placements: DataFrame, ranking: DataFrame) -> DataFrame:
    """Three admissions metrics, one placement and one ranking metric per canonical row."""
    def row(domain, metric, value, unit, polarity, risk):
        return F.struct(F.lit(domain).alias("domain"), F.lit(metric).alias("metric_name"),
                        value.cast("double").alias("value"), F.lit(unit).alias("unit"),
                        F.lit(polarity).alias("polarity"), risk.cast("double").alias("risk_contribution"))
    none = F.lit(None)
    vr, pct = F.col("vacancy_rate"), F.col("placement_percentage")
    key = ["institution_id", "department", "academic_year"]
    a = admissions.select(*key, F.inline(F.array(
        row("admissions", "sanctioned_intake", F.col("sanctioned_intake"), "count", "neutral", none),
        row("admissions", "admitted_students", F.col("enrolled_count"), "count", "higher_is_better", none),
        row("admissions", "vacancy_rate", vr, "ratio", "lower_is_better", rnd(F.least(F.lit(1.0), vr * 1.5), 3)))))
    p = placements.select(*key, F.inline(F.array(row(
        "placements", "placement_percentage", pct, "%", "higher_is_better",
        rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(100.0) - pct) / 100.0)), 3)))))
    c = ranking.select(*key, F.inline(F.array(row("ranking", "closing_rank", F.col("closing_rank"), "rank", "lower_is_better", none))))
    return a.unionByName(p).unionByName(c)


def _bridge_metrics(signals: DataFrame, metrics: list[str]) -> DataFrame:
    """Last reported value of each wanted metric per institution, department and year."""
    s = signals.where("value IS NOT NULL AND academic_year BETWEEN 2000 AND 2100").where(F.col("metric_name").isin(metrics))
    last = lambda m: F.max_by(F.when(F.col("metric_name") == m, F.col("value")),
                              F.when(F.col("metric_name") == m, F.col("seq"))).alias(m)
    return s.groupBy("institution_id", F.coalesce("department", F.lit("INSTITUTIONAL")).alias("department"),
                     "academic_year").agg(*[last(m) for m in metrics])


def long_to_admissions(signals: DataFrame) -> DataFrame:
    """Admissions rows derived from long metrics; invented defaults are marked by ``is_imputed``."""
    g = _bridge_metrics(signals, ["sanctioned_intake", "admitted_students", "vacancy_rate", "admission_fill_rate"])
    given = F.col("sanctioned_intake").cast("int")
    intake = F.when(given > 0, given).otherwise(100)
    v = F.when(F.col("vacancy_rate") > 1.0, F.col("vacancy_rate") / 100.0).otherwise(F.col("vacancy_rate"))
    adm = F.coalesce(F.col("admitted_students").cast("int"), rnd(intake * (F.lit(1.0) - v), 0).cast("int"),
                     rnd(intake * (F.coalesce("admission_fill_rate", F.lit(100.0)) / 100.0), 0).cast("int"))
    enrolled = F.least(intake, F.greatest(F.lit(0), adm))
    return g.select(
        "institution_id", "department", "academic_year", intake.alias("sanctioned_intake"),
        enrolled.alias("enrolled_count"), (intake - enrolled).alias("vacancy_count"),
        rnd((intake - enrolled) / intake, 4).alias("vacancy_rate"), F.coalesce(given <= 0, F.lit(True)).alias("is_imputed"))


def long_to_placements(signals: DataFrame) -> DataFrame:
    g = _bridge_metrics(signals, ["placement_percentage", "placed_students", "eligible_students", "median_salary_lpa",
                                  "highest_salary_lpa"])
    g = g.where("placement_percentage IS NOT NULL OR placed_students IS NOT NULL OR eligible_students IS NOT NULL")
    given = F.col("eligible_students").cast("int")
    e = F.when(given > 0, given).otherwise(100)
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("placement_percentage", F.lit(0.0))))
    placed = F.least(e, F.greatest(F.lit(0), F.coalesce(F.col("placed_students").cast("int"),
                                                        rnd(e * (pct / 100.0), 0).cast("int"))))
    med = F.greatest(F.lit(0.0), F.coalesce("median_salary_lpa", F.lit(4.5)))
    return g.select(
        "institution_id", "department", "academic_year", e.alias("eligible_students"), placed.alias("placed_students"),
        rnd(placed / e * 100.0, 2).alias("placement_percentage"), med.alias("median_salary_lpa"),
        F.greatest(med, F.coalesce("highest_salary_lpa", med)).alias("max_salary_lpa"),
        (e - placed).alias("unplaced_count"), F.coalesce(given <= 0, F.lit(True)).alias("is_imputed"))


def long_to_ranking(signals: DataFrame) -> DataFrame:
    g = _bridge_metrics(signals, ["closing_rank", "opening_rank"]).where("closing_rank >= 1")
    c = F.col("closing_rank").cast("int")
    o = F.coalesce(F.col("opening_rank").cast("int"), F.greatest(F.lit(1), F.floor(c / 2).cast("int")))
    return g.select("institution_id", "department", "academic_year", F.least(o, c).alias("opening_rank"),
                    c.alias("closing_rank"), F.lit(75.0).alias("percentile_cutoff"),
                    F.col("opening_rank").isNull().alias("is_imputed"))


def extract_year_blocks(cells: DataFrame) -> DataFrame:
    """Sheets with 'DATA 20xx' banner rows: the banner's year holds for the rows below it (forward fill).

    Columns by position: 2 department, 3 institution, 5 intake, 6 placed, 8 admitted.
    """
    at = lambda i: F.max(F.when(F.col("col") == i, F.trim("text")))
    rows = cells.groupBy(*SHEET, "row").agg(
        F.max(F.regexp_extract("text", r"(?i)DATA\s+(\d{4})", 1)).alias("_b"), at(2).alias("department"),
        at(3).alias("institution_id"), at(5).alias("_i"), at(6).alias("_p"), at(8).alias("_a"))
    banner = F.when(F.col("_b") != "", F.col("_b")).cast("int")
    year = F.last(banner, ignorenulls=True).over(W.partitionBy(*SHEET).orderBy("row"))
    d = rows.withColumn("academic_year", F.coalesce(year, F.lit(2024))).where("_b = ''")
    skip = lambda c, *w: F.coalesce(F.lower(c), F.lit("")).isin("", "none", *w)
    d = d.where(~skip(F.col("department"), "dept") & ~skip(F.col("institution_id"), "college name"))
    ok = F.lit(True)
    for c in ("_i", "_p", "_a"):
        ok = ok & (F.col(c).isNull() | F.col(c).rlike(r"^-?\d+$"))
    d = d.where(ok).withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("_i", "_p", "_a")})
    return d.where("_i > 0 OR _p > 0 OR _a > 0").select(
        *SHEET, "institution_id", "department", "academic_year", F.col("_i").alias("intake"),
        F.col("_p").alias("placed"), F.col("_a").alias("admitted"))


def blocks_to_admissions(blocks: DataFrame) -> DataFrame:
    """Only where both intake and admitted were observed."""
    e = F.least("intake", "admitted")
    return blocks.where("intake > 0 AND admitted > 0").select(
        "institution_id", "department", "academic_year", F.col("intake").alias("sanctioned_intake"),
        e.alias("enrolled_count"), (F.col("intake") - e).alias("vacancy_count"),
        rnd((F.col("intake") - e) / F.col("intake"), 4).alias("vacancy_rate"))


def blocks_to_placements(blocks: DataFrame) -> DataFrame:
    e = F.greatest("placed", "intake")
    return blocks.where("intake > 0 AND placed > 0").select(
        "institution_id", "department", "academic_year", e.alias("eligible_students"),
        F.col("placed").alias("placed_students"), rnd(F.col("placed") / e * 100.0, 2).alias("placement_percentage"),
        (e - F.col("placed")).alias("unplaced_count"))


def flag_ocr_noise(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with recognizer residue get the lower confidence and an issue."""
    noisy = F.col(text).rlike(r"(?i)(\?\?\?|\[ocr_low_conf\]|\[illegible\]|\x{FFFD})")
    return pages.withColumns({
        "has_noise": noisy, "base_confidence": F.when(noisy, 0.72).otherwise(0.91),
        "issue_type": F.when(noisy, "ocr_uncertainty")})
