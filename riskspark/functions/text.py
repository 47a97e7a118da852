"""String columns: metric classification, number parsing, context, hashes, sanitizing, URL policy."""
from __future__ import annotations

import html.entities
import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions import metric_rules as M
from riskspark.functions.num import clamp, key9, rnd


def _has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _chain(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    cond, val = pairs[0]
    out = F.when(cond, val)
    for cond, val in pairs[1:]:
        out = out.when(cond, val)
    return out.otherwise(default)


def classify_metrics(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, domain, metric_name, unit, polarity) of every distinct label, computed once per label.

    The ordered rules give one index per label; the attributes are then array lookups, so each pattern is tested at
    most once. Labels no rule knows fall back to broad domain words.
    """
    d = labels.select(label).where(F.col(label).isNotNull()).distinct()
    d = d.withColumn("_low", F.lower(F.trim(label)))
    low = F.col("_low")
    d = d.withColumn("_i", _chain([(low.rlike(p), F.lit(i)) for i, (_, p, _, _, _) in enumerate(M.METRIC_RULES)],
                                  F.lit(None).cast("int")))
    rule = lambda k: F.get(F.array(*[F.lit(x[k]) for x in M.METRIC_RULES]), F.col("_i"))
    dom = _chain([(_has_any(low, words), F.lit(d)) for d, words in M.DOMAIN_WORDS],
                 F.lit("general_institutional"))
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    unit = (
        F.when(F.col(label).contains("%") | _has_any(low, ["percent", "rate", "ratio"]), "%")
        .when(_has_any(low, ["lakh", "inr", "rs"]), "INR_Lakhs").when(low.contains("lpa"), "LPA")
        .when(_has_any(low, ["count", "number", "total"]), "count"))
    pol = (F.when(_has_any(low, M.DOWN_WORDS), "lower_is_better").when(_has_any(low, M.UP_WORDS), "higher_is_better")
           .otherwise("neutral"))
    known = F.col("_i").isNotNull()
    return d.select(
        label, F.when(known, rule(0)).otherwise(dom).alias("domain"),
        F.when(known, rule(2)).otherwise(F.when(slug == "", "institutional_metric").otherwise(slug)).alias("metric_name"),
        F.when(known, rule(3)).otherwise(unit).alias("unit"), F.when(known, rule(4)).otherwise(pol).alias("polarity"))


def with_classification(df: DataFrame, label: str) -> DataFrame:
    """Join the classification of distinct labels back (a label vocabulary is small next to its rows)."""
    return df.join(classify_metrics(df, label), label)


def parse_numeric(raw: Column) -> Column:
    """Struct (value, is_ambiguous, unit): first number without commas, doubt tokens or ranges, unit marks."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(s)
    is_range = s.rlike(r"^\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?%?$") & ~s.rlike(r"^20\d{2}\s*-\s*\d{2,4}$")
    num = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0)
    unit = (F.when(s.contains("%"), "%").when(s.rlike(r"(?i)\blpa\b"), "LPA")
            .when(s.rlike(r"(?i)\b(?:lakhs?|lacs?)\b"), "INR_Lakhs"))
    return F.struct(
        F.when(num != "", num).cast("double").alias("value"),
        (_has_any(low, M.AMBIGUOUS) | is_range).alias("is_ambiguous"), unit.alias("unit"))


def risk_contribution(metric: Column, value: Column, unit: Column, polarity: Column) -> Column:
    """Risk 0..1 of one observation by metric family, three decimals; null where no rule applies."""
    share = F.when(value > 1.0, value).otherwise(value * 100.0)
    out = (
        F.when(metric == "vacancy_rate", F.when(value > 1.0, value / 100.0).otherwise(value) * 1.5)
        .when(metric == "placement_percentage", (F.lit(100.0) - value) / 100.0)
        .when(metric.isin(M.FALLING_BASE_40), share / 40.0)
        .when(metric.isin(M.RISING_BASE_60), (F.lit(100.0) - share) / 60.0)
        .when(metric.isin(M.COUNT_BASE_25), value / 25.0)
        .when((polarity == "lower_is_better") & (unit == "%"), share / 50.0)
        .when((polarity == "higher_is_better") & (unit == "%"), (F.lit(100.0) - share) / 100.0)
    )
    return F.when(value.isNotNull() & out.isNotNull(), rnd(key9(clamp(out)), 3))


def context_from_text(text: Column) -> dict[str, Column]:
    """Department, program, period and year evidenced by a text; null where the text says nothing."""
    dept = _chain([(text.rlike("(?i)" + p), F.lit(code)) for p, code in M.DEPARTMENT_PATTERNS],
                  F.lit(None).cast("string"))
    prog = F.trim(F.regexp_extract(text, "(?i)" + M.PROGRAM_PATTERN, 0))
    period = F.trim(F.regexp_extract(text, "(?i)" + M.PERIOD_PATTERN, 1))
    return {
        "department": dept, "program": F.when(prog != "", prog), "time_period": F.when(period != "", period),
        "academic_year": F.when(period != "", F.substring(period, 1, 4)).cast("int"),
    }


def with_context(df: DataFrame, text: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """Add context columns: an explicit non-empty column wins, else the text; plus a map of what was evidenced how."""
    explicit = explicit or {}
    ctx = context_from_text(F.coalesce(F.col(text), F.lit("")))
    for field in ("department", "program"):
        if field in explicit:
            e = F.trim(F.col(explicit[field]))
            ctx[field] = F.coalesce(F.when(e != "", e), ctx[field])
    if "period" in explicit:
        e = F.trim(F.col(explicit["period"]).cast("string"))
        given = F.coalesce(e, F.lit("")) != ""
        year = F.regexp_extract(e, r"\b(20\d{2})\b", 1)
        ctx["time_period"] = F.when(given, e).otherwise(ctx["time_period"])
        ctx["academic_year"] = F.when(given, F.when(year != "", year).cast("int")).otherwise(ctx["academic_year"])
    names = {"department": "department", "program": "program", "period": "time_period"}
    how = lambda f: F.when(F.lit(f in explicit) & (F.coalesce(F.trim(F.col(explicit[f]).cast("string")), F.lit("")) != ""
                                                  if f in explicit else F.lit(False)), "explicit column").otherwise("matched in text")
    out = df.withColumns(ctx)
    ev = F.map_filter(F.create_map(*[x for f, n in names.items() for x in (
        F.lit(n), F.when(F.col(n).isNotNull(), how(f)))]), lambda k, v: v.isNotNull())
    return out.withColumn("context_evidence", ev)


def fingerprint(institution: Column, domain: Column, metric: Column, year: Column, period: Column, department: Column,
                location: Column, raw: Column) -> Column:
    """First 24 hex digits of the hash of the seven lower-cased identity parts."""
    part = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    when = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), period)
    joined = F.concat_ws(":", *[part(c) for c in (institution, domain, metric, when, department, location, raw)])
    return F.substring(F.sha2(joined, 256), 1, 24)


def content_hash(c: Column) -> Column:
    """Hash of trimmed, lower-cased, whitespace-collapsed text."""
    norm = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")
    return F.sha2(norm, 256)


# Markup that is dropped with its content, and control characters that are dropped.
ACTIVE_TAGS = "script|style|iframe|object|embed|applet|meta|link"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _entity_tables() -> tuple[str, str]:
    """JSON of all named character references of HTML, and an alternation of those that need no semicolon, longest first."""
    names = html.entities.html5
    open_names = sorted((n for n in names if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(names), "|".join(open_names)


def decode_entities(c: Column) -> Column:
    """HTML character references decoded as a browser does: all names, decimal and hexadecimal numbers, missing semicolons."""
    table, open_names = _entity_tables()
    names = F.from_json(F.lit(table), "map<string,string>")
    parts = F.regexp_extract_all(c, F.lit(r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&)"), F.lit(1))

    def number(x: Column) -> Column:
        hexa = F.regexp_extract(x, "^&#[xX]0*([0-9a-fA-F]+)", 1)
        digits = F.regexp_extract(x, "^&#0*([0-9]+)", 1)
        code = F.when(hexa != "", F.when(F.length(hexa) <= 6, F.conv(hexa, 16, 10).cast("int"))).otherwise(
            F.when(F.length(digits) <= 7, F.when(digits == "", 0).otherwise(digits.cast("int"))))
        low = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
        early = F.create_map(*[F.lit(v) for kv in low.items() for v in kv])
        nothing = code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | (code == 11) | ((code % 65536) >= 65534)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(early[code].isNotNull(), early[code])
                .when(nothing, "").otherwise(char))

    def one(x: Column) -> Column:
        name = F.substring(x, 2, 33)
        head = F.regexp_extract(name, f"^({open_names})", 1)
        return (F.when(~x.startswith("&") | (x == "&"), x).when(x.startswith("&#"), number(x)).when(names[name].isNotNull(), names[name])
                .when(head != "", F.concat(names[head], F.substr(name, F.length(head) + 1))).otherwise(x))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def sanitize_text(c: Column, max_len: int | None = None) -> Column:
    """Plain text of untrusted markup: active blocks and tags dropped, character references decoded; whole unless `max_len` is given."""
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(t, rf"(?is)<({ACTIVE_TAGS})\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, rf"(?i)<({ACTIVE_TAGS})\b[^>]*>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(decode_entities(t), CONTROL, "")
    t = F.trim(F.regexp_replace(t, r"[\s\u00a0]+", " "))
    return t if max_len is None else F.substring(t, 1, max_len)


# Fixed values of the outbound URL policy.
FORBIDDEN_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal", "metadata", "169.254.169.254",
                   "0.0.0.0", "[::1]", "::1"]
FORBIDDEN_SUFFIXES = [".local", ".internal", ".localhost"]
RESERVED_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
                   "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
                   "224.0.0.0/4", "240.0.0.0/4"]


def check_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add (allowed, reason): scheme, credentials, host names and literal private addresses; no name lookup.

    The parts of the URL become columns first, so each is computed once.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    d = urls.withColumns({
        "_u": u, "_scheme": F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "_auth": F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)})
    d = d.withColumn("_host", F.lower(F.regexp_replace(F.regexp_replace("_auth", r"^.*@", ""), r":\d*$", "")))
    ip = F.col("_host").rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    # the four octets as one number, so that each reserved block is a range test
    d = d.withColumn("_o", F.when(ip, F.transform(F.split("_host", r"\."), lambda x: x.cast("long"))))
    d = d.withColumn("_ip", F.aggregate("_o", F.lit(0).cast("long"), lambda acc, x: acc * 256 + x))

    def block(cidr: str) -> Column:
        base, bits = cidr.split("/")
        lo = 0
        for part in base.split("."):
            lo = lo * 256 + int(part)
        return F.col("_ip").between(lo, lo + 2 ** (32 - int(bits)) - 1)
    private = F.lit(False)
    for cidr in RESERVED_BLOCKS:
        private = private | block(cidr)
    suffix = F.col("_host").rlike("(" + "|".join(re.escape(x) for x in FORBIDDEN_SUFFIXES) + ")$")
    reason = (
        F.when(F.col("_u") == "", "empty").when(~F.col("_scheme").isin("http", "https"), "scheme")
        .when(F.col("_auth").contains("@"), "credentials").when(F.col("_host") == "", "no_host")
        .when(F.col("_host").isin(FORBIDDEN_HOSTS) | suffix, "restricted_host").when(private, "restricted_address"))
    return d.withColumn("_r", reason).withColumns({
        "allowed": F.col("_r").isNull(), "reason": F.coalesce("_r", F.lit("ok"))}).drop(
        "_u", "_scheme", "_auth", "_host", "_o", "_ip", "_r")


def humanize_source(doc: Column, period: Column) -> Column:
    """Readable source name: no extension, underscores as spaces, no trailing copy number, period appended."""
    n = F.regexp_replace(F.coalesce(doc, F.lit("")), r"\.(xlsx|xls|csv|pdf|docx|doc)", "")
    n = F.regexp_replace(F.trim(F.translate(n, "_", " ")), r"\s*\(\d+\)$", "")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    base = F.when(F.coalesce(doc, F.lit("")) == "", "Institutional Records").otherwise(n)
    has = F.coalesce(period, F.lit("")) != ""
    return F.when(has & ~base.contains(F.coalesce(period, F.lit(""))), F.concat(base, F.lit(" · "), period)).otherwise(base)


def normalize_confidence(c: Column) -> Column:
    v = F.when(c > 1.0, c / 100.0).otherwise(c)
    return F.when(c.isNull(), 0.85).otherwise(rnd(key9(clamp(v)), 3))


def parse_ts(c: Column) -> Column:
    """ISO time stamp (with Z or offset) or null."""
    return F.try_to_timestamp(c)
