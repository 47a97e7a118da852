"""Uploads and feeds as DataFrames: JSON, delimited, text, RSS/Atom and HTML documents, and file formats.

Every parser takes a table of documents (``doc``, ``content``) so that it runs over files, message payloads or columns
alike; ``read_documents`` makes that table from files. One document is one upload, which the contract limits to 50 MB.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskspark.functions.text import (fingerprint, parse_numeric, risk_contribution, sanitize_text,
                                      with_classification)

BASE = "institution_id string, academic_year int, department string"
ADMISSIONS = (f"{BASE}, sanctioned_intake int, enrolled_count int, vacancy_count int, vacancy_rate double, "
              "gender_diversity_ratio double, dropouts_year_1 int")
PLACEMENTS = (f"{BASE}, graduation_year int, eligible_students int, placed_students int, placement_percentage double, "
              "median_salary_lpa double, max_salary_lpa double, top_tier_recruiters_count int, unplaced_count int")
RANKING = (f"{BASE}, quota_category string, opening_rank int, closing_rank int, percentile_cutoff double, state_rank int, "
           "national_rank int")


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in fields.split(", "))) + ">"


CANONICAL_SCHEMA = f"admissions array<{_struct(ADMISSIONS)}>, placements array<{_struct(PLACEMENTS)}>, cet_ranking array<{_struct(RANKING)}>"
SIGNAL_ITEM = ("metric string, metric_name string, name string, value string, unit string, domain string, department string, "
               "program string, academic_year string, period string, year string, institution_id string")
SIGNALS_SCHEMA = f"signals array<{_struct(SIGNAL_ITEM)}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (doc, content): UTF-8 with or without byte-order mark, else Latin-1."""
    b = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    decoded = F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^﻿", "")).otherwise(
        F.decode("content", "ISO-8859-1"))
    return b.select(F.element_at(F.split("path", "/"), -1).alias("doc"), decoded.alias("content"))


def parse_canonical_json(docs: DataFrame, source_type: str = "synthetic_generated") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admissions, placements, ranking) rows with provenance of documents holding the three canonical arrays."""
    d = docs.withColumn("_j", F.from_json("content", CANONICAL_SCHEMA))
    prov = F.struct(F.col("doc").alias("source_id"), F.lit(source_type).alias("source_type"), F.lit("1.0.0").alias("version"))

    def rows(name: str) -> DataFrame:
        return d.select(prov.alias("provenance"), F.inline(f"_j.{name}"))
    return rows("admissions"), rows("placements"), rows("cet_ranking")


def parse_signals_json(docs: DataFrame) -> DataFrame:
    """Long signals of documents with a ``signals`` array; metric, period and year names have aliases."""
    d = docs.select("doc", F.posexplode(F.from_json("content", SIGNALS_SCHEMA)["signals"]).alias("_i", "_s")).select("doc", "_i", "_s.*")
    given = lambda *c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in c])
    d = d.where("coalesce(value, '') <> ''").select(
        "doc", "_i", F.coalesce(given("metric", "metric_name", "name"), F.concat(F.lit("metric_"), F.col("_i") + 1)).alias("label"),
        F.col("value").alias("raw_value"), F.col("unit").alias("_unit"), F.lower("domain").alias("_domain"), given("department").alias("department"),
        given("program").alias("program"), given("academic_year", "period", "year").alias("time_period"), "institution_id")
    d = with_classification(d, "label").withColumn("_p", parse_numeric(F.col("raw_value")))
    year = F.regexp_extract("time_period", r"\b(20\d{2})\b", 1)
    d = d.withColumns({
        "domain": F.coalesce("_domain", "domain"), "unit": F.coalesce("_unit", "_p.unit", "unit"), "value": F.col("_p.value"),
        "academic_year": F.when(year != "", year).cast("int"),
        "location": F.concat(F.lit("JSON $.signals["), F.col("_i"), F.lit("]"))})
    fp = fingerprint(F.col("institution_id"), F.col("domain"), F.col("metric_name"), F.col("academic_year"), F.col("time_period"),
                     F.col("department"), F.col("location"), F.col("raw_value"))
    return d.withColumns({
        "signal_id": F.concat(F.lit("sig_"), fp), "confidence": F.lit(0.98),
        "risk_contribution": risk_contribution(F.col("metric_name"), F.col("value"), F.col("unit"), F.col("polarity"))}).drop(
        "_i", "_unit", "_domain", "_p")


def _unquoted(field: Column) -> Column:
    """Value of a raw field: a field that opens with a quote ends at its first odd run of quotes, doubled quotes before it stand for one."""
    inner = F.substr(field, F.lit(2))
    run = F.regexp_extract(inner, ODD_RUN, 0)
    at, n = F.regexp_instr(inner, F.lit(ODD_RUN)), F.length(run)
    single = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    closed = F.concat(single(F.substr(inner, F.lit(1), at - 1)), F.substr(run, F.lit(1), F.floor(n / 2).cast("int")), F.substr(inner, at + n))
    return F.when(~field.startswith('"'), field).when(run == "", single(inner)).otherwise(closed)


#: A run of an odd number of quotes, matched without backtracking.
ODD_RUN = r'(?<!")"(?:"")*+(?!")'


def parse_delimited(docs: DataFrame, sheet: str = "CSV") -> DataFrame:
    """Cell table of delimited text; the first line that is not blank tells tab, semicolon or comma.

    Texts are cut at every delimiter and line break, quoted or not. Each piece then maps the state before it (outside or inside of quotes)
    to the state after it: a piece that opens with a quote enters quotes, an odd run of quotes leaves them. Such a map either sets
    the state, keeps it or swaps it, so the composed state at every piece is the last state set, swapped as often as pieces have swapped it
    since: two running aggregates over the pieces of a document, linear in its length whatever the number of quotes.

    Quotes count only at the start of a field; text behind a closing quote belongs to the field; quotes left open reach the end of the text. Rows are numbered
    before blank ones are dropped, and a row of several lines counts once. Cells are trimmed outside of quotes.
    """
    blank = F.regexp_extract("content", r"^\s*+", 0)
    head = F.concat(F.substring_index(F.translate(blank, "\r", "\n"), "\n", -1), F.regexp_extract("content", r"^\s*+([^\r\n]*+)", 1))
    n = lambda ch: F.length(head) - F.length(F.replace(head, F.lit(ch), F.lit("")))
    d = docs.where("content IS NOT NULL").select("doc", "content", F.when(n("\t") > n(","), "\t").when(n(";") > n(","), ";").otherwise(",").alias("_sep"),
                                                 F.monotonically_increasing_id().alias("_d"))  # documents may share a name
    pieces = F.split("content", F.concat(F.lit("(?<=["), F.col("_sep"), F.lit(r"\n])|(?<=\r)(?!\n)")), -1)
    d = d.select("doc", "_d", "_sep", F.posexplode(pieces).alias("_i", "_t"))
    line_end = F.col("_t").endswith("\n") | F.col("_t").endswith("\r")
    drop = F.when(F.col("_t").endswith("\r\n"), 2).when(line_end | F.col("_t").endswith(F.col("_sep")), 1).otherwise(0)
    d = d.withColumns({"_ends": line_end, "_body": F.substr("_t", F.lit(1), F.length("_t") - drop)})
    opens = F.col("_body").startswith('"')
    d = d.withColumns({"_from_out": opens & ~F.substr("_body", F.lit(2)).rlike(ODD_RUN), "_from_in": ~F.col("_body").rlike(ODD_RUN)})
    sofar = W.partitionBy("_d").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = W.partitionBy("_d").orderBy("_i")
    odd = lambda c: c % 2 == 1
    d = d.withColumn("_swaps", F.sum((F.col("_from_out") & ~F.col("_from_in")).cast("int")).over(sofar))
    sets = F.when(F.col("_from_out") == F.col("_from_in"), F.col("_from_out") != odd(F.col("_swaps")))
    d = d.withColumn("_in", F.coalesce(F.last(sets, ignorenulls=True).over(sofar), F.lit(False)) != odd(F.col("_swaps")))
    # a piece starts a field where its predecessor ended outside of quotes, and a row where that one also ended a line
    d = d.withColumns({"_starts": ~F.lag("_in", 1, False).over(step), "_row_ends": F.col("_ends") & ~F.col("_in")})
    d = d.withColumn("_row_starts", F.lag("_row_ends", 1, True).over(step))
    d = d.withColumns({"row": F.sum(F.col("_row_starts").cast("int")).over(sofar), "_f": F.sum(F.col("_starts").cast("int")).over(sofar)})
    d = d.withColumn("col", F.col("_f") - F.last(F.when(F.col("_row_starts"), F.col("_f")), ignorenulls=True).over(sofar) + 1)
    last_piece = F.lead("_i").over(step).isNull()
    d = d.withColumn("_alone", F.col("_row_starts") & (F.col("_row_ends") | last_piece)).where(~(F.col("_alone") & (F.trim("_body") == "")))
    # pieces inside of quotes keep the delimiter or line break that they end with
    part = F.struct("_i", F.when(F.col("_in"), F.col("_t")).otherwise(F.col("_body")).alias("_t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "")
    f = d.groupBy("_d", "doc", "row", "col").agg(whole.alias("_x"))  # on the pieces' own partitions
    return f.select("doc", F.lit(sheet).alias("sheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                    F.when(F.col("_x").startswith('"'), _unquoted(F.col("_x"))).otherwise(F.trim("_x")).alias("text"))


def parse_text_lines(docs: DataFrame) -> DataFrame:
    """Numbered non-empty lines with the section they stand in; headings themselves are dropped."""
    d = docs.select("doc", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("_n", "_t")).withColumns({
        "line_no": F.col("_n") + 1, "text": F.trim("_t")}).where("text <> ''")
    t = F.col("text")
    heading = t.startswith("#") | ((F.length(t) < 75) & t.endswith(":") & ~t.rlike(r"\d"))
    title = F.regexp_replace(F.regexp_replace(t, "^#+", ""), "^[: ]+|[: ]+$", "")
    sec = F.last(F.when(heading, title), ignorenulls=True).over(W.partitionBy("doc").orderBy("line_no"))
    return d.withColumns({"ctx": F.coalesce(sec, F.lit("Section 1")), "_h": heading}).where("NOT _h").select("doc", "line_no", "ctx", "text")


FEED_ITEM = "struct<title: string, description: string, link: string, pubDate: string, source: struct<_VALUE: string, _url: string>>"
RSS_SCHEMA = f"channel struct<item: array<{FEED_ITEM}>>"
ATOM_SCHEMA = ("entry array<struct<title: struct<_VALUE: string, _type: string>, summary: struct<_VALUE: string, _type: string>, "
               "content: struct<_VALUE: string, _type: string>, link: array<struct<_VALUE: string, _href: string>>>>")


def parse_feed(docs: DataFrame, default_publisher: str = "RSS Feed") -> DataFrame:
    """Articles of RSS 2.0 items, or of Atom entries where a document has no item; entity declarations are refused."""
    safe = docs.where(~F.col("content").rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)\b"))
    opts = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    d = safe.withColumns({"_rss": F.from_xml("content", RSS_SCHEMA, opts), "_atom": F.from_xml("content", ATOM_SCHEMA, opts)})
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    items = F.filter(F.col("_rss.channel.item"), lambda x: x.isNotNull())
    rss = d.where(F.coalesce(F.size(items), F.lit(0)) > 0).select("doc", F.posexplode(items).alias("position", "_x")).select(
        "doc", "position", tidy(F.col("_x.title")).alias("title"), tidy(F.col("_x.description")).alias("summary"),
        tidy(F.col("_x.link")).alias("url"), tidy(F.col("_x.pubDate")).alias("published_raw"),
        F.coalesce(F.nullif(F.trim(F.col("_x.source._VALUE")), F.lit("")), F.lit(default_publisher)).alias("publisher"))
    atom = d.where(F.coalesce(F.size(items), F.lit(0)) <= 0).select("doc", F.posexplode("_atom.entry").alias("position", "_x")).select(
        "doc", "position", tidy(F.col("_x.title._VALUE")).alias("title"),
        tidy(F.coalesce(F.col("_x.content._VALUE"), F.col("_x.summary._VALUE"))).alias("summary"),
        tidy(F.coalesce(F.get("_x.link", F.lit(0))["_href"], F.get("_x.link", F.lit(0))["_VALUE"])).alias("url"),
        F.lit("").alias("published_raw"), F.lit(default_publisher).alias("publisher")).where("title <> '' OR summary <> ''")
    return rss.unionByName(atom).withColumn("independence_group", F.replace(F.lower("publisher"), F.lit(" "), F.lit("_")))


Q = "[\"']"
NQ = "[^\"']"


def _meta(html: Column, names: str) -> Column:
    x = F.regexp_extract(html, rf"(?i)<meta[^>]+(?:name|property)={Q}(?:{names}){Q}[^>]+content={Q}({NQ}+){Q}", 1)
    return F.when(x != "", x)


def absolute_link(page: Column, href: Column) -> Column:
    """Resolve a link against its page: absolute, scheme-relative, root-relative, query-only or path-relative."""
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(page, r"[?#].*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(path, href))
            .otherwise(F.concat(folder, href)))


def extract_html(pages: DataFrame, max_links: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Language, title, author, publication time, distinct absolute links and plain text of each page, whole unless limits are given."""
    h = F.col("html")
    some = lambda p, g=1: F.nullif(F.regexp_extract(h, p, g), F.lit(""))
    lang = F.lower(F.coalesce(some(rf"(?i)<html[^>]*\blang={Q}?([a-zA-Z\-]+){Q}?"), F.lit("en")))
    raw_title = F.coalesce(_meta(h, "og:title|twitter:title"), some(r"(?is)<title[^>]*>(.*?)</title>"), F.col("url"))
    d = pages.withColumns({
        "language": lang, "_t": sanitize_text(raw_title),
        "author": sanitize_text(_meta(h, r"author|article:author|dc\.creator")),
        "published_raw": F.coalesce(_meta(h, r"article:published_time|pubdate|date|dc\.date"), some(rf"(?i)<time[^>]+datetime={Q}({NQ}+){Q}")),
        "_a": F.transform(F.regexp_extract_all(h, F.lit(rf"(?i)<a[^>]+href={Q}([^\"'#]+){Q}"), F.lit(1)), lambda x: F.trim(x))})
    keep = F.filter("_a", lambda x: ~x.rlike("^(javascript:|mailto:|tel:|data:)"))
    links = F.filter(F.transform(keep, lambda x: absolute_link(F.col("url"), x)), lambda x: x.rlike("^https?://"))
    return d.select(
        "page_id", "url", "language", F.when(F.col("_t") != "", F.col("_t")).otherwise(F.col("url")).alias("title"),
        F.nullif("author", F.lit("")).alias("author"), F.try_to_timestamp("published_raw").alias("published_at"),
        sanitize_text(h, max_chars).alias("content"), (F.array_distinct(links) if max_links is None else F.slice(F.array_distinct(links), 1, max_links)).alias("links"))


# Format of a file by extension and by its first bytes (hex).
EXTENSIONS = {"xlsx": "XLSX", "xlsm": "XLSX", "csv": "CSV", "tsv": "CSV", "txt": "TXT", "md": "TXT", "json": "TXT", "pdf": "PDF",
              "docx": "DOCX", "pptx": "PPTX"}
IMAGE_EXT = ["png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif", "gif"]
MEDIA_EXT = ["wav", "mp3", "m4a", "mp4", "mov", "webm", "ogg"]
IMAGE_MAGIC = ["89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A"]
MEDIA_MAGIC = ["494433", "4F676753", "1A45DFA3"]


def inventory_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Format and refusal reason of each file by magic bytes, then extension. The members of a ZIP container are not opened:
    an Office extension on a ZIP is taken at its word."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    x = F.hex(F.substring(F.col(content), 1, 16))
    starts = lambda *m: F.exists(F.array(*[F.lit(i) for i in m]), lambda i: F.startswith(x, i))
    at8 = F.substring(x, 17, 8)
    fmt = F.create_map(*[F.lit(i) for kv in EXTENSIONS.items() for i in kv])
    zipped = starts("504B0304")
    kind = (
        F.when(starts("255044462D"), "PDF").when(zipped & ext.isin("xlsx", "xlsm", "docx", "pptx"), fmt[ext]).when(zipped, "UNSUPPORTED")
        .when(starts("D0CF11E0A1B11AE1") | starts("4D5A", "7F454C46"), "UNSUPPORTED")
        .when(starts(*IMAGE_MAGIC) | (starts("52494646") & (at8 == "57454250")) | ext.isin(IMAGE_EXT), "IMAGE")
        .when(starts(*MEDIA_MAGIC) | (starts("52494646") & (at8 == "57415645")) | (F.substring(x, 9, 8) == "66747970") | ext.isin(MEDIA_EXT), "AUDIO_VIDEO")
        .otherwise(F.coalesce(fmt[ext], F.lit("UNSUPPORTED"))))
    reason = (F.when(zipped & (kind == "UNSUPPORTED"), "generic ZIP archive").when(starts("D0CF11E0A1B11AE1"), "legacy Office container")
              .when(starts("4D5A", "7F454C46"), "executable").when(kind == "UNSUPPORTED", "unsupported format"))
    return files.select(F.col(name).alias("path"), kind.alias("format"), reason.alias("reason"))
