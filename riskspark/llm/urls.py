"""URL filter: rules first, then host word segmentation and multinomial naive Bayes.

Names in hosts are split into words by unigram Viterbi; word probabilities come from counts over the visible words of all pages. The classifier
learns from all pages that a rule judges (their verdict is the class) over the words of host and path, and judges the pages without a rule.

All words and tokens count, in totals, smoothing and scores. `vocabulary` and `tokens` only bound the most frequent words and tokens that are sent to
the tasks (whole steps of a fine histogram of counts); the counts of the others reach the hosts and urls that hold them by joins.

Defined results: a null url or one without "://" has an empty host and path and no rule; with nothing to learn from, and on equal
scores, the verdict is allow; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import stage

#: Longest word that segmentation considers; host names remembered by one task.
LONGEST, REMEMBERED = 24, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    parts = lambda k: F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", k)
    return F.translate(parts(1), _UPPER, _LOWER), parts(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (verdict, host, path) that fits a host or a parent domain of it and a path prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later, longer rules win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def frequent(counts: DataFrame, limit: int, sums: list[str]) -> tuple[list, DataFrame | None, dict[str, int]]:
    """The rows of `counts` (column n) with the highest counts, at most `limit`; the other rows, None without any; number of all rows and sums over them.

    A histogram over powers of 2**(1/8) gives the least count to keep, so the driver gets no more rows than it asked for.
    """
    counts = stage(counts.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")))
    steps = sorted(counts.groupBy("step").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in sums]).collect(), reverse=True)  # a few hundred rows
    totals = {c: sum(r[c] for r in steps) for c in ("k", *sums)}
    kept, least = 0, None
    for r in steps:
        if kept + r["k"] > limit:
            break
        kept, least = kept + r["k"], r["step"]
    top = [] if least is None else counts.where(F.col("step") >= least).drop("step").collect()
    others = None if kept == totals["k"] else counts if least is None else counts.where(F.col("step") < least)
    return top, None if others is None else others.drop("step"), totals


def word_counts(pages: DataFrame, vocabulary: int) -> tuple[dict[str, int], int, DataFrame | None]:
    """The most frequent visible words of all pages, the number of all words of at most LONGEST letters, and the counts of the other words."""
    text = F.translate(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "), _UPPER, _LOWER)
    counts = pages.where("html IS NOT NULL").select(F.explode(F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))).alias("w")) \
        .where(F.length("w") <= LONGEST).groupBy("w").agg(F.count("*").alias("n"))
    top, others, totals = frequent(counts, vocabulary, ["n"])
    return {r["w"]: r["n"] for r in top}, totals["n"], others


def _flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most `most`."""
    while part := list(islice(rows, most)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def other_words(hosts: DataFrame, kept: Broadcast, others: DataFrame) -> DataFrame:
    """host, words: counts of the words in `others` that are parts of the host's runs of letters; kept: words that need no count."""
    runs = hosts.select("host", F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit("([a-z]+)"), F.lit(1)))).alias("run"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept.value[0]
        pairs = ((run, w) for b in batches for run in b.column(0).to_pylist()
                 for w in {run[s:e] for s in range(len(run)) for e in range(s + 1, min(len(run), s + LONGEST) + 1)} if w not in known)
        return _flushed(pairs, pa.schema([("run", pa.string()), ("w", pa.string())]))
    found = runs.select("run").distinct().mapInArrow(parts, "run string, w string").join(others, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("words"))
    return runs.join(found, "run").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


class Segmenter:
    """Most probable split of a name into words; an unknown word of length m has probability 10 / (total * 10**m)."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = total = max(total, 1)
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = [math.log(10 / total) - m * math.log(10) for m in range(LONGEST + 1)]
        self.seen: dict[str, list[str]] = {}

    def words(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """Words of one run of letters; more: logs of further words."""
        log = ChainMap(self.log, more) if more else self.log
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            found = max(((best[start] + log.get(name[start:end], self.unknown[end - start]), start) for start in range(max(0, end - LONGEST), end)))
            best.append(found[0])
            cut.append(found[1])
        out, end = [], len(name)
        while end:
            out.append(name[cut[end]:end])
            end = cut[end]
        return out[::-1]

    def tokens(self, host: str, path: str, others: list[dict] | None = None) -> list[str]:
        """Segmented host words, and path words; numbers stand by their length. others: counts of the host's further words."""
        known = self.seen.get(host)
        if known is None:
            more = {x["w"]: math.log(x["n"] / self.total) for x in others or ()}
            known = ["h:" + w for run in re.findall("[a-z]+", host) for w in self.words(run, more)]
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[host] = known
        return known + ["p:" + (t if t.isalpha() else f"#{len(t)}") for t in re.findall("[a-z]+|[0-9]+", path.lower())]


class Bayes:
    """Log-ratios (block against allow) of tokens and of the classes; counts: block pages' and all pages' occurrences of the most frequent tokens."""

    def __init__(self, counts: list[tuple[str, int, int]], total_b: int, total_a: int, size: int, prior: float):
        self.total_b, self.total_a, self.size, self.prior = total_b, total_a, size, prior
        self.log = {t: self.ratio(b, n - b) for t, b, n in counts}
        self.unknown = self.ratio(0, 0)

    def ratio(self, b: int, a: int) -> float:
        return math.log((b + 1) / (self.total_b + self.size)) - math.log((a + 1) / (self.total_a + self.size))

    def margin(self, tokens: list[str], others: list[dict] | None = None) -> float:
        """others: counts of tokens that are not among the most frequent ones."""
        more = {x["t"]: self.ratio(x["b"], x["n"] - x["b"]) for x in others or ()}
        return self.prior + sum(self.log[t] if t in self.log else more.get(t, self.unknown) for t in tokens)


def naive_bayes(tokens: DataFrame, limit: int) -> tuple[Bayes, DataFrame | None]:
    """The classifier with the most frequent tokens, and the counts of the other tokens; rows: verdict, tokens."""
    block = (F.col("verdict") == "block").cast("int")
    classes = tokens.agg(F.sum(block).alias("b"), F.count("*").alias("n")).first()
    b, a = classes["b"] or 0, classes["n"] - (classes["b"] or 0)
    counts = tokens.select(block.alias("b"), F.explode("tokens").alias("t")).groupBy("t").agg(F.sum("b").alias("b"), F.count("*").alias("n"))
    top, others, totals = frequent(counts, limit, ["b", "n"])
    return Bayes([(r["t"], r["b"], r["n"]) for r in top], totals["b"], totals["n"] - totals["b"], totals["k"] + 1, math.log((b + 1) / (a + 1))), others


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: int = 100_000, tokens: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, the segmented host words and the block score of every url."""
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    sc = pages.sparkSession.sparkContext
    *kept, others = word_counts(pages, vocabulary)
    words = sc.broadcast(kept)
    urls = rows.select("host", "path").distinct()
    # The counts that are not broadcast: of words by host, of tokens by url.
    if others is None:
        with_words = lambda df: df.withColumn("words", F.lit(None).cast("array<struct<w: string, n: bigint>>"))
    else:
        of_host = stage(other_words(rows.select("host").distinct(), words, others))
        with_words = lambda df: df.join(of_host, "host", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Segmenter(*words.value)
        for b in batches:
            found = [s.tokens(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["verdict", "tokens"])
    judged = with_words(rows.where("rule IS NOT NULL")).select("verdict", "host", "path", "words")
    bayes, others = naive_bayes(judged.mapInArrow(split, "verdict string, tokens array<string>"), tokens)
    model = sc.broadcast(bayes)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = Segmenter(*words.value), model.value.log
        found = ((h, p, t) for b in batches for h, p, w in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True)
                 for t in set(s.tokens(h, p, w)) if t not in known)
        return _flushed(found, pa.schema([("host", pa.string()), ("path", pa.string()), ("t", pa.string())]))
    rows = with_words(rows)
    if others is None:
        rows = rows.withColumn("rare", F.lit(None).cast("array<struct<t: string, b: bigint, n: bigint>>"))
    else:
        of_url = with_words(urls).select("host", "path", "words").mapInArrow(rare, "host string, path string, t string")
        rows = rows.join(of_url.join(others, "t").groupBy("host", "path").agg(F.collect_list(F.struct("t", "b", "n")).alias("rare")), ["host", "path"], "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = Segmenter(*words.value), model.value
        for b in batches:
            hosts, paths, verdicts, more, rest = (b.column(k).to_pylist() for k in (1, 2, 4, 5, 6))
            found = [s.tokens(*x) for x in zip(hosts, paths, more, strict=True)]
            margin = [m.margin(*x) for x in zip(found, rest, strict=True)]
            yield pa.record_batch([*b.columns[:4], pa.array([v or ("block" if m > 0 else "allow") for v, m in zip(verdicts, margin, strict=True)]),
                                   pa.array([[t[2:] for t in f if t.startswith("h:")] for f in found], pa.list_(pa.string())),
                                   pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margin])], names=["page_id", "host", "path", "rule", "verdict", "host_words", "block_score"])
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string, host_words array<string>, block_score double"
    return rows.select("page_id", "host", "path", "rule", "verdict", "words", "rare").mapInArrow(score, schema)
