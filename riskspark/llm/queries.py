"""Registered queries of the numbered operators: each runs its operator over the whole intended table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, centroids, decontam, exact_dedup, langid, ngram_join, pii, quality, token_count, topk, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional check SQL."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_nbsvm")
def op1(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_maxscore_top_k", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""")
def op2(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_token_counts")
def op3(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_language_id")
def op5(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


# Fixed values: (verdict, host, path prefix).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op6_url_filter")
def op6(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


#: A-Z to a-z only; DuckDB's lower() also changes other letters.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[k:k + 12], ' ') FOR k IN range(1, len(w) - 11)] END) AS g, least(len(w), 13) AS m FROM i),
l AS (SELECT DISTINCT m FROM b),
p AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, w FROM d, l WHERE len(w) >= m),
g AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM p),
o AS (SELECT g.doc_id, g.m, g.k, b.item_id FROM g JOIN b ON b.g = g.g AND b.m = g.m),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(h.n > 0 AND 20 * h.n >= len(d.w), FALSE) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""")
def op4(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_ngram_jaccard_join", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id WHERE r.m < u.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
""")
def op7(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_bpe_round_trip")
def op8(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_warc_bundles", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND (page_id IS NULL OR page_id < m) AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND (page_id IS NULL OR page_id < m) AND m IS NOT NULL THEN m END AS refers_to
FROM q
""")
def op9(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op10_pii_skip_chain")
def op10(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def _rounds(k: int, rounds: int) -> str:
    """Check SQL of centroid clustering: one pair of statements for every round."""
    floor_of = "(({s} - ((({s} % {n}) + {n}) % {n})) // {n})"
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)])::BIGINT"
    nearest = f"SELECT v.vec_id, v.x, arg_min(c.cluster, [{away}, c.cluster]) AS cluster, min({away}) AS distance FROM v, c{{r}} c GROUP BY v.vec_id, v.x"
    steps = ["v AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings"
             " WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
             f"c0 AS MATERIALIZED (SELECT x, (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({nearest.format(r=r)})",
                  f"m{r} AS (SELECT cluster, list({floor_of.format(s='s', n='n')} ORDER BY d) AS x FROM (SELECT cluster, d, sum(x[d])::BIGINT AS s, count(*) AS n"
                  f" FROM a{r}, range(1, 65) t(d) GROUP BY cluster, d) GROUP BY cluster)",
                  f"c{r + 1} AS MATERIALIZED (SELECT coalesce(m.x, c.x) AS x, c.cluster FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)"]
    steps.append(f"f AS MATERIALIZED ({nearest.format(r=rounds)})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT f.vec_id, f.cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.cluster = f.cluster"""


@query("op11_bisector_clusters", _rounds(8, 10))
def op11(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_block_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op13(spark, sf_dir):
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents"))
