"""Staged crisis signals, clusters, article trends and brief figures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.num import key9, rnd
from riskspark.operators.dedup import severity_rank
from riskspark.operators.set_join import similar_sets

STAGES = ["OBSERVATION", "SIGNAL", "DEVELOPING_EVENT", "SIGNIFICANT_EVENT", "CRISIS_CANDIDATE"]
# Signal category of an event type, and words left out of article trends.
CATEGORY = {
    "infrastructure_disruption": "infrastructure_disruption", "cyber_threat": "cyber_indicator",
    "supply_chain": "supply_chain_disruption", "climate_environmental": "environmental_indicator",
    "conflict": "conflict_indicator", "military": "escalation_indicator", "humanitarian": "humanitarian_indicator",
    "geopolitical": "escalation_indicator", "general_osint": "repeated_reports",
}
TREND_STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "into", "over", "after", "near", "amid", "report", "reports", "update", "news", "have", "been", "were"]
THREAT_TYPES = ["Threat Actor", "Intrusion Set", "Malware", "Vulnerability", "Indicator", "Observable", "Campaign",
                "Infrastructure"]


def place_key(country: str = "country", city: str = "city") -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("unknown")))
    return F.concat(low(country), F.lit(":"), low(city))


def stage_of(sev: Column, streams: Column, corroboration: Column, cluster: Column) -> Column:
    """Stage from severity rank, independent streams, corroboration and the number of events at the place."""
    official = corroboration == "Official-source confirmation"
    strong = (streams >= 2) | official
    return (
        F.when(corroboration == "Conflicting-source signal", F.when(sev >= 3, "DEVELOPING_EVENT").otherwise("SIGNAL"))
        .when((sev == 1) & (streams == 1), "OBSERVATION").when((sev == 2) & (streams == 1) & ~official, "SIGNAL")
        .when((sev >= 3) & strong, F.when((sev == 4) | ((streams >= 2) & (cluster >= 2)), "CRISIS_CANDIDATE")
              .otherwise("SIGNIFICANT_EVENT"))
        .when((sev >= 3) | (streams >= 2) | (cluster >= 2), "DEVELOPING_EVENT").otherwise("SIGNAL"))


def place_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy(place_key().alias("place")).agg(F.count("*").alias("cluster_size"))


def crisis_signals(events: DataFrame) -> DataFrame:
    """One staged signal per canonical event.

    The other events of the place are given by the place key and their number; ``related_events`` lists them on
    demand, so that a busy place is not copied into each of its own rows.
    """
    e = events.withColumn("place", place_key()).join(place_sizes(events), "place")
    cat = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    return e.select(
        F.concat(F.lit("sig_"), "event_id").alias("signal_id"), "event_id", "title", "place",
        F.coalesce(cat[F.col("event_type")], F.lit("repeated_reports")).alias("category"),
        stage_of(severity_rank(F.col("severity")), F.col("independent_source_count"), F.col("corroboration_status"),
                 F.col("cluster_size")).alias("stage"),
        "severity", "confidence", (F.col("cluster_size") - 1).alias("n_related"),
        (F.col("n_conflicts") > 0).alias("has_conflicting_sources"))


def related_events(events: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Events at the same place as each asked event, without itself."""
    e = events.select("event_id", place_key().alias("place"))
    return event_ids.join(e, "event_id").join(
        e.select("place", F.col("event_id").alias("related_id")), "place").where("related_id <> event_id").select(
        "event_id", "related_id")


def cluster_signals(events: DataFrame) -> DataFrame:
    """Places with two or more unique events: worst severity, mean confidence, number of sources."""
    u = events.where("duplicate_status = 'unique'").withColumn("place", place_key())
    g = u.groupBy("place").agg(
        F.count("*").alias("n_events"), F.max(severity_rank(F.col("severity"), 1)).alias("_s"),
        rnd(key9(F.avg("confidence")), 3).alias("confidence"), F.countDistinct("source_id").alias("n_sources"),
        F.min_by("event_id", "arrival").alias("first_event_id"))
    return g.where("n_events >= 2").select(
        F.concat(F.lit("sig_cluster_"), F.substring(F.sha2("place", 256), 1, 10)).alias("signal_id"), "place",
        F.lit("geographic_clustering").alias("category"),
        F.when(F.col("_s") >= 3, "SIGNIFICANT_EVENT").otherwise("DEVELOPING_EVENT").alias("stage"),
        F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("_s")).alias("severity"),
        "confidence", "n_events", "n_sources", "first_event_id")


def merge_bundles(bundles: list[DataFrame], key: str, organization_id: str | None = None,
                  institution_id: str | None = None) -> DataFrame:
    """Last write per id over providers in the given order; missing scope ids are filled."""
    u = None
    for i, b in enumerate(bundles):
        x = b.withColumn("_p", F.lit(i))
        u = x if u is None else u.unionByName(x, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (key, "_p")]
    out = u.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("_p")).alias("_r")).select(key, "_r.*")
    fill = {"organization_id": organization_id, "institution_id": institution_id}
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if v is not None and c in out.columns})


def brief_stats(signals: DataFrame, events: DataFrame, scope: str) -> DataFrame:
    """Situation figures per scope value: highest stage, mean confidence and open gaps."""
    rank = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage"))
    s = signals.groupBy(scope).agg(
        F.count("*").alias("n_signals"), F.max(rank).alias("_r"), rnd(key9(F.avg("confidence")), 3).alias("mean_confidence"))
    e = events.groupBy(scope).agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("corroboration_status") == "Single-source signal").alias("n_single_source"),
        F.sum("n_conflicts").alias("n_conflicts"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("n_without_coordinates"))
    return e.join(s, scope, "left").select(
        scope, "n_events", F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
        F.coalesce(F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("_r").cast("int")), F.lit("OBSERVATION")).alias("highest_stage"),
        F.coalesce("mean_confidence", F.lit(0.5)).alias("mean_confidence"), "n_single_source", "n_conflicts",
        "n_without_coordinates")


# ---- articles -----------------------------------------------------------------------------------

def article_tokens(title: Column, summary: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, summary)), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(TREND_STOP_WORDS)))


def trend_terms(articles: DataFrame, k: int | None = None) -> DataFrame:
    """Terms with the number of articles that hold them and the burst ratio; the k most frequent ones (ties alphabetically), or all."""
    t = articles.select(F.explode(article_tokens(F.col("title"), F.col("summary"))).alias("term"))
    top = t.groupBy("term").agg(F.count("*").alias("article_frequency"))
    if k is not None:
        top = top.orderBy(F.desc("article_frequency"), "term").limit(k)
    n = articles.agg(F.count("*")).scalar()
    return top.select("term", "article_frequency", rnd(
        F.col("article_frequency") / F.greatest(F.lit(1.0), n * 0.35), 2).alias("burst_ratio"))


def related_articles(articles: DataFrame, threshold: float = 0.22, key: str = "arrival") -> DataFrame:
    """Articles of similar words: exact set-similarity join at Jaccard >= threshold; articles with equal word sets count once, under the first."""
    a = articles.select(F.col(key).alias("id"), article_tokens(F.col("title"), F.col("summary")).alias("tokens"))
    return similar_sets(a, threshold).select(F.col("id_a").alias("article_a"), F.col("id_b").alias("article_b"), "copies_a", "copies_b", "jaccard")


def article_copies(articles: DataFrame, key: str = "arrival") -> DataFrame:
    """First article of every group with an identical word set and the group size."""
    a = articles.select(key, F.array_sort(article_tokens(F.col("title"), F.col("summary"))).alias("tokens")).where(F.size("tokens") > 0)
    return a.groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("set_id")).agg(
        F.min(key).alias("first_article"), F.count("*").alias("copies")).drop("set_id")


def refresh_delta(before: DataFrame, after: DataFrame, provider_status: DataFrame) -> DataFrame:
    """New records per kind after a refresh and the overall status."""
    new = after.join(before, ["kind", "record_id"], "left_anti")
    u = new.select("kind", F.lit(False).alias("down")).unionByName(provider_status.select(
        F.lit("provider").alias("kind"), F.col("status").isin("OFFLINE", "DEGRADED").alias("down")))
    is_ = lambda k: F.count_if(F.col("kind") == k)
    n = u.agg(is_("event").alias("new_events"), is_("evidence").alias("new_evidence"),
              is_("provider").alias("n_providers"), F.count_if("down").alias("n_failed"))
    status = (
        F.when((F.col("n_failed") >= F.col("n_providers")) & (F.col("n_providers") > 0), "FAILED")
        .when(F.col("n_failed") > 0, "PARTIAL_FAILURE").when((F.col("new_events") > 0) | (F.col("new_evidence") > 0), "UPDATED")
        .otherwise("NO_CHANGES"))
    return n.withColumn("status", status)


def threat_entities(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("entity_type").isin(THREAT_TYPES))
