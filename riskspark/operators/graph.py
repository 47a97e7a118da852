"""Provenance graph: nodes, edges, neighbourhoods and timelines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Graph node type of an entity type; every other entity becomes "Entity".
NODE_TYPE = {"Threat Actor": "Threat Actor", "Intrusion Set": "Threat Actor", "Organization": "Organization",
             "Infrastructure": "Infrastructure", "Indicator": "Indicator", "Observable": "Indicator",
             "Location": "Location", "Country": "Location", "City": "Location"}


def country_node(country: Column) -> Column:
    return F.concat(F.lit("loc_country_"), F.translate(F.lower(country), " ", "_"))


def day_node(ts: Column) -> Column:
    return F.concat(F.lit("tl_"), F.date_format(ts, "yyyy-MM-dd"))


def graph_nodes(sources: DataFrame, evidence: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes in build order; the first one gives type, label and confidence, the provenance of all is counted.

    The provenance ids themselves are in ``node_provenance``: a busy country or day node would otherwise carry an
    unbounded list in one row.
    """
    kind = F.create_map(*[F.lit(x) for kv in NODE_TYPE.items() for x in kv])

    def part(df, block, seq, node_id, node_type, label, conf):
        return df.select(F.struct(F.lit(block).alias("b"), seq.alias("s")).alias("_o"), node_id.alias("node_id"),
                         node_type.alias("node_type"), label.alias("label"), conf.cast("double").alias("confidence"))
    ev_day = events.where("first_observed IS NOT NULL")
    u = (
        part(sources, 0, F.lit(0).cast("bigint"), F.col("source_id"), F.lit("Source"), F.col("source_id"), F.col("reliability"))
        .unionByName(part(evidence, 1, F.col("arrival"), F.col("evidence_id"), F.lit("Evidence"), F.col("title"), F.col("confidence")))
        .unionByName(part(entities, 2, F.col("arrival"), F.col("entity_id"),
                          F.coalesce(kind[F.col("entity_type")], F.lit("Entity")), F.col("name"), F.col("confidence")))
        .unionByName(part(events, 3, F.col("arrival"), F.col("event_id"), F.lit("Event"), F.col("title"), F.col("confidence")))
        .unionByName(part(ev_day, 3, F.col("arrival"), day_node(F.col("first_observed")), F.lit("Timeline"),
                          F.concat(F.lit("Timeline "), F.date_format("first_observed", "yyyy-MM-dd")), F.lit(1.0)))
        .unionByName(part(events.where("country IS NOT NULL AND country <> ''"), 3, F.col("arrival"),
                          country_node(F.col("country")), F.lit("Location"), F.col("country"), F.lit(0.95)))
    )
    return u.groupBy("node_id").agg(
        F.min_by(F.struct("node_type", "label", "confidence"), F.col("_o")).alias("_f"), F.count("*").alias("n_mentions")
    ).select("node_id", "_f.*", "n_mentions")


def node_provenance(events: DataFrame) -> DataFrame:
    """(node, evidence) pairs of event, day and country nodes, distinct."""
    return events.select("evidence_id", F.explode(F.array(
        F.col("event_id"), day_node(F.col("first_observed")), country_node(F.col("country")))).alias("node_id")).where(
        "node_id IS NOT NULL").select("node_id", "evidence_id").distinct()


def edge_id(src: Column, rel: Column, tgt: Column) -> Column:
    """Ids hash the lower-cased triple, so spellings that differ in case share one edge."""
    return F.concat(F.lit("kge_"), F.substring(F.sha2(F.lower(F.concat_ws(":", src, rel, tgt)), 256), 1, 12))


def graph_edges(sources: DataFrame, evidence: DataFrame, events: DataFrame, relationships: DataFrame | None = None,
                involvements: DataFrame | None = None) -> DataFrame:
    """Edges in build order, first one per id. Evidence hangs on its source only where the source is known."""
    def part(df, block, seq, src, rel, tgt, conf):
        return df.select(F.struct(F.lit(block).alias("b"), seq.alias("s")).alias("_o"), src.alias("source_node_id"),
                         rel.alias("relationship_type"), tgt.alias("target_node_id"), conf.cast("double").alias("confidence"))
    known = evidence.join(sources.select("source_id"), "source_id", "left_semi")
    u = (
        part(known, 1, F.col("arrival"), F.col("source_id"), F.lit("supported-by"), F.col("evidence_id"), F.col("confidence"))
        .unionByName(part(events, 3, F.col("arrival"), F.col("event_id"), F.lit("occurred-on"),
                          day_node(F.col("first_observed")), F.lit(1.0)))
        .unionByName(part(events.where("country IS NOT NULL AND country <> ''"), 3, F.col("arrival"),
                          country_node(F.col("country")), F.lit("affected-by"), F.col("event_id"), F.col("confidence")))
        .unionByName(part(events, 3, F.col("arrival"), F.col("event_id"), F.lit("reported-by"), F.col("source_id"), F.col("confidence")))
    )
    if involvements is not None:
        u = u.unionByName(part(involvements, 3, F.col("arrival"), F.col("entity_id"), F.lit("involved-in"), F.col("event_id"), F.col("confidence")))
    if relationships is not None:
        u = u.unionByName(part(relationships, 4, F.col("arrival"), F.col("source_entity"), F.col("relationship_type"),
                               F.col("target_entity"), F.col("confidence")))
    u = u.withColumn("edge_id", edge_id(F.col("source_node_id"), F.col("relationship_type"), F.col("target_node_id")))
    return u.groupBy("edge_id").agg(
        F.min_by(F.struct("source_node_id", "relationship_type", "target_node_id", "confidence"), F.col("_o")).alias("_f")
    ).select("edge_id", "_f.*")


def seeds_by_text(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose id equals the text or whose label contains it."""
    q = text.lower()
    return nodes.where((F.lower("node_id") == q) | F.lower("label").contains(q)).select(
        F.lit(text).alias("seed"), "node_id")


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, edge) rows of the two-hop neighbourhood: every edge that touches a node of the one-hop set."""
    ends = edges.select("edge_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    both = edges.select("edge_id", F.array("source_node_id", "target_node_id").alias("_n"))
    hop1 = seeds.join(ends, "node_id").select("seed", "edge_id").distinct()
    near = hop1.join(both, "edge_id").select("seed", F.explode("_n").alias("node_id")).unionByName(
        seeds.select("seed", "node_id")).distinct()
    return near.join(ends, "node_id").select("seed", "edge_id").distinct()


def hop_nodes(edges: DataFrame, hood: DataFrame, seeds: DataFrame) -> DataFrame:
    both = edges.select("edge_id", F.array("source_node_id", "target_node_id").alias("_n"))
    return hood.join(both, "edge_id").select("seed", F.explode("_n").alias("node_id")).unionByName(
        seeds.select("seed", "node_id")).distinct()


PHASES = ["first_observed", "reported", "confirmed", "last_updated", "resolved"]


def timeline(events: DataFrame) -> DataFrame:
    """Milestones of each event that are set, in their fixed order; sort by first_observed and position to read."""
    cols = {"first_observed": "first_observed", "reported": "reported_at", "confirmed": "confirmed_at",
            "last_updated": "last_updated", "resolved": "resolved_at"}
    ms = F.filter(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(cols[p]).alias("ts")) for p in PHASES]),
                  lambda x: x["ts"].isNotNull())
    return events.select("event_id", "first_observed", F.posexplode(ms).alias("position", "_m")).select(
        "event_id", "first_observed", "position", "_m.phase", "_m.ts")
