"""Distances, geofences, nearby assets and density clusters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.num import key9, rnd
from riskspark.operators.dedup import severity_rank
from riskspark.operators.signals import STAGES

EARTH_RADIUS_KM = 6371.0088
# Coordinates used for an institution that only names its city.
CITY_COORDINATES = [
    ("ballari", 15.1394, 76.9214), ("bellary", 15.1394, 76.9214), ("bengaluru", 12.9716, 77.5946),
    ("bangalore", 12.9716, 77.5946), ("hubballi", 15.3647, 75.1240), ("dharwad", 15.4589, 75.0078),
    ("mysuru", 12.2958, 76.6394),
]
KM_PER_DEGREE = 111.0  # below the true length of a degree of latitude, so bands only widen


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), F.lit(2.0)))
    c = 2.0 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))
    return rnd(key9(EARTH_RADIUS_KM * c), 2)


def _within_radius(queries: DataFrame, points: DataFrame, cell_deg: int = 5) -> DataFrame:
    """Pairs of query and point closer than the query's radius.

    Range join on a grid: points sit in one cell of ``cell_deg`` degrees; a query visits every cell its circle can
    touch. Longitude spread grows toward the poles and wraps at the date line; near a pole all columns are visited.
    """
    ncol = 360 // cell_deg
    dlat = F.col("radius_km") / KM_PER_DEGREE
    row = lambda x: F.floor((x + 90.0) / cell_deg).cast("int")
    top = F.least(F.lit(90.0), F.abs("q_lat") + dlat)
    # widest longitude difference on the circle; all columns once the circle reaches a pole
    ratio = F.sin(F.least(F.lit(1.5707), F.radians(dlat))) / F.greatest(F.cos(F.radians("q_lat")), F.lit(1e-9))
    dlon = F.when((top >= 89.9) | (ratio >= 1.0), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 0.1)
    col0 = F.floor((F.col("q_lon") - dlon + 180.0) / cell_deg).cast("int")
    n_cols = F.least(F.lit(ncol), F.floor((F.col("q_lon") + dlon + 180.0) / cell_deg).cast("int") - col0 + 1)
    q = queries.withColumns({
        "_r": F.explode(F.sequence(row(F.greatest(F.lit(-90.0), F.col("q_lat") - dlat)),
                                   row(F.least(F.lit(90.0), F.col("q_lat") + dlat))))})
    q = q.withColumn("_k", F.explode(F.sequence(F.lit(0), n_cols - 1))).withColumn("_c", F.pmod(col0 + F.col("_k"), F.lit(ncol)))
    p = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumns({
        "_r": row(F.col("latitude")), "_c": F.pmod(F.floor((F.col("longitude") + 180.0) / cell_deg).cast("int"), F.lit(ncol))})
    d = q.drop("_k").join(p, ["_r", "_c"]).withColumn(
        "distance_km", haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("latitude"), F.col("longitude")))
    return d.where("distance_km <= radius_km").drop("_r", "_c")


def geofence(queries: DataFrame, events: DataFrame, as_of_s: Column | int, min_severity: str | None = None) -> DataFrame:
    """Events with coordinates inside each query's circle and time range, at or above the least severity.

    Events older than the longest range of all queries are dropped before the grid join.
    """
    as_of = as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s)
    e = events.where(severity_rank(F.col("severity"), 1) >= {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}[min_severity or "LOW"])
    longest = queries.agg(F.max("hours_back")).scalar()
    e = e.select("event_id", "published_s", "latitude", "longitude", "severity").where(F.col("published_s") >= as_of - longest * 3600)
    hit = _within_radius(queries, e)
    return hit.where(F.col("published_s") >= as_of - F.col("hours_back") * 3600).select(
        "query_id", "event_id", "severity", "distance_km")


def nearby_assets(queries: DataFrame, entities: DataFrame, institutions: DataFrame) -> DataFrame:
    """Located entities of three types and institutions (by city where they give no coordinates) near each query."""
    city = F.create_map(*[x for n, la, lo in CITY_COORDINATES for x in (F.lit(n), F.array(F.lit(la), F.lit(lo)))])
    at = city[F.lower(F.trim(F.coalesce("city", F.lit(""))))]
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    inst = institutions.select(
        F.col("institution_id").alias("asset_id"), F.lit("Registered Institution").alias("asset_type"),
        F.when(own, F.col("latitude")).otherwise(F.get(at, F.lit(0))).alias("latitude"),
        F.when(own, F.col("longitude")).otherwise(F.get(at, F.lit(1))).alias("longitude"))
    ent = entities.where(F.col("entity_type").isin("Infrastructure", "Organization", "Asset")).select(
        F.col("entity_id").alias("asset_id"), F.col("entity_type").alias("asset_type"), "latitude", "longitude")
    return _within_radius(queries, ent.unionByName(inst)).select("query_id", "asset_id", "asset_type", "distance_km")


def density_clusters(events: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Centre, worst severity, highest stage and size of the located events per country and city."""
    e = events.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumns({
        "country": F.coalesce("country", F.lit("Unknown")), "city": F.coalesce("city", F.lit("Area"))})
    rank = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("stage"))
    g = e.groupBy("country", "city").agg(
        rnd(key9(F.avg("latitude")), 4).alias("center_latitude"), rnd(key9(F.avg("longitude")), 4).alias("center_longitude"),
        F.count("*").alias("event_count"), F.max(severity_rank(F.col("severity"), 1)).alias("_s"), F.max(rank).alias("_g"))
    out = g.select(
        F.concat(F.lit("cluster_"), F.substring(F.sha2(F.lower(F.concat_ws(":", "country", "city")), 256), 1, 10)).alias("cluster_id"),
        "country", "city", "center_latitude", "center_longitude", "event_count",
        F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), F.col("_s")).alias("max_severity"),
        F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.greatest(F.col("_g").cast("int"), F.lit(1))).alias("highest_stage"))
    if assets is None:
        return out
    n = assets.groupBy(F.lower("city").alias("_c")).agg(F.count("*").alias("n_assets"))
    return out.join(n, F.lower("city") == F.col("_c"), "left").drop("_c").fillna(0, ["n_assets"])
