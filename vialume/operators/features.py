"""Node attributes and model features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.functions.geo import bearing, deviation, first_tag, haversine, road_score
from vialume.sources.graphs import Graph

BASE = ["node_lat", "node_lon", "target_lat", "target_lon", "haversine_dist_m"]
EXTRA = ["node_degree", "target_degree", "node_road_score", "target_road_score", "heading_deviation_deg"]


def degree(edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges in and out; a self-loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def road_attributes(graph: Graph) -> DataFrame:
    """(node_id, degree, road_score, bearings): one row a node; score 0 and no bearings without edges out."""
    tag = road_score(first_tag(F.col("highway")))
    head = F.try_element_at("bearing", F.lit(1))
    out = graph.edges.groupBy(F.col("u").alias("node_id")).agg(F.max(tag).alias("road_score"), F.collect_list(head).alias("bearings"))
    rows = graph.nodes.select("node_id").join(degree(graph.edges), "node_id", "left").join(out, "node_id", "left")
    return rows.select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("road_score", F.lit(0.0)).alias("road_score"), F.coalesce("bearings", F.array().cast("array<double>")).alias("bearings"))


def base_features(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (node_id, target_id, ...) with coordinates of both ends and their distance."""
    at = lambda k, p: nodes.select(F.col("node_id").alias(k), F.col("y").alias(f"{p}_lat"), F.col("x").alias(f"{p}_lon"))
    rows = pairs.join(at("node_id", "node"), "node_id").join(at("target_id", "target"), "target_id")
    return rows.withColumn("haversine_dist_m", haversine("node_lat", "node_lon", "target_lat", "target_lon"))


def advanced_features(pairs: DataFrame, graph: Graph) -> DataFrame:
    """Base features, degrees and road scores of both ends, and the node's heading deviation towards the target."""
    attributes = road_attributes(graph)
    of = lambda k, p: attributes.select(F.col("node_id").alias(k), F.col("degree").cast("double").alias(f"{p}_degree"), F.col("road_score").alias(f"{p}_road_score"), *([F.col("bearings")] if p == "node" else []))
    rows = base_features(pairs, graph.nodes).join(of("node_id", "node"), "node_id").join(of("target_id", "target"), "target_id")
    ideal = bearing("node_lat", "node_lon", "target_lat", "target_lon")
    return rows.withColumn("heading_deviation_deg", deviation(F.col("bearings"), ideal)).drop("bearings")


def needs_advanced(columns: list[str]) -> bool:
    """Whether a model with these inputs wants the advanced features."""
    return any(c in EXTRA for c in columns)


def parallel_min(edges: DataFrame, weight: str = "travel_time_d", default: int = 0, loops: bool = False) -> DataFrame:
    """(u, v, w): the cheapest of parallel edges."""
    rows = edges if loops else edges.filter("u <> v")
    return rows.groupBy("u", "v").agg(F.min(F.coalesce(weight, F.lit(default))).alias("w"))


def parallel_first(edges: DataFrame, weight: str = "travel_time_d") -> DataFrame:
    """(u, v, w): the first key of parallel edges."""
    return edges.groupBy("u", "v").agg(F.min_by(F.coalesce(weight, F.lit(0)), "key").alias("w"))
