"""Geographic filters and subgraphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialume.functions.geo import KM_PER_DEGREE, haversine
from vialume.sources.graphs import Graph


def within_radius(nodes: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Nodes at most ``km`` away."""
    return nodes.filter(haversine("y", "x", lat, lon) / 1000 <= km)


def band_table(spark, bands: list[tuple[float, float]]) -> DataFrame:
    """(band, rmin, rmax) of half-open distance bands in kilometres."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(bands)], "band int, rmin double, rmax double")


def classify_bands(nodes: DataFrame, lat: float, lon: float, bands: list[tuple[float, float]]) -> DataFrame:
    """Nodes with each band that holds them; bands may overlap, nodes beyond all bands go."""
    return _banded(nodes.withColumn("dist_km", haversine("y", "x", lat, lon) / 1000), bands)


def classify_bands_of_centres(nodes: DataFrame, centres: dict[str, tuple[float, float]], bands: list[tuple[float, float]]) -> DataFrame:
    """The same for each of a few centres, with its name (centro)."""
    at = nodes.sparkSession.createDataFrame([(name, float(lat), float(lon)) for name, (lat, lon) in centres.items()], "centro string, lat double, lon double")
    d = nodes.crossJoin(F.broadcast(at)).withColumn("dist_km", haversine("y", "x", "lat", "lon") / 1000)
    return _banded(d.drop("lat", "lon"), bands)


def _banded(d: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    table = F.broadcast(band_table(d.sparkSession, bands))  # one row a band
    return d.join(table, (F.col("dist_km") >= F.col("rmin")) & (F.col("dist_km") < F.col("rmax"))).drop("rmin", "rmax")


def induced(graph: Graph, nodes: DataFrame) -> Graph:
    """The subgraph of some nodes: edges with both ends among them."""
    ids = nodes.select("node_id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return Graph(nodes, edges.select(*graph.edges.columns))


def _places(nodes: DataFrame, ids: list[int]) -> dict[int, tuple[float, float]]:
    return {r["node_id"]: (r["y"], r["x"]) for r in nodes.filter(F.col("node_id").isin(ids)).select("node_id", "y", "x").collect()}


def _ends(nodes: DataFrame, source: int, target: int) -> tuple[float, float, float, float]:
    at = {r["node_id"]: r for r in nodes.filter(F.col("node_id").isin(source, target)).select("node_id", "y", "x").collect()}
    return at[source]["y"], at[source]["x"], at[target]["y"], at[target]["x"]


def _pads(lat1: float, lat2: float, km: float) -> tuple[float, float]:
    return km / KM_PER_DEGREE, km / (KM_PER_DEGREE * math.cos(math.radians((lat1 + lat2) / 2)))


def _box(lat1: float, lon1: float, lat2: float, lon2: float, km: float) -> Column:
    pad_y, pad_x = _pads(lat1, lat2, km)
    return F.col("y").between(min(lat1, lat2) - pad_y, max(lat1, lat2) + pad_y) & F.col("x").between(min(lon1, lon2) - pad_x, max(lon1, lon2) + pad_x)


def bbox_cut(graph: Graph, source: int, target: int, padding_km: float = 2.0) -> Graph:
    """Nodes in the padded rectangle around both ends."""
    return induced(graph, graph.nodes.filter(_box(*_ends(graph.nodes, source, target), padding_km)))


def _ellipse(lat1, lon1, lat2, lon2, padding_km: float) -> tuple[Column, float, float]:
    squeeze = math.cos(math.radians((lat1 + lat2) / 2))
    flat = lambda lat, lon: F.sqrt((F.col("y") - lat) * (F.col("y") - lat) + ((F.col("x") - lon) * squeeze) * ((F.col("x") - lon) * squeeze))
    most = math.sqrt((lat1 - lat2) ** 2 + ((lon1 - lon2) * squeeze) ** 2) + padding_km / KM_PER_DEGREE
    return flat(lat1, lon1) + flat(lat2, lon2) <= most, most, squeeze


def ellipse_cut(graph: Graph, source: int, target: int, padding_km: float = 2.0) -> Graph:
    """Nodes whose detour from end to end is at most the straight way plus the padding."""
    keep, _, _ = _ellipse(*_ends(graph.nodes, source, target), padding_km)
    return induced(graph, graph.nodes.filter(keep))


def ellipse_cut_indexed(graph: Graph, source: int, target: int, padding_km: float = 2.0) -> Graph:
    """The same nodes; a rectangle around the ellipse comes first, which Parquet statistics can prune."""
    lat1, lon1, lat2, lon2 = _ends(graph.nodes, source, target)
    keep, most, squeeze = _ellipse(lat1, lon1, lat2, lon2, padding_km)
    # the long half axis is half the largest detour; a little more, as the box only has to hold the ellipse
    y, x, r = (lat1 + lat2) / 2, (lon1 + lon2) / 2, most / 2 + 1e-9
    wide = r / squeeze
    return induced(graph, graph.nodes.filter(F.col("y").between(y - r, y + r) & F.col("x").between(x - wide, x + wide) & keep))


def trips_with_ends(nodes: DataFrame, trips: list, padding_km: float = 2.0, extra_km: float = 1.0) -> DataFrame:
    """(query_id, target, ty, tx, ...) of a few trips (query_id, source, target): what ``regions`` needs of each."""
    at, rows = _places(nodes, sorted({n for q in trips for n in (q["source"], q["target"])})), []
    for q in trips:
        (sy, sx), (ty, tx) = at[q["source"]], at[q["target"]]
        squeeze = math.cos(math.radians((sy + ty) / 2))
        far = math.sqrt((sy - ty) ** 2 + ((sx - tx) * squeeze) ** 2)
        most, (pad_y, pad_x) = far + padding_km / KM_PER_DEGREE, _pads(ty, ty, extra_km)
        to_source = math.sqrt((ty - sy) * (ty - sy) + ((tx - sx) * squeeze) * ((tx - sx) * squeeze))
        rows.append((q["query_id"], q["target"], sy, sx, ty, tx, squeeze, most, *((0.0, 0.0, 0.0, 0.0) if to_source <= most else (ty - pad_y, ty + pad_y, tx - pad_x, tx + pad_x)), to_source > most))
    doubles = ", ".join(f"{c} double" for c in ("sy", "sx", "ty", "tx", "squeeze", "most", "low_y", "high_y", "low_x", "high_x"))
    return nodes.sparkSession.createDataFrame(rows, f"query_id long, target long, {doubles}, boxed boolean")


def regions(y: str, x: str) -> Column:
    """In which parts of a trip's cut (``trips_with_ends``) a place is: 1 its ellipse, 2 the box around a target outside it, 3 both.

    An edge is in the cut if a part has both its ends: those of ``ensure_target`` over ``ellipse_cut``.
    """
    y, x = F.col(y), F.col(x)
    flat = lambda lat, lon: F.sqrt((y - F.col(lat)) * (y - F.col(lat)) + ((x - F.col(lon)) * F.col("squeeze")) * ((x - F.col(lon)) * F.col("squeeze")))
    box = F.col("boxed") & y.between(F.col("low_y"), F.col("high_y")) & x.between(F.col("low_x"), F.col("high_x"))
    return F.when(flat("sy", "sx") + flat("ty", "tx") <= F.col("most"), 1).otherwise(0) + F.when(box, 2).otherwise(0)


def cluster_by_cell(nodes: DataFrame, degrees: float = 0.05, partitions: int = 64) -> DataFrame:
    """Nodes sorted by grid cell, for tables that rectangle filters shall prune."""
    cell = [F.floor(F.col(c) / degrees) for c in ("y", "x")]
    return nodes.repartitionByRange(partitions, *cell).sortWithinPartitions(*cell)


def ensure_target(cut: Graph, graph: Graph, target: int, extra_km: float = 1.0) -> Graph:
    """``cut``, united with the subgraph of a box around the target if the target isn't in it."""
    if not cut.nodes.filter(F.col("node_id") == target).isEmpty():
        return cut
    lat, lon, _, _ = _ends(graph.nodes, target, target)
    more = induced(graph, graph.nodes.filter(_box(lat, lon, lat, lon, extra_km)))
    return Graph(more.nodes.unionByName(cut.nodes).dropDuplicates(["node_id"]), more.edges.unionByName(cut.edges).dropDuplicates(["u", "v", "key"]))


def nearest_reachable(graph: Graph, lat: float, lon: float) -> DataFrame:
    """The nearest node (in raw degrees) with more than one edge out, else the nearest of all."""
    out = graph.edges.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    d = (F.col("y") - lat) * (F.col("y") - lat) + (F.col("x") - lon) * (F.col("x") - lon)
    found = graph.nodes.join(out, "node_id", "left").withColumn("d2", d)
    return found.orderBy((F.coalesce("out_degree", F.lit(0)) > 1).desc(), "d2", "node_id").limit(1).select("node_id")
