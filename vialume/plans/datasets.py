"""Training sets of exact times to sampled targets, neighbour frames and consistency losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vialume.functions.geo import units
from vialume.operators.cuts import classify_bands, classify_bands_of_centres, within_radius
from vialume.operators.features import advanced_features, base_features
from vialume.operators.relax import merged_edges, shortest_to
from vialume.operators.sampling import per_stratum
from vialume.operators.traffic import PERIODS, reweight
from vialume.plans.store import materialize, release
from vialume.sources.graphs import Graph

#: Most ids that are sent to every task (some MB).
MOST_IDS = 200_000
COLUMNS = ["node_id", "target_id", "node_lat", "node_lon", "target_lat", "target_lon", "haversine_dist_m", "tempo_reale_s"]


def _framed(pairs: DataFrame, graph: Graph, weight: str, advanced: bool = False) -> DataFrame:
    rows = pairs.withColumn("tempo_reale_s", F.col("d") / F.lit(units(weight))).drop("d")
    if not advanced:
        return base_features(rows, graph.nodes)
    rows = materialize(rows, "sampled")  # few, and read more than once
    release(rows.sparkSession)
    return advanced_features(rows, _around(graph, rows))


def _around(graph: Graph, pairs: DataFrame) -> Graph:
    """The nodes of ``pairs`` and all edges into and out of them, stored: what their features need. The graph itself if they are many."""
    ids = pairs.select(F.explode(F.array("node_id", "target_id")).alias("node_id")).distinct()
    if ids.count() > MOST_IDS:
        return graph
    ids = materialize(ids, "wanted")
    of = lambda end: F.broadcast(ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_wanted")))
    edges = graph.edges.select("u", "v", "highway", "bearing").join(of("u"), "u", "left").join(of("v"), "v", "left")
    edges = materialize(edges.filter("u_wanted OR v_wanted").select("u", "v", "highway", "bearing"), "around")
    return Graph(graph.nodes.join(F.broadcast(ids), "node_id", "left_semi"), edges)


def standard(graph: Graph, lat: float, lon: float, radius_km: float = 15.0, n_targets: int = 60, n_nodes: int = 400, weight: str = "travel_time_d", seed: int = 42, method: str = "auto") -> DataFrame:
    """Targets sampled in a radius; per target, nodes of the radius that reach it (itself included)."""
    zone = within_radius(graph.nodes, lat, lon, radius_km).select("node_id")
    targets = per_stratum(zone, [], n_targets, seed=seed).select(F.col("node_id").alias("target_id"))
    first = zone.select(F.lit(0).alias("stratum"), "node_id"), n_nodes, seed
    d = shortest_to(merged_edges(graph, weight), graph.nodes, targets, method, first).join(zone, "node_id", "left_semi")
    return _framed(per_stratum(d, ["target_id"], n_nodes, seed=seed), graph, weight).select(*COLUMNS)


def rings(graph: Graph, lat: float, lon: float, bands: list[tuple[float, float]], per_band: int = 20, per_pair: int = 150, weight: str = "travel_time_d", seed: int = 42, advanced: bool = False, method: str = "auto") -> DataFrame:
    """Targets sampled in each band; per target and band, nodes that reach it, itself excluded."""
    banded = classify_bands(graph.nodes, lat, lon, bands).select("node_id", "band")
    targets = per_stratum(banded, ["band"], per_band, seed=seed).select(F.col("node_id").alias("target_id"))
    first = banded.select(F.col("band").alias("stratum"), "node_id"), per_pair, seed
    d = shortest_to(merged_edges(graph, weight), graph.nodes, targets, method, first).filter("node_id <> target_id").join(banded, "node_id")
    rows = _framed(per_stratum(d, ["target_id", "band"], per_pair, seed=seed), graph, weight, advanced)
    extra = [c for c in rows.columns if c not in (*COLUMNS, "band")]
    return rows.select(*COLUMNS, *extra)


def regional(graph: Graph, centres: dict[str, tuple[float, float]], bands: list[tuple[float, float]], per_band: int = 5, per_pair: int = 100, weight: str = "travel_time_d", seed: int = 42, method: str = "auto") -> DataFrame:
    """Rings around each of several centres, with the centre's name. All centres' targets are asked for at once, in one set of jobs."""
    banded = classify_bands_of_centres(graph.nodes, centres, bands).select("centro", "node_id", "band")
    targets = materialize(per_stratum(banded, ["centro", "band"], per_band, seed=seed).select("centro", F.col("node_id").alias("target_id")).distinct(), "targets")
    number = F.array_position(F.array(*[F.lit(c) for c in centres]), F.col("centro"))
    first = banded.select((number * 1000 + F.col("band")).cast("long").alias("stratum"), "node_id"), per_pair, seed
    d = shortest_to(merged_edges(graph, weight), graph.nodes, targets.select("target_id").distinct(), method, first).filter("node_id <> target_id")
    d = d.join(F.broadcast(targets), "target_id").join(banded, ["centro", "node_id"])
    return _framed(per_stratum(d, ["centro", "target_id", "band"], per_pair, seed=seed), graph, weight).select(*COLUMNS, "centro")


def unified(graph: Graph, centres: dict[str, tuple[float, float]], bands: list[tuple[float, float]], per_band: int = 15, per_pair: int = 50, weight: str = "travel_time_d", traffic: bool = False, seed: int = 42) -> DataFrame:
    """Rings around each centre, in each period of the day if ``traffic``."""
    if not traffic:
        return regional(graph, centres, bands, per_band, per_pair, weight, seed).withColumnRenamed("centro", "centro_riferimento")
    parts = []
    for p, f in PERIODS.items():
        busy = reweight(graph, list(centres.values()), f, seed=seed + p)
        parts.append(regional(busy, centres, bands, per_band, per_pair, weight, seed).withColumn("periodo_giorno", F.lit(float(p))))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("centro", "centro_riferimento")


def split(rows: DataFrame, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the pair, whatever the partitions."""
    part = F.pmod(F.xxhash64("node_id", "target_id", F.lit(seed)), F.lit(1000)) < int(test * 1000)
    return rows.filter(~part), rows.filter(part)


def neighbours_long(rows: DataFrame, graph: Graph, weight: str = "travel_time_d") -> DataFrame:
    """(row_id, vicino, peso, base features of the neighbour): all edges out of each row's node; peso in seconds."""
    out = graph.edges.select("u", F.col("v").alias("vicino"), (F.coalesce(weight, F.lit(0)) / F.lit(units(weight))).alias("peso"))
    pairs = rows.select("row_id", F.col("node_id").alias("u"), "target_id").join(out, "u").select("row_id", "target_id", F.col("vicino").alias("node_id"), "peso")
    return base_features(pairs, graph.nodes).withColumnRenamed("node_id", "vicino")


def neighbours_wide(rows: DataFrame, graph: Graph, weight: str = "travel_time_d", k: int = 4) -> DataFrame:
    """(row_id, vicini): the first ``k`` distinct successors in order of their ids, weight of the first key; padded with infinite weights."""
    first = graph.edges.groupBy("u", "v").agg(F.min_by(F.coalesce(weight, F.lit(0)), "key").alias("w"))
    order = Window.partitionBy("u").orderBy("v")
    top = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = top.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("v").alias("vicino"), (F.col("w") / F.lit(units(weight))).alias("peso")))).alias("l"))
    got = rows.select("row_id", F.col("node_id").alias("u")).join(lists, "u", "left")
    pad = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at(F.col("l"), i)[c], none))
    return got.select("row_id", pad("vicino", F.lit(None).cast("long")).alias("vicini"), pad("peso", F.lit(float("inf"))).alias("pesi"))


def neighbours_first_k(rows: DataFrame, graphs: dict[int | None, Graph], weight: str = "travel_time_d", k: int = 4) -> DataFrame:
    """(row_id, peso, base features, periodo_giorno if ``rows`` have it): the first ``k`` successors of each row's node in its own period's graph.

    ``graphs`` maps periods (None without traffic) to graphs; rows meet edges by node and period.
    """
    period = F.coalesce(F.col("periodo_giorno").cast("int"), F.lit(-1)) if "periodo_giorno" in rows.columns else F.lit(-1)
    order = Window.partitionBy("u").orderBy("v")
    parts = []
    for p, g in graphs.items():
        first = g.edges.groupBy("u", "v").agg((F.min_by(F.coalesce(weight, F.lit(0)), "key") / F.lit(units(weight))).alias("peso"))
        parts.append(first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("u", F.col("v").alias("vicino"), "peso", F.lit(-1 if p is None else p).alias("periodo")))
    own = rows.select("row_id", F.col("node_id").alias("u"), "target_id", period.alias("periodo"), *[c for c in ("periodo_giorno",) if c in rows.columns])
    pairs = own.join(reduce(DataFrame.unionByName, parts), ["u", "periodo"]).withColumnRenamed("vicino", "node_id").drop("u", "periodo")
    return base_features(pairs, next(iter(graphs.values())).nodes)


def bellman_min_loss(rows: DataFrame, near: DataFrame, weight: float = 0.5) -> DataFrame:
    """(row_id, grad, hess) against the smallest ``peso + h`` of a row's neighbours. rows: row_id, p, y. near: row_id, peso, h."""
    least = near.groupBy("row_id").agg(F.min(F.col("peso") + F.col("h")).alias("least"))
    v = F.when(F.col("least").isNull() | (F.col("least") == float("inf")), 0.0).otherwise(F.greatest(F.col("p") - F.col("least"), F.lit(0.0)))
    return rows.join(least, "row_id", "left").select("row_id", (F.col("p") - F.col("y") + 2 * weight * v).alias("grad"), (1 + 2 * weight * (v > 0).cast("double")).alias("hess"))


def mean_loss(rows: DataFrame, near: DataFrame, weight: float = 0.5) -> DataFrame:
    """(row_id, grad, hess) of half the squared error plus ``weight`` times the mean squared violation.

    rows: row_id, p, y. near: row_id, peso, h. A violation is max(0, p - peso - h), 0 where it isn't finite.
    """
    v = F.col("p") - F.col("peso") - F.col("h")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.greatest(v, F.lit(0.0)))
    agg = near.join(rows.select("row_id", "p"), "row_id").groupBy("row_id").agg(F.avg(v).alias("viol"), F.avg((v > 0).cast("double")).alias("ind"))
    out = rows.join(agg, "row_id", "left").na.fill(0.0, ["viol", "ind"])
    return out.select("row_id", (F.col("p") - F.col("y") + 2 * weight * F.col("viol")).alias("grad"), (1 + 2 * weight * F.col("ind")).alias("hess"))


def bellman_loss(rows: DataFrame, weight: float = 0.5) -> DataFrame:
    """(row_id, grad, hess) against the smallest of ``pesi + stime`` (arrays); rows without finite neighbours have no violation."""
    least = F.array_min(F.zip_with("pesi", "stime", lambda a, b: a + b))
    v = F.when(least.isNull() | (least == float("inf")), 0.0).otherwise(F.greatest(F.col("p") - least, F.lit(0.0)))
    return rows.select("row_id", (F.col("p") - F.col("y") + 2 * weight * v).alias("grad"), (1 + 2 * weight * (v > 0).cast("double")).alias("hess"))


def schedule(t: Column | int, rounds: int, first: float, last: float):
    """The consistency weight in round ``t`` of ``rounds``."""
    if isinstance(t, Column):
        return F.lit(first) + F.least(F.lit(1.0), (t + 1) / F.lit(float(rounds))) * (last - first)
    return first + min(1.0, (t + 1) / rounds) * (last - first)
