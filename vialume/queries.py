"""Registered queries of the graph operators over the order tables' routing graph."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialume.functions.geo import bearing, combined_bound, haversine, travel_bound
from vialume.operators import cuts, evaluate, features, potentials, relax, sampling, search, traffic
from vialume.plans import comparisons, datasets, learning
from vialume.plans.store import materialize, release, shared_dir
from vialume.session import ship
from vialume.sources import graphs, models
from vialume.sources.graphs import Graph

LAT, LON = 45.4064, 11.8768
BANDS = [(0.0, 5.0), (5.0, 15.0), (15.0, 60.0)]
BAND_NAMES = ["Centro", "Periferia", "Provincia"]
#: Places of the regional centres, and the regional bands.
CENTRES = {"Padova": (LAT, LON), "Venezia": (45.4408, 12.3155), "Verona": (45.4384, 10.9916), "Vicenza": (45.5455, 11.5354), "Treviso": (45.6669, 12.2450), "Belluno": (46.1424, 12.2166), "Rovigo": (45.0712, 11.7901)}
REGIONAL_BANDS = [(0.0, 10.0), (10.0, 30.0), (30.0, 80.0)]
V_MAX = 1000.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


_stores: dict[tuple[str, str], Graph] = {}


def graph_store(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph of a folder, written once a session as Parquet: the canonical form that operators read.

    Of edges only (u, v, key, travel_time) is written; the other columns are made of these where they are read.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        g = graphs.narrow_from_tables(ship(spark), sf_dir)
        parts = max(1, min(64, g.nodes.count() // 50_000))
        _stores[at] = graphs.described(Graph(materialize(cuts.cluster_by_cell(g.nodes, partitions=parts), "nodes"), materialize(g.edges, "edges")))
        release(spark)
    return _stores[at]


def query(f: Callable[[Graph], DataFrame]) -> Callable:
    """Register a query over the derived graph under the function's name; the two scans derive it anew."""
    scan = f.__name__ in ("nodes", "edges", "weight_variants")
    QUERIES[f.__name__] = lambda spark, sf_dir: f(graphs.from_tables(ship(spark), sf_dir) if scan else graph_store(spark, sf_dir))
    return f


def milli(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5).cast("long")


def _targets(g: Graph, *ids: int) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "target_id long")


def _sources(g: Graph, *ids: int) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "source long")


def _to(g: Graph, *ids: int) -> DataFrame:
    """Nodes with the place of each of a few targets (ty, tx)."""
    t = g.nodes.filter(F.col("node_id").isin(*ids)).select(F.col("node_id").alias("target_id"), F.col("y").alias("ty"), F.col("x").alias("tx"))
    return g.nodes.crossJoin(F.broadcast(t))


def _pot(g: Graph, *ids: int, v_max: float = V_MAX) -> DataFrame:
    return potentials.analytic(g.nodes, _targets(g, *ids), v_max)


def _banded(g: Graph) -> DataFrame:
    names = F.array(*[F.lit(n) for n in BAND_NAMES])
    return cuts.classify_bands(g.nodes, LAT, LON, BANDS).withColumn("name", F.element_at(names, F.col("band") + 1))


def _pairs(g: Graph, n: int) -> DataFrame:
    p = sampling.pairs_by_band(_banded(g), g.nodes, n)
    return p.withColumn("query_id", F.xxhash64("nome"))


@query
def nodes(g):
    return g.nodes


@query
def edges(g):
    return g.edges.select("u", "v", "key", F.array_join("highway", "|").alias("tags"), milli(F.try_element_at("bearing", F.lit(1))).alias("bearing_milli"), "travel_time")


@query
def weight_variants(g):
    return g.edges.select("u", "v", "key", *graphs.VARIANTS)


@query
def edges_missing_weight(g):
    w = F.when((F.col("u") + F.col("v") + F.col("key")) % 17 != 0, F.col("travel_time_d"))
    return g.edges.select("u", "v", "key", F.coalesce(w, F.lit(0)).alias("w_reduce"), F.coalesce(w, F.lit(1)).alias("w_search"))


@query
def haversine_to_target(g):
    return _to(g, 7).select("node_id", milli(haversine("y", "x", "ty", "tx")).alias("dist_mm"))


@query
def bearing_to_target(g):
    return _to(g, 7).filter("node_id <> 7").select("node_id", milli(bearing("y", "x", "ty", "tx")).alias("bearing_milli"))


@query
def heading_deviation(g):
    rows = _to(g, 7).filter("node_id <> 7").join(features.road_attributes(g), "node_id")
    return rows.select("node_id", milli(features.deviation(F.col("bearings"), bearing("y", "x", "ty", "tx"))).alias("deviation_milli"))


@query
def heuristic_bounds(g):
    e = travel_bound("y", "x", "ty", "tx")
    learned = F.when(F.col("node_id") % 3 != 0, F.col("e") * 2)
    return _to(g, 7).withColumn("e", e).select("node_id", milli(F.col("e")).alias("euclid_milli"), milli(combined_bound(F.col("e"), learned)).alias("combined_milli"))


@query
def radius_filter(g):
    return cuts.within_radius(g.nodes, LAT, LON, 15.0).select("node_id")


@query
def band_classify(g):
    return _banded(g).select("node_id", "band", milli(F.col("dist_km")).alias("dist_m"))


@query
def nearest_reachable_node(g):
    return cuts.nearest_reachable(g, LAT, LON)


@query
def bbox_cut(g):
    return cuts.bbox_cut(g, 3, 7).edges.select("u", "v", "key")


@query
def ellipse_cut(g):
    return cuts.ellipse_cut(g, 3, 7, 5.0).edges.select("u", "v", "key")


@query
def ellipse_cut_indexed(g):
    return cuts.ellipse_cut_indexed(g, 3, 7, 5.0).nodes.select("node_id")


@query
def ensure_target(g):
    return cuts.ensure_target(cuts.induced(g, g.nodes.filter("node_id % 5 = 1")), g, 7).nodes.select("node_id")


@query
def degree(g):
    return features.degree(g.edges)


@query
def road_score(g):
    return features.road_attributes(g).select("node_id", "degree", "road_score")


def _all_pairs(g: Graph) -> DataFrame:
    return g.nodes.select("node_id").crossJoin(_targets(g, 7, 11))


@query
def base_features(g):
    return features.base_features(_all_pairs(g), g.nodes).withColumn("dist_mm", milli(F.col("haversine_dist_m"))).drop("haversine_dist_m")


@query
def advanced_features(g):
    rows = features.advanced_features(_all_pairs(g).filter("node_id <> target_id"), g)
    return rows.select("node_id", "target_id", "node_degree", "target_degree", "node_road_score", "target_road_score", milli(F.col("heading_deviation_deg")).alias("deviation_milli"))


@query
def parallel_edge_min(g):
    return features.parallel_min(g.edges)


@query
def parallel_edge_first(g):
    return features.parallel_first(g.edges)


@query
def traffic_reweight(g):
    return traffic.reweight(g, [(LAT, LON)], seed=42).edges.select("u", "v", "key", milli(F.col("travel_time")).alias("t_ms"), "travel_time_d")


@query
def traffic_periods(g):
    return traffic.periods(g, [(LAT, LON)]).select("periodo", "u", "v", "key", "travel_time_d")


@query
def sssp(g):
    return relax.shortest(relax.merged_edges(g), g.nodes, _sources(g, 0)).select("node_id", "d")


@query
def sssp_relaxation(g):
    return relax.shortest(relax.merged_edges(g), g.nodes, _sources(g, 0), "relaxation").select("node_id", "d")


@query
def farthest_nodes(g):
    return sssp(g).orderBy(F.col("d").desc(), "node_id").limit(10)


@query
def sssp_reverse_multi_target(g):
    return relax.shortest_to(relax.merged_edges(g), g.nodes, _targets(g, 7, 11, 19))


@query
def reachable(g):
    return relax.reachable(relax.merged_edges(g), g.nodes, _sources(g, 0, 5))


@query
def potentials_analytic(g):
    return _pot(g, 7, 11).select("target_id", "node_id", "y_hat_int")


@query
def reduced_edges(g):
    return potentials.reduced_edges(g.edges, _pot(g, 7, 11))


@query
def reduced_summary(g):
    return potentials.reduced_summary(reduced_edges(g))


@query
def phi(g):
    return relax.repair_potentials(reduced_edges(g), g.nodes)


@query
def phi_relaxation(g):
    return relax.repair_potentials(potentials.reduced_edges(g.edges, _pot(g, 7)), g.nodes, "relaxation")


@query
def repaired_edges(g):
    return potentials.repaired_edges(g.edges, _pot(g, 7, 11), phi(g))


@query
def sssp_on_repaired(g):
    """Distances on repaired edges, turned back by the potentials."""
    p = materialize(_pot(g, 7), "potentials")
    f = materialize(relax.repair_potentials(potentials.reduced_edges(g.edges, p), g.nodes), "phi")
    san = potentials.repaired_edges(g.edges, p, f).groupBy("u", "v").agg(F.min("w_san").alias("w"))
    pi = p.join(f, ["target_id", "node_id"]).select("node_id", (F.col("y_hat_int") + F.col("phi")).alias("pi"))
    start = pi.filter("node_id = 0").select(F.col("pi").alias("pi0"))
    d = relax.shortest(san, g.nodes, _sources(g, 0)).join(pi, "node_id").crossJoin(start)
    return d.select("node_id", (F.col("d") - F.col("pi0") + F.col("pi")).alias("d_original"))


@query
def predecessors(g):
    m = relax.merged_edges(g)
    return relax.predecessors(m, relax.shortest(m, g.nodes, _sources(g, 0)).select("node_id", "d"), 0).select("node_id", "hops", "pred")


@query
def path(g):
    return relax.path(predecessors(g), 7)


@query
def dijkstra_explored_raw(g):
    q = _pairs(g, 10)
    return search.explored_closed_form(relax.merged_edges(g), g.nodes, q).join(q.select("query_id", "nome"), "query_id").select("nome", "dist", "n_explored")


def _searched(g: Graph, rows: DataFrame, q: DataFrame) -> DataFrame:
    d = F.when(F.col("dist") != float("inf"), F.col("dist")).cast("long")
    return rows.join(q.select("query_id", "nome"), "query_id").select("nome", d.alias("dist"), "n_explored")


@query
def dijkstra_explored_kernel(g):
    q = _pairs(g, 10)
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q), q)


@query
def astar_exhaustive(g):
    q = _pairs(g, 10)
    return search.exhaustive_closed_form(relax.merged_edges(g), g.nodes, q).join(q.select("query_id", "nome"), "query_id").select("nome", "dist", "n_explored")


@query
def astar_exhaustive_kernel(g):
    q = _pairs(g, 10)
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q, search.EXHAUSTIVE, heuristic=True), q)


@query
def astar_closed(g):
    q = _pairs(g, 10)
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q, search.CLOSED, heuristic=True), q)


@query
def astar_reopen(g):
    q = _pairs(g, 10)
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q, search.REOPEN, heuristic=True), q)


def _repaired_search(g: Graph) -> DataFrame:
    """(query_id, source, target, dist, n_explored, raw_dist) of the search on each target's repaired edges."""
    q = _pairs(g, 10)
    p = potentials.analytic(g.nodes, q.select(F.col("target").alias("target_id")).distinct(), V_MAX)
    rows = search.repaired_search(materialize(features.parallel_min(g.edges), "merged"), q, p)
    if rows is None:  # a component is too large for a task: all targets' edges are repaired
        p = materialize(p, "potentials")
        f = materialize(relax.repair_potentials(potentials.reduced_edges(g.edges, p), g.nodes), "phi")
        pi = p.join(f, ["target_id", "node_id"]).select(F.col("target_id").alias("target"), "node_id", (F.col("y_hat_int") + F.col("phi")).alias("pi"))
        at = lambda c: pi.select("target", F.col("node_id").alias(c), F.col("pi").alias(f"pi_{c}"))
        rows = search.search_repaired(potentials.repaired_edges(g.edges, p, f), q).join(at("source"), ["target", "source"])
        rows = rows.join(pi.filter("node_id = target").select("target", F.col("pi").alias("pi_target")), "target")
        rows = rows.withColumn("raw_dist", F.col("dist") - F.col("pi_source") + F.col("pi_target"))
    return rows.join(q.select("query_id", "nome"), "query_id")


def _whole(d: str) -> Column:
    return F.when(F.col(d) != float("inf"), F.col(d)).cast("long").alias("dist")


@query
def dijkstra_explored_repaired(g):
    return _repaired_search(g).select("nome", _whole("dist"), "n_explored")


@query
def dijkstra_repaired_distance(g):
    """Distances that the repaired search finds, turned back by the potentials: those of the raw graph."""
    return _repaired_search(g).select("nome", _whole("raw_dist"))


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query
def sign_sanity(g):
    return evaluate.sign_sanity(g.edges, _pot(g, 7, 11))


@query
def consistency_sample_as_reference(g):
    return _rounded(evaluate.sample_check(g.edges, _pot(g, 7, 11)), "pct_violazioni", "violazione_media_s")


@query
def consistency_sample_documented(g):
    return _rounded(evaluate.sample_check(g.edges, _pot(g, 7, 11), sign=evaluate.DOCUMENTED), "pct_violazioni", "violazione_media_s")


@query
def consistency_path(g):
    return _rounded(evaluate.path_check(features.parallel_first(g.edges), path(g), _pot(g, 7)), "pct_violazioni", "violazione_media_s")


@query
def consistency_visited(g):
    d = sssp(g)
    goal = d.filter("node_id = 7").select(F.col("d").alias("goal"))
    seen = d.crossJoin(F.broadcast(goal)).filter("d < goal OR (d = goal AND node_id <= 7)")
    return _rounded(evaluate.visited_check(g.edges, seen, _pot(g, 7)), "pct_violazioni", "violazione_media_s")


@query
def sample_targets_per_band(g):
    return sampling.per_stratum(_banded(g).select("band", "node_id"), ["band"], 20)


@query
def sample_sources_per_target_band(g):
    rows = datasets.rings(g, LAT, LON, BANDS, 3, 50)
    return rows.join(cuts.classify_bands(g.nodes, LAT, LON, BANDS).select("node_id", "band"), "node_id").select("target_id", "band", "node_id")


@query
def pairs_by_band(g):
    return sampling.pairs_by_band(_banded(g), g.nodes)


@query
def pairs_by_trip_type(g):
    return sampling.pairs_by_trip(_banded(g), g.nodes)


def _frame(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("node_id", "target_id", milli(F.col("haversine_dist_m")).alias("dist_mm"), "tempo_reale_s", *more)


@query
def dataset_standard(g):
    return _frame(datasets.standard(g, LAT, LON))


@query
def dataset_ring(g):
    return _frame(datasets.rings(g, LAT, LON, BANDS))


@query
def dataset_regional(g):
    return _frame(datasets.regional(g, CENTRES, REGIONAL_BANDS), "centro")


@query
def dataset_unified(g):
    one = {"centro": (LAT, LON)}
    return _frame(datasets.unified(g, one, BANDS, traffic=True), "centro_riferimento", "periodo_giorno")


def _row_ids(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("node_id").alias("row_id"), "node_id", F.lit(7).cast("long").alias("target_id"))


@query
def neighbours_long(g):
    return datasets.neighbours_long(_row_ids(g), g).select("row_id", "vicino", "peso", milli(F.col("haversine_dist_m")).alias("dist_mm"))


@query
def neighbours_wide(g):
    rows = datasets.neighbours_wide(_row_ids(g), g)
    both = F.zip_with("vicini", "pesi", lambda v, w: F.when(v.isNotNull(), F.concat_ws(":", v.cast("string"), F.rint(w * 10).cast("long").cast("string"))))
    text = F.array_join(F.filter(both, lambda s: s.isNotNull()), " ")
    return rows.select("row_id", F.when(text != "", text).alias("vicini"), F.size(F.filter("vicini", lambda v: v.isNotNull())).cast("long").alias("n_vicini"))


def _guess(c: str) -> Column:
    return (F.col(c) * 37 % 1000) / F.lit(10.0)


def _lossy(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("node_id").alias("row_id"), "node_id", _guess("node_id").alias("p"), ((F.col("node_id") * 53 % 1000) / F.lit(10.0)).alias("y"))


def _loss(rows: DataFrame) -> DataFrame:
    off = lambda c: F.floor(F.col(c) * 1000 + 0.3719).cast("long")  # cut where means of tenths over few edges never fall
    return rows.select("row_id", off("grad").alias("grad_milli"), off("hess").alias("hess_milli"))


@query
def loss_mean(g):
    near = g.edges.select(F.col("u").alias("row_id"), (F.col("travel_time_d") / F.lit(10.0)).alias("peso"), _guess("v").alias("h"))
    return _loss(datasets.mean_loss(_lossy(g), near))


@query
def loss_bellman_min(g):
    wide = datasets.neighbours_wide(_row_ids(g), g)
    stime = F.transform("vicini", lambda v: F.coalesce((v * 37 % 1000) / F.lit(10.0), F.lit(float("inf"))))
    return _loss(datasets.bellman_loss(_lossy(g).join(wide.withColumn("stime", stime), "row_id")))


@query
def lambda_schedule(g):
    t = g.nodes.sparkSession.range(310).withColumnRenamed("id", "t")
    return t.select("t", F.round(datasets.schedule(F.col("t"), 300, 0.5, 2.0) * 1000000).cast("long").alias("lambda_ppm"))


@query
def anchor_split(g):
    return potentials.anchors(g.nodes, 7).select("node_id", "anchor")


@query
def nearest_anchor(g):
    return potentials.nearest_anchor(potentials.anchors(g.nodes, 7))


@query
def interpolate_linear(g):
    values = _pot(g, 7).select("node_id", F.col("y_hat").alias("value"))
    return potentials.interpolate(potentials.anchors(g.nodes, 7), values)


def _training(g: Graph) -> DataFrame:
    return datasets.rings(g, LAT, LON, BANDS, 3, 40)


@query
def train_baseline(g):
    return learning.train_standard(datasets.rings(g, LAT, LON, BANDS))[1]


@query
def train_consistency(g):
    return learning.train_consistent(g, _training(g), penalty=(0.5, 2.0), rounds=2, rate=0.5, depth=4)[1]


@query
def predict_potentials(g):
    model, _ = learning.train_standard(_training(g), rounds=3, depth=4)
    return potentials.predicted(g, _targets(g, 7), model)


@query
def train_regional(g):
    return learning.train_regional(g, datasets.regional(g, CENTRES, REGIONAL_BANDS))[1]


@query
def train_unified(g):
    """Few rounds with traffic, each row's neighbours in its own period."""
    one = {"centro": (LAT, LON)}
    busy = {p: traffic.reweight(g, list(one.values()), f, seed=42 + p) for p, f in traffic.PERIODS.items()}
    return learning.train_unified(busy, datasets.unified(g, one, BANDS, 2, 30, traffic=True), rounds=2, rate=0.5, depth=4)[1]


@query
def anchored_prediction(g):
    model, _ = learning.train_standard(datasets.rings(g, LAT, LON, BANDS))
    return potentials.anchored(g, 7, model)


@query
def wall_clock(g):
    return comparisons.timed(g, 3, 7, 20.0)


@query
def precision_benchmark(g):
    return comparisons.precision_benchmark(g, _pairs(g, 10))


@query
def distances_reduced_and_original(g):
    """Distances from node 0 through the repaired graph, in reduced and in original weights."""
    p = materialize(_pot(g, 7), "potentials")
    f = materialize(relax.repair_potentials(potentials.reduced_edges(g.edges, p), g.nodes), "phi")
    own = potentials.repaired_edges(g.edges, p, f).groupBy("u", "v").agg(F.min("w_san").alias("w"))
    d = relax.shortest(own, g.nodes, _sources(g, 0)).select(F.lit(7).cast("long").alias("target_id"), "source", "node_id", "d")
    return potentials.original_and_reduced(d, p, f)


@query
def astar_learned(g):
    q = _pairs(g, 10)
    t = q.select(F.col("target").alias("target_id")).distinct()
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q, search.REOPEN, heuristic=True, potentials=potentials.analytic(g.nodes, t, V_MAX)), q)


@query
def astar_learned_exhaustive(g):
    q = _pairs(g, 10)
    t = q.select(F.col("target").alias("target_id")).distinct()
    return _searched(g, search.search(relax.merged_edges(g), g.nodes, q, search.EXHAUSTIVE, heuristic=True, potentials=potentials.analytic(g.nodes, t, 60.0)), q)


@query
def dataset_ring_advanced(g):
    rows = datasets.rings(g, LAT, LON, BANDS, advanced=True)
    return _frame(rows, "node_degree", "target_degree", "node_road_score", "target_road_score")


@query
def cell_clustering(g):
    nodes = cuts.cluster_by_cell(g.nodes)
    return nodes.select("node_id", F.floor(F.col("y") / 0.05).alias("cell_y"), F.floor(F.col("x") / 0.05).alias("cell_x"))


@query
def graphml_roundtrip(g):
    spark = g.nodes.sparkSession
    path = f"{shared_dir(spark)}/graphml-{uuid.uuid4().hex}"
    graphs.write_graphml(g, path)
    return graphs.read_graphml(spark, path).edges.select("u", "v", "key", F.array_join("highway", "|").alias("tags"), milli(F.try_element_at("bearing", F.lit(1))).alias("bearing_milli"), "travel_time")


@query
def osm_payload_nodes(g):
    e = F.array(F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon")))
    return graphs.osm_nodes(g.nodes.select(F.to_json(F.struct(F.lit("0.6").alias("version"), e.alias("elements"))).alias("value")))


@query
def potential_tokens(g):
    token = F.when(F.col("node_id") % 11 == 0, "inf").otherwise(F.format_string("%d.75", F.col("node_id") * 37 % 1000 - 500))
    line = g.nodes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", token.alias("t")))), lambda s: s["t"]), " ").alias("value"))
    return graphs.parse_potential_tokens(line)


@query
def solver_seconds(g):
    log = F.when(F.col("node_id") % 5 != 0, F.format_string("done, Time: %d.%d s", F.col("node_id") % 60, F.col("node_id") % 10)).otherwise("no clock")
    return g.nodes.select("node_id", graphs.elapsed_seconds(log).alias("seconds"))


@query
def edge_file_lines(g):
    """Text of a solver's input: the number of nodes with the super node, then the merged edges."""
    return graphs.edge_lines(relax.merged_edges(g), super_index=g.nodes.count())


#: A model of two trees in the public JSON format.
TREES_JSON = json.dumps({"learner": {"feature_names": ["node_lat", "node_lon"], "learner_model_param": {"base_score": "2.5E0"}, "gradient_booster": {"model": {"trees": [
    {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0], "split_conditions": [45.5, 1.5, 11.75, -2.0, 4.25], "default_left": [0, 0, 1, 0, 0]},
    {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [12.0, 0.25, 8.0], "default_left": [1, 0, 0]}]}}}})


@query
def json_model_prediction(g):
    spark = g.nodes.sparkSession
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    spark.createDataFrame([(TREES_JSON,)], "value string").coalesce(1).write.text(path)
    rows = g.nodes.select("node_id", F.when(F.col("node_id") % 7 != 0, F.col("y")).alias("node_lat"), F.when(F.col("node_id") % 5 != 0, F.col("x")).alias("node_lon"))
    return models.TreeTable.load(spark, path).transform(rows).select("node_id", "prediction")


@query
def explored_comparison(g):
    return comparisons.explored(g, _pairs(g, 100)).drop("query_id")


@query
def explored_comparison_cut(g):
    return comparisons.explored_with_cut(g, _pairs(g, 100), 20.0).drop("query_id")


def _two_models(g: Graph) -> DataFrame:
    q = _pairs(g, 30)
    t = q.select(F.col("target").alias("target_id")).distinct()
    return comparisons.models(g, q, {"v130": potentials.analytic(g.nodes, t), "v1000": potentials.analytic(g.nodes, t, V_MAX)})


@query
def model_comparison(g):
    return _two_models(g).drop("query_id")


@query
def static_vs_traffic(g):
    return comparisons.static_vs_traffic(g, traffic.reweight(g, [(LAT, LON)], seed=42), _pairs(g, 30)).drop("query_id")


@query
def precision_sweep(g):
    return comparisons.precision_sweep(g, _targets(g, 7, 11))


@query
def precision_summary(g):
    rows = comparisons.precision_sweep(g, _targets(g, 7, 11)).withColumn("trovato", F.lit(True))
    return evaluate.summary_by(rows, "configurazione", "n_negative").select("configurazione", "n_negative_media", "n_negative_mediana")


@query
def edge_text_roundtrip(g):
    return graphs.parse_edge_lines(graphs.edge_lines(relax.merged_edges(g)))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic result frame from orders."""
    o = ship(spark).read.parquet(f"{sf_dir}/orders.parquet")
    of = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % 3 + 1).cast("int"))
    k = F.col("o_orderkey")
    return o.select(of(BAND_NAMES, "o_orderkey").alias("fascia"), of(["standard", "anelli", "regionale"], "o_custkey").alias("modello"), F.concat(F.lit("coppia "), (k % 50).cast("string")).alias("coppia"), ((k * 37 % 2001 - 1000) / F.lit(10.0)).alias("riduzione_pct"), (k * 13 % 997).alias("n_negativi"), (k % 7 != 0).alias("trovato"))


def result_query(f: Callable[[DataFrame], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(_results(spark, sf_dir))
    return f


@result_query
def aggregate_by_band(rows):
    return _rounded(evaluate.by_band(rows), "media", "std", "pct_positive")


@result_query
def aggregate_overall(rows):
    return _rounded(evaluate.overall(rows), "media", "pct_positive")


@result_query
def aggregate_by_model(rows):
    return _rounded(evaluate.by_model(rows), "media", "std")


@result_query
def summary_by_model(rows):
    return _rounded(evaluate.summary_by(rows, "modello", "riduzione_pct"), "riduzione_pct_media", "riduzione_pct_std")


@result_query
def grid_by_model(rows):
    return _rounded(evaluate.grid_by_model(rows.filter("fascia <> 'Centro' OR modello <> 'anelli'")), "media", "std")


@result_query
def pivot_model_pair(rows):
    top = rows.groupBy("coppia", "modello").agg(F.max("riduzione_pct").alias("riduzione_pct"))
    return evaluate.pivot_models(top, ["standard", "anelli", "regionale"])


@result_query
def boxplot_stats(rows):
    return _rounded(evaluate.box_stats(rows, "n_negativi", 1.0), "q1", "mediana", "q3", "basso", "alto")


def mae_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ship(spark).read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_totalprice").alias("label"), (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 1000).alias("prediction"))
    return evaluate.regression_metrics(rows).select(F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


QUERIES["mae_r2"] = mae_r2
