"""Comparisons of searches with and without repaired potentials, models, cuts and weight precisions."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.functions.geo import half_even, travel_bound
from vialume.operators.cuts import ellipse_cut, ensure_target, regions, trips_with_ends
from vialume.operators.features import parallel_min
from vialume.operators.potentials import analytic, anchored, anchors, as_potential, interpolate, potential, predicted, reduced_edges, reduced_summary, repaired_edges
from vialume.operators.relax import merged_edges, repair_potentials
from vialume.operators.search import repaired_search, search, search_repaired
from vialume.plans.store import cached, materialize
from vialume.sources.graphs import VARIANTS, Graph


def _rows(queries: DataFrame, base: DataFrame, own: DataFrame, counts: DataFrame) -> DataFrame:
    b, s = F.col("nodi_baseline"), F.col("nodi_sanato")
    rows = queries.join(base.select("query_id", F.col("n_explored").alias("nodi_baseline")), "query_id").join(own.select("query_id", F.col("n_explored").alias("nodi_sanato"), "trovato", "errore"), "query_id")
    rows = rows.join(counts.select(F.col("target_id").alias("target"), F.col("n_negative").alias("n_negativi"), F.col("max_violation").alias("max_violazione")), "target")
    return rows.select("query_id", F.col("nome").alias("coppia"), "fascia", "nodi_baseline", "nodi_sanato", F.when(b == 0, 0.0).otherwise((1 - s / b) * 100).alias("riduzione_pct"), "n_negativi", "max_violazione", "trovato", "errore")


def explored(graph: Graph, queries: DataFrame, potentials: DataFrame | None = None, weight: str = "travel_time_d", clock: dict | None = None) -> DataFrame:
    """Explored nodes of Dijkstra on the graph and on its repaired form, per query (query_id, nome, source, target, fascia).

    Stages that run on their own are timed into ``clock``.
    """
    targets = queries.select(F.col("target").alias("target_id")).distinct()
    potentials = _timed(clock, "pred", lambda: materialize(potentials if potentials is not None else analytic(graph.nodes, targets), "potentials"))
    reduced = _timed(clock, "reduced", lambda: materialize(reduced_edges(graph.edges, potentials, weight), "reduced"))
    phi = _timed(clock, "bcf", lambda: materialize(repair_potentials(reduced, graph.nodes), "phi"))
    repaired = repaired_edges(graph.edges, potentials, phi, weight)
    own = _timed(clock, "dijkstra", lambda: materialize(search_repaired(repaired, queries), "repaired-search"))
    return _rows(queries, search(merged_edges(graph, weight), graph.nodes, queries), own, reduced_summary(reduced))


def _timed(clock: dict | None, name: str, run):
    began = time.perf_counter()
    out = run()
    if clock is not None:
        clock[name] = time.perf_counter() - began
    return out


def _failed(queries: DataFrame, e: Exception) -> DataFrame:
    """Rows of queries whose comparison failed as a whole."""
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    return queries.select("query_id", F.col("nome").alias("coppia"), "fascia", none("long", "nodi_baseline"), none("long", "nodi_sanato"), none("double", "riduzione_pct"), none("long", "n_negativi"), none("long", "max_violazione"), F.lit(False).alias("trovato"), F.lit(repr(e)[:500]).alias("errore"))


def explored_with_cut(graph: Graph, queries: DataFrame, padding_km: float = 5.0, weight: str = "travel_time_d") -> DataFrame:
    """The same with the repaired search on an ellipse cut; the baseline stays on the whole graph.

    Each query has a graph of its own; one set of jobs does all of them, whose rows are told apart by ``query_id``. Nodes and
    edges meet all queries where they are read, and only sums and the places in cuts go on.
    """
    total = graph.nodes.count()
    base = search(merged_edges(graph, weight), graph.nodes, queries).select("query_id", F.col("n_explored").alias("nodi_baseline"))
    trips = F.broadcast(trips_with_ends(graph.nodes, queries.select("query_id", "source", "target").collect(), padding_km))  # a benchmark's list of trips
    y_hat = lambda k, y, x: half_even(potential(k, "target", travel_bound(y, x, "ty", "tx") / 10.0))
    places = graph.nodes.crossJoin(trips).withColumn("region", regions("y", "x")).filter("region > 0")
    places = materialize(places.select("query_id", "node_id", y_hat("node_id", "y", "x").alias("y_hat_int"), "region"), "cut-nodes")
    at = lambda k: graph.nodes.select(F.col("node_id").alias(k), F.col("y").alias(f"y_{k}"), F.col("x").alias(f"x_{k}"))
    cut = graph.edges.filter("u <> v").select("u", "v", "key", F.coalesce(weight, F.lit(0)).alias("w")).join(at("u"), "u").join(at("v"), "v").crossJoin(trips)
    cut = cut.filter(regions("y_u", "x_u").bitwiseAND(regions("y_v", "x_v")) > 0)
    reduced = cut.select(F.col("query_id").alias("target_id"), "u", "v", "key", (F.col("w") + y_hat("u", "y_u", "x_u") - y_hat("v", "y_v", "x_v")).alias("w_red"))
    counts = reduced_summary(reduced).select(F.col("target_id").alias("query_id"), "n_negative", "max_violation")
    own = repaired_search(materialize(parallel_min(graph.edges, weight), "merged"), queries, places, "query_id")
    if own is None:  # a component is too large for a task: each cut's own edges are repaired
        reduced = materialize(reduced, "reduced")
        phi = materialize(repair_potentials(reduced, graph.nodes), "phi")
        of = lambda k: phi.select("target_id", F.col("node_id").alias(k), F.col("phi").alias(f"p{k}"))
        repaired = reduced.join(of("u"), ["target_id", "u"]).join(of("v"), ["target_id", "v"])
        own = search_repaired(repaired.withColumn("w_san", F.greatest(F.lit(0), F.col("w_red") + F.col("pu") - F.col("pv")).cast("long")), queries, "query_id")
    sizes = places.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = queries.join(base, "query_id").join(own.select("query_id", F.col("n_explored").alias("nodi_sanato"), "trovato", "errore"), "query_id").join(sizes, "query_id").join(counts, "query_id", "left")
    of_cut = [F.coalesce("n_negative", F.lit(0)).alias("n_negativi"), F.coalesce("max_violation", F.lit(0)).cast("long").alias("max_violazione"), "trovato", "errore"]  # a cut may have no edges
    share = [F.col("n").cast("int").alias("n_nodi_sottografo"), (F.col("n") * 100.0 / F.lit(total)).alias("pct_grafo_originale")]
    reduction = F.when(F.col("nodi_baseline") == 0, 0.0).otherwise((1 - F.col("nodi_sanato") / F.col("nodi_baseline")) * 100).alias("riduzione_pct")
    return rows.select("query_id", F.col("nome").alias("coppia"), "fascia", "nodi_sanato", *of_cut, *share, "nodi_baseline", reduction)


def models(graph: Graph, queries: DataFrame, potentials: dict[str, DataFrame], weight: str = "travel_time_d", keep: str | None = None) -> DataFrame:
    """One row for each model (a name and its potentials) and query; ``tempo_bcf_s`` is the time of the repair alone.

    A model that fails gives rows with its error. With ``keep``, a folder, a model's rows are kept there under the name, the
    weight and the queries, and read instead of computed again.
    """
    spark, parts = graph.nodes.sparkSession, []
    asked = sorted(map(str, queries.select("query_id", "nome", "source", "target", "fascia").collect())) if keep else None  # a benchmark's list of trips
    for name, p in potentials.items():

        def rows(name=name, p=p) -> DataFrame:
            clock: dict = {}
            try:
                found = materialize(explored(graph, queries, p, weight, clock), "model")
            except Exception as e:  # recorded in its rows
                found = _failed(queries, e)
            return found.withColumn("modello", F.lit(name)).withColumn("tempo_bcf_s", F.lit(clock.get("bcf")).cast("double"))

        parts.append(cached(spark, keep, {"model": name, "weight": weight, "queries": asked}, rows) if keep else rows())
    return reduce(DataFrame.unionByName, parts)


def static_vs_traffic(graph: Graph, busy: Graph, queries: DataFrame, v_max: tuple[float, float] = (130.0, 110.0)) -> DataFrame:
    """The same queries on a graph and on its traffic form, each with its own potentials."""
    targets = queries.select(F.col("target").alias("target_id")).distinct()
    rows = [explored(g, queries, analytic(g.nodes, targets, v)).withColumn("modello", F.lit(n)) for n, g, v in (("statico", graph, v_max[0]), ("traffico", busy, v_max[1]))]
    return rows[0].unionByName(rows[1])


def precision_sweep(graph: Graph, targets: DataFrame, v_max_kmh: float = 130.0) -> DataFrame:
    """Negative edges and largest violation of each target for weights in seconds, tenths, hundredths and thousandths."""
    parts = []
    for weight, scale in VARIANTS.items():
        p = analytic(graph.nodes, targets, v_max_kmh)
        p = p.withColumn("y_hat_int", F.rint(F.col("y_hat") / 10.0 * scale).cast("long"))
        parts.append(reduced_summary(reduced_edges(graph.edges, p, weight)).withColumn("configurazione", F.lit(weight)))
    return reduce(DataFrame.unionByName, parts)


def precision_benchmark(graph: Graph, queries: DataFrame, v_max_kmh: float = 130.0, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each weight precision and query: seconds of prediction, repair alone, repair with its edges, and search; negative edges; found.

    Queries run together, so a stage's seconds are shared equally among them.
    """
    parts, n = [], max(1, queries.count())
    targets = queries.select(F.col("target").alias("target_id")).distinct()
    for weight, scale in (weights or VARIANTS).items():
        p = analytic(graph.nodes, targets, v_max_kmh)
        p = p.withColumn("y_hat_int", F.rint(F.col("y_hat") / 10.0 * scale).cast("long"))
        clock: dict = {}
        try:
            rows = materialize(explored(graph, queries, p, weight, clock), "precision")
        except Exception as e:  # recorded in its rows
            rows = _failed(queries, e)
        share = lambda *stages: F.round(F.lit(sum(clock.get(s, 0.0) for s in stages) / n), 4)  # noqa: B023, E731
        times = [share("pred").alias("t_pred_s"), share("bcf").alias("t_bcf_puro_s"), share("reduced", "bcf").alias("t_bcf_totale_s"), share("dijkstra").alias("t_dijkstra_s")]
        parts.append(rows.select(F.lit(weight).alias("configurazione"), "coppia", *times, "n_negativi", "trovato"))
    return reduce(DataFrame.unionByName, parts)


def timed(graph: Graph, source: int, target: int, padding_km: float = 2.0, model=None, ratio: float = 0.1) -> DataFrame:
    """Seconds and explored nodes of plain search, the repaired pipeline, and the pipeline on an ellipse cut whose potentials are
    interpolated between anchors (asked of ``model``, or straight lines). The cut isn't timed."""
    spark = graph.nodes.sparkSession
    q = spark.createDataFrame([(0, "trip", source, target, "N/A")], "query_id long, nome string, source long, target long, fascia string")
    t = q.select(F.col("target").alias("target_id"))
    cut = ensure_target(ellipse_cut(graph, source, target, padding_km), graph, target)
    cut = Graph(materialize(cut.nodes, "cut-nodes"), materialize(cut.edges, "cut-edges"))

    def interpolated() -> DataFrame:
        if model is not None:
            return anchored(cut, target, model, ratio)
        values = analytic(cut.nodes, t).select("node_id", (-F.col("y_hat") / 10.0).alias("value"))
        rows = interpolate(anchors(cut.nodes, target, ratio), values)
        return as_potential(rows.withColumn("target_id", F.lit(target).cast("long")), F.col("value"))

    def run(f):
        began = time.perf_counter()
        row = f().collect()[0]
        return time.perf_counter() - began, row

    t0, a = run(lambda: search(merged_edges(graph), graph.nodes, q))
    t1, b = run(lambda: explored(graph, q, predicted(graph, t, model) if model is not None else None))
    t2, c = run(lambda: explored(cut, q, interpolated()))
    return spark.createDataFrame([(t0, a["n_explored"], t1, b["nodi_sanato"], t2, c["nodi_sanato"], t1 / t2, t2 / t0)], "t_vanilla_s double, n_nodi_vanilla long, t_pipeline_completa_s double, n_nodi_pipeline_completa long, t_ritaglio_interp_s double, n_nodi_ritaglio_interp long, speedup_completa_su_interp double, rapporto_interp_su_vanilla double")
