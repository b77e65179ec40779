"""Properties of searches, repairs, cuts, sources and models on small graphs."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vialume import queries
from vialume.functions import geo
from vialume.operators import cuts, evaluate, features, potentials, relax, sampling, search
from vialume.plans import datasets, learning
from vialume.sources import graphs
from vialume.sources.graphs import Graph

EDGES = "u long, v long, key int, highway array<string>, bearing array<double>, travel_time double"


def random_graph(seed: int, n: int = 40, p: float = 0.25):
    rng = random.Random(seed)
    edges = [(u, v, rng.randint(1, 15)) for u in range(n) for v in range(n) if u != v and rng.random() < p]
    return np.array(edges)


def true_distances(e, n, source):
    d = np.full(n, np.inf)
    d[source] = 0
    for _ in range(n):
        np.minimum.at(d, e[:, 1], d[e[:, 0]] + e[:, 2])
    return d


@pytest.mark.parametrize("seed", range(30))
def test_search_modes(seed):
    e, rng = random_graph(seed), random.Random(seed)
    g, n = search.Adjacency(e[:, 0], e[:, 1], e[:, 2]), 40
    d = true_distances(e, n, 0)
    back = true_distances(e[:, [1, 0, 2]], n, 1)
    good = {k: back[k] * rng.random() for k in range(n) if np.isfinite(back[k])}
    bad = {k: back[k] * (rng.uniform(1.3, 3) if rng.random() < 0.3 else rng.uniform(0.5, 0.99)) for k in range(n) if np.isfinite(back[k])}
    assert search.best_first(g, 0, 1)[0] == d[1]
    for bound in (good, bad):
        dist, seen = search.best_first(g, 0, 1, bound, search.EXHAUSTIVE)
        assert dist == d[1]
        assert seen == set(np.flatnonzero(np.isfinite(d)).tolist())
        assert search.best_first(g, 0, 1, bound, search.CLOSED)[0] >= d[1]
        assert search.best_first(g, 0, 1, bound, search.REOPEN)[0] >= d[1]
    assert search.best_first(g, 0, 1, good, search.REOPEN)[0] == d[1]
    with pytest.raises(ValueError):
        search.best_first(g, 0, 1, None, "other")


def test_unreachable_target_explores_all():
    e = np.array([(0, 1, 1), (1, 0, 1)])
    dist, seen = search.best_first(search.Adjacency(e[:, 0], e[:, 1], e[:, 2]), 0, 9)
    assert dist == float("inf") and seen == {0, 1}


def _frame(spark, e):
    return spark.createDataFrame([tuple(map(int, x)) for x in e], "u long, v long, w long")


def test_kernel_and_relaxation_agree(spark):
    e = random_graph(5, 20, 0.15)
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    src = spark.createDataFrame([(0,), (3,)], "source long")
    a, b = (sorted(map(tuple, relax.shortest(_frame(spark, e), nodes, src, m).collect())) for m in ("kernel", "relaxation"))
    assert a == b
    assert {(0, n, int(d)) for n, d in enumerate(true_distances(e, 20, 0)) if np.isfinite(d)} == {r for r in a if r[0] == 0}


def test_negative_cycle_raises():
    g = relax.Arrays(np.arange(2), np.array([0, 1]), np.array([1, 0]), np.array([1.0, -2.0]))
    with pytest.raises(ValueError):
        g.relax(np.zeros((1, 2)))


def test_path_without_cycle_over_zero_weights(spark):
    e = _frame(spark, [(0, 1, 5), (1, 2, 0), (2, 1, 0), (2, 3, 1)])
    nodes = spark.range(5).withColumnRenamed("id", "node_id")
    d = relax.shortest(e, nodes, spark.createDataFrame([(0,)], "source long")).select("node_id", "d")
    p = relax.predecessors(e, d, 0)
    assert [r["node_id"] for r in relax.path(p, 3).orderBy("step").collect()] == [0, 1, 2, 3]
    assert relax.path(p, 4).count() == 0
    assert [r["node_id"] for r in relax.path(p, 0).collect()] == [0]


@pytest.fixture(scope="module")
def tiny(spark):
    nodes = spark.createDataFrame([(0, 45.0, 11.0), (1, 45.01, 11.0), (2, 45.0, 11.02), (3, 45.3, 11.3), (4, 45.02, 11.02)], "node_id long, y double, x double")
    rows = [(0, 1, 0, ["primary"], [10.0], 9.0), (0, 1, 1, ["primary"], [10.0], 4.0), (1, 0, 0, [], None, 0.25), (1, 2, 0, ["residential", "motorway"], [90.0], None), (2, 2, 0, ["spaceway"], [0.0], 1.0), (2, 3, 0, None, [45.0], 2.5), (3, 0, 0, ["trunk"], [200.0], 0.04)]
    return Graph(nodes, graphs.with_weights(spark.createDataFrame(rows, EDGES)))


def test_edge_cases_of_features(tiny):
    got = {r["node_id"]: (r["degree"], r["road_score"], r["bearings"]) for r in features.road_attributes(tiny).collect()}
    assert got[0] == (4, 4.0, [10.0, 10.0]) and got[2] == (4, 1.0, [0.0, 45.0]) and got[4] == (0, 0.0, [])
    assert got[1][1] == 1.0 and got[3][1] == 5.0
    first = {(r["u"], r["v"]): r["w"] for r in features.parallel_first(tiny.edges).collect()}
    least = {(r["u"], r["v"]): r["w"] for r in features.parallel_min(tiny.edges).collect()}
    assert first[0, 1] == 90 and least[0, 1] == 40 and least[1, 2] == 0 and (2, 2) not in least
    assert {(r["u"], r["v"]): r["w"] for r in relax.merged_edges(tiny).collect()}[1, 2] == 1


def test_halves_go_to_even(tiny):
    w = {(r["u"], r["v"], r["key"]): (r["travel_time_s"], r["travel_time_d"]) for r in tiny.edges.collect()}
    assert w[2, 3, 0] == (2, 25) and w[1, 0, 0] == (0, 2) and w[1, 2, 0] == (None, None)


def test_repair_leaves_no_negative_edge(spark, tiny):
    p = potentials.analytic(tiny.nodes, spark.createDataFrame([(3,)], "target_id long"))
    red = potentials.reduced_edges(tiny.edges, p)
    a, b = (sorted(map(tuple, relax.repair_potentials(red, tiny.nodes, m).collect())) for m in ("auto", "relaxation"))
    assert a == b
    phi = spark.createDataFrame(a, "target_id long, node_id long, phi long")
    f = {n: v for _, n, v in a}
    assert min(r["w_red"] + f[r["u"]] - f[r["v"]] for r in red.collect()) >= 0
    assert all(r["w_san"] >= 0 for r in potentials.repaired_edges(tiny.edges, p, phi).collect())


def test_indexed_ellipse_is_the_ellipse(tiny):
    ids = lambda g: {r["node_id"] for r in g.nodes.collect()}
    for km in (0.1, 2.0, 50.0):
        assert ids(cuts.ellipse_cut(tiny, 0, 2, km)) == ids(cuts.ellipse_cut_indexed(tiny, 0, 2, km))
    assert 3 in ids(cuts.ensure_target(cuts.ellipse_cut(tiny, 0, 2, 0.1), tiny, 3))


def test_bands_are_half_open_and_may_overlap(tiny):
    got = cuts.classify_bands(tiny.nodes, 45.0, 11.0, [(0, 1.2), (0, 5), (5, 6)])
    assert {(r["node_id"], r["band"]) for r in got.collect()} == {(0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (4, 1)}


def test_deviation_and_tags(spark):
    df = spark.createDataFrame([(350.0, [10.0, 200.0]), (0.0, [])], "i double, b array<double>")
    assert [r[0] for r in df.select(geo.deviation(F.col("b"), F.col("i"))).collect()] == [20.0, 0.0]
    tags = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in tags.select(geo.first_tag(F.col("t"))).collect()] == ["a", "unclassified", "unclassified"]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="y" attr.type="double"/><key id="d1" for="node" attr.name="x" attr.type="double"/>
<key id="d2" for="edge" attr.name="travel_time" attr.type="double"/><key id="d3" for="edge" attr.name="highway" attr.type="string"/><key id="d4" for="edge" attr.name="bearing" attr.type="double"/>
<graph edgedefault="directed"><node id="1"><data key="d0">45.0</data><data key="d1">11.0</data></node><node id="2"><data key="d0">45.1</data><data key="d1">11.1</data></node>
<edge source="1" target="2" id="0"><data key="d2">2.5</data><data key="d3">['primary', 'trunk']</data><data key="d4">30.0</data></edge>
<edge source="2" target="1" id="0"><data key="d3">residential</data></edge></graph></graphml>""")
    g = graphs.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(map(tuple, g.nodes.collect())) == [(1, 45.0, 11.0), (2, 45.1, 11.1)]
    e = {r["u"]: r for r in g.edges.collect()}
    assert e[1]["highway"] == ["primary", "trunk"] and e[1]["travel_time_s"] == 2 and e[1]["bearing"] == [30.0]
    assert e[2]["travel_time"] is None and e[2]["travel_time_d"] is None and e[2]["highway"] == ["residential"]


def test_text_sources(spark):
    lines = spark.createDataFrame([("1 2 3",), ("1 2",), (" 4  5 -6 ",)], "value string")
    assert sorted(map(tuple, graphs.parse_edge_lines(lines).collect())) == [(1, 2, 3), (4, 5, -6)]
    phi = spark.createDataFrame([("0 -3.7 inf 5",)], "value string")
    assert sorted(map(tuple, graphs.parse_potential_tokens(phi).collect())) == [(0, 0), (1, -3), (3, 5)]


def test_triangles_cover_the_hull():
    rng = np.random.default_rng(1)
    p = rng.random((60, 2))
    t = potentials.triangulate(p)
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
    hull = p[np.lexsort((p[:, 1], p[:, 0]))]
    chain = []
    for pts in (hull, hull[::-1]):
        part = []
        for q in pts:
            while len(part) > 1 and np.cross(np.append(part[-1] - part[-2], 0), np.append(q - part[-2], 0))[2] <= 0:
                part.pop()
            part.append(q)
        chain += part[:-1]
    x, y = np.array(chain).T
    assert abs(area - abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2) < 0.01


def test_interpolation_is_exact_for_planes(spark):
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"node_id": np.arange(80), "y": rng.random(80), "x": rng.random(80), "anchor": np.arange(80) < 40})
    values = pd.DataFrame({"node_id": np.arange(80), "value": 3 * pts.x - 2 * pts.y + 1})
    got = potentials.interpolate(spark.createDataFrame(pts), spark.createDataFrame(values)).toPandas().sort_values("node_id")
    near = (got.value.to_numpy() - values.value.to_numpy())
    assert (np.abs(near) < 1e-6).sum() > 60


def test_pairs(spark):
    g = queries.graph_store(spark, "/root/testdata/sf0.001")
    trips = sampling.pairs_by_trip(queries._banded(g), g.nodes, 10).toPandas()
    assert (trips.source != trips.target).all() and set(trips.fascia) == {"Tratte Urbane", "Tratte Miste", "Tratte Lunghe"}
    none = queries._banded(g).filter("band > 0")
    assert sampling.pairs_by_trip(none, g.nodes, 10).count() == 0


def test_losses_without_neighbours(spark):
    rows = spark.createDataFrame([(1, 10.0, 4.0), (2, 1.0, 4.0)], "row_id long, p double, y double")
    near = spark.createDataFrame([(1, 2.0, 3.0), (1, float("inf"), 0.0)], "row_id long, peso double, h double")
    got = {r["row_id"]: (r["grad"], r["hess"]) for r in datasets.mean_loss(rows, near, 0.5).collect()}
    assert got == {1: (6.0 + 2.5, 1.5), 2: (-3.0, 1.0)}
    assert datasets.schedule(0, 10, 0.0, 1.0) == 0.1 and datasets.schedule(50, 10, 0.0, 1.0) == 1.0
    assert learning.overfitted(1.0, 1.6) and not learning.overfitted(1.0, 1.5)


def test_unknown_sign(spark):
    with pytest.raises(ValueError):
        evaluate._violation("other")


def test_relaxation_and_kernel_agree_on_fractional_weights(spark):
    e = spark.createDataFrame([(0, 1, 0.6), (1, 2, 0.7), (0, 2, 2.0)], "u long, v long, w double")
    nodes, src = spark.range(3).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0,)], "source long")
    a, b = (relax.shortest(e, nodes, src, m) for m in ("kernel", "relaxation"))
    assert a.schema["d"].dataType == b.schema["d"].dataType
    assert sorted(r["d"] for r in a.collect()) == sorted(r["d"] for r in b.collect()) == pytest.approx([0, 0.6, 1.3])


def test_relaxation_leaves_one_table(spark):
    from pathlib import Path

    from vialume.plans.store import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    out = relax.shortest(_frame(spark, random_graph(5, 20, 0.15)), nodes, spark.createDataFrame([(0,)], "source long"), "relaxation")
    assert out.count() and len(set(folder.iterdir()) - before) == 1


def test_relaxation_merges_its_tables(spark, monkeypatch):
    """More rounds than tables that are kept, nodes lowered several times and nodes that aren't reached."""
    monkeypatch.setattr(relax, "COMPACT_EVERY", 2)
    e = [(k, k + 1, 1) for k in range(7)] + [(0, 7, 100), (0, 4, 50), (9, 0, 1)]
    nodes, src = spark.range(10).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0,), (5,)], "source long")
    a, b = (sorted(map(tuple, relax.shortest(_frame(spark, e), nodes, src, m).collect())) for m in ("kernel", "relaxation"))
    assert a == b == sorted([(0, k, k) for k in range(8)] + [(5, k, k - 5) for k in (5, 6, 7)])


def test_cuts_that_hold_all_change_nothing(spark, tiny):
    q = spark.createDataFrame([(0, "a", 0, 3, "N/A"), (1, "b", 1, 3, "N/A"), (2, "c", 3, 2, "N/A")], "query_id long, nome string, source long, target long, fascia string")
    from vialume.plans import comparisons

    own = comparisons.explored(tiny, q)
    cut = comparisons.explored_with_cut(tiny, q, 1e5)
    assert {r["pct_grafo_originale"] for r in cut.collect()} == {100.0}
    rows_ = lambda df: sorted(map(tuple, df.select(own.columns).collect()))
    assert rows_(cut) == rows_(own) and len(rows_(own)) == 3


@pytest.mark.parametrize("shape", ["even", "clustered", "line", "one"])
def test_nearest_anchor_is_brute_force(spark, shape):
    rng = random.Random(shape)
    make = {
        "even": lambda k: (rng.random(), rng.random(), rng.random() < 0.1),
        "clustered": lambda k: (rng.gauss(k % 3 * 10, 0.01), rng.gauss(0, 0.01), rng.random() < 0.2 and k % 3 == 0),
        "line": lambda k: (float(k), 0.0, k % 50 == 0),
        "one": lambda k: (rng.random(), rng.random(), k == 7),
    }[shape]
    rows = [(k, *make(k)) for k in range(400)]
    anchors = [r for r in rows if r[3]]
    got = dict(map(tuple, potentials.nearest_anchor(spark.createDataFrame(rows, "node_id long, y double, x double, anchor boolean")).collect()))
    assert got == {k: min(((y - b) ** 2 + (x - c) ** 2, a) for a, b, c, _ in anchors)[1] for k, y, x, flag in rows if not flag}


def test_models_come_back(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS node_id", "id % 7 AS target_id", "id / 10.0D AS node_lat", "id % 13 / 1.0D AS node_lon", "0.0D AS target_lat", "0.0D AS target_lon", "id * 1.0D AS haversine_dist_m", "id * 2.0D AS tempo_reale_s")
    rounds = []
    train = rows.withColumn("row_id", F.col("node_id"))
    near = train.withColumn("peso", F.lit(1.0))
    both = [learning.train_standard(rows, rounds=2, depth=2)[0], learning.boost(train, near, lambda p, h, t: datasets.mean_loss(p, h, 0.5), learning.inputs(rows), rounds=10, rate=0.5, depth=2, on_round=lambda t, m: rounds.append((t, len(m.trees))))]
    assert rounds == [(t, t + 1) for t in range(10)]
    for k, model in enumerate(both):
        model.save(spark, f"file://{tmp_path}/{k}")
        again = learning.load_model(spark, f"file://{tmp_path}/{k}")
        ask = lambda m: {r["node_id"]: r["prediction"] for r in m.transform(rows).collect()}
        assert ask(model) == ask(again) and again.columns == learning.BASE
    close = both[1].transform(rows).selectExpr("avg(abs(prediction - tempo_reale_s)) AS e").collect()[0]["e"]
    assert close < 40


def test_boosting_adds_one_tree_a_round(spark):
    """Kept estimates equal those of all trees applied anew."""
    rows = spark.range(60).selectExpr("id AS row_id", "id * 1.0D AS x", "pow(id, 2) AS tempo_reale_s")
    near = rows.withColumn("peso", F.lit(5.0))
    seen = []

    def objective(p, h, t):
        seen.append({r["row_id"]: r["p"] for r in p.collect()})
        return datasets.bellman_min_loss(p, h, 0.5)

    model = learning.boost(rows, near, objective, ["x"], rounds=18, rate=0.3, depth=2)
    for t in (0, 7, 8, 9, 17):
        part = learning.Trees(["x"], 0.0, 0.3, model.trees[:t]).transform(rows).collect()
        assert all(abs(r["prediction"] - seen[t][r["row_id"]]) < 1e-6 for r in part)


def test_bellman_losses_agree(spark):
    rows = spark.createDataFrame([(1, 9.0, 1.0), (2, 5.0, 2.0), (3, 1.0, 0.0)], "row_id long, p double, y double")
    near = spark.createDataFrame([(1, 2.0, 3.0), (1, 1.0, 9.0), (2, float("inf"), 0.0)], "row_id long, peso double, h double")
    wide = rows.join(near.groupBy("row_id").agg(F.collect_list("peso").alias("pesi"), F.collect_list("h").alias("stime")), "row_id", "left")
    a, b = (sorted(map(tuple, x.collect())) for x in (datasets.bellman_min_loss(rows, near), datasets.bellman_loss(wide)))
    assert a == b == [(1, 12.0, 2.0), (2, 3.0, 1.0), (3, 1.0, 1.0)]


def test_neighbours_of_the_own_period(spark):
    nodes = spark.createDataFrame([(k, 45.0 + k, 11.0) for k in range(4)], "node_id long, y double, x double")
    graph = lambda w: Graph(nodes, spark.createDataFrame([(0, 1, 0, w), (0, 2, 0, w + 10), (0, 2, 1, 1)], "u long, v long, key int, travel_time_d long"))
    rows = spark.createDataFrame([(5, 0, 3, 0.0), (6, 0, 3, 1.0), (7, 3, 3, 1.0)], "row_id long, node_id long, target_id long, periodo_giorno double")
    got = datasets.neighbours_first_k(rows, {0: graph(20), 1: graph(40)}, k=2).select("row_id", "node_id", "peso", "periodo_giorno").collect()
    assert sorted(map(tuple, got)) == [(5, 1, 2.0, 0.0), (5, 2, 3.0, 0.0), (6, 1, 4.0, 1.0), (6, 2, 5.0, 1.0)]


def test_failed_models_give_rows_and_results_are_kept(spark, tmp_path):
    from vialume.plans import comparisons
    from vialume.plans.store import cached

    g = queries.graph_store(spark, "/root/testdata/sf0.001")
    q = queries._pairs(g, 1)
    keep = f"file://{tmp_path}/kept"
    bad = spark.createDataFrame([(1,)], "wrong long")
    rows = comparisons.models(g, q, {"bad": bad}, keep=keep).collect()
    assert len(rows) == q.count() and all(not r["trovato"] and r["errore"] for r in rows)
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert [cached(spark, keep, {"a": a}, compute).count() for a in (1, 1, 2)] == [3, 3, 3] and len(calls) == 2


def test_shared_folder_is_needed_on_clusters(spark):
    from vialume.plans import store

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        store.shared_dir(Far)
