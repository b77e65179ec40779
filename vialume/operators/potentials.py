"""Potentials, reduced edges, repair, anchors and interpolation.

The sign convention: a potential is minus the estimated time to the target, in weight units, and 0 at the target; the
reduced weight of an edge is ``w + y[u] - y[v]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialume.functions.geo import half_even, travel_bound
from vialume.operators.features import advanced_features, base_features, needs_advanced
from vialume.plans.store import materialize
from vialume.sources.graphs import Graph

M31 = 2147483647
MOST_ANCHORS = 500_000
#: Points from which on each is looked for from its neighbour instead of among all triangles.
WALKED = 20_000


def mod_rank(id_: Column, seed: int = 42) -> Column:
    """A shuffled order of ids that any SQL engine can repeat; ties go by id."""
    return (id_ * 48271 + seed * 16807) % M31


def potential(node: str, target: str, estimate: Column, scale: float = 10.0) -> Column:
    """Minus the estimate in seconds, 0 at the target."""
    return F.when(F.col(node) == F.col(target), F.lit(0.0)).otherwise(-estimate * scale)


def as_potential(rows: DataFrame, estimate: Column, scale: float = 10.0) -> DataFrame:
    """(target_id, node_id, y_hat, y_hat_int) from an estimate in seconds."""
    return rows.select("target_id", "node_id", potential("node_id", "target_id", estimate, scale).alias("y_hat")).withColumn("y_hat_int", half_even(F.col("y_hat")))


def analytic(nodes: DataFrame, targets: DataFrame, v_max_kmh: float = 130.0) -> DataFrame:
    """Potentials from straight lines at top speed, for each of ``targets`` (target_id)."""
    goal = nodes.join(targets, F.col("node_id") == F.col("target_id"), "left_semi").select(F.col("node_id").alias("target_id"), F.col("y").alias("ty"), F.col("x").alias("tx"))
    rows = nodes.crossJoin(goal)  # each target is a problem of its own: all nodes times all targets is the result
    return as_potential(rows, travel_bound("y", "x", "ty", "tx", v_max_kmh) / 10.0)


def predicted(graph: Graph, targets: DataFrame, model, scale: float = 10.0) -> DataFrame:
    """Potentials from a fitted model; it gets the advanced features if its columns want them."""
    pairs = graph.nodes.select("node_id").crossJoin(targets.select("target_id").distinct())  # all nodes times all targets is the result
    return as_potential(_estimated(pairs, graph, model), F.col("prediction"), scale)


def _estimated(pairs: DataFrame, graph: Graph, model) -> DataFrame:
    wants = needs_advanced(getattr(model, "columns", []))
    return model.transform(advanced_features(pairs, graph) if wants else base_features(pairs, graph.nodes))


def anchored(graph: Graph, target: int, model, ratio: float = 0.1, least: int = 100, scale: float = 10.0, seed: int = 42) -> DataFrame:
    """Potentials of one target with the model asked at anchors only; the other nodes interpolate between them."""
    flagged = anchors(graph.nodes, target, ratio, least, seed)
    pairs = flagged.filter("anchor").select("node_id", F.lit(target).cast("long").alias("target_id"))
    values = _estimated(pairs, graph, model).select("node_id", F.col("prediction").alias("value"))
    rows = interpolate(flagged, values).withColumn("target_id", F.lit(target).cast("long"))
    return as_potential(rows, F.col("value"), scale)


def reduced_edges(edges: DataFrame, potentials: DataFrame, weight: str = "travel_time_d") -> DataFrame:
    """(target_id, u, v, key, w_red); self-loops go, missing weights count 0."""
    at = lambda k, y: potentials.select("target_id", F.col("node_id").alias(k), F.col("y_hat_int").alias(y))
    rows = edges.filter("u <> v").select("u", "v", "key", F.coalesce(weight, F.lit(0)).alias("w"))
    return rows.join(at("u", "yu"), "u").join(at("v", "yv"), ["target_id", "v"]).select("target_id", "u", "v", "key", (F.col("w") + F.col("yu") - F.col("yv")).alias("w_red"))


def reduced_summary(reduced: DataFrame) -> DataFrame:
    """Per target: edges, negative edges and the largest violation (0 without any)."""
    return reduced.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("w_red") < 0).alias("n_negative"), F.coalesce(F.max(F.when(F.col("w_red") < 0, -F.col("w_red"))), F.lit(0)).alias("max_violation"))


def repaired_edges(edges: DataFrame, potentials: DataFrame, phi: DataFrame, weight: str = "travel_time_d") -> DataFrame:
    """(target_id, u, v, key, w_san): reduced weights corrected by phi (0 where missing), not below 0."""
    at = lambda k, p: phi.select("target_id", F.col("node_id").alias(k), F.col("phi").alias(p))
    rows = reduced_edges(edges, potentials, weight).join(at("u", "pu"), ["target_id", "u"], "left").join(at("v", "pv"), ["target_id", "v"], "left")
    w = F.greatest(F.lit(0), F.col("w_red") + F.coalesce("pu", F.lit(0)) - F.coalesce("pv", F.lit(0)))
    return rows.select("target_id", "u", "v", "key", w.cast("long").alias("w_san"))


def anchors(nodes: DataFrame, target: int, ratio: float = 0.1, least: int = 100, seed: int = 42) -> DataFrame:
    """Nodes with a flag ``anchor``: a sample of max(least, ratio n) nodes, and the target."""
    total = nodes.count()
    n = min(max(least, int(total * ratio)), total)
    top = nodes.select("node_id", mod_rank(F.col("node_id"), seed).alias("r")).orderBy("r", "node_id").limit(n).select(F.col("node_id").alias("chosen"))
    return nodes.join(top, F.col("node_id") == F.col("chosen"), "left").withColumn("anchor", F.col("chosen").isNotNull() | (F.col("node_id") == target)).drop("chosen")


def nearest_anchor(flagged: DataFrame) -> DataFrame:
    """(node_id, anchor_id) of the nearest anchor, in raw degrees, of each node that isn't one.

    Anchors meet nodes in a grid with about two anchors a cell, and a node's nearest among the nine cells around it is
    final if it is nearer than their border. The rest goes on with cells twice as wide, until none is left.
    """
    a = flagged.filter("anchor").select(F.col("node_id").alias("anchor_id"), F.col("y").alias("ay"), F.col("x").alias("ax"))
    box = flagged.agg(F.count_if("anchor").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("y", "x")]).collect()[0]
    if not box["n"]:
        return flagged.select("node_id", F.col("node_id").alias("anchor_id")).limit(0)
    span = max(box["max_y"] - box["min_y"], box["max_x"] - box["min_x"], 1e-9)
    cell, rest, parts = span / max(1, int((box["n"] / 2) ** 0.5)), flagged.filter("NOT anchor").select("node_id", "y", "x"), []
    while True:
        at = lambda c: F.floor((F.col(c) - F.lit(box[f"min_{c[-1]}"])) / F.lit(cell))  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct((at("ay") + i).alias("i"), (at("ax") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        near = a.withColumn("c", around).select("anchor_id", "ay", "ax", "c.i", "c.j")
        rows = rest.withColumn("i", at("y")).withColumn("j", at("x")).join(near, ["i", "j"], "left")
        d2 = (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")) + (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax"))
        best = rows.groupBy("node_id", "y", "x", "i", "j").agg(F.min(F.when(F.col("anchor_id").isNotNull(), F.struct(d2.alias("d2"), "anchor_id"))).alias("best"))
        side = lambda c, k: F.least(F.col(c) - (F.lit(box[f"min_{c}"]) + (F.col(k) - 1) * cell), F.lit(box[f"min_{c}"]) + (F.col(k) + 2) * cell - F.col(c))  # noqa: B023, E731
        border = F.least(side("y", "i"), side("x", "j"))
        whole = cell >= span
        best = materialize(best.withColumn("final", F.lit(whole) | F.coalesce(F.col("best.d2") < border * border, F.lit(False))), "nearest-anchor")
        parts.append(best.filter("final").select("node_id", F.col("best.anchor_id").alias("anchor_id")))
        rest, cell = best.filter("NOT final").select("node_id", "y", "x"), cell * 2
        if whole or rest.isEmpty():
            return reduce(DataFrame.union, parts)


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three point numbers), one point inserted at a time."""
    if len(points) > WALKED:
        return _triangulate_walking(points)
    mid, span = points.mean(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    p = np.vstack([points, mid + span * np.array([[-30.0, -20.0], [0.0, 40.0], [30.0, -20.0]])])
    n = len(points)
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t):
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(d == 0, 1e-30, d)
        bb, cc = (b * b).sum(1), (c * c).sum(1)
        o = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
        return o + a, (o * o).sum(1)

    centre, r2 = circles(tri)
    for k in range(n):
        bad = ((p[k] - centre) ** 2).sum(1) < r2
        if not bad.any():
            continue
        sides = np.sort(tri[bad][:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), axis=1)
        sides, times = np.unique(sides, axis=0, return_counts=True)
        rim = sides[times == 1]
        new = np.column_stack([rim, np.full(len(rim), k)])
        c, r = circles(new)
        tri, centre, r2 = np.vstack([tri[~bad], new]), np.vstack([centre[~bad], c]), np.concatenate([r2[~bad], r])
    return tri[(tri < n).all(1)]


def _triangulate_walking(points: np.ndarray) -> np.ndarray:
    """The same for many points: inserted by cells of a grid row after row, so that the next is near, over exact whole numbers."""
    low, span = points.min(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    unit, n = 1 << 40, len(points)
    cells = np.floor((points - low) / span * max(1, int((n / 2) ** 0.5))).astype(np.int64)
    along = np.where(cells[:, 1] % 2 == 0, cells[:, 0], -cells[:, 0])
    half = (np.ptp(points, axis=0) / span * unit / 2).astype(np.int64)
    p = list(map(tuple, np.rint((points - low) / span * unit).astype(np.int64).tolist()))
    p += [(int(half[0]) + x * unit, int(half[1]) + y * unit) for x, y in ((-30, -20), (30, -20), (0, 40))]
    corners, beside, last = [(n, n + 1, n + 2)], [[-1, -1, -1]], 0  # beside: over the side after each corner

    def left(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def around(t, q):
        (ax, ay), (bx, by), (cx, cy) = (p[k] for k in corners[t])
        ax, ay, bx, by, cx, cy = ax - q[0], ay - q[1], bx - q[0], by - q[1], cx - q[0], cy - q[1]
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    for k in np.lexsort((along, cells[:, 1])).tolist():
        q, t, moved = p[k], last, True
        while moved:
            moved = False
            for i in range(3):
                if left(p[corners[t][i]], p[corners[t][(i + 1) % 3]], q) < 0:
                    t, moved = beside[t][i], True
                    break
        if q in (p[c] for c in corners[t]):
            continue  # a point twice
        bad, rim = [t], []
        inside = {t}
        for b in bad:
            for i in range(3):
                o = beside[b][i]
                if o in inside:
                    continue
                if o >= 0 and around(o, q):
                    inside.add(o)
                    bad.append(o)
                else:
                    rim.append((corners[b][i], corners[b][(i + 1) % 3], o))
        first: dict[int, int] = {}
        new = []
        for a, b, o in rim:
            at = len(corners)
            corners.append((a, b, k))
            beside.append([o, -1, -1])
            first[a] = at
            new.append(at)
            if o >= 0:
                side = next(j for j in range(3) if corners[o][j] == b and corners[o][(j + 1) % 3] == a)
                beside[o][side] = at
        for at in new:
            other = first[corners[at][1]]
            beside[at][1], beside[other][2] = other, at
        for b in bad:
            corners[b], beside[b] = None, None
        last = new[0]
    tri = np.array([c for c in corners if c is not None])
    return tri[(tri < n).all(1)]


def interpolate(flagged: DataFrame, values: DataFrame) -> DataFrame:
    """(node_id, value) of all nodes: anchors keep their value, others get a linear one in their Delaunay triangle, else the nearest anchor's.

    Anchors go to every task with their triangles, found by grid cell; more than ``MOST_ANCHORS`` are refused.
    """
    if flagged.filter("anchor").count() > MOST_ANCHORS:
        raise ValueError("too many anchors to triangulate at once; lower the ratio or cut the graph")
    known = flagged.filter("anchor").join(values, "node_id").select("node_id", "y", "x", "value").orderBy("node_id").toPandas()
    spark = flagged.sparkSession
    points = known[["x", "y"]].to_numpy()
    shared = spark.sparkContext.broadcast((points, known["value"].to_numpy(), triangulate(points) if len(points) > 2 else np.zeros((0, 3), int)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pts, val, tri = shared.value
        a, b, c = (pts[tri[:, k]] for k in range(3))
        det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
        low, wide = pts.min(0), np.maximum(np.ptp(pts, axis=0), 1e-9) / max(1, int(len(pts) ** 0.5))
        cell = lambda p: np.floor((p - low) / wide).astype(np.int64)
        inside_of: dict[tuple[int, int], list[int]] = {}
        if len(tri):
            corners = np.stack([a, b, c])
            for k, (lo, hi) in enumerate(zip(cell(corners.min(0) - 1e-9).tolist(), cell(corners.max(0) + 1e-9).tolist(), strict=True)):
                for i in range(lo[0], hi[0] + 1):
                    for j in range(lo[1], hi[1] + 1):
                        inside_of.setdefault((i, j), []).append(k)
        for batch in batches:
            out = np.empty(len(batch))
            xy = batch[["x", "y"]].to_numpy()
            for k, ((x, y), at) in enumerate(zip(xy.tolist(), map(tuple, cell(xy).tolist()), strict=True)):
                m = np.array(inside_of.get(at, ()), dtype=np.int64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = ((b[m, 1] - c[m, 1]) * (x - c[m, 0]) + (c[m, 0] - b[m, 0]) * (y - c[m, 1])) / det[m]
                    t = ((c[m, 1] - a[m, 1]) * (x - c[m, 0]) + (a[m, 0] - c[m, 0]) * (y - c[m, 1])) / det[m]
                inside = np.flatnonzero((s >= -1e-12) & (t >= -1e-12) & (s + t <= 1 + 1e-12))
                if len(inside):
                    i = inside[0]
                    out[k] = s[i] * val[tri[m[i], 0]] + t[i] * val[tri[m[i], 1]] + (1 - s[i] - t[i]) * val[tri[m[i], 2]]
                else:
                    out[k] = val[((pts - [x, y]) ** 2).sum(1).argmin()]
            yield pd.DataFrame({"node_id": batch["node_id"], "value": out})

    rest = flagged.filter("NOT anchor").select("node_id", "y", "x").mapInPandas(run, "node_id long, value double")
    return spark.createDataFrame(known[["node_id", "value"]], "node_id long, value double").unionByName(rest)


def original_and_reduced(repaired_distances: DataFrame, potentials: DataFrame, phi: DataFrame) -> DataFrame:
    """(target_id, source, node_id, d_reduced, d_original) from distances over repaired edges (target_id, source, node_id, d).

    Repaired distances are reduced ones moved by phi, and those are original ones moved by the potentials.
    """
    at = lambda k, tag: potentials.join(phi, ["target_id", "node_id"]).select("target_id", F.col("node_id").alias(k), F.col("y_hat_int").alias(f"y_{tag}"), F.col("phi").alias(f"p_{tag}"))
    rows = repaired_distances.join(at("source", "s"), ["target_id", "source"]).join(at("node_id", "n"), ["target_id", "node_id"])
    rows = rows.withColumn("d_reduced", F.col("d") - F.col("p_s") + F.col("p_n"))
    return rows.select("target_id", "source", "node_id", "d_reduced", (F.col("d_reduced") - F.col("y_s") + F.col("y_n")).alias("d_original"))
