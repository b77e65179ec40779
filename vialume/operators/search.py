"""Best-first searches whose trace matters: explored sets of Dijkstra and A*.

The trace is sequential, so each query runs in one Python call; queries run in parallel. Edges of at most
``KERNEL_EDGES`` rows go to every task. Of larger graphs a task gets whole components that hold its sources, as a search never
leaves them; where a component is larger, cut it first (see cuts) or use the closed forms below, which the exhaustive mode,
whose result doesn't depend on the trace, does by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.operators import compact
from vialume.operators.compact import Compact
from vialume.operators.components import for_each_component
from vialume.operators.dealing import Batches, for_each_block
from vialume.operators.relax import KERNEL_EDGES, Arrays, fits, fits_compact, shortest
from vialume.plans.store import materialize, release

CLOSED, REOPEN, EXHAUSTIVE = "closed", "reopen", "exhaustive"
MODES = (CLOSED, REOPEN, EXHAUSTIVE)
RESULT = "query_id long, source long, target long, dist double, n_explored long, trovato boolean, errore string"


class Adjacency:
    """Edges out of each node, and coordinates."""

    def __init__(self, u, v, w):
        order = np.lexsort((v, u))
        self.v, self.w = v[order], w[order]
        ids, first, n = np.unique(u[order], return_index=True, return_counts=True)
        self.at = {i: (f, f + k) for i, f, k in zip(ids.tolist(), first.tolist(), n.tolist(), strict=True)}

    def out(self, n: int):
        i, j = self.at.get(n, (0, 0))
        return zip(self.v[i:j].tolist(), self.w[i:j].tolist(), strict=True)


def best_first(graph: Adjacency, source: int, target: int, bound=None, mode: str = CLOSED) -> tuple[float, set[int]]:
    """Distance and explored nodes. Ties pop by (estimate, distance, node).

    closed: a node is settled once and the search ends at the target. reopen: a node is explored again when it gets
    nearer, and the search ends beyond the best way to the target. exhaustive: everything is explored.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    h = (lambda n: 0) if bound is None else lambda n: bound.get(n, 0)
    best, explored, limit = {source: 0}, set(), float("inf")
    heap = [(h(source), 0, source)]
    while heap:
        f, g, n = heapq.heappop(heap)
        if f > limit and mode == REOPEN:
            break
        if (n in explored) if mode == CLOSED else g > best[n]:
            continue
        explored.add(n)
        if n == target and mode == CLOSED:
            return g, explored
        if n == target and mode == REOPEN:
            limit = min(limit, g)
            continue
        for v, w in graph.out(n):
            way = g + w
            if way < best.get(v, float("inf")) and not (mode == CLOSED and v in explored):
                best[v] = way
                heapq.heappush(heap, (way + h(v), way, v))
                if v == target:
                    limit = min(limit, way)
    return best.get(target, float("inf")), explored


def _row(query_id, s, t, found=None, error=None) -> dict:
    d, explored = found if found else (np.nan, ())
    return {"query_id": query_id, "source": s, "target": t, "dist": float(d), "n_explored": len(explored) if found else None, "trovato": found is not None, "errore": error}


def _straight(nodes: pd.DataFrame, target: int, v_max_kmh: float) -> np.ndarray:
    """Deciseconds of each node's straight line to the target at top speed."""
    at = nodes[nodes.node_id == target].iloc[0]
    la, lo, ta, to = np.radians(nodes.y), np.radians(nodes.x), np.radians(at.y), np.radians(at.x)
    a = np.sin((ta - la) / 2) ** 2 + np.cos(la) * np.cos(ta) * np.sin((to - lo) / 2) ** 2
    return (2 * 6_371_000.0 * np.arcsin(np.sqrt(a)) / (v_max_kmh / 3.6) * 10).to_numpy()


def _bounds(nodes: pd.DataFrame, target: int, v_max_kmh: float) -> dict[int, float]:
    return dict(zip(nodes.node_id.tolist(), _straight(nodes, target, v_max_kmh).tolist(), strict=True))


def _bound_array(graph: Compact, nodes: pd.DataFrame, target: int, v_max_kmh: float, learned: Batches | None, safety: float) -> np.ndarray:
    """The estimates of ``search`` by node number; 0 for nodes without a place."""
    found = _straight(nodes, target, v_max_kmh)
    known = graph.known(nodes["node_id"].to_numpy())
    bound, placed = np.zeros(len(graph.ids)), graph.number(nodes["node_id"].to_numpy()[known])
    bound[placed] = found[known]
    more = np.zeros(len(graph.ids))
    for b in learned or ():
        ids, of = b["node_id"].to_numpy(), b["target"].to_numpy() == target
        of &= graph.known(ids)
        more[graph.number(ids[of])] = -b["y_hat"].to_numpy()[of]
    bound[placed] = np.maximum(bound[placed], more[placed] / safety)
    return bound


def _search_compact(edges: DataFrame, nodes: DataFrame, queries: DataFrame, mode: str, heuristic: bool, potentials: DataFrame | None, safety: float, v_max_kmh: float) -> DataFrame:
    """The rows of ``search`` on a graph that fits a task in compact form alone."""

    def run(asked: pd.DataFrame, edges: Batches, nodes: pd.DataFrame, potentials: Batches | None = None) -> Iterator[pd.DataFrame]:
        graph = Compact.of([nodes["node_id"].to_numpy(), asked["source"].to_numpy()], edges)
        number = lambda n: int(graph.number(np.array([n]))[0]) if graph.known(np.array([n]))[0] else None
        for target, queries in asked.groupby("target"):
            bound, error, out = None, None, []
            try:
                if heuristic:
                    bound = _bound_array(graph, nodes, target, v_max_kmh, potentials, safety)
            except Exception as e:  # recorded in its rows
                error = repr(e)
            for q in queries.itertuples():
                s, t = number(q.source), number(target)
                if error:
                    out.append(_row(q.query_id, q.source, target, error=error))
                    continue
                if mode == EXHAUSTIVE:
                    d = graph.distances(s)
                    found = float("inf") if t is None else d[t], int(np.isfinite(d).sum())
                elif mode == CLOSED and bound is None:
                    found = graph.settled(s, t)
                else:
                    found = graph.trace(s, t, bound, mode == REOPEN)
                out.append({"query_id": q.query_id, "source": q.source, "target": target, "dist": float(found[0]), "n_explored": found[1], "trovato": True, "errore": None})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"n_explored": "Int64"})

    own = {} if potentials is None or not heuristic else {"potentials": potentials.select(F.col("target_id").alias("target"), "node_id", "y_hat")}
    tables = {"edges": edges.select("u", "v", "w"), "nodes": nodes.select("node_id", "y", "x") if heuristic else nodes.select("node_id")}
    return for_each_block(queries.select("query_id", "source", "target"), "target", tables, run, RESULT, own, packed=("edges", "potentials"))


def search(edges: DataFrame, nodes: DataFrame, queries: DataFrame, mode: str = CLOSED, heuristic: bool = False, potentials: DataFrame | None = None, safety: float = 1.5, v_max_kmh: float = 130.0) -> DataFrame:
    """One row for each of ``queries`` (query_id, source, target) over edges (u, v, w).

    With ``heuristic`` estimates are the larger of the straight line at top speed and, if ``potentials`` (target_id,
    node_id, y_hat) are given, the learned time over ``safety``. An error in a query is recorded in its row.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    whole = fits(edges, nodes)
    if not whole:
        edges = materialize(edges.select("u", "v", "w"), "merged")  # read more than once
        release(edges.sparkSession)
        if fits_compact(edges, nodes):
            return _search_compact(edges, nodes, queries, mode, heuristic, potentials, safety, v_max_kmh)
    if not whole and mode == EXHAUSTIVE:
        return _exhaustive(edges, nodes, queries, heuristic)

    def run(asked: pd.DataFrame, edges: pd.DataFrame, nodes: pd.DataFrame | None = None, potentials: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
        graph = Adjacency(edges["u"].to_numpy(), edges["v"].to_numpy(), edges["w"].to_numpy())
        del edges
        learned = {} if potentials is None else dict(iter(potentials.groupby("target")))
        for target, queries in asked.groupby("target"):
            bound, error, out = None, None, []
            try:
                if nodes is not None:
                    bound = _bounds(nodes, target, v_max_kmh)
                    if target in learned:
                        more = dict(zip(learned[target].node_id.tolist(), (-learned[target].y_hat).tolist(), strict=True))
                        bound = {n: max(b, more.get(n, 0.0) / safety) for n, b in bound.items()}
            except Exception as e:  # recorded in its rows
                error = repr(e)
            for q in queries.itertuples():
                try:
                    out.append(_row(q.query_id, q.source, target, error=error) if error else _row(q.query_id, q.source, target, best_first(graph, q.source, target, bound, mode)))
                except Exception as e:  # recorded in its row
                    out.append(_row(q.query_id, q.source, target, error=repr(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"n_explored": "Int64"})

    if not whole:

        def own(inside: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
            """The places of a component's nodes and of the targets asked for, and their potentials."""
            if not heuristic:
                return {}
            pairs = asked.select("component", "target").distinct()
            near = inside.union(pairs.select("component", "target")).distinct()
            found = {"nodes": nodes.select("node_id", "y", "x").join(near, "node_id")}
            if potentials is not None:
                p = potentials.select(F.col("target_id").alias("target"), "node_id", "y_hat").join(F.broadcast(pairs), "target")
                found["potentials"] = p.join(near, ["component", "node_id"])
            return found

        found = for_each_component(queries.select("query_id", "source", "target"), "source", "target", edges, run, RESULT, KERNEL_EDGES, own)
        if found is None:
            raise ValueError("a component of the graph is too large for a sequential search; cut the graph first")
        return found
    tables = {"edges": edges.select("u", "v", "w")} | ({"nodes": nodes.select("node_id", "y", "x")} if heuristic else {})
    own, least = {}, 1
    if heuristic and potentials is not None:
        own = {"potentials": potentials.select(F.col("target_id").alias("target"), "node_id", "y_hat")}
        least = -(-potentials.count() // KERNEL_EDGES)
    return for_each_block(queries.select("query_id", "source", "target"), "target", tables, run, RESULT, own, least)


def _exhaustive(edges: DataFrame, nodes: DataFrame, queries: DataFrame, heuristic: bool) -> DataFrame:
    """The rows of the exhaustive search on graphs of any size: whatever its estimates, it explores all that the source reaches.

    A source outside ``nodes`` reaches what its edges reach; estimates to a target without a place are an error, as in a trace.
    """
    ends = nodes.select("node_id").union(queries.select("source")).union(edges.select("v")).distinct()
    rows = exhaustive_closed_form(edges, ends, queries.select("query_id", "source", "target"))
    placed = nodes.select(F.col("node_id").alias("target"), F.lit(True).alias("placed")).distinct()
    rows = queries.select("query_id", "source", "target").join(rows, "query_id").join(placed, "target", "left")
    found = F.lit(True) if not heuristic else F.col("placed").isNotNull()
    dist = F.when(found, F.coalesce(F.col("dist").cast("double"), F.lit(float("inf"))))
    error = F.when(~found, "IndexError('single positional indexer is out-of-bounds')")
    return rows.select("query_id", "source", "target", dist.alias("dist"), F.when(found, F.col("n_explored")).alias("n_explored"), found.alias("trovato"), error.alias("errore"))


def search_repaired(repaired: DataFrame, queries: DataFrame, by: str = "target") -> DataFrame:
    """Dijkstra on each query's own repaired edges (target_id, u, v, w_san); ``by`` is what of a query ``target_id`` names."""
    merged = repaired.groupBy("target_id", "u", "v").agg(F.min("w_san").alias("w"))

    def run(key, qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        graph = Adjacency(es["u"].to_numpy(), es["v"].to_numpy(), es["w"].to_numpy())
        out = []
        for q in qs.itertuples():
            try:
                out.append(_row(q.query_id, q.source, q.target, best_first(graph, q.source, q.target)))
            except Exception as e:  # recorded in its row
                out.append(_row(q.query_id, q.source, q.target, error=repr(e)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    qs = queries.select("query_id", "source", "target", F.col(by).alias("target_id"))
    return qs.groupBy("target_id").cogroup(merged.groupBy("target_id")).applyInPandas(run, RESULT)


REPAIRED = f"{RESULT}, raw_dist double"


def repaired_search(edges: DataFrame, queries: DataFrame, potentials: DataFrame, by: str = "target") -> DataFrame | None:
    """The rows of ``search_repaired`` with the distances on the raw edges (u, v, w; missing weights 0) beside them, each query on its
    source's component alone.

    Potentials (target_id, node_id, y_hat_int) are repaired where they are used, so that edges are dealt once instead of once for
    each target. None if a component is too large for a task. ``by``: with ``query_id``, potentials are (query_id, node_id,
    y_hat_int, region), and a query's edges are those of its own cut (``regions``).
    """
    extra = ["region"] if by == "query_id" else []

    def run(asked: pd.DataFrame, edges: pd.DataFrame, potentials: pd.DataFrame) -> Iterator[pd.DataFrame]:
        of_key = {k: p.sort_values("node_id") for k, p in potentials.groupby(by)}
        for key, qs in asked.groupby(by):
            p, target = of_key.get(key, potentials.iloc[:0]), qs["target"].iloc[0]
            ids, y = p["node_id"].to_numpy(), p["y_hat_int"].to_numpy()
            es = edges[edges["u"].isin(ids) & edges["v"].isin(ids)]
            u, v = es["u"].to_numpy(), es["v"].to_numpy()
            at = lambda of, n: of[np.searchsorted(ids, n)]  # noqa: B023, E731
            if extra:
                region = p["region"].to_numpy()
                together = (at(region, u) & at(region, v)) > 0
                es, u, v = es[together], u[together], v[together]
            w = es["w"].to_numpy() + at(y, u) - at(y, v)
            phi = Arrays(ids, u, v, w.astype(float)).relax(np.zeros((1, len(ids))))[0].astype(np.int64)
            graph = Adjacency(u, v, np.maximum(0, w + at(phi, u) - at(phi, v)))
            out = []
            for q in qs.itertuples():
                try:
                    row, raw = _row(q.query_id, q.source, target, best_first(graph, q.source, target)), np.inf
                    if np.isfinite(row["dist"]) and np.isin([q.source, target], ids).all():
                        raw = row["dist"] - at(y + phi, q.source) + at(y + phi, target)
                except Exception as e:  # recorded in its row
                    row, raw = _row(q.query_id, q.source, target, error=repr(e)), np.nan
                out.append(row | {"raw_dist": float(raw)})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")]).astype({"n_explored": "Int64"})

    def own(inside: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
        p = potentials.select(F.col("target_id").alias("target"), "node_id", "y_hat_int") if by == "target" else potentials.select(by, "node_id", "y_hat_int", *extra)
        if inside is None:
            return {"potentials": p}
        return {"potentials": p.join(F.broadcast(asked.select("component", by).distinct()), by).join(inside, ["component", "node_id"])}

    if KERNEL_EDGES < edges.count() <= compact.KERNEL_EDGES:
        return _repaired_compact(edges, queries, own(None, queries)["potentials"], by)
    return for_each_component(queries.select("query_id", "source", "target"), "source", "target", edges, run, REPAIRED, KERNEL_EDGES, own)


def _repaired_compact(edges: DataFrame, queries: DataFrame, potentials: DataFrame, by: str) -> DataFrame:
    """The rows of ``repaired_search`` on a graph that fits a task in compact form alone."""

    def run(asked: pd.DataFrame, edges: Batches, potentials: Batches) -> Iterator[pd.DataFrame]:
        graph = Compact.of([asked["source"].to_numpy(), asked["target"].to_numpy()], edges)
        number = lambda n: int(graph.number(np.array([n]))[0])
        for key, qs in asked.groupby(by):
            y, region, target = np.zeros(len(graph.ids), np.int64), np.zeros(len(graph.ids), np.int8), qs["target"].iloc[0]
            for b in potentials:
                ids, of = b["node_id"].to_numpy(), b[by].to_numpy() == key
                of &= graph.known(ids)
                at = graph.number(ids[of])
                y[at], region[at] = b["y_hat_int"].to_numpy()[of], b["region"].to_numpy()[of] if by == "query_id" else 1
            cut, out = graph.reduced(y, region), []
            phi = cut.repair()
            for q in qs.itertuples():
                s, t = number(q.source), number(target)
                d, n = cut.settled(s, t)
                raw = d - (y[s] + phi[s]) + y[t] + phi[t] if np.isfinite(d) and region[s] and region[t] else np.inf
                out.append({"query_id": q.query_id, "source": q.source, "target": target, "dist": d, "n_explored": n, "trovato": True, "errore": None, "raw_dist": float(raw)})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")]).astype({"n_explored": "Int64"})

    return for_each_block(queries.select("query_id", "source", "target"), by, {"edges": edges.select("u", "v", "w")}, run, REPAIRED, {"potentials": potentials}, packed=("edges", "potentials"))


def explored_closed_form(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dist, n_explored) of Dijkstra over positive weights: nodes nearer than the target, and equals up to its id."""
    d = shortest(edges, nodes, queries.select("source"))
    goal = queries.join(d.withColumnRenamed("node_id", "target"), ["source", "target"], "left").select("query_id", "source", "target", F.col("d").alias("dist"))
    rows = goal.join(d, "source").filter("dist IS NULL OR d < dist OR (d = dist AND node_id <= target)")
    return rows.groupBy("query_id", "dist").agg(F.count(F.lit(1)).alias("n_explored"))


def exhaustive_closed_form(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dist, n_explored) of the exhaustive A*: the true distance and all reachable nodes."""
    d = shortest(edges, nodes, queries.select("source"))
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_explored"))
    goal = d.select("source", F.col("node_id").alias("target"), F.col("d").alias("dist"))
    return queries.join(n, "source").join(goal, ["source", "target"], "left").select("query_id", "dist", "n_explored")
