"""Shortest distances, potentials that repair negative edges, predecessors and paths.

Two ways give the same rows. ``relaxation`` repeats a join and a minimum on DataFrames until nothing changes, frontier
only, and fits graphs of any size. ``kernel`` deals merged edges of at most ``KERNEL_EDGES`` rows (counted first) to the
tasks of a few blocks of sources, by a shuffle, and relaxes many sources at once with numpy. ``auto`` counts and picks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialume.operators import compact
from vialume.operators.components import MOST_NODES, components, for_each_component
from vialume.operators.dealing import Batches, for_each_block
from vialume.operators.features import parallel_min
from vialume.plans.store import discard, materialize, release

KERNEL_EDGES = 4_000_000
#: Edges times sources that a task relaxes at once.
AT_ONCE = 1 << 23
#: Tables of lowered rows that are kept beside each other.
COMPACT_EVERY = 8


class Arrays:
    """Merged edges as arrays over dense node numbers, sorted by head."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.ids = ids
        u, v = (np.searchsorted(ids, x).astype(np.int32) for x in (u, v))
        order = np.argsort(v, kind="stable")
        self.u, self.w = u[order], w[order]
        self.heads, self.first = np.unique(v[order], return_index=True)

    def relax(self, d: np.ndarray) -> np.ndarray:
        """Smallest distances from the values of ``d`` (rows: problems, columns: nodes; infinity: not reached)."""
        if not len(self.u):
            return d
        for _ in range(len(self.ids) + 1):
            best = np.minimum.reduceat(d[:, self.u] + self.w, self.first, axis=1)
            old = d[:, self.heads]
            if (best >= old).all():
                return d
            d[:, self.heads] = np.minimum(best, old)
        raise ValueError("negative cycle")


def fits(edges: DataFrame, nodes: DataFrame, most: int = KERNEL_EDGES) -> bool:
    """Whether edges and nodes number at most ``most`` each, so that a task can hold them."""
    return edges.count() <= most and nodes.count() <= most


def fits_compact(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether a task holds the graph in the form of ``compact``."""
    return edges.count() <= compact.KERNEL_EDGES and nodes.count() <= compact.KERNEL_NODES


def weight_kind(edges: DataFrame) -> str:
    """The type of distances: long over whole weights, else double."""
    return "long" if isinstance(edges.schema["w"].dataType, T.IntegralType) else "double"


def _distances(exact: type) -> Callable[..., Iterator[pd.DataFrame]]:
    """The distances from each source asked for, over whole tables of edges and nodes."""

    def run(asked: pd.DataFrame, edges: pd.DataFrame, nodes: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g = Arrays(np.unique(np.concatenate([nodes["node_id"], edges["u"], edges["v"]]).astype(np.int64)), edges["u"].to_numpy(), edges["v"].to_numpy(), edges["w"].to_numpy())
        del edges, nodes
        known = asked["source"].to_numpy()
        known, at_once = known[np.isin(known, g.ids)], max(1, min(16, AT_ONCE // max(1, len(g.u))))
        for lo in range(0, len(known), at_once):
            part = known[lo : lo + at_once]
            d = np.full((len(part), len(g.ids)), np.inf)
            d[np.arange(len(part)), np.searchsorted(g.ids, part)] = 0
            g.relax(d)
            s, n = np.nonzero(np.isfinite(d))
            yield pd.DataFrame({"source": part[s], "node_id": g.ids[n], "d": d[s, n].astype(exact)})

    return run


def _by_kernel(edges: DataFrame, nodes: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    tables = {"edges": edges.select("u", "v", F.col("w").cast("double").alias("w")), "nodes": nodes.select("node_id")}
    run = _distances(np.int64 if kind == "long" else np.float64)
    return for_each_block(sources.select("source").distinct(), "source", tables, run, f"source long, node_id long, d {kind}")


def _by_compact(edges: DataFrame, nodes: DataFrame, sources: DataFrame, kind: str, first: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """``first`` (rows of stratum and node_id, a number, a seed): only the nodes that ``per_stratum`` may take of each stratum, one more than the number."""
    exact = np.int64 if kind == "long" else np.float64
    most, seed = first[1:] if first else (0, 0)

    def run(asked: pd.DataFrame, edges: Batches, nodes: pd.DataFrame, strata: Batches | None = None) -> Iterator[pd.DataFrame]:
        g = compact.Compact.of([nodes["node_id"].to_numpy()], edges)
        known, order = asked["source"].to_numpy(), None
        if strata is not None:
            order = compact.Order(g, strata, seed)
        for source in known[g.known(known)].tolist():
            d = g.distances(int(g.number(np.array([source]))[0]))
            at = np.flatnonzero(np.isfinite(d)) if order is None else order.first(np.isfinite(d), most + 1)
            for lo in range(0, len(at), 100_000):
                part = at[lo : lo + 100_000]
                yield pd.DataFrame({"source": source, "node_id": g.ids[part], "d": d[part].astype(exact)})

    tables = {"edges": edges.select("u", "v", "w"), "nodes": nodes.select("node_id")} | ({"strata": first[0].select("stratum", "node_id")} if first else {})
    return for_each_block(sources.select("source").distinct(), "source", tables, run, f"source long, node_id long, d {kind}", packed=("edges", "strata"))


def _by_components(edges: DataFrame, nodes: DataFrame, sources: DataFrame, kind: str) -> DataFrame | None:
    """None if a component is too large."""
    whole = _distances(np.int64 if kind == "long" else np.float64)

    def run(asked: pd.DataFrame, edges: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return whole(asked, edges, asked.rename(columns={"source": "node_id"}))

    asked = sources.select("source").distinct().join(nodes.select(F.col("node_id").alias("source")).distinct(), "source")
    return for_each_component(asked, "source", "source", edges.select("u", "v", F.col("w").cast("double").alias("w")), run, f"source long, node_id long, d {kind}", KERNEL_EDGES)


def _by_relaxation(edges: DataFrame, state: DataFrame, keys: list[str], name: str, rounds: int = 100_000) -> DataFrame:
    """Rows of (keys, node_id, d) lowered along edges (u, v, w [, keys]) until nothing changes.

    A round writes only the rows that it lowers; each ``COMPACT_EVERY`` rounds these are merged into one table of all rows,
    and at the end, when that table alone stays.
    """
    edges = materialize(edges.repartition("u"), f"{name}-edges")
    on_edges, at = [k for k in keys if k in edges.columns], [*keys, "node_id"]
    least = lambda tables: reduce(DataFrame.unionByName, tables).groupBy(*at).agg(F.min("d").alias("d"))
    frontier = materialize(state.select(*at, "d"), f"{name}-0")
    tables = [frontier]
    for r in range(1, rounds + 1):
        step = frontier.withColumnRenamed("node_id", "u").join(edges, ["u", *on_edges]).groupBy(*keys, F.col("v").alias("node_id")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        known = least([t.join(step.select(*at), at, "left_semi") for t in tables])
        moved = step.join(known, at, "left").filter("d IS NULL OR new < d").select(*at, F.col("new").alias("d"))
        frontier = materialize(moved, f"{name}-{r}")
        done = frontier.isEmpty()
        tables.append(frontier)
        if done or len(tables) > COMPACT_EVERY:
            merged = materialize(least(tables), f"{name}-{r}-all")
            if done:
                discard(edges, *tables)
                return merged
            discard(*tables[:-1])
            tables = [merged, frontier]  # the next round reads the frontier
    raise ValueError("negative cycle")


def shortest(edges: DataFrame, nodes: DataFrame, sources: DataFrame, method: str = "auto", first: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """(source, node_id, d) for every node that each of ``sources`` (source) reaches over edges (u, v, w >= 0).

    ``first`` (rows of stratum and node_id, a number, a seed) allows to leave out what ``per_stratum`` with that number, or one
    more, doesn't take of a source's reached nodes in each stratum.
    """
    kind = weight_kind(edges)
    if method != "relaxation" and fits(edges, nodes):
        return _by_kernel(edges, nodes, sources, kind)
    if method != "relaxation":
        edges = materialize(edges, "merged")  # read more than once
        release(edges.sparkSession)
        if fits_compact(edges, nodes):
            return _by_compact(edges, nodes, sources, kind, first)
        found = _by_components(edges, nodes, sources, kind)
        if found is not None:
            return found
    start = sources.select("source").distinct().join(nodes.select(F.col("node_id")), F.col("source") == F.col("node_id")).select("source", "node_id", F.lit(0).cast(kind).alias("d"))
    return _by_relaxation(edges.select("u", "v", F.col("w").cast(kind).alias("w")), start, ["source"], "shortest")


def shortest_to(edges: DataFrame, nodes: DataFrame, targets: DataFrame, method: str = "auto", first: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """(target_id, node_id, d): distances from every node to each of ``targets`` (target_id); ``first`` as in ``shortest``."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    found = shortest(turned, nodes, targets.select(F.col("target_id").alias("source")), method, first)
    return found.select(F.col("source").alias("target_id"), "node_id", "d")


def reachable(edges: DataFrame, nodes: DataFrame, sources: DataFrame, method: str = "auto") -> DataFrame:
    """(source, node_id) for every node that a source reaches."""
    return shortest(edges, nodes, sources, method).select("source", "node_id")


def repair_potentials(reduced: DataFrame, nodes: DataFrame, method: str = "auto") -> DataFrame:
    """(target_id, node_id, phi): shortest distances over reduced edges (target_id, u, v, w_red), every node starting at 0.

    Raises ValueError if reduced weights hold a negative cycle (weights made from one potential can't).
    """
    merged = reduced.groupBy("target_id", "u", "v").agg(F.min("w_red").alias("w"))
    most = 0 if method == "relaxation" else merged.groupBy("target_id").count().agg(F.max("count")).first()[0] or 0
    if method != "relaxation" and most <= KERNEL_EDGES:  # a task holds one target's edges
        return _with_untouched(merged.groupBy("target_id").applyInPandas(_lowered, "target_id long, node_id long, phi long"), nodes)
    if method != "relaxation":
        merged = materialize(merged, "merged")  # read more than once
        found = _repair_by_components(merged)
        if found is not None:
            return _with_untouched(found, nodes)
    start = merged.select("target_id").distinct().join(nodes.select("node_id")).select("target_id", "node_id", F.lit(0).cast("long").alias("d"))
    return _by_relaxation(merged, start, ["target_id"], "phi").withColumnRenamed("d", "phi")


def _lowered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Potentials at the ends of one target's edges."""
    g = Arrays(np.unique(np.concatenate([pdf["u"], pdf["v"]])), pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy().astype(float))
    phi = g.relax(np.zeros((1, len(g.ids))))[0]
    return pd.DataFrame({"target_id": pdf["target_id"].iloc[0], "node_id": g.ids, "phi": phi.astype(np.int64)})


def _with_untouched(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Also 0 for the nodes without edges; ends of edges that aren't among ``nodes`` go."""
    found = materialize(found, "lowered")
    every = nodes.select("node_id").crossJoin(F.broadcast(found.select("target_id").distinct()))
    return every.join(found, ["target_id", "node_id"], "left").select("target_id", "node_id", F.coalesce("phi", F.lit(0)).cast("long").alias("phi"))


def _repair_by_components(merged: DataFrame) -> DataFrame | None:
    """Potentials at the ends of edges, whole components of a target's edges at a time; None if these are too large for a task."""
    of_node = materialize(components(merged), "components")
    if of_node.count() > MOST_NODES:
        return None
    buckets = -(-merged.count() // max(1, KERNEL_EDGES // 8))
    part = F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("part")
    dealt = materialize(merged.join(of_node.withColumnRenamed("node_id", "u"), "u").select("target_id", part, "u", "v", "w"), "component-edges")
    if dealt.groupBy("target_id", "part").count().agg(F.max("count")).first()[0] > KERNEL_EDGES:
        return None
    return dealt.groupBy("target_id", "part").applyInPandas(_lowered, "target_id long, node_id long, phi long")


def hops(edges: DataFrame, dist: DataFrame, source: int) -> DataFrame:
    """(node_id, d, hops): the fewest tight edges from the source to each node of ``dist`` (node_id, d)."""
    at = lambda k, d: dist.select(F.col("node_id").alias(k), F.col("d").alias(d))
    tight = edges.join(at("u", "du"), "u").join(at("v", "dv"), "v").filter("du + w = dv").select("u", "v", F.lit(1).alias("w"))
    counted = shortest(tight, dist.select("node_id"), dist.sparkSession.createDataFrame([(source,)], "source long"))
    return dist.join(counted.select("node_id", F.col("d").alias("hops")), "node_id")


def predecessors(edges: DataFrame, dist: DataFrame, source: int) -> DataFrame:
    """(node_id, d, hops, pred): the smallest node one tight edge and one hop nearer; null at the source."""
    h = hops(edges, dist, source)
    at = lambda k: h.select(F.col("node_id").alias(k), F.col("d").alias(f"d{k}"), F.col("hops").alias(f"h{k}"))
    tight = edges.join(at("u"), "u").join(at("v"), "v").filter("du + w = dv AND hu + 1 = hv")
    pred = tight.groupBy(F.col("v").alias("node_id")).agg(F.min("u").alias("pred"))
    return h.join(pred, "node_id", "left").select("node_id", "d", "hops", "pred")


def path(preds: DataFrame, target: int) -> DataFrame:
    """(step, node_id) from the source to ``target``; no rows if it isn't reached. Ancestors are followed by doubling."""
    own = materialize(preds.select("node_id", "hops", "pred"), "preds")
    end = own.filter(F.col("node_id") == target).select("hops").collect()
    if not end:
        return own.select(F.col("hops").alias("step"), "node_id").limit(0)
    seen = preds.sparkSession.createDataFrame([(target,)], "node_id long")
    up = own.filter("pred IS NOT NULL").select("node_id", F.col("pred").alias("up"))
    for _ in range(int(end[0]["hops"]).bit_length()):
        seen = materialize(seen.union(seen.join(up, "node_id").select("up")), "path")
        twice = up.select(F.col("node_id").alias("via"), F.col("up").alias("beyond"))
        up = materialize(up.join(twice, F.col("up") == F.col("via")).select("node_id", F.col("beyond").alias("up")), "ancestors")
    return own.join(seen, "node_id").select(F.col("hops").alias("step"), "node_id")


def merged_edges(graph, weight: str = "travel_time_d") -> DataFrame:
    """(u, v, w): what shortest paths need of a graph (cheapest parallel edge, no self-loops, missing weights count 1)."""
    return parallel_min(graph.edges, weight, default=1)
