"""Whole connected components of a graph as parts that tasks can hold, for questions that never leave a component.

Neither a way nor a potential that repairs edges crosses from one component to another, so a question needs the edges of the
components of its nodes alone. A graph whose edges no task holds is dealt by components, if each of these fits a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.operators.dealing import for_each_block
from vialume.plans.store import materialize

#: Most nodes whose components are found: one task merges them at last.
MOST_NODES = 8_000_000
#: Rows that a task gathers before it merges them, and edges of a block that are aimed at.
AT_ONCE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and for each the smallest node that it is connected with."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root = up
        open_ = root[a] != root[b]
        a, b = root[a[open_]], root[b[open_]]
    return ids, ids[root]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, waiting, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate([k, *x]) for k, x in zip(known, zip(*waiting, strict=True), strict=True))) if waiting else known

    for batch in batches:
        waiting.append((batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= AT_ONCE + len(known[0]):
            known, waiting, n = merge(), [], 0
    known = merge()
    for lo in range(0, len(known[0]), 100_000):
        yield pa.RecordBatch.from_pydict({"node_id": known[0][lo : lo + 100_000], "component": known[1][lo : lo + 100_000]})


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component) of all nodes with edges (u, v): the smallest node that one is connected with, whatever the directions."""
    rows, schema = edges.select(F.col("u").cast("long"), F.col("v").cast("long")), "node_id long, component long"
    for tasks in (edges.sparkSession.sparkContext.defaultParallelism, 1):
        rows = rows.mapInArrow(_merged, schema).repartition(tasks)
    return rows.mapInArrow(_merged, schema)


def _packed_blocks(items: list[tuple[int, int]], edges_of: dict[int, int], parallel: int) -> tuple[list[int], int]:
    """A block for each of ``items`` (component, question), so that blocks hold about equally many edges; the number of blocks."""
    asked = defaultdict(list)
    for k, (component, _) in enumerate(items):
        asked[component].append(k)
    per = -(-len(items) // (2 * parallel))
    chunks = sorted(((edges_of.get(c, 0), ks[i : i + per]) for c, ks in asked.items() for i in range(0, len(ks), per)), key=lambda x: (-x[0], x[1]))
    blocks = max(1, min(len(chunks), max(parallel, -(-sum(n for n, _ in chunks) // AT_ONCE))))
    load, out = [0] * blocks, [0] * len(items)
    for n, ks in chunks:
        at = min(range(blocks), key=load.__getitem__)
        load[at] += n + 1
        for k in ks:
            out[k] = at
    return out, blocks


def for_each_component(asked: DataFrame, at: str, by: str, edges: DataFrame, run: Callable[..., Iterator[pd.DataFrame]], schema: str, most: int, own: Callable[[DataFrame, DataFrame], dict[str, DataFrame]] = lambda inside, asked: {}) -> DataFrame | None:
    """What ``run`` (component, asked, edges, **own) yields for each component that the nodes ``at`` of ``asked`` are in.

    Rows of ``asked`` with equal ``by`` stay together in a component. A node without edges is a component of its own. ``own``
    makes further tables with a column ``component`` from the nodes of the components (component, node_id) and from ``asked``
    with its component. None if a component has more than ``most`` edges, or nodes are too many.
    """
    spark = asked.sparkSession
    of_node = materialize(components(edges), "components")
    if of_node.count() > MOST_NODES:
        return None
    asked = materialize(asked.join(of_node.withColumnRenamed("node_id", at), at, "left").withColumn("component", F.coalesce("component", F.col(at))), "asked")
    items = sorted((r["component"], r[by]) for r in asked.select("component", by).distinct().collect())  # questions are few
    wanted = spark.createDataFrame([(c,) for c in sorted({c for c, _ in items})], "component long")
    inside = materialize(of_node.join(F.broadcast(wanted), "component").select("component", "node_id"), "inside")
    edges = materialize(edges.join(inside.withColumnRenamed("node_id", "u"), "u").select("component", "u", "v", "w"), "component-edges")
    sizes = {r["component"]: r["count"] for r in edges.groupBy("component").count().collect()}
    if max(sizes.values(), default=0) > most:
        return None
    blocks, n = _packed_blocks(items, sizes, spark.sparkContext.defaultParallelism)
    of = spark.createDataFrame([(c, b, k) for (c, b), k in zip(items, blocks, strict=True)], f"component long, {by} long, block int")
    tables = {"edges": edges, **own(inside, asked)}

    def each(asked: pd.DataFrame, **tables: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cut = {name: dict(iter(rows.groupby("component"))) for name, rows in tables.items()}
        none = {name: rows.iloc[:0] for name, rows in tables.items()}
        tables.clear()
        for component, questions in asked.groupby("component"):
            yield from run(questions, **{name: parts.get(component, none[name]) for name, parts in cut.items()})

    return for_each_block(asked, "component", {}, each, schema, tables, of=(of, ["component", by], n))
