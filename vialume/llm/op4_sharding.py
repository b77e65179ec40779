"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key's place on the ring is the first four hex digits of the MD5 of its doc_id (65,536 cells); each shard has virtual
nodes at cells found the same way, and owns the cells up to each of them. A shard takes at most its capacity; keys that
overflow it continue clockwise to the next virtual node whose shard has room. Which keys of a cell overflow depends only
on counts, so the ring is solved on the table of cell counts (at most 65,536 rows, whatever the input) and its result,
intervals of ranks within cells, is joined back to the rows. Keys get their rank in a cell from a window; cells are
many and even, so no task holds a hot group.

``rows`` law: capacities are the row count over the shards, rounded so that they sum to it; counts differ by one at most.
Null doc_ids are keys like any other (the empty string); repeated rows are separate rows with their own slots; null text
has size 16 and CRC 0. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:4], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def solve(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first) pieces that place every key of every cell."""
    nodes = ring(shards, vnodes)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(counts):
        at.setdefault(bisect_left(cells, cell) % len(nodes), []).append((cell, 0, counts[cell]))
    out = []
    while at:
        over: dict[int, list[tuple[int, int, int]]] = {}
        for node in sorted(at):
            shard = nodes[node][1]
            for cell, lo, hi in at[node]:
                take = min(hi - lo, room[shard])
                if take:
                    out.append((cell, lo, lo + take, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                if lo + take < hi:
                    over.setdefault(node, []).append((cell, lo + take, hi))
        at = {}
        for node, pieces in over.items():
            step = next(k for k in range(1, len(nodes) + 1) if room[nodes[(node + k) % len(nodes)][1]])
            at.setdefault((node + step) % len(nodes), []).extend(pieces)
    return out


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 128) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cell = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    counts = {r["cell"]: r["count"] for r in docs.select(cell.alias("cell")).groupBy("cell").count().collect()}
    pieces = spark.createDataFrame(solve(counts, shards, vnodes), "in_cell int, lo long, hi long, shard int, first long")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("place"), cell.alias("cell"))
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - F.lit(1).cast("long"))
    fits = (F.col("cell") == F.col("in_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(pieces), fits).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
