"""Deterministic samples and query pairs.

Samples take the first rows of each stratum in a shuffled order of ids; picks with replacement walk a stratum by a
linear congruence. Both can be repeated by any SQL engine and don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialume.operators.potentials import mod_rank


#: Ids that one task numbers at most.
NUMBERED_AT_ONCE = 1 << 18


def per_stratum(rows: DataFrame, strata: list[str], n: int, id_: str = "node_id", seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each stratum, or of all rows without strata, without replacement."""
    if not strata:
        return rows.orderBy(mod_rank(F.col(id_), seed), id_).limit(n)
    w = Window.partitionBy(*strata).orderBy(mod_rank(F.col(id_), seed), id_)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def _numbered(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Rows numbered by node_id in each stratum: by ranges of ids, whose offsets are summed first, so no task holds a stratum."""
    rows = rows.select(*strata, "node_id").withColumn("part", F.floor(F.col("node_id") / NUMBERED_AT_ONCE))
    counts = rows.groupBy(*strata, "part").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(*strata)
    before = all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*strata, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(all_).alias("size"))
    within = F.row_number().over(Window.partitionBy(*strata, "part").orderBy("node_id")) - 1
    return rows.withColumn("within", within).join(counts, [*strata, "part"]).select(*strata, "node_id", (F.col("before") + F.col("within")).cast("long").alias("k"), "size")


def _pick(i, size, seed: int):
    return (i * 7919 + seed * 104729) % size


def pairs_by_band(banded: DataFrame, nodes: DataFrame, n: int = 100, seed: int = 123) -> DataFrame:
    """(nome, source, target, fascia): ``n`` pairs a band, target in the band, source anywhere else; none in one-node graphs."""
    goal = _numbered(banded.withColumnRenamed("name", "fascia"), ["fascia"])
    start = _numbered(nodes.withColumn("all", F.lit(1)), ["all"])
    ids = nodes.sparkSession.range(1, n + 1).withColumnRenamed("id", "i")
    sizes = goal.select("fascia", "size").distinct()
    total = start.select(F.col("size").alias("total")).distinct()
    want = sizes.crossJoin(ids).crossJoin(total).select("fascia", "i", _pick(F.col("i"), F.col("size"), seed).alias("kt"), _pick(F.col("i"), F.col("total"), seed + 1).alias("ks"), "total")
    rows = want.join(goal.select("fascia", F.col("k").alias("kt"), F.col("node_id").alias("target")), ["fascia", "kt"])
    rows = rows.join(start.select(F.col("k").alias("ks"), F.col("node_id").alias("s1")), "ks").withColumn("ks2", (F.col("ks") + 1) % F.col("total"))
    rows = rows.join(start.select(F.col("k").alias("ks2"), F.col("node_id").alias("s2")), "ks2")
    source = F.when(F.col("s1") != F.col("target"), F.col("s1")).otherwise(F.col("s2"))
    return rows.select(F.concat("fascia", F.lit(" #"), F.col("i").cast("string")).alias("nome"), source.alias("source"), "target", "fascia").filter("source <> target")


def pairs_by_trip(banded: DataFrame, nodes: DataFrame, n: int = 100, seed: int = 123) -> DataFrame:
    """(nome, source, target, fascia) of urban, mixed and long trips over bands 0, 1, 2.

    Urban: both in band 0. Mixed: one in band 1, the other in band 0 or 1. Long: one in band 2, the other anywhere. Odd
    numbers of mixed and long trips start in the outer band, even ones end there. No rows if band 0 is empty.
    """
    pool = lambda name, rows: rows.select(F.lit(name).alias("pool"), "node_id")
    b = lambda *k: banded.filter(F.col("band").isin(*k))
    pools = _numbered(pool("c", b(0)).union(pool("p", b(1))).union(pool("m", b(0, 1).select("node_id").distinct())).union(pool("l", b(2))).union(pool("t", nodes)), ["pool"])
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([("Urbana", "Tratte Urbane", "c", "c", "c", "c", "c"), ("Mista", "Tratte Miste", "p", "m", "m", "p", "m"), ("Lunga", "Tratte Lunghe", "l", "t", "t", "l", "t")], "kind string, fascia string, s1 string, t1 string, s0 string, t0 string, again string")
    rows = kinds.crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "i"))
    odd = F.col("i") % 2 == 1
    rows = rows.select("kind", "fascia", "i", "again", F.when(odd, F.col("s1")).otherwise(F.col("s0")).alias("sp"), F.when(odd, F.col("t1")).otherwise(F.col("t0")).alias("tp"))
    sizes = pools.select(F.col("pool"), "size").distinct()
    size = lambda c: sizes.select(F.col("pool").alias(c), F.col("size").alias(f"n_{c}"))
    rows = rows.join(size("sp"), "sp").join(size("tp"), "tp").join(size("again"), "again")
    rows = rows.withColumns({"ks": _pick(F.col("i"), F.col("n_sp"), seed), "kt": _pick(F.col("i"), F.col("n_tp"), seed + 1), "ka": _pick(F.col("i"), F.col("n_again"), seed + 2)})
    rows = rows.withColumn("kb", (F.col("ka") + 1) % F.col("n_again"))
    at = lambda p, k, name: pools.select(F.col("pool").alias(p), F.col("k").alias(k), F.col("node_id").alias(name))
    rows = rows.join(at("sp", "ks", "source"), ["sp", "ks"]).join(at("tp", "kt", "a"), ["tp", "kt"]).join(at("again", "ka", "b"), ["again", "ka"]).join(at("again", "kb", "c"), ["again", "kb"])
    target = F.when(F.col("a") != F.col("source"), F.col("a")).when(F.col("b") != F.col("source"), F.col("b")).otherwise(F.col("c"))
    some = pools.filter("pool = 'c'").limit(1).select(F.lit(1).alias("some"))
    return rows.crossJoin(some).select(F.concat("kind", F.lit(" #"), F.col("i").cast("string")).alias("nome"), "source", target.alias("target"), "fascia").filter("source <> target")
