"""Consistency checks, result aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialume.operators.potentials import mod_rank, reduced_edges

AS_REFERENCE, DOCUMENTED = "as_reference", "documented"


def _violation(sign: str) -> Column:
    """How far an edge breaks consistency. The default tests y[u] > w + y[v] on negated potentials as they are."""
    if sign not in (AS_REFERENCE, DOCUMENTED):
        raise ValueError(f"unknown sign {sign!r}")
    y = F.col("yu") - F.col("yv")
    return (y if sign == AS_REFERENCE else -y) - F.col("w")


def with_potentials(edges: DataFrame, potentials: DataFrame, weight: str = "travel_time_d") -> DataFrame:
    """(target_id, u, v, key, w, yu, yv)."""
    at = lambda k, y: potentials.select("target_id", F.col("node_id").alias(k), F.col("y_hat_int").alias(y))
    rows = edges.select("u", "v", "key", F.coalesce(weight, F.lit(0)).alias("w"))
    return rows.join(at("u", "yu"), "u").join(at("v", "yv"), ["target_id", "v"])


def summary(rows: DataFrame, by: list[str], sign: str, scale: float = 10.0) -> DataFrame:
    """Count, share, and mean, largest and median violation in seconds (null without any)."""
    v = _violation(sign)
    bad = F.when(v > 0, v / scale)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_totale"), F.count_if(v > 0).alias("n_violazioni"), (F.count_if(v > 0) * 100.0 / F.count(F.lit(1))).alias("pct_violazioni"),
        F.avg(bad).alias("violazione_media_s"), F.max(bad).alias("violazione_massima_s"), F.median(bad).alias("violazione_mediana_s"),
    )


def sample_check(edges: DataFrame, potentials: DataFrame, n: int = 5000, sign: str = AS_REFERENCE, seed: int = 42) -> DataFrame:
    """Summary over a sample of edges, self-loops included."""
    order = mod_rank(F.col("u") * 31 + F.col("v") * 17 + F.col("key"), seed)
    sample = edges.withColumn("r", order).orderBy("r", "u", "v", "key").limit(n).drop("r")
    return summary(with_potentials(sample, potentials), ["target_id"], sign)


def path_check(first: DataFrame, path: DataFrame, potentials: DataFrame, sign: str = AS_REFERENCE) -> DataFrame:
    """Summary over the steps of a path (step, node_id), with weights (u, v, w) of first keys."""
    after = path.select((F.col("step") - 1).alias("step"), F.col("node_id").alias("v"))
    steps = path.select("step", F.col("node_id").alias("u")).join(after, "step")
    rows = steps.join(first, ["u", "v"]).select("u", "v", F.lit(0).alias("key"), "w")
    return summary(with_potentials(rows, potentials, "w"), ["target_id"], sign)


def visited_check(edges: DataFrame, visited: DataFrame, potentials: DataFrame, sign: str = AS_REFERENCE) -> DataFrame:
    """Summary over the edges out of visited nodes, self-loops excluded, with the number of visited nodes."""
    rows = edges.filter("u <> v").join(visited.select(F.col("node_id").alias("u")), "u", "left_semi")
    n = visited.agg(F.countDistinct("node_id").alias("n_nodi_visitati"))
    return summary(with_potentials(rows, potentials), ["target_id"], sign).crossJoin(n)


def sign_sanity(edges: DataFrame, potentials: DataFrame, weight: str = "travel_time_d") -> DataFrame:
    """Negative reduced edges with the potentials negated (as used) and as predicted."""
    turned = potentials.withColumn("y_hat_int", -F.col("y_hat_int"))
    count = lambda p, name: reduced_edges(edges, p, weight).groupBy("target_id").agg(F.count_if(F.col("w_red") < 0).alias(name))
    return count(potentials, "n_invertito").join(count(turned, "n_diretto"), "target_id")


def by_band(rows: DataFrame, value: str = "riduzione_pct", by: str = "fascia") -> DataFrame:
    """Mean, median, sample deviation, percentage of positives and count of found rows for each band."""
    x = F.col(value)
    return rows.filter("trovato").groupBy(by).agg(F.avg(x).alias("media"), F.median(x).alias("mediana"), F.stddev_samp(x).alias("std"), (F.avg((x > 0).cast("double")) * 100).alias("pct_positive"), F.count(x).alias("n"))


def overall(rows: DataFrame, value: str = "riduzione_pct") -> DataFrame:
    """Mean and percentage of positives over all found rows."""
    x = F.col(value)
    return rows.filter("trovato").agg(F.avg(x).alias("media"), (F.avg((x > 0).cast("double")) * 100).alias("pct_positive"))


def by_model(rows: DataFrame, value: str = "riduzione_pct") -> DataFrame:
    """Mean, sample deviation and count for each band and model."""
    return rows.filter("trovato").groupBy("fascia", "modello").agg(F.avg(value).alias("media"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n_coppie"))


def summary_by(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """Mean, median and sample deviation of each of ``values`` over found rows, for each value of ``by``."""
    return rows.filter("trovato").groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in values for n, f in (("media", F.avg), ("mediana", F.median), ("std", F.stddev_samp))])


def grid_by_model(rows: DataFrame, value: str = "riduzione_pct") -> DataFrame:
    """by_model over the full grid of bands and models, 0 where there is nothing (what mean and deviation bars show)."""
    agg = by_model(rows, value)
    grid = rows.select("fascia").distinct().crossJoin(rows.select("modello").distinct())
    return grid.join(agg, ["fascia", "modello"], "left").na.fill(0)


def pivot_models(rows: DataFrame, models: list[str], value: str = "riduzione_pct") -> DataFrame:
    """One row a pair, one column a model."""
    return rows.groupBy("coppia").pivot("modello", models).agg(F.first(value))


def box_stats(rows: DataFrame, value: str, floor: float | None = None) -> DataFrame:
    """Quartiles and fences at 1.5 interquartile ranges for each band and model; ``floor`` is for logarithmic axes."""
    x = F.greatest(F.col(value), F.lit(floor)) if floor is not None else F.col(value)
    q = rows.filter("trovato").groupBy("fascia", "modello").agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q1, q2, q3 = (F.col("q")[k] for k in range(3))
    return q.select("fascia", "modello", q1.alias("q1"), q2.alias("mediana"), q3.alias("q3"), (q1 - 1.5 * (q3 - q1)).alias("basso"), (q3 + 1.5 * (q3 - q1)).alias("alto"))


def regression_metrics(rows: DataFrame, predicted: str = "prediction", true: str = "label") -> DataFrame:
    """Mean absolute error and R squared."""
    e, y = F.col(predicted) - F.col(true), F.col(true)
    return rows.agg(F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))
