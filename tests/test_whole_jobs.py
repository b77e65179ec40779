"""Registered queries do their operators' whole job, and the forms that make this affordable agree with plain ones."""

from __future__ import annotations

import inspect
import time

import numpy as np
import pytest

from vialume import queries
from vialume.operators import boosting, potentials, sampling
from vialume.plans import datasets, learning

SF = "/root/testdata/sf0.001"


def _spied(monkeypatch, module, name: str) -> dict:
    """All arguments of the calls of a function, by name."""
    f, seen = getattr(module, name), {}

    def call(*a, **b):
        bound = inspect.signature(f).bind(*a, **b)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return f(*a, **b)

    monkeypatch.setattr(module, name, call)
    return seen


@pytest.mark.parametrize("name,rows,sizes", [("train_baseline", "rings", (20, 150)), ("anchored_prediction", "rings", (20, 150)), ("train_regional", "regional", (5, 100))])
def test_training_has_all_rounds_and_targets(spark, monkeypatch, name, rows, sizes):
    sampled, asked = _spied(monkeypatch, datasets, rows), _spied(monkeypatch, boosting, "fitted")
    assert queries.QUERIES[name](spark, SF).count()
    assert (asked["rounds"], asked["rate"], asked["depth"]) == (300, 0.05, 8)
    assert (sampled["per_band"], sampled["per_pair"]) == sizes


def test_cuts_of_all_pairs(spark, monkeypatch):
    asked = _spied(monkeypatch, sampling, "pairs_by_band")
    assert queries.QUERIES["explored_comparison_cut"](spark, SF).groupBy("fascia").count().filter("count > 50").count() and asked["n"] == 100


def test_boosting_in_one_task_is_that_of_rounds(spark, monkeypatch):
    """Few values a column, so that both forms choose among the same splits."""
    rows = spark.range(240).selectExpr("id AS row_id", "id AS node_id", "id % 11 / 1.0D AS x", "id % 7 / 1.0D AS z", "id % 11 * 3.7D + id % 7 * (id % 11) + id % 5 / 9.0D AS tempo_reale_s")
    near = rows.selectExpr("row_id", "5.0D AS peso", "(x + 3) % 11 AS x", "z").union(rows.filter("row_id % 2 = 0").selectExpr("row_id", "double('inf')", "x", "z"))
    ask = lambda m: np.array([r["prediction"] for r in m.transform(rows).orderBy("row_id").collect()])
    plain = learning.boost(rows, near, lambda p, h, t: datasets.mean_loss(p, h, 0.5 + t / 10), ["x", "z"], rounds=6, rate=0.3, depth=3)
    own = boosting.fitted(rows, ["x", "z"], 6, 0.3, 3, near, lambda t: 0.5 + t / 10)
    assert np.abs(ask(plain) - ask(own)).max() < 1e-4 * np.abs(ask(plain)).max()


def test_boosting_fits_and_refuses_no_rows(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id AS node_id", "id % 7 AS target_id", "id / 10.0D AS node_lat", "id % 13 / 1.0D AS node_lon", "0.0D AS target_lat", "0.0D AS target_lon", "id * 1.0D AS haversine_dist_m", "pow(id, 2) AS tempo_reale_s")
    model, _ = learning.train_standard(rows, rounds=200, rate=0.1, depth=4)
    error = model.transform(rows).selectExpr("avg(abs(prediction - tempo_reale_s)) / avg(tempo_reale_s) AS e").collect()[0]["e"]
    assert error < 0.01
    monkeypatch.setattr(boosting, "KERNEL_ROWS", 10)  # beyond a task
    assert isinstance(learning.train_standard(rows, rounds=2, depth=2)[0], learning.Boosted)
    with pytest.raises(ValueError):
        boosting.fitted(rows.filter("node_id < 0"), ["node_lat"], 2, 0.1, 2)


def test_thresholds_part_neighbouring_values():
    x = np.array([1.0, np.nextafter(np.float32(1), np.float32(2)), 3.0, 3.0, np.nan], np.float32)
    cuts = boosting.thresholds(x)
    assert len(cuts) == 2 and [int(b) for b in np.searchsorted(cuts, np.unique(x[:4]), side="right")] == [0, 1, 2]


@pytest.mark.parametrize("shape", ["even", "lattice", "twice"])
def test_triangles_by_walking(shape):
    rng = np.random.default_rng(5)
    points = {"even": rng.random((700, 2)), "lattice": np.column_stack([np.arange(600) * 7919 % 601, np.arange(600) * 6151 % 607]) / 60.0, "twice": np.repeat(rng.random((200, 2)), 2, axis=0)}[shape]
    found = potentials._triangulate_walking(points)
    area = lambda points, t: np.abs((points[t[:, 1], 0] - points[t[:, 0], 0]) * (points[t[:, 2], 1] - points[t[:, 0], 1]) - (points[t[:, 1], 1] - points[t[:, 0], 1]) * (points[t[:, 2], 0] - points[t[:, 0], 0])).sum()
    once = np.unique(points, axis=0) if shape == "twice" else points
    plain = potentials.triangulate(once)
    if shape == "even":
        assert sorted(map(sorted, found.tolist())) == sorted(map(sorted, plain.tolist()))
    assert abs(area(points, found) - area(once, plain)) < 1e-6 * area(once, plain) and abs(len(found) - len(plain)) <= (0 if shape == "even" else 4)


def test_more_anchors_than_were_allowed():
    n = 120_000
    points = np.column_stack([np.arange(n) * 10 * 7919 % 10007 / 10007, np.arange(n) * 10 * 6151 % 10009 / 10009]) * 0.6 + 45
    assert n <= potentials.MOST_ANCHORS
    began = time.perf_counter()
    tri = potentials.triangulate(points)
    assert 2 * n - 2000 < len(tri) < 2 * n and time.perf_counter() - began < 120
