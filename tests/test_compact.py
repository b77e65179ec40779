"""Large graphs in compact form give the rows of the plain forms, whole components of any size included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vialume import queries
from vialume.operators import compact, relax, search
from vialume.operators.compact import Compact

SF = "/root/testdata/sf0.001"


def _random(rng, n: int, m: int, low: int, high: int, spread: int = 1) -> tuple[Compact, search.Adjacency, np.ndarray]:
    e = pd.DataFrame({"u": rng.integers(0, n, m) * spread, "v": rng.integers(0, n, m) * spread, "w": rng.integers(low, high, m)}).query("u != v").groupby(["u", "v"], as_index=False).w.min()
    e = e.sample(frac=1, random_state=int(rng.integers(1 << 30)))
    ids = np.arange(0, n, 2) * spread
    return Compact.of([ids], tuple(pa.Table.from_pandas(e.iloc[k::3], preserve_index=False) for k in range(3))), search.Adjacency(*(e[c].to_numpy() for c in "uvw")), e


@pytest.mark.parametrize("low,high", [(0, 3), (1, 9), (5, 40_000), (0, 1)])
@pytest.mark.parametrize("spread", [1, 977])
def test_compact_searches_are_traces(low, high, spread):
    rng = np.random.default_rng(low + high)
    for n, m in ((2, 1), (12, 30), (60, 150), (150, 900)):
        g, plain, _ = _random(rng, n, m, low, high, spread)
        bound = rng.integers(0, 4 * high, len(g.ids)).astype(float)
        for s, t in rng.integers(0, len(g.ids), (12, 2)).tolist():
            h = dict(zip(g.ids.tolist(), bound.tolist(), strict=True))
            ask = lambda mode, b: (lambda d, x: (float(d), len(x)))(*search.best_first(plain, int(g.ids[s]), int(g.ids[t]), b, mode))  # noqa: B023, E731
            assert g.settled(s, t) == g.trace(s, t, None, False) == ask(search.CLOSED, None)
            for reopen in (False, True):
                assert g.trace(s, t, bound, reopen) == ask(search.REOPEN if reopen else search.CLOSED, h)
            d = g.distances(s)
            assert (float(d[t]), int(np.isfinite(d).sum())) == ask(search.EXHAUSTIVE, h)
        assert g.settled(0, None) == (float("inf"), int(np.isfinite(g.distances(0)).sum()))


def test_compact_lowers_negative_edges():
    rng = np.random.default_rng(3)
    g, _, e = _random(rng, 80, 400, 1, 50)
    y = rng.integers(-60, 60, len(g.ids))
    u, v = g.number(e.u.to_numpy()), g.number(e.v.to_numpy())
    own = np.repeat(np.arange(len(g.ids)), np.diff(g.start))
    phi = g.lower(np.zeros(len(g.ids)), np.ones(len(g.ids), bool), g.w + y[own] - y[g.v])
    plain = relax.Arrays(g.ids, e.u.to_numpy(), e.v.to_numpy(), (e.w.to_numpy() + y[u] - y[v]).astype(float)).relax(np.zeros((1, len(g.ids))))[0]
    assert (phi == plain).all() and phi.min() < 0


def test_compact_types():
    g = Compact.of([np.array([9])], (pa.table({"u": [1, 5], "v": [5, 1], "w": [40_000, 2]}),))
    assert g.ids.tolist() == [1, 5, 9] and g.w.dtype == np.int32 and g.start.tolist() == [0, 1, 2, 2]
    assert Compact.of([], (pa.table({"u": [1], "v": [5], "w": [0.5]}),)).distances(0).tolist() == [0.0, 0.5]
    assert g.known(np.array([0, 1, 5, 7, 9, 11])).tolist() == [False, True, True, False, True, False]


@pytest.mark.parametrize("name", ["dataset_ring", "dataset_unified", "dataset_ring_advanced", "dataset_regional", "dataset_standard", "dijkstra_explored_kernel", "astar_learned", "astar_exhaustive_kernel", "dijkstra_explored_repaired", "dijkstra_repaired_distance", "explored_comparison_cut"])
def test_one_large_component(spark, monkeypatch, name):
    """The graph is one component of more edges than a task holds as a frame: traces were refused and distances went by rounds."""
    rows = lambda: sorted(map(str, queries.QUERIES[name](spark, SF).collect()))
    small = rows()

    def never(*a, **b):
        raise AssertionError("this form isn't wanted here")

    monkeypatch.setattr(relax.fits, "__defaults__", (5,))
    monkeypatch.setattr(relax, "KERNEL_EDGES", 5)
    monkeypatch.setattr(search, "KERNEL_EDGES", 5)
    monkeypatch.setattr(search, "for_each_component", never)
    monkeypatch.setattr(relax, "_by_relaxation", never)
    assert small and rows() == small


@pytest.mark.parametrize("name", ["dataset_ring", "dijkstra_explored_kernel"])
def test_beyond_compact_by_components(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, queries.QUERIES[name](spark, SF).collect()))
    small = rows()
    monkeypatch.setattr(relax.fits, "__defaults__", (300,))
    monkeypatch.setattr(compact, "KERNEL_EDGES", 300)
    assert rows() == small


def test_first_nodes_of_strata():
    g = Compact.of([np.array([3, 4, 8, 9, 20])], [])
    order = compact.Order(g, [pa.table({"stratum": [0, 0, 1, 1, 1, 0], "node_id": [3, 9, 4, 8, 9, 77]})], 42)
    rank = {i: (i * 48271 + 42 * 16807) % 2147483647 for i in (3, 4, 8, 9)}
    wanted = np.array([True, True, True, False, True])
    assert g.ids[order.first(wanted, 1)].tolist() == sorted({3, min((4, 8), key=rank.get)})
    assert g.ids[order.first(wanted, 5)].tolist() == [3, 4, 8]
