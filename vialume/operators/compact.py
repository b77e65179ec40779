"""Graphs of many edges in one task: a row of edges a node in arrays of the smallest types, filled from packed batches.

A task holds some 6 to 8 bytes an edge, so that ``KERNEL_EDGES`` in one connected component fit where frames of 24 bytes don't.
Distances settle nodes by buckets of about equal distance, each node's edges once or little more; a trace settles them by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Edges and nodes that a task holds in this form.
KERNEL_EDGES = 64_000_000
KERNEL_NODES = 8_000_000
#: Nodes whose edges are followed at once.
AT_ONCE = 20_000


def _smallest(low: float, high: float) -> type:
    return next((t for t in (np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.int64)


def shuffled(ids: np.ndarray, seed: int) -> np.ndarray:
    """``mod_rank`` (potentials) over arrays."""
    return (ids * 48271 + seed * 16807) % 2147483647


class Order:
    """The nodes of strata in the order of ``per_stratum`` (sampling)."""

    def __init__(self, graph: Compact, strata: Iterable[pa.Table], seed: int):
        at, of = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for b in strata:
            ids = b["node_id"].to_numpy()
            known = graph.known(ids)
            at.append(graph.number(ids[known]).astype(np.int32))
            of.append(b["stratum"].to_numpy()[known])
        at, of = np.concatenate(at), np.concatenate(of)
        ids = graph.ids[at]
        order = np.lexsort((ids, shuffled(ids, seed), of))
        self.at = at[order]
        _, start, n = np.unique(of[order], return_index=True, return_counts=True)
        self.start, self.n = start, n

    def first(self, wanted: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the first ``n`` wanted nodes (a mask) of each stratum, each once."""
        here = wanted[self.at]
        before = np.concatenate([[0], np.cumsum(here)])
        here &= before[:-1] - np.repeat(before[self.start], self.n) < n
        return np.unique(self.at[here])


class Compact:
    """Edges out of each node: those of node number n are ``v[start[n]:start[n + 1]]`` with weights ``w``; ``ids`` are sorted."""

    def __init__(self, ids: np.ndarray, start: np.ndarray | None = None, v: np.ndarray | None = None, w: np.ndarray | None = None):
        self.ids, self.start, self.v, self.w = ids, start, v, w
        self.low, span = (int(ids[0]), int(ids[-1] - ids[0]) + 1) if len(ids) else (0, 0)
        self.table = None
        if span <= 4 * len(ids) + 1000:
            self.table = np.full(span, -1, np.int32)
            self.table[ids - self.low] = np.arange(len(ids))

    @classmethod
    def of(cls, nodes: Iterable[np.ndarray], batches: Iterable[pa.Table]) -> Compact:
        """From further node ids and edges (u, v, w) in batches that can be read more than once."""
        out, more, low, high, whole = cls(np.unique(np.concatenate([*nodes, np.empty(0, np.int64)]).astype(np.int64))), [], 0, 0, True
        for b in batches:
            w = b["w"].to_numpy()
            whole &= w.dtype.kind == "i"
            low, high = min(low, w.min(initial=0)), max(high, w.max(initial=0))
            ends = np.concatenate([b["u"].to_numpy(), b["v"].to_numpy()])
            more.append(np.unique(ends[~out.known(ends)]))
            if sum(map(len, more[1:])) > len(more[0]) + 1_000_000:
                more = [np.unique(np.concatenate(more))]
        if any(map(len, more)):
            out = cls(np.union1d(out.ids, np.concatenate(more)))
        out.start = np.zeros(len(out.ids) + 1, np.int64)
        for b in batches:
            out.start[1:] += np.bincount(out.number(b["u"].to_numpy()), minlength=len(out.ids))
        np.cumsum(out.start, out=out.start)
        out.v = np.empty(out.start[-1], np.int32)
        out.w = np.empty(out.start[-1], _smallest(low, high) if whole else np.float64)
        free = out.start[:-1].copy()
        for b in batches:
            u = out.number(b["u"].to_numpy())
            order = np.argsort(u, kind="stable")
            own, first, n = np.unique(u[order], return_index=True, return_counts=True)
            at = np.repeat(free[own] - first, n) + np.arange(len(u))
            out.v[at], out.w[at] = out.number(b["v"].to_numpy())[order], b["w"].to_numpy()[order]
            free[own] += n
        if hasattr(batches, "clear"):
            batches.clear()
        return out

    def number(self, ids: np.ndarray) -> np.ndarray:
        """The numbers of ids, which must be known."""
        return np.searchsorted(self.ids, ids) if self.table is None else self.table[ids - self.low]

    def known(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), bool)
        inside = (ids >= self.ids[0]) & (ids <= self.ids[-1])
        ids = np.where(inside, ids, self.ids[0])
        return inside & (self.ids[np.searchsorted(self.ids, ids)] == ids if self.table is None else self.table[ids - self.low] >= 0)

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the edges out of nodes, and how many each has."""
        first = self.start[nodes]
        n = self.start[nodes + 1] - first
        return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), n

    def _parts(self) -> Iterable[tuple[np.ndarray, slice]]:
        """Tails of edges, and their places, some nodes at a time."""
        for lo in range(0, len(self.ids), AT_ONCE):
            at = self.start[lo : lo + AT_ONCE + 1]
            yield np.repeat(np.arange(lo, lo + len(at) - 1), np.diff(at)), slice(at[0], at[-1])

    def reduced(self, y: np.ndarray, region: np.ndarray) -> Compact:
        """The edges whose ends share a part (``region``, bits by node), with weights ``w + y[u] - y[v]``."""
        whole, n, end = bool((region & region[:1]).all()), np.zeros(len(self.ids) + 1, np.int64), 0
        far = float(np.abs(y).max(initial=0)) * 2 + float(np.abs(self.w).max(initial=0))
        w = np.empty(len(self.v), self.w.dtype if self.w.dtype.kind == "f" else _smallest(-far, far))
        v = self.v if whole else np.empty_like(self.v)
        for u, at in self._parts():
            head = self.v[at]
            new = self.w[at] + y[u] - y[head]
            if not whole:
                keep = (region[u] & region[head]) > 0
                u, head, new = u[keep], head[keep], new[keep]
                v[end : end + len(u)] = head
            w[end : end + len(u)] = new
            if len(u):
                n[u[0] + 1 : u[-1] + 2] += np.bincount(u - u[0])
            end += len(u)
        return Compact(self.ids, np.cumsum(n), v[:end], w[:end])

    def repair(self) -> np.ndarray:
        """Potentials that lift the weights, which become not less than 0: shortest distances, every node starting at 0."""
        phi = self.lower(np.zeros(len(self.ids)), np.ones(len(self.ids), bool))
        for u, at in self._parts():
            self.w[at] = np.maximum(0, self.w[at] + phi[u] - phi[self.v[at]])
        return phi

    def lower(self, d: np.ndarray, active: np.ndarray, w: np.ndarray | None = None, step: float | None = None, until: int | None = None) -> np.ndarray:
        """``d`` lowered along edges from the nodes ``active`` (a mask) until nothing changes.

        With ``step`` (weights not below 0) nodes go by buckets of that width; with ``until`` it stops when that node and all
        nearer or equally far ones are final.
        """
        w, edges, nodes = self.w if w is None else w, 0, len(self.ids)
        most = float("inf") if step is None else -float("inf")
        for _ in range(1 << 62):
            now = np.flatnonzero(active & (d <= most)) if step is not None else np.flatnonzero(active)
            if not len(now):
                if step is None or not active.any() or (until is not None and d[until] <= most):
                    return d
                most = d[active].min() + step
                continue
            active[now] = False
            for lo in range(0, len(now), AT_ONCE):
                part = now[lo : lo + AT_ONCE]
                at, n = self.out(part)
                edges += len(at)
                v = self.v[at]
                new = np.repeat(d[part], n) + w[at]
                less = new < d[v]
                v, new = v[less], new[less]
                np.minimum.at(d, v, new)
                active[v] = True
            if edges > (nodes + 1) * max(1, len(self.v)):
                raise ValueError("negative cycle")
        return d

    def width(self, w: np.ndarray | None = None) -> float:
        """A width of buckets: a tenth of the usual weight."""
        w = self.w if w is None else w
        return max(1e-9, float(w[:: max(1, len(w) // 100_000)].mean()) / 10) if len(w) else 1.0

    def distances(self, source: int, w: np.ndarray | None = None, step: float | None = None, until: int | None = None) -> np.ndarray:
        """Distances from a node number to all; infinity where it leads nowhere. Weights mustn't be below 0."""
        d, active = np.full(len(self.ids), np.inf), np.zeros(len(self.ids), bool)
        d[source], active[source] = 0, True
        return self.lower(d, active, w, self.width(w) if step is None else step, until)

    def settled(self, source: int, target: int | None, w: np.ndarray | None = None, step: float | None = None) -> tuple[float, int]:
        """Distance and number of explored nodes of Dijkstra that ends at the target and settles ties by node, from distances alone.

        All nearer nodes are explored. Of those equally far, ways without length (from one to another) decide which come first.
        """
        d = self.distances(source, w, step, target)
        if target is None or not np.isfinite(d[target]):
            return float("inf"), int(np.isfinite(d).sum())
        w, far = self.w if w is None else w, d[target]
        nearer = np.flatnonzero(d < far)
        level = np.flatnonzero(d == far)
        at, n = self.out(level)
        free = (w[at] == 0) & (d[self.v[at]] == far)
        if not free.any():
            return float(far), len(nearer) + int((level <= target).sum())
        entered = np.zeros(len(d), bool)
        entered[source] = far == 0
        for lo in range(0, len(nearer), AT_ONCE):
            part = nearer[lo : lo + AT_ONCE]
            p, k = self.out(part)
            v = self.v[p]
            entered[v[(np.repeat(d[part], k) + w[p] == far) & (d[v] == far)]] = True
        ways: dict[int, list[int]] = {}
        for a, b in zip(np.repeat(level, n)[free].tolist(), self.v[at[free]].tolist(), strict=True):
            ways.setdefault(a, []).append(b)
        heap = level[entered[level]].tolist()
        heapq.heapify(heap)
        seen = set(heap)
        for explored in range(1, len(level) + 1):
            x = heapq.heappop(heap)
            if x == target:
                return float(far), len(nearer) + explored
            for y in ways.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    heapq.heappush(heap, y)
        raise AssertionError("the target is on its level")

    def trace(self, source: int, target: int | None, bound: np.ndarray | None, reopen: bool) -> tuple[float, int]:
        """Distance and number of explored nodes of ``best_first`` (search), closed or reopening, with estimates ``bound``."""
        best, explored, limit, w = np.full(len(self.ids), np.inf), np.zeros(len(self.ids), bool), float("inf"), self.w
        h = np.zeros(len(self.ids)) if bound is None else bound
        best[source] = 0
        heap, target = [(float(h[source]), 0.0, source)], -1 if target is None else target
        start, v_of = self.start, self.v
        while heap:
            f, g, n = heapq.heappop(heap)
            if f > limit and reopen:
                break
            if g > best[n] if reopen else explored[n]:
                continue
            explored[n] = True
            if n == target and not reopen:
                return g, int(explored.sum())
            if n == target:
                limit = min(limit, g)
                continue
            i, j = start[n], start[n + 1]
            v = v_of[i:j]
            way = w[i:j] + g
            less = way < best[v]
            if not reopen:
                less &= ~explored[v]
            if less.any():
                v, way = v[less], way[less]
                best[v] = way
                for item in zip((way + h[v]).tolist(), way.tolist(), v.tolist(), strict=True):
                    heapq.heappush(heap, item)
                    if item[2] == target:
                        limit = min(limit, item[1])
        return float(best[target]) if target >= 0 else float("inf"), int(explored.sum())
