"""Best-first search over a graph in compressed rows, many edges at a time."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

from tidegraph.config import BLOCKER

#: Energies closer than this count as equal: the label that came first stays.
SAME = 1e-15
#: Labels further than this below another stay below it when both are rounded to 12 places.
APART = 1e-11
#: Edges of a node from which on those that can't lead to a first row are found once and left out of later searches.
HUB = 1_000


def rounded(x: np.ndarray) -> np.ndarray:
    """``round(x, 12)`` of every value: halves that the product blurs are rounded one by one."""
    scaled = x * 1e12
    whole = np.rint(scaled)
    out = whole / 1e12
    near = np.abs(np.abs(scaled - whole) - 0.5) < 1e-2
    out[near] = [round(float(v), 12) for v in x[near]]
    return out


@dataclass
class Rows:
    """Open edges of a mask by source, in the stored order (edge_type, dst, weight). ``masked`` and ``blocked`` count, per
    node, the edges outside the mask and those that block or are closed by a blocking one. ``carry`` is what ``greatest``
    gives, where it is known."""

    nodes: np.ndarray
    first: np.ndarray
    dst: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    masked: np.ndarray | None = None
    blocked: np.ndarray | None = None
    carry: float | None = None

    @staticmethod
    def mapped(folder: str, carry: float, counted: bool = False) -> Rows:
        """Rows in the files of a folder. They are mapped, so that the tasks of a machine share what they touch of them."""

        def of(name: str, kind: type) -> np.ndarray:
            path = f"{folder}/{name}"
            return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.empty(0, kind)

        counts = [of(c, np.int64) for c in ("masked", "blocked")] if counted else [None, None]
        return Rows(of("nodes", np.int64), of("first", np.int64), of("dst", np.int32), of("kind", np.int8), of("weight", np.float64), *counts, carry)

    @staticmethod
    def of(src: np.ndarray, dst: np.ndarray, kind: np.ndarray, weight: np.ndarray, mask: frozenset, counted: bool = False) -> Rows:
        nodes = np.union1d(np.unique(src), np.unique(dst))
        src, dst = (np.searchsorted(nodes, x).astype(np.int32) for x in (src, dst))
        kind = kind.astype(np.int8)
        shut = kind == BLOCKER
        closed = shut.copy()
        if shut.any():
            pair = src.astype(np.int64) * len(nodes) + dst
            closed |= np.isin(pair, np.unique(pair[shut]))
        inside = np.isin(kind, np.array(sorted(mask), np.int8))
        # A blocking edge counts as blocked even outside the mask; a closed one outside the mask counts as masked.
        masked = np.bincount(src[~inside & ~shut], minlength=len(nodes)) if counted else None
        blocked = np.bincount(src[shut | (inside & closed)], minlength=len(nodes)) if counted else None
        keep = np.flatnonzero(inside & ~closed)
        keep = keep[np.lexsort((weight[keep], dst[keep], kind[keep], src[keep]))]
        first = np.append(0, np.cumsum(np.bincount(src[keep], minlength=len(nodes))))
        return Rows(nodes, first, dst[keep], kind[keep], weight[keep], masked, blocked)

    def greatest(self, att: dict, rigor: float) -> float:
        """No edge carries more than this share of an energy."""
        if self.carry is not None:
            return self.carry
        if not len(self.weight):
            return 0.0
        table = np.array([att.get(t, 0.0) for t in range(128)])
        return float((table[self.kind] * self.weight).max()) * rigor * (1 + 1e-12)


class Search:
    """Label-setting searches from single seeds, in the order of energy and node.

    Edges carry no more than the share ``greatest`` < 1 of an energy. So no node whose label is above that share of the
    greatest open label can get a better one from the others of them: all these are settled in one step, in their order.
    """

    def __init__(self, rows: Rows, steps: int, threshold: float, att: dict, rigor: float):
        self.rows, self.steps, self.threshold, self.rigor = rows, steps, threshold, rigor
        self.att = np.array([att.get(t, 0.0) for t in range(128)])
        self.share = rows.greatest(att, rigor)
        n = len(rows.nodes)
        self.best, self.top, self.depth = np.full(n, -1.0), np.full(n, -1.0), np.zeros(n, np.int16)
        self.prior, self.kind, self.winner = np.zeros(n, np.int32), np.zeros(n, np.int8), np.zeros(n, np.int64)
        self.held, self.firsts = np.empty(0, np.int64), {}

    def run(self, seed: int, most: int | None = None) -> tuple[np.ndarray, dict]:
        """Places in ``rows.nodes`` of the nodes reached, and counters; labels stay in ``best``, ``depth``, ``prior`` and
        ``kind`` until the next run. A seed without edges gives no places.

        With ``most``, at least the nodes whose rounded energies are among the ``most`` greatest come out, and counters don't
        count. Energies only fall along a path, so a label under the ``most``-th greatest leads to no such node: it is dropped.
        """
        r, best, depth = self.rows, self.best, self.depth
        n = dict.fromkeys(("expanded", "masked", "thresholded", "blocked"), 0)
        at = int(np.searchsorted(r.nodes, seed))
        if at == len(r.nodes) or r.nodes[at] != seed:
            return np.empty(0, np.int64), n | {"expanded": int(self.steps > 0)}
        best[self.held] = -1.0
        floor = self.threshold
        best[at], depth[at], self.prior[at], self.kind[at] = 1.0, 0, -1, 0
        waiting, reached = np.array([at]), []
        while len(waiting):
            energy = best[waiting]
            now = energy > energy.max() * self.share  # holds for the greatest: share < 1, and no energy is under the threshold
            settled, energy, waiting = waiting[now], energy[now], waiting[~now]
            reached.append(settled)
            deep = depth[settled] < self.steps
            settled, energy = settled[deep], energy[deep]
            if not len(settled):
                continue
            order = np.lexsort((settled, -energy))
            settled, energy = settled[order], energy[order]
            n["expanded"] += len(settled)
            if r.masked is not None:
                n["masked"] += int(r.masked[settled].sum())
                n["blocked"] += int(r.blocked[settled].sum())
            edge, who = self._edges(settled, most)
            out = energy[who] * self.att[r.kind[edge]] * r.weight[edge] * self.rigor
            ok = out >= floor
            n["thresholded"] += len(out) - int(np.count_nonzero(ok))
            dst = r.dst[edge]
            ok &= out > best[dst] + SAME
            edge, who, out, dst = edge[ok], who[ok], out[ok], dst[ok]
            if most is not None and len(out) > 4 * most:
                least = np.partition(out, len(out) - 4 * most)[len(out) - 4 * most]
                if len(np.unique(dst[out >= least])) >= most:
                    floor = max(floor, least - APART)
                    ok = out >= floor
                    edge, who, out, dst = edge[ok], who[ok], out[ok], dst[ok]
            if len(out):
                waiting = np.concatenate([waiting, self._label(edge, settled[who], out, dst)])
                labels = np.concatenate([best[x] for x in (*reached, waiting)]) if most is not None else ()
                if most is not None and len(labels) >= most:
                    floor = max(floor, np.partition(labels, len(labels) - most)[len(labels) - most] - APART)
                    low = best[waiting] < floor
                    best[waiting[low]], waiting = -1.0, waiting[~low]
        self.held = np.concatenate(reached)
        return self.held, n

    def _edges(self, settled: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The edges of the nodes, in their order, and which of the nodes each comes from."""
        first = self.rows.first
        count = first[settled + 1] - first[settled]
        if most is None or count.max() <= max(HUB, 4 * most):
            edge = np.arange(count.sum()) + np.repeat(first[settled] - np.cumsum(count) + count, count)
        else:
            parts = [self._first(v, most) if n > max(HUB, 4 * most) else np.arange(first[v], first[v + 1]) for v, n in zip(settled.tolist(), count.tolist(), strict=True)]
            edge, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return edge, np.repeat(np.arange(len(settled)), count)

    def _first(self, node: int, most: int) -> np.ndarray:
        """The edges of a node without those behind ``most`` other targets, whatever energy the node has."""
        if (node, most) not in self.firsts:
            r = self.rows
            part = slice(r.first[node], r.first[node + 1])
            share = self.att[r.kind[part]] * r.weight[part] * self.rigor
            some, keep = 4 * most, np.ones(len(share), bool)
            while some < len(share):
                least = np.partition(share, len(share) - some)[len(share) - some]
                if len(np.unique(r.dst[part][share >= least])) >= most:
                    keep = share >= least - APART / self.threshold
                    break
                some *= 4
            self.firsts[node, most] = r.first[node] + np.flatnonzero(keep)
        return self.firsts[node, most]

    def _label(self, edge: np.ndarray, src: np.ndarray, out: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Give every target the best of its offers, which come in their order; the targets that had no label before."""
        best, top = self.best, self.top
        top[dst] = -1.0
        np.maximum.at(top, dst, out)
        near = np.flatnonzero(out >= top[dst] - 10 * SAME)
        self.winner[dst[near[::-1]]] = near[::-1]
        odd = near[out[near] != top[dst[near]]]
        if len(odd):  # nearly equal: each replaces the one before only if it is clearly more
            pick: dict = {}
            for i in near[np.isin(dst[near], dst[odd])].tolist():
                d = int(dst[i])
                if d not in pick or out[i] > out[pick[d]] + SAME:
                    pick[d] = i
            self.winner[list(pick)] = list(pick.values())
        first = near[self.winner[dst[near]] == near]
        target = dst[first]
        new = target[best[target] < 0]
        best[target], self.prior[target], self.kind[target] = out[first], src[first], self.rows.kind[edge[first]]
        self.depth[target] = self.depth[src[first]] + 1
        return new

    def paths(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, types): the edge types of the best paths one after the other, the i-th up to ends[i]."""
        length = self.depth[places].astype(np.int64)
        ends = np.cumsum(length)
        types = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        left, to, node = length.copy(), ends - 1, places
        while True:
            on = left > 0
            if not on.any():
                return ends, types
            left, to, node = left[on], to[on], node[on]
            types[to] = self.kind[node]
            left, to, node = left - 1, to - 1, self.prior[node]


def chosen(node: np.ndarray, energy: np.ndarray, length: np.ndarray, top_k: int | None, order: tuple[str, ...], among: np.ndarray | tuple[int, int] | None, always: np.ndarray | None) -> np.ndarray:
    """Places of the rows of a wave that come out, in ``order``: of the nodes in ``among`` (a range or sorted nodes), those
    in ``always`` (sorted) and the first ``top_k`` others."""
    at = np.arange(len(node))
    if among is not None:
        at = np.flatnonzero((node >= among[0]) & (node < among[1]) if isinstance(among, tuple) else _isin(node, among))
    rest = at
    if always is not None:
        sure = _isin(node[at], always)
        rest, at = at[~sure], at[sure]
    keys = {"energy": -energy, "length": length, "node": node}
    if top_k is not None and top_k < len(rest):
        first = keys[order[0]][rest]
        rest = rest[first <= np.partition(first, top_k - 1)[top_k - 1]]
        rest = rest[np.lexsort([keys[o][rest] for o in reversed(order)])][:top_k]
    at = rest if always is None else np.concatenate([at, rest])
    return at[np.lexsort([keys[o][at] for o in reversed(order)])]


def _isin(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), bool)
    at = np.searchsorted(some, x)
    at[at == len(some)] = 0
    return some[at] == x
