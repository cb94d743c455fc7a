"""Hierarchical navigable small-world graphs in NumPy, for one shard of unit vectors.

Vectors are inserted in batches. A batch searches the graph so far in lockstep: every query of the batch opens its best
unopened nodes at once, and the beams of all queries are merged by one sort. Links are chosen for diversity (a candidate
nearer to a chosen link than to the node is passed over, and taken only where room is left), and a node that gets
too many links chooses again. The highest layer of up to ``TOP`` nodes is compared in full, so a graph has no
single entry point, and a shard of that size is searched exactly.
"""

from __future__ import annotations

import math

import numpy as np

#: Links of a node: in layer 0, and above.
DEGREE, UPPER = 20, 10
#: Width of the beam while building; nodes of the layer that is compared in full; queries in lockstep; nodes opened at once.
EF_BUILD, TOP, BATCH, OPEN = 48, 512, 256, 4


def levels_of(ids: np.ndarray) -> np.ndarray:
    """The layer each id reaches; a fixed function of the id, geometric with ratio 1 / UPPER."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    u = (h >> np.uint64(11)).astype(float) / 2.0**53
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(UPPER)), 15).astype(np.int64)


class Graph:
    """``x`` holds unit vectors as rows, ``ids`` gives each a fixed layer. ``links[l]`` has -1 for no link."""

    def __init__(self, x: np.ndarray, level: np.ndarray, links: list[np.ndarray] | None = None):
        self.x, self.level, self.n = x.astype(np.float32), level, len(x)
        top = 0
        while (level >= top).sum() > TOP:
            top += 1
        self.top = top
        self.links = links
        if links is None:
            self.links = [np.full((self.n, DEGREE if i == 0 else UPPER), -1, np.int32) for i in range(top)]
            self._build()
        self.entry = np.flatnonzero(level >= top)

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray) -> Graph:
        return cls(x, levels_of(ids))

    def _build(self) -> None:
        at = np.flatnonzero(self.level >= self.top)
        self.entry = at
        # the layers below take their nodes in order of layer, so that a search always comes from above
        order = np.argsort(-np.minimum(self.level, self.top), kind="stable")
        done = 0
        while done < self.n:
            part = order[done : done + min(BATCH, max(64, done))]
            self._insert(part, order[:done])
            done += len(part)

    def _insert(self, part: np.ndarray, before: np.ndarray) -> None:
        if not self.top:
            return
        q = self.x[part]
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        starts = self._best_of(q, self.entry, 8) if len(before) else np.zeros((len(part), 0), np.int64)
        for layer in range(self.top - 1, -1, -1):
            here = self.level[part] >= layer
            if len(before):
                found, sims = self._layer(q, starts, layer, EF_BUILD if here.any() else 8)
                starts = found[:, :8]
            else:
                found, sims = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0), np.float32)
            if not here.any():
                continue
            mate = np.where(here[None, :], mates, -np.inf)
            near = np.argsort(-mate, axis=1, kind="stable")[:, :16]
            both = np.concatenate([found, np.where(np.isfinite(np.take_along_axis(mate, near, 1)), part[near], -1)], 1)
            sims = np.concatenate([sims, np.take_along_axis(mate, near, 1)], 1)
            both = np.where(both == part[:, None], -1, both)
            # nodes of the layer that is compared in full are candidates of one another too
            self._connect(part[here], both[here], np.where(both[here] >= 0, sims[here], -np.inf), layer)

    def _connect(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, layer: int) -> None:
        width = self.links[layer].shape[1]
        chosen = self._choose(cand, sims, width)
        self.links[layer][nodes] = chosen
        a, b = np.repeat(nodes, width), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        by = np.lexsort((a, b))
        a, b = a[by], b[by]
        target, first, count = np.unique(b, return_index=True, return_counts=True)
        slot = np.arange(len(b)) - np.repeat(first, count)
        new = np.full((len(target), count.max()), -1, np.int64)
        new[np.repeat(np.arange(len(target)), count), slot] = a
        old = self.links[layer][target].astype(np.int64)
        new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
        both = np.concatenate([old, new], 1)
        step = max(1, 2_000_000 // (both.shape[1] * self.x.shape[1]))
        for lo in range(0, len(target), step):
            c, t = both[lo : lo + step], target[lo : lo + step]
            s = np.einsum("ijk,ik->ij", self.x[np.maximum(c, 0)], self.x[t])
            s = np.where(c >= 0, s, -np.inf)
            self.links[layer][t] = self._choose(c, s, width)

    def _choose(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` diverse links for each row, nearest first; passed-over candidates fill what is left."""
        by = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
        if cand.shape[1] <= width:
            return np.pad(cand, ((0, 0), (0, width - cand.shape[1])), constant_values=-1).astype(np.int32)
        out = np.full((len(cand), width), -1, np.int32)
        step = max(1, 4_000_000 // (cand.shape[1] * self.x.shape[1]))
        for lo in range(0, len(cand), step):
            c, s = cand[lo : lo + step], sims[lo : lo + step]
            v = self.x[np.maximum(c, 0)]
            apart = v @ v.transpose(0, 2, 1)
            real = np.isfinite(s)
            kept = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                hidden = (kept & (apart[:, j, :] > s[:, j, None])).any(1)
                kept[:, j] = real[:, j] & ~hidden & (kept.sum(1) < width)
            rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :width]
            out[lo : lo + step] = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(c, rank, 1), -1)
        return out

    def _best_of(self, q: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
        s = q @ self.x[nodes].T
        return nodes[np.argsort(-s, axis=1, kind="stable")[:, :k]]

    def _layer(self, q: np.ndarray, starts: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query in one layer: ids (-1 for none) and similarities, best first."""
        rows, width = len(q), starts.shape[1]
        seen, stamp = np.zeros(rows * self.n, bool), np.empty(rows * self.n, np.int32)
        links = self.links[layer]
        ids = np.full((rows, max(ef, width)), -1, np.int64)
        ids[:, :width] = starts
        sims = np.full(ids.shape, -np.inf, np.float32)
        sims[:, :width] = np.where(starts >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(starts, 0)], q), -np.inf)
        r, c = np.nonzero(starts >= 0)
        seen[r * self.n + starts[r, c]] = True
        by = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        opened = ids < 0
        live = np.arange(rows)
        while True:
            live = live[~opened[live].all(1)]
            if not len(live):
                return ids, sims
            # the first OPEN unopened nodes of each beam
            closed = ~opened[live]
            pick = closed & (np.cumsum(closed, 1) <= OPEN)
            opened[live] |= pick
            r, c = np.nonzero(pick)
            flat = (live[r][:, None] * self.n + links[ids[live[r], c]])[links[ids[live[r], c]] >= 0]
            flat = flat[~seen[flat]]
            if not len(flat):
                continue
            stamp[flat] = np.arange(len(flat))
            flat = flat[stamp[flat] == np.arange(len(flat))]  # once each, rows still ascending
            seen[flat] = True
            row, node = flat // self.n, flat % self.n
            s = np.einsum("ij,ij->i", q[row], self.x[node])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            some, count = row[first], np.diff(first, append=len(row))
            slot = np.arange(len(row)) - np.repeat(first, count)
            more = np.full((len(some), count.max()), -1, np.int64)
            more_s = np.full(more.shape, -np.inf, np.float32)
            at = np.repeat(np.arange(len(some)), count), slot
            more[at], more_s[at] = node, s
            ids_, sims_ = np.concatenate([ids[some], more], 1), np.concatenate([sims[some], more_s], 1)
            open_ = np.concatenate([opened[some], more < 0], 1)
            by = np.argsort(-sims_, axis=1)[:, : ids.shape[1]]
            ids[some], sims[some], opened[some] = (np.take_along_axis(m, by, 1) for m in (ids_, sims_, open_))

    def near(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of ``ef`` nodes for each query row, best first."""
        q = q.astype(np.float32)
        starts = self._best_of(q, self.entry, ef if not self.top else 8)
        if not self.top:
            s = np.einsum("ijk,ik->ij", self.x[starts], q)
            return starts, s
        for layer in range(self.top - 1, 0, -1):
            starts = self._layer(q, starts, layer, 16)[0][:, :8]
        return self._layer(q, starts, 0, ef)

    def within(self, q: np.ndarray, least: float, ef: int) -> np.ndarray:
        """A boolean row for each query: the nodes found with similarity of at least ``least``.

        A beam that is full of such nodes is widened until its end lies below ``least``; beyond a quarter of the graph the
        query is compared with every node.
        """
        found = np.zeros((len(q), self.n), bool)
        todo = np.arange(len(q))
        while len(todo) and self.top and 4 * ef <= self.n:
            rest = []
            for lo in range(0, len(todo), BATCH):
                at = todo[lo : lo + BATCH]
                ids, sims = self.near(q[at], ef)
                fine = (ids >= 0) & (sims >= least - 1e-4)
                r, c = np.nonzero(fine)
                found[at[r], ids[r, c]] = True
                rest.append(at[fine.all(1)])
            todo, ef = np.concatenate(rest), 2 * ef
        for lo in range(0, len(todo), BATCH):
            at = todo[lo : lo + BATCH]
            found[at] = q[at].astype(np.float32) @ self.x.T >= least - 1e-4
        return found
