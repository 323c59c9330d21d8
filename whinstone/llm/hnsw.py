"""Hierarchical navigable small-world graphs in numpy: batches of points are inserted and searched together."""

from __future__ import annotations

import math

import numpy as np

#: Links of a new point, most links of a point, and beam while building.
LINKS, MOST, BUILD_BEAM = 16, 32, 64
#: Nodes of a beam that are expanded at once: so many, or of a wide beam a part of it, so that its rounds stay few.
EXPAND, EXPAND_PART = 4, 16
#: Layers of at most this many points are linked by comparing all of them.
EXACT = 1024
BATCH = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. They are scaled by a power of two first, so no finite row is too large or too small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sims(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("akd,ad->ak", x.take(ids, axis=0), q, optimize=False)


def search_layer(x: np.ndarray, adjacent: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` nearest points that a beam search from entry (one row of point numbers a query) finds, nearest
    first: numbers (-1 where there are fewer) and similarities."""
    n_q, seen = len(q), np.zeros((len(q), len(x) + 1), bool)
    ids = np.full((n_q, beam), -1, np.int32)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    todo = np.zeros((n_q, beam), bool)
    k = min(entry.shape[1], beam)
    first = entry[:, :k]
    ids[:, :k] = first
    sims[:, :k] = np.where(first >= 0, _sims(x, np.maximum(first, 0), q), -np.inf)
    todo[:, :k] = first >= 0
    np.put_along_axis(seen, first, True, axis=1)
    rows = np.arange(n_q)
    while len(rows):
        s = np.where(todo[rows], sims[rows], -np.inf)
        width = min(max(EXPAND, beam // EXPAND_PART), beam)
        at = np.argpartition(-s, width - 1, axis=1)[:, :width] if beam > width else np.tile(np.arange(width), (len(rows), 1))
        open_ = np.take_along_axis(s, at, 1) > -np.inf
        alive = open_.any(axis=1)
        rows, at, open_ = rows[alive], at[alive], open_[alive]
        if not len(rows):
            break
        todo[rows[:, None], at] = False
        from_ = np.where(open_, ids[rows[:, None], at], -1)
        near = np.where(from_[:, :, None] >= 0, adjacent[from_], -1).reshape(len(rows), -1)
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        seen[:, -1] = False
        most = int(fresh.sum(axis=1).max()) if fresh.size else 0
        if not most:
            continue
        pack = np.argsort(~fresh, axis=1, kind="stable")[:, :most]  # the fresh ones to the left
        near = np.sort(np.where(np.take_along_axis(fresh, pack, 1), np.take_along_axis(near, pack, 1), -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # a point that two expanded nodes share counts once
        got = np.where(fresh, _sims(x, np.maximum(near, 0), q[rows]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[rows], near], axis=1)
        all_sims = np.concatenate([sims[rows], got], axis=1)
        all_todo = np.concatenate([todo[rows], fresh], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        sims[rows] = np.take_along_axis(all_sims, best, 1)
        todo[rows] = np.take_along_axis(all_todo, best, 1) & (sims[rows] > -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, ids, -1), sims


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int, must: np.ndarray | None = None) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) up to `links`: those of `must`; those nearer to the row's point than to any
    chosen before them, so links spread in all directions; then the nearest of the rest."""
    n, c = ids.shape
    v = x.take(np.maximum(ids, 0), axis=0)
    between = np.matmul(v, v.transpose(0, 2, 1))
    valid = (ids >= 0) & (sims > -np.inf)
    kept = np.zeros((n, c), bool) if must is None else must & valid & (np.cumsum(must & valid, axis=1) <= links)
    count = kept.sum(axis=1)
    for j in range(c):
        blocked = (kept[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(axis=1) if j else np.zeros(n, bool)
        take = valid[:, j] & ~kept[:, j] & ~blocked & (count < links)
        kept[:, j] |= take
        count += take
    rest = valid & ~kept
    fill = rest & (np.cumsum(rest, axis=1) <= (links - count)[:, None])
    kept |= fill
    pack = np.argsort(~kept, axis=1, kind="stable")[:, :links]
    out = np.where(np.take_along_axis(kept, pack, 1), np.take_along_axis(ids, pack, 1), -1)
    if out.shape[1] < links:
        out = np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Points in the order of insertion, highest layers first; layer k joins the first sizes[k] of them."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        x = np.asarray(x, np.float64)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        sizes = [int((level >= k).sum()) for k in range(level.max() + 1 if n else 1)]
        self.sizes = [s for s in sizes if s] or [n]
        self.layers: list[np.ndarray] = [np.empty(0)] * len(self.sizes)
        for k in range(len(self.sizes) - 1, -1, -1):
            self.layers[k] = self._build(k)
        del self.parent

    def packed(self) -> tuple:
        """All but the points; small numbers in small types."""
        kind = np.int16 if len(self.x) < 1 << 15 else np.int32
        return self.order.astype(np.int32), self.sizes, [a.astype(kind) for a in self.layers]

    @classmethod
    def unpacked(cls, x: np.ndarray, packed: tuple) -> Graph:
        """The graph of the same points again."""
        out = cls.__new__(cls)
        order, out.sizes, layers = packed
        out.order = order.astype(np.int64)
        out.x = np.ascontiguousarray(x[out.order], np.float32)
        out.layers = [a.astype(np.int32) for a in layers]
        return out

    def _build(self, k: int) -> np.ndarray:
        n = self.sizes[k]
        adjacent = np.full((n, MOST), -1, np.int32)
        self.parent = np.full(n, -1, np.int64)  # the nearest point a point chose: it keeps its link back, so all can be reached
        first = min(n, EXACT)
        block = self.x[:first]
        for lo in range(0, first, BATCH):
            s = block[lo : lo + BATCH] @ block.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            width = min(BUILD_BEAM, first)
            near = np.argsort(-s, axis=1, kind="stable")[:, :width]
            adjacent[lo : lo + BATCH, :LINKS] = choose(self.x, near, np.take_along_axis(s, near, 1), LINKS)
        self.parent[:first] = adjacent[:first, 0]
        self._back(adjacent, np.repeat(np.arange(first), LINKS), adjacent[:first, :LINKS].ravel())
        for lo in range(first, n, BATCH):
            hi = min(n, lo + BATCH)
            q = self.x[lo:hi]
            entry = self._entry(q, k)
            entry = np.where(entry < lo, entry, 0)  # points of the layer above that aren't in this one yet
            entry[:, 1:][entry[:, 1:] == 0] = -1
            near, sims = search_layer(self.x[:lo], adjacent[:lo], q, entry, BUILD_BEAM)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            width = min(LINKS, hi - lo)
            mates = np.argsort(-own, axis=1, kind="stable")[:, :width]
            near = np.concatenate([near, lo + mates], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, mates, 1)], axis=1)
            by = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            near, sims = np.take_along_axis(near, by, 1), np.take_along_axis(sims, by, 1)
            chosen = choose(self.x, near, sims, LINKS)
            adjacent[lo:hi, :LINKS] = chosen
            self.parent[lo:hi] = chosen[:, 0]
            self._back(adjacent, np.repeat(np.arange(lo, hi), LINKS), chosen.ravel())
        return adjacent

    def _back(self, adjacent: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
        """Links from the chosen points back to the new ones; a point with too many chooses again among its nearest."""
        ok = to >= 0
        new, to = new[ok], to[ok]
        by = np.argsort(to, kind="stable")
        new, to = new[by], to[by]
        who, start, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(who), BATCH):
            w, c, s = who[lo : lo + BATCH], count[lo : lo + BATCH], start[lo : lo + BATCH]
            more = np.full((len(w), int(c.max())), -1, np.int64)
            for i in range(len(w)):
                more[i, : c[i]] = new[s[i] : s[i] + c[i]]
            more[(more[:, :, None] == adjacent[w][:, None, :]).any(axis=2)] = -1
            ids = np.concatenate([adjacent[w], more], axis=1)
            sims = np.where(ids >= 0, _sims(self.x, np.maximum(ids, 0), self.x[w]), -np.inf)
            near = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * MOST]
            ids = np.take_along_axis(ids, near, 1)
            must = (ids >= 0) & (self.parent[ids] == w[:, None])
            adjacent[w] = choose(self.x, ids, np.take_along_axis(sims, near, 1), MOST, must)

    def _entry(self, q: np.ndarray, k: int, beam: int = 8) -> np.ndarray:
        """Points of layer k from which to search it: the best that the layers above find."""
        top = len(self.sizes) - 1
        if k >= top:
            return np.zeros((len(q), 1), np.int64)
        entry = np.zeros((len(q), 1), np.int64)
        for at in range(top, k, -1):
            entry, _ = search_layer(self.x[: self.sizes[at]], self.layers[at], q, entry, beam)
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (in the order of the points given to Graph) and similarities of the `beam` nearest found."""
        q = np.ascontiguousarray(q, np.float32)
        found, sims = search_layer(self.x, self.layers[0], q, self._entry(q, 0), min(beam, len(self.x)))
        return np.where(found >= 0, self.order[found], -1), sims
