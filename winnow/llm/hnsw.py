"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches in numpy.

Nodes of the graph are centres. A vector whose nearest centre has a cosine of BUNDLE or more joins that
centre's bundle instead of becoming a node, so a crowd of near copies neither floods the graph nor cuts it
into islands. Every other vector draws a level and is linked on that level and all below, by beam search
from the entry point downwards and among the vectors of its own batch; of the candidates those are taken
first that are nearer to the new node than to any taken before (Malkov and Yashunin, 2016).

The beam used later is found by audit. Each centre has a reach, the least cosine at which a query must find
it. Queries are planted as far from known centres as their reach allows, all centres that reach a query are
found by comparing with every centre, and the beam is doubled until it finds AUDIT of them. A beam as wide
as the graph compares with every centre.
"""

from __future__ import annotations

import numpy as np

LINKS = 16  # of a new node; twice as many may lead to a node of level 0
BUILD_BEAM = 48
FIRST_BEAM = 8
EXPAND = 4  # candidates followed in one step
BATCH = 512
BUNDLE = 0.98
AUDITS = 256
AUDIT = 0.99


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 0) -> None:
        """`vectors` are of length one, in double precision."""
        self.vectors = vectors
        self.rng = np.random.default_rng(seed)
        n, dim = vectors.shape
        self.unit = np.zeros((n, dim), np.float32)  # of the centres, as they come
        self.row = np.zeros(n, np.int64)  # of `vectors`
        self.centre = np.full(n, -1, np.int64)  # of each vector
        self.level = np.zeros(n, np.int64)
        self.links: list[np.ndarray] = []
        self.count, self.entry = 0, -1
        at, size = 0, 1
        while at < n:
            self._insert(np.arange(at, min(n, at + size)))
            at += size
            size = min(BATCH, max(1, self.count))
        close = np.einsum("nd,nd->n", vectors, vectors[self.row[self.centre]])
        self.least = np.ones(self.count)  # cosine between a centre and its farthest member
        np.minimum.at(self.least, self.centre, close)

    def _insert(self, rows: np.ndarray) -> None:
        q = self.vectors[rows].astype(np.float32)
        level = (-np.log(1 - self.rng.random(len(rows))) / np.log(LINKS)).astype(np.int64)
        found = self._candidates(q, level)
        if found:
            best = found[0][0][:, 0]
            joins = np.einsum("nd,nd->n", self.vectors[rows], self.vectors[self.row[best]]) >= BUNDLE
            self.centre[rows[joins]] = best[joins]
        else:
            joins = np.zeros(len(rows), bool)
        free = np.flatnonzero(~joins)
        own = self.vectors[rows[free]]
        close = own @ own.T
        lead = np.full(len(free), -1)
        for i in range(len(free)):
            if lead[i] < 0:
                lead[(close[i] >= BUNDLE) & (lead < 0)] = i
                lead[i] = i
        chosen = np.flatnonzero(lead == np.arange(len(free)))
        fresh = self.count + np.arange(len(chosen))
        self.centre[rows[free]] = self.count + np.searchsorted(chosen, lead)
        self.row[fresh], self.unit[fresh] = rows[free[chosen]], q[free[chosen]]
        self.level[fresh] = level[free[chosen]]
        self.count += len(chosen)
        if not len(chosen):
            return
        top = len(self.links)
        while len(self.links) <= self.level[fresh].max():
            width = LINKS if self.links else 2 * LINKS
            self.links.append(np.full((len(self.unit), width), -1, np.int32))
        close = close[np.ix_(chosen, chosen)].astype(np.float32)
        np.fill_diagonal(close, -np.inf)
        for layer in range(len(self.links)):
            held = np.flatnonzero(self.level[fresh] >= layer)
            if not len(held):
                break
            near = close[np.ix_(held, held)]
            kept = min(len(held), BUILD_BEAM)
            order = np.argpartition(-near, kept - 1, 1)[:, :kept]
            ids, sims = fresh[held][order], np.take_along_axis(near, order, 1)
            if layer < top:
                ids = np.concatenate([ids, found[layer][0][free[chosen[held]]]], 1)
                sims = np.concatenate([sims, found[layer][1][free[chosen[held]]]], 1)
            self._link(layer, fresh[held], ids, sims)
        if self.entry < 0 or self.level[fresh].max() > self.level[self.entry]:
            self.entry = int(fresh[self.level[fresh].argmax()])

    def _link(self, layer: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        taken = self._select(ids, sims, LINKS)
        links = self.links[layer]
        links[nodes, : taken.shape[1]] = taken
        to, which = taken.reshape(-1), np.repeat(nodes, taken.shape[1])
        order = np.argsort(to, kind="stable")
        to, which = to[order], which[order]
        to, which = to[to >= 0], which[to >= 0]
        ends, first, n = np.unique(to, return_index=True, return_counts=True)
        if not len(ends):
            return
        more = np.full((len(ends), n.max()), -1)
        more[np.repeat(np.arange(len(ends)), n), np.arange(len(to)) - np.repeat(first, n)] = which
        every = np.concatenate([links[ends], more], 1)
        # A batch may hold both ends of a link.
        every = np.sort(every, 1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        near = np.einsum("nd,nkd->nk", self.unit[ends], self.unit[every])
        near[every < 0] = -np.inf
        full = self._select(every, near, links.shape[1])
        links[ends] = -1
        links[ends, : full.shape[1]] = full

    def _select(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """At most `limit` of each row's candidates, nearest first, those towards new directions before others."""
        kept = min(ids.shape[1], 4 * LINKS)
        order = np.argsort(-sims, 1, kind="stable")[:, :kept]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = np.isfinite(sims)
        if kept > limit:
            chosen, n = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                own = self.unit[ids[part]]
                mutual = own @ own.transpose(0, 2, 1)
                for j in range(kept):
                    nearest = np.where(chosen[part], mutual[:, j], -np.inf).max(1)
                    take = valid[part, j] & (n[part] < limit) & (nearest < sims[part, j])
                    chosen[part, j] = take
                    n[part] += take
            rank = np.where(valid, sims + 4 * chosen, -np.inf)
            order = np.argsort(-rank, 1, kind="stable")[:, :limit]
            ids, valid = np.take_along_axis(ids, order, 1), np.take_along_axis(valid, order, 1)
        return np.where(valid, ids, -1)

    def _candidates(self, q: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level, (centres, cosines) of each row of `q` that belongs on it, nearest first."""
        found = []
        entries = np.full((len(q), 1), self.entry)
        for layer in reversed(range(len(self.links))):
            ids = np.full((len(q), BUILD_BEAM), -1)
            sims = np.full((len(q), BUILD_BEAM), -np.inf, np.float32)
            own = np.flatnonzero(level >= layer)
            if len(own):
                ids[own], sims[own] = self._beam(q[own], entries[own], layer, BUILD_BEAM)
            found.append((ids, sims))
            if layer:
                entries = self._beam(q, entries, layer, EXPAND)[0]
        return found[::-1]

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centres, cosines) of the beam on the lowest level, nearest first."""
        entries = np.full((len(q), 1), self.entry)
        for layer in reversed(range(1, len(self.links))):
            entries = self._beam(q, entries, layer, EXPAND)[0]
        return self._beam(q, entries, 0, beam)

    def _beam(self, q: np.ndarray, entries: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, links = len(q), self.links[layer]
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf, np.float32)
        k = min(width, entries.shape[1])
        entries = entries[:, :k]
        ids[:, :k] = entries
        sims[:, :k] = np.where(entries >= 0, np.einsum("nd,nkd->nk", q, self.unit[entries]), -np.inf)
        seen = np.zeros(n * self.count, bool)
        seen[(np.arange(n)[:, None] * self.count + entries)[entries >= 0]] = True
        todo = np.isfinite(sims)
        worst = sims.min(1)
        k = min(EXPAND, width)
        rows = np.arange(n)
        while len(rows):
            score = np.where(todo[rows], sims[rows], -np.inf)
            pick = np.argpartition(-score, k - 1, 1)[:, :k]
            ok = np.isfinite(np.take_along_axis(score, pick, 1))
            going = ok.any(1)
            rows, pick, ok = rows[going], pick[going], ok[going]
            if not len(rows):
                break
            todo[rows[:, None], pick] = False
            near = links[ids[rows[:, None], pick]]
            near[~ok] = -1
            near = near.reshape(len(rows), -1)
            key = (near + (rows * self.count)[:, None])[near >= 0]
            key = np.sort(key[~seen[key]])
            key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
            seen[key] = True
            r, v = np.divmod(key, self.count)
            s = np.einsum("nd,nd->n", q[r], self.unit[v])
            better = s > worst[r]
            r, v, s = r[better], v[better], s[better]
            if not len(r):
                continue
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            own, times = r[first], np.diff(np.append(first, len(r)))
            at = np.repeat(np.arange(len(own)), times), np.arange(len(r)) - np.repeat(first, times)
            new_ids = np.full((len(own), times.max()), -1)
            new_sims = np.full(new_ids.shape, -np.inf, np.float32)
            new_ids[at], new_sims[at] = v, s
            all_sims = np.concatenate([sims[own], new_sims], 1)
            order = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            sims[own] = np.take_along_axis(all_sims, order, 1)
            ids[own] = np.take_along_axis(np.concatenate([ids[own], new_ids], 1), order, 1)
            todo[own] = np.take_along_axis(np.concatenate([todo[own], np.isfinite(new_sims)], 1), order, 1)
            worst[own] = sims[own].min(1)
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def within(self, q: np.ndarray, reach: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, centre) of the centres found with a cosine of their `reach` or more.

        Where every place of a query's beam is within the widest reach there may be more: it is searched
        again with twice the beam, up to all centres.
        """
        q, reach = q.astype(np.float32), reach.astype(np.float32)
        widest = reach.min()
        queries, centres = [], []
        for at in range(0, len(q), BATCH):
            rows, width = np.arange(at, min(len(q), at + BATCH)), beam
            while len(rows):
                if width >= self.count:
                    r, c = np.nonzero(q[rows] @ self.unit[: self.count].T >= reach)
                    open_ = np.zeros(len(rows), bool)
                else:
                    ids, sims = self._search(q[rows], width)
                    open_ = sims[:, -1] >= widest
                    r, c = np.nonzero((sims >= reach[ids]) & ~open_[:, None])
                    c = ids[r, c]
                queries.append(rows[r])
                centres.append(c)
                rows, width = rows[open_], 2 * width
        return np.concatenate([np.zeros(0, np.int64), *queries]), np.concatenate([np.zeros(0, np.int64), *centres])

    def audited_beam(self, reach: np.ndarray) -> int:
        """The narrowest beam, FIRST_BEAM doubled, that passes the audit.

        A quarter of the queries is planted by centres of wider reach than the others have, if there are any.
        """
        order = self.rng.permutation(self.count)
        wide = order[reach[order] < reach.max()]
        chosen = np.unique(np.concatenate([wide[: AUDITS // 4], order[:AUDITS]]))
        known, away = self.unit[chosen].astype(np.float64), self.rng.standard_normal((len(chosen), self.unit.shape[1]))
        away -= known * np.einsum("nd,nd->n", away, known)[:, None]
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
        least = reach[chosen][:, None] + 1e-6
        q = (known * least + away * np.sqrt(np.maximum(0, 1 - least * least))).astype(np.float32)
        true = (q @ self.unit[: self.count].T) >= reach.astype(np.float32)
        beam = FIRST_BEAM
        while beam < self.count:
            hit, centre = self.within(q, reach, beam)
            if true[hit, centre].sum() >= AUDIT * true.sum():
                break
            beam *= 2
        return beam
