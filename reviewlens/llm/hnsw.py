"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Nodes stand in order of their level, highest first, so every layer is a prefix of the nodes. Queries and
insertions advance in step: each round expands the best open candidates of all queries of a block at once.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

_BLOCK = 512
_AT_ONCE = 4
# Wider beams cost more than comparing a query with all nodes of a shard.
_WIDEST = 64


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled by the largest entry first, so squares stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _distinct_in_rows(ids: np.ndarray) -> np.ndarray:
    """Each row sorted, repeats replaced by -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


@dataclass
class Graph:
    """``layers[l][i]`` are the neighbours of node ``i`` in layer ``l``, padded with -1; layer 0 holds all nodes."""

    vectors: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    degree: int = 12
    beam: int = 32
    seed: int = 7
    order: np.ndarray | None = None

    @classmethod
    def build(cls, unit: np.ndarray, **options) -> Graph:
        """Graph of the rows of ``unit``; ``order`` says which row each node is."""
        graph = cls(np.empty((0, unit.shape[1]), np.float32), **options)
        draws = np.random.default_rng(graph.seed).random(len(unit))
        levels = np.floor(-np.log(1 - draws) / np.log(graph.degree)).astype(int)
        graph.order = np.argsort(-levels, kind="stable")
        graph.vectors = unit[graph.order].astype(np.float32)
        tallest = int(levels.max(initial=0))
        sizes = [int((levels >= level).sum()) for level in range(tallest + 1)]
        graph.layers = [np.full((size, graph._width(level)), -1, np.int32) for level, size in enumerate(sizes)]
        for level in range(tallest, -1, -1):
            graph._fill(level)
        return graph

    def _width(self, level: int) -> int:
        return self.degree * (2 if level == 0 else 1)

    def _fill(self, level: int) -> None:
        """Insert a layer's nodes in blocks: candidates come from the layer so far and from the block itself."""
        size, start = len(self.layers[level]), 0
        while start < size:
            stop = min(size, start + _BLOCK)
            block = np.arange(start, stop)
            vectors = self.vectors[block]
            near = vectors @ vectors.T
            np.fill_diagonal(near, -np.inf)
            k = min(len(block), self.beam)
            own = np.argpartition(-near, k - 1, axis=1)[:, :k].astype(np.int32)
            ids = np.where(np.take_along_axis(near, own, 1) > -np.inf, own + start, -1)
            if start:
                found, _ = self._search_layer(vectors, self._entries(vectors, level, start), level, self.beam, start)
                ids = np.concatenate([found, ids], axis=1)
            chosen = self._select(block, ids, self.degree)
            self.layers[level][start:stop, : chosen.shape[1]] = chosen
            self._link_back(level, block, chosen)
            start = stop

    def _entries(self, queries: np.ndarray, level: int, filled: int | None = None) -> np.ndarray:
        """Nodes to start from in a layer: what the layers above find, or the first nodes."""
        entries = np.zeros((len(queries), 1), np.int32)
        for above in range(len(self.layers) - 1, level, -1):
            entries, _ = self._search_layer(queries, entries, above, 4, len(self.layers[above]))
        return np.where(entries < (filled or len(self.vectors)), entries, -1)

    def _search_layer(self, queries: np.ndarray, entries: np.ndarray, level: int, beam: int, filled: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes of a layer per query, best first, and their similarities; -1 pads."""
        n, links = len(queries), self.layers[level]
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, filled + 1), bool)  # the last column takes the padding
        rows = np.arange(n)
        fresh = _distinct_in_rows(entries.copy())
        while len(rows):
            valid = (fresh >= 0) & (fresh < filled)
            at = np.where(valid, fresh, filled)
            valid &= ~seen[rows[:, None], at]
            seen[rows[:, None], at] = True
            safe = np.where(valid, fresh, 0)
            gained = np.einsum("rkd,rd->rk", self.vectors[safe], queries[rows], optimize=False)
            gained = np.where(valid, gained, -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[rows], np.where(valid, fresh, -1)], axis=1)
            all_sims = np.concatenate([sims[rows], gained], axis=1)
            all_open = np.concatenate([open_[rows], valid], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1)
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                break
            # The first few open candidates of every query are expanded together.
            ranks = np.where(open_[rows], np.arange(beam)[None, :], beam)
            ordered = np.sort(ranks, axis=1)[:, :_AT_ONCE]
            taken = ordered < beam
            first = np.where(taken, ordered, 0)
            expand = np.where(taken, np.take_along_axis(ids[rows], first, 1), -1)
            open_[rows] &= ranks > ordered[:, -1:]
            fresh = np.where((expand >= 0)[:, :, None], links[np.where(expand >= 0, expand, 0)], -1)
            fresh = _distinct_in_rows(fresh.reshape(len(rows), -1))
        return ids, sims

    def _select(self, nodes: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of candidate neighbours, best first, those nearer to the node than to any chosen one; then the best of the rest."""
        safe = np.where(ids >= 0, ids, 0)
        sims = np.einsum("rkd,rd->rk", self.vectors[safe], self.vectors[nodes])
        sims = np.where(ids >= 0, sims, -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        points = self.vectors[np.where(ids >= 0, ids, 0)]
        among = np.matmul(points, points.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            close = np.where(chosen, among[:, k, :], -np.inf).max(axis=1)
            chosen[:, k] = (ids[:, k] >= 0) & (close < sims[:, k]) & (chosen.sum(axis=1) < most)
        # Chosen ones first, then fill up in order.
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, keep, 1)

    def _link_back(self, level: int, block: np.ndarray, chosen: np.ndarray) -> None:
        links, width = self.layers[level], self._width(level)
        source = np.repeat(block, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), _BLOCK):
            own, begin, count = nodes[at : at + _BLOCK], first[at : at + _BLOCK], counts[at : at + _BLOCK]
            room = min(int(count.max()), 4 * width)
            slots = np.arange(room)[None, :]
            places = np.minimum(begin[:, None] + slots, len(source) - 1)
            new = np.where(slots < np.minimum(count, room)[:, None], source[places], -1)
            together = _distinct_in_rows(np.concatenate([links[own], new], axis=1).astype(np.int32))
            most = int((together >= 0).sum(axis=1).max())
            if most <= width:
                kept = np.sort(together, axis=1)[:, ::-1][:, :width]
            else:
                kept = self._select(own, np.sort(together, axis=1)[:, ::-1][:, :most], width)
            links[own] = -1
            links[own, : kept.shape[1]] = kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the built vectors and similarities of the ``beam`` nearest per query; -1 pads."""
        beam = min(beam, len(self.vectors))
        ids, sims = self._search_layer(queries, self._entries(queries, 0), 0, beam, len(self.vectors))
        return np.where(ids >= 0, self.order[ids], -1), sims

    def _holds_all(self, beam: int) -> bool:
        return beam > _WIDEST or beam * 4 > len(self.vectors)

    def within(self, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Boolean matrix, query by built row: found with similarity of at least ``least``.

        A beam whose last place still is that similar may have missed some and is widened fourfold; beyond
        ``_WIDEST`` or a quarter of the nodes it holds all of them: the query is compared with each.
        """
        hits = np.zeros((len(queries), len(self.vectors)), bool)
        left = np.arange(len(queries))
        while len(left):
            full = self._holds_all(beam)
            again = []
            for at in range(0, len(left), _BLOCK):
                rows = left[at : at + _BLOCK]
                if full:
                    inside = np.zeros((len(rows), len(self.vectors)), bool)
                    inside[:, self.order] = queries[rows] @ self.vectors.T >= least
                    hits[rows] = inside
                    continue
                ids, sims = self.search(queries[rows], beam)
                r, k = np.nonzero((sims >= least) & (ids >= 0))
                hits[rows[r], ids[r, k]] = True
                again.append(rows[sims[:, -1] >= least])
            left, beam = np.concatenate(again) if again else left[:0], beam * 4
        return hits

    def audited_beam(self, least: float, recall: float = 0.99, beam: int = 16, probes: int = 256) -> tuple[int, float]:
        """The smallest tried beam whose recall of neighbours passes, and that recall.

        Probes are nodes, and nodes moved as far away as a neighbour may be; the truth is an exhaustive
        comparison. The beam doubles until the audit passes or it holds all nodes.
        """
        rng = np.random.default_rng(self.seed)
        some = rng.choice(len(self.vectors), size=min(probes, len(self.vectors)), replace=False)
        points = self.vectors[np.sort(some)].astype(np.float64)
        noise = rng.normal(size=points.shape)
        noise -= (noise * points).sum(axis=1, keepdims=True) * points
        noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
        reach = min(1.0, least + 0.002)
        moved = reach * points + np.sqrt(1 - reach**2) * noise
        queries = np.concatenate([points, moved]).astype(np.float32)
        truth = np.zeros((len(queries), len(self.vectors)), bool)
        truth[:, self.order] = queries @ self.vectors.T >= least
        while True:
            found = (self.within(queries, least, beam) & truth).sum() / max(1, truth.sum())
            if found >= recall or self._holds_all(beam):
                return beam, float(found)
            beam *= 2

    def to_bytes(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        layers = {f"layer{i}": layer for i, layer in enumerate(self.layers)}
        np.savez(out, vectors=self.vectors, order=self.order, **layers, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as stored:
            parts = {name: stored[name] for name in stored.files}
        layers = [parts.pop(f"layer{i}") for i in range(sum(name.startswith("layer") for name in parts))]
        return cls(parts.pop("vectors"), layers, order=parts.pop("order")), parts
