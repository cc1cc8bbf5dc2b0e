"""A robust-pruned directed graph over one shard of vectors, all steps on many vectors at once.

Similarity is the inner product of vectors of equal norm, so the most similar is the nearest.
"""

from __future__ import annotations

import numpy as np

DEGREE, WIDTH, RELAXED = 40, 80, 1.2
BATCH, FIRST = 1024, 256


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nodes (-1: none) found nearest to every query, in no order, and their similarities.

    Every query keeps a beam; in each step it follows the edges of its best node not yet followed.
    """
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, width + edges.shape[1]), -1, np.int64)
    sims = np.full(ids.shape, -np.inf, np.float32)
    done = np.zeros(ids.shape, bool)
    k = min(len(starts), width)
    ids[:, :k], seen[:, starts[:k]] = starts[:k], True
    sims[:, :k] = queries @ x[starts[:k]].T
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live, :width], -np.inf, sims[live, :width])
        best = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        near = edges[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, column = np.nonzero(fresh)
        seen[live[row], near[row, column]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[row, column] = np.einsum("ij,ij->i", x[near[row, column]], queries[live[row]])
        sims[live, width:], ids[live, width:], done[live, width:] = new, np.where(fresh, near, -1), False
        order = np.argpartition(-sims[live], width - 1, axis=1)[:, :width]
        for a in (sims, ids, done):
            a[live, :width] = np.take_along_axis(a[live], order, axis=1)
    return ids[:, :width], sims[:, :width]


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int, norm: float) -> np.ndarray:
    """Of each point's candidates (-1: none) at most ``degree``: the nearest one stays and takes away
    those that are nearer to it, by the factor ``RELAXED``, than to the point; and so on."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
    vectors = x[np.maximum(candidates, 0)]
    among = np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
    own, between = 2 * norm - 2 * sims, 2 * norm - 2 * among  # squared distances
    alive = (candidates >= 0) & (candidates != points[:, None])
    out = np.full((len(points), degree), -1, np.int64)
    count, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for k in range(candidates.shape[1]):
        take = alive[:, k] & (count < degree)
        out[rows[take], count[take]] = candidates[take, k]
        count += take
        alive &= ~take[:, None] | (RELAXED**2 * between[:, k, :] > own)
    return out


def build(x: np.ndarray, degree: int = DEGREE, width: int = WIDTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) of every vector, and the nodes where searches start. Vectors are distinct."""
    n = len(x)
    norm = float((x[0].astype(np.float64) ** 2).sum()) if n else 0.0
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    first = order[: min(FIRST, n)]
    if n > 1:
        sims = x[first] @ x[first].T
        edges[first] = prune(x, first, np.broadcast_to(first, sims.shape).copy(), sims, degree, norm)
    middle = int((x @ x.mean(axis=0)).argmax()) if n else 0
    starts = first[:8]
    at = len(first)
    while at < n:
        size = min(BATCH, at, n - at)
        batch = order[at : at + size]
        at += size
        found, sims = beam_search(x, edges, starts, x[batch], width)
        edges[batch] = prune(x, batch, found, sims, degree, norm)
        _back(x, edges, batch, degree, norm)
    return edges, np.unique(np.append(starts, middle)) if n else starts


def _back(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, norm: float) -> None:
    """Edges in the other direction; a node with too many is pruned."""
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    keep = target >= 0
    source, target = source[keep], target[keep]
    sims = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, "left")
    near = place < degree  # of very many new ones the nearest; the others keep their own edge
    source, target, place = source[near], target[near], place[near]
    nodes, row = np.unique(target, return_inverse=True)
    more = np.full((len(nodes), int(place.max()) + 1 if len(place) else 1), -1, np.int64)
    more[row, place] = source
    for a in range(0, len(nodes), BATCH):
        some = nodes[a : a + BATCH]
        both = np.concatenate([edges[some], more[a : a + BATCH]], axis=1)
        width = max(degree, int((both >= 0).sum(axis=1).max()))
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable")[:, :width], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        edges[some[~full]] = both[~full, :degree]
        if full.any():
            sims = np.where(both[full] >= 0, np.einsum("bjd,bd->bj", x[np.maximum(both[full], 0)], x[some[full]]), -np.inf)
            edges[some[full]] = prune(x, some[full], both[full], sims.astype(np.float32), degree, norm)
