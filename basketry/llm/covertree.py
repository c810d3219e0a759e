"""Cover trees for inner products: points, covering radii and best-first search, as numpy arrays of one block.

A point ``x`` gets one more coordinate, the root of ``reach**2 - |x|**2``, so that all points have the same
length ``reach`` and the distance to a query ``q`` (whose extra coordinate is zero) says the inner product:
``d**2 = |q|**2 + reach**2 - 2 q.x``. A node has a centre, which is one of its points, and a covering radius
``r``; all its points lie within ``d - r`` and ``d + r`` of the query, which bounds their inner products on both
sides. The centres below a node are at least half its radius apart and cover its points within that.

Points that would make a node of their own with fewer than ``LEAF`` points stay with the node above and are
verified when it is opened.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LEAF = 8
SMALL_NODE = 48
# Nodes opened for a query between two rounds of pruning.
WAVE = 8
# Room for rounding in a bound, as a share of the squared lengths it is made of.
ROUNDING = 1e-9


def narrowest(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them, as float64 if none does."""
    most = float(np.abs(values).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    return values.astype(kind)


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


@dataclass
class Tree:
    """Points in tree order and, per node, the range of its own points, its centre, radius and children."""

    points: np.ndarray  # n x d whole numbers
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    own_from: np.ndarray
    own_to: np.ndarray
    centre: np.ndarray  # place of a point
    radius: np.ndarray
    child_from: np.ndarray  # children of a node are neighbours in the node arrays
    child_to: np.ndarray
    reach: float

    def to_bytes(self) -> bytes:
        arrays = {k: v for k, v in vars(self).items() if k not in ("points", "reach")}
        return packed(points=narrowest(self.points), reach=np.array(self.reach), **arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        arrays = unpacked(data)
        arrays["points"] = arrays["points"].astype(np.float64)
        return cls(**arrays | {"reach": float(arrays["reach"])})


def built(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, reach: float) -> Tree:
    """The cover tree of a block. Own points of a node are in the order of ids, equal ids in that of rows."""
    sequence = np.lexsort((rows, ids))
    points, ids, rows, labels = points[sequence], ids[sequence], rows[sequence], labels[sequence]
    extra = np.sqrt(np.maximum(0.0, reach * reach - np.einsum("ij,ij->i", points, points)))
    lifted = np.column_stack((points, extra))

    def away(members: np.ndarray, centre: int) -> np.ndarray:
        gap = lifted[members] - lifted[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    every = np.arange(len(points))
    nodes: list[list] = [[None, 0, 0.0, 0, 0]]  # own points, centre, radius, first child, child after the last
    waiting = [(0, every, 0)]
    while waiting:
        number, members, centre = waiting.pop()
        near = away(members, centre)
        radius = float(near.max(initial=0.0))
        nodes[number][1:3] = centre, radius
        if len(members) <= SMALL_NODE or radius == 0.0:
            nodes[number][0] = members
            continue
        # the farthest point becomes a centre until all points are within half the radius of one
        owner = np.zeros(len(members), np.int64)
        centres = [centre]
        while True:
            far = int(near.argmax())
            if near[far] <= radius / 2:
                break
            gap = away(members, members[far])
            closer = gap < near
            owner[closer] = len(centres)
            near = np.where(closer, gap, near)
            centres.append(int(members[far]))
        counts = np.bincount(owner, minlength=len(centres))
        kept = np.flatnonzero(counts >= LEAF)
        nodes[number][0] = members[counts[owner] < LEAF]
        nodes[number][3:5] = len(nodes), len(nodes) + len(kept)
        for k in kept.tolist():
            waiting.append((len(nodes), members[owner == k], centres[k]))
            nodes.append([None, 0, 0.0, 0, 0])
    own = [n[0] for n in nodes]
    order = np.concatenate(own)
    place = np.empty(len(order), np.int64)
    place[order] = every
    ends = np.cumsum([len(o) for o in own])
    return Tree(
        points[order],
        ids[order],
        rows[order],
        labels[order],
        ends - [len(o) for o in own],
        ends,
        place[[n[1] for n in nodes]],
        np.array([n[2] for n in nodes]),
        np.array([n[3] for n in nodes]),
        np.array([n[4] for n in nodes]),
        float(reach),
    )


def _first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries of each row; of equal ones the leftmost."""
    width = scores.shape[1]
    if width > k:
        finite = np.isfinite(scores)
        if np.abs(scores, where=finite, out=np.zeros_like(scores)).max(initial=0) * width < 2**52:
            columns = np.argpartition(np.arange(width) - scores * width, k - 1, axis=1)[:, :k]
        else:
            columns = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    else:
        columns = np.broadcast_to(np.arange(width), scores.shape)
    lines = np.broadcast_to(np.arange(len(scores))[:, None], columns.shape)
    taken = np.isfinite(scores[lines, columns])
    return lines[taken], columns[taken]


class Search:
    """The best ``k`` points of a tree in each window of inner products, for a block of queries.

    ``low`` and ``high`` (queries x windows, both ends included) say the windows; an empty one has low above high.
    Points count whose label equals that of the query (``same``) or differs from it; a query's own row does not.
    ``least`` (of the shape of ``low``) says scores below which a point is of no use, for what other trees have.
    """

    def __init__(
        self, tree: Tree, queries: np.ndarray, rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int,
        least: np.ndarray | None = None,
    ):
        self.tree, self.queries, self.rows, self.labels = tree, queries, rows, labels
        self.low, self.high, self.same, self.k = low, high, same, k
        self.lengths = np.einsum("ij,ij->i", queries, queries)
        # what a point must reach to count: the foot of the window, then the k-th best so far
        self.least = np.where(low <= high, low if least is None else np.maximum(low, least), np.inf)
        self.found = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64)]  # query and window, score, point

    def _useful(self, query: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """For bounds of shape (queries, nodes): can any window of the query still gain from the node?"""
        least, high = self.least[query], self.high[query]
        useful = np.zeros(upper.shape, bool)
        for w in range(least.shape[1]):
            useful |= (upper >= least[:, w, None]) & (lower <= high[:, w, None])
        return useful

    def _bounds(self, query: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree = self.tree
        total = self.lengths[query][:, None] + tree.reach**2
        product = self.queries[query] @ tree.points[tree.centre[nodes]].T
        away = np.sqrt(np.maximum(0.0, total - 2 * product))
        slack = ROUNDING * total
        radius = tree.radius[nodes][None, :]
        return (
            (total - np.maximum(0.0, away - radius) ** 2) / 2 + slack,
            (total - (away + radius) ** 2) / 2 - slack,
        )

    def _verify(self, query: np.ndarray, node: int) -> None:
        tree = self.tree
        own = slice(tree.own_from[node], tree.own_to[node])
        if own.start == own.stop:
            return
        scores = self.queries[query] @ tree.points[own].T
        allowed = (tree.labels[own][None, :] == self.labels[query][:, None]) == self.same
        allowed &= tree.rows[own][None, :] != self.rows[query][:, None]
        windows = self.low.shape[1]
        for w in range(windows):
            inside = allowed & (scores >= self.least[query, w][:, None]) & (scores <= self.high[query, w][:, None])
            if not inside.any():
                continue
            line, column = _first(np.where(inside, scores, -np.inf), self.k)
            new = (query[line] * windows + w, scores[line, column], own.start + column)
            self.found = [np.concatenate(pair) for pair in zip(self.found, new)]

    def _settle(self) -> None:
        """Keep the k best per query and window, and raise what a point must reach."""
        key, score, point = self.found
        order = np.lexsort((self.tree.rows[point], self.tree.ids[point], -score, key))
        key, score, point = key[order], score[order], point[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        last = rank == self.k - 1
        self.least.reshape(-1)[key[last]] = score[last]
        kept = rank < self.k
        self.found = [key[kept], score[kept], point[kept]]

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, score, place of the point) of all results."""
        tree, everyone = self.tree, np.arange(len(self.queries))
        upper, lower = self._bounds(everyone, np.zeros(1, np.int64))
        query = everyone[self._useful(everyone, upper, lower)[:, 0]]
        front = [query, np.zeros(len(query), np.int64), upper[query, 0], lower[query, 0]]
        while len(front[0]):
            query, node, upper, lower = front
            alive = self._useful(query, upper[:, None], lower[:, None])[:, 0]
            order = np.lexsort((-upper[alive], query[alive]))
            query, node, upper, lower = (x[alive][order] for x in front)
            if not len(query):
                break
            start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
            opened = rank < WAVE
            rest = [x[~opened] for x in (query, node, upper, lower)]
            query, node = query[opened], node[opened]
            by_node = np.argsort(node, kind="stable")
            query, node = query[by_node], node[by_node]
            below = []
            for number, who in zip(*_groups(node, query)):
                self._verify(who, number)
                children = np.arange(tree.child_from[number], tree.child_to[number])
                if len(children):
                    up, low = self._bounds(who, children)
                    line, column = np.nonzero(self._useful(who, up, low))
                    below.append((who[line], children[column], up[line, column], low[line, column]))
            self._settle()
            front = [np.concatenate(x) for x in zip(rest, *below)]
        key, score, point = self.found
        windows = self.low.shape[1]
        return key // windows, key % windows, score, point


def _groups(key: np.ndarray, value: np.ndarray) -> tuple[list, list]:
    cuts = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate(([0], cuts))].tolist(), np.split(value, cuts)


def best_of(
    trees: list[Tree], queries: np.ndarray, rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int
) -> tuple[np.ndarray, ...]:
    """(query, window, score, row, id) of the best ``k`` points of all ``trees`` in each window, arguments as for ``Search``.

    What the trees before have bounds the search in the next. Of equal scores the smaller ids stay, then the smaller rows.
    """
    windows = low.shape[1]
    least = np.full(low.shape, -np.inf)
    found = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64, np.int64)]  # query and window, score, row, id
    for tree in trees:
        query, window, score, point = Search(tree, queries, rows, labels, low, high, same, k, least).run()
        new = (query * windows + window, score, tree.rows[point], tree.ids[point])
        key, score, row, number = (np.concatenate(pair) for pair in zip(found, new))
        order = np.lexsort((row, number, -score, key))
        key, score, row, number = (x[order] for x in (key, score, row, number))
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        least.reshape(-1)[key[rank == k - 1]] = score[rank == k - 1]
        found = [x[rank < k] for x in (key, score, row, number)]
    key, score, row, number = found
    return key // windows, key % windows, score, row, number
