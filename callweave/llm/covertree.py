"""Dual-tree search of the highest inner products over cover trees.

A tree's node has a centre (one of its points) and a covering radius (the largest distance
of its points from the centre). Its children are a net: centres are picked farthest
first, so they lie at least as far apart as any point is from its centre, and every point
goes to its nearest centre. A net that does not part its points (most fall to one centre)
is replaced by shells of that centre, so the depth stays logarithmic.

Two nodes with centres c and e and radii r and s hold no pair with an inner product above
<c, e> + r |e| + s |c| + r s. A pair of nodes is pruned if that is below the worst k-th score
of the query node's queries. Below a leaf of the query tree stand its queries, nodes of radius
0; those that stay meet a leaf of the data as a block, exactly.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 64, 16
#: a child with more than this share of its parent's points is cut into shells
MOST = 0.75
#: float bounds are widened by this share of the sizes that enter them
ROUNDING = 1e-9
NONE = np.iinfo(np.int64).max


class Node:
    __slots__ = ("centre", "radius", "members", "children", "size")

    def __init__(self, points: np.ndarray, centre: int, members: np.ndarray, radius: float):
        self.centre, self.radius, self.members, self.children = centre, radius, members, []
        self.size = float(np.linalg.norm(points[centre]))


def grow(points: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF, fan: int = FAN) -> Node:
    """The tree of (some of) the points."""
    members = np.arange(len(points)) if members is None else members
    far = np.linalg.norm(points[members] - points[members[0]], axis=1)
    root = Node(points, int(members[0]), members, float(far.max()))
    todo = [(root, far)]
    while todo:
        node, far = todo.pop()
        members = node.members
        if len(members) <= leaf or node.radius == 0:
            continue
        owner, near, picks = np.zeros(len(members), np.int64), far.copy(), [node.centre]
        while len(picks) < fan and near.max() > 0:
            pick = int(members[near.argmax()])
            other = np.linalg.norm(points[members] - points[pick], axis=1)
            owner[other < near] = len(picks)
            near = np.minimum(near, other)
            picks.append(pick)
        for c, pick in enumerate(picks):
            mine = np.flatnonzero(owner == c)
            if len(mine) > MOST * len(members):
                mine = mine[np.argsort(near[mine], kind="stable")]
                for a in range(0, len(mine), leaf):
                    shell = mine[a:a + leaf]
                    node.children.append(Node(points, pick, members[shell], float(near[shell].max())))
            elif len(mine):
                child = Node(points, pick, members[mine], float(near[mine].max()))
                node.children.append(child)
                todo.append((child, near[mine]))
    return root


class Search:
    """The k best data rows of each query: data vectors stand for rows of several ids."""

    def __init__(self, data: np.ndarray, ids: list[np.ndarray], k: int):
        self.k, self.data, self.ids = k, data, ids
        self.low = np.array([i[0] for i in ids], np.int64)
        self.points = data.astype(float)
        self.tree = grow(self.points)
        self.size = int(np.abs(data).max()) if data.size else 0
        self.met = 0  # pairs of points that leaves compared

    def top(self, queries: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the k best data vectors of each query, by score and then lowest id; place -1:
        none. Only scores of at least the query's floor are sure to be there."""
        n, d = queries.shape
        bound = d * self.size * (int(np.abs(queries).max()) if queries.size else 0)
        kind = float if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object
        self.q, self.x = queries.astype(kind), self.data.astype(kind)
        self.score, self.place = np.full((n, self.k), 0, kind), np.full((n, self.k), -1, np.int64)
        self.floor = floors.astype(float) if kind is float else floors.astype(object)
        # a full list's last score, else the floor
        self.worst = self.floor.copy()
        points = queries.astype(float)
        self._descend(points, grow(points), self.tree)
        return self.score, self.place

    def _above(self, points: np.ndarray, a: Node, b: Node) -> float:
        """What no pair of the nodes' points exceeds."""
        reach = a.radius * b.size + b.radius * a.size + a.radius * b.radius
        return float(points[a.centre] @ self.points[b.centre]) + reach + ROUNDING * ((a.size + a.radius) * (b.size + b.radius) + 1)

    def _still(self, points: np.ndarray, asked: np.ndarray, b: Node) -> np.ndarray:
        """The queries, each a node of radius 0, that the pair with b does not prune."""
        sizes = self.sizes[asked]
        above = points[asked] @ self.points[b.centre] + b.radius * sizes + ROUNDING * (sizes * (b.size + b.radius) + 1)
        return asked[(above >= self.worst[asked]).astype(bool)]

    def _descend(self, points: np.ndarray, root: Node, tree: Node) -> None:
        self.sizes = np.linalg.norm(points, axis=1)
        todo = [(self._above(points, root, tree), root, tree, root.members)]
        while todo:
            above, a, b, asked = todo.pop()
            if above < self.worst[asked].min():
                continue
            if not a.children:  # below a leaf stand its queries
                asked = self._still(points, asked, b)
                if not len(asked):
                    continue
                if not b.children:
                    self._meet(asked, b.members)
                    continue
            split_a = bool(a.children) and (not b.children or a.radius > b.radius)
            pairs = [(c, b, c.members) for c in a.children] if split_a else [(a, c, asked) for c in b.children]
            # the most promising pair is on top of the stack
            todo.extend(sorted(((self._above(points, c, e), c, e, m) for c, e, m in pairs), key=lambda t: t[0]))

    def _meet(self, asked: np.ndarray, members: np.ndarray) -> None:
        self.met += len(asked) * len(members)
        found = self.q[asked] @ self.x[members].T
        some = np.flatnonzero((found >= self.worst[asked][:, None]).any(axis=1))
        if not len(some):
            return
        rows = asked[some]
        score = np.concatenate([self.score[rows], found[some]], axis=1)
        place = np.concatenate([self.place[rows], np.broadcast_to(members, (len(rows), len(members)))], axis=1)
        low = np.where(place < 0, NONE, self.low[place])
        if score.dtype == object:
            order = np.array([sorted(range(score.shape[1]), key=lambda c: (p[c] < 0, -s[c], i[c])) for s, p, i in zip(score, place, low)])
        else:
            order = np.lexsort((low, -score, place < 0), axis=1)
        order = order[:, :self.k]
        score, place = np.take_along_axis(score, order, axis=1), np.take_along_axis(place, order, axis=1)
        self.score[rows], self.place[rows] = score, place
        self.worst[rows] = np.where(place[:, -1] < 0, self.floor[rows], np.maximum(self.floor[rows], score[:, -1]))
