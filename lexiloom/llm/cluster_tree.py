"""A tree of k-means clusters in numpy, searched best bin first by many queries in lock-step."""

from __future__ import annotations

import numpy as np

BRANCHES = 16
PASSES = 8
DEEPEST = 12
#: Components are cut to this size where the tree compares them, so that squares stay finite; distances of results are never cut.
TAME = 1e100


def _off(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres, but for each row's own square (which orders nothing)."""
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by k-means: first ones drawn by squared distance from those drawn before, then PASSES rounds."""
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(PASSES):
        at = _off(x, centres).argmin(axis=1)
        count = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        used = np.flatnonzero(count)
        centres = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[used])[:-1]]), axis=0) / count[used, None]
    return centres


class Tree:
    """Node 0 is the root; the children of a node follow each other. leaf: the number of a leaf, -1 for other nodes."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, children: np.ndarray, leaf: np.ndarray):
        self.centres, self.first, self.children, self.leaf = centres, first, children, leaf

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int, seed: int = 0) -> Tree:
        """A tree whose leaves hold at most about leaf_rows rows of the sample. Rows alike stay together."""
        rng = np.random.default_rng(seed)
        sample = np.clip(sample, -TAME, TAME)
        centres, first, children, leaf = [sample.mean(axis=0)], [0], [0], [-1]
        todo, leaves = [(0, np.arange(len(sample)), 0)], 0
        while todo:
            node, rows, depth = todo.pop(0)
            parts = np.zeros((0, 0))
            if len(rows) > leaf_rows and depth < DEEPEST:
                parts = _clusters(sample[rows], min(BRANCHES, max(2, -(-len(rows) // leaf_rows))), rng)
            if len(parts) < 2:
                leaf[node], leaves = leaves, leaves + 1
                continue
            first[node], children[node] = len(centres), len(parts)
            at = _off(sample[rows], parts).argmin(axis=1)
            for k, c in enumerate(parts):
                todo.append((len(centres), rows[at == k], depth + 1))
                centres.append(c)
                first.append(0)
                children.append(0)
                leaf.append(-1)
        return cls(np.array(centres), np.array(first), np.array(children), np.array(leaf))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node on the way down."""
        x = np.clip(x, -TAME, TAME)
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.leaf[node] < 0)
        while len(live):
            for u in np.unique(node[live]):
                rows = live[node[live] == u]
                lo = self.first[u]
                node[rows] = lo + _off(x[rows], self.centres[lo : lo + self.children[u]]).argmin(axis=1)
            live = live[self.leaf[node[live]] < 0]
        return self.leaf[node]

    def visits(self, q: np.ndarray, width: int, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of the leaves that each query visits: a priority queue of open nodes by their centres' distance; the best is
        taken, an inner one opens its children. A query ends after `width` leaves, but not before they hold `least` (held: by leaf)."""
        q = np.clip(q, -TAME, TAME)
        own = (q * q).sum(axis=1)
        queue = np.full((len(q), len(self.centres)), np.inf)
        queue[:, 0] = 0
        seen, have = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        live, out = np.arange(len(q)), []
        while len(live):
            node = queue[live].argmin(axis=1)
            some = queue[live, node] < np.inf
            live, node = live[some], node[some]
            queue[live, node] = np.inf
            leaf = self.leaf[node]
            end = leaf >= 0
            out.append(np.stack([live[end], leaf[end]]))
            seen[live[end]] += 1
            have[live[end]] += held[leaf[end]]
            for u in np.unique(node[~end]):
                rows = live[node == u]
                lo, hi = self.first[u], self.first[u] + self.children[u]
                queue[rows, lo:hi] = _off(q[rows], self.centres[lo:hi]) + own[rows, None]
            live = live[(seen[live] < width) | (have[live] < least)]
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return both[0], both[1]
