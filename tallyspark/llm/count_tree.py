"""R-trees over count vectors: which sets can share enough elements, told without the sets.

The point of a set has its number of elements by hash residue. The number of residues (axes) grows with the
set, to about FILL elements an axis, so the bound stays as sharp for long texts as for short ones. Axes are powers
of two: a point is folded to fewer axes by adding up its parts, which is how sets of unlike sizes compare.

Two sets share at most the sum of the minima of their coordinates; all sets below two nodes share at most
the sum of the minima of the nodes' upper corners. Trees are joined from their roots: a pair of nodes whose bound
is too low for their sizes ends there, with all pairs below it.
"""

from __future__ import annotations

import numpy as np

FAN = 16
LEAST_AXES = 64
FILL = 2
#: Coordinates compared at once.
STEP = 1 << 22
KINDS = (np.uint8, np.uint16, np.uint32)


def axes(n: int) -> int:
    """The smallest power of two that leaves at most FILL elements an axis, at least LEAST_AXES."""
    return max(LEAST_AXES, 1 << max(0, -(-n // FILL) - 1).bit_length())


def point(s: np.ndarray) -> np.ndarray:
    """The count vector of a set of 64-bit hashes."""
    k = axes(len(s))
    return np.bincount((s & np.uint64(k - 1)).astype(np.int64), minlength=k)


def packed(p: np.ndarray) -> bytes:
    """A point in one, two or four bytes a count, whatever its largest count needs; the first byte tells which."""
    kind = next(k for k, t in enumerate(KINDS) if p.max() <= np.iinfo(t).max)
    return bytes([kind]) + p.astype(KINDS[kind]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, KINDS[raw[0]], offset=1)


def folded(points: list[np.ndarray], k: int) -> np.ndarray:
    """Points as rows of k axes each."""
    return np.array([p.reshape(-1, k).sum(axis=0) for p in points], np.int32).reshape(len(points), k)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ``a`` and ``b`` side by side, the most elements the sets can share."""
    step = max(1, STEP // a.shape[1])
    parts = [np.minimum(a[k : k + step], b[k : k + step]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Tree:
    """A packed R-tree: level 0 has the points, a node of each higher level the upper corner of FAN nodes below it.

    Points are packed by the nearest of one pivot for each leaf, so sets that are alike are in few leaves.
    """

    def __init__(self, points: np.ndarray):
        n = points.sum(axis=1)
        by_size = np.argsort(n, kind="stable")
        pivots = by_size[FAN // 2 :: FAN]
        nearest, best = np.zeros(len(points), np.int64), np.full(len(points), -1.0)
        for k, p in enumerate(pivots):
            alike = 2 * shared(points, np.broadcast_to(points[p], points.shape)) / np.maximum(n + n[p], 1)
            nearest, best = np.where(alike > best, k, nearest), np.maximum(alike, best)
        self.order = np.lexsort((n, nearest))
        self.high, self.small, self.large = [points[self.order]], [n[self.order]], [n[self.order]]
        while len(self.high[-1]) > 1:
            cuts = np.arange(0, len(self.high[-1]), FAN)
            self.high.append(np.maximum.reduceat(self.high[-1], cuts, axis=0))
            self.small.append(np.minimum.reduceat(self.small[-1], cuts))
            self.large.append(np.maximum.reduceat(self.large[-1], cuts))


class Join:
    """All pairs of two trees (or of one with itself) whose bound admits a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.visits = 0  # pairs of nodes or points whose bound was computed

    def __call__(self, a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = min(len(a.high), len(b.high)) - 1
        x, y = (g.ravel() for g in np.indices((len(a.high[level]), len(b.high[level]))))
        while True:
            if a is b:
                keep = x < y if level == 0 else x <= y
                x, y = x[keep], y[keep]
            x, y, bound = self._fitting(a, b, level, x, y)
            if level == 0:
                return a.order[x], b.order[y], bound
            level -= 1
            x, y = self._children(x, y, len(a.high[level]), len(b.high[level]))

    def _fitting(self, a: Tree, b: Tree, level: int, x: np.ndarray, y: np.ndarray):
        num, den = self.num, self.den
        near = (a.large[level][x] * den >= num * b.small[level][y]) & (b.large[level][y] * den >= num * a.small[level][x])
        x, y = x[near], y[near]
        self.visits += len(x)
        step = max(1, STEP // a.high[0].shape[1])
        parts = [shared(a.high[level][x[k : k + step]], b.high[level][y[k : k + step]]) for k in range(0, len(x), step)]
        bound = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        fits = bound * (den + num) >= num * (a.small[level][x] + b.small[level][y])
        return x[fits], y[fits], bound[fits]

    @staticmethod
    def _children(x: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        below = np.arange(FAN)
        x = (x[:, None, None] * FAN + below[:, None]).repeat(FAN, axis=2).ravel()
        y = (y[:, None, None] * FAN + below[None, :]).repeat(FAN, axis=1).ravel()
        there = (x < n) & (y < m)
        return x[there], y[there]


def candidates(points: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, num: int, den: int):
    """Pairs (i, j) that the bound admits, and the bound: within ``left``, or between ``left`` and ``right``.

    Sets of each number of axes have a tree of their own; two such trees meet at the axes of the coarser one.
    """
    width, size = np.array([len(p) for p in points]), np.array([int(p.sum()) for p in points])
    join, found, trees = Join(num, den), [], {}

    def tree(side: int, places: np.ndarray, k: int) -> Tree:
        at = (side, int(width[places[0]]), k)
        if at not in trees:
            trees[at] = Tree(folded([points[p] for p in places], k))
        return trees[at]

    by = lambda side: [side[width[side] == w] for w in np.unique(width[side])]
    one = right is None
    for i, some in enumerate(by(left)):
        for j, others in enumerate(by(left if one else right)):
            if (one and j < i) or size[some].max() * den < num * size[others].min() or size[others].max() * den < num * size[some].min():
                continue
            k = int(min(width[some[0]], width[others[0]]))
            x, y, bound = join(tree(0, some, k), tree(0 if one else 1, others, k))
            found.append((some[x], others[y], bound))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)
