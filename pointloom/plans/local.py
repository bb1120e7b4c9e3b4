"""Registration of small clouds inside one task, in numpy.

For scans of up to some ten thousand points after downsampling, one of which is a
unit of work; clouds larger than that are registered by ``plans.registration``.
"""

from __future__ import annotations

import numpy as np

from pointloom.operators.features import normals_of, regularised_covs
from pointloom.plans.kernels import N_STATS, Quadratic, direct, matrices, statistics, weight_of
from pointloom.plans.optimize import GaussNewton, LevenbergMarquardt, NullFactor, RegistrationResult, TerminationCriteria

#: Few targets are searched directly, and distances are held in blocks of so many.
_DIRECT, _BLOCK = 64, 2_000_000


def _direct(queries: np.ndarray, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    idx, d2 = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    step = max(1, _BLOCK // max(len(targets), 1))
    for a in range(0, len(queries), step):
        d = ((queries[a : a + step, None, :] - targets[None, :, :]) ** 2).sum(axis=2)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        idx[a : a + step], d2[a : a + step] = best, np.take_along_axis(d, best, axis=1)
    return idx, d2


class Grid:
    """An index of points by cells, exact for any query.

    The points of the 27 cells around a query are ranges of a sorted array. A query is
    settled once k of them are within the cells' width, since all else is farther;
    the others go on with cells of twice the width. Widths start where few points share a cell, and
    a search starts where about k / 3 do; layouts are kept for the next search.
    """

    def __init__(self, targets: np.ndarray):
        self.targets = targets
        self.low = targets.min(axis=0) if len(targets) else np.zeros(3)
        sides = targets.max(axis=0) - self.low if len(targets) else np.zeros(3)
        longest = max(float(sides.max()), 1e-12)
        volume = float(np.prod(np.maximum(sides, longest * 1e-2)))
        self.width = max((volume * 4.0 / max(len(targets), 1)) ** (1 / 3), longest * 1e-5)
        self.levels: list[tuple] = []
        if len(targets) > _DIRECT:
            while self._laid(self.width)[4] > 1.5 and self.width > longest * 2e-5:
                self.width /= 2.0

    def _laid(self, width: float) -> tuple:
        """Width, cells along the axes, sorted keys, the points in their order, and how many points a point's cell has on average."""
        cells = np.floor((self.targets - self.low) / width).astype(np.int64)
        size = cells.max(axis=0) + 1
        keys = (cells[:, 2] * size[1] + cells[:, 1]) * size[0] + cells[:, 0]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        n = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]))
        return width, size, keys, order, float((n * n).sum() / len(keys))

    def _level(self, i: int) -> tuple:
        while len(self.levels) <= i:
            self.levels.append(self._laid(self.width * 2.0 ** len(self.levels)))
        return self.levels[i]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances, nearest first, ties to the smaller index."""
        k = min(k, len(self.targets))
        idx, d2 = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), np.inf)
        left, level = np.arange(len(queries)), 0
        while len(left) and k:
            if len(self.targets) <= _DIRECT or (self._level(level)[1] <= 2).all():  # every cell is a neighbour: all points
                idx[left], d2[left] = _direct(queries[left], self.targets, k)
                break
            if self._level(level)[4] >= k / 3:
                left = np.concatenate([self._near(queries, left[a : a + 4096], k, level, idx, d2) for a in range(0, len(left), 4096)])
            level += 1
        return idx, d2

    def _near(self, queries: np.ndarray, own: np.ndarray, k: int, level: int, idx: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Settle those of ``own`` that have ``k`` points within the width; the others come back."""
        width, size, keys, order, _ = self._level(level)
        at = np.floor((queries[own] - self.low) / width)
        at = np.clip(at, -2, size + 1).astype(np.int64)  # farther out there is nothing anyway
        who, start, length = [], [], []
        for dz in (-1, 0, 1):
            for dy in (-1, 0, 1):
                y, z = at[:, 1] + dy, at[:, 2] + dz
                lo, hi = np.maximum(at[:, 0] - 1, 0), np.minimum(at[:, 0] + 1, size[0] - 1)
                some = np.flatnonzero((y >= 0) & (y < size[1]) & (z >= 0) & (z < size[2]) & (lo <= hi))
                row = (z[some] * size[1] + y[some]) * size[0]  # three cells along x are one range
                first = np.searchsorted(keys, row + lo[some], side="left")
                who.append(some)
                start.append(first)
                length.append(np.searchsorted(keys, row + hi[some], side="right") - first)
        who, start, length = (np.concatenate(x) for x in (who, start, length))
        by = np.argsort(who, kind="stable")
        who, start, length = who[by], start[by], length[by]
        settled = np.zeros(len(own), bool)
        most = width * width * (1 - 1e-12)
        ends = np.cumsum(length)
        a = 0
        while a < len(who):  # pairs of some queries at a time, or of one that has more
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BLOCK, side="right"))
            b = int(np.searchsorted(who, who[min(b, len(who) - 1)], side="left")) if b < len(who) else b
            if b <= a:
                b = int(np.searchsorted(who, who[a], side="right"))
            n = length[a:b]
            q = np.repeat(who[a:b], n)
            t = order[np.repeat(start[a:b] - np.cumsum(n) + n, n) + np.arange(len(q))]
            d = ((queries[own[q]] - self.targets[t]) ** 2).sum(axis=1)
            near = d <= most
            q, t, d = q[near], t[near], d[near]
            a = b
            rank = np.lexsort((t, d, q))
            q, first, n = np.unique(q, return_index=True, return_counts=True)
            enough = n >= k
            best = rank[first[enough, None] + np.arange(k)]
            idx[own[q[enough]]], d2[own[q[enough]]] = t[best], d[best]
            settled[q[enough]] = True
        return own[~settled]


def knn(queries: np.ndarray, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances, nearest first, ties to the smaller index; at most as many as there are targets."""
    return Grid(targets).search(queries, k)


def voxel_means(points: np.ndarray, leaf: float) -> np.ndarray:
    cells = np.floor(points * (1.0 / leaf)).astype(np.int64)
    fine = ((cells >= -(1 << 20)) & (cells < (1 << 20))).all(axis=1)
    cells, points = cells[fine], points[fine]
    if not len(points):
        return points
    _, group, n = np.unique(cells[:, ::-1], axis=0, return_inverse=True, return_counts=True)
    group = group.ravel()
    return np.stack([np.bincount(group, points[:, i]) for i in range(3)], axis=1) / n[:, None]


def features(points: np.ndarray, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Normals and regularised covariances."""
    idx, _ = knn(points, points, k)
    near = points[idx]
    off = near - near.mean(axis=1, keepdims=True)
    cov = np.einsum("nki,nkj->nij", off, off) / max(near.shape[1], 1)
    normal = normals_of(cov, points, np.full(len(points), idx.shape[1]))
    return normal, regularised_covs(normal)


class CloudTarget:
    """A cloud as the target of correspondences."""

    def __init__(self, points: np.ndarray, normals: np.ndarray, covs: np.ndarray):
        self.points, self.normals, self.covs = points, normals, covs
        self.index = Grid(points)

    def match(self, moved: np.ndarray, max_sq: float) -> tuple[np.ndarray, np.ndarray]:
        """Source and target indices of the pairs that are near enough."""
        if not len(self.points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        idx, d2 = self.index.search(moved, 1)
        near = np.flatnonzero(d2[:, 0] <= max_sq)
        return near, idx[near, 0]


class LocalProblem:
    def __init__(self, target, points: np.ndarray, covs: np.ndarray | None, factor: str, max_sq: float, kernel=None, width: float = 1.0):
        self.target, self.points, self.covs, self.factor, self.max_sq = target, points, covs, factor, max_sq
        self.weight = weight_of(kernel, width)

    def linearize(self, t):
        s, g = self.target.match(self.points @ t[:3, :3].T + t[:3, 3], self.max_sq)
        self.p, self.q = self.points[s], self.target.points[g]
        normals = self.target.normals[g] if self.factor == "plane" else None
        covs = (self.target.covs[g], self.covs[s]) if self.factor in ("gicp", "vgicp") else (None, None)
        self.m = matrices(self.factor, t, normals, *covs, n=len(s))
        if self.weight:
            return *direct(self.p, self.q, self.m, t, self.weight), len(s)
        cs = self.p.mean(axis=0) if len(s) else np.zeros(3)
        ct = t[:3, :3] @ cs + t[:3, 3]
        self.quadratic = Quadratic(statistics(self.p - cs, self.q - ct, self.m) if len(s) else np.zeros(N_STATS), cs, ct)
        return self.quadratic.linearize(t)

    def error(self, t):
        return direct(self.p, self.q, self.m, t, self.weight)[2] if self.weight else self.quadratic.error(t)


def register(
    target,
    points: np.ndarray,
    covs: np.ndarray | None,
    factor: str = "gicp",
    init: np.ndarray | None = None,
    max_distance: float = 1.0,
    kernel=None,
    optimizer: GaussNewton | LevenbergMarquardt | None = None,
    criteria: TerminationCriteria | None = None,
    general: NullFactor | None = None,
) -> RegistrationResult:
    problem = LocalProblem(target, points, covs, factor, max_distance * max_distance, kernel)
    return (optimizer or LevenbergMarquardt()).run(problem, np.eye(4) if init is None else init, criteria or TerminationCriteria(), general or NullFactor())
