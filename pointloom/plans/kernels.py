"""The registration error in numpy: one quadratic form for all factors.

Every factor is e = r' M r / 2 with r = q - (R p + t): M is the identity (points),
the squared normal on the diagonal (planes), or the inverse of the summed covariances
(distributions). For fixed M the error is a quadratic in the pose's 12 entries, so 74
sums give H, b and e at any pose.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pointloom.functions.lie import skew

N_STATS = 10 * 6 + 12 + 2
_PAIRS4 = [(a, b) for a in range(4) for b in range(a, 4)]
_PAIRS3 = [(i, j) for i in range(3) for j in range(i, 3)]


def huber_weight(x: np.ndarray, c: float = 1.0) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < c, 1.0, c / np.maximum(x, 1e-300))


def cauchy_weight(x: np.ndarray, c: float = 1.0) -> np.ndarray:
    return c / (c + x * x)


WEIGHTS = {"huber": huber_weight, "cauchy": cauchy_weight}


def weight_of(kernel: str | Callable[[np.ndarray, float], np.ndarray] | None, width: float = 1.0) -> Callable[[np.ndarray], np.ndarray] | None:
    """The weight as a function of the error: of a kernel by name, or one's own function of (errors, width)."""
    if kernel is None:
        return None
    weight = kernel if callable(kernel) else WEIGHTS[kernel]
    return lambda x: weight(x, width)


def statistics(p: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sums of points p, q (n x 3) under matrices m (n x 3 x 3)."""
    h = np.concatenate([p, np.ones((len(p), 1))], axis=1)
    mq = np.einsum("nij,nj->ni", m, q)
    left = np.stack([h[:, a] * h[:, b] for a, b in _PAIRS4], axis=1)
    right = np.stack([m[:, i, j] for i, j in _PAIRS3], axis=1)
    return np.concatenate([(left.T @ right).ravel(), (h.T @ mq).ravel(), [(q * mq).sum(), float(len(p))]])


class Quadratic:
    """H, b and e at any pose from the sums; points were shifted by ``cs`` (source) and ``ct`` (target)."""

    def __init__(self, stats: np.ndarray, cs: np.ndarray, ct: np.ndarray):
        self.cs, self.ct = cs, ct
        self.s = np.zeros((12, 12))
        for value, ((a, b), (i, j)) in zip(stats[:60], ((x, y) for x in _PAIRS4 for y in _PAIRS3), strict=True):
            for u, v in ((a, b), (b, a)):
                self.s[3 * u + i, 3 * v + j] = self.s[3 * u + j, 3 * v + i] = value
        self.c, self.q, self.inliers = stats[60:72], stats[72], int(round(stats[73]))

    def _theta(self, t: np.ndarray) -> np.ndarray:
        r = t[:3, :3]
        return np.concatenate([r.T.ravel(), t[:3, 3] + r @ self.cs - self.ct])

    def error(self, t: np.ndarray) -> float:
        x = self._theta(t)
        return 0.5 * float(self.q - 2 * x @ self.c + x @ self.s @ x)

    def linearize(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        x, r = self._theta(t), t[:3, :3]
        g = np.zeros((12, 6))
        for k in range(3):
            turn = r @ skew(np.eye(3)[k])
            g[:9, k] = turn.T.ravel()
            g[9:, k] = turn @ self.cs
            g[9:, 3 + k] = r[:, k]
        return g.T @ self.s @ g, -g.T @ (self.c - self.s @ x), self.error(t), self.inliers


def direct(p: np.ndarray, q: np.ndarray, m: np.ndarray, t: np.ndarray, weight=None) -> tuple[np.ndarray, np.ndarray, float]:
    """H, b and e by summing over points, with a robust weight on sqrt(e) if given."""
    r3 = t[:3, :3]
    r = q - (p @ r3.T + t[:3, 3])
    s = np.zeros((len(p), 3, 3))
    s[:, 0, 1], s[:, 0, 2], s[:, 1, 2] = -p[:, 2], p[:, 1], -p[:, 0]
    s[:, 1, 0], s[:, 2, 0], s[:, 2, 1] = p[:, 2], -p[:, 1], p[:, 0]
    j = np.concatenate([r3 @ s, np.broadcast_to(-r3, s.shape)], axis=2)
    mr = np.einsum("nij,nj->ni", m, r)
    e = 0.5 * (r * mr).sum(axis=1)
    w = np.ones(len(p)) if weight is None else weight(np.sqrt(np.maximum(e, 0.0)))
    mj = m @ j
    return np.einsum("n,nia,nib->ab", w, j, mj), np.einsum("n,nia,ni->a", w, j, mr), float((w * e).sum())


def matrices(factor: str, t: np.ndarray, target_normal=None, target_cov=None, source_cov=None, n: int = 0) -> np.ndarray:
    if factor == "icp":
        return np.broadcast_to(np.eye(3), (n, 3, 3))
    if factor == "plane":
        return target_normal[:, :, None] ** 2 * np.eye(3)
    r = t[:3, :3]
    return np.linalg.inv(target_cov + r @ source_cov @ r.T)
