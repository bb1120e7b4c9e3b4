"""Gauss-Newton and Levenberg-Marquardt on the driver, over 6 x 6 systems.

A problem has ``linearize(T) -> (H, b, e, inliers)``, which fixes correspondences
and weights at T, and ``error(T) -> e`` under those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from pointloom.functions.lie import se3_exp


class Problem(Protocol):
    def linearize(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]: ...

    def error(self, t: np.ndarray) -> float: ...


@dataclass(frozen=True)
class TerminationCriteria:
    rotation_eps: float = 0.1 * math.pi / 180.0
    translation_eps: float = 1e-3

    def converged(self, delta: np.ndarray) -> bool:
        return bool(np.linalg.norm(delta[:3]) <= self.rotation_eps and np.linalg.norm(delta[3:]) <= self.translation_eps)


class NullFactor:
    """Changes nothing; the base of general factors."""

    def update_linearized_system(self, t: np.ndarray, h: np.ndarray, b: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray, float]:
        return h, b, e

    def update_error(self, t: np.ndarray, e: float) -> float:
        return e


@dataclass
class RestrictDoF(NullFactor):
    """Holds degrees of freedom whose mask is 0 (softly, by a large diagonal)."""

    mask: tuple[float, ...] = (1.0,) * 6
    weight: float = 1e9

    def update_linearized_system(self, t, h, b, e):
        return h + self.weight * np.diag(np.abs(np.asarray(self.mask) - 1.0)), b, e


@dataclass
class RegistrationResult:
    T: np.ndarray
    converged: bool = False
    iterations: int = 0
    num_inliers: int = 0
    H: np.ndarray = field(default_factory=lambda: np.zeros((6, 6)))
    b: np.ndarray = field(default_factory=lambda: np.zeros(6))
    error: float = 0.0

    def row(self) -> tuple:
        return self.T.ravel().tolist(), self.converged, self.iterations, self.num_inliers, self.H.ravel().tolist(), self.b.tolist(), float(self.error)

    SCHEMA = "pose array<double>, converged boolean, iterations int, num_inliers long, h array<double>, b array<double>, error double"

    def frame(self, spark):
        """One row: the pose and the system row by row."""
        return spark.createDataFrame([self.row()], self.SCHEMA)


def _step(h: np.ndarray, b: np.ndarray, damping: float) -> np.ndarray:
    return -np.linalg.solve(h + damping * np.eye(6), b)


@dataclass(frozen=True)
class GaussNewton:
    """Always accepts; the error reported is that before the last step."""

    max_iterations: int = 20
    damping: float = 1e-6

    def run(self, problem: Problem, init: np.ndarray, criteria: TerminationCriteria, general: NullFactor) -> RegistrationResult:
        out = RegistrationResult(init.copy())
        for k in range(self.max_iterations):
            h, b, e, out.num_inliers = problem.linearize(out.T)
            h, b, e = general.update_linearized_system(out.T, h, b, e)
            delta = _step(h, b, self.damping)
            out.T = out.T @ se3_exp(delta)
            out.H, out.b, out.error, out.iterations = h, b, e, k
            if criteria.converged(delta):
                out.converged = True
                break
        return out


@dataclass(frozen=True)
class LevenbergMarquardt:
    """Accepts a step that doesn't raise the error; the damping goes by tens and lasts across iterations."""

    max_iterations: int = 20
    max_inner: int = 10
    init_damping: float = 1e-3
    factor: float = 10.0

    def run(self, problem: Problem, init: np.ndarray, criteria: TerminationCriteria, general: NullFactor) -> RegistrationResult:
        out, damping = RegistrationResult(init.copy()), self.init_damping
        for k in range(self.max_iterations):
            h, b, e, out.num_inliers = problem.linearize(out.T)
            h, b, e = general.update_linearized_system(out.T, h, b, e)
            accepted = False
            for _ in range(self.max_inner):
                delta = _step(h, b, damping)
                moved = out.T @ se3_exp(delta)
                new_e = general.update_error(moved, problem.error(moved))
                if new_e <= e:
                    out.converged = criteria.converged(delta)
                    out.T, e, accepted = moved, new_e, True
                    damping /= self.factor
                    break
                damping *= self.factor
            out.H, out.b, out.error, out.iterations = h, b, e, k
            if out.converged or not accepted:
                break
        return out
