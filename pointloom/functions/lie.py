"""Rotations and rigid motions; twists have the rotation first."""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    x, y, z = v
    return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])


def so3_exp(omega: np.ndarray) -> np.ndarray:
    """The quaternion (w, x, y, z) of a rotation vector."""
    omega = np.asarray(omega, float)
    sq = float(omega @ omega)
    if sq < 1e-10:  # series
        imag, real = 0.5 - sq / 48.0 + sq * sq / 3840.0, 1.0 - sq / 8.0 + sq * sq / 384.0
    else:
        angle = np.sqrt(sq)
        imag, real = np.sin(angle / 2) / angle, np.cos(angle / 2)
    return np.array([real, *(imag * omega)])


def rotation(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q / np.linalg.norm(q)
    v = skew(np.array([x, y, z]))
    return np.eye(3) + 2.0 * w * v + 2.0 * v @ v


def se3_exp(twist: np.ndarray) -> np.ndarray:
    """The 4 x 4 pose of (rx, ry, rz, tx, ty, tz)."""
    omega, v = np.asarray(twist[:3], float), np.asarray(twist[3:], float)
    angle = np.linalg.norm(omega)
    out = np.eye(4)
    out[:3, :3] = rotation(so3_exp(omega))
    if angle < 1e-10:
        out[:3, 3] = out[:3, :3] @ v
    else:
        s = skew(omega)
        left = np.eye(3) + (1 - np.cos(angle)) / angle**2 * s + (angle - np.sin(angle)) / angle**3 * s @ s
        out[:3, 3] = left @ v
    return out


def so3_log(r: np.ndarray) -> np.ndarray:
    cosine = np.clip((np.trace(r) - 1) / 2, -1.0, 1.0)
    angle = np.arccos(cosine)
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return 0.5 * axis if angle < 1e-9 else angle / (2 * np.sin(angle)) * axis


def inverse(t: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = t[:3, :3].T
    out[:3, 3] = -t[:3, :3].T @ t[:3, 3]
    return out
