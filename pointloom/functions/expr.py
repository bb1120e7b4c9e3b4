"""Column expressions over points, normals, covariances and voxels.

All of them are plain arithmetic, so they stay inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.schema import COV, COV_AT, NORMAL, XYZ

#: Voxel coordinates have 21 bits; points outside are left out.
VOXEL_MIN, VOXEL_MAX = -(1 << 20), (1 << 20) - 1
#: Fixed values of the spatial hash.
HASH_PRIMES = (73856093, 19349669, 83492791)


def columns(names: Sequence[str] = XYZ) -> list[Column]:
    return [F.col(n) for n in names]


def _row(weights: Sequence[float], values: Sequence[Column], plus: float = 0.0) -> Column:
    out = F.lit(float(weights[0])) * values[0]
    for w, v in zip(weights[1:], values[1:], strict=True):
        out = out + F.lit(float(w)) * v
    return out + F.lit(float(plus)) if plus else out


def transform_point(t: np.ndarray, p: Sequence[Column] | None = None) -> list[Column]:
    """R p + t for a 4 x 4 pose."""
    p = p or columns()
    return [_row(t[i, :3], p, t[i, 3]) for i in range(3)]


def transform_normal(t: np.ndarray, n: Sequence[Column] | None = None) -> list[Column]:
    n = n or columns(NORMAL)
    return [_row(t[i, :3], n) for i in range(3)]


def full_cov(c: Sequence[Column]) -> list[list[Column]]:
    """3 x 3 from the six entries."""
    out: list[list[Column]] = [[c[0]] * 3 for _ in range(3)]
    for v, (i, j) in zip(c, COV_AT, strict=True):
        out[i][j] = out[j][i] = v
    return out


def transform_cov(t: np.ndarray, c: Sequence[Column] | None = None) -> list[Column]:
    """The six entries of R C R'."""
    full = full_cov(c or columns(COV))
    out = []
    for i, j in COV_AT:
        terms = [F.lit(float(t[i, a] * t[j, b])) * full[a][b] for a in range(3) for b in range(3)]
        total = terms[0]
        for x in terms[1:]:
            total = total + x
        out.append(total)
    return out


def sq_dist(a: Sequence[Column], b: Sequence[Column]) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return dx * dx + dy * dy + dz * dz


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def fast_floor(x: Column) -> Column:
    return F.floor(x)


def voxel_coord(x: Column, leaf: float) -> Column:
    """floor(x * (1 / leaf)): the reciprocal is multiplied, so borders fall alike everywhere."""
    return F.floor(x * F.lit(1.0 / leaf))


def voxel_coords(leaf: float, p: Sequence[Column] | None = None) -> list[Column]:
    return [voxel_coord(c, leaf) for c in (p or columns())]


def in_voxel_range(*coords: Column) -> Column:
    out = coords[0].between(VOXEL_MIN, VOXEL_MAX)
    for c in coords[1:]:
        out = out & c.between(VOXEL_MIN, VOXEL_MAX)
    return out


def voxel_key(vx: Column, vy: Column, vz: Column) -> Column:
    """Three 21-bit coordinates in one long, z highest."""
    x, y, z = (v - F.lit(VOXEL_MIN) for v in (vx, vy, vz))
    return x.bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(F.shiftleft(z, 42))


def spatial_hash(vx: Column, vy: Column, vz: Column) -> Column:
    a, b, c = (v * F.lit(p).cast("long") for v, p in zip((vx, vy, vz), HASH_PRIMES, strict=True))
    return a.bitwiseXOR(b).bitwiseXOR(c)


def global_index(voxel_id: Column, slot: Column) -> Column:
    """A point of a voxel map: the voxel's number in the high half, the slot in the low one."""
    return F.shiftleft(voxel_id.cast("long"), 32).bitwiseOR(slot.cast("long"))


def huber(x: Column, c: float = 1.0) -> Column:
    """Weight of a residual x = sqrt(e)."""
    return F.when(F.abs(x) < c, F.lit(1.0)).otherwise(F.lit(c) / F.abs(x))


def cauchy(x: Column, c: float = 1.0) -> Column:
    """c / (c + x x), with c and not its square above and below."""
    return F.lit(c) / (F.lit(c) + x * x)


KERNELS: dict[str, Callable[..., Column]] = {"huber": huber, "cauchy": cauchy}


def equirectangular(p: Sequence[Column] | None = None) -> list[Column]:
    """The direction of a point as (u, v) in the unit square; the middle for points at the origin."""
    x, y, z = p or columns()
    n2 = x * x + y * y + z * z
    n = F.sqrt(n2)
    near = n2 < 1e-3
    u = F.atan2(x / n, z / n) / F.lit(2.0 * math.pi) + F.lit(0.5)
    v = -F.asin(y / n) / F.lit(math.pi) + F.lit(0.5)
    return [F.when(near, F.lit(0.5)).otherwise(u), F.when(near, F.lit(0.5)).otherwise(v)]


def clamp_border(x: Column, width: int) -> Column:
    """Positions outside stay outside (and are then left out)."""
    return x


def repeat_border(x: Column, width: int) -> Column:
    """One wrap around either end."""
    return F.when(x < 0, x + width).when(x >= width, x - width).otherwise(x)


def inverse_sym3(m: Sequence[Column]) -> list[Column]:
    """The six entries of the inverse of a symmetric 3 x 3 matrix."""
    a, b, c, d, e, f = m
    k00, k01, k02 = d * f - e * e, c * e - b * f, b * e - c * d
    det = a * k00 + b * k01 + c * k02
    return [k00 / det, k01 / det, k02 / det, (a * f - c * c) / det, (b * c - a * e) / det, (a * d - b * b) / det]


def max_variance_axis(p: Sequence[Column] | None = None) -> Column:
    """Aggregate: 0, 1 or 2, the axis along which the points vary most."""
    vx, vy, vz = (F.var_pop(c) for c in (p or columns()))
    return F.when((vx >= vy) & (vx >= vz), 0).when(vy >= vz, 1).otherwise(2)


def principal_axis(points, p: Sequence[str] = XYZ) -> np.ndarray:
    """The direction along which a cloud varies most, from one aggregate of its second moments."""
    row = points.agg(*(F.covar_pop(p[i], p[j]).alias(n) for n, (i, j) in zip(COV, COV_AT, strict=True))).first()
    full = np.zeros((3, 3))
    for n, (i, j) in zip(COV, COV_AT, strict=True):
        full[i, j] = full[j, i] = row[n] or 0.0
    return np.linalg.eigh(full)[1][:, -1]
