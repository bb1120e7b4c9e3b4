"""Downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.expr import in_voxel_range, voxel_coords
from pointloom.schema import XYZ


def with_voxels(points: DataFrame, leaf: float) -> DataFrame:
    """``points`` with vx, vy, vz; those outside the 21-bit range are left out."""
    for name, c in zip(("vx", "vy", "vz"), voxel_coords(leaf), strict=True):
        points = points.withColumn(name, c)
    return points.where(in_voxel_range(F.col("vx"), F.col("vy"), F.col("vz")))


def voxel_grid(points: DataFrame, leaf: float, by: tuple[str, ...] = (), order: bool = False) -> DataFrame:
    """The mean point of each voxel: vx, vy, vz, n, x, y, z (and ``by``, such as a frame id).

    Only positions are carried. One shuffle of partial sums; a voxel is never
    emitted twice. No point in range, or no point at all: no rows. ``order`` sorts by
    the packed key (z, y, x).
    """
    out = with_voxels(points, leaf).groupBy(*by, "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in XYZ))
    return out.orderBy(*by, "vz", "vy", "vx") if order else out


def voxel_occupancy(points: DataFrame, leaf: float) -> DataFrame:
    """How many voxels hold how many points: n, voxels."""
    return voxel_grid(points, leaf).groupBy("n").agg(F.count(F.lit(1)).alias("voxels"))


def random_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` points without replacement (all, if there are no more), the same ones for the same seed."""
    key = F.xxhash64(F.lit(seed), "point_id")
    return points.withColumn("__key", key).orderBy("__key", "point_id").limit(n).drop("__key")


def random_sample_md5(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The same with an MD5 key, which other engines can compute too."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("point_id").cast("string")).cast("binary"))
    return points.withColumn("__key", key).orderBy("__key", "point_id").limit(n).drop("__key")
