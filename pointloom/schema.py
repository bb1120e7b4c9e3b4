"""Schemas and column mapping.

A cloud is a DataFrame with one row for each point: ``point_id``, ``x``, ``y``,
``z``, optionally ``nx, ny, nz`` and ``cxx, cxy, cxz, cyy, cyz, czz``, and any other
columns. A feature that was not computed is null or absent, never a made-up value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
#: Row and column of each entry of COV.
COV_AT = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))

POINT = "point_id long, x double, y double, z double"
NEIGHBOR = "query_id long, rank int, point_id long, sq_dist double"
TRAJECTORY = "sensor_id long, frame_id long, pose array<double>"


def cloud(df: DataFrame, point_id: str | Column, x: str | Column, y: str | Column, z: str | Column, **more: str | Column) -> DataFrame:
    """Any table as a cloud: coordinates become doubles, ``more`` maps further columns by name."""

    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(point_id).cast("long").alias("point_id"),
        *(col(c).cast("double").alias(n) for n, c in zip(XYZ, (x, y, z), strict=True)),
        *(col(c).alias(n) for n, c in more.items()),
    )


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the cloud has no columns {missing}; compute them first")


def finite(df: DataFrame) -> DataFrame:
    """Only the points whose coordinates are all finite."""
    for c in XYZ:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def point_at(df: DataFrame, point_id: int) -> DataFrame:
    return df.where(F.col("point_id") == point_id)


def normal_at(df: DataFrame, point_id: int) -> np.ndarray | None:
    """The normal of one point, or None if there is no such point."""
    row = point_at(df, point_id).select(*NORMAL).first()
    return None if row is None else np.array(row)


def cov_at(df: DataFrame, point_id: int) -> np.ndarray | None:
    """The 3 x 3 covariance of one point, or None if there is no such point."""
    row = point_at(df, point_id).select(*COV).first()
    if row is None:
        return None
    out = np.empty((3, 3))
    for v, (i, j) in zip(row, COV_AT, strict=True):
        out[i, j] = out[j, i] = v
    return out


def from_numpy(spark: SparkSession, points: np.ndarray) -> DataFrame:
    """A cloud from an array of n x 3 or n x 4 (the fourth column is not a coordinate); ids are row numbers."""
    points = np.asarray(points, dtype=np.float64)
    if points.ndim != 2 or points.shape[1] not in (3, 4):
        raise ValueError("points are an array of n x 3 or n x 4")
    columns = {"point_id": pa.array(np.arange(len(points)))} | {c: pa.array(np.ascontiguousarray(points[:, i])) for i, c in enumerate(XYZ)}
    return spark.createDataFrame(pa.table(columns))


def to_numpy(points: DataFrame, *names: str) -> np.ndarray:
    """Columns (x, y, z if none are named) as an array in the order of ids; for clouds that fit the driver."""
    table = points.select("point_id", *(names or XYZ)).orderBy("point_id").toArrow()
    return np.stack([table.column(n).to_numpy() for n in (names or XYZ)], axis=1)
