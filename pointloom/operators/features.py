"""Local features: normals and covariances from the nearest neighbours of each point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.neighbors import knn
from pointloom.schema import COV, COV_AT, NORMAL, XYZ

#: A point with fewer neighbours (itself included) has no features.
MIN_NEIGHBORS = 5
#: The eigenvalue of a regularised covariance along the normal; the others are 1.
FLATNESS = 1e-3


def neighborhood_moments(points: DataFrame, k: int = 20, neighbors: DataFrame | None = None) -> DataFrame:
    """Mean and population covariance of each point's ``k`` nearest (itself included): point_id, n, mx.., cxx..

    ``neighbors`` may be a ready result of a search (query_id, point_id).
    """
    found = neighbors if neighbors is not None else knn(points, points, k)
    near = found.select("query_id", "point_id").join(points.select("point_id", *XYZ), "point_id")
    out = near.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(c).alias("m" + c) for c in XYZ),
        *(F.covar_pop(XYZ[i], XYZ[j]).alias(name) for name, (i, j) in zip(COV, COV_AT, strict=True)),
    )
    return out.withColumnRenamed("query_id", "point_id")


def normals_of(cov: np.ndarray, points: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the smallest eigenvalues, facing the origin; zero where there are too few neighbours."""
    _, vectors = np.linalg.eigh(cov)
    normal = vectors[:, :, 0].copy()
    normal[(normal * points).sum(axis=1) > 0] *= -1
    normal[n < MIN_NEIGHBORS] = 0.0
    return normal


def regularised_covs(normal: np.ndarray) -> np.ndarray:
    """V diag(flat, 1, 1) V' from the normals; the identity where there is none."""
    return np.eye(3) - (1.0 - FLATNESS) * normal[:, :, None] * normal[:, None, :]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in NORMAL]))
def _normal(rows: pd.DataFrame) -> pd.DataFrame:
    full = np.empty((len(rows), 3, 3))
    for name, (i, j) in zip(COV, COV_AT, strict=True):
        full[:, i, j] = full[:, j, i] = rows[name]
    return pd.DataFrame(normals_of(full, rows[list(XYZ)].to_numpy(), rows["n"].to_numpy()), columns=list(NORMAL))


def estimate_normals_covariances(points: DataFrame, k: int = 20, neighbors: DataFrame | None = None, normals: bool = True, covariances: bool = True) -> DataFrame:
    """``points`` with normals and regularised covariances; columns of those names are replaced."""
    moments = neighborhood_moments(points, k, neighbors).select("point_id", "n", *COV)
    bare = points.drop(*NORMAL, *COV)
    both = bare.join(moments, "point_id").withColumn("__n", _normal(F.struct("n", *XYZ, *COV))).drop("n", *COV)
    normal = [F.col(f"__n.{c}") for c in NORMAL]
    if normals:
        for name, c in zip(NORMAL, normal, strict=True):
            both = both.withColumn(name, c)
    if covariances:
        for name, (i, j) in zip(COV, COV_AT, strict=True):
            both = both.withColumn(name, F.lit(1.0 if i == j else 0.0) - F.lit(1.0 - FLATNESS) * normal[i] * normal[j])
    return both.drop("__n")


def estimate_normals(points: DataFrame, k: int = 20, neighbors: DataFrame | None = None) -> DataFrame:
    return estimate_normals_covariances(points, k, neighbors, covariances=False)


def estimate_covariances(points: DataFrame, k: int = 20, neighbors: DataFrame | None = None) -> DataFrame:
    return estimate_normals_covariances(points, k, neighbors, normals=False)
