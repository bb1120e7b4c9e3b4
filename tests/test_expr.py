import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import expr
from pointloom.functions.lie import inverse, rotation, se3_exp, skew, so3_exp, so3_log
from pointloom.schema import COV, COV_AT, cloud, finite, point_at, require

POSE = se3_exp(np.array([0.3, -0.2, 0.5, 1.0, -2.0, 0.5]))


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).uniform(-1000, 1000, (500, 3))


def frame(spark, xyz, **more):
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def columns(df, cols):
    rows = df.select("point_id", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).orderBy("point_id").collect()
    return np.array([r[1:] for r in rows])


def test_transforms(spark, points):
    df = frame(spark, points)
    assert np.allclose(columns(df, expr.transform_point(POSE)), points @ POSE[:3, :3].T + POSE[:3, 3])
    assert np.allclose(columns(df, expr.transform_normal(POSE, expr.columns())), points @ POSE[:3, :3].T)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 3, 3))
    covs = m @ m.transpose(0, 2, 1)
    rows = [(i, *[float(c[a, b]) for a, b in COV_AT]) for i, c in enumerate(covs)]
    cdf = spark.createDataFrame(rows, "point_id long, " + ", ".join(f"{c} double" for c in COV))
    r = POSE[:3, :3]
    want = r @ covs @ r.T
    assert np.allclose(columns(cdf, expr.transform_cov(POSE)), np.stack([want[:, a, b] for a, b in COV_AT], axis=1))
    inv = np.linalg.inv(covs)
    assert np.allclose(columns(cdf, expr.inverse_sym3([F.col(c) for c in COV])), np.stack([inv[:, a, b] for a, b in COV_AT], axis=1))


def test_floor_and_voxels(spark, points):
    df = frame(spark, points)
    assert np.array_equal(columns(df, [expr.fast_floor(F.col("x"))])[:, 0], np.floor(points[:, 0]))
    edge = frame(spark, [(-0.5, -1.0, 0.0), (0.999999, 1.0, -1e-12)])
    assert columns(edge, expr.voxel_coords(1.0)).tolist() == [[-1, -1, 0], [0, 1, -1]]
    keys = columns(df, [expr.voxel_key(*[c.cast("long") for c in expr.voxel_coords(0.5)])])[:, 0].astype(np.int64)
    v = np.floor(points * 2.0).astype(np.int64) + (1 << 20)
    assert np.array_equal(keys, v[:, 0] | v[:, 1] << 21 | v[:, 2] << 42)


def test_kernels_and_projection(spark, points):
    df = frame(spark, points)
    h, c = columns(df, [expr.huber(F.col("x"), 2.0), expr.cauchy(F.col("x"), 2.0)]).T
    x = points[:, 0]
    assert np.allclose(h, np.where(abs(x) < 2, 1, 2 / abs(x))) and np.allclose(c, 2 / (2 + x * x))
    uv = columns(df, expr.equirectangular())
    n = points / np.linalg.norm(points, axis=1)[:, None]
    assert np.allclose(uv, np.stack([np.arctan2(n[:, 0], n[:, 2]) / (2 * math.pi) + 0.5, -np.arcsin(n[:, 1]) / math.pi + 0.5], axis=1))
    assert columns(frame(spark, [(0.0, 0.0, 0.01)]), expr.equirectangular()).tolist() == [[0.5, 0.5]]
    assert [r[0] for r in spark.range(-2, 7).select(expr.repeat_border(F.col("id"), 5)).collect()] == [3, 4, 0, 1, 2, 3, 4, 0, 1]


def test_lie():
    rng = np.random.default_rng(2)
    for scale in (1e-12, 1e-6, 0.1, 3.0):
        w = rng.normal(size=3)
        w *= scale / np.linalg.norm(w)
        r = rotation(so3_exp(w))
        assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(so3_log(r), w, atol=1e-8)
        t = se3_exp(np.concatenate([w, [1.0, 2.0, 3.0]]))
        assert np.allclose(inverse(t) @ t, np.eye(4))
        half = se3_exp(np.concatenate([w, [1.0, 2.0, 3.0]]) / 2)
        assert np.allclose(half @ half, t, atol=1e-9)
    assert np.allclose(skew(np.array([1.0, 2, 3])) @ [4, 5, 6], np.cross([1, 2, 3], [4, 5, 6]))


def test_schema(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan"), 0.0), (2, float("inf"), 0.0, 0.0), (3, 1.0, 2.0, 3.0), (4, None, 0.0, 0.0)], "id int, a double, b double, c double")
    points = cloud(df, "id", "a", "b", F.col("c") * 2, payload="id")
    assert [tuple(r) for r in finite(points).collect()] == [(3, 1.0, 2.0, 6.0, 3)]
    assert point_at(points, 3).count() == 1
    with pytest.raises(ValueError):
        require(points, "nx")
