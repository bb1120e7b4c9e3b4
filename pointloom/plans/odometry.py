"""Scan-to-scan odometry over a table of frames, all pairs of neighbours in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.neighbors import frame_pairs
from pointloom.operators.sampling import voxel_grid
from pointloom.plans.local import CloudTarget, features, register
from pointloom.schema import TRAJECTORY, XYZ
from pointloom.streaming.odometry import scan_to_model_batch
from pointloom.streaming.voxelmap import VoxelMap


def _pose_of_pair(k: int, factor: str, voxel: float, max_distance: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows.loc[rows["is_target"] == x].sort_values(["vx", "vy", "vz"])[list(XYZ)].to_numpy() for x in (True, False)]
        pose, inliers, error = np.eye(4), 0, 0.0
        if all(len(x) for x in sides):
            (tn, tc), (_, sc) = (features(x, k) for x in sides)
            target = CloudTarget(sides[0], tn, tc)
            if factor == "vgicp":
                target = VoxelMap(voxel)
                target.insert(sides[0], tc)
            out = register(target, sides[1], sc, factor, None, max_distance)
            pose, inliers, error = out.T, out.num_inliers, float(out.error)
        return pd.DataFrame({"sensor_id": [key[0]], "frame_id": [key[1]], "pose": [pose[:3].ravel().tolist()], "num_inliers": [inliers], "error": [error]})

    return run


def relative_poses(frames: DataFrame, leaf: float = 0.25, k: int = 10, factor: str = "gicp", voxel: float = 1.0, max_distance: float = 1.0) -> DataFrame:
    """The pose of each frame in the one before it: sensor_id, frame_id, pose, num_inliers, error.

    A task holds the two downsampled scans of a pair. ``frames`` has sensor_id,
    frame_id, point_id, x, y, z.
    """
    small = voxel_grid(frames, leaf, by=("sensor_id", "frame_id"))
    pairs = frame_pairs(frames.select("sensor_id", "frame_id"), by=("sensor_id",))
    own = small.join(pairs.select("sensor_id", "frame_id"), ["sensor_id", "frame_id"]).withColumn("is_target", F.lit(False))
    before = pairs.select("sensor_id", F.col("previous"), F.col("frame_id").alias("pair"))
    target = small.join(before, (small["frame_id"] == before["previous"]) & (small["sensor_id"] == before["sensor_id"]))
    target = target.select(small["sensor_id"], F.col("pair").alias("frame_id"), "vx", "vy", "vz", *XYZ, F.lit(True).alias("is_target"))
    both = own.select("sensor_id", "frame_id", "vx", "vy", "vz", *XYZ, "is_target").union(target)
    return both.groupBy("sensor_id", "frame_id").applyInPandas(_pose_of_pair(k, factor, voxel, max_distance), f"{TRAJECTORY}, num_inliers long, error double")


def accumulate(frames: DataFrame, relative: DataFrame) -> DataFrame:
    """The trajectory: products of the relative poses in frame order, the first frame at the identity."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        world, out = np.eye(4), []
        rows = rows.sort_values("frame_id")
        for pose in rows["pose"]:
            if pose is not None:
                step = np.eye(4)
                step[:3] = np.reshape(pose, (3, 4))
                world = world @ step
            out.append(world[:3].ravel().tolist())
        return pd.DataFrame({"sensor_id": key[0], "frame_id": rows["frame_id"].to_numpy(), "pose": out})

    ids = frames.select("sensor_id", "frame_id").distinct()
    poses = ids.join(relative.select("sensor_id", "frame_id", "pose"), ["sensor_id", "frame_id"], "left")
    return poses.groupBy("sensor_id").applyInPandas(run, TRAJECTORY)  # twelve numbers a frame


def scan_to_scan(frames: DataFrame, **how) -> DataFrame:
    return accumulate(frames, relative_poses(frames, **how))


#: Odometry engines by name.
ENGINES: dict[str, Callable[..., DataFrame]] = {
    "gicp": lambda frames, **how: scan_to_scan(frames, factor="gicp", **how),
    "vgicp": lambda frames, **how: scan_to_scan(frames, factor="vgicp", **how),
    "icp": lambda frames, **how: scan_to_scan(frames, factor="icp", **how),
    "plane_icp": lambda frames, **how: scan_to_scan(frames, factor="plane", **how),
    "vgicp_model": lambda frames, **how: scan_to_model_batch(frames, kind="gaussian", **how),
    "gicp_last": lambda frames, **how: scan_to_model_batch(frames, kind="last", **how),
    "gicp_model": lambda frames, **how: scan_to_model_batch(frames, kind="flat", **how),
}


def register_engine(name: str, engine: Callable[..., DataFrame]) -> None:
    ENGINES[name] = engine


def run(frames: DataFrame, engine: str = "gicp", **how) -> DataFrame:
    return ENGINES[engine](frames, **how)


# --- metrics ----------------------------------------------------------------------


def alignment(estimated: DataFrame, truth: DataFrame) -> np.ndarray:
    """The rigid pose that brings the estimated positions nearest to the true ones (Umeyama 1991), from one aggregate."""
    a = estimated.select("sensor_id", "frame_id", *(F.element_at("pose", 4 * i + 4).alias(f"a{i}") for i in range(3)))
    b = truth.select("sensor_id", "frame_id", *(F.element_at("pose", 4 * i + 4).alias(f"b{i}") for i in range(3)))
    both = a.join(b, ["sensor_id", "frame_id"])
    sums = [F.covar_pop(f"b{i}", f"a{j}").alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    row = both.agg(*sums, *(F.avg(f"{n}{i}").alias(f"m{n}{i}") for n in "ab" for i in range(3))).first()
    u, _, v = np.linalg.svd(np.array([[row[f"c{i}{j}"] or 0.0 for j in range(3)] for i in range(3)]))
    out = np.eye(4)
    out[:3, :3] = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0]) @ v
    ma, mb = (np.array([row[f"m{n}{i}"] or 0.0 for i in range(3)]) for n in "ab")
    out[:3, 3] = mb - out[:3, :3] @ ma
    return out


def moved_trajectory(trajectory: DataFrame, t: np.ndarray) -> DataFrame:
    """Every pose multiplied by ``t`` from the left."""
    p = [F.element_at("pose", i) for i in range(1, 13)]
    new = [
        sum((F.lit(float(t[i, k])) * p[4 * k + j] for k in range(3)), F.lit(float(t[i, 3]) if j == 3 else 0.0))
        for i in range(3)
        for j in range(4)
    ]
    return trajectory.withColumn("pose", F.array(*new))


def absolute_error(estimated: DataFrame, truth: DataFrame, aligned: bool = False) -> DataFrame:
    """Root mean square and standard deviation of the position error by sensor; after a rigid alignment of all if ``aligned``."""
    if aligned:
        estimated = moved_trajectory(estimated, alignment(estimated, truth))
    a = estimated.select("sensor_id", "frame_id", *(F.element_at("pose", 4 * i + 4).alias(f"a{i}") for i in range(3)))
    b = truth.select("sensor_id", "frame_id", *(F.element_at("pose", 4 * i + 4).alias(f"b{i}") for i in range(3)))
    sq = sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(3)), F.lit(0.0))
    e = a.join(b, ["sensor_id", "frame_id"]).withColumn("e", F.sqrt(sq))
    return e.groupBy("sensor_id").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_pop("e").alias("std"), F.count(F.lit(1)).alias("n"))


def relative_error(estimated: DataFrame, truth: DataFrame, step: int = 1) -> DataFrame:
    """The same for the translation between frames ``step`` apart, each in its own first frame's axes."""

    def moved(poses: DataFrame, prefix: str) -> DataFrame:
        order = Window.partitionBy("sensor_id").orderBy("frame_id")
        later = F.lead("pose", step).over(order)
        p = poses.select("sensor_id", "frame_id", "pose", later.alias("next")).where("next IS NOT NULL")
        d = [F.element_at("next", 4 * i + 4) - F.element_at("pose", 4 * i + 4) for i in range(3)]
        own = [sum((F.element_at("pose", 4 * i + j + 1) * d[i] for i in range(3)), F.lit(0.0)) for j in range(3)]
        return p.select("sensor_id", "frame_id", *(c.alias(f"{prefix}{j}") for j, c in enumerate(own)))

    both = moved(estimated, "a").join(moved(truth, "b"), ["sensor_id", "frame_id"])
    e = both.withColumn("e", F.sqrt(sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(3)), F.lit(0.0))))
    return e.groupBy("sensor_id").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_pop("e").alias("std"), F.count(F.lit(1)).alias("n"))


def distance_error(estimated: DataFrame, truth: DataFrame, length: float) -> DataFrame:
    """The relative error over stretches of at least ``length`` along the true path, each from its first frame."""
    order = Window.partitionBy("sensor_id").orderBy("frame_id")
    at = [F.element_at("pose", 4 * i + 4) for i in range(3)]
    step = F.sqrt(sum(((c - F.lag(c).over(order)) ** 2 for c in at), F.lit(0.0)))
    path = truth.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("way", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = f"min(frame_id) OVER (PARTITION BY sensor_id ORDER BY way RANGE BETWEEN {float(length)!r}D FOLLOWING AND UNBOUNDED FOLLOWING)"
    pairs = path.select("sensor_id", "frame_id", F.expr(later).alias("later")).where("later IS NOT NULL")

    def moved(poses: DataFrame, prefix: str) -> DataFrame:
        a = pairs.join(poses.select("sensor_id", "frame_id", "pose"), ["sensor_id", "frame_id"])
        b = poses.select("sensor_id", F.col("frame_id").alias("later"), F.col("pose").alias("next"))
        both = a.join(b, ["sensor_id", "later"])
        d = [F.element_at("next", 4 * i + 4) - F.element_at("pose", 4 * i + 4) for i in range(3)]
        own = [sum((F.element_at("pose", 4 * i + j + 1) * d[i] for i in range(3)), F.lit(0.0)) for j in range(3)]
        return both.select("sensor_id", "frame_id", *(c.alias(f"{prefix}{j}") for j, c in enumerate(own)))

    e = moved(estimated, "a").join(moved(truth, "b"), ["sensor_id", "frame_id"])
    e = e.withColumn("e", F.sqrt(sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(3)), F.lit(0.0))))
    return e.groupBy("sensor_id").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_pop("e").alias("std"), F.count(F.lit(1)).alias("n"))


def summarize(values: DataFrame, column: str, order: str) -> DataFrame:
    """mean, std (population), median and the last value by ``order`` of a numeric column."""
    return values.agg(
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.median(column).alias("median"),
        F.max_by(column, order).alias("last"),
        F.count(column).alias("n"),
    )
