"""Scan-to-model odometry as a structured stream keyed by sensor."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.schema import TRAJECTORY, XYZ
from pointloom.streaming.voxelmap import ModelOdometry


#: Poses that are held before they come out.
POSE_ROWS = 256


def poses_of(model: ModelOdometry, points: pd.DataFrame) -> tuple[list[int], list[list[float]]]:
    """Push the frames of ``points`` in order; frame ids and poses (3 x 4, by rows)."""
    ids, poses = [], []
    for frame, own in points.sort_values(["frame_id", "point_id"], kind="stable").groupby("frame_id", sort=True):
        poses.append(model.push(own[list(XYZ)].to_numpy(dtype=np.float64))[:3].ravel().tolist())
        ids.append(int(frame))
    return ids, poses


def scan_to_model(frames: DataFrame, **how) -> DataFrame:
    """(sensor_id, frame_id, pose) of a stream of sensor_id, frame_id, point_id, x, y, z.

    A sensor's frames come in order and whole (they are sorted within a micro-batch). A frame that
    is not after the last one of its sensor came late or was split over micro-batches, and a frame without a number has no
    place: both end the stream with an error, since the pose of every later frame would be wrong.
    The state of a sensor is its map and pose, bounded by the map's count-based eviction. ``how`` sets up ModelOdometry.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = ModelOdometry.load(state.get[0]) if state.exists else ModelOdometry(**how)
        rows = list(batches)
        points = pd.concat(rows) if rows else pd.DataFrame({"frame_id": []})
        if points["frame_id"].isna().any():
            raise ValueError(f"sensor {key[0]}: a frame has no number")
        if len(points) and model.last_frame is not None and points["frame_id"].min() <= model.last_frame:
            raise ValueError(f"sensor {key[0]}: frame {int(points['frame_id'].min())} came late or in parts, after frame {model.last_frame}")
        ids, poses = poses_of(model, points) if len(points) else ([], [])
        model.last_frame = max(ids, default=model.last_frame)
        state.update((model.dump(),))
        yield pd.DataFrame({"sensor_id": [int(key[0])] * len(ids), "frame_id": ids, "pose": poses})

    return frames.groupBy("sensor_id").applyInPandasWithState(step, TRAJECTORY, "model binary", "append", GroupStateTimeout.NoTimeout)


def _scans(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sensor, frame and points of each scan of rows sorted by sensor, frame and point; one scan is held at a time."""
    at, held = None, []
    for batch in batches:
        for key, own in batch.groupby(["sensor_id", "frame_id"], sort=False):
            if key != at and held:
                yield *at, np.concatenate(held)
                held = []
            at = key
            held.append(own[list(XYZ)].to_numpy(dtype=np.float64))
    if held:
        yield *at, np.concatenate(held)


def scan_to_model_batch(frames: DataFrame, **how) -> DataFrame:
    """The same over a whole table: a sensor's frames are sequential, sensors are parallel. Frames without a number are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sensor, scans in groupby(_scans(batches), key=lambda x: x[0]):
            model = ModelOdometry(**how)
            posed = ((frame, model.push(xyz)[:3].ravel().tolist()) for _, frame, xyz in scans)  # noqa: B023
            while some := list(islice(posed, POSE_ROWS)):
                yield pd.DataFrame({"sensor_id": [int(sensor)] * len(some), "frame_id": [int(f) for f, _ in some], "pose": [p for _, p in some]})

    rows = frames.where("sensor_id IS NOT NULL AND frame_id IS NOT NULL").select("sensor_id", "frame_id", "point_id", *XYZ)
    return rows.repartition("sensor_id").sortWithinPartitions("sensor_id", "frame_id", "point_id").mapInPandas(run, TRAJECTORY)
