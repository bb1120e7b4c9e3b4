"""Voxel maps as tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.expr import global_index
from pointloom.operators.checkpoints import numbered
from pointloom.operators.sampling import with_voxels
from pointloom.schema import COV, XYZ

#: A cell of a flat map holds so many points, none nearer to another than the square root of this.
CELL_POINTS, CELL_SQ_SPACING = 10, 0.01
LRU_HORIZON, LRU_CYCLE = 100, 10
#: Rows of a map with own contents that are held at a time.
FOLD_ROWS = 1024


def gaussian_voxelmap(points: DataFrame, leaf: float) -> DataFrame:
    """Per voxel: vx, vy, vz, n, the mean point, and the mean of the points' covariances if they have any."""
    cov = [c for c in COV if c in points.columns]
    return with_voxels(points, leaf).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in (*XYZ, *cov)))


def _fold(cell_points: int, sq_spacing: float):
    """Rows come sorted by voxel and order; those come out that their voxel keeps, with their slots.

    The first row that is left is kept and takes those near it along, until a voxel is full:
    the same as going through the rows one by one, but all voxels of a batch at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros((0, 3))  # the last voxel so far and the points that it has kept
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, xyz = (np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1) for names in (("vx", "vy", "vz"), XYZ))
            start = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
            group = np.cumsum(start) - 1
            slots = np.full(len(cell), -1)
            taken = np.zeros(group[-1] + 1, np.int64)
            left = np.arange(len(cell))
            if last is not None and (cell[0] == last).all():
                taken[0] = len(held)
                own = np.flatnonzero(group == 0)
                for p in held:
                    own = own[((xyz[own] - p) ** 2).sum(axis=1) >= sq_spacing]
                left = np.concatenate([own, left[group > 0]])
            else:
                held = np.zeros((0, 3))
            while len(left := left[taken[group[left]] < cell_points]):
                first = np.concatenate([[True], group[left][1:] != group[left][:-1]])
                new = left[first]
                slots[new] = taken[group[new]]
                taken[group[new]] += 1
                by = new[np.cumsum(first) - 1]  # the row that was kept in each one's voxel
                left = left[((xyz[left] - xyz[by]) ** 2).sum(axis=1) >= sq_spacing] if sq_spacing > 0 else left[~first]
            keep = slots >= 0
            at_end = np.flatnonzero(keep & (group == group[-1]))
            held = np.concatenate([held if group[-1] == 0 else held[:0], xyz[at_end]])
            last = cell[-1]
            yield batch.append_column("slot", pa.array(slots)).filter(pa.array(keep))

    return run


def flat_voxelmap(points: DataFrame, leaf: float, seq: str = "point_id", cell_points: int = CELL_POINTS, sq_spacing: float = CELL_SQ_SPACING) -> DataFrame:
    """The points that a bounded map keeps: in order of ``seq``, at most so many a voxel and none too near another.

    The choice depends on the order, so a voxel's points pass one task as a sorted
    stream; only the few that were kept are held.
    """
    rows = with_voxels(points, leaf)
    ordered = rows.repartition("vx", "vy", "vz").sortWithinPartitions("vx", "vy", "vz", seq)
    return ordered.mapInArrow(_fold(cell_points, sq_spacing), rows.schema.add("slot", "long"))


def fold_voxels(points: DataFrame, leaf: float, fold, schema: str, seq: str = "point_id") -> DataFrame:
    """A map with contents of one's own: ``fold(cell, rows) -> rows`` over the points of each voxel in order of ``seq``.

    ``fold`` gets (vx, vy, vz) and an iterator of dictionaries, and yields dictionaries of ``schema``; a voxel's
    points pass one task as a sorted stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        found = (out for cell, own in groupby(rows, key=lambda r: (r["vx"], r["vy"], r["vz"])) for out in fold(cell, own))
        while some := list(islice(found, FOLD_ROWS)):
            yield pa.RecordBatch.from_pylist(some)

    rows = with_voxels(points, leaf)
    return rows.repartition("vx", "vy", "vz").sortWithinPartitions("vx", "vy", "vz", seq).mapInArrow(run, schema)


def map_indices(voxels: DataFrame) -> DataFrame:
    """``voxels`` with voxel_id (0, 1, ... in the order of coordinates) and the global index of each point of a flat map."""
    order = ["vx", "vy", "vz"]
    cells = numbered(voxels.select(*order).distinct(), order, "voxel_id")
    return voxels.join(cells, order).withColumn("global_index", global_index(F.col("voxel_id"), F.col("slot")))


def map_cloud(voxels: DataFrame) -> DataFrame:
    """A map as a cloud, to be the source of an alignment.

    A Gaussian map has a point for each voxel, its mean, with the voxel's number as point_id; a flat map
    (with slots) has its points, with their global index.
    """
    order = ["vx", "vy", "vz"]
    if "slot" in voxels.columns:
        return map_indices(voxels).withColumn("point_id", F.col("global_index")).drop(*order, "slot", "voxel_id", "global_index")
    return voxels.join(numbered(voxels.select(*order), order, "point_id"), order).drop(*order)


def lru_survivors(frames: DataFrame, leaf: float, horizon: int = LRU_HORIZON, cycle: int = LRU_CYCLE) -> DataFrame:
    """The voxels left after inserting frames 0, 1, ... in order: vx, vy, vz, last_frame.

    ``frames`` has frame_id, counted from 0 without gaps. After every ``cycle``
    inserts, voxels not touched for more than ``horizon`` inserts go; a voxel that
    comes back later is a new one, which the last touch alone decides.
    """
    touched = with_voxels(frames, leaf).groupBy("vx", "vy", "vz").agg(F.max("frame_id").alias("last_frame"))
    inserts = frames.agg((F.max("frame_id") + 1).alias("inserts"))
    sweep = F.floor(F.col("inserts") / cycle) * cycle  # the last insert count at which a sweep ran
    gone = (sweep > F.col("last_frame")) & (F.col("last_frame") + horizon < sweep)
    return touched.join(F.broadcast(inserts), F.lit(True)).where(~gone).select("vx", "vy", "vz", "last_frame")
