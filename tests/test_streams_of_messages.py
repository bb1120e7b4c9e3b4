"""Messages as streams: parts of a bounded size, and frames that span Arrow batches."""

import numpy as np
import pyarrow as pa

from pointloom.sources import files


def test_long_messages_come_out_in_parts():
    xyz = np.arange(3 * 150_000, dtype="<f4").reshape(-1, 3)
    xyz[70_000, 1] = np.nan
    kind = pa.map_(pa.string(), pa.int32())
    batch = pa.RecordBatch.from_pydict({"cloud_id": pa.array([5]), "point_step": pa.array([12], pa.int32()), "offsets": pa.array([[("x", 0), ("y", 4), ("z", 8)]], kind), "data": pa.array([xyz.tobytes()])})
    parts = list(files._unpacked(iter([batch])))
    assert max(p.num_rows for p in parts) <= files.PART_POINTS
    ids = np.concatenate([p.column(1).to_numpy() for p in parts])
    assert (ids == np.delete(np.arange(150_000), 70_000)).all() and (np.concatenate([p.column(4).to_numpy() for p in parts]) == xyz[ids, 2]).all()


def test_frames_that_span_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(f) if f else None, int(i), *map(float, rng.integers(0, 99, 3))) for i, f in enumerate(rng.integers(0, 4, 500))]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        packed = {r["cloud_id"]: r for r in files.pack_messages(df).collect()}
        sizes = {r["frame_id"]: len(r["content"]) for r in files.float4_files(df.withColumnRenamed("cloud_id", "frame_id")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for f in (None, 1, 2, 3):
        own = [r[2:] for r in rows if r[0] == f]
        assert packed[f]["width"] == len(own) and sizes[f] == 16 * len(own) and (np.frombuffer(packed[f]["data"], "<f4").reshape(-1, 3) == own).all()
    assert len(packed) == len(sizes) == 4
