import os
import struct

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pointloom.plans.odometry import run
from pointloom.sources import files
from pointloom.streaming import odometry
from pointloom.streaming.odometry import scan_to_model
from tests.test_registration import walk


def test_float4_round_trip(spark, tmp_path):
    frames, _ = walk(spark, 3)
    written = files.write_float4(frames, f"file://{tmp_path}/scans").collect()
    assert sorted(r["path"] for r in written) == sorted(str(f) for f in (tmp_path / "scans").iterdir())  # no parts are left
    files.write_float4(frames, str(tmp_path / "scans"))  # again: the same files
    back = files.read_scan_folder(spark, str(tmp_path / "scans"))
    a = {(r["frame_id"], r["point_id"]): np.float32(r["x"]) for r in frames.collect()}
    b = {(r["frame_id"], r["point_id"]): r["x"] for r in back.collect()}
    assert a.keys() == b.keys() and all(np.float64(a[k]) == b[k] for k in a)
    assert files.read_scan_folder(spark, str(tmp_path / "scans"), max_frames=2).select("frame_id").distinct().count() == 2
    (tmp_path / "odd.bin").write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6) + b"xy")
    assert [tuple(r)[1:] for r in files.read_float4(spark, str(tmp_path / "odd.bin")).collect()] == [(0, 1.0, 2.0, 3.0)]


HEADER = "ply\nformat {} 1.0\ncomment c\nelement vertex 2\nproperty {} x\nproperty {} y\nproperty {} z\nproperty uchar red\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"


@pytest.mark.parametrize(("form", "kind", "code"), [("binary_little_endian", "float", "<3fB"), ("binary_big_endian", "double", ">3dB"), ("ascii", "float", None)])
def test_ply(spark, tmp_path, form, kind, code):
    rows = [(1.0, 2.0, 3.0, 4), (-1.5, 0.25, 9.0, 255)]
    body = b"".join(struct.pack(code, *r) for r in rows) if code else "".join(" ".join(map(str, r)) + "\n" for r in rows).encode()
    (tmp_path / "a.ply").write_bytes(HEADER.format(form, kind, kind, kind).encode() + body)
    got = files.read_ply(spark, str(tmp_path / "a.ply")).orderBy("point_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [r[:3] for r in rows]


def test_ply_errors():
    for bad in (b"no", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float a\nend_header\n1\n"):
        with pytest.raises(ValueError):
            files.decode_ply(bad)


def test_messages(spark):
    data = struct.pack("<5f", 9, 1, 2, 3, 0) + struct.pack("<5f", 9, float("nan"), 2, 3, 0) + struct.pack("<5f", 9, 4, 5, 6, 0)
    rows = [(7, 20, {"i": 0, "x": 4, "y": 8, "z": 12}, bytearray(data)), (8, 20, {"x": 4}, bytearray(data)), (9, 0, {}, bytearray()), (10, 20, {"x": 4, "y": 8, "z": 12}, None), (11, None, None, None), (12, 20, {"x": 4, "y": 8, "z": None}, bytearray(data))]
    df = spark.createDataFrame(rows, "cloud_id long, point_step int, offsets map<string,int>, data binary")
    assert [tuple(r) for r in files.unpack_messages(df).collect()] == [(7, 0, 1.0, 2.0, 3.0), (7, 2, 4.0, 5.0, 6.0)]
    points = spark.createDataFrame([(1, 1, 4.0, 5.0, 6.0, 0.0, 0.0, 1.0), (1, 0, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0)], "cloud_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    packed = files.pack_messages(points, with_normals=True).first()
    assert packed["point_step"] == 24 and packed["width"] == 2 and struct.unpack("<12f", packed["data"])[:6] == (1, 2, 3, 1, 0, 0)


def test_trajectory_file(spark, tmp_path):
    _, truth = walk(spark, 2)
    files.write_trajectory(truth, str(tmp_path / "t"))
    lines = [line for f in (tmp_path / "t").glob("part*") for line in f.read_text().splitlines()]
    assert len(lines) == 2 and lines[0].startswith("1.000000 0.000000 ") and len(lines[1].split()) == 12


def test_stream_equals_batch(spark, tmp_path):
    frames, _ = walk(spark, 4)
    files.write_float4(frames, f"file://{tmp_path}/scans")
    for k, f in enumerate(sorted((tmp_path / "scans").glob("*.bin"))):  # a stream takes files in the order of their times
        os.utime(f, (1_000_000 + k, 1_000_000 + k))
    how = {"leaf": 0.1, "voxel": 0.5}
    stream = scan_to_model(files.stream_scan_folder(spark, str(tmp_path / "scans"), sensor_id=1), **how)
    query = stream.writeStream.format("memory").queryName("poses").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["frame_id"]: r["pose"] for r in spark.table("poses").collect()}
    want = {r["frame_id"]: r["pose"] for r in run(frames, "vgicp_model", **how).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


def test_late_split_and_unnumbered_frames_end_the_stream(spark, tmp_path):
    def run_over(name, numbers):
        folder = tmp_path / name
        folder.mkdir()
        for k, n in enumerate(numbers):
            (folder / f"scan{n}.bin").write_bytes(np.random.default_rng(k).normal(size=(50, 4)).astype("<f4").tobytes())
            os.utime(folder / f"scan{n}.bin", (1_000_000 + k, 1_000_000 + k))
        stream = scan_to_model(files.stream_scan_folder(spark, str(folder)), leaf=0.1)
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r["frame_id"] for r in spark.table(name).collect())

    assert run_over("in_order", ["001", "002", "10"]) == [1, 2, 10]
    for name, numbers in (("late", ["001", "003", "002"]), ("split", ["001", "0001"]), ("unnumbered", ["001", "x"])):
        with pytest.raises(StreamingQueryException):
            run_over(name, numbers)


def test_a_sensor_of_many_batches(spark):
    """One scan is held at a time: poses come out while later batches haven't been read."""
    frames, _ = walk(spark, 4)
    rows = frames.withColumn("sensor_id", F.lit(1)).union(frames.withColumn("sensor_id", F.lit(2))).toPandas()
    rows = rows.sort_values(["sensor_id", "frame_id", "point_id"], ignore_index=True)
    read = []

    def batches(size):
        for a in range(0, len(rows), size):
            read.append(a)
            yield rows.iloc[a : a + size]

    scans = odometry._scans(batches(37))
    first = next(scans)
    assert first[:2] == (1, 0) and len(read) < 0.2 * len(rows) / 37
    assert [s[:2] for s in scans] == [(s, f) for s in (1, 2) for f in range(4)][1:]
    both = {}
    for size in ("29", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = odometry.scan_to_model_batch(frames.union(frames.withColumn("sensor_id", F.col("sensor_id") + 1)), leaf=0.1, voxel=0.5).collect()
        both[size] = {(r["sensor_id"], r["frame_id"]): r["pose"] for r in out}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert both["29"] == both["100000"] and len(both["29"]) == 8


def test_command_line(spark, tmp_path):
    from pointloom.cli import main

    frames, _ = walk(spark, 3)
    files.write_float4(frames, f"file://{tmp_path}/scans")
    main([str(tmp_path / "scans"), str(tmp_path / "out"), "--engine", "vgicp", "--downsampling-resolution", "0.1", "--voxel-resolution", "0.5"])
    lines = [line for f in (tmp_path / "out").glob("part*") for line in f.read_text().splitlines()]
    assert len(lines) == 3 and abs(float(lines[1].split()[3]) - 0.1) < 0.03
