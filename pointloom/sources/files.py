"""Point files: float records, PLY, packed messages, and trajectories.

Files are read by Spark's binary source, so any store that Spark reads will do, and
decoded in Arrow batches on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.checkpoints import cut, numbered
from pointloom.schema import NORMAL, XYZ

#: Points that are read out of a file or message at a time.
PART_POINTS = 65536
_OUT = "path string, point_id long, x double, y double, z double"


def _emit(path: str, xyz: np.ndarray, first: int) -> pa.RecordBatch:
    n = len(xyz)
    cols = [pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), *(pa.array(np.ascontiguousarray(xyz[:, i], dtype=np.float64)) for i in range(3))]
    return pa.RecordBatch.from_arrays(cols, names=["path", "point_id", *XYZ])


def _decoded(files: DataFrame, decode) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "content")), strict=True):
                xyz = decode(content)
                for a in range(0, max(len(xyz), 1), PART_POINTS):
                    yield _emit(path, xyz[a : a + PART_POINTS], a)

    return files.select("path", "content").mapInArrow(run, _OUT)


def decode_float4(content: bytes) -> np.ndarray:
    """Little-endian float records (x, y, z, intensity); a rest of less than a record is ignored."""
    n = len(content) // 16
    return np.frombuffer(content, "<f4", 4 * n).reshape(n, 4)[:, :3]


def decoded_float4(files: DataFrame) -> DataFrame:
    """Points of the contents of such files (path, content): path, point_id (the position in its file), x, y, z."""
    return _decoded(files, decode_float4)


def read_float4(spark: SparkSession, path: str) -> DataFrame:
    """Points of headerless files: path, point_id (the position in its file), x, y, z."""
    return decoded_float4(spark.read.format("binaryFile").load(path))


def with_frames(points: DataFrame, max_frames: int | None = None) -> DataFrame:
    """``points`` with frame_id: files numbered from 0 in the order of their paths."""
    ids = numbered(points.select("path").distinct(), ["path"], "frame_id")
    if max_frames is not None:
        ids = ids.where(F.col("frame_id") < max_frames)
    return points.join(ids, "path").select("frame_id", "point_id", *XYZ)


def read_scan_folder(spark: SparkSession, folder: str, max_frames: int | None = None) -> DataFrame:
    """A folder of scans, one ``.bin`` file a frame, in the order of their names: frame_id, point_id, x, y, z."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return with_frames(_decoded(files, decode_float4), max_frames)


def stream_scan_folder(spark: SparkSession, folder: str, sensor_id: int = 0, files_per_batch: int = 1) -> DataFrame:
    """The same as a stream: sensor_id, frame_id (the number that the file's name ends with; null if there is none), point_id, x, y, z.

    Files come in the order of their modification times.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", files_per_batch).load(folder)
    frame = F.regexp_extract("path", r"(\d+)\.bin$", 1).try_cast("long")
    return _decoded(files, decode_float4).select(F.lit(sensor_id).cast("long").alias("sensor_id"), frame.alias("frame_id"), "point_id", *XYZ)


# Fixed values of the PLY format.
_PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def decode_ply(content: bytes) -> np.ndarray:
    """The vertices' x, y, z of a PLY file, text or binary, whatever other properties a vertex has."""
    end = content.find(b"end_header")
    if not content.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    body = content.index(b"\n", end) + 1
    form, count, fields, before, element = "ascii", 0, [], 0, None
    for line in content[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            form = words[1]
        elif words[0] == "element":
            element = words[1]
            if element == "vertex":
                count = int(words[2])
            elif not fields:
                before += int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices aren't read")
            fields.append((words[2].lower(), _PLY_TYPES[words[1]]))
    names = [n for n, _ in fields]
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("vertices have no x, y, z")
    if form == "ascii":
        lines = content[body:].decode("ascii", "replace").split("\n")[before : before + count]
        rows = np.array([[float(v) for v in x.split()[: len(names)]] for x in lines if x.strip()]).reshape(-1, len(names))
        return rows[:, [names.index(c) for c in XYZ]]
    if before:
        raise ValueError("binary files with elements before the vertices aren't read")
    kind = np.dtype([(n, ("<" if form == "binary_little_endian" else ">") + t) for n, t in fields])
    rows = np.frombuffer(content, kind, count, body)
    return np.stack([rows[c].astype(np.float64) for c in XYZ], axis=1)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark.read.format("binaryFile").load(path), decode_ply)


# --- packed messages --------------------------------------------------------------


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of messages, a part of a message at a time."""
    for batch in batches:
        ids, steps, fields, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("cloud_id", "point_step", "offsets", "data"))
        for at in range(batch.num_rows):
            offsets, step, data = dict(fields[at].as_py() or []), steps[at].as_py() or 0, contents[at].as_buffer()
            if step <= 0 or data is None or any(offsets.get(c) is None for c in XYZ):
                continue
            n = len(data) // step
            raw = np.frombuffer(data, np.uint8, n * step).reshape(n, step)
            for a in range(0, n, PART_POINTS):
                part = raw[a : a + PART_POINTS]
                xyz = np.stack([part[:, offsets[c] : offsets[c] + 4].copy().view("<f4")[:, 0] for c in XYZ], axis=1).astype(np.float64)
                own = np.flatnonzero(np.isfinite(xyz).all(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at].as_py()] * len(own), pa.int64()), pa.array(own + a), *(pa.array(xyz[own, i]) for i in range(3))], names=["cloud_id", "point_id", *XYZ]
                )


def unpack_messages(messages: DataFrame) -> DataFrame:
    """Points of packed clouds: cloud_id, point_id, x, y, z; points with a coordinate that isn't finite are left out.

    ``messages`` has cloud_id, point_step, offsets (map of field name to byte
    offset) and data; fields are 32-bit little-endian floats. A message without x, y
    and z, or without data, gives no points.
    """
    return messages.select("cloud_id", "point_step", "offsets", "data").mapInArrow(_unpacked, "cloud_id long, point_id long, x double, y double, z double")


def pack_messages(points: DataFrame, with_normals: bool = False) -> DataFrame:
    """The reverse: cloud_id, width, point_step, offsets, data, with points in the order of their ids."""
    names = [*XYZ, *(NORMAL if with_normals else ())]

    def message(key: int | None, data: pa.Buffer) -> pa.RecordBatch:
        step = 4 * len(names)
        return pa.RecordBatch.from_pydict(
            {
                "cloud_id": pa.array([key], pa.int64()),
                "width": pa.array([len(data) // step], pa.int64()),
                "point_step": pa.array([step], pa.int32()),
                "offsets": pa.array([[(n, 4 * i) for i, n in enumerate(names)]], pa.map_(pa.string(), pa.int32())),
                "data": _one(data),
            }
        )

    return _packed(points, "cloud_id", names, lambda rows: rows, message, "cloud_id long, width long, point_step int, offsets map<string,int>, data binary")


def _one(data: pa.Buffer) -> pa.Array:
    """A column with one binary value, without a copy of it."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), data])


def _packed(points: DataFrame, by: str, names: list[str], encode: Callable[[np.ndarray], np.ndarray], message: Callable[[int | None, pa.Buffer], pa.RecordBatch], schema: str) -> DataFrame:
    """A row for each value of ``by``, of its points as 32-bit floats in the order of their ids.

    Points come as a sorted stream, so that a task holds the bytes of one message, not its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, None
        for batch in batches:
            keys = batch.column(0)
            own = np.stack([keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)], axis=1)
            rows = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype("<f4") for i in range(len(names))], axis=1)
            ends = np.append(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1, len(own)) if len(own) else []
            a = 0
            for b in ends:
                key = keys[a].as_py()
                if out is None or key != last:
                    if out is not None:
                        yield message(last, out.getvalue())
                    last, out = key, pa.BufferOutputStream()
                out.write(np.ascontiguousarray(encode(rows[a:b]), "<f4").tobytes())
                a = b
        if out is not None:
            yield message(last, out.getvalue())

    ordered = points.select(by, "point_id", *names).repartition(by).sortWithinPartitions(F.col(by), F.col("point_id").asc_nulls_last())
    return ordered.select(by, *names).mapInArrow(run, schema)


def encode_float4(xyz: np.ndarray) -> bytes:
    return _float4(xyz).tobytes()


def _float4(xyz: np.ndarray) -> np.ndarray:
    return np.concatenate([xyz, np.ones((len(xyz), 1))], axis=1).astype("<f4")


def float4_files(points: DataFrame) -> DataFrame:
    """One row for each frame: frame_id and the content of its file, points in the order of their ids."""

    def file(key: int | None, data: pa.Buffer) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"frame_id": pa.array([key], pa.int64()), "content": _one(data)})

    return _packed(points, "frame_id", list(XYZ), _float4, file, "frame_id long, content binary")


def write_float4(points: DataFrame, folder: str) -> DataFrame:
    """One ``.bin`` file a frame in a folder that all executors share; frame_id and path of each.

    Executors write: a file gets a name of its own and then, when it is whole, the frame's, so that a
    task that runs again leaves the same files. ``folder`` is a path or an address that Arrow's file systems know.
    """
    files, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            ids, paths = batch.column(batch.schema.get_field_index("frame_id")), []
            for frame, content in zip(ids.to_pylist(), batch.column(batch.schema.get_field_index("content")), strict=True):
                path = f"{root}/{frame:06d}.bin"
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([ids, pa.array(paths, pa.string())], names=["frame_id", "path"])

    written = float4_files(points).mapInArrow(run, "frame_id long, path string")
    return cut(written)


def trajectory_lines(trajectory: DataFrame) -> DataFrame:
    """One line for each frame: the 3 x 4 pose by rows, six decimals each."""
    numbers = [F.format_string("%.6f", F.element_at("pose", i)) for i in range(1, 13)]
    return trajectory.select("sensor_id", "frame_id", F.concat_ws(" ", *numbers).alias("line"))


def write_trajectory(trajectory: DataFrame, path: str) -> None:
    """Lines in the order of sensors and frames, over as many files as the sort has ranges, named in that order."""
    trajectory_lines(trajectory).orderBy("sensor_id", "frame_id").select("line").write.mode("overwrite").text(path)


def to_double(points: DataFrame, *names: str) -> DataFrame:
    """Float columns as doubles."""

    def wide(c: str) -> Column:
        return F.col(c).cast("double").alias(c)

    chosen = names or XYZ
    return points.select(*[wide(c) if c in chosen else F.col(c) for c in points.columns])
