"""Command line: odometry over a folder of scans.

python -m pointloom.cli FOLDER OUT [--engine gicp] [--downsampling-resolution 0.25] ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointloom.plans import odometry
from pointloom.sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--engine", choices=sorted(odometry.ENGINES), default="gicp")
    parser.add_argument("--downsampling-resolution", type=float, default=0.25)
    parser.add_argument("--num-neighbors", type=int, default=10)
    parser.add_argument("--voxel-resolution", type=float, default=1.0)
    parser.add_argument("--max-frames", type=int, default=1_000_000)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("odometry").getOrCreate()
    frames = files.read_scan_folder(spark, given.folder, given.max_frames).withColumn("sensor_id", F.lit(0).cast("long"))
    how = {"leaf": given.downsampling_resolution, "k": given.num_neighbors, "voxel": given.voxel_resolution}
    files.write_trajectory(odometry.run(frames, given.engine, **how), given.out)


if __name__ == "__main__":
    main()
