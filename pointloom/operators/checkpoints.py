"""Cutting the lineage of iterative plans, and numbering rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> None:
    """Make sure that the session has a checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that all executors share. Only a session whose
    executors are threads of the driver, as in tests, gets a temporary folder, which goes with the process.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pointloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and continue from there."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in ``order``, which must tell all rows apart.

    Rows are numbered inside range partitions; only the partitions' sizes meet in one place.
    """
    low = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__part", F.shiftright(low, 33)).withColumn("__row", low.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row a partition
    return dealt.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + F.col("__row")).alias(name))
