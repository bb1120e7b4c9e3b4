"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm._util import batches_of, column, cut_lineage

#: So many edges (16 MB) are joined up in one task; more go through rounds over all tasks.
TASK_EDGES = 1 << 20


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges (child, parent) and the smallest node of its component."""
    ends = [np.stack([column(b, c).to_numpy() for c in ("child", "parent")]) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):  # hook the larger root onto the smaller, then point every node at its root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield batches_of({"node": pa.array(nodes), "root": pa.array(nodes[root])})


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("child", "parent")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): root is the component's smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).
    Every step replaces edges by as many or fewer, minima are pre-aggregated
    before the shuffle, and only two numbers a round reach the driver. Nodes
    without an edge to another node are not returned. Edges with a null end and
    loops are left out. No more than ``task_edges`` edges, a number that is checked, are joined up
    in one task instead, with the same result; rounds that don't settle are an error.
    """
    links = cut_lineage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    state = _state(links)
    if state[0] <= task_edges:
        return links.coalesce(1).mapInArrow(_joined_up, "node long, root long")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = links.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(
            links.select("parent", "child")
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        )
        lowest = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(lowest, "child")
        links = cut_lineage(
            small.where("parent <> m")
            .select(F.col("parent").alias("child"), F.col("m").alias("parent"))
            .union(small.select("child", F.col("m").alias("parent")))
            .distinct()
        )
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return links.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(
        links.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    )
