"""Exact nearest neighbours over blocks of about as many points each.

Cells of a fixed width hold more points the more a cloud has, so that a join over them grows with the
square. Here planes cut space into blocks, so that a query meets about as many points in a cloud of any size. A query is
first answered by the block that is nearest to it; the k-th distance found there bounds the search, and
only the blocks whose bounds are within it are asked too. Inside a task a block is a tree in numpy.
A block's points come to its task before its queries, in one sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.schema import XYZ

#: Points of a block, the most levels of planes (beyond, blocks grow), and sampled points a block by which planes are laid.
BLOCK_POINTS, MAX_LEVELS, PLANE_POINTS = 4096, 12, 64
#: Queries of a block that one group takes; a block with more is sent to several groups.
GROUP_QUERIES = 32768
#: Points of a bucket of the tree in a task (and k at least), and children of a box that are looked at at once.
BUCKET_POINTS, FAN, TOP = 16, 8, 64
#: Queries that are searched at a time, and rows held of a block before copies of a point beyond k go.
CHUNK, HELD_ROWS = 512, 500_000

CELL = ("vx", "vy", "vz")
_TARGET, _QUERY, _FOUND = 0, 1, 2


def _least(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points and boxes, by the terms of a squared distance of points: never more than that of a point in the box."""
    d = np.maximum(np.maximum(low - q, q - high), 0.0)
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def ranks(i: np.ndarray) -> np.ndarray:
    """The position of each in its run of equal values."""
    first = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
    return np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))


def _runs(rows: np.ndarray, *last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows (then of ``last``), and in it where each run of equal rows begins."""
    order = np.lexsort((*last, *rows.T[::-1]))
    ordered = rows[order]
    return order, np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])[: len(rows)])


class Boxes:
    """Bounds of the leaves of a binary tree, and of every FAN-th part above; bounds of an empty leaf are NaN.

    Dimensions after the third are cells' coordinates, in which a query reaches from a low to a high corner.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels = [(low, high)]
        while len(low) > TOP:
            low, high = np.fmin.reduce(low.reshape(-1, FAN, low.shape[1]), axis=1), np.fmax.reduce(high.reshape(-1, FAN, high.shape[1]), axis=1)
            self.levels.append((low, high))

    def home(self, q: np.ndarray) -> np.ndarray:
        """A leaf near each query that isn't empty: that of the nearest box on each level."""
        low, high = self.levels[-1]
        at = np.empty(len(q), np.int64)
        for a in range(0, len(q), CHUNK):
            d = _least(q[a : a + CHUNK, None, :], low[None, :, :3], high[None, :, :3])
            at[a : a + CHUNK] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        for low, high in self.levels[-2::-1]:
            below = at[:, None] * FAN + np.arange(FAN)
            d = _least(q[:, None, :], low[below, :3], high[below, :3])
            at = below[np.arange(len(q)), np.where(np.isnan(d), np.inf, d).argmin(axis=1)]
        return at

    def within(self, q: np.ndarray, limit: np.ndarray, reach: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a query and a leaf that is at most so far and meets the query's reach."""
        top = len(self.levels[-1][0])
        i, j = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        for at in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[at]
            near = _least(q[i], low[j, :3], high[j, :3]) <= limit[i]
            if reach is not None:
                near &= ((low[j, 3:] <= reach[1][i]) & (high[j, 3:] >= reach[0][i])).all(axis=1)
            i, j = i[near], j[near]
            if at:
                i, j = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
        return i, j


def _reach(cells: np.ndarray | None, offsets: int) -> tuple[np.ndarray, np.ndarray] | None:
    return None if cells is None else (cells, cells) if offsets == 1 else (cells - 1, cells + 1)


class Tree:
    """A block's points in buckets; copies of a point are one with their ``k`` smallest ids.

    ``rows`` are coordinates, and cells if searches are bounded by cells.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int):
        order, start = _runs(rows, ids)
        self.ids, points = ids[order], rows[order][start]
        n = np.minimum(np.diff(np.append(start, len(ids))), k)
        perm, levels = np.arange(len(points)), 0
        bounds = np.array([0, len(points)])
        while len(points) >> (levels + 1) >= max(BUCKET_POINTS, k):
            levels += 1
        for _ in range(levels):
            at = points[perm, :3]
            side = (np.maximum.reduceat(at, bounds[:-1]) - np.minimum.reduceat(at, bounds[:-1])).argmax(axis=1)
            part = np.repeat(np.arange(len(side)), np.diff(bounds))
            perm = perm[np.lexsort((at[np.arange(len(at)), side[part]], part))]
            bounds = np.sort(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
        self.points, self.start, self.n, self.bounds = points[perm], start[perm], n[perm], bounds
        self.boxes = Boxes(np.minimum.reduceat(self.points, bounds[:-1]), np.maximum.reduceat(self.points, bounds[:-1])) if len(points) else None

    def _distances(self, q: np.ndarray, p: np.ndarray, cells: np.ndarray | None, offsets: int) -> np.ndarray:
        """Squared distances of queries and points at the same places; infinite for those in cells that aren't asked."""
        at = self.points[p]
        dx, dy, dz = (q[..., c] - at[..., c] for c in range(3))
        d = dx * dx + dy * dy + dz * dz
        if cells is not None:
            off = np.abs(at[..., 3:] - cells)
            d = np.where(off.sum(axis=-1) <= 1 if offsets == 7 else off.max(axis=-1) <= (offsets == 27), d, np.inf)
        return d

    def nearest(self, q: np.ndarray, k: int, limit: np.ndarray, cells: np.ndarray | None = None, offsets: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` nearest of each query within its limit: query, id and squared distance, in that order."""
        parts = []
        for a in range(0, len(q) if self.boxes else 0, CHUNK):
            i, ids, d = self._some(q[a : a + CHUNK], k, limit[a : a + CHUNK], None if cells is None else cells[a : a + CHUNK], offsets)
            parts.append((i + a, ids, d))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _some(self, q, k, limit, cells, offsets):
        size = int(np.diff(self.bounds).max())
        home = self.boxes.home(q)
        if size >= k:
            p = self.bounds[home][:, None] + np.arange(size)
            d = self._distances(q[:, None, :], np.minimum(p, len(self.points) - 1), None if cells is None else cells[:, None, :], offsets)
            d[p >= self.bounds[home + 1][:, None]] = np.inf
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = self.boxes.within(q, limit, _reach(cells, offsets))
        n = self.bounds[j + 1] - self.bounds[j]
        i, p = np.repeat(i, n), np.repeat(self.bounds[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = self._distances(q[i], p, None if cells is None else cells[i], offsets)
        near = (d <= limit[i]) & (d < np.inf)
        i, p, d = i[near], p[near], d[near]
        # a point that k others are before, by distance and smallest id, has no copy among the k nearest
        order = np.lexsort((self.ids[self.start[p]], d, i))
        order = order[ranks(i[order]) < k]
        i, p, d = i[order], p[order], d[order]
        n = self.n[p]
        copy = np.repeat(np.arange(len(p)), n)
        ids = self.ids[self.start[p][copy] + np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)]
        i, d = i[copy], d[copy]
        if len(copy) > len(p):
            order = np.lexsort((ids, d, i))
            order = order[ranks(i[order]) < k]
            i, d, ids = i[order], d[order], ids[order]
        return i, ids, d


@dataclass
class Planes:
    """The planes that cut space into blocks (by the nodes of a binary tree), and the bounds of blocks' points."""

    axis: np.ndarray
    cut: np.ndarray
    levels: int
    boxes: Boxes | None = None
    group: np.ndarray | None = None  # the first group of each block; one more entry at the end

    @staticmethod
    def of(points: np.ndarray, levels: int) -> Planes:
        axis, cut, parts = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, np.inf), [points]
        for node in range(len(axis)):
            own = parts[node]
            if len(own) > 1:
                side = int((own.max(axis=0) - own.min(axis=0)).argmax())
                x = np.sort(own[:, side])
                middle = x[len(x) // 2]
                axis[node], cut[node] = side, middle if middle > x[0] else x[min(np.searchsorted(x, x[0], side="right"), len(x) - 1)]
            right = own[:, axis[node]] >= cut[node]
            parts += [own[~right], own[right]]
            parts[node] = own[:0]
        return Planes(axis, cut, levels)

    def block(self, xyz: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(xyz), np.int64), np.arange(len(xyz))
        for _ in range(self.levels):
            node = 2 * node + 1 + (xyz[at, self.axis[node]] >= self.cut[node])
        return node - ((1 << self.levels) - 1)

    def groups_of(self, block: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first = self.group[block]
        return first + ids % (self.group[block + 1] - first)


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for n in names], axis=1)


def _ids(batch: pa.RecordBatch, name: str = "point_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _points(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coordinates (and cells) and ids of the points that are somewhere."""
    for batch in batches:
        rows = _numbers(batch, names)
        there = np.isfinite(rows).all(axis=1)
        if there.any():
            yield rows[there], _ids(batch)[there]


class Blocks:
    """Targets (point_id, x, y, z, and vx, vy, vz if ``cells``) in blocks; ready for searches."""

    def __init__(self, targets: DataFrame, cells: bool = False):
        self.names = (*XYZ, *(CELL if cells else ()))
        self.targets = targets.select("point_id", *(F.col(c).cast("double").alias(c) for c in self.names))
        self.n = self.targets.count()
        levels = 0
        while levels < MAX_LEVELS and self.n > BLOCK_POINTS << levels:
            levels += 1
        some = np.zeros((0, 3))
        if levels:  # only where planes lie depends on the sample; every point is in a block
            table = self.targets.select(*XYZ).sample(fraction=min(1.0, (PLANE_POINTS << levels) / self.n), seed=7).toArrow()
            some = np.stack([table.column(c).to_numpy() for c in XYZ], axis=1)
            some = np.unique(some[np.isfinite(some).all(axis=1)], axis=0)
        self.planes = Planes.of(some, levels)
        self.planes.boxes = self._bounds()
        self.planes.group = np.arange((1 << levels) + 1)
        self.queries = 0
        self._laid: DataFrame | None = None

    def _bounds(self) -> Boxes:
        names, planes, sides = self.names, self.planes, [(p + c, f) for p, f in (("lo", F.min), ("hi", F.max)) for c in self.names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = (np.full((1 << planes.levels, len(names)), v) for v in (np.inf, -np.inf))
            for rows, _ in _points(batches, names):
                block = planes.block(rows)
                order = np.argsort(block, kind="stable")
                found, first = np.unique(block[order], return_index=True)
                low[found] = np.minimum(low[found], np.minimum.reduceat(rows[order], first))
                high[found] = np.maximum(high[found], np.maximum.reduceat(rows[order], first))
            own = np.flatnonzero(low[:, 0] < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.ascontiguousarray(x[own, c])) for x in (low, high) for c in range(len(names)))], names=["block", *(s for s, _ in sides)])

        parts = self.targets.mapInArrow(run, ", ".join(["block long", *(f"{s} double" for s, _ in sides)]))
        rows = parts.groupBy("block").agg(*(f(s).alias(s) for s, f in sides)).toPandas()
        both = np.full((2, 1 << planes.levels, len(names)), np.nan)
        for at, p in enumerate(("lo", "hi")):
            both[at, rows["block"].to_numpy(np.int64)] = rows[[p + c for c in names]].to_numpy(np.float64)
        return Boxes(*both)

    def deal(self, queries: DataFrame) -> Blocks:
        """Count the queries near each block, so that searches send busy blocks to several groups."""
        planes = self.planes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << planes.levels, np.int64)
            for rows, _ in _points(batches, XYZ):
                n += np.bincount(planes.boxes.home(rows), minlength=len(n))
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["block", "n"])

        rows = queries.select("point_id", *XYZ).mapInArrow(run, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).toPandas()
        groups = np.ones(1 << planes.levels, np.int64)
        groups[rows["block"].to_numpy(np.int64)] = -(-rows["n"].to_numpy(np.int64) // GROUP_QUERIES)
        self.queries = int(rows["n"].sum())
        planes.group = np.concatenate([[0], np.cumsum(groups)])
        return self

    def _types(self) -> list[tuple[str, pa.DataType]]:
        return [("part", pa.int64()), ("kind", pa.int64()), ("id", pa.int64()), *((c, pa.float64()) for c in self.names), ("most", pa.float64()), ("found", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64()))]

    def laid(self) -> DataFrame:
        """The targets with their groups."""
        if self._laid is None:
            names, planes, rows_of = self.names, self.planes, _Rows(self._types())

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for rows, ids in _points(batches, names):
                    block = planes.block(rows)
                    n = planes.group[block + 1] - planes.group[block]
                    at = np.repeat(np.arange(len(ids)), n)
                    part = planes.group[block][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    yield rows_of(part=part, kind=_TARGET, id=ids[at], **dict(zip(names, rows[at].T, strict=True)))

            self._laid = self.targets.mapInArrow(run, rows_of.schema)
        return self._laid

    def search(self, queries: DataFrame, k: int, max_distance: float | None = None, offsets: int = 0) -> DataFrame:
        """Targets among which are the ``k`` nearest of each query (point_id, x, y, z) within ``max_distance``: query_id, point_id, sq_dist.

        With ``offsets`` only targets in so many cells around the query's (vx, vy, vz) count.
        """
        names, planes, rows_of = self.names, self.planes, _Rows(self._types())
        most = np.inf if max_distance is None else max_distance * max_distance
        asked = queries.select("point_id", *(F.col(c).cast("double").alias(c) for c in names))

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, ids in _points(batches, names):
                part = planes.groups_of(planes.boxes.home(rows[:, :3]), ids)
                yield rows_of(part=part, kind=_QUERY, id=ids, most=np.full(len(ids), most), **dict(zip(names, rows.T, strict=True)))

        spark = queries.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, (self.n + self.queries) // 200_000)
        parts = min(parts, int(planes.group[-1]))

        def met(rows: DataFrame) -> DataFrame:
            return self.laid().union(rows).repartition(parts, "part").sortWithinPartitions("part", "kind")

        first = met(asked.mapInArrow(start, rows_of.schema)).mapInArrow(_first(planes, names, k, offsets, rows_of), rows_of.schema)
        return met(first).mapInArrow(_second(names, k, offsets), "query_id long, point_id long, sq_dist double")


class _Rows:
    """Arrow batches of one schema from the columns that are given; others are null, or empty lists (null lists take Spark's writer a time that grows with the square of a batch)."""

    def __init__(self, types: list[tuple[str, pa.DataType]]):
        self.types = types
        kinds = {pa.int64(): "long", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}
        self.schema = ", ".join(f"{n} {kinds[t]}" for n, t in types)

    def __call__(self, **given) -> pa.RecordBatch:
        n = len(given["id"])
        columns = []
        for name, kind in self.types:
            x = given.get(name)
            if x is None and pa.types.is_list(kind):
                x = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind.value_type))
            elif x is None:
                x = pa.nulls(n, kind)
            elif isinstance(x, int):
                x = pa.array(np.full(n, x))
            elif isinstance(x, np.ndarray):
                x = pa.array(np.ascontiguousarray(x), kind)
            columns.append(x)
        return pa.RecordBatch.from_arrays(columns, names=[t[0] for t in self.types])


def _streams(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], k: int):
    """Runs of a sorted stream that aren't targets: kind, rows, and the tree of their block's targets."""
    part, rows, ids, tree = None, [], [], None
    for batch in batches:
        own, kind = _ids(batch, "part"), _ids(batch, "kind")
        ends = np.append(np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1, len(own)) if len(own) else []
        a = 0
        for b in ends:
            if own[a] != part:
                part, rows, ids, tree = own[a], [], [], None
            run = batch.slice(a, b - a)
            if kind[a] == _TARGET:
                rows.append(_numbers(run, names))
                ids.append(_ids(run, "id").copy())
                if sum(map(len, ids)) > HELD_ROWS:
                    rows, ids = ([np.concatenate(x)] for x in (rows, ids))
                    order, start = _runs(rows[0], ids[0])
                    first = np.zeros(len(order), np.int64)
                    first[start] = start
                    order = order[np.arange(len(order)) - np.maximum.accumulate(first) < k]
                    rows, ids = [rows[0][order]], [ids[0][order]]
            elif kind[a] == _QUERY:
                if tree is None:
                    tree = Tree(np.concatenate([np.zeros((0, len(names))), *rows]), np.concatenate([np.zeros(0, np.int64), *ids]), k)
                    rows, ids = [], []
                yield _QUERY, run, tree
            else:
                yield _FOUND, run, None
            a = b


def _asked(run: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different queries of a run (coordinates, cells and limit); the order of its rows, and the query of each row in that order."""
    rows = _numbers(run, (*names, "most"))
    order, start = _runs(rows)
    return rows[order][start], order, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))


def _spread(i: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted by query ``i`` (of n) for each row of ``which`` query: the row, and the position of the pair."""
    first = np.searchsorted(i, np.arange(n + 1))
    count = np.diff(first)[which]
    row = np.repeat(np.arange(len(which)), count)
    return row, first[which][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _first(planes: Planes, names: tuple[str, ...], k: int, offsets: int, rows_of: _Rows):
    """Queries at the block nearest to them: what they find there, and the other blocks that they must ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, tree in _streams(batches, names, k):
            query, order, which = _asked(own, names)
            ids, part = _ids(own, "id")[order], _ids(own, "part")[order]
            q, limit, cells = query[:, :3], query[:, -1], query[:, 3:-1] if offsets else None
            i, found, d = tree.nearest(q, k, limit, cells, offsets)
            n = np.bincount(i, minlength=len(q))
            limit = limit.copy()
            full = n >= k
            limit[full] = d[np.cumsum(n)[full] - 1]
            row, at = _spread(i, len(q), which)
            offset = pa.array(np.concatenate([[0], np.cumsum(n[which])]), pa.int32())
            yield rows_of(part=part, kind=_FOUND, id=ids, found=pa.ListArray.from_arrays(offset, pa.array(found[at])), dist=pa.ListArray.from_arrays(offset, pa.array(d[at])))
            home = planes.boxes.home(q)
            for a in range(0, len(q), CHUNK):
                some = slice(a, a + CHUNK)
                i, block = planes.boxes.within(q[some], limit[some], _reach(None if cells is None else cells[some], offsets))
                other = block != home[some][i]
                i, block = i[other] + a, block[other]
                sort = np.argsort(i, kind="stable")
                i, block = i[sort], block[sort]
                mine = np.flatnonzero((which >= a) & (which < a + CHUNK))
                row, at = _spread(i, len(q), which[mine])
                for c in range(0, len(row), 65536):
                    to, block_at = mine[row[c : c + 65536]], at[c : c + 65536]
                    values = query[which[to]]
                    yield rows_of(part=planes.groups_of(block[block_at], ids[to]), kind=_QUERY, id=ids[to], most=limit[which[to]], **dict(zip(names, values[:, : len(names)].T, strict=True)))

    return run


def _second(names: tuple[str, ...], k: int, offsets: int):
    """Queries at the further blocks; what the first ones found passes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, own, tree in _streams(batches, names, k):
            if kind == _FOUND:
                found = own.column(own.schema.get_field_index("found"))
                columns = [pa.array(np.repeat(_ids(own, "id"), np.diff(found.offsets.to_numpy()))), found.flatten(), own.column(own.schema.get_field_index("dist")).flatten()]
            else:
                query, order, which = _asked(own, names)
                i, found, d = tree.nearest(query[:, :3], k, query[:, -1], query[:, 3:-1] if offsets else None, offsets)
                row, at = _spread(i, len(query), which)
                columns = [pa.array(_ids(own, "id")[order][row]), pa.array(found[at]), pa.array(d[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "point_id", "sq_dist"])

    return run


def best(found: DataFrame) -> DataFrame:
    """The nearest of each query: query_id, point_id, sq_dist."""
    return found.groupBy("query_id").agg(F.min(F.struct("sq_dist", "point_id")).alias("b")).select("query_id", "b.point_id", "b.sq_dist")


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query: query_id, rank, point_id, sq_dist."""
    if k == 1:
        return best(found).select("query_id", F.lit(1).alias("rank"), "point_id", "sq_dist")
    order = Window.partitionBy("query_id").orderBy("sq_dist", "point_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "sq_dist")
