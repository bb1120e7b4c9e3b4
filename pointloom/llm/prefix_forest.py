"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a string of 32 sign bits of orthogonal random
projections and keeps the strings in a sorted array (LSH Forest, Bawa, Condie and
Ganesan 2005). All trees use one set of projections, so the forest is one; its sorted
arrays are dealt over shards by a hash of the vector, are built once, and are written
to the shared folder. Shards are even whatever the data: a hot prefix has no task of its own.

A query descends in every tree of its home shard to the longest matching prefixes,
and all trees ascend together from there. How far is not a setting but follows
from what is found (as in PUFFINN, Aumueller et al. 2019): a row at angle a shares a prefix of
L bits in one of T trees with probability 1 - (1 - (1 - a / pi)^L)^T, so
the ascent ends once a row as near as the k-th best so far would have been missed
with probability ``miss`` at most. That bounds the expected recall at every
size and for any data: few bits are given up where neighbours stand out, many where
there is no structure, and all if fewer than k rows have turned up. The k-th best of the
home shard then gives the common level at which the query visits the other
shards, which return only what is at least as good.

The inner product is not a metric; vectors get one more coordinate that makes
their lengths equal, and queries a zero there, which orders angles as inner
products (Bachrach et al. 2014).

A task holds one shard's arrays and streams a bounded number of queries past them; a lost
task is repeated alone. Equal vectors are indexed once, with the k + 1 smallest of their ids: no
other of them can be among a query's k nearest, since ties go to the smaller id.

Every query looks into every shard, if only for its prefixes, so work grows with queries times
rows divided by a constant that the data decide.

Defined results: vectors that are null, zero, or hold a null or a component that isn't
finite take no part, nor do rows with a null id; vectors of another length than
the query's aren't compared with it; fewer candidates than k are all returned; rows
that repeat an id are separate candidates, except to that id's own query; an id with
several vectors asks with the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm._util import batches_of, column, cut_lineage, in_small_batches

K = 20
TREES, BITS = 128, 32
#: The chance that a row as near as the k-th nearest is missed.
MISS = 0.06
SHARD_ROWS, QUERY_ROWS = 8192, 1 << 16
SEED = 20240229


def _projections(dim: int, trees: int, seed: int) -> np.ndarray:
    """Directions for all bits of all trees, orthogonal in runs of ``dim``."""
    rng = np.random.default_rng([seed, dim])
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-trees * BITS // dim))]
    return np.concatenate(runs, axis=1)[:, : trees * BITS].astype(np.float32)


def _strings(lifted: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """trees x rows: the hash strings as unsigned integers, the first bit highest."""
    out = [np.packbits(lifted[a : a + 1024].astype(np.float32) @ directions > 0, axis=1).view(">u4") for a in range(0, len(lifted), 1024)]
    return np.ascontiguousarray(np.concatenate(out).T.astype(np.uint32))


def positions(cosines: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """How far to ascend for rows at these cosines: the sum over the trees of the prefix bits that are kept.

    At position L * trees - j, j trees are at level L - 1 and the others at L.
    """
    p = 1 - np.arccos(np.clip(cosines, -1.0, 1.0)) / np.pi
    with np.errstate(divide="ignore"):
        lost = np.log1p(-(p[:, None] ** np.arange(BITS + 1)))  # by level: log of the chance that one tree misses; -inf at level 0
    enough = trees * lost <= np.log(miss)
    level = BITS - enough[:, ::-1].argmax(axis=1)  # the deepest level at which all trees suffice
    here, below = (lost[np.arange(len(p)), np.minimum(level + s, BITS)] for s in (0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        j = np.ceil((trees * below - np.log(miss)) / (below - here))
    j = np.where(np.isneginf(here), 1, np.nan_to_num(j, nan=0.0))
    return np.where(level == BITS, BITS * trees, (level + 1) * trees - np.clip(j, 0, trees)).astype(np.int64)


class Shard:
    """The distinct vectors of a shard, each tree's strings in order, and the ids of each vector."""

    def __init__(self, x: np.ndarray, most: float, ids: np.ndarray, cuts: np.ndarray, order: np.ndarray, strings: np.ndarray, directions: np.ndarray):
        self.x, self.most, self.ids, self.cuts = x, most, ids, cuts
        self.order, self.sorted, self.directions = order, strings, directions
        self.trees = len(order)
        self.scored = 0

    @classmethod
    def build(cls, x: np.ndarray, most: float, ids: np.ndarray, cuts: np.ndarray, trees: int, seed: int) -> Shard:
        directions = _projections(x.shape[1] + 1, trees, seed)
        lengths = (x * x).sum(axis=1)
        lifted = np.concatenate([x, np.sqrt(np.maximum(most - lengths, 0.0))[:, None]], axis=1)
        strings = _strings(lifted, directions)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return cls(x, most, ids, cuts, order, np.take_along_axis(strings, order, axis=1), directions)

    def _ranges(self, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """trees x queries: the ranges of equal prefix at ``level`` (trees x queries)."""
        low = np.uint64(0xFFFFFFFF) >> level.astype(np.uint64)  # the bits that are given up
        first = strings.astype(np.uint64) & ~low
        last = first | low
        lo, hi = np.zeros(strings.shape, np.int64), np.zeros(strings.shape, np.int64)
        for t in range(self.trees):
            lo[t] = np.searchsorted(self.sorted[t], first[t].astype(np.uint32), side="left")
            hi[t] = np.searchsorted(self.sorted[t], last[t].astype(np.uint32), side="right")
        return lo, hi

    def _levels(self, position: np.ndarray) -> np.ndarray:
        """trees x queries: the level of each tree at a position."""
        level = -(-position // self.trees)
        return np.maximum(level[None, :] - (np.arange(self.trees)[:, None] < (level * self.trees - position)[None, :]), 0)

    def _top(self, found: np.ndarray, score: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ids of rows ``found``, the query's own left out, ties to the smaller id."""
        some = k + np.count_nonzero(self.ids == query_id)
        if len(found) > some:
            best = score >= np.partition(score, len(score) - some)[len(score) - some]
            found, score = found[best], score[best]
        if not len(found):
            return np.zeros(0, np.int64), np.zeros(0)
        vec = np.concatenate([self.ids[self.cuts[g] : self.cuts[g + 1]] for g in found])
        s = np.repeat(score, self.cuts[found + 1] - self.cuts[found])
        other = vec != query_id
        vec, s = vec[other], s[other]
        top = np.lexsort((vec, -s))[:k]
        return vec[top], s[top]

    def search(self, q: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores found; ``bounds`` are k-th best scores known before, or nan."""
        n, trees = len(self.x), self.trees
        lengths = np.sqrt((q * q).sum(axis=1) * self.most)
        strings = _strings(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.directions)
        at = np.full(len(q), BITS * trees)
        known = np.isfinite(bounds)
        if known.any():
            at[known] = positions(bounds[known] / lengths[known], trees, miss)
        # the others descend to their longest prefixes: the first common level with rows besides the query's own in all trees
        rising = np.flatnonzero(~known)
        for level in range(BITS, -1, -1):
            if not len(rising):
                break
            lo, hi = self._ranges(strings[:, rising], np.full((trees, len(rising)), level))
            at[rising] = level * trees
            rising = rising[(hi - lo).sum(axis=0) <= trees + 8 * k]
        order = list(self.order)
        results: list = [None] * len(q)
        scores: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        todo, worst = np.arange(len(q)), np.zeros(len(q))
        while len(todo):
            lo, hi = (a.T.tolist() for a in self._ranges(strings[:, todo], self._levels(at[todo])))
            for c, i in enumerate(todo.tolist()):
                mark = np.zeros(n, bool)
                mark[np.concatenate([rows[a:b] for rows, a, b in zip(order, lo[c], hi[c], strict=True)])] = True
                seen, score = scores.get(i) or (np.zeros(n, bool), np.zeros(n))
                new = np.flatnonzero(mark & ~seen)
                score[new] = self.x[new] @ q[i]
                self.scored += len(new)
                found = np.flatnonzero(mark)
                vec, s = self._top(found, score[found], query_ids[i], k)
                if known[i]:
                    vec, s = vec[s >= bounds[i]], s[s >= bounds[i]]
                else:
                    scores[i] = mark, score
                results[i], worst[i] = (vec, s), s[-1] / lengths[i] if len(s) == k else np.nan
            # where k rows were found, no further than they ask for; else on to the root
            goal = np.where(np.isnan(worst[todo]), 0, positions(np.nan_to_num(worst[todo], nan=-1.0), trees, miss))
            on = ~known[todo] & (at[todo] > goal)
            for i in todo[~on]:
                scores.pop(i, None)
            at[todo] = np.maximum(goal, at[todo] - trees)
            todo = todo[on]
        yield from results


# --- Spark ------------------------------------------------------------------------

_PARTS = ("x", "ids", "cuts", "tree_order", "strings")
_INDEX = "dim int, shard int, " + ", ".join(f"{c} binary" for c in _PARTS)
_FOUND = "query_id long, vec_id long, score double"


def _build(most: float, k: int, trees: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        ids, copies = rows["vec_id"].to_numpy(), np.minimum(rows["n"].to_numpy(), k)
        _, first, group = np.unique(x.view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.repeat(np.lexsort((ids, group)), copies[np.lexsort((ids, group))])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group, copies, len(first)).astype(np.int64))])
        made = Shard.build(x[first], most, ids[order], cuts, trees, seed)
        arrays = dict(zip(_PARTS, (made.x, made.ids, made.cuts, made.order, made.sorted), strict=True))
        return pd.DataFrame([{"dim": int(key[0]), "shard": int(key[1])} | {c: np.ascontiguousarray(a).tobytes() for c, a in arrays.items()}])

    return run


def _load(row: dict, most: float, trees: int, seed: int) -> Shard:
    x = np.frombuffer(row["x"]).reshape(-1, row["dim"])
    order, strings = (np.frombuffer(row[c], kind).reshape(trees, len(x)) for c, kind in (("tree_order", np.int32), ("strings", np.uint32)))
    return Shard(x, most, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cuts"], np.int64), order, strings, _projections(row["dim"] + 1, trees, seed))


def _visit(most: float, k: int, trees: int, miss: float, seed: int):
    """Rows come sorted by dim and part, the shard's arrays before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            dims, parts = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("dim", "part"))
            is_index = np.asarray(column(batch, "x").is_valid())
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                if a == b:
                    continue
                if is_index[a]:
                    row = {c: column(batch, c)[int(a)].as_py() for c in ("dim", *_PARTS)}
                    at, shard = (dims[a], parts[a]), _load(row, most, trees, seed)
                    a += 1
                if a == b or at != (dims[a], parts[a]):
                    continue  # a shard without rows of this length
                own = batch.slice(int(a), int(b - a))
                q = column(own, "v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dims[a]))
                ids, bounds = column(own, "query_id").to_numpy(), column(own, "bound").to_numpy(zero_copy_only=False).astype(np.float64)
                found = list(shard.search(q, ids, bounds, k, miss))
                yield batches_of(
                    {
                        "query_id": pa.array(np.repeat(ids, [len(v) for v, _ in found])),
                        "vec_id": pa.array(np.concatenate([v for v, _ in found])),
                        "score": pa.array(np.concatenate([s for _, s in found])),
                    }
                )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components that aren't all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    trees: int = TREES,
    miss: float = MISS,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; the rows where ``is_query`` holds are queries.
    """
    rows = usable(vectors)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(length).alias("most")).first()
    shards, blocks, most = max(1, -(-totals["n"] // shard_rows)), max(1, -(-totals["q"] // query_rows)), totals["most"] or 1.0
    shard = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shards)).cast("int")

    # the k + 1 smallest ids of each vector, limited before the shuffle too
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    dealt = few.select("vec_id", "v", "n", F.size("v").alias("dim"), shard.alias("shard"))
    index = cut_lineage(dealt.groupBy("dim", "shard").applyInPandas(_build(most, k, trees, seed), _INDEX))

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"), shard.alias("home"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    columns = ("dim", "part", *_PARTS, "query_id", "v", "bound")

    def visited(asks: DataFrame) -> DataFrame:
        """What the queries ``asks`` (with shard and bound) find."""
        sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
            {"query_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>"), "bound": F.lit(None).cast("double")}
        )
        asks = asks.withColumns({c: F.lit(None).cast("binary") for c in _PARTS})
        part = (F.col("shard").cast("long") * blocks + F.col("block")).alias("part")
        both = sent.select("dim", part, *columns[2:]).union(asks.select("dim", part, *columns[2:]))
        stream = in_small_batches(both.repartition("dim", "part").sortWithinPartitions("dim", "part", F.col("x").isNull()))
        return stream.mapInArrow(_visit(most, k, trees, miss, seed), _FOUND)

    home = cut_lineage(visited(asked.withColumn("shard", F.col("home")).withColumn("bound", F.lit(None).cast("double"))))
    bounds = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    away = asked.join(bounds, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    found = home.union(visited(away)) if shards > 1 else home
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(n: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(n)) == 0
