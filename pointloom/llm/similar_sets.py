"""Near-duplicates by SimHash on the popcount grid and the Jaccard similarity of word shingles.

A text is the set of its distinct 5-word shingles (XXH64). Two texts are near-duplicates
if their sets' similarity is 0.8 or more; groups are the connected components.

First comes the method of ``simhash``: the sets' fingerprints meet on the grid of segment
popcounts, and each link of two fingerprints within 2 bits (or equal ones) is checked on the whole
sets. The grid's radius is a cap, which most pairs of similarity 0.8 exceed, and a wider one
meets nearly everything. So what lies beyond it is found exactly, among sets that the grid has not connected yet.
No pair is left to chance: with any total order of the shingles, two sets that similar
share one among the first n - ceil(0.8 n) + 1 of each (prefix filter), so
every set visits the shingles of its prefix, and pairs that meet are verified on whole sets.
A meeting counts only if the shingles after it, and the two sizes, can still reach 0.8.

The order has shingles that are frequent in a sample of the documents last, to keep
meetings few; the sample decides the order, never the result. Visits are shuffled once and
pass a sorted stream, which drops those that nobody else makes; the visits to a frequent
shingle, all of which stay, are dealt over several tasks. Equal sets are one
node. Each set is first held against a few visitors of its meeting point, those with the smallest keys;
pairs that this has already connected are not built, so that a large group of near copies
costs few pairs beyond those. What is left is held against each other, pair by pair, if two
bounds from above allow it: the numbers of the sets' hashes in 256 cells differ by no more than the
sets do, and so do their parities, which are looked at first. Pairs are two keys until then: only
sets whose numbers are that close are built again and sent to each other.

Defined results: a text of fewer than five words is one shingle, a text without words
(or null) the empty set, which equals only itself. Repeated ids and null are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm import simhash
from pointloom.llm._util import batches_of, column, cut_lineage, free_unused, in_small_batches
from pointloom.llm.graph import connected_components
from pointloom.llm.simhash import SEED

SHINGLE_WORDS = 5
#: Similarity of NUM / DEN or more: DEN * common >= NUM * (all), in whole numbers.
NUM, DEN = 4, 5
#: Visitors of a place that all others there are held against first; a place with so many is done then.
HUBS = 16
SAMPLE_DOCS, SAMPLE_SEEN, SAMPLE_MOST = 20_000, 3, 1 << 17
#: The sample has one of so many documents at least.
SAMPLE_STEP = 20
#: Tasks that share the visits to a frequent shingle.
SALTS = 64
#: Keys that a task remembers, to pass by copies.
SEEN_KEYS = 1 << 19
#: Ids of documents to be compared that are sent to every task, at most.
SENT_IDS = 1 << 18
CELLS = 256
PARITY = [f"b{i}" for i in range(CELLS // 64)]


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, ascending."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: max(len(words) - k, 0)] + 1).tolist()]
    stops = ends[k - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64).view(np.int64))


def set_key(shingles: np.ndarray) -> int:
    """A signed hash of 64 bits that stands for the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def cell_counts(shingles: np.ndarray) -> np.ndarray:
    """How many of the shingles fall into each of 256 cells, modulo 256."""
    return np.bincount(shingles.view(np.uint64) >> np.uint64(56), minlength=CELLS).astype(np.uint8)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: a bit for each of 256 cells, whether an odd number of the shingles fall there."""
    return np.packbits(cell_counts(shingles) & 1, bitorder="little").view(np.int64)


def counts_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row, the sum of differences of cells' counts, each the least possible: the sets differ in as many shingles at least."""
    return np.abs((x - y).view(np.int8).astype(np.int64)).sum(axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in column(batch, "text")]
        bits = np.stack([parities(s) for s in sets]) if sets else np.zeros((0, len(PARITY)), np.int64)
        yield batches_of(
            {
                "doc_id": column(batch, "doc_id"),
                "key": pa.array([set_key(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int32()),
                "fp": pa.array(np.array([simhash.majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)),
                "counts": pa.array([cell_counts(s).tobytes() for s in sets], pa.binary()),
            }
            | {c: pa.array(np.ascontiguousarray(bits[:, i])) for i, c in enumerate(PARITY)}
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in column(batch, "text"):
            yield batches_of({"shingle": pa.array(shingle_set(t.as_py()))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in column(batch, "text")]
        yield batches_of({"key": pa.array([set_key(s) for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample have, ascending; at most SAMPLE_MOST."""
    step = min(max(1, docs.count() // SAMPLE_DOCS), SAMPLE_STEP)
    sample = in_small_batches(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct())
    seen = sample.mapInArrow(_shingles, "shingle long").groupBy("shingle").count().where(F.col("count") >= SAMPLE_SEEN)
    top = seen.orderBy(F.desc("count"), "shingle").limit(SAMPLE_MOST).toArrow()
    return np.sort(top.column("shingle").to_numpy())


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(shingle, salt, key, at): the places that each set visits; ``at`` has the set's size above bit 32 and the place in its order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for t in column(batch, "text"):
                s = shingle_set(t.as_py())
                n, key = len(s), set_key(s)
                if not n or key in seen:
                    continue
                if len(seen) >= SEEN_KEYS:
                    seen.clear()
                seen.add(key)
                late = np.isin(s, frequent, assume_unique=True)
                first = np.concatenate([s[~late], s[late]])[: n - -(-NUM * n // DEN) + 1]
                salt = np.where(np.arange(len(first)) < n - late.sum(), -1, key % SALTS).astype(np.int32)
                parts.append((first, salt, np.full(len(first), key, np.int64), (np.int64(n) << 32) | np.arange(len(first))))
            if parts:
                yield batches_of({k: pa.array(np.concatenate(v)) for k, v in zip(("shingle", "salt", "key", "at"), zip(*parts, strict=True), strict=True)})

    return in_small_batches(docs).select("text").mapInArrow(run, "shingle long, salt int, key long, at long")


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of visits sorted by shingle and key, each once, those whose shingle another set visits or that are salted."""
    names = ("shingle", "salt", "key", "at")
    held, met = [np.zeros(0, np.int64)] * 4, False  # the last visit so far, and whether the one before has its shingle
    for batch in batches:
        rows = [np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        shingle, key = rows[0], rows[2]
        if not len(shingle):
            continue
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])])
        rows = [r[new] for r in rows]
        after = rows[0][1:] == rows[0][:-1]
        before = np.concatenate([[met], after])
        keep = before[:-1] | after | (rows[1][:-1] >= 0)
        yield batches_of({c: pa.array(r[:-1][keep]) for c, r in zip(names, rows, strict=True) if c != "salt"})
        held, met = [r[-1:] for r in rows], bool(before[-1])
    if len(held[0]) and (met or held[1][0] >= 0):
        yield batches_of({c: pa.array(r) for c, r in zip(names, held, strict=True) if c != "salt"})


#: If two sets first meet here, can NUM / DEN still be reached?
_REACHES = f"{NUM + DEN} * least(x.n - x.pos, y.n - y.pos) >= {NUM} * (x.n + y.n)"
#: Do the fingerprints differ in no more places than sets that similar can?
_MAY_BE = f"{NUM + DEN} * ({' + '.join(f'bit_count(x.{c} ^ y.{c})' for c in PARITY)}) <= {DEN - NUM} * (x.n + y.n)"


def _close(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose cells' counts differ by no more than sets that similar can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("ca", "cb"))
            sizes = column(batch, "na").to_numpy().astype(np.int64) + column(batch, "nb").to_numpy()
            hold = pa.array((NUM + DEN) * counts_apart(x, y) <= (DEN - NUM) * sizes)
            yield batches_of({k: column(batch, k).filter(hold) for k in ("a", "b")})

    for end in "ab":
        pairs = pairs.join(distinct.select(F.col("key").alias(end), F.col("n").alias(f"n{end}"), F.col("counts").alias(f"c{end}")), end)
    return cut_lineage(pairs.mapInArrow(run, "a long, b long"))


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose whole sets are similar enough; only documents that are needed are hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(column(batch, "sa"), column(batch, "sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hold.append((NUM + DEN) * common >= NUM * (len(x) + len(y)))
            hold = pa.array(hold, pa.bool_())
            yield batches_of({k: column(batch, k).filter(hold) for k in ("a", "b")})

    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = cut_lineage(distinct.join(needed, "key", "left_semi").select(F.col("first_doc").alias("__id")).distinct())
    if ids.count() <= SENT_IDS:  # else texts are shuffled
        ids = F.broadcast(ids)
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    keyed = in_small_batches(found).select("text").mapInArrow(_sets, "key long, shingles binary")
    sets = cut_lineage(keyed.join(needed, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    return cut_lineage(both.mapInArrow(run, "a long, b long"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _on_grid(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints the grid join links, each fingerprint by its smallest key, and of that key and others with its fingerprint."""
    first = cut_lineage(distinct.groupBy("fp").agg(F.min("key").alias("first")))
    same = distinct.select("fp", "key").join(first, "fp").where("key <> first").select(*_ordered("key", "first"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}")) for c in "ab"]
    met = simhash.links(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select(*_ordered("key_a", "key_b"))
    return cut_lineage(same.union(met).distinct())


def _met(docs: DataFrame, distinct: DataFrame, near: DataFrame) -> DataFrame:
    """(shingle, key, n, pos, root, parities): the visits that have company; links ``near`` are known."""
    visits = _prefixes(docs, _frequent(docs)).repartition("shingle", "salt").sortWithinPartitions("shingle", "key")
    met = visits.mapInArrow(_company, "shingle long, key long, at long")
    pos = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")
    roots = connected_components(near).withColumnRenamed("node", "key")
    known = distinct.select("key", "n", *PARITY).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return cut_lineage(met.join(known, "key").select("shingle", "key", "n", pos, "root", *PARITY))


def _star(company: DataFrame) -> DataFrame:
    """Pairs (a, b) of a visitor and one of the few with the smallest keys at the same place, unless they are connected."""
    smallest = Window.partitionBy("shingle").orderBy("key")
    hubs = company.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= HUBS).drop("r")
    x, y = hubs.alias("x"), company.alias("y")
    star = y.join(x, "shingle").where(f"x.root <> y.root AND {_REACHES} AND {_MAY_BE}")
    return cut_lineage(star.select(*_ordered("x.key", "y.key")).distinct())


def _rest(company: DataFrame, star: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (a, b) of visitors of a place that the links ``first`` don't connect, but for those of ``star``."""
    roots = connected_components(first).withColumnRenamed("node", "key")
    rooted = cut_lineage(company.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    apart = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("visits")).where(f"lo <> hi AND visits > {HUBS}")
    rooted = rooted.join(apart.select("shingle"), "shingle", "left_semi")
    x, y = rooted.alias("x"), rooted.alias("y")
    rest = x.join(y, "shingle").where(f"x.key < y.key AND x.root <> y.root AND {_REACHES} AND {_MAY_BE}").select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    return cut_lineage(rest.join(star, ["a", "b"], "left_anti"))


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``docs`` and their distinct (key, n, fp, counts, parities, first_doc) to links (a, b) of similar sets, by key, that keep all connections.

    Each step's shuffles and checkpoints go before the next one writes its own.
    """
    spark = docs.sparkSession
    near = _verified(docs, distinct, _close(distinct, _on_grid(distinct)))
    free_unused(spark)
    company = _met(docs, distinct, near)
    free_unused(spark)
    star = _star(company)
    free_unused(spark)
    first = near.union(_verified(docs, distinct, _close(distinct, star)))
    free_unused(spark)
    rest = _rest(company, star, first)
    del company, star
    free_unused(spark)
    found = first.union(_verified(docs, distinct, _close(distinct, rest)))
    del rest
    free_unused(spark)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(in_small_batches(docs).select("doc_id", "text").mapInArrow(_keys, f"doc_id {kind}, key long, n int, fp long, counts binary, {', '.join(f'{c} long' for c in PARITY)}"))
    distinct = cut_lineage(prints.groupBy("key", "n", "fp", "counts", *PARITY).agg(F.min("doc_id").alias("first_doc")))
    prints = cut_lineage(prints.select("doc_id", "key"))
    roots = connected_components(links(docs, distinct)).withColumnRenamed("node", "key")
    grouped = distinct.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first_doc")
    smallest = grouped.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_key = grouped.join(smallest, "root").select("key", "component_id")
    return prints.join(by_key, "key").select("doc_id", "component_id")
