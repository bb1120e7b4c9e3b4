"""Exact removal of lines that repeat across documents.

The distinct hashes of lines found in two or more documents are put into a
sharded minimal perfect hash. Each shard is a few compact arrays: the bits of
the hash function, a fingerprint and a document count for each slot, and the
smallest document that holds the line. Documents send the hashes of their lines
past the arrays of their shard in sorted streams, so neither side is ever held
whole, and get back the hashes to drop.

Defined results: a null or empty text is one empty line; a null ``doc_id``
counts as one document after all others; rows with the same ``doc_id`` are one
document, each keeping its own text; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm._util import ASCII_SPACE, batches_of, column, cut_lineage, in_small_batches

MIN_KEY_CHARS = 10
#: Keys in a shard of the perfect hash, about.
SHARD_KEYS = 1 << 16
#: A shard's arrays are sent to so many tasks, so that a line of many documents spreads out.
SALTS = 16
NULL_DOC = (1 << 63) - 1

_GAMMA = 2.0
_LEVELS = 48


def line_key(line: str) -> bytes:
    """The stripped line with A-Z in lower case, as UTF-8; bytes.lower() leaves other letters alone."""
    return line.encode("utf-8", "surrogatepass").strip(ASCII_SPACE).lower()


def _hashes(line: str, min_chars: int) -> tuple[int, int] | None:
    key = line_key(line)
    if len(key) < min_chars or len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    both = xxhash.xxh3_128_intdigest(key)
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


# --- the perfect hash of a shard --------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash in levels of bits (Limasset et al. 2017), built and probed in numpy.

    A key takes the first level at which no other key shares its bit; its slot
    is the number of bits set before that one.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left):
            if len(levels) == _LEVELS:
                raise ValueError("repeated keys")
            size = max(64, int(len(left) * _GAMMA))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys that are not in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(x) for x in self.levels], np.int64)
        bits = b"".join(np.packbits(x).tobytes() for x in self.levels)
        return sizes.tobytes(), bits

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at, raw = [], 0, np.frombuffer(bits, np.uint8)
        for n in np.frombuffer(sizes, np.int64):
            width = (int(n) + 7) // 8
            levels.append(np.unpackbits(raw[at : at + width])[: int(n)].astype(bool))
            at += width
        return cls(levels)


class Shard:
    """The arrays of a shard, by slot of its perfect hash."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, firsts: bytes):
        self.hash = PerfectHash.unpack(sizes, bits)
        self.prints, self.counts, self.firsts = (np.frombuffer(x, np.int64) for x in (prints, counts, firsts))

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each line is held by two or more documents, of which ``doc`` is not the smallest."""
        slot = self.hash.slots(h1.view(np.uint64))
        safe = np.maximum(slot, 0)
        return (slot >= 0) & (self.prints[safe] == h2) & (self.counts[safe] >= 2) & (self.firsts[safe] != doc)


# --- Spark ------------------------------------------------------------------------

_LINES = T.StructType([T.StructField(x, T.LongType()) for x in ("doc", "h1", "h2")])


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h1, h2 = [], [], []
            ids, texts = column(batch, "doc"), column(batch, "text")
            for i, t in zip(ids.to_pylist(), texts, strict=True):
                seen = {h for line in set((t.as_py() or "").split("\n")) if (h := _hashes(line, min_chars))}
                doc += [i] * len(seen)
                h1 += [h[0] for h in seen]
                h2 += [h[1] for h in seen]
            yield batches_of({k: pa.array(v, pa.int64()) for k, v in (("doc", doc), ("h1", h1), ("h2", h2))})

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of arrays for each shard; rows come sorted by shard."""

    def made(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        h1, h2, n, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        # h1 alone can repeat: such keys share a slot's hash, so they go to h1 ^ h2 in their own shard row
        uniq, at = np.unique(h1, return_index=True)
        rest = np.setdiff1d(np.arange(len(h1)), at)
        rows = []
        while len(at):
            table = PerfectHash.build(h1[at].view(np.uint64))
            slot = table.slots(h1[at].view(np.uint64))
            order = at[np.argsort(slot)]
            rows.append((*table.pack(), h2[order].tobytes(), n[order].tobytes(), first[order].tobytes()))
            if not len(rest):
                break
            _, k = np.unique(h1[rest], return_index=True)
            at, rest = rest[k], np.delete(rest, k)
        return batches_of(
            {"shard": pa.array([shard] * len(rows), pa.int32())}
            | {k: pa.array(v, pa.binary()) for k, v in zip(_ARRAYS, zip(*rows, strict=True), strict=True)}
        )

    shard, parts = None, []
    for batch in batches:
        cols = [column(batch, x).to_numpy(zero_copy_only=False) for x in ("shard", "h1", "h2", "n", "first")]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for part in zip(*(np.split(x, cuts) for x in cols), strict=True):
            if not len(part[0]):
                continue
            if parts and part[0][0] != shard:
                yield made(shard, parts)
                parts = []
            shard = int(part[0][0])
            parts.append(part[1:])
    if parts:
        yield made(shard, parts)


_ARRAYS = ("sizes", "bits", "prints", "counts", "firsts")
_SHARD_SCHEMA = "shard int, " + ", ".join(f"{x} binary" for x in _ARRAYS)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, the shard's arrays first; lines that must go come out."""
    current, tables = None, []
    for batch in batches:
        shards = column(batch, "shard").to_numpy(zero_copy_only=False)
        sizes = column(batch, "sizes")
        is_array = ~np.asarray(sizes.is_null())
        cols = {x: column(batch, x) for x in ("doc", "h1", "h2")}
        keep = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if shards[a] != current:
                current, tables = shards[a], []
            k = a
            while k < b and is_array[k]:
                tables.append(Shard(*(column(batch, x)[k].as_py() for x in _ARRAYS)))
                k += 1
            if k == b or not tables:
                continue
            doc, h1, h2 = (cols[x].slice(k, b - k).to_numpy(zero_copy_only=False) for x in ("doc", "h1", "h2"))
            hit = np.zeros(b - k, bool)
            for table in tables:
                hit |= table.drops(h1, h2, doc)
            keep.append(k + np.flatnonzero(hit))
        take = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64), pa.int64())
        yield batches_of({k: v.take(take) for k, v in cols.items()})


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, shard_keys: int = SHARD_KEYS, salts: int = SALTS) -> DataFrame:
    """(doc, h1, h2): the line hashes that each document loses. ``docs`` has doc (long, not null) and text."""
    lines = cut_lineage(in_small_batches(docs).select("doc", "text").mapInArrow(_line_hashes(min_chars), _LINES))
    repeated = cut_lineage(
        lines.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first <> last")
    )
    shards = max(1, -(-repeated.count() // shard_keys))

    def shard(h: str) -> F.Column:
        return F.pmod(F.xxhash64(h), F.lit(shards)).cast("int")

    tables = (
        repeated.withColumn("shard", shard("h1"))
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_build, _SHARD_SCHEMA)
    )
    n = max(salts, 1)
    sent = tables.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(n)]))).select(
        (F.col("shard") * n + F.col("salt")).alias("shard"),
        *_ARRAYS,
        *(F.lit(None).cast("long").alias(x) for x in ("doc", "h1", "h2")),
    )
    asked = lines.select(
        (shard("h1") * n + F.pmod(F.xxhash64("doc", "h2"), F.lit(n)).cast("int")).alias("shard"),
        *(F.lit(None).cast("binary").alias(x) for x in _ARRAYS),
        "doc",
        "h1",
        "h2",
    )
    return (
        sent.union(asked)
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("sizes").isNull())
        .mapInArrow(_probe, _LINES)
    )


def _without(min_chars: int, names: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, texts = column(batch, "__lost"), column(batch, "text")
            kept, total, gone, shas = [], [], [], []
            for t, drop in zip(texts, lost, strict=True):
                text = t.as_py()
                lines = (text or "").split("\n")
                total.append(len(lines))
                if drop.is_valid:
                    out = {(x["h1"], x["h2"]) for x in drop.as_py()}
                    stay = [x for x in lines if _hashes(x, min_chars) not in out]
                    text = "\n".join(stay)
                    gone.append(len(lines) - len(stay))
                else:
                    gone.append(0)
                if digest:
                    shas.append(hashlib.sha256((text or "").encode()).hexdigest())
                else:
                    kept.append(text)
            if digest:
                yield batches_of(
                    {
                        "doc_id": column(batch, "doc_id"),
                        "n_lines": pa.array(total, pa.int64()),
                        "n_dropped": pa.array(gone, pa.int64()),
                        "kept_sha256": pa.array(shas, pa.string()),
                    }
                )
            else:
                yield batches_of({x: pa.array(kept, texts.type) if x == "text" else column(batch, x) for x in names})

    return run


def _with_losses(docs: DataFrame, min_chars: int, **how) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC))
    lost = (
        lines_to_drop(docs.select(doc.alias("doc"), "text"), min_chars, **how)
        .distinct()
        .groupBy("doc")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("__lost"))  # one document's lines
    )
    return docs.withColumn("__doc", doc).join(lost.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, **how) -> DataFrame:
    """``docs`` (doc_id, text, any others) with repeated lines gone from all but the smallest document.

    A line's key is the stripped line with A-Z lower-cased; keys of at least
    ``min_chars`` code points count. A null text stays null.
    """
    found = _with_losses(docs, min_chars, **how)
    return found.mapInArrow(_without(min_chars, docs.columns, False), docs.schema)


def line_dedup_report(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, **how) -> DataFrame:
    """Per document: doc_id, n_lines before dropping, n_dropped, and the SHA-256 of the text that stays."""
    found = _with_losses(docs.select("doc_id", "text"), min_chars, **how)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return found.mapInArrow(_without(min_chars, docs.columns, True), schema)
