"""SimHash near-duplicates by a grid range join over segment popcounts.

A fingerprint of 64 bits is cut into 16 segments of 4 bits and embedded as the
vector of their bit counts. The Manhattan distance of two embeddings is a lower
bound of their Hamming distance, so fingerprints within 2 bits lie within
distance 2 on the integer grid, and then some grid point is within 1 of both:
every fingerprint visits its own grid point and the next ones along each axis,
and meets its candidates there. Points with a single visitor are discarded by
a pre-aggregated minimum and maximum.

The exact check keeps to the grid point: two fingerprints that meet are within
2 bits exactly if some 64-bit string is within 1 bit of both, and that string's
embedding is a grid point that both visit. Visitors of a point with company
therefore name the strings there that are within 1 bit, and each is linked to the
smallest fingerprint that named the same string. That keeps every connection
with a number of links that is linear in the fingerprints, however large a
group of copies is, instead of all pairs of a group.

Defined results: a text without words (or null) has fingerprint zero and links
like any other; rows with a null ``doc_id`` take part in links, and the
component id is the smallest non-null id reachable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm._util import batches_of, column, cut_lineage, in_small_batches
from pointloom.llm.graph import connected_components

SEGMENTS, SEGMENT_BITS = 16, 4
SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's k-word shingles, as unsigned 64 bits."""
    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of unsigned hashes: a bit is 1 if it is in over half of them; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint((t.as_py() or "").encode()) for t in column(batch, "text")]
        yield batches_of({"doc_id": column(batch, "doc_id"), "fp": pa.array(np.array(prints, np.uint64).view(np.int64))})


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


# The grid: 3 bits an axis, since a segment has at most 4 bits set.
_SEGMENT = "(shiftrightunsigned(fp, 4 * i) & 15L)"
_EMBEDDING = f"aggregate(sequence(0, 15), 0L, (e, i) -> e | shiftleft(CAST(bit_count({_SEGMENT}) AS BIGINT), 3 * i))"
_VISITS = f"""flatten(array(array(named_struct('cell', e, 'axis', -1, 'up', false)),
    filter(transform(sequence(0, 15), i -> named_struct('cell', e + shiftleft(1L, 3 * i), 'axis', i, 'up', true)), v -> (shiftrightunsigned(e, 3 * v.axis) & 7L) < 4),
    filter(transform(sequence(0, 15), i -> named_struct('cell', e - shiftleft(1L, 3 * i), 'axis', i, 'up', false)), v -> (shiftrightunsigned(e, 3 * v.axis) & 7L) > 0)))"""
#: The strings within one bit of fp whose embedding is the visited grid point.
_STRINGS = """CASE WHEN v.axis < 0 THEN array(fp) ELSE transform(
    filter(sequence(4 * v.axis, 4 * v.axis + 3), b -> (shiftrightunsigned(fp, b) & 1L) = IF(v.up, 0L, 1L)),
    b -> fp ^ shiftleft(1L, b)) END"""


def links(prints: DataFrame) -> DataFrame:
    """Distinct ``fp`` to links (a, b) of fingerprints within 2 bits that keep all connections."""
    visits = (
        prints.select("fp", F.expr(_EMBEDDING).alias("e"))
        .select("fp", F.explode(F.expr(_VISITS)).alias("v"))
        .select("fp", "v", F.col("v.cell").alias("cell"))
    )
    company = visits.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    named = visits.join(company, "cell").select("fp", F.explode(F.expr(_STRINGS)).alias("string"))
    named = cut_lineage(named)
    met = named.groupBy("string").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    return (
        named.join(met.select("string", "lo"), "string")
        .where("fp <> lo AND bit_count(fp ^ lo) <= 2")
        .select(F.col("lo").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = cut_lineage(with_fingerprints(docs))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(links(distinct.select("fp")))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_doc"
    )
    smallest = grouped.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = grouped.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with only the smallest document of each component that ``find`` reports.

    Rows with the same id are one document and stay or go together; null is such
    an id, larger than all others.
    """
    stays = find(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
