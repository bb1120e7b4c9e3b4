"""Quality rules: a hashed n-gram log-likelihood ratio after base rules.

Two multinomials over hashed byte 4-grams are estimated: the target from
documents labelled good, the raw one from all documents. A document's score is the
mean over its 4-grams of log(target / raw); it is kept if the score is not below a
threshold fixed once from the labelled documents. Log ratios are integers (in
2**-20), so sums don't depend on how documents are batched, and each document gets
the same verdict on every run.

Labels: a bounded sample of ``max_labelled`` labelled documents (those with the
smallest hash of their id) fits the target and the threshold. The raw counts cover
all documents.

Defined results: a null text has no words; a text of fewer than four bytes scores
0; repeated rows are judged alike; without good labels the ratio is 0 everywhere
and the base rules alone decide; labels that repeat count once, the lowest quality
winning; labels with a null id or quality are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm._util import batches_of, column, in_small_batches, runs, utf8

BUCKET_BITS = 16
MAX_LABELLED = 50_000
#: At most this share of the labelled good documents may fall below the threshold.
MAX_GOOD_LOST = 0.002
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

_ONE = 1 << 20  # fixed point of the log ratios
_BINS = 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the 4 bytes at each position, and each document's range of positions."""
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    x = raw.astype(np.uint32)
    word = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    word ^= word >> np.uint32(15)
    with np.errstate(over="ignore"):
        word *= np.uint32(2654435761)
    bucket = (word >> np.uint32(32 - bits)).astype(np.int32)
    top = np.maximum(ends - 3, starts)
    return bucket, np.minimum(starts, len(bucket)), np.minimum(top, len(bucket))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base of the word hash, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            with np.errstate(over="ignore"):
                table = np.full(2 * n, base, np.uint64)
                table[0] = 1
                _powers[k] = np.multiply.accumulate(table)
    return _powers


@dataclass
class Base:
    """The counts of a run of documents, one entry for each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        if line in seen:
            n += 1
        seen.add(line)
    return n


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> Base:
    """Counts of whole documents; ``raw`` holds their bytes one after the other."""
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = ~space[inner]  # a document's first byte starts a word
    last = ~space
    last[:-1] &= space[1:]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    n_words = _per_doc(first, offsets)
    chars = _per_doc(~space & ((raw & 0xC0) != 0x80), offsets)
    symbols = _per_doc(_SYMBOL[raw], offsets)
    data = raw.tobytes()
    dups = np.array([_dup_lines(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    return Base(n_words, chars, symbols, dups, _repeat_words(raw, starts, ends, n_words))


def _repeat_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    k, n = REPEAT_WINDOW, len(starts)
    if n < k:
        return np.zeros(len(n_words), np.int64)
    up, down = _power(len(raw) + 1)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=sums[1:])
        word = (sums[ends] - sums[starts]) * down[starts]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        word ^= word >> np.uint64(32)
        m = n - k + 1
        window = np.zeros(m, np.uint64)
        for i in range(k):
            window = window * np.uint64(0x94D049BB133111EB) + word[i : i + m]
        window ^= window >> np.uint64(31)
        window += doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # windows of other documents don't count
        window = (window ^ (window >> np.uint64(30))) * np.uint64(0x9FB21C651E98DF25)
    whole = np.flatnonzero(doc[:m] == doc[k - 1 :])
    window = window[whole]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    at = whole[twice]
    step[at] += 1  # positions are distinct
    np.subtract.at(step, at + k, 1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc, weights=covered, minlength=len(n_words)).astype(np.int64)


# --- training ---------------------------------------------------------------------


@dataclass
class QualityModel:
    """Log ratios by bucket in 2**-20, and the smallest score (same unit) that is kept."""

    ratio: np.ndarray
    threshold: int | None

    @property
    def bits(self) -> int:
        return int(len(self.ratio)).bit_length() - 1

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, a, b = grams(raw, offsets[:-1], offsets[1:], self.bits)
        total = np.concatenate([[0], np.cumsum(self.ratio[bucket])])
        n = b - a
        return np.where(n > 0, (total[b] - total[a]) // np.maximum(n, 1), 0)


def _labelled(labels: DataFrame, limit: int) -> DataFrame:
    """(id, good) of at most ``limit`` labelled documents: the bound of what is broadcast."""
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("__label_id"))
        .agg((F.min("quality") > 0).alias("__good"))
        .orderBy(F.xxhash64("__label_id"), "__label_id")
        .limit(limit)
    )


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            raw, offsets = utf8(column(batch, "text"))
            good = column(batch, "__good").fill_null(False).to_numpy(zero_copy_only=False)
            for i, j in runs(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bucket, a, b = grams(part, at[:-1], at[1:], bits)
                step = np.zeros((2, len(bucket) + 1), np.int64)
                for k, use in enumerate((b > a, (b > a) & good[i:j])):
                    np.add.at(step[k], a[use], 1)
                    np.add.at(step[k], b[use], -1)
                for k in range(2):
                    inside = np.cumsum(step[k][:-1]) > 0
                    if inside.any():
                        counts[k] += np.bincount(bucket[inside], minlength=1 << bits)
        some = np.flatnonzero(counts[0])
        yield batches_of({"bucket": pa.array(some), "n_raw": pa.array(counts[0][some]), "n_target": pa.array(counts[1][some])})

    return run


def _bins(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(column(batch, "text"))
            score, fine = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            for i, j in runs(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                score[i:j], fine[i:j] = model.scores(part, at), ~base_counts(part, at).failed
            take = pa.array(np.flatnonzero(fine))
            yield batches_of({"bin": pa.array(_bin(score)).take(take), "good": column(batch, "__good").take(take)})

    return run


#: Bins of 2**-10 over scores from -8 to 8.
def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip((score >> 10) + _BINS // 2, 0, _BINS - 1)


def threshold_of(good: np.ndarray, bad: np.ndarray, max_good_lost: float) -> int | None:
    """The first bin to keep, from counts by bin: the best balanced accuracy among those that lose few good ones."""
    if not good.sum():
        return None
    lost = np.concatenate([[0], np.cumsum(good)])[:-1]
    caught = np.concatenate([[0], np.cumsum(bad)])[:-1]
    value = caught / max(1, bad.sum()) - lost / good.sum()
    value[lost > max_good_lost * good.sum()] = -1
    best = np.flatnonzero(value >= value.max() - 1e-12)
    return int(best[len(best) // 2])  # the middle of a gap between the classes


def fit(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, max_labelled: int = MAX_LABELLED, max_good_lost: float = MAX_GOOD_LOST) -> QualityModel:
    """Count 4-grams over all of ``docs``, and set the threshold from the labelled ones."""
    sample = _labelled(labels, max_labelled)
    text = in_small_batches(docs).select(F.col("doc_id").alias("__label_id"), "text")
    rows = (
        text.join(F.broadcast(sample), "__label_id", "left")
        .select("text", "__good")
        .mapInArrow(_count(bits), "bucket long, n_raw long, n_target long")
        .groupBy("bucket")
        .agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
        .toArrow()  # 2**bits rows at most
    )
    counts = np.zeros((2, 1 << bits))
    at = rows.column("bucket").to_numpy()
    counts[0, at], counts[1, at] = rows.column("n_raw").to_numpy(), rows.column("n_target").to_numpy()
    if not counts[1].sum():
        return QualityModel(np.zeros(1 << bits, np.int64), None)
    share = (counts + 1) / (counts.sum(axis=1, keepdims=True) + (1 << bits))
    model = QualityModel(np.round(np.log(share[1] / share[0]) * _ONE).astype(np.int64), None)
    bins = (
        text.join(F.broadcast(sample), "__label_id")
        .select("text", "__good")
        .mapInArrow(_bins(model), "bin long, good boolean")
        .groupBy("bin", "good")
        .count()
        .collect()  # two rows for each bin at most
    )
    both = np.zeros((2, _BINS), np.int64)
    for r in bins:
        both[int(r["good"]), r["bin"]] = r["count"]
    first = threshold_of(both[1], both[0], max_good_lost)
    model.threshold = None if first is None else (first - _BINS // 2) << 10
    return model


# --- application ------------------------------------------------------------------


def _judge(model: QualityModel, texts: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = utf8(texts)
    parts = []
    for i, j in runs(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        b, score = base_counts(part, at), model.scores(part, at)
        passed = np.ones(j - i, bool) if model.threshold is None else score >= model.threshold
        parts.append((b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, ~b.failed & passed, score / _ONE))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    if not parts:
        kinds = [np.int64] * 5 + [bool] * 2 + [np.float64]
        return {k: np.zeros(0, t) for k, t in zip(names, kinds, strict=True)}
    return {k: np.concatenate(v) for k, v in zip(names, zip(*parts, strict=True), strict=True)}


def quality_report(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the score ``llr``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judge(model, column(batch, "text"))
            yield batches_of({"doc_id": column(batch, "doc_id")} | {k: pa.array(v) for k, v in found.items()})

    counts = [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    flags = [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]
    schema = T.StructType([docs.schema["doc_id"], *counts, *flags, T.StructField("llr", T.DoubleType())])
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(model, column(batch, "text"))["kept"]))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
