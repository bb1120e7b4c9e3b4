"""Language identification by multilingual mixture inference.

Each language has a multinomial over hashed byte trigrams, learned from labelled
documents. A word (with a space on both sides) has a likelihood under each language;
a document is a mixture of languages that generate its words. Expectation
maximisation estimates the proportions; the language set is the one of the nested
sets (the most frequent language, the two most frequent, ...) with the highest
log-likelihood less log(words) / 2 for each language. The prediction is the set's
most frequent language. An estimate ends after 25 rounds, or once no proportion moves by 0.001; a
language whose first estimate is below 0.02 of the document is in no larger set.

The model is one table of languages times buckets, which the driver gathers and every task gets; labels
with more than 256 values are refused, as that table would have no bound.

Only the text decides: the language label serves to learn from documents that are
not held out, nothing else of a document is looked at.

Defined results: ``und`` with score 0 for a null text, a text without letters, and
if nothing was learned; a null ``doc_id`` is held out; repeated rows are alike; equal
proportions go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm._util import batches_of, column, in_small_batches, runs, utf8

BUCKET_BITS = 15
SMOOTHING = 0.5
EM_ROUNDS, EM_STEP = 25, 1e-3
#: Languages below this share after the first estimate are not tried in a larger set.
MIN_SHARE = 0.02
HELD_OUT_MOD, HELD_OUT = 4, 2
MAX_LANGUAGES = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def is_held_out() -> Column:
    """Whether crc32 of doc_id as text leaves the held-out remainder."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_MOD))
    return F.coalesce(rest == HELD_OUT, F.lit(True))


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each followed by a space; one more space in front of them all."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    raw, offsets = utf8(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
    raw = np.concatenate([np.array([32], np.uint8), raw])
    return np.where(_SPACE[raw], np.uint8(32), raw), offsets + 1


def trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte that isn't a space, and the position of that byte."""
    at = np.flatnonzero(raw != 32)
    x = raw.astype(np.uint32)
    code = (x[at - 1] << np.uint32(16)) | (x[at] << np.uint32(8)) | x[at + 1]
    code ^= code >> np.uint32(11)
    with np.errstate(over="ignore"):
        code *= np.uint32(2654435761)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), at


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(column(batch, "lang").to_pylist(), object)
        raw, offsets = _spaced(column(batch, "text"))
        for i, j in runs(offsets):
            part = np.concatenate([[np.uint8(32)], raw[offsets[i] : offsets[j]]])
            bucket, at = trigrams(part)
            doc = np.searchsorted(offsets[i : j + 1] - offsets[i] + 1, at, side="right") - 1
            for lang in set(langs[i:j]):
                own = bucket[(langs[i:j] == lang)[doc]]
                counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                counts[lang] += np.bincount(own, minlength=1 << BUCKET_BITS)
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield batches_of({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some), "n": pa.array(n[some])})


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from all of ``docs`` (doc_id, text, lang) that are not held out and have a language."""
    learned = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learned.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = (
        in_small_batches(learned)
        .select("lang", "text")
        .mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # languages x buckets at most
    )
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    where = {x: k for k, x in enumerate(names)}
    at = np.array([where[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("bucket").to_numpy(), at] = found.column("n").to_numpy()
    p = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << BUCKET_BITS))
    return LanguageModel(names, np.log(p).astype(np.float32))


# --- inference --------------------------------------------------------------------


def _mixture(like: np.ndarray, top: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``share`` for documents of ``n`` words; ``like`` is words x languages, scaled by exp(-top).

    Returns the proportions and the log-likelihoods. Documents leave once they move
    by less than EM_STEP.
    """
    share = share.copy()
    total = np.zeros(len(n))
    active = np.arange(len(n))
    words = np.arange(len(like))
    for k in range(EM_ROUNDS):
        own = n[active]
        starts = np.concatenate([[0], np.cumsum(own)[:-1]])
        r = like[words] * np.repeat(share[active], own, axis=0)
        s = r.sum(axis=1)
        r /= s[:, None]
        total[active] = np.add.reduceat(np.log(s) + top[words], starts)
        new = np.add.reduceat(r, starts, axis=0) / own[:, None]
        moved = np.abs(new - share[active]).max(axis=1) >= EM_STEP
        share[active] = new
        if not moved.any() or k == EM_ROUNDS - 1:
            break
        words = words[np.repeat(moved, own)]
        active = active[moved]
    return share, total


def infer(log_word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (0 outside the chosen set) and the size of the set, for documents of n > 0 words."""
    k = log_word.shape[1]
    top = log_word.max(axis=1)
    like = np.exp(log_word - top[:, None]).astype(np.float64)
    np.maximum(like, 1e-30, out=like)
    share, _ = _mixture(like, top, n, np.full((len(n), k), 1.0 / k))
    order = np.argsort(-share, axis=1, kind="stable")
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    single = np.add.reduceat(log_word.astype(np.float64), starts, axis=0)
    rows = np.arange(len(n))
    best = single[rows, order[:, 0]] - np.log(n) / 2
    chosen = np.zeros_like(share)
    chosen[rows, order[:, 0]] = 1.0
    size = np.ones(len(n), np.int64)
    for m in range(2, k + 1):
        again = np.flatnonzero(share[rows, order[:, m - 1]] >= MIN_SHARE)
        if not len(again):
            break
        start = share[again].copy()
        np.put_along_axis(start, order[again][:, m:], 0.0, axis=1)
        start /= start.sum(axis=1, keepdims=True)
        words = np.flatnonzero(np.repeat(np.isin(rows, again), n))
        found, total = _mixture(like[words], top[words], n[again], start)
        value = total - m * np.log(n[again]) / 2
        better = value > best[again]
        best[again[better]] = value[better]
        chosen[again[better]] = found[better]
        size[again[better]] = m
    return chosen, size


def _word_log_likelihoods(model: LanguageModel, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket, at = trigrams(part)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros((0, len(model.languages))), starts
    return np.add.reduceat(model.log_p[bucket], starts, axis=0), at[starts]


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in batches:
            texts = column(batch, "text")
            raw, offsets = _spaced(texts)
            share, size = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows, np.int64)
            letters = np.array([any(map(str.isalpha, t.as_py() or "")) for t in texts], bool)
            if k:
                for i, j in runs(offsets):
                    part = np.concatenate([[np.uint8(32)], raw[offsets[i] : offsets[j]]])
                    logs, first = _word_log_likelihoods(model, part)
                    n = np.diff(np.searchsorted(first, offsets[i : j + 1] - offsets[i] + 1))
                    some = np.flatnonzero(n)
                    if len(some):
                        share[i + some], size[i + some] = infer(logs, n[some])
            share[~letters], size[~letters] = 0, 0
            best = share.argmax(axis=1) if k else np.zeros(batch.num_rows, int)
            names = np.array([*model.languages, "und"], object)
            score = share.max(axis=1) if k else np.zeros(batch.num_rows)
            pred = names[np.where(score > 0, best, k)]
            sets = [[model.languages[x] for x in np.argsort(-s, kind="stable")[:m]] for s, m in zip(share, size, strict=True)]
            yield batches_of(
                {
                    "doc_id": column(batch, "doc_id"),
                    "held_out": column(batch, "held_out"),
                    "lang_pred": pa.array(pred.tolist(), pa.string()),
                    "score": pa.array(np.clip(score, 0.0, 1.0)),
                    "languages": pa.array(sets, pa.list_(pa.string())),
                    "shares": pa.array([sorted((float(x) for x in s if x > 0), reverse=True) for s in share], pa.list_(pa.float64())),
                }
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and the chosen ``languages`` with their ``shares``."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.ArrayType(T.StringType())),
            T.StructField("shares", T.ArrayType(T.DoubleType())),
        ]
    )
    return in_small_batches(docs).select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(_predict(model), schema)
