import re

import numpy as np
import pytest

from pointloom.llm import quality
from tests.llm.cases import EDGE, edge, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n


def counts(df):
    return sorted(tuple(r)[1:7] for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())


def test_base_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.QualityModel(np.zeros(1 << 16, np.int64), None)
    assert counts(quality.quality_report(docs, model)) == sorted(brute(r["text"]) for r in docs.collect())
    assert counts(quality.quality_report(edge(spark), model)) == sorted(brute(r[1]) for r in EDGE)


def test_windows_do_not_cross_documents():
    words = b"a b c d e f g h "
    raw = np.frombuffer(words * 2, np.uint8)
    base = quality.base_counts(raw, np.array([0, 16, 32]))
    assert base.n_repeat_words.tolist() == [0, 0] and base.n_words.tolist() == [8, 8]


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs, labels, quality.fit(docs, labels)


def test_ratio_matches_brute_force(fitted):
    docs, labels, model = fitted
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    n = np.zeros((2, 1 << 16))
    for r in docs.collect():
        t = (r["text"] or "").encode()
        for i in range(len(t) - 3):
            word = int.from_bytes(t[i : i + 4], "little")
            word ^= word >> 15
            bucket = (word * 2654435761 & 0xFFFFFFFF) >> 16
            n[0, bucket] += 1
            n[1, bucket] += r["doc_id"] in good
    share = (n + 1) / (n.sum(axis=1, keepdims=True) + (1 << 16))
    assert np.array_equal(model.ratio, np.round(np.log(share[1] / share[0]) * (1 << 20)).astype(np.int64))


def test_verdict_does_not_depend_on_partitions_and_separates(fitted):
    docs, labels, model = fitted
    one = {tuple(r) for r in quality.quality_report(docs.repartition(1), model).collect()}
    many = {tuple(r) for r in quality.quality_report(docs.repartition(7), model).collect()}
    assert one == many
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs, model).where("not base_failed").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in kept}
    good = [kept[i] for i, q in truth.items() if q == 1]
    bad = [kept[i] for i, q in truth.items() if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_filter_keeps_columns_and_edges(spark, fitted):
    docs, _, model = fitted
    out = quality.keep_good(edge(spark), model)
    assert out.columns == edge(spark).columns and {r["doc_id"] for r in out.collect()} <= {r[0] for r in EDGE}
    assert quality.keep_good(empty(spark), model).count() == 0
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    bare = quality.fit(empty(spark), none)
    assert bare.threshold is None and not bare.ratio.any()
    assert quality.quality_report(edge(spark), quality.fit(edge(spark), none)).count() == len(EDGE)


def test_threshold_prefers_a_gap():
    good, bad = np.zeros(100, int), np.zeros(100, int)
    good[60:80], bad[10:20] = 5, 5
    assert 20 <= quality.threshold_of(good, bad, 0.0) <= 60
