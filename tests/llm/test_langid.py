import zlib

import numpy as np
import pytest

from pointloom.llm import langid
from tests.llm.cases import EDGE, edge, empty


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.fit(docs)


def test_held_out_accuracy_and_split(fitted):
    docs, model = fitted
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.predict(docs, model).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_the_text_decides(spark, fitted):
    docs, model = fitted
    from pyspark.sql import functions as F

    one = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    blind = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(5)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(blind, model).collect()} == one


def test_counts_match_brute_force(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("Ab c\nd", "x"), ("éa b", "y"), ("q", None), ("zz top", "x"), (None, "y"), ("more Words", "y"), ("a", "x"), ("b", "y")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    counts = {lang: np.zeros(1 << langid.BUCKET_BITS) for lang in ("x", "y")}
    for i, t, lang, *_ in rows:
        if lang is None or t is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        for word in t.lower().split():
            b = b" " + word.encode() + b" "
            for k in range(len(b) - 2):
                code = int.from_bytes(b[k : k + 3], "big")
                code ^= code >> 11
                counts[lang][(code * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)] += 1
    assert model.languages == ["x", "y"]
    for k, lang in enumerate(model.languages):
        p = (counts[lang] + langid.SMOOTHING) / (counts[lang].sum() + langid.SMOOTHING * (1 << langid.BUCKET_BITS))
        assert np.allclose(model.log_p[:, k], np.log(p), atol=1e-4)


def test_em_recovers_proportions():
    rng = np.random.default_rng(0)
    n, k = 4000, 3
    z = rng.choice(k, n, p=[0.7, 0.3, 0.0])
    logs = np.log(np.where(np.eye(k, dtype=bool)[z], 0.9, 0.05)).astype(np.float32)
    share, size = langid.infer(np.concatenate([logs, logs[:1]]), np.array([n, 1]))
    assert size.tolist() == [2, 1] and np.allclose(share[0], [0.7, 0.3, 0], atol=0.03) and share[1].max() == 1


def test_mixture_of_two_languages(spark, fitted):
    docs, model = fitted
    de, fr = (docs.where(f"lang = '{x}' AND n_chars > 2000").orderBy("doc_id").first()["text"] for x in ("de", "fr"))
    row = langid.predict(spark.createDataFrame([(1, de[:2000] + "\n" + fr[:1000])], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "de" and set(row["languages"]) >= {"de", "fr"} and 0.5 < row["score"] < 0.8


def test_edges(spark, fitted):
    _, model = fitted
    rows = langid.predict(edge(spark), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE)
    assert [by[i]["lang_pred"] for i in (3, 4, 7)] == ["und"] * 3 and by[None]["held_out"]
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge(spark), langid.fit(empty(spark))).collect()} == {"und"}


def test_too_many_languages_are_refused(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
