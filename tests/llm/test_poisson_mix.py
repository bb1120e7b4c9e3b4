import hashlib
import math
from collections import Counter

import pytest

from pointloom.llm import poisson_mix
from tests.llm.cases import EDGE, edge, empty


def brute(rows, weights, other, seed):
    """Counts by id; for an id ``null:...`` see the module."""
    group = lambda s: s if s in weights else None
    n = Counter(group(s) for _, s in rows)
    w = {g: weights.get(g, other) for g in n}
    out = Counter()
    for i, s in rows:
        g = group(s)
        mean = w[g] / sum(w.values()) * len(rows) / n[g]
        if not mean:
            continue
        u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, total = 0, math.exp(-mean)
        while total <= u:
            k += 1
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if k:
            out[i] += k
    return out


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = {"src0": 3.0, "src1": 0.5, "src2": 0.0}
    want = brute([(r["doc_id"], r["source"]) for r in docs.collect()], weights, 1.0, 5)
    out = poisson_mix.replicate_to_weights(docs, weights, 1.0, seed=5)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == want
    assert not [r for r in rows if r["source"] == "src2"] and all(1 <= r["copy"] <= want[r["doc_id"]] for r in rows)
    again = poisson_mix.replicate_to_weights(docs.repartition(5), weights, 1.0, seed=5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_rows_without_an_id_are_drawn_apart(spark):
    texts = [f"text {i}" for i in range(300)] + [None, ""]
    rows = [(None, t, "a") for t in texts]
    out = poisson_mix.replicate_to_weights(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1.0}, total=600, seed=4).collect()
    want = Counter()
    for t in texts:
        u = (int(hashlib.md5(f"4:null:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, total, mean = 0, math.exp(-600 / 302), 600 / 302
        while total <= u:
            k += 1
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        want[t] += k
    assert Counter(r["text"] for r in out) == +want and len({r["shuffle_key"] for r in out}) > 400


def test_shares_and_shuffle(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    weights = {"hot": 0.1} | {f"s{i}": 0.9 / 7 for i in range(7)}
    rows = poisson_mix.replicate_to_weights(docs, weights, total=50000).collect()
    n = Counter(r["source"] for r in rows)
    assert abs(len(rows) - 50000) < 1200 and abs(n["hot"] / len(rows) - 0.1) < 0.01
    keys = [r["shuffle_key"] for r in rows]
    assert abs(sum(a < b for a, b in zip(keys, keys[1:], strict=False)) / len(keys) - 1) < 0.01 and len(set(keys)) == len(keys)


def test_large_means_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "t", "rare")] + [(i, "t", "x") for i in range(2, 12)], "doc_id long, text string, source string")
    rows = poisson_mix.replicate_to_weights(docs, {"rare": 1.0, "x": 0.0}, total=2000).collect()
    assert 1750 < len(rows) < 2250 and {r["source"] for r in rows} == {"rare"}


def test_edges(spark):
    out = poisson_mix.replicate_to_weights(edge(spark), {"src0": 1.0}, other=1.0, total=40, seed=2)
    assert set(out.columns) == set(edge(spark).columns) | {"shuffle_key"} and dict(out.dtypes)["copy"] == "int"
    assert Counter(r["doc_id"] for r in out.collect()).keys() <= {r[0] for r in EDGE}
    assert poisson_mix.replicate_to_weights(empty(spark), {"src0": 1.0}).count() == 0
    assert poisson_mix.replicate_to_weights(edge(spark), {}, other=1.0).count() >= 0
    with pytest.raises(ValueError):
        poisson_mix.replicate_to_weights(edge(spark), {"a": -1.0})
