import numpy as np
import pytest

from pointloom.llm import prefix_forest as f

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, n, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % n == 0):
        s = (x * x[q]).sum(axis=1)
        others = np.flatnonzero(ids != ids[q])
        top = others[np.lexsort((ids[others], -s[others]))[:k]]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in top]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(len(want[q]), 1) for q in want])


def clustered(rng, n, dim):
    """Vectors of unequal lengths around a few centres, one of which has a third of them."""
    centres = rng.normal(size=(8, dim))
    pick = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 8, n))
    return (centres[pick] + rng.normal(size=(n, dim)) * 0.3) * rng.uniform(0.5, 2.0, (n, 1))


@pytest.mark.parametrize("kind", ["even", "clustered"])
@pytest.mark.parametrize(("n", "how"), [(2, {}), (15, {}), (21, {}), (60, {}), (100, {"shard_rows": 30}), (500, {}), (500, {"shard_rows": 100, "query_rows": 7}), (2000, {}), (5000, {"shard_rows": 2048}), (9000, {})])
def test_recall_at_every_size(spark, n, how, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32)) if kind == "even" else clustered(rng, n, 32)
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    want, got = brute(rows, 20), found(f.nearest(spark.createDataFrame(rows, SCHEMA), f.every_nth(20), **how))
    assert all(len(got.get(q, [])) == min(20, n - 1) for q in want)
    assert recall(got, want) >= 0.9 and (n > 21 or recall(got, want) == 1)


@pytest.mark.parametrize("how", [{}, {"shard_rows": 100, "query_rows": 7}])
def test_recall(spark, how):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows, 20), found(f.nearest(df, f.every_nth(20), **how))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, v in brute(rows, 20, 10**6).items() for i, s in v}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_every_query_of_few_rows():
    """Every row asks, at the sizes where an ascent could end too early."""
    rng = np.random.default_rng(3)
    for n in (2, 15, 21, 60, 100):
        x = rng.normal(size=(n, 64))
        shard = f.Shard.build(x, (x * x).sum(axis=1).max(), np.arange(n), np.arange(n + 1), f.TREES, f.SEED)
        hits = list(shard.search(x, np.arange(n), np.full(n, np.nan), 20, f.MISS))
        true = np.argsort(-(x @ x.T) + 1e9 * np.eye(n), axis=1)[:, : min(20, n - 1)]
        assert all(len(v) == min(20, n - 1) for v, _ in hits)
        assert np.mean([len(set(t) & set(v)) / len(t) for t, (v, _) in zip(true, hits, strict=True)]) >= 0.9


def test_well_under_half_is_scored_where_neighbours_stand_out():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(160, 32)), 50, axis=0) + rng.normal(size=(8000, 32)) * 0.2
    shard = f.Shard.build(x, (x * x).sum(axis=1).max(), np.arange(8000), np.arange(8001), f.TREES, f.SEED)
    list(shard.search(x[::80], np.arange(0, 8000, 80), np.full(100, np.nan), 20, f.MISS))
    assert shard.scored < 0.1 * 8000 * 100


def test_positions_are_the_least_that_keep_the_promise():
    """Against the definition, tree by tree."""
    for cosine in (-0.9, 0.0, 0.2, 0.41, 0.8, 0.99):
        p, at = 1 - np.arccos(cosine) / np.pi, int(f.positions(np.array([cosine]), 16, 0.06)[0])

        def missed(at):
            level = -(-at // 16)
            up = level * 16 - at
            return (1 - p ** (level - 1)) ** up * (1 - p**level) ** (16 - up)

        assert missed(at) <= 0.06 and (at == 16 * f.BITS or missed(at + 1) > 0.06)
    assert f.positions(np.array([-1.0, 1.0]), 16, 0.06).tolist()[1] == 16 * f.BITS


def test_ties_and_copies_are_exact(spark):
    rng = np.random.default_rng(1)
    hot = [0.5, 0.5, 0.5, 0.5]
    rows = [(i, hot, 0) for i in range(300)] + [(20, hot, 0)] * 60 + [(i, rng.normal(size=4).round(1).tolist(), 0) for i in range(300, 400)]
    got = found(f.nearest(spark.createDataFrame(rows, SCHEMA), f.every_nth(20), miss=1e-300, shard_rows=150))
    want = brute(rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_edges(spark):
    good = [(20, [1.0, 0.0], 1), (40, [0.0, 2.0], 1), (1, [1.0, 1.0], None), (1, [1.0, 1.0], None), (2, [3.0, 0.0, 1.0], 0)]
    bad = [(3, None, 0), (60, [0.0, 0.0], 0), (80, [float("nan"), 1.0], 0), (100, [float("inf"), 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 0.0], 0), (5, [], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "'x' AS v", "1 AS score", "2 AS shard", "3 AS n", "4 AS block")
    got = found(f.nearest(df, f.every_nth(20)))
    assert got == {20: [(1, 1.0), (1, 1.0), (40, 0.0)], 40: [(1, 2.0), (1, 2.0), (20, 0.0)]}
    assert f.nearest(spark.createDataFrame([], SCHEMA), f.every_nth(20)).count() == 0
