"""The block search: exact in many blocks, with copies, ties and far queries, and rows in line with the points."""

import numpy as np
import pytest

from pointloom.operators import blocks, neighbors, sampling
from tests.test_expr import frame
from tests.test_operators import brute, found

RNG = np.random.default_rng(11)


def most_rows(df) -> int:
    """The most rows that a step of the plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        todo += [plan.children().apply(i) for i in range(plan.children().length())]
    return most


@pytest.fixture(scope="module")
def dense(spark):
    """A cloud that lies within the radius of each of its points."""
    p = RNG.uniform(0.1, 0.5, (2500, 3))
    return p, frame(spark, p).persist()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 32)
    monkeypatch.setattr(blocks, "GROUP_QUERIES", 40)


#: Copies, a lattice with ties, and a few points far from the rest.
TARGETS = np.concatenate([np.repeat(RNG.normal(size=(40, 3)), 9, axis=0), RNG.integers(-3, 4, (600, 3)), RNG.normal(size=(20, 3)) * 100])
QUERIES = np.concatenate([TARGETS[::5], RNG.normal(size=(60, 3)) + [0, 0, 40], np.repeat([[0.5, 0.5, 0.5]], 90, axis=0), [[1e4, 0, 0]]])


@pytest.mark.parametrize("k", [1, 4])
def test_blocks_are_exact(spark, small_blocks, k):
    got = neighbors.knn(frame(spark, QUERIES), frame(spark, TARGETS), k, nested_loop_targets=0)
    assert found(got) == brute(QUERIES, TARGETS, k)


def test_more_neighbours_than_a_block_has(spark, small_blocks):
    q = QUERIES[::40]
    assert found(neighbors.knn(frame(spark, q), frame(spark, TARGETS[:200]), 150, nested_loop_targets=0)) == brute(q, TARGETS[:200], 150)


def test_points_that_are_nowhere_take_no_part(spark, small_blocks):
    t = np.concatenate([TARGETS[:100], [[np.nan, 0, 0], [0, np.inf, 0]]])
    got = found(neighbors.knn(frame(spark, t[-3:]), frame(spark, t), 2, nested_loop_targets=0))
    assert got == {0: brute(t[99:100], t[:100], 2)[0]}


def test_the_nearest_within_a_radius_takes_no_pairs(spark, dense):
    p, df = dense
    assert most_rows(neighbors.radius_nn(df, df, 1.0)) < 10 * len(p)


def test_few_targets_for_many_queries_take_no_pairs(spark, dense):
    p, df = dense
    assert most_rows(neighbors.knn(frame(spark, np.concatenate([p, p + 0.01])), df, 1)) < 10 * len(p)


@pytest.mark.parametrize("offsets", [1, 7, 27])
def test_probes_are_exact_in_their_cells(spark, small_blocks, offsets):
    p = TARGETS[:700] * [1.3, 1.0, 0.7]
    q = np.concatenate([p[::9] + 0.2, QUERIES[-20:]])
    got = found(neighbors.voxel_probe_knn(frame(spark, q), sampling.with_voxels(frame(spark, p), 1.0), 1.0, 4, offsets))
    off = np.abs(np.floor(q)[:, None] - np.floor(p)[None])
    d2 = ((q[:, None] - p[None]) ** 2) @ np.ones(3)
    d2[~(off.sum(axis=2) <= 1 if offsets == 7 else off.max(axis=2) <= (offsets == 27))] = np.inf
    for i in range(len(q)):
        order = np.argsort(np.round(d2[i], 12), kind="stable")[:4]
        assert [j for j, _ in got.get(i, [])] == [j for j in order if d2[i, j] < np.inf]


def test_probes_of_full_cells_take_no_pairs(spark, dense):
    p, df = dense
    assert most_rows(neighbors.voxel_probe_knn(df, sampling.with_voxels(df, 1.0), 1.0, 5, 27)) < 30 * len(p)


@pytest.mark.parametrize("pixels", [1 << 20, 0])
def test_projective_searches_are_exact_in_their_windows(spark, monkeypatch, pixels):
    """Both ways, with copies and windows over the seam, against all pixels."""
    monkeypatch.setattr(neighbors, "RASTER_PIXELS", pixels)
    p = np.concatenate([RNG.normal(size=(300, 3)), np.repeat(RNG.normal(size=(20, 3)), 3, axis=0)])
    width, height, window = 40, 20, (6, 3)
    n = np.sqrt((p * p).sum(axis=1))
    u = ((np.arctan2(p[:, 0] / n, p[:, 2] / n) / (2 * np.pi) + 0.5) * width).astype(int)
    v = ((-np.arcsin(p[:, 1] / n) / np.pi + 0.5) * height).astype(int)
    last = {(a, b): i for i, (a, b) in enumerate(zip(u, v, strict=True)) if 0 <= a < width and 0 <= b < height}
    got = found(neighbors.projective_knn(frame(spark, p), frame(spark, p), width, height, k=3, window=window))
    for i in range(len(p)):
        near = [j for (a, b), j in last.items() if min(abs(a - u[i]), width - abs(a - u[i])) <= window[0] and abs(b - v[i]) <= window[1]]
        d = {j: float(((p[i] - p[j]) ** 2) @ np.ones(3)) for j in near}
        assert [j for j, _ in got.get(i, [])] == sorted(near, key=lambda j: (round(d[j], 12), j))[:3]


def test_projective_searches_take_no_pairs(spark, dense):
    p, df = dense
    assert most_rows(neighbors.projective_knn(df, df, 512, 128, k=3)) < 10 * len(p)
