import numpy as np
import pyarrow as pa
import pytest

from pointloom.operators import checkpoints, features, neighbors, sampling, voxelmap
from pointloom.plans import local
from pointloom.schema import COV, NORMAL, XYZ
from tests.test_expr import frame

RNG = np.random.default_rng(5)
CLOUDS = {
    "small box": RNG.uniform(-1, 1, (256, 3)),
    "huge box": RNG.uniform(-1e6, 1e6, (256, 3)),
    "two boxes": RNG.uniform(0.5, 1, (256, 3)) * np.where(RNG.random((256, 1)) < 0.5, -1, 1),
    "lattice with ties": RNG.integers(-3, 4, (256, 3)).astype(float),
    "normal": RNG.normal(size=(256, 3)),
    "ten": RNG.normal(size=(10, 3)),
    "five": RNG.normal(size=(5, 3)),
}


def brute(q, t, k):
    d = q[:, None, :] - t[None, :, :]
    d2 = d[:, :, 0] * d[:, :, 0] + d[:, :, 1] * d[:, :, 1] + d[:, :, 2] * d[:, :, 2]
    order = np.argsort(d2, axis=1, kind="stable")[:, : min(k, len(t))]
    return {i: [(int(j), float(d2[i, j])) for j in row] for i, row in enumerate(order)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["point_id"], r["sq_dist"]))
    return out


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("nested", [4096, 0])
def test_knn_is_exact(spark, name, nested):
    t = CLOUDS[name]
    q = CLOUDS["small box"][:60] * 3
    assert found(neighbors.knn(frame(spark, q), frame(spark, t), 7, nested_loop_targets=nested)) == brute(q, t, 7)


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("width", [None, 0.3])
def test_the_tree_is_exact_for_far_queries(spark, name, width):
    t = CLOUDS[name]
    if name == "huge box" and width:
        width = 2e5
    q = np.concatenate([t[:20], t[:20] * 50, t[:10] + 1e3, t[:10] * [1, 0, 0]])
    assert found(neighbors.tree_knn(frame(spark, q), frame(spark, t), 5, width)) == brute(q, t, 5)


@pytest.mark.parametrize("name", CLOUDS)
def test_the_grid_in_a_task_is_exact(name):
    t = CLOUDS[name]
    for q in (t, t * 3 + 0.1, t[:7] + 1e4, np.zeros((0, 3))):
        for k in (1, 5, 300):
            idx, d2 = local.knn(q, t, k)
            d = ((q[:, None, :] - t[None, :, :]) ** 2).sum(axis=2)
            order = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(t))]
            assert (idx == order).all() and np.allclose(d2, np.take_along_axis(d, order, axis=1), rtol=1e-12)
    assert local.knn(t, np.zeros((0, 3)), 3)[0].shape == (len(t), 0)


def test_the_grid_scales_past_a_full_matrix():
    t = RNG.uniform(0, 50, (30_000, 3))
    index = local.Grid(t)
    idx, d2 = index.search(t[::3] + 0.01, 10)
    some = RNG.integers(0, 10_000, 50)
    for i in some:
        d = ((t[3 * i] + 0.01 - t) ** 2).sum(axis=1)
        assert (idx[i] == np.argsort(d, kind="stable")[:10]).all()


def test_one_point(spark):
    t = CLOUDS["lattice with ties"]
    rows = neighbors.nearest_to(frame(spark, t), (0.2, 0.0, 0.0), 4).orderBy("rank").collect()
    assert [(r["point_id"], r["sq_dist"]) for r in rows] == brute(np.array([[0.2, 0.0, 0.0]]), t, 4)[0]
    assert neighbors.nearest_to(frame(spark, np.zeros((0, 3))), (0, 0, 0)).count() == 0
    assert found(neighbors.knn(frame(spark, t[:9]), frame(spark, t), 3, epsilon=0.5)) == brute(t[:9], t, 3)
    with pytest.raises(ValueError):
        neighbors.knn(frame(spark, t), frame(spark, t), 3, epsilon=-1.0)


@pytest.mark.parametrize("name", ["small box", "lattice with ties"])
def test_radius(spark, name):
    p = CLOUDS[name]
    q = p + 0.1
    want = {i: v[0] for i, v in brute(q, p, 1).items() if v[0][1] <= 0.3 * 0.3}
    got = {r["query_id"]: (r["point_id"], r["sq_dist"]) for r in neighbors.radius_nn(frame(spark, q), frame(spark, p), 0.3).collect()}
    assert got == want


def test_left_and_arrays(spark):
    q, t = CLOUDS["ten"], CLOUDS["five"]
    rows = neighbors.knn_left(frame(spark, q + 100), frame(spark, t), 2, max_distance=1.0).collect()
    assert len(rows) == 10 and all(r["point_id"] is None for r in rows)
    wide = neighbors.knn_arrays(frame(spark, q), frame(spark, t), 7).first()
    assert len(wide["point_ids"]) == 7 and wide["point_ids"][5:] == [None, None]
    assert neighbors.nearest(frame(spark, q), frame(spark, t)).count() == 10


def test_voxel_probe_and_offsets(spark):
    p = CLOUDS["normal"]
    cells = sampling.with_voxels(frame(spark, p), 0.5)
    all27 = found(neighbors.voxel_probe_knn(frame(spark, p), cells, 0.5, 3, 27))
    exact = brute(p, p, 3)
    for i, v in all27.items():
        assert v[0] == exact[i][0] and len(set(v)) == len(v)  # no cell is probed twice
        assert [x for x in v if x[1] <= 0.25] == [x for x in exact[i] if x[1] <= 0.25]
    with pytest.raises(ValueError):
        neighbors.voxel_probe_knn(frame(spark, p), cells, 0.5, 3, 5)


def test_projective(spark):
    p = CLOUDS["normal"]
    raster = neighbors.index_map(frame(spark, np.concatenate([p, p])), 64, 32).collect()
    assert all(r["point_id"] >= 256 for r in raster)  # the last point of a pixel wins
    rows = neighbors.projective_knn(frame(spark, p), frame(spark, p), 512, 128, k=1).collect()
    assert np.mean([r["sq_dist"] == 0 for r in rows]) > 0.95


def test_voxel_grid(spark):
    p = RNG.uniform(-3, 3, (2000, 3))
    rows = sampling.voxel_grid(frame(spark, p), 0.5, order=True).collect()
    want = local.voxel_means(p, 0.5)
    assert np.allclose(np.array([[r[c] for c in XYZ] for r in rows]), want)
    assert sum(r["n"] for r in rows) == 2000
    assert all(np.floor(r[c] * 2) == r["v" + c] for r in rows for c in XYZ)
    assert sampling.voxel_grid(frame(spark, np.zeros((0, 3))), 1.0).count() == 0
    assert sampling.voxel_grid(frame(spark, [[1e9, 0, 0]]), 1.0).count() == 0


def test_random_sample(spark):
    df = frame(spark, RNG.normal(size=(1000, 3)))
    for n, want in ((0, 0), (100, 100), (5000, 1000)):
        rows = sampling.random_sample(df, n, seed=3).collect()
        assert len(rows) == want == len({r["point_id"] for r in rows})
    assert {r["point_id"] for r in sampling.random_sample(df, 50, 1).collect()} == {r["point_id"] for r in sampling.random_sample(df.repartition(7), 50, 1).collect()}


def test_features(spark):
    p = RNG.normal(size=(300, 3)) + 5
    p[:100, 2] = 0.0  # a plane
    df = features.estimate_normals_covariances(frame(spark, p), 10)
    rows = df.orderBy("point_id").collect()
    normals = np.array([[r[c] for c in NORMAL] for r in rows])
    want_n, want_c = local.features(p, 10)
    assert np.allclose(np.linalg.norm(normals, axis=1), 1) and ((normals * p).sum(axis=1) <= 1e-12).all()
    assert np.allclose(normals[:, :, None] * normals[:, None, :], want_n[:, :, None] * want_n[:, None, :], atol=1e-6)
    full = np.array([[r[c] for c in COV] for r in rows])
    assert np.allclose(full, want_c[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]], atol=1e-6)
    few = features.estimate_normals_covariances(frame(spark, p[:4]), 10).collect()
    assert all(tuple(r[c] for c in NORMAL) == (0, 0, 0) and tuple(r[c] for c in COV) == (1, 0, 0, 1, 0, 1) for r in few)
    assert "nx" not in features.estimate_covariances(frame(spark, p), 10).columns and "cxx" not in features.estimate_normals(frame(spark, p), 10).columns


def test_flat_map_is_greedy_in_order(spark):
    p = RNG.uniform(0, 2, (3000, 3))
    kept = {}
    for i, x in enumerate(p):
        cell = kept.setdefault(tuple(np.floor(x).astype(int)), [])
        if len(cell) < 10 and all(((x - p[j]) ** 2).sum() >= 0.01 for j in cell):
            cell.append(i)
    got = {}
    for r in voxelmap.flat_voxelmap(frame(spark, p).repartition(6), 1.0).collect():
        got.setdefault((r["vx"], r["vy"], r["vz"]), []).append((r["slot"], r["point_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == kept
    index = voxelmap.map_indices(voxelmap.flat_voxelmap(frame(spark, p), 1.0)).collect()
    cells = sorted({(r["vx"], r["vy"], r["vz"]) for r in index})
    assert {(r["vx"], r["vy"], r["vz"]): r["voxel_id"] for r in index} == {c: k for k, c in enumerate(cells)}
    assert len({r["global_index"] for r in index}) == len(index) and all(r["global_index"] == r["voxel_id"] << 32 | r["slot"] for r in index)


def test_the_fold_of_a_flat_map_in_any_batches():
    """Against going through the rows one by one, with voxels that span batches and points that coincide."""
    xyz = np.concatenate([RNG.uniform(0, 2, (400, 3)), np.repeat(RNG.uniform(0, 2, (5, 3)), 30, axis=0)])
    cell = np.floor(xyz).astype(np.int64)
    order = np.lexsort((np.arange(len(xyz)), cell[:, 2], cell[:, 1], cell[:, 0]))
    xyz, cell = xyz[order], cell[order]
    for most, spacing in ((10, 0.01), (3, 0.2), (1000, 0.0)):
        want, kept, last = [], [], None
        for i, c in enumerate(map(tuple, cell.tolist())):
            kept = kept if c == last else []
            last = c
            if len(kept) < most and all(((xyz[i] - xyz[j]) ** 2).sum() >= spacing for j in kept):
                want.append((i, len(kept)))
                kept.append(i)
        columns = dict(zip(("vx", "vy", "vz"), cell.T, strict=True)) | dict(zip(XYZ, xyz.T, strict=True)) | {"i": np.arange(len(xyz))}
        for size in (1, 7, 1000):
            batches = [pa.RecordBatch.from_pydict({c: np.ascontiguousarray(v[a : a + size]) for c, v in columns.items()}) for a in range(0, len(xyz), size)]
            got = [(r["i"], r["slot"]) for b in voxelmap._fold(most, spacing)(iter(batches)) for r in b.to_pylist()]
            assert got == want


def test_a_map_as_a_cloud(spark):
    p = RNG.uniform(0, 3, (500, 3))
    voxels = voxelmap.gaussian_voxelmap(frame(spark, p), 1.0)
    cells = voxelmap.map_cloud(voxels).orderBy("point_id").collect()
    assert [r["point_id"] for r in cells] == list(range(len(cells)))
    assert [(r["x"], r["n"]) for r in cells] == [(r["x"], r["n"]) for r in voxels.orderBy("vx", "vy", "vz").collect()]
    flat = voxelmap.map_cloud(voxelmap.flat_voxelmap(frame(spark, p), 1.0))
    assert flat.select("point_id").distinct().count() == flat.count() and set(XYZ) <= set(flat.columns)


def test_numbered(spark):
    rows = [(int(x),) for x in RNG.permutation(5000)]
    got = checkpoints.numbered(spark.createDataFrame(rows, "v long").repartition(9), ["v"], "at").collect()
    assert all(r["v"] == r["at"] for r in got) and len(got) == 5000


def test_frame_pairs(spark):
    df = spark.createDataFrame([(3,), (1,), (7,), (3,)], "frame_id long")
    assert sorted(tuple(r) for r in neighbors.frame_pairs(df).collect()) == [(3, 1), (7, 3)]
