import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.lie import inverse, se3_exp
from pointloom.operators.features import estimate_normals_covariances
from pointloom.operators.voxelmap import gaussian_voxelmap, lru_survivors
from pointloom.plans import kernels, local, odometry
from pointloom.plans.optimize import GaussNewton, LevenbergMarquardt, NullFactor, RestrictDoF, TerminationCriteria
from pointloom.plans.registration import Registration, RegistrationSession, align, correspondences, linear_system, linearize_point, relative_pose_error
from pointloom.streaming.voxelmap import ModelOdometry, VoxelMap
from tests.test_expr import frame

TRUTH = se3_exp(np.array([0.03, -0.02, 0.04, 0.15, -0.1, 0.05]))


def room(n=900, seed=0, noise=0.005):
    """Three orthogonal planes and clutter."""
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 4, (2, n))
    side = rng.integers(0, 3, n)
    p = np.where(side[:, None] == 0, np.stack([a, b, 0 * a], 1), np.where(side[:, None] == 1, np.stack([a, 0 * a, b], 1), np.stack([0 * a, a, b], 1)))
    clutter = rng.uniform(1, 3, (n // 6, 3)) * [1, 1, 0.3]
    return np.concatenate([p, clutter]) + rng.normal(0, noise, (n + n // 6, 3)) + [2, -1, 3]


@pytest.fixture(scope="module")
def pair():
    target = room(seed=0)
    source = room(seed=1)
    inv = inverse(TRUTH)
    return target, source @ inv[:3, :3].T + inv[:3, 3]


def test_statistics_give_the_direct_sums():
    rng = np.random.default_rng(3)
    p, q, a = rng.normal(size=(200, 3)) + 50, rng.normal(size=(200, 3)) + 50, rng.normal(size=(200, 3, 3))
    m = a @ a.transpose(0, 2, 1)
    cs, ct = p.mean(axis=0), q.mean(axis=0)
    quad = kernels.Quadratic(kernels.statistics(p - cs, q - ct, m), cs, ct)
    for t in (np.eye(4), TRUTH, se3_exp(rng.normal(size=6))):
        h, b, e, n = quad.linearize(t)
        dh, db, de = kernels.direct(p, q, m, t)
        assert np.allclose(h, dh) and np.allclose(b, db) and np.isclose(e, de) and n == 200
        assert np.allclose(h, h.T) and np.linalg.eigvalsh(h).min() > 0
    step = 1e-6 * rng.normal(size=6)
    assert np.isclose(quad.error(TRUTH @ se3_exp(step)) - quad.error(TRUTH), quad.linearize(TRUTH)[1] @ step, rtol=1e-3)


@pytest.mark.parametrize("factor", ["icp", "plane", "gicp", "vgicp"])
@pytest.mark.parametrize("optimizer", [LevenbergMarquardt(), GaussNewton()])
def test_local_registration(pair, factor, optimizer):
    target, source = (local.voxel_means(x, 0.2) for x in pair)
    (tn, tc), (_, sc) = (local.features(x, 15) for x in (target, source))
    goal = local.CloudTarget(target, tn, tc)
    if factor == "vgicp":
        goal = VoxelMap(0.7)
        goal.insert(target, tc)
    out = local.register(goal, source, sc, factor, optimizer=optimizer)
    turn, shift = relative_pose_error(TRUTH, out.T)
    assert np.degrees(turn) < 2.5 and shift < 0.2


@pytest.mark.parametrize("kernel", ["huber", "cauchy"])
def test_local_robust(pair, kernel):
    target, source = (local.voxel_means(x, 0.2) for x in pair)
    (tn, tc), (_, sc) = (local.features(x, 15) for x in (target, source))
    out = local.register(local.CloudTarget(target, tn, tc), source, sc, "gicp", kernel=kernel)
    assert relative_pose_error(TRUTH, out.T)[1] < 0.2


@pytest.mark.parametrize("kind", ["PLANE_ICP", "GICP", "VGICP"])
def test_distributed_align(spark, pair, kind):
    target, source = (frame(spark, x) for x in pair)
    out = align(target, source, registration_type=kind, downsampling_resolution=0.3)
    turn, shift = relative_pose_error(TRUTH, out.T)
    assert np.degrees(turn) < 2.5 and shift < 0.2 and out.num_inliers > 50
    assert np.allclose(out.H, out.H.T, atol=1e-3 * abs(out.H).max()) and out.frame(spark).count() == 1


def test_distributed_equals_local(spark, pair):
    target, source = (local.voxel_means(x, 0.4) for x in pair)
    (tn, tc), (_, sc) = (local.features(x, 10) for x in (target, source))
    want = local.register(local.CloudTarget(target, tn, tc), source, sc, "gicp")
    ready = [estimate_normals_covariances(frame(spark, x), 10).persist() for x in (target, source)]
    got = Registration("gicp").align(*ready)
    assert np.allclose(got.T, want.T, atol=1e-6) and got.num_inliers == want.num_inliers and got.iterations == want.iterations
    one = linear_system(correspondences(*ready, TRUTH, "gicp"), TRUTH).first()
    problem = local.LocalProblem(local.CloudTarget(target, tn, tc), source, sc, "gicp", 1.0)
    h, b, e, n = problem.linearize(TRUTH)
    assert np.isclose(one["h00"], h[0, 0]) and np.isclose(one["h25"], h[2, 5]) and np.isclose(one["b4"], b[4]) and np.isclose(one["e"], e) and one["n_inliers"] == n
    free = Registration("gicp", max_distance=None).align(*ready)
    assert relative_pose_error(TRUTH, free.T)[1] < 0.2
    robust = Registration("gicp", kernel="cauchy").align(*ready)
    assert relative_pose_error(TRUTH, robust.T)[1] < 0.2


def test_session(spark, pair):
    target, source = (frame(spark, local.voxel_means(x, 0.4)) for x in pair)
    s = RegistrationSession(max_distance=1.0, num_neighbors=10)
    s.set_target(target)
    s.set_source(source)
    a = s.align().T
    s.swap()
    b = s.align().T
    assert np.allclose(a @ b, np.eye(4), atol=0.05) and s.final_hessian().shape == (6, 6)
    assert s.aligned().count() == s.source.count() and s.target_covariances().columns[0] == "point_id"
    s.set_source_covariances(s.source_covariances().withColumn("cxx", F.lit(1.0)))
    s.clear_target()
    s.clear_source()
    with pytest.raises(ValueError):
        RegistrationSession("ICP")
    with pytest.raises(ValueError):
        RegistrationSession(voxel_resolution=0)


def test_general_factors(pair):
    target, source = (local.voxel_means(x, 0.3) for x in pair)
    goal = local.CloudTarget(target, *local.features(target, 10))
    held = local.register(goal, source, None, "icp", general=RestrictDoF((0, 0, 0, 1, 1, 1)))
    assert np.allclose(held.T[:3, :3], np.eye(3), atol=1e-5)

    class Prior(NullFactor):
        def update_error(self, t, e):
            return e + 1e9 * np.linalg.norm(t[:3, 3])

    pinned = local.register(goal, source, None, "icp", general=Prior())
    assert not pinned.converged and np.allclose(pinned.T, np.eye(4))
    assert TerminationCriteria(0.1, 0.1).converged(np.full(6, 0.01)) and not TerminationCriteria(1e-3, 1.0).converged(np.full(6, 0.01))


def test_no_pairs_stay_where_they_are(pair):
    target, source = pair
    goal = local.CloudTarget(target, *local.features(target, 10))
    out = local.register(goal, source + 1000, None, "icp")
    assert out.num_inliers == 0 and np.allclose(out.T, np.eye(4))


# --- voxel maps and odometry --------------------------------------------------------


def test_own_kernels_and_single_points(spark, pair):
    target, source, *_ = pair

    def soft(x, width):
        return 1.0 / (1.0 + (x / width) ** 2)

    df = [estimate_normals_covariances(frame(spark, p), 10) for p in (target, source)]
    pairs = correspondences(*df, np.eye(4), "icp", 1.0)
    for mine, theirs in ((kernels.cauchy_weight, "cauchy"), (kernels.huber_weight, "huber")):
        assert np.allclose(list(linear_system(pairs, np.eye(4), mine).first()), list(linear_system(pairs, np.eye(4), theirs).first()))
    assert np.allclose(list(linear_system(pairs, np.eye(4), soft).first()), list(linear_system(pairs, np.eye(4), "cauchy").first()))
    with pytest.raises(KeyError):
        kernels.weight_of("no such kernel")
    total, n = np.zeros((6, 6)), 0
    for i in range(5):
        fits, h, b, e = linearize_point(*df, np.eye(4), i, "icp", 1.0)
        n += fits
        total += h
        assert (e > 0 and b.any()) or not fits
    row = linear_system(pairs.where("source_id < 5"), np.eye(4)).first()
    assert n == row["n_inliers"] and np.isclose(total[0, 0], row["h00"]) and np.isclose(total[2, 5], row["h25"])
    assert linearize_point(*df, np.eye(4), -1, "icp", 1.0)[0] is False


@pytest.mark.parametrize("kind", ["flat", "gaussian"])
def test_stored_normals(kind):
    """A map turns the normals it is given, and gives them back instead of the covariances' own."""
    rng = np.random.default_rng(8)
    p, n = rng.uniform(20, 23, (200, 3)), rng.normal(size=(200, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    t = se3_exp(np.array([0.3, -0.2, 0.5, 1.0, 2.0, 3.0]))
    one = VoxelMap(100.0 if kind == "gaussian" else 0.01, kind)
    one.insert(p, t=t, normals=n)
    if kind == "flat":
        back = {tuple(x): y for x, y in zip(one.points.round(9), one.normals, strict=True)}
        want = {tuple(x): y for x, y in zip((p @ t[:3, :3].T + t[:3, 3]).round(9), n @ t[:3, :3].T, strict=True)}
        assert back.keys() <= want.keys() and len(back) > 190 and all(np.allclose(back[k], want[k]) for k in back)
    else:
        mean = (n @ t[:3, :3].T).mean(axis=0)
        assert np.allclose(one.normals, mean / np.linalg.norm(mean))
    assert VoxelMap(1.0).normals.shape == (0, 3)


def test_lru_counts_inserts():
    m = VoxelMap(1.0, horizon=2, cycle=3)
    for k in range(6):
        m.insert(np.array([[k + 0.5, 0.5, 0.5]]))
        assert len(m) == {0: 1, 1: 2, 2: 2, 3: 3, 4: 4, 5: 2}[k]  # swept after the third and sixth insert


def test_lru_table_equals_the_map(spark):
    rng = np.random.default_rng(9)
    rows = [(f, i, *map(float, p)) for f in range(14) for i, p in enumerate(rng.uniform(0, 6, (5, 3)) + f // 3)]
    m = VoxelMap(1.0, horizon=4, cycle=3)
    for f in range(14):
        m.insert(np.array([r[2:] for r in rows if r[0] == f]))
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    got = {(r["vx"], r["vy"], r["vz"]) for r in lru_survivors(df, 1.0, horizon=4, cycle=3).collect()}
    assert got == set(m.cells)


def test_gaussian_map_equals_the_table(spark):
    p = room(200)
    _, covs = local.features(p, 10)
    m = VoxelMap(0.5)
    m.insert(p[:100], covs[:100])
    m.insert(p[100:], covs[100:])
    df = estimate_normals_covariances(frame(spark, p), 10)
    for r in gaussian_voxelmap(df, 0.5).collect():
        last, n, total = m.cells[r["vx"], r["vy"], r["vz"]]
        assert n == r["n"] and np.allclose(total[:3] / n, [r["x"], r["y"], r["z"]]) and np.isclose(total[3] / n, r["cxx"], atol=1e-6)


@pytest.mark.parametrize("offsets", [1, 7, 27])
def test_map_search(offsets):
    p = room(200)
    m = VoxelMap(0.5, "flat", offsets=offsets)
    m.insert(p)
    s, g = m.match(p, 10.0)
    d = ((m.points[g] - p[s]) ** 2).sum(axis=1)
    exact = local.knn(p, m.points, 1)[1][:, 0]
    assert len(s) == len(p) and (d >= exact - 1e-12).all()
    if offsets == 27:
        assert np.allclose(d[exact < 0.25], exact[exact < 0.25])


def walk(spark, n=5):
    base, pose, rows, truth = room(500, noise=0.0), np.eye(4), [], []
    step = se3_exp(np.array([0.0, 0.0, 0.03, 0.1, 0.02, 0.0]))
    for k in range(n):
        inv = inverse(pose)
        rows += [(1, k, i, *map(float, p)) for i, p in enumerate(base @ inv[:3, :3].T + inv[:3, 3])]
        truth.append((1, k, pose[:3].ravel().tolist()))
        pose = pose @ step
    return (
        spark.createDataFrame(rows, "sensor_id long, frame_id long, point_id long, x double, y double, z double"),
        spark.createDataFrame(truth, "sensor_id long, frame_id long, pose array<double>"),
    )


@pytest.mark.parametrize("engine", sorted(odometry.ENGINES))
def test_engines(spark, engine):
    frames, truth = walk(spark)
    how = {"voxel": 0.5} if engine.endswith("model") or engine == "vgicp" else {}
    found = odometry.run(frames, engine, leaf=0.1, **how).persist()
    assert found.count() == 5
    assert odometry.absolute_error(found, truth).first()["rmse"] < 0.1
    assert odometry.relative_error(found, truth).first()["rmse"] < 0.1


def test_model_frame_by_frame(spark):
    frames, truth = walk(spark)
    model = ModelOdometry(leaf=0.1, voxel=0.5, guess="constant_velocity")
    for k, r in enumerate(truth.orderBy("frame_id").collect()):
        scan = np.array([[x["x"], x["y"], x["z"]] for x in frames.where(f"frame_id = {k}").orderBy("point_id").collect()])
        assert np.allclose(model.push(scan)[:3].ravel(), r["pose"], atol=0.1)
        model = ModelOdometry.load(model.dump())
    assert np.allclose(model.push(np.zeros((0, 3))), model.world)


def test_extension_points(spark, pair):
    from pointloom.operators.neighbors import radius_nn
    from pointloom.operators.voxelmap import fold_voxels

    target, source = (frame(spark, local.voxel_means(x, 0.4)).persist() for x in pair)

    def point_to_point(t):
        return [F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 1.0)]

    want = Registration("icp").align(target, source)
    assert np.allclose(Registration(point_to_point).align(target, source).T, want.T, atol=1e-9)
    searched = Registration("icp", search=lambda q, t: radius_nn(q, t, 1.0)).align(target, source)
    assert np.allclose(searched.T, want.T, atol=1e-9)

    def count(cell, rows):
        yield {"vx": cell[0], "n": sum(1 for _ in rows)}

    assert fold_voxels(target, 1.0, count, "vx long, n long").agg(F.sum("n")).first()[0] == target.count()


def test_aligned_error_and_stretches(spark):
    frames, truth = walk(spark)
    turned = odometry.moved_trajectory(truth, TRUTH)
    assert odometry.absolute_error(turned, truth).first()["rmse"] > 0.05
    assert odometry.absolute_error(turned, truth, aligned=True).first()["rmse"] < 1e-9
    row = odometry.distance_error(turned, truth, 0.15).first()
    assert row["rmse"] < 1e-9 and row["n"] == 3


def test_arrays(spark):
    from pointloom.functions.expr import principal_axis
    from pointloom.schema import from_numpy, to_numpy

    p = np.random.default_rng(0).normal(size=(100, 4)) * [1, 5, 1, 1]
    df = from_numpy(spark, p)
    assert np.allclose(to_numpy(df), p[:, :3]) and abs(principal_axis(df)[1]) > 0.9
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((3, 2)))
