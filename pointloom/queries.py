"""The engine's queries over the star-schema clouds, each with SQL that another engine can check."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import clouds
from pointloom.functions import expr
from pointloom.functions.lie import inverse, se3_exp
from pointloom.operators import features, neighbors, sampling, voxelmap
from pointloom.plans import odometry
from pointloom.plans.optimize import GaussNewton, RestrictDoF
from pointloom.plans.registration import Registration, RegistrationSession, correspondences, linear_system, voxel_correspondences
from pointloom.schema import COV, COV_AT, NORMAL, XYZ
from pointloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The pose of the fixed-pose queries, and the small one that registrations must find.
POSE = se3_exp(np.array([0.1, -0.05, 0.2, 0.5, -0.3, 0.25]))
SMALL_POSE = se3_exp(np.array([0.02, -0.01, 0.03, 0.1, -0.08, 0.05]))


def query(sql: str | None = None, *names: str):
    """Register a query; ``names`` are the clouds that its SQL reads."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = ", ".join(f"{n} AS ({clouds.SQL[n]})" for n in names)
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' * ('UNION ALL' in sql)}{parts}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}" if parts else "") + sql.strip()
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, *skip: str) -> DataFrame:
    """Doubles rounded, minus zero made zero."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


# --- SQL pieces -------------------------------------------------------------------


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)" if "e" not in repr(float(v)) else f"CAST('{float(v)!r}' AS DOUBLE)"


def rnd(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


def point_sql(t: np.ndarray, p: tuple[str, ...] = XYZ) -> list[str]:
    return ["(" + " + ".join([f"{num(float(t[i, a]))} * {p[a]}" for a in range(3)] + [num(float(t[i, 3]))]) + ")" for i in range(3)]


def full_sql(c: tuple[str, ...]) -> list[list[str]]:
    out = [[""] * 3 for _ in range(3)]
    for v, (i, j) in zip(c, COV_AT, strict=True):
        out[i][j] = out[j][i] = v
    return out


def cov_sql(t: np.ndarray, c: tuple[str, ...]) -> list[str]:
    m = full_sql(c)
    return ["(" + " + ".join(f"{num(float(t[i, a] * t[j, b]))} * {m[a][b]}" for a in range(3) for b in range(3)) + ")" for i, j in COV_AT]


def voxel_sql(leaf: float, p: tuple[str, ...] = XYZ) -> list[str]:
    return [f"CAST(floor({c} * {num(1.0 / leaf)}) AS BIGINT)" for c in p]


def distance_sql(a: str, b: str) -> str:
    d = [f"({a}.{c} - {b}.{c})" for c in XYZ]
    return " + ".join(f"{x} * {x}" for x in d)


RANGE = " AND ".join(f"{v} BETWEEN {expr.VOXEL_MIN} AND {expr.VOXEL_MAX}" for v in ("vx", "vy", "vz"))


def voxelled_sql(name: str, leaf: float) -> str:
    vx, vy, vz = voxel_sql(leaf)
    return f"(SELECT * FROM (SELECT *, {vx} AS vx, {vy} AS vy, {vz} AS vz FROM {name}) WHERE {RANGE})"


#: Means of few decimal prices end in a 5 that rounding would have to break evenly; ten digits keep it.
_GRID_DIGITS = 10


def grid_sql(name: str, leaf: float) -> str:
    means = ", ".join(rnd(f"avg({c})", c, _GRID_DIGITS) for c in XYZ)
    return f"SELECT vx, vy, vz, count(*) AS n, {means} FROM {voxelled_sql(name, leaf)} GROUP BY vx, vy, vz"


# --- projections and predicates ---------------------------------------------------


@query("SELECT point_id, " + ", ".join(rnd(e, c) for e, c in zip(point_sql(POSE), XYZ, strict=True)) + " FROM pc_orders", "pc_orders")
def point_transform(spark, sf_dir):
    moved = expr.transform_point(POSE)
    return rounded(clouds.orders(spark, sf_dir).select("point_id", *(m.alias(c) for m, c in zip(moved, XYZ, strict=True))))


_ROTATION = POSE.copy()
_ROTATION[:3, 3] = 0.0


@query("SELECT point_id, " + ", ".join(rnd(e, c) for e, c in zip(point_sql(_ROTATION), NORMAL, strict=True)) + " FROM pc_emb", "pc_emb")
def normal_transform(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir)
    return rounded(df.select("point_id", *(m.alias(c) for m, c in zip(expr.transform_normal(POSE, expr.columns()), NORMAL, strict=True))))


#: A covariance for every point of a cloud, positive definite, from its coordinates.
_DEMO_COV = ("1.0 + x * x", "x * y", "x * z", "1.0 + y * y", "y * z", "1.0 + z * z")


def with_demo_covs(df: DataFrame) -> DataFrame:
    x, y, z = expr.columns()
    values = (1.0 + x * x, x * y, x * z, 1.0 + y * y, y * z, 1.0 + z * z)
    return df.withColumns({n: F.lit(0.01) * v for n, v in zip(COV, values, strict=True)})


_COV_SELECT = ", ".join(f"{num(0.01)} * ({e}) AS {n}" for e, n in zip(_DEMO_COV, COV, strict=True))


@query(f"covs AS (SELECT point_id, {_COV_SELECT} FROM pc_emb) SELECT point_id, " + ", ".join(rnd(e, c) for e, c in zip(cov_sql(POSE, COV), COV, strict=True)) + " FROM covs", "pc_emb")
def cov_transform(spark, sf_dir):
    df = with_demo_covs(clouds.embeddings(spark, sf_dir))
    return rounded(df.select("point_id", *(m.alias(c) for m, c in zip(expr.transform_cov(POSE), COV, strict=True))))


@query("SELECT point_id, " + ", ".join(f"{e} AS {n}" for e, n in zip(voxel_sql(0.25), ("vx", "vy", "vz"), strict=True)) + " FROM pc_orders", "pc_orders")
def voxel_coord(spark, sf_dir):
    return clouds.orders(spark, sf_dir).select("point_id", *(v.alias(n) for v, n in zip(expr.voxel_coords(0.25), ("vx", "vy", "vz"), strict=True)))


@query(
    f"SELECT point_id, (vx + 1048576) | ((vy + 1048576) << 21) | ((vz + 1048576) << 42) AS voxel_key FROM {voxelled_sql('pc_orders', 0.25)}",
    "pc_orders",
)
def voxel_key_packed(spark, sf_dir):
    df = sampling.with_voxels(clouds.orders(spark, sf_dir), 0.25)
    return df.select("point_id", expr.voxel_key(F.col("vx"), F.col("vy"), F.col("vz")).alias("voxel_key"))


@query(f"SELECT point_id, xor(xor(vx * 73856093, vy * 19349669), vz * 83492791) AS h FROM {voxelled_sql('pc_orders', 0.25)}", "pc_orders")
def spatial_hash(spark, sf_dir):
    df = sampling.with_voxels(clouds.orders(spark, sf_dir), 0.25)
    return df.select("point_id", expr.spatial_hash(F.col("vx"), F.col("vy"), F.col("vz")).alias("h"))


@query(f"SELECT point_id, vx, vy, vz FROM {voxelled_sql('pc_orders', 1e-5)}", "pc_orders")
def voxel_range_filter(spark, sf_dir):
    return sampling.with_voxels(clouds.orders(spark, sf_dir), 1e-5).select("point_id", "vx", "vy", "vz")


@query(
    """SELECT point_id, round(CASE WHEN e < 1.0 THEN 1.0 ELSE 1.0 / e END, 6) + 0.0 AS huber, round(1.0 / (1.0 + e * e), 6) + 0.0 AS cauchy
FROM (SELECT point_id, sqrt(x * x + y * y + z * z) AS e FROM pc_emb)""",
    "pc_emb",
)
def kernel_weights(spark, sf_dir):
    x, y, z = expr.columns()
    df = clouds.embeddings(spark, sf_dir).withColumn("e", F.sqrt(x * x + y * y + z * z))
    return rounded(df.select("point_id", expr.huber(F.col("e")).alias("huber"), expr.cauchy(F.col("e")).alias("cauchy")))


_UV = """SELECT *, CASE WHEN x*x+y*y+z*z < 1e-3 THEN 0.5 ELSE atan2(x / sqrt(x*x+y*y+z*z), z / sqrt(x*x+y*y+z*z)) / (2 * pi()) + 0.5 END AS u,
 CASE WHEN x*x+y*y+z*z < 1e-3 THEN 0.5 ELSE -asin(y / sqrt(x*x+y*y+z*z)) / pi() + 0.5 END AS v FROM {}"""


@query(f"SELECT point_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM ({_UV.format('pc_emb')})", "pc_emb")
def equirectangular(spark, sf_dir):
    u, v = expr.equirectangular()
    return rounded(clouds.embeddings(spark, sf_dir).select("point_id", u.alias("u"), v.alias("v")))


#: Every seventh point without a first coordinate, and others infinite or missing in the next ones.
_HOLES = """holes AS (SELECT point_id, CASE point_id % 7 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) ELSE x END AS x,
 CASE point_id % 11 WHEN 0 THEN CAST('-inf' AS DOUBLE) WHEN 1 THEN NULL ELSE y END AS y, CASE point_id % 13 WHEN 0 THEN CAST('nan' AS DOUBLE) ELSE z END AS z FROM pc_orders)"""


@query(_HOLES + " SELECT point_id, " + ", ".join(rnd(c, c) for c in XYZ) + " FROM holes WHERE isfinite(x) AND isfinite(y) AND isfinite(z)", "pc_orders")
def finite_points(spark, sf_dir):
    from pointloom.schema import finite

    def left(n: int) -> Column:
        return F.pmod(F.col("point_id"), F.lit(n))

    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    df = clouds.orders(spark, sf_dir).select(
        "point_id",
        F.when(left(7) == 0, nan).when(left(7) == 1, inf).otherwise(F.col("x")).alias("x"),
        F.when(left(11) == 0, -inf).when(left(11) == 1, F.lit(None)).otherwise(F.col("y")).alias("y"),
        F.when(left(13) == 0, nan).otherwise(F.col("z")).alias("z"),
    )
    return rounded(finite(df))


# --- downsampling -----------------------------------------------------------------


@query(grid_sql("pc_orders", 0.5), "pc_orders")
def voxel_grid_orders(spark, sf_dir):
    return rounded(sampling.voxel_grid(clouds.orders(spark, sf_dir), 0.5), _GRID_DIGITS)


@query(grid_sql("pc_lineitem", 2.0), "pc_lineitem")
def voxel_grid_lineitem(spark, sf_dir):
    return rounded(sampling.voxel_grid(clouds.lineitem(spark, sf_dir), 2.0), _GRID_DIGITS)


@query(f"SELECT n, count(*) AS voxels FROM ({grid_sql('pc_orders', 1.0)}) GROUP BY n", "pc_orders")
def voxel_occupancy(spark, sf_dir):
    return sampling.voxel_occupancy(clouds.orders(spark, sf_dir), 1.0)


@query("SELECT point_id, x, y, z FROM pc_orders ORDER BY md5('7:' || point_id), point_id LIMIT 1000", "pc_orders")
def random_sample_hash(spark, sf_dir):
    return sampling.random_sample_md5(clouds.orders(spark, sf_dir), 1000, seed=7)


# --- neighbour joins --------------------------------------------------------------


def _moved_sql(name: str, t: np.ndarray) -> str:
    return f"(SELECT point_id, {', '.join(f'{e} AS {c}' for e, c in zip(point_sql(t), XYZ, strict=True))} FROM {name})"


def _moved(df: DataFrame, t: np.ndarray) -> DataFrame:
    return df.select("point_id", *(m.alias(c) for m, c in zip(expr.transform_point(t), XYZ, strict=True)))


def knn_sql(q: str, t: str, k: int, where: str = "") -> str:
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(sq_dist, 6) + 0.0 AS sq_dist FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sq_dist, point_id) AS rank FROM (
  SELECT q.point_id AS query_id, t.point_id, {distance_sql("q", "t")} AS sq_dist FROM {q} q, {t} t {where})) WHERE rank <= {k}"""


_NN = f"""SELECT query_id, point_id, sq_dist FROM ({knn_sql(_moved_sql("pc_emb", POSE), "pc_emb", 1)})"""


@query(_NN + " WHERE sq_dist <= 1.0", "pc_emb")
def nn_radius(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir)
    return rounded(neighbors.radius_nn(_moved(df, POSE), df, 1.0))


@query(_NN, "pc_emb")
def nn_unbounded(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir)
    return rounded(neighbors.nearest(_moved(df, POSE), df))


@query(knn_sql("pc_emb", "pc_emb", 5), "pc_emb")
def knn_k5(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir)
    return rounded(neighbors.knn(df, df, 5))


@query(knn_sql("pc_part", "pc_orders", 5), "pc_part", "pc_orders")
def knn_parts_orders(spark, sf_dir):
    return rounded(neighbors.knn(clouds.part(spark, sf_dir), clouds.orders(spark, sf_dir), 5))


@query(
    f"found AS ({knn_sql('pc_part', 'pc_orders', 1)}) SELECT p.point_id AS query_id, coalesce(f.rank, 0) AS rank, coalesce(f.point_id, -1) AS point_id, coalesce(f.sq_dist, -1.0) AS sq_dist "
    "FROM pc_part p LEFT JOIN (SELECT * FROM found WHERE sq_dist <= 25.0) f ON f.query_id = p.point_id",
    "pc_part",
    "pc_orders",
)
def knn_left_outer(spark, sf_dir):
    found = neighbors.knn_left(clouds.part(spark, sf_dir), clouds.orders(spark, sf_dir), 1, max_distance=5.0)
    return rounded(found.fillna({"rank": 0, "point_id": -1, "sq_dist": -1.0}))


@query(
    f"SELECT query_id, list(point_id ORDER BY rank) AS point_ids FROM ({knn_sql('pc_emb', 'pc_emb', 3)}) GROUP BY query_id",
    "pc_emb",
)
def knn_wide(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir)
    return neighbors.knn_arrays(df, df, 3).select("query_id", "point_ids")


def probe_sql(cells: list[tuple[int, int, int]], leaf: float) -> str:
    steps = ", ".join(f"({a}, {b}, {c})" for a, b, c in cells)
    keys = " AND ".join(f"t.v{c} = q.v{c} + o.d{c}" for c in XYZ)
    q = voxelled_sql(_moved_sql("pc_emb", POSE), leaf)
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(sq_dist, 6) + 0.0 AS sq_dist FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sq_dist, point_id) AS rank FROM (
  SELECT q.point_id AS query_id, t.point_id, {distance_sql("q", "t")} AS sq_dist
  FROM {q} q, (VALUES {steps}) o(dx, dy, dz), {voxelled_sql("pc_emb", leaf)} t WHERE {keys})) WHERE rank <= 5"""


def _probe(offsets: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = clouds.embeddings(spark, sf_dir)
        return rounded(neighbors.voxel_probe_knn(_moved(df, POSE), sampling.with_voxels(df, 1.0), 1.0, 5, offsets))

    run.__name__ = f"voxel_probe_{offsets}"
    return run


for _n in (1, 7, 27):
    query(probe_sql(neighbors.OFFSETS[_n], 1.0), "pc_emb")(_probe(_n))


@query(
    f"""uv AS ({_UV.format("pc_part")}), px AS (SELECT *, CAST(trunc(u * 512) AS INTEGER) AS pu, CAST(trunc(v * 128) AS INTEGER) AS pv FROM uv),
raster AS (SELECT pu, pv, max(point_id) AS point_id FROM px WHERE pu BETWEEN 0 AND 511 AND pv BETWEEN 0 AND 127 GROUP BY pu, pv),
t AS (SELECT r.pu, r.pv, p.point_id, p.x, p.y, p.z FROM raster r JOIN pc_part p USING (point_id)),
near AS (SELECT q.point_id AS query_id, t.point_id, {distance_sql("q", "t")} AS d
 FROM px q JOIN t ON t.pv BETWEEN q.pv - 5 AND q.pv + 5 AND (t.pu BETWEEN q.pu - 10 AND q.pu + 10 OR t.pu - 512 BETWEEN q.pu - 10 AND q.pu + 10 OR t.pu + 512 BETWEEN q.pu - 10 AND q.pu + 10))
SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(d, 6) + 0.0 AS sq_dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS rank FROM near) WHERE rank <= 3""",
    "pc_part",
)
def projective_nn(spark, sf_dir):
    df = clouds.part(spark, sf_dir)
    return rounded(neighbors.projective_knn(df, df, 512, 128, k=3))


@query("SELECT frame_id, lag(frame_id) OVER (ORDER BY frame_id) AS previous FROM (SELECT DISTINCT frame_id FROM pc_frames) QUALIFY previous IS NOT NULL", "pc_frames")
def frame_pairs(spark, sf_dir):
    return neighbors.frame_pairs(clouds.frames(spark, sf_dir))


# --- correspondences, rejection ---------------------------------------------------

_PAIRS_PLAIN = f"""pairs AS (SELECT query_id AS source_id, point_id AS target_id, sq_dist FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sq_dist, point_id) AS k FROM (
  SELECT q.point_id AS query_id, t.point_id, {distance_sql("q", "t")} AS sq_dist FROM {_moved_sql("pc_emb", POSE)} q, pc_emb t)) WHERE k = 1 AND sq_dist <= 1.0)"""


@query(_PAIRS_PLAIN + " SELECT source_id, target_id, round(sq_dist, 6) + 0.0 AS sq_dist FROM pairs", "pc_emb")
def reject_distance(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
    return rounded(correspondences(df, df, POSE, "icp", 1.0).select("source_id", "target_id", "sq_dist"))


@query(
    _PAIRS_PLAIN
    + """ SELECT source_id, target_id, round(sq_dist, 6) + 0.0 AS sq_dist FROM pairs JOIN pc_emb s ON s.point_id = source_id JOIN pc_emb t ON t.point_id = target_id
WHERE NOT (s.label <> t.label)""",
    "pc_emb",
)
def reject_feature(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ, "label")
    return rounded(correspondences(df, df, POSE, "icp", 1.0, reject=F.col("s_label") != F.col("t_label")).select("source_id", "target_id", "sq_dist"))


@query(_PAIRS_PLAIN + " SELECT count(*) AS num_inliers FROM pairs", "pc_emb")
def inlier_count(spark, sf_dir):
    df = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
    return correspondences(df, df, POSE, "icp", 1.0).agg(F.count(F.lit(1)).alias("num_inliers"))


# --- moments, voxel maps ----------------------------------------------------------

_MOMENTS = ", ".join([rnd(f"avg(t.{c})", "m" + c, 5) for c in XYZ] + [rnd(f"covar_pop(t.{XYZ[i]}, t.{XYZ[j]})", n, 5) for n, (i, j) in zip(COV, COV_AT, strict=True)])


@query(
    f"nb AS ({knn_sql('pc_emb', 'pc_emb', 20)}) SELECT query_id AS point_id, count(*) AS n, {_MOMENTS} FROM nb JOIN pc_emb t USING (point_id) GROUP BY query_id",
    "pc_emb",
)
def neighborhood_moments(spark, sf_dir):
    return rounded(features.neighborhood_moments(clouds.embeddings(spark, sf_dir), 20), 5)


@query(grid_sql("pc_emb", 1.0), "pc_emb")
def gaussian_voxelmap(spark, sf_dir):
    return rounded(voxelmap.gaussian_voxelmap(clouds.embeddings(spark, sf_dir).select("point_id", *XYZ), 1.0), _GRID_DIGITS)


_GAUSS = f"""covs AS (SELECT point_id, x, y, z, {_COV_SELECT} FROM pc_emb),
gauss AS (SELECT vx, vy, vz, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in (*XYZ, *COV))} FROM {voxelled_sql("covs", 1.0)} GROUP BY vx, vy, vz)"""


@query(_GAUSS + " SELECT vx, vy, vz, n, " + ", ".join(rnd(c, c) for c in (*XYZ, *COV)) + " FROM gauss", "pc_emb")
def gaussian_voxelmap_cov(spark, sf_dir):
    return rounded(voxelmap.gaussian_voxelmap(with_demo_covs(clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)), 1.0))


@query(
    f"""cells AS (SELECT vx, vy, vz, max(frame_id) AS last_frame FROM {voxelled_sql("pc_frames", 5.0)} GROUP BY vx, vy, vz), total AS (SELECT max(frame_id) + 1 AS n FROM pc_frames)
SELECT vx, vy, vz, last_frame FROM cells, total WHERE NOT (last_frame + 5 < (n // 4) * 4)""",
    "pc_frames",
)
def lru_survivors(spark, sf_dir):
    return voxelmap.lru_survivors(clouds.frames(spark, sf_dir), 5.0, horizon=5, cycle=4)


# --- linear systems ---------------------------------------------------------------


def linsys_sql(t: np.ndarray, m: list[str], pairs: str, kernel: str | None = None, digits: int = 3) -> str:
    """H, b and e over rows with px .. qz and the matrix expressions ``m`` (columns of ``pairs``)."""
    p, q = [f"p{c}" for c in XYZ], [f"q{c}" for c in XYZ]
    skew = [["0.0", "-pz", "py"], ["pz", "0.0", "-px"], ["-py", "px", "0.0"]]
    moved = point_sql(t, tuple(p))
    first = [f"{q[i]} - {moved[i]} AS r{i}" for i in range(3)]
    for i in range(3):
        for k in range(3):
            first.append(" + ".join(f"{num(float(t[i, a]))} * ({skew[a][k]})" for a in range(3)) + f" AS j{i}{k}")
            first.append(f"{num(float(-t[i, k]))} AS j{i}{k + 3}")
    full = full_sql(tuple(f"m{n[1:]}" for n in COV))
    second = [f"{' + '.join(f'{full[i][a]} * r{a}' for a in range(3))} AS mr{i}" for i in range(3)]
    second += [f"{' + '.join(f'{full[i][a]} * j{a}{k}' for a in range(3))} AS mj{i}{k}" for i in range(3) for k in range(6)]
    weight = {None: "1.0", "huber": "CASE WHEN sqrt(e) < 1.0 THEN 1.0 ELSE 1.0 / sqrt(e) END", "cauchy": "1.0 / (1.0 + e)"}[kernel]
    sums = [rnd(f"sum(w * ({' + '.join(f'j{i}{a} * mj{i}{b}' for i in range(3))}))", f"h{a}{b}", digits) for a in range(6) for b in range(a, 6)]
    sums += [rnd(f"sum(w * ({' + '.join(f'j{i}{a} * mr{i}' for i in range(3))}))", f"b{a}", digits) for a in range(6)]
    named = ", ".join(f"{e} AS m{n[1:]}" for e, n in zip(m, COV, strict=True))
    return f"""SELECT {", ".join(sums)}, {rnd("sum(w * e)", "e", digits)}, count(*) AS n_inliers FROM (
 SELECT *, {weight} AS w FROM (SELECT *, 0.5 * (r0 * mr0 + r1 * mr1 + r2 * mr2) AS e FROM (
  SELECT *, {", ".join(second)} FROM (SELECT *, {", ".join(first)} FROM (SELECT *, {named} FROM ({pairs}))))))"""


_PQ = "s.x AS px, s.y AS py, s.z AS pz, t.x AS qx, t.y AS qy, t.z AS qz"
_JOINED = f"SELECT {_PQ} FROM pairs JOIN pc_emb s ON s.point_id = source_id JOIN pc_emb t ON t.point_id = target_id"
_EYE = ["1.0", "0.0", "0.0", "1.0", "0.0", "1.0"]


def _linsys(factor: str, kernel: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
        if factor == "gicp":
            df = with_demo_covs(df)
        if factor == "plane":  # unit vectors from the origin as normals
            n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
            df = df.withColumns({a: F.col(c) / n for a, c in zip(NORMAL, XYZ, strict=True)})
        return rounded(linear_system(correspondences(df, df, POSE, factor, 1.0), POSE, kernel), 3)

    run.__name__ = (kernel or factor) + "_linsys"
    return run


query(f"{_PAIRS_PLAIN} {linsys_sql(POSE, _EYE, _JOINED)}", "pc_emb")(_linsys("icp"))
query(f"{_PAIRS_PLAIN} {linsys_sql(POSE, _EYE, _JOINED, 'huber')}", "pc_emb")(_linsys("icp", "huber"))
query(f"{_PAIRS_PLAIN} {linsys_sql(POSE, _EYE, _JOINED, 'cauchy')}", "pc_emb")(_linsys("icp", "cauchy"))
_N2 = "(qx * qx + qy * qy + qz * qz)"
query(f"{_PAIRS_PLAIN} {linsys_sql(POSE, [f'qx * qx / {_N2}', '0.0', '0.0', f'qy * qy / {_N2}', '0.0', f'qz * qz / {_N2}'], _JOINED)}", "pc_emb")(_linsys("plane"))


def inverse_sql(m: list[str]) -> list[str]:
    a, b, c, d, e, f = m
    k = [f"({d} * {f} - {e} * {e})", f"({c} * {e} - {b} * {f})", f"({b} * {e} - {c} * {d})", f"({a} * {f} - {c} * {c})", f"({b} * {c} - {a} * {e})", f"({a} * {d} - {b} * {b})"]
    det = f"({a} * {k[0]} + {b} * {k[1]} + {c} * {k[2]})"
    return [f"{x} / {det}" for x in k]


_SUMMED = ", ".join(f"t.{n} + {e} AS a{n[1:]}" for n, e in zip(COV, cov_sql(POSE, tuple(f"s.{n}" for n in COV)), strict=True))
_INVERSE = inverse_sql([f"a{n[1:]}" for n in COV])
_GICP = f"SELECT {_PQ}, {_SUMMED} FROM pairs JOIN covs s ON s.point_id = source_id JOIN covs t ON t.point_id = target_id"
query(f"{_PAIRS_PLAIN}, covs AS (SELECT point_id, x, y, z, {_COV_SELECT} FROM pc_emb) {linsys_sql(POSE, _INVERSE, _GICP)}", "pc_emb")(_linsys("gicp"))

_W = voxel_sql(1.0, ("wx", "wy", "wz"))
_VPAIRS = f"""SELECT {_PQ}, {_SUMMED} FROM (SELECT *, {", ".join(f"{e} AS w{c}" for e, c in zip(point_sql(POSE), XYZ, strict=True))} FROM covs) s
JOIN gauss t ON t.vx = {_W[0]} AND t.vy = {_W[1]} AND t.vz = {_W[2]} AND (wx - t.x) * (wx - t.x) + (wy - t.y) * (wy - t.y) + (wz - t.z) * (wz - t.z) <= 1.0"""


@query(f"{_GAUSS} {linsys_sql(POSE, _INVERSE, _VPAIRS)}", "pc_emb")
def vgicp_linsys(spark, sf_dir):
    df = with_demo_covs(clouds.embeddings(spark, sf_dir).select("point_id", *XYZ))
    return rounded(linear_system(voxel_correspondences(voxelmap.gaussian_voxelmap(df, 1.0), df, POSE, 1.0, 1.0), POSE), 3)


# --- accessors, metrics, sinks ----------------------------------------------------


@query("SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, round(arg_max(x, point_id), 6) AS last, count(x) AS n FROM pc_orders", "pc_orders")
def bench_summary(spark, sf_dir):
    return rounded(odometry.summarize(clouds.orders(spark, sf_dir), "x", "point_id"))


@query("SELECT CAST(0 AS BIGINT) AS sensor_id, point_id AS frame_id, printf('%.6f 0.000000 0.000000 %.6f 0.000000 1.000000 0.000000 %.6f 0.000000 0.000000 1.000000 %.6f', CAST(1 AS DOUBLE), x, y, z) AS line FROM pc_part", "pc_part")
def trajectory_format(spark, sf_dir):
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, F.col("z"))
    return files.trajectory_lines(clouds.part(spark, sf_dir).select(F.lit(0).cast("long").alias("sensor_id"), F.col("point_id").alias("frame_id"), pose.alias("pose")))


@query("SELECT frame_id AS cloud_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS point_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM pc_frames", "pc_frames")
def message_round_trip(spark, sf_dir):
    packed = files.pack_messages(clouds.frames(spark, sf_dir).withColumnRenamed("frame_id", "cloud_id"))
    return files.unpack_messages(packed)


@query("SELECT frame_id, CAST(16 * count(*) AS BIGINT) AS size FROM pc_frames GROUP BY frame_id", "pc_frames")
def float4_sizes(spark, sf_dir):
    return files.float4_files(clouds.frames(spark, sf_dir)).select("frame_id", F.length("content").cast("long").alias("size"))


@query("SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS point_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM pc_frames", "pc_frames")
def float4_content(spark, sf_dir):
    """The files' contents, read back."""
    written = files.float4_files(clouds.frames(spark, sf_dir)).select(F.col("frame_id").cast("string").alias("path"), "content")
    return files.decoded_float4(written).select(F.col("path").cast("long").alias("frame_id"), "point_id", *XYZ)


@query(
    """both_ AS (SELECT a.frame_id, avg(a.x) AS x, avg(a.y) AS y, avg(a.z) AS z FROM pc_frames a GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS sensor_id, round(sqrt(avg(e * e)), 6) AS rmse, round(stddev_pop(e), 6) AS std, count(*) AS n
FROM (SELECT sqrt(x * x + y * y + z * z) AS e FROM both_)""",
    "pc_frames",
)
def trajectory_error(spark, sf_dir):
    means = clouds.frames(spark, sf_dir).groupBy("sensor_id", "frame_id").agg(*(F.avg(c).alias(c) for c in XYZ))
    one, zero = F.lit(1.0), F.lit(0.0)

    def pose(*t: Column) -> Column:
        return F.array(one, zero, zero, t[0], zero, one, zero, t[1], zero, zero, one, t[2])

    estimated = means.select("sensor_id", "frame_id", pose(*expr.columns()).alias("pose"))
    return rounded(odometry.absolute_error(estimated, means.select("sensor_id", "frame_id", pose(zero, zero, zero).alias("pose"))))


# --- registrations with a known answer --------------------------------------------

_DIGITS = 2


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    target = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
    return target, _moved(target, inverse(SMALL_POSE))


#: The pose that must be found, and how far the source's points then are from their own in the target: recomputed from the points.
_BACK = point_sql(SMALL_POSE, tuple(f"m.{c}" for c in XYZ))
_FOUND = f"""moved AS {_moved_sql("pc_emb", inverse(SMALL_POSE))}
SELECT {", ".join(rnd(num(float(SMALL_POSE[i, j])), f"t{i}{j}", _DIGITS) for i in range(3) for j in range(4))}, true AS converged,
 {rnd("sqrt(avg(" + " + ".join(f"({e} - t.{c}) * ({e} - t.{c})" for e, c in zip(_BACK, XYZ, strict=True)) + "))", "rms", _DIGITS)}, count(*) AS n
FROM moved m JOIN pc_emb t USING (point_id)"""


def _verdict(target: DataFrame, source: DataFrame, pose: np.ndarray, converged: bool) -> DataFrame:
    """The pose's twelve numbers, and the distance over all points of the pair."""
    at = _moved(source.select("point_id", *XYZ), pose).select("point_id", *(F.col(c).alias("m" + c) for c in XYZ))
    d2 = expr.sq_dist([F.col("m" + c) for c in XYZ], expr.columns())
    out = at.join(target.select("point_id", *XYZ), "point_id").agg(F.sqrt(F.avg(d2)).alias("rms"), F.count(F.lit(1)).alias("n"))
    numbers = [F.lit(float(pose[i, j])).alias(f"t{i}{j}") for i in range(3) for j in range(4)]
    return rounded(out.select(*numbers, F.lit(bool(converged)).alias("converged"), "rms", "n"), _DIGITS)


def _align(name: str, factor: str, **how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target, source = plain = _pair(spark, sf_dir)
        if factor != "icp":
            target = features.estimate_normals_covariances(target, 10).persist()
            source = features.estimate_normals_covariances(source, 10).persist()
        if factor == "vgicp":
            target = voxelmap.gaussian_voxelmap(target, 0.5)
        out = Registration(factor, 1.0, voxel_leaf=0.5, **how).align(target, source)
        return _verdict(*plain, out.T, out.converged)

    run.__name__ = name
    return run


query(_FOUND, "pc_emb")(_align("align_icp", "icp"))
query(_FOUND, "pc_emb")(_align("align_plane", "plane"))
query(_FOUND, "pc_emb")(_align("align_gicp", "gicp"))
query(_FOUND, "pc_emb")(_align("align_vgicp", "vgicp"))
query(_FOUND, "pc_emb")(_align("align_huber", "icp", kernel="huber"))
query(_FOUND, "pc_emb")(_align("align_gauss_newton", "gicp", optimizer=GaussNewton()))


@query("SELECT " + ", ".join(rnd(num(float(i == j)), f"r{i}{j}") for i in range(3) for j in range(3)) + ", true AS moved")
def restrict_dof(spark, sf_dir):
    """Rotations are held: the pose found is a pure translation."""
    target, source = _pair(spark, sf_dir)
    out = Registration("icp", 1.0, general=RestrictDoF((0.0, 0.0, 0.0, 1.0, 1.0, 1.0))).align(target, source)
    numbers = {f"r{i}{j}": round(float(out.T[i, j]), 6) + 0.0 for i in range(3) for j in range(3)}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in numbers.items()), F.lit(bool(np.linalg.norm(out.T[:3, 3]) > 0.01)).alias("moved"))


@query(_FOUND, "pc_emb")
def session_swap(spark, sf_dir):
    target, source = _pair(spark, sf_dir)
    session = RegistrationSession(max_distance=1.0, num_neighbors=10)
    session.set_target(source)
    session.set_source(target)
    session.swap()
    out = session.align()
    return _verdict(target, source, out.T, out.converged)


_MAP_FOUND = _FOUND.replace("moved AS", f"cells AS (SELECT row_number() OVER (ORDER BY vx, vy, vz) - 1 AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {voxelled_sql('pc_emb', 0.5)} GROUP BY vx, vy, vz), moved AS").replace("FROM pc_emb)", "FROM cells)").replace("JOIN pc_emb t", "JOIN cells t")


@query(_MAP_FOUND.replace(voxelled_sql("cells", 0.5), voxelled_sql("pc_emb", 0.5)), "pc_emb")
def align_map_source(spark, sf_dir):
    """A voxel map as the source: its means are aligned as points."""
    cells = voxelmap.map_cloud(voxelmap.gaussian_voxelmap(clouds.embeddings(spark, sf_dir).select("point_id", *XYZ), 0.5)).select("point_id", *XYZ)
    source = _moved(cells, inverse(SMALL_POSE))
    out = Registration("icp", 1.0).align(cells, source)
    return _verdict(cells, source, out.T, out.converged)


# --- features up to sign, order-dependent folds, odometry ---------------------------


def smallest_eigenvalue_sql(c: tuple[str, ...]) -> str:
    """The least eigenvalue of a symmetric 3 x 3 matrix, in closed form."""
    xx, xy, xz, yy, yz, zz = c
    q = f"(({xx} + {yy} + {zz}) / 3)"
    p = f"sqrt((({xx} - {q}) * ({xx} - {q}) + ({yy} - {q}) * ({yy} - {q}) + ({zz} - {q}) * ({zz} - {q}) + 2 * ({xy} * {xy} + {xz} * {xz} + {yz} * {yz})) / 6)"
    a, b, d = f"({xx} - {q})", f"({yy} - {q})", f"({zz} - {q})"
    det = f"({a} * ({b} * {d} - {yz} * {yz}) - {xy} * ({xy} * {d} - {yz} * {xz}) + {xz} * ({xy} * {yz} - {b} * {xz}))"
    return f"({q} + 2 * {p} * cos(acos(greatest(-1.0, least(1.0, {det} / (2 * {p} * {p} * {p})))) / 3 + 2 * pi() / 3))"


_RAW_MOMENTS = f"""nb AS ({knn_sql('pc_emb', 'pc_emb', 20)}),
moments AS (SELECT query_id AS point_id, {", ".join(f"covar_pop(t.{XYZ[i]}, t.{XYZ[j]}) AS {n}" for n, (i, j) in zip(COV, COV_AT, strict=True))} FROM nb JOIN pc_emb t USING (point_id) GROUP BY query_id)"""
_TRACE = "cxx + cyy + czz"


def _with_moments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
    near = neighbors.knn(points, points, 20)
    moments = features.neighborhood_moments(points, 20, near)
    return points, near, moments.select("point_id", *(F.col(c).alias("m" + c) for c in COV))


@query(f"{_RAW_MOMENTS} SELECT point_id, {rnd(smallest_eigenvalue_sql(COV), 'along', 4)}, {rnd('1.0', 'length', 6)}, true AS faces_origin FROM moments", "pc_emb")
def normals(spark, sf_dir):
    """Normals by what doesn't depend on their sign: n'Cn is the least eigenvalue, n is a unit vector and faces the origin."""
    points, near, moments = _with_moments(spark, sf_dir)
    full = expr.full_cov([F.col("m" + c) for c in COV])
    n = expr.columns(NORMAL)
    along = sum((n[i] * full[i][j] * n[j] for i in range(3) for j in range(3)), F.lit(0.0))
    out = features.estimate_normals(points, 20, near).join(moments, "point_id")
    out = out.select("point_id", along.alias("along"), F.sqrt(expr.dot(n, n)).alias("length"), (expr.dot(n, expr.columns()) <= 1e-12).alias("faces_origin"))
    return rounded(rounded(out, 6, "along"), 4, "length")


@query(
    f"{_RAW_MOMENTS} SELECT point_id, {rnd('2.001', 'trace')}, {rnd('2.000001', 'square')}, {rnd(f'{_TRACE} - 0.999 * ' + smallest_eigenvalue_sql(COV), 'weighed', 4)} FROM moments",
    "pc_emb",
)
def covariances(spark, sf_dir):
    """Regularised covariances by their trace, sum of squares, and product with the raw moments: eigenvalues 1e-3, 1, 1 and the right axes."""
    points, near, moments = _with_moments(spark, sf_dir)
    out = features.estimate_covariances(points, 20, near).join(moments, "point_id")
    twice = [1.0 if i == j else 2.0 for i, j in COV_AT]
    square = sum((F.lit(w) * F.col(c) * F.col(c) for w, c in zip(twice, COV, strict=True)), F.lit(0.0))
    weighed = sum((F.lit(w) * F.col(c) * F.col("m" + c) for w, c in zip(twice, COV, strict=True)), F.lit(0.0))
    out = out.select("point_id", (F.col("cxx") + F.col("cyy") + F.col("czz")).alias("trace"), square.alias("square"), weighed.alias("weighed"))
    return rounded(rounded(out, 6, "weighed"), 4, "trace", "square")


_NEW_POINT = "{'x': o.x, 'y': o.y, 'z': o.z}"
_FITS = "len(s.kept) < 10 AND len(list_filter(s.kept, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) + (p.z - o.z) * (p.z - o.z) < 0.01)) = 0"


@query(
    f"""rows_ AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY point_id) AS i FROM {voxelled_sql("pc_orders", 8.0)}),
steps AS (
 SELECT o.vx, o.vy, o.vz, o.i, o.point_id, [{_NEW_POINT}] AS kept, true AS stays, 0 AS slot FROM rows_ o WHERE o.i = 1
 UNION ALL
 SELECT o.vx, o.vy, o.vz, o.i, o.point_id, CASE WHEN {_FITS} THEN list_append(s.kept, {_NEW_POINT}) ELSE s.kept END, {_FITS}, len(s.kept)
 FROM steps s JOIN rows_ o ON o.vx = s.vx AND o.vy = s.vy AND o.vz = s.vz AND o.i = s.i + 1),
cells AS (SELECT vx, vy, vz, row_number() OVER (ORDER BY vx, vy, vz) - 1 AS voxel_id FROM (SELECT DISTINCT vx, vy, vz FROM rows_))
SELECT point_id, vx, vy, vz, CAST(slot AS BIGINT) AS slot, CAST(voxel_id AS BIGINT) AS voxel_id, CAST(voxel_id * 4294967296 + slot AS BIGINT) AS global_index
FROM steps JOIN cells USING (vx, vy, vz) WHERE stays""",
    "pc_orders",
)
def flat_voxelmap(spark, sf_dir):
    kept = voxelmap.flat_voxelmap(clouds.orders(spark, sf_dir), 8.0)
    return voxelmap.map_indices(kept).select("point_id", "vx", "vy", "vz", "slot", "voxel_id", "global_index")


_WALK_FRAMES = 6


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding cloud seen from a sensor that moves a little each frame."""
    target = clouds.embeddings(spark, sf_dir).select("point_id", *XYZ)
    out, pose = None, np.eye(4)
    for k in range(_WALK_FRAMES):
        frame = _moved(target, inverse(pose)).select(F.lit(0).cast("long").alias("sensor_id"), F.lit(k).cast("long").alias("frame_id"), "point_id", *XYZ)
        out = frame if out is None else out.union(frame)
        pose = pose @ SMALL_POSE
    return out


def _walk_sql(digits: int) -> str:
    """The known walk: powers of the small pose."""
    step = [[num(float(SMALL_POSE[i, j])) for j in range(4)] for i in range(3)]
    times = [" + ".join([f"m{i}{a} * {step[a][j]}" for a in range(3)] + ([f"m{i}3"] if j == 3 else [])) for i in range(3) for j in range(4)]
    start = ", ".join(f"{num(float(i == j))} AS m{i}{j}" for i in range(3) for j in range(4))
    return f"""walk AS (SELECT 0 AS k, {start} UNION ALL SELECT k + 1, {", ".join(times)} FROM walk WHERE k < {_WALK_FRAMES - 1})
SELECT CAST(0 AS BIGINT) AS sensor_id, CAST(k AS BIGINT) AS frame_id, {", ".join(rnd(f"m{i}{j}", f"t{i}{j}", digits) for i in range(3) for j in range(4))} FROM walk"""


def _walked(poses: DataFrame, digits: int) -> DataFrame:
    return rounded(poses.select("sensor_id", "frame_id", *(F.element_at("pose", 4 * i + j + 1).alias(f"t{i}{j}") for i in range(3) for j in range(4))), digits)


@query("WITH RECURSIVE " + _walk_sql(2))
def odometry_s2s(spark, sf_dir):
    return _walked(odometry.run(_walk(spark, sf_dir), "gicp", leaf=0.01), 2)


@query("WITH RECURSIVE " + _walk_sql(1))
def odometry_s2m(spark, sf_dir):
    return _walked(odometry.run(_walk(spark, sf_dir), "vgicp_model", leaf=0.01, voxel=0.5), 1)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
