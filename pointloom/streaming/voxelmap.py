"""An incremental voxel map as the state of a stream, and odometry against it."""

from __future__ import annotations

import pickle

import numpy as np

from pointloom.operators.neighbors import OFFSETS
from pointloom.operators.voxelmap import CELL_POINTS, CELL_SQ_SPACING, LRU_CYCLE, LRU_HORIZON


class VoxelMap:
    """Voxels that are dropped when no insert has touched them for long (counted in inserts, not time).

    ``kind`` is ``gaussian`` (count, mean and mean covariance of a voxel) or
    ``flat`` (its first points that keep a distance). Reading doesn't refresh a
    voxel. Every ``cycle`` inserts, voxels last touched more than ``horizon``
    inserts ago go.
    """

    def __init__(self, leaf: float, kind: str = "gaussian", horizon: int = LRU_HORIZON, cycle: int = LRU_CYCLE, offsets: int = 1, cell_points: int = CELL_POINTS, sq_spacing: float = CELL_SQ_SPACING):
        if kind not in ("gaussian", "flat") or offsets not in OFFSETS:
            raise ValueError("a map is gaussian or flat and probes 1, 7 or 27 cells")
        self.leaf, self.kind, self.horizon, self.cycle, self.offsets = leaf, kind, horizon, cycle, offsets
        self.cell_points, self.sq_spacing = cell_points, sq_spacing
        self.inserts = 0
        self.cells: dict[tuple[int, int, int], list] = {}  # [last insert, n, rows of (xyz, 9 of the covariance, the normal)]
        self.has_normals = False
        self._flat = None

    def __len__(self) -> int:
        """The number of voxels."""
        return len(self.cells)

    def set_lru(self, horizon: int = LRU_HORIZON, cycle: int = LRU_CYCLE) -> None:
        self.horizon, self.cycle = horizon, cycle

    def insert(self, points: np.ndarray, covs: np.ndarray | None = None, t: np.ndarray | None = None, normals: np.ndarray | None = None) -> None:
        """Add points at a pose, with their covariances and normals if they have any (a map keeps what it is given)."""
        t = np.eye(4) if t is None else t
        moved = points @ t[:3, :3].T + t[:3, 3]
        spread = np.zeros((len(points), 9)) if covs is None else (t[:3, :3] @ covs @ t[:3, :3].T).reshape(-1, 9)
        turned = np.zeros((len(points), 3)) if normals is None else normals @ t[:3, :3].T
        self.has_normals |= normals is not None
        rows = np.concatenate([moved, spread, turned], axis=1)
        keys = np.floor(moved * (1.0 / self.leaf)).astype(np.int64)
        if self.kind == "gaussian":
            uniq, group, n = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
            sums = np.stack([np.bincount(group.ravel(), rows[:, i], len(uniq)) for i in range(15)], axis=1) if len(keys) else np.zeros((0, 15))
            for key, count, total in zip(map(tuple, uniq.tolist()), n.tolist(), sums, strict=True):
                cell = self.cells.setdefault(key, [0, 0, np.zeros(15)])
                cell[0], cell[1] = self.inserts, cell[1] + count
                cell[2] = cell[2] + total
        else:
            for key, row in zip(map(tuple, keys.tolist()), rows, strict=True):
                cell = self.cells.setdefault(key, [0, 0, []])
                cell[0] = self.inserts
                if cell[1] < self.cell_points and all(((row[:3] - x[:3]) ** 2).sum() >= self.sq_spacing for x in cell[2]):
                    cell[1] += 1
                    cell[2].append(row)
        self.inserts += 1
        if self.inserts % self.cycle == 0:
            self.cells = {k: c for k, c in self.cells.items() if c[0] + self.horizon >= self.inserts}
        self._flat = None

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, dict, np.ndarray]:
        """All points (or means), their covariances, and the range of rows of each voxel."""
        if self._flat is None:
            rows, where, at = [], {}, 0
            for key, cell in self.cells.items():
                own = [cell[2] / cell[1]] if self.kind == "gaussian" else cell[2]
                rows += own
                where[key] = (at, at + len(own))
                at += len(own)
            table = np.array(rows) if rows else np.zeros((0, 15))
            self._flat = table[:, :3], table[:, 3:12].reshape(-1, 3, 3), where, table[:, 12:]
        return self._flat

    @property
    def points(self) -> np.ndarray:
        return self._arrays()[0]

    @property
    def covs(self) -> np.ndarray:
        return self._arrays()[1]

    @property
    def normals(self) -> np.ndarray:
        """The stored normals (of a Gaussian voxel, the direction of their mean), or those of the covariances if none were given."""
        if self.has_normals:
            mean = self._arrays()[3]
            return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-300)
        return np.linalg.eigh(self.covs)[1][:, :, 0] if len(self.points) else np.zeros((0, 3))

    def match(self, moved: np.ndarray, max_sq: float) -> tuple[np.ndarray, np.ndarray]:
        """Source indices and map rows of the nearest entries in the probed voxels."""
        table, _, where, _ = self._arrays()
        keys = np.floor(moved * (1.0 / self.leaf)).astype(np.int64)
        uniq, group = np.unique(keys, axis=0, return_inverse=True)
        s, g = [], []
        order = np.argsort(group.ravel(), kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group.ravel(), minlength=len(uniq)))])
        for k, (x, y, z) in enumerate(uniq.tolist()):
            near = [where[c] for i, j, h in OFFSETS[self.offsets] if (c := (x + i, y + j, z + h)) in where]
            if not near:
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in near])
            own = order[cuts[k] : cuts[k + 1]]
            d2 = ((moved[own][:, None, :] - table[rows][None, :, :]) ** 2).sum(axis=2)
            best = d2.argmin(axis=1)
            fine = d2[np.arange(len(own)), best] <= max_sq
            s.append(own[fine])
            g.append(rows[best[fine]])
        if not s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, g = np.concatenate(s), np.concatenate(g)
        back = np.argsort(s, kind="stable")
        return s[back], g[back]


class ModelOdometry:
    """Scan-to-model: each scan is registered against the map of all before it and inserted there.

    With ``kind`` "last" it goes against the scan before it instead, from the last
    relative pose as the first guess.
    """

    def __init__(self, leaf: float = 0.25, voxel: float = 1.0, k: int = 10, kind: str = "gaussian", max_distance: float = 1.0, guess: str = "world", horizon: int = LRU_HORIZON, cycle: int = LRU_CYCLE, offsets: int = 1):
        if guess not in ("world", "constant_velocity"):
            raise ValueError("the first guess is the last pose (world) or goes on from it (constant_velocity)")
        self.leaf, self.k, self.max_distance, self.guess = leaf, k, max_distance, guess
        self.map = None if kind == "last" else VoxelMap(voxel, kind, horizon, cycle, offsets)
        self.target = None
        self.world, self.last, self.frames = np.eye(4), np.eye(4), 0
        self.last_frame: int | None = None

    def push(self, scan: np.ndarray) -> np.ndarray:
        from pointloom.plans.local import CloudTarget, features, register, voxel_means

        points = voxel_means(scan, self.leaf)
        if len(points) and self.map is None:
            normals, covs = features(points, self.k)
            if self.target is not None:
                self.last = register(self.target, points, covs, "gicp", self.last, self.max_distance).T
                self.world = self.world @ self.last
            self.target = CloudTarget(points, normals, covs)
        elif len(points):
            _, covs = features(points, self.k)
            if self.frames:
                init = self.world @ self.last if self.guess == "constant_velocity" else self.world
                pose = register(self.map, points, covs, "vgicp", init, self.max_distance).T
                self.last = np.linalg.inv(self.world) @ pose
                self.world = pose
            self.map.insert(points, covs, self.world)
        self.frames += 1
        return self.world

    def dump(self) -> bytes:
        if self.map is not None:
            self.map._flat = None
        return pickle.dumps(self)

    @staticmethod
    def load(raw: bytes) -> ModelOdometry:
        return pickle.loads(raw)
