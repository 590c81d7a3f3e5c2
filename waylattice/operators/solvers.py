"""Least squares on graphs and point sets: pose graphs, robust alignment, scan matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

HUBER, SETTLED = 3.0, 1e-7


def wrap(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


def relative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of b in the frames of rows of a."""
    c, s = np.cos(a[:, 2]), np.sin(a[:, 2])
    d = b[:, :2] - a[:, :2]
    return np.stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1], wrap(b[:, 2] - a[:, 2])], axis=1)


def optimise_pose_graph(poses: np.ndarray, i: np.ndarray, j: np.ndarray, z: np.ndarray, weight: np.ndarray, robust: np.ndarray, *, rounds: int = 30, damping: float = 1e-6) -> np.ndarray:
    """Gauss-Newton on planar poses with edges i -> j measured as z; ``weight`` are the information's diagonals, ``robust`` edges get Huber weights; pose 0 stays.

    The normal equations are never formed: edges hold their two Jacobian blocks,
    and conjugate gradients with block-diagonal scaling solve each step, so cost
    and memory go with the number of edges.
    """
    x = poses.astype(float).copy()
    n = len(x)
    if n < 2 or not len(i):
        return x
    for _ in range(rounds):
        r = relative(x[i], x[j]) - z
        r[:, 2] = wrap(r[:, 2])
        white = np.sqrt((r * r * weight).sum(axis=1))
        w = weight * np.where(robust & (white > HUBER), HUBER / np.maximum(white, 1e-12), 1.0)[:, None]
        c, s = np.cos(x[i, 2]), np.sin(x[i, 2])
        d = x[j, :2] - x[i, :2]
        a, b = np.zeros((len(i), 3, 3)), np.zeros((len(i), 3, 3))
        b[:, 0, 0], b[:, 0, 1], b[:, 1, 0], b[:, 1, 1], b[:, 2, 2] = c, s, -s, c, 1.0
        a[:, :2, :2] = -b[:, :2, :2]
        a[:, 0, 2], a[:, 1, 2], a[:, 2, 2] = -s * d[:, 0] + c * d[:, 1], -c * d[:, 0] - s * d[:, 1], -1.0

        def add(at: np.ndarray, v: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(at, weights=v[:, k], minlength=n) for k in range(3)], axis=1)

        def times(v: np.ndarray) -> np.ndarray:
            e = (np.einsum("eij,ej->ei", a, v[i]) + np.einsum("eij,ej->ei", b, v[j])) * w
            out = add(i, np.einsum("eji,ej->ei", a, e)) + add(j, np.einsum("eji,ej->ei", b, e)) + damping * v
            out[0] = 0.0
            return out

        g = -(add(i, np.einsum("eji,ej->ei", a, r * w)) + add(j, np.einsum("eji,ej->ei", b, r * w)))
        g[0] = 0.0
        block = np.zeros((n, 3, 3))
        np.add.at(block, i, np.einsum("eji,ej,ejk->eik", a, w, a))
        np.add.at(block, j, np.einsum("eji,ej,ejk->eik", b, w, b))
        inverse = np.linalg.inv(block + (damping + 1e-9) * np.eye(3))
        step, rest = np.zeros_like(g), g.copy()
        y = np.einsum("nij,nj->ni", inverse, rest)
        p, rho = y.copy(), float((rest * y).sum())
        for _ in range(min(20 * n, 2000)):
            if rho <= 1e-24:
                break
            q = times(p)
            alpha = rho / max(float((p * q).sum()), 1e-300)
            step, rest = step + alpha * p, rest - alpha * q
            y = np.einsum("nij,nj->ni", inverse, rest)
            y[0] = 0.0
            new = float((rest * y).sum())
            if new < 1e-18 * max(1.0, float((g * g).sum())):
                break
            p, rho = y + new / rho * p, new
        x += step
        x[:, 2] = wrap(x[:, 2])
        if np.linalg.norm(step) < SETTLED:
            break
    return x


def solve_pose_graphs(nodes: DataFrame, edges: DataFrame, by: str, *, rounds: int = 30) -> DataFrame:
    """Optimises the pose graph of each run: nodes (by, node, x, y, theta), edges (by, i, j, dx, dy, dtheta, w_xy, w_theta, loop).

    Runs are solved side by side, one to a task; loop edges get robust weights.
    Edges whose ends are no nodes are left out; the least node of a run stays.
    """
    ship_package(nodes.sparkSession)

    def solve(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return n
        n = n.sort_values("node").drop_duplicates("node").reset_index(drop=True)
        place = pd.Series(n.index, index=n["node"])
        e = e[e["i"].isin(place.index) & e["j"].isin(place.index)]
        x = optimise_pose_graph(n[["x", "y", "theta"]].to_numpy(), place[e["i"]].to_numpy(), place[e["j"]].to_numpy(), e[["dx", "dy", "dtheta"]].to_numpy(), e[["w_xy", "w_xy", "w_theta"]].to_numpy(), e["loop"].to_numpy(dtype=bool), rounds=rounds)
        return n.assign(x=x[:, 0], y=x[:, 1], theta=x[:, 2])

    kind = dict(nodes.dtypes)
    right = edges.withColumn("of", F.col(by))  # a name of its own: the edges may be made from the nodes
    left = nodes.select(by, F.col("node").cast("bigint").alias("node"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "theta")])
    return left.groupBy(by).cogroup(right.groupBy("of")).applyInPandas(solve, f"`{by}` {kind[by]}, node BIGINT, x DOUBLE, y DOUBLE, theta DOUBLE")


def kabsch(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that take source to target with least squares."""
    cs, ct = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((target - ct).T @ (source - cs))
    r = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0]) @ vt
    return r, ct - r @ cs


def robust_alignment(source: np.ndarray, target: np.ndarray, most: float = 0.08, tries: int = 200, seed: int = 226) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of most correspondences within ``most``: the one over all and those of random triples compete by inliers, then mean error; the winner is refitted on its inliers."""
    good = np.isfinite(source).all(axis=1) & np.isfinite(target).all(axis=1)
    none = np.zeros(len(source), bool)
    if good.sum() < 3:
        return np.eye(3), np.zeros(3), none
    rng, at = np.random.default_rng(seed), np.flatnonzero(good)
    samples = [at, *{tuple(sorted(rng.choice(at, 3, replace=False).tolist())) for _ in range(min(tries, len(at) * (len(at) - 1) * (len(at) - 2) // 6))}]

    def score(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, tuple[int, float]]:
        with np.errstate(invalid="ignore"):
            e = np.linalg.norm(source @ r.T + t - target, axis=1)
            inside = good & (e <= most)
        return inside, (int(inside.sum()), -float(e[inside].mean()) if inside.any() else -np.inf)

    best = None
    for s in samples:
        r, t = kabsch(source[list(s)], target[list(s)])
        inside, rank = score(r, t)
        if best is None or rank > best[0]:
            best = (rank, r, t, inside)
    if best[3].sum() >= 3:
        r, t = kabsch(source[best[3]], target[best[3]])
        return r, t, score(r, t)[0]
    return best[1], best[2], best[3]


def score_offsets(points: DataFrame, cells: DataFrame, resolution: float, *, reach: float, step: float, turn: float, turn_step: float, least: int = 20) -> DataFrame:
    """Correlative matching as joins: mean probability of the cells that a scan's points fall on, for each offset of a square and angular window.

    ``points``: (scan, map, x, y); ``cells``: (map, gx, gy, p). Points off the map
    count for nothing, an offset with fewer than ``least`` on it is left out.
    Returns (scan, dx, dy, dtheta, score, n).
    """
    n, m = round(reach / step), round(turn / turn_step)
    tried = points
    for c, k in (("i", n), ("j", n), ("k", m)):
        tried = tried.withColumn(c, F.explode(F.sequence(F.lit(-k), F.lit(k))))
    tried = tried.withColumns({"dx": F.col("i") * step, "dy": F.col("j") * step, "dtheta": F.col("k") * turn_step})
    c, s = F.cos("dtheta"), F.sin("dtheta")
    at = tried.select("scan", "map", "dx", "dy", "dtheta", F.floor((c * F.col("x") - s * F.col("y") + F.col("dx")) / resolution).alias("gx"), F.floor((s * F.col("x") + c * F.col("y") + F.col("dy")) / resolution).alias("gy"))
    return at.join(cells, ["map", "gx", "gy"]).groupBy("scan", "dx", "dy", "dtheta").agg(F.avg("p").alias("score"), F.count("*").alias("n")).where(F.col("n") >= least)


def best_offsets(scores: DataFrame) -> DataFrame:
    """The best offset of each scan; of equally good ones the least, and of those the first in order."""
    small = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dtheta") * F.col("dtheta")
    rank = F.struct(F.col("score"), (-small).alias("near"), (-F.col("dx")).alias("a"), (-F.col("dy")).alias("b"), (-F.col("dtheta")).alias("c"))
    return scores.groupBy("scan").agg(F.max_by(F.struct("dx", "dy", "dtheta", "score", "n"), rank).alias("m")).select("scan", "m.*")


def sample_grid(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bilinear value and gradient of a grid [y, x] at cell coordinates; 0 off the grid."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    ok = (x0 >= 0) & (y0 >= 0) & (x0 < grid.shape[1] - 1) & (y0 < grid.shape[0] - 1)
    x0, y0 = np.where(ok, x0, 0), np.where(ok, y0, 0)
    fx, fy = x - x0, y - y0
    a, b, c, d = grid[y0, x0], grid[y0, x0 + 1], grid[y0 + 1, x0], grid[y0 + 1, x0 + 1]
    v = a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + c * (1 - fx) * fy + d * fx * fy
    gx, gy = (b - a) * (1 - fy) + (d - c) * fy, (c - a) * (1 - fx) + (d - b) * fx
    return np.where(ok, v, 0.0), np.where(ok, gx, 0.0), np.where(ok, gy, 0.0)


def refine_pose(grid: np.ndarray, origin: tuple[float, float], resolution: float, points: np.ndarray, pose: np.ndarray, *, rounds: int = 20, damping: float = 1e-3) -> tuple[np.ndarray, float]:
    """Gauss-Newton of a pose on a probability grid: drives the points' probabilities to one; returns pose and mean probability."""
    pose = np.asarray(pose, float).copy()

    def look(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = np.cos(p[2]), np.sin(p[2])
        wx, wy = p[0] + c * points[:, 0] - s * points[:, 1], p[1] + s * points[:, 0] + c * points[:, 1]
        v, gx, gy = sample_grid(grid, (wx - origin[0]) / resolution, (wy - origin[1]) / resolution)
        j = np.stack([gx, gy, gx * (-s * points[:, 0] - c * points[:, 1]) + gy * (c * points[:, 0] - s * points[:, 1])], axis=1) / resolution
        return 1.0 - v, -j

    r, j = look(pose)
    lam = damping
    for _ in range(rounds):
        h = j.T @ j
        step = -np.linalg.solve(h + lam * np.diag(np.diag(h) + 1e-9), j.T @ r)
        new_r, new_j = look(pose + step)
        if new_r @ new_r < r @ r:
            pose, r, j, lam = pose + step, new_r, new_j, max(lam / 3, 1e-9)
        else:
            lam *= 10
        if np.linalg.norm(step) < 1e-6 or lam > 1e9:
            break
    pose[2] = float(wrap(np.array(pose[2])))
    return pose, float(1.0 - r.mean())


def forward_max_grid(grid: np.ndarray, width: int) -> np.ndarray:
    """Greatest value of the ``width`` square from each cell on."""
    out = grid
    step = 1
    while step < width:
        by = min(step, width - step)
        for axis in (0, 1):
            moved = np.zeros_like(out)
            if axis == 0:
                moved[: out.shape[0] - by] = out[by:]
            else:
                moved[:, : out.shape[1] - by] = out[:, by:]
            out = np.maximum(out, moved)
        step += by
    return out


def branch_and_bound(grid: np.ndarray, origin: tuple[float, float], resolution: float, points: np.ndarray, pose: np.ndarray, *, reach: float, turn: float, turn_step: float, depth: int = 4, least: float = 0.0) -> tuple[np.ndarray, float] | None:
    """Best pose of a window by the mean probability of the points' nearest cells; None under ``least``.

    Blocks of offsets are bounded by the forward maxima of the grid and split in
    the order of their bounds, so the result is that of the full search.
    """
    pad = int(np.ceil(reach / resolution)) + (1 << depth)
    wide = np.pad(grid, pad)
    levels = [forward_max_grid(wide, 1 << d) for d in range(depth + 1)]
    steps = int(np.ceil(reach / resolution))
    best, at = least, None
    open_ = []
    for k in range(-round(turn / turn_step), round(turn / turn_step) + 1):
        a = pose[2] + k * turn_step
        c, s = np.cos(a), np.sin(a)
        gx = np.floor((pose[0] + c * points[:, 0] - s * points[:, 1] - origin[0]) / resolution).astype(int) + pad
        gy = np.floor((pose[1] + s * points[:, 0] + c * points[:, 1] - origin[1]) / resolution).astype(int) + pad
        for ox in range(-steps, steps + 1, 1 << depth):
            for oy in range(-steps, steps + 1, 1 << depth):
                open_.append((k, gx, gy, ox, oy, depth))

    def value(gx: np.ndarray, gy: np.ndarray, ox: int, oy: int, d: int) -> float:
        x, y = gx + ox, gy + oy
        inside = (x >= 0) & (y >= 0) & (x < wide.shape[1]) & (y < wide.shape[0])
        return float(np.where(inside, levels[d][np.where(inside, y, 0), np.where(inside, x, 0)], 0.0).mean())

    stack = sorted(((value(gx, gy, ox, oy, d), (k, gx, gy, ox, oy, d)) for k, gx, gy, ox, oy, d in open_), key=lambda v: v[0])
    while stack:
        bound, (k, gx, gy, ox, oy, d) = stack.pop()
        if bound <= best and at is not None or bound < best:
            continue
        if d == 0:
            best, at = bound, (k, ox, oy)
            continue
        half = 1 << (d - 1)
        parts = [(k, gx, gy, ox + i * half, oy + j * half, d - 1) for i in (0, 1) for j in (0, 1) if ox + i * half <= steps and oy + j * half <= steps]
        stack.extend(sorted(((value(p[1], p[2], p[3], p[4], p[5]), p) for p in parts), key=lambda v: v[0]))
    if at is None:
        return None
    k, ox, oy = at
    return np.array([pose[0] + ox * resolution, pose[1] + oy * resolution, float(wrap(np.array(pose[2] + k * turn_step)))]), best
