"""Geometry of views by least squares and random samples: similarity, homography, epipolar geometry, poses, bundles, spatial graphs.

All are kernels for bounded groups (a frame, a block of matches, a local map), to
be run with ``solve_groups``; groups that could grow are cut into blocks first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship_package

# --- fixed values: 95 % of a chi-square with two and three degrees of freedom -----------------------------------
CHI2_MONO, CHI2_STEREO = 5.991, 7.815
# ---------------------------------------------------------------------------------------------------------------


def solve_groups(df: DataFrame, by: list[str], kernel: Callable[[pd.DataFrame], dict], fields: str) -> DataFrame:
    """One row per group: its keys and what ``kernel`` makes of its rows (columns named in ``fields``). Groups must be bounded."""
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(by, key)), **kernel(rows)}])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in by) + ", " + fields)


def umeyama(source: np.ndarray, target: np.ndarray, with_scale: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and scale that take source to target with least squares."""
    cs, ct = source.mean(axis=0), target.mean(axis=0)
    a, b = source - cs, target - ct
    u, d, vt = np.linalg.svd(b.T @ a)
    sign = np.ones(len(d))
    sign[-1] = np.sign(np.linalg.det(u @ vt)) or 1.0
    r = u @ np.diag(sign) @ vt
    spread = (a * a).sum()
    s = float((d * sign).sum() / spread) if with_scale and spread > 0 else 1.0
    return r, ct - s * r @ cs, s


def _samples(n: int, size: int, tries: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(n, size, replace=False) for _ in range(tries)]) if n >= size else np.empty((0, size), int)


def sim3_ransac(source: np.ndarray, target: np.ndarray, most: float, *, with_scale: bool = True, tries: int = 200, seed: int = 226) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Similarity with most pairs within ``most`` over random triples, refitted on them; fewer than three pairs give the identity and no inliers."""
    n = len(source)
    best = np.zeros(n, bool)
    for s in _samples(n, 3, tries, seed):
        r, t, k = umeyama(source[s], target[s], with_scale)
        inside = np.linalg.norm(k * source @ r.T + t - target, axis=1) <= most
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 3:
        return np.eye(3), np.zeros(3), 1.0, best
    r, t, k = umeyama(source[best], target[best], with_scale)
    return r, t, k, np.linalg.norm(k * source @ r.T + t - target, axis=1) <= most


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of mean 0 and mean distance sqrt 2, homogeneous, and the matrix that makes them so."""
    c = p.mean(axis=0)
    d = np.linalg.norm(p - c, axis=1).mean()
    s = np.sqrt(2) / d if d > 0 else 1.0
    t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1.0]])
    return np.c_[p, np.ones(len(p))] @ t.T, t


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix that takes points a to b, by the linear method on normalised points."""
    x, ta = _normalised(a)
    y, tb = _normalised(b)
    zero = np.zeros_like(x)
    m = np.r_[np.c_[x, zero, -y[:, :1] * x], np.c_[zero, x, -y[:, 1:2] * x]]
    h = np.linalg.inv(tb) @ np.linalg.svd(m)[2][-1].reshape(3, 3) @ ta
    return h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else np.linalg.norm(h))


def homography_ransac(a: np.ndarray, b: np.ndarray, most: float = 3.0, *, tries: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Homography with most points within ``most`` of their image, refitted on them."""

    def error(h: np.ndarray) -> np.ndarray:
        p = np.c_[a, np.ones(len(a))] @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.linalg.norm(p[:, :2] / p[:, 2:] - b, axis=1)
        return np.where(np.isfinite(e), e, np.inf)

    best = np.zeros(len(a), bool)
    for s in _samples(len(a), 4, tries, seed):
        inside = error(homography(a[s], b[s])) <= most
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 4:
        return np.eye(3), np.zeros(len(a), bool)
    h = homography(a[best], b[best])
    return h, error(h) <= most


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank-two F with b' F a = 0, by the normalised eight-point method."""
    x, ta = _normalised(a)
    y, tb = _normalised(b)
    u, d, vt = np.linalg.svd(np.linalg.svd(np.einsum("ni,nj->nij", y, x).reshape(len(x), 9))[2][-1].reshape(3, 3))
    f = tb.T @ (u @ np.diag([d[0], d[1], 0.0]) @ vt) @ ta
    return f / max(np.linalg.norm(f), 1e-300)


def sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of pairs from the epipolar geometry, to first order."""
    x, y = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    l, m = x @ f.T, y @ f
    return (y * l).sum(axis=1) ** 2 / np.maximum(l[:, 0] ** 2 + l[:, 1] ** 2 + m[:, 0] ** 2 + m[:, 1] ** 2, 1e-300)


def essential_ransac(a: np.ndarray, b: np.ndarray, k: np.ndarray, most: float = 1.0, *, tries: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Essential matrix, rotation, direction and inliers of pixel pairs of a camera ``k``: most pairs within ``most`` pixels, the pose with most points before both views."""
    best = np.zeros(len(a), bool)
    for s in _samples(len(a), 8, tries, seed):
        inside = sampson(fundamental(a[s], b[s]), a, b) <= most * most
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 8:
        return np.zeros((3, 3)), np.eye(3), np.zeros(3), np.zeros(len(a), bool)
    f = fundamental(a[best], b[best])
    best = sampson(f, a, b) <= most * most
    u, _, vt = np.linalg.svd(k.T @ f @ k)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    turn = np.array([[0, -1.0, 0], [1, 0, 0], [0, 0, 1]])
    rays = [(np.linalg.inv(k) @ np.c_[p[best], np.ones(best.sum())].T).T for p in (a, b)]
    front = []
    for w in (turn, turn.T):
        r = u @ w @ vt
        for t in (u[:, 2], -u[:, 2]):
            # depths in both views by the two-by-two system of each pair
            p, q = rays[0] @ r.T, rays[1]
            pq, pp, qq = (p * q).sum(1), (p * p).sum(1), (q * q).sum(1)
            det = np.maximum(pp * qq - pq * pq, 1e-300)
            d1 = (-(p @ t) * qq + (q @ t) * pq) / det
            d2 = ((q @ t) * pp - (p @ t) * pq) / det
            front.append((int(((d1 > 0) & (d2 > 0)).sum()), r, t))
    _, r, t = max(front, key=lambda x: x[0])
    cross = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    return cross @ r, r, t, best


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation by a vector (axis times angle)."""
    n = np.linalg.norm(v)
    x = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if n < 1e-8:
        return np.eye(3) + x + x @ x / 2
    return np.eye(3) + np.sin(n) / n * x + (1 - np.cos(n)) / (n * n) * x @ x


def rotation_vector(r: np.ndarray) -> np.ndarray:
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    n = np.linalg.norm(v)
    if n < 1e-8:
        if c > 0:
            return v
        w, m = np.linalg.eigh(r)
        return np.pi * m[:, -1]
    return np.arctan2(n, c) / n * v


def _project(r: np.ndarray, t: np.ndarray, points: np.ndarray, cam: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels, camera points, and derivatives of pixels by camera points."""
    fx, fy, cx, cy = cam
    p = points @ r.T + t
    z = np.where(np.abs(p[:, 2]) > 1e-9, p[:, 2], 1e-9)
    j = np.zeros((len(p), 2, 3))
    j[:, 0, 0], j[:, 0, 2], j[:, 1, 1], j[:, 1, 2] = fx / z, -fx * p[:, 0] / z**2, fy / z, -fy * p[:, 1] / z**2
    return np.stack([fx * p[:, 0] / z + cx, fy * p[:, 1] / z + cy], axis=1), p, j


def _by_pose(p: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Derivatives of pixels by a small turn and shift of the camera frame."""
    skew = np.zeros((len(p), 3, 3))
    skew[:, 0, 1], skew[:, 0, 2], skew[:, 1, 0], skew[:, 1, 2], skew[:, 2, 0], skew[:, 2, 1] = p[:, 2], -p[:, 1], -p[:, 2], p[:, 0], p[:, 1], -p[:, 0]
    return np.concatenate([np.einsum("nij,njk->nik", j, skew), j], axis=2)


def motion_only(r: np.ndarray, t: np.ndarray, points: np.ndarray, pixels: np.ndarray, cam: tuple[float, float, float, float], sigma2: np.ndarray | None = None, *, rounds: int = 4, steps: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """World-to-camera pose from points and pixels: ``rounds`` of ``steps`` Gauss-Newton steps, outliers being judged anew after each; Huber weights but in the last two."""
    sigma2 = np.ones(len(points)) if sigma2 is None else sigma2
    inside = np.ones(len(points), bool)
    for k in range(rounds):
        for _ in range(steps):
            uv, p, j = _project(r, t, points, cam)
            e = pixels - uv
            chi = (e * e).sum(axis=1) / sigma2
            w = inside / sigma2
            if k < 2:
                w = w * np.where(chi > CHI2_MONO, np.sqrt(CHI2_MONO / np.maximum(chi, 1e-300)), 1.0)
            w = np.where(p[:, 2] > 0, w, 0.0)
            a = _by_pose(p, j)
            h, g = np.einsum("nij,n,nik->jk", a, w, a), np.einsum("nij,n,ni->j", a, w, e)
            d = np.linalg.solve(h + 1e-9 * np.eye(6), g)
            turn = rotation(d[:3])
            r, t = turn @ r, turn @ t + d[3:]
            if np.linalg.norm(d) < 1e-10:
                break
        uv, p, _ = _project(r, t, points, cam)
        inside = (((pixels - uv) ** 2).sum(axis=1) / sigma2 <= CHI2_MONO) & (p[:, 2] > 0)
        if inside.sum() < 3:
            break
    return r, t, inside


def bundle_adjust(rs: np.ndarray, ts: np.ndarray, points: np.ndarray, cam_of: np.ndarray, point_of: np.ndarray, pixels: np.ndarray, cam: tuple[float, float, float, float], fixed: int = 1, *, steps: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local bundle adjustment by damped Gauss-Newton with the points eliminated; the first ``fixed`` cameras stay. A second pass leaves out what doesn't fit after the first. Returns rotations, translations, points and inliers."""
    rs, ts, points = rs.copy(), ts.copy(), points.copy()
    n, m = len(rs), len(points)
    live = np.ones(len(pixels), bool)

    def look(rs, ts, points):
        e, a, b, z = np.empty((len(pixels), 2)), np.empty((len(pixels), 2, 6)), np.empty((len(pixels), 2, 3)), np.empty(len(pixels))
        for c in range(n):
            of = cam_of == c
            uv, p, j = _project(rs[c], ts[c], points[point_of[of]], cam)
            e[of], a[of], b[of], z[of] = pixels[of] - uv, _by_pose(p, j), j @ rs[c], p[:, 2]
        chi = (e * e).sum(axis=1)
        w = np.where(live & (z > 0), np.where(chi > CHI2_MONO, np.sqrt(CHI2_MONO / np.maximum(chi, 1e-300)), 1.0), 0.0)
        cost = np.where(chi > CHI2_MONO, 2 * np.sqrt(CHI2_MONO * chi) - CHI2_MONO, chi)[live].sum()
        return e, a, b, w, cost, chi, z

    # once with all observations, and again without those that don't fit
    for _ in range(2):
        lam = 1e-4
        e, a, b, w, cost, chi, z = look(rs, ts, points)
        for _ in range(steps):
            hcc, gc = np.zeros((n, 6, 6)), np.zeros((n, 6))
            hpp, gp = np.zeros((m, 3, 3)), np.zeros((m, 3))
            np.add.at(hcc, cam_of, np.einsum("nij,n,nik->njk", a, w, a))
            np.add.at(gc, cam_of, np.einsum("nij,n,ni->nj", a, w, e))
            np.add.at(hpp, point_of, np.einsum("nij,n,nik->njk", b, w, b))
            np.add.at(gp, point_of, np.einsum("nij,n,ni->nj", b, w, e))
            cross = np.zeros((n, m, 6, 3))
            np.add.at(cross, (cam_of, point_of), np.einsum("nij,n,nik->njk", a, w, b))
            inv = np.linalg.inv(hpp + (lam * np.trace(hpp, axis1=1, axis2=2)[:, None, None] / 3 + 1e-9) * np.eye(3))
            y = np.einsum("cmij,mjk->cmik", cross, inv)
            s = -np.einsum("cmik,dmjk->cidj", y, cross)
            for c in range(n):
                s[c, :, c, :] += hcc[c] + (lam * np.trace(hcc[c]) / 6 + 1e-9) * np.eye(6)
            g = gc - np.einsum("cmik,mk->ci", y, gp)
            free = np.arange(fixed, n)
            dc = np.zeros((n, 6))
            if len(free):
                dc[free] = np.linalg.solve(s[np.ix_(free, range(6), free, range(6))].reshape(6 * len(free), -1), g[free].ravel()).reshape(-1, 6)
            dp = np.einsum("mij,mj->mi", inv, gp - np.einsum("cmij,ci->mj", cross, dc))
            turns = np.stack([rotation(d[:3]) for d in dc])
            new = turns @ rs, np.einsum("cij,cj->ci", turns, ts) + dc[:, 3:], points + dp
            seen = look(*new)
            if seen[4] < cost:
                small = cost - seen[4] < 1e-9 * max(cost, 1e-12)
                (rs, ts, points), (e, a, b, w, cost, chi, z) = new, seen
                lam = max(lam / 5, 1e-9)
                if small:
                    break
            else:
                lam *= 10
                if lam > 1e6:
                    break
        live = (chi <= CHI2_MONO) & (z > 0)
    return rs, ts, points, live


def spatial_graph(rs: np.ndarray, ts: np.ndarray, i: np.ndarray, j: np.ndarray, zr: np.ndarray, zt: np.ndarray, weight: np.ndarray, *, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton on spatial poses (camera to world) with edges i -> j measured as (zr, zt); pose 0 stays. For the poses of one block."""
    rs, ts = rs.copy(), ts.copy()
    n = len(rs)
    for _ in range(steps):
        h, g = np.zeros((n, 6, n, 6)), np.zeros((n, 6))
        for a, b, r, t, w in zip(i, j, zr, zt, weight):
            back = r.T @ rs[a].T
            er, et = rotation_vector(back @ rs[b]), back @ (ts[b] - ts[a]) - r.T @ t
            d = ts[b] - ts[a]
            cross = np.array([[0, -d[2], d[1]], [d[2], 0, -d[0]], [-d[1], d[0], 0]])
            # by small turns (of the world about the pose) and shifts of either pose
            jb, ja = np.zeros((6, 6)), np.zeros((6, 6))
            jb[:3, :3], jb[3:, 3:] = back, back
            ja[:3, :3], ja[3:, 3:], ja[3:, :3] = -back, -back, back @ cross
            e = np.concatenate([er, et])
            for p, jp in ((a, ja), (b, jb)):
                g[p] -= w * jp.T @ e
                for q, jq in ((a, ja), (b, jb)):
                    h[p, :, q, :] += w * jp.T @ jq
        free = slice(1, n)
        m = 6 * (n - 1)
        if not m:
            break
        step = np.linalg.solve(h[free, :, free, :].reshape(m, m) + 1e-9 * np.eye(m), g[free].ravel()).reshape(-1, 6)
        for k, d in enumerate(step, 1):
            rs[k], ts[k] = rotation(d[:3]) @ rs[k], ts[k] + d[3:]
        if np.linalg.norm(step) < 1e-9:
            break
    return rs, ts


def correct_points(points: np.ndarray, owner: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Points moved with the keyframe that owns them, from its pose before an optimisation to that after it."""
    r0, t0 = before[0][owner], before[1][owner]
    local = np.einsum("nji,nj->ni", r0, points - t0)
    return np.einsum("nij,nj->ni", after[0][owner], local) + after[1][owner]
