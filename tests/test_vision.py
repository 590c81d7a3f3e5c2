import numpy as np
import pytest

from waylattice.operators import vision as v

CAM = (500.0, 510.0, 320.0, 240.0)
K = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])


def pixels(r, t, p):
    return v._project(r, t, p, CAM)[0]


def test_sim3_ransac():
    g = np.random.default_rng(1)
    r, t = v.rotation(np.array([0.3, -0.2, 0.9])), np.array([1.0, -2.0, 0.5])
    a = g.normal(size=(60, 3))
    b = 1.7 * a @ r.T + t + 0.001 * g.normal(size=(60, 3))
    b[:20] += g.normal(size=(20, 3)) + 2
    gr, gt, gs, inside = v.sim3_ransac(a, b, 0.02)
    assert inside.tolist() == [False] * 20 + [True] * 40 and gs == pytest.approx(1.7, abs=1e-3) and np.allclose(gr, r, atol=1e-3) and np.allclose(gt, t, atol=1e-2)
    assert not v.sim3_ransac(a[:2], b[:2], 0.1)[3].any()


def test_homography_ransac():
    g = np.random.default_rng(2)
    h = np.array([[1.1, 0.05, 12], [-0.03, 0.95, -4], [1e-4, 2e-4, 1]])
    a = g.uniform(0, 600, (50, 2))
    p = np.c_[a, np.ones(50)] @ h.T
    b = p[:, :2] / p[:, 2:]
    b[:12] += g.uniform(20, 60, (12, 2))
    got, inside = v.homography_ransac(a, b)
    assert inside.tolist() == [False] * 12 + [True] * 38 and np.allclose(got, h, atol=1e-6)
    assert not v.homography_ransac(a[:3], b[:3])[1].any()


def test_essential_ransac():
    g = np.random.default_rng(3)
    r, t = v.rotation(np.array([0.05, -0.1, 0.02])), np.array([0.3, 0.05, 0.1])
    p = g.uniform([-2, -2, 4], [2, 2, 9], (80, 3))
    a, b = pixels(np.eye(3), np.zeros(3), p), pixels(r, t, p)
    b[:15] += g.uniform(15, 40, (15, 2))
    e, gr, gt, inside = v.essential_ransac(a, b, K)
    assert inside[15:].all() and inside[:15].sum() <= 2 and np.allclose(gr, r, atol=1e-3) and np.allclose(gt, t / np.linalg.norm(t), atol=1e-2)


def test_motion_only():
    g = np.random.default_rng(4)
    r, t = v.rotation(np.array([0.2, 0.1, -0.3])), np.array([0.1, -0.2, 0.4])
    p = g.uniform([-2, -2, 4], [2, 2, 9], (60, 3))
    uv = pixels(r, t, p) + 0.2 * g.normal(size=(60, 2))
    uv[:10] += 60
    gr, gt, inside = v.motion_only(np.eye(3), np.zeros(3), p, uv, CAM)
    assert inside.tolist() == [False] * 10 + [True] * 50 and np.allclose(gr, r, atol=2e-3) and np.allclose(gt, t, atol=1e-2)


def test_bundle_adjust():
    g = np.random.default_rng(5)
    p = g.uniform([-2, -2, 4], [2, 2, 9], (40, 3))
    rs = np.stack([v.rotation(0.05 * k * np.array([0.3, 1, 0.2])) for k in range(4)])
    ts = np.stack([np.array([0.2 * k, 0.05 * k, 0]) for k in range(4)])
    cam_of, point_of = np.repeat(np.arange(4), 40), np.tile(np.arange(40), 4)
    uv = np.concatenate([pixels(r, t, p) for r, t in zip(rs, ts)])
    uv[7] += 80  # one outlier
    rs0 = np.stack([rs[0], rs[1], *[v.rotation(0.01 * g.normal(size=3)) @ r for r in rs[2:]]])
    ts0 = np.r_[ts[:2], ts[2:] + 0.03 * g.normal(size=(2, 3))]
    gr, gt, gp, inside = v.bundle_adjust(rs0, ts0, p + 0.05 * g.normal(size=p.shape), cam_of, point_of, uv, CAM, fixed=2, steps=60)
    assert not inside[7] and inside.sum() >= 157 and np.allclose(gt, ts, atol=5e-3) and np.median(np.linalg.norm(gp - p, axis=1)) < 5e-3


def test_spatial_graph_closes_a_loop():
    n = 12
    turn = v.rotation(np.array([0, 0, 2 * np.pi / n]))
    rs, ts = [np.eye(3)], [np.zeros(3)]
    for _ in range(n - 1):
        ts.append(ts[-1] + rs[-1] @ np.array([1.0, 0, 0.1]))
        rs.append(rs[-1] @ turn)
    rs, ts = np.stack(rs), np.stack(ts)
    i, j = np.r_[np.arange(n - 1), n - 1], np.r_[np.arange(1, n), 0]
    zr = np.stack([rs[a].T @ rs[b] for a, b in zip(i, j)])
    zt = np.stack([rs[a].T @ (ts[b] - ts[a]) for a, b in zip(i, j)])
    g = np.random.default_rng(6)
    rs0 = np.stack([rs[0], *[v.rotation(0.1 * g.normal(size=3)) @ r for r in rs[1:]]])
    ts0 = np.r_[ts[:1], ts[1:] + 0.2 * g.normal(size=(n - 1, 3))]
    gr, gt = v.spatial_graph(rs0, ts0, i, j, zr, zt, np.ones(n), steps=50)
    assert np.allclose(gt, ts, atol=1e-5) and np.allclose(gr, rs, atol=1e-5)
    owner = np.array([3, 5])
    moved = v.correct_points(np.stack([ts0[3] + rs0[3] @ [1, 2, 3], ts0[5]]), owner, (rs0, ts0), (gr, gt))
    assert np.allclose(moved, np.stack([ts[3] + rs[3] @ [1, 2, 3], ts[5]]), atol=1e-5)
