import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylattice.functions import geom
from waylattice.operators import asof, descriptors, graph, loops, maps, solvers, trajectory

random.seed(5)


def stamped(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def brute_nearest(lefts, rights, tol, tie):
    out = {}
    for i, e, t in lefts:
        cand = [(abs(r - t), r if tie == "earlier" else -r, rid) for rid, re, r in rights if re == e] if e is not None and t is not None else []
        best = min(cand, default=None)
        out[i] = best[2] if best and (tol is None or best[0] <= tol) else None
    return out


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("tol", [None, 0.5])
def test_asof_nearest_brute(spark, tie, tol):
    rights = [(i, random.choice("ab"), float(t)) for i, t in enumerate(random.sample(range(0, 6000, 3), 60))]
    lefts = [(i, random.choice("abc"), random.randrange(0, 60000) / 10) for i in range(200)] + [(900, None, 1.0), (901, "a", None), (902, "a", 4.5)]
    left = stamped(spark, [(*r, "prev", 1) for r in lefts], "id BIGINT, e STRING, t DOUBLE, row STRING, r INT")
    right = stamped(spark, rights, "id BIGINT, e STRING, t DOUBLE")
    got = {r["id"]: r["match_id"] for r in asof.asof_nearest(left, right, "e", "t", "t", "id", tolerance=tol, tie=tie).collect()}
    want = brute_nearest(lefts, rights, tol, tie)
    assert got == want
    assert asof.asof_nearest(left, right.limit(0), "e", "t", "t", "id").where("match_id IS NOT NULL").count() == 0
    assert asof.asof_nearest(left.limit(0), right, "e", "t", "t", "id").count() == 0


def test_asof_backward_and_exact(spark):
    left = stamped(spark, [(1, "a", 2.0, "k2"), (2, "a", 0.5, "k9"), (3, "a", 700.0, "k1")], "id BIGINT, e STRING, t DOUBLE, key STRING")
    right = stamped(spark, [(10, "a", 1.0, "k1"), (11, "a", 2.0, "k2")], "id BIGINT, e STRING, t DOUBLE, key STRING")
    got = {r["id"]: r["match_id"] for r in asof.asof_backward(left, right, "e", "t", "t", "id").collect()}
    assert got == {1: 11, 2: None, 3: 11}
    got = {r["id"]: r["match_id"] for r in asof.asof_exact_then_nearest(left, right, "e", "key", "t", "t", "id", tolerance=0.6).collect()}
    assert got == {1: 11, 2: 10, 3: 10}


def greedy(lefts, rights, tol):
    """Two neighbours of each left row in time; used ones are out; the later wins a tie."""
    rights, used, out = sorted(rights), set(), {}
    for t, i in sorted(lefts):
        k = next((n for n, r in enumerate(rights) if r[0] >= t), len(rights))
        best = None
        for n in (k, k - 1):
            if 0 <= n < len(rights) and n not in used and (best is None or abs(rights[n][0] - t) < best[0]):
                best = (abs(rights[n][0] - t), n)
        if best and best[0] <= tol:
            used.add(best[1])
            out[i] = rights[best[1]][1]
    return out


def test_asof_greedy_brute(spark):
    rights = [(round(t, 3), i) for i, t in enumerate(sorted(random.sample([x / 10 for x in range(400)], 80)))]
    lefts = [(round(random.random() * 40 + 0.0001 * i, 4), i) for i in range(120)]
    left = stamped(spark, [("a", t, i) for t, i in lefts], "e STRING, t DOUBLE, id BIGINT")
    right = stamped(spark, [("a", t, i) for t, i in rights], "e STRING, t DOUBLE, id BIGINT")
    got = {r["id"]: r["match_id"] for r in asof.asof_greedy(left, right, "e", "t", "id", "t", "id", tolerance=0.3).collect()}
    assert got == greedy(lefts, rights, 0.3)


def test_asof_first_come(spark):
    left = stamped(spark, [("a", 1.00, 1), ("a", 1.01, 2), ("a", 3.05, 3)], "e STRING, t DOUBLE, id BIGINT")
    right = stamped(spark, [("a", 1.004, 7), ("a", 2.0, 8)], "e STRING, t DOUBLE, id BIGINT")
    got = {r["id"]: r["match_id"] for r in asof.asof_first_come(left, right, "e", "t", "id", "t", "id", tolerance=0.02).collect()}
    assert got == {1: 7}


def test_geometry(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5, -1.0, -2.9)], "x DOUBLE, y DOUBLE, h DOUBLE, x2 DOUBLE, y2 DOUBLE, h2 DOUBLE")
    a, b = geom.se2(F.col("x"), F.col("y"), F.col("h")), geom.se2(F.col("x2"), F.col("y2"), F.col("h2"))
    back = geom.se2_compose(a, geom.se2_between(a, b))
    r = df.select(back.alias("p"), geom.se2_compose(a, geom.se2_inverse(a)).alias("i"), geom.wrap_angle(F.lit(math.pi)).alias("w")).first()
    assert (r["p"]["x"], r["p"]["y"]) == (pytest.approx(0.5), pytest.approx(-1.0)) and math.isclose(math.cos(r["p"]["theta"]), math.cos(-2.9))
    assert abs(r["i"]["x"]) < 1e-12 and abs(r["i"]["theta"]) < 1e-12 and r["w"] == -math.pi
    q = [F.lit(v) for v in (0.0, 0.0, math.sin(0.3), math.cos(0.3))]
    m = geom.quaternion_to_matrix(*q)
    r = df.select(geom.rotation_angle_deg(m).alias("a"), geom.matrix_yaw(m).alias("y"), geom.quaternion_to_matrix(*[F.lit(0.0)] * 4).alias("z"), geom.rotation_between_angle_deg(m, m).alias("s")).first()
    assert r["a"] == pytest.approx(math.degrees(0.6)) and r["y"] == pytest.approx(0.6) and r["z"] is None and r["s"] == pytest.approx(0, abs=1e-5)
    t = geom.se3(m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    r = df.select(geom.se3_compose(t, geom.se3_inverse(t)).alias("i")).first()["i"]
    assert np.allclose(r["r"], np.eye(3).ravel()) and np.allclose(r["t"], 0)
    r = df.select(geom.s1_dist_deg(F.lit(350.0), F.lit(10.0)).alias("d"), geom.huber_weight(F.lit(6.0), 3.0).alias("h"), geom.pair_key(F.lit(7), F.lit(2)).alias("k"), geom.edge_information(F.lit("covisibility"), F.lit(900)).alias("e"), geom.hamming(F.array(F.lit(5)), F.array(F.lit(3)), 1).alias("x")).first()
    assert (r["d"], r["h"], r["k"], r["e"], r["x"]) == (20.0, 0.5, "2-7", 5.0, 2)


def test_alignment_recovers_a_transform(spark):
    rng = np.random.default_rng(2)
    s = rng.standard_normal((50, 3))
    c, n = math.cos(0.4), math.sin(0.4)
    r = np.array([[c, -n, 0], [n, c, 0], [0, 0, 1.0]])
    t = 2.0 * s @ r.T + [1, -2, 3]
    rows = [("a", *map(float, x), *map(float, y)) for x, y in zip(s, t)] + [("few", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE, z DOUBLE, u DOUBLE, v DOUBLE, w DOUBLE")
    out = trajectory.align(df, ["g"], ["x", "y", "z"], ["u", "v", "w"], with_scale=True)
    assert out.agg(F.max("error")).first()[0] < 1e-9 and out.count() == 50
    assert trajectory.align(df, ["g"], ["x", "y", "z"], ["u", "v", "w"]).agg(F.max("error")).first()[0] > 0.1


def test_relative_errors_of_equal_motion_are_zero(spark):
    rows = [("a", i, float(i), i * 1.0, 0.5 * i, 0.1 * i, 0.0, 0.0, math.sin(i / 20), math.cos(i / 20)) for i in range(6)]
    df = spark.createDataFrame([(*r, *r[3:]) for r in rows], "s STRING, id INT, ts DOUBLE, " + ", ".join(f"{p}_{c} DOUBLE" for p in "eg" for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")))
    e = trajectory.relative_errors_3d(df, "s", ["ts"]).collect()
    assert len(e) == 5 and all(r["trans_error"] < 1e-12 and r["rot_error_deg"] < 1e-6 for r in e)


def test_stage_classes(spark):
    rows = [
        (True, False, "guided final matches below", None, 0, 0, "FAILED_REFINED_GEOMETRY"), (True, False, "Final support too low", "consistency", 0, 0, "FAILED_FINAL_SUPPORT"), (True, False, None, "consistency", 0, 0, "FAILED_CONSISTENCY"),
        (True, False, None, "geometry", 5, 12, "FAILED_FINAL_SUPPORT"), (True, False, None, "geometry", 5, 0, "FAILED_SEED_GEOMETRY"), (True, False, None, "geometry", None, None, "FAILED_GEOMETRY_MATCHES"), (True, True, "seed inliers", None, 0, 0, "ACCEPTED"),
        (True, False, None, None, 0, 0, "UNKNOWN_STAGE"), (False, False, None, None, 0, 0, "NOT_RETRIEVED"),
    ]
    df = spark.createDataFrame(rows, "present BOOLEAN, accepted BOOLEAN, reason STRING, stage STRING, seed INT, final INT, want STRING")
    none = F.lit(None).cast("int")
    got = df.select("want", loops.rejection_class(F.col("present"), F.col("accepted"), F.col("reason"), F.col("stage"), seed=F.col("seed"), refined=none, guided=none, final=F.col("final"), retrieved=F.lit(False), chosen=F.lit(False)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_dominant_stage_ties(spark):
    df = spark.createDataFrame([("B",), ("A",), ("ACCEPTED",), ("ACCEPTED",)], "stage STRING")
    assert loops.dominant_stage(df, "stage").first()["stage"] == "A"
    assert loops.dominant_stage(df, "stage", tie="last").first()["stage"] == "B"
    assert loops.dominant_stage(df.where("stage = 'ACCEPTED'"), "stage", nothing="ACCEPTED").first()["stage"] == "ACCEPTED"


def test_funnel_may_rise(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, True), (False, True)], "a BOOLEAN, b BOOLEAN")
    got = [(r["n"], r["drop"]) for r in loops.funnel(df, [("a", F.col("a")), ("b", F.col("b"))]).orderBy("stage_no").collect()]
    assert got == [(2, None), (3, -1)]


def test_occupancy_fold_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), int(b), int(g), 0, bool(h), "a") for s, b, g, h in zip(rng.integers(0, 3000, 4000), range(4000), rng.integers(0, 3, 4000), rng.random(4000) < 0.4)]
    df = spark.createDataFrame(rows, "scan_id BIGINT, beam INT, gx BIGINT, gy INT, hit BOOLEAN, m STRING")
    got = {r["gx"]: r["l"] for r in maps.occupancy_fold(df, ["m"], "scan_id", "beam").collect()}
    for g in range(3):
        v = 0.0
        for r in sorted(x for x in rows if x[2] == g):
            v = max(-5.0, min(5.0, v + (0.85 if r[4] else -0.4)))
        assert got[g] == pytest.approx(v)


def test_bresenham_has_no_gaps(spark):
    ends = [(0, 0, 7, 3), (0, 0, -4, 9), (2, 2, 2, 2), (5, -1, -6, -6)]
    df = spark.createDataFrame(ends, "a BIGINT, b BIGINT, c BIGINT, d BIGINT")
    for r in df.select("*", maps.bresenham(*[F.col(x) for x in "abcd"]).alias("w")).collect():
        cells = [(c["gx"], c["gy"]) for c in r["w"]]
        assert cells[0] == (r["a"], r["b"]) and cells[-1] == (r["c"], r["d"])
        assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(cells, cells[1:]))
        assert [c["last"] for c in r["w"]] == [False] * (len(cells) - 1) + [True]


def test_adaptive_voxel(spark):
    rng = np.random.default_rng(1)
    pts = rng.random((400, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in pts] + [("b", 0.0, 0.0)], "g STRING, x DOUBLE, y DOUBLE")
    got = {r["g"]: r["size"] for r in maps.adaptive_voxel_size(df, "g", ["x", "y"], 1.0, 50).collect()}
    lo, hi, best = 0.0, 1.0, 0.0
    for mid in [1.0]:
        assert len({tuple(v) for v in np.floor(pts / mid)}) < 50
    for _ in range(8):
        mid = (lo + hi) / 2
        if len({tuple(v) for v in np.floor(pts / mid)}) >= 50:
            lo = best = mid
        else:
            hi = mid
    assert got == {"a": best, "b": 0.0}


def test_radius_nearest_brute(spark):
    rng = np.random.default_rng(6)
    p = rng.random((150, 2)) * 4
    df = spark.createDataFrame([("a", i, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "g STRING, id BIGINT, ord BIGINT, x DOUBLE, y DOUBLE")
    got = {(r["query_id"], r["place"]): r["point_id"] for r in maps.radius_nearest(df, df, "g", 0.6, 3, 10).collect()}
    for i in range(150):
        near = sorted((math.dist(p[i], p[j]), j) for j in range(150) if j < i - 10 and math.dist(p[i], p[j]) <= 0.6)[:3]
        assert [got.get((i, k + 1)) for k in range(3)] == [n[1] for n in near] + [None] * (3 - len(near))


def test_graph(spark):
    obs = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (2, 11), (3, 11), (None, 11), (4, None)], "k BIGINT, p BIGINT")
    got = {(r["a"], r["b"]): r["shared"] for r in graph.shared_items(obs, "k", "p").collect()}
    assert got == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
    e = spark.createDataFrame([(3, 1, 1), (3, 2, 1), (2, 1, 2)], "a BIGINT, b BIGINT, w BIGINT")
    assert {(r["kf_id"], r["parent"]) for r in graph.parents(e).collect()} == {(3, 1), (2, 1)}
    assert {(r["a"], r["b"]) for r in graph.connections(e, 2).collect()} == {(2, 1), (3, 1)}
    u = graph.edge_union(("loop", e), ("spanning_tree", e))
    assert {r["kind"] for r in graph.essential_edges(u).collect()} == {"loop"}


def test_rotation_histogram_and_medoid(spark):
    m = spark.createDataFrame([("a", i, 29.0) for i in range(20)] + [("a", 90, 200.0), ("a", 91, 359.0)], "g STRING, id BIGINT, angle DOUBLE")
    assert {r["id"] for r in descriptors.rotation_histogram(m, "g", "angle").collect()} == set(range(20))
    d = spark.createDataFrame([("p", 1, [0]), ("p", 2, [1]), ("p", 3, [255])], "p STRING, id BIGINT, des ARRAY<BIGINT>")
    assert descriptors.medoid(d, "p", 1).first()["id"] == 1


def test_pose_graph_closes_a_loop():
    n = 40
    true = np.array([[math.cos(2 * math.pi * k / n) * 5, math.sin(2 * math.pi * k / n) * 5, solvers.wrap(np.array(2 * math.pi * k / n + math.pi / 2))] for k in range(n)], float)
    i = np.arange(n - 1)
    z = solvers.relative(true[i], true[i + 1]) + [0.02, 0.0, 0.004]
    drift = [true[0]]
    for step in z:
        c, s = math.cos(drift[-1][2]), math.sin(drift[-1][2])
        drift.append(np.array([drift[-1][0] + c * step[0] - s * step[1], drift[-1][1] + s * step[0] + c * step[1], drift[-1][2] + step[2]]))
    drift = np.array(drift)
    loops_i, loops_j = np.array([0, 5, 0, 0, 0, 0]), np.array([n - 1, n - 3, 20, 20, 20, 20])
    m = len(loops_i)
    w = np.concatenate([np.tile([500.0, 500.0, 1600.0], (n - 1, 1)), np.tile([11000.0, 11000.0, 100000.0], (m, 1))])

    def worst(false, robust):
        zl = solvers.relative(true[loops_i], true[loops_j])
        zl[-1] += [false, false, 0.0]  # the last one is false, the three before it are not
        out = solvers.optimise_pose_graph(drift, np.concatenate([i, loops_i]), np.concatenate([i + 1, loops_j]), np.concatenate([z, zl]), w, np.concatenate([np.zeros(n - 1, bool), np.full(m, robust)]))
        assert np.allclose(out[0], drift[0])
        return np.abs(out[:, :2] - true[:, :2]).max()

    assert worst(0.0, True) < 0.3 * np.abs(drift[:, :2] - true[:, :2]).max()
    assert worst(3.0, True) < 0.5 * worst(3.0, False)


def test_robust_alignment_ignores_outliers():
    rng = np.random.default_rng(1)
    s = rng.standard_normal((30, 3))
    r, t = solvers.kabsch(s, s @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + [1, 2, 3])
    target = s @ r.T + t
    target[:8] += 5 * rng.standard_normal((8, 3))
    s[29] = np.nan
    r2, t2, inside = solvers.robust_alignment(s, target)
    assert np.allclose(r2, r) and np.allclose(t2, [1, 2, 3]) and inside.sum() == 21
    assert solvers.robust_alignment(s[:2], target[:2])[2].sum() == 0


def world(n=80):
    grid = np.zeros((n, n))
    grid[10, 10:60], grid[10:50, 60], grid[30, 20:40] = 1.0, 1.0, 1.0
    soft = grid.copy()
    for _ in range(2):
        p = np.pad(soft, 1)
        soft = np.maximum(soft, 0.6 * np.max([p[1 + a : n + 1 + a, 1 + b : n + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0))
    y, x = np.nonzero(grid)
    return soft, np.stack([(x + 0.5) * 0.1, (y + 0.5) * 0.1], axis=1)


def test_branch_and_bound_equals_full_search(spark):
    grid, pts = world()
    pose = np.array([0.3, -0.2, 0.0])
    got, score = solvers.branch_and_bound(grid, (0.0, 0.0), 0.1, pts, pose, reach=0.5, turn=0.1, turn_step=0.05)
    def value(p):
        c, s = math.cos(p[2]), math.sin(p[2])
        gx, gy = np.floor((p[0] + c * pts[:, 0] - s * pts[:, 1]) / 0.1 + 1e-9).astype(int), np.floor((p[1] + s * pts[:, 0] + c * pts[:, 1]) / 0.1 + 1e-9).astype(int)
        ok = (gx >= 0) & (gy >= 0) & (gx < 80) & (gy < 80)
        return np.where(ok, grid[np.where(ok, gy, 0), np.where(ok, gx, 0)], 0).mean()
    best = max(value(pose + [x * 0.1, y * 0.1, a * 0.05]) for x in range(-5, 6) for y in range(-5, 6) for a in (-2, -1, 0, 1, 2))
    assert score == pytest.approx(best) and abs(got[0]) < 0.11 and abs(got[1]) < 0.11
    fine, mean = solvers.refine_pose(grid, (0.05, 0.05), 0.1, pts, np.array([0.06, -0.05, 0.01]))
    assert np.abs(fine).max() < 0.06 and mean > 0.8


def test_relational_matching(spark):
    grid, pts = world()
    cells = spark.createDataFrame([("m", int(x), int(y), float(grid[y, x])) for y, x in zip(*np.nonzero(grid))], "map STRING, gx BIGINT, gy BIGINT, p DOUBLE")
    points = spark.createDataFrame([(1, "m", float(x - 0.3), float(y + 0.2)) for x, y in pts], "scan BIGINT, map STRING, x DOUBLE, y DOUBLE")
    best = solvers.best_offsets(solvers.score_offsets(points, cells, 0.1, reach=0.4, step=0.1, turn=0.05, turn_step=0.05)).first()
    assert (round(best["dx"], 6), round(best["dy"], 6), best["dtheta"]) == (0.3, -0.2, 0.0)
