import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylattice.operators import graph, maps, matching, trajectory

POSE = "STRUCT<x: DOUBLE, y: DOUBLE, theta: DOUBLE>"


def test_extrapolation_against_a_loop(spark):
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(120):
        t += r.choice([0.125, 0.25, 0.75, 1.0])
        pose = (r.random() * 3, r.random(), r.uniform(-3, 3))
        odom = None if i % 7 == 3 else (r.random() * 3, r.random(), r.uniform(-3, 3))
        rows.append(("a", t, i, pose, odom, None if i % 5 == 0 else r.uniform(-2, 2)))
    rows.append(("b", 1.0, 500, (1.0, 2.0, 0.5), None, None))
    df = spark.createDataFrame(rows, f"e STRING, t DOUBLE, id INT, pose {POSE}, odom {POSE}, yaw DOUBLE")
    got = {x["id"]: x["predicted"] for x in trajectory.extrapolate(df, "e", ["t", "id"], blend=0.25, yaw="yaw", alpha=0.2, most_speed=2.0, most_turn=1.5).collect()}
    wrap = lambda a: (a + math.pi) % (2 * math.pi) - math.pi

    def speed(queue):
        (t0, p0), (t1, p1) = queue[0], queue[-1]
        return None if t1 <= t0 else ((p1[0] - p0[0]) / (t1 - t0), (p1[1] - p0[1]) / (t1 - t0), wrap(p1[2] - p0[2]) / (t1 - t0))

    mine = [x for x in rows if x[0] == "a"]
    first = next(x for x in mine if x[5] is not None)
    offset = first[3][2] - first[5]
    assert got[0] is None and got[500] is None
    for i in range(1, 120):
        before = mine[:i]
        _, t0, _, p0, _, _ = before[-1]
        recent = [x for x in before if t0 - x[1] <= 1.5]
        own, odo = speed([(x[1], x[3]) for x in recent]) or (0, 0, 0), None
        known = [(x[1], x[4]) for x in recent if x[4] is not None]
        if known:
            odo = speed(known)
        v = [o if odo is None else 0.75 * o + 0.25 * q for o, q in zip(own, odo or own)]
        v = [max(-m, min(m, x)) for x, m in zip(v, (2.0, 2.0, 1.5))]
        dt = min(max(mine[i][1] - t0, 0), 0.5)
        h = wrap(p0[2] + v[2] * dt)
        if mine[i][5] is not None:
            h = wrap(h + 0.2 * wrap(wrap(mine[i][5] + offset) - h))
        assert got[i]["x"] == pytest.approx(p0[0] + v[0] * dt, abs=1e-9) and got[i]["y"] == pytest.approx(p0[1] + v[1] * dt, abs=1e-9)
        assert abs(wrap(got[i]["theta"] - h)) < 1e-9


def test_walk_to_kept(spark):
    se2 = lambda x, y, h: (float(x), float(y), float(h))
    frames = spark.createDataFrame([("f", 3, se2(1, 0, 0)), ("g", 1, se2(0, 0, 0.5)), ("h", 9, se2(0, 0, 0))], f"frame STRING, kf BIGINT, rel {POSE}")
    parents = spark.createDataFrame([(3, 2, se2(1, 0, math.pi / 2)), (2, 1, se2(2, 0, 0)), (9, 8, se2(0, 0, 0))], f"kf BIGINT, parent BIGINT, rel {POSE}")
    culled = spark.createDataFrame([(3,), (2,), (9,), (8,)], "kf BIGINT")
    got = {r["frame"]: r for r in trajectory.walk_to_kept(frames, parents, culled).collect()}
    assert set(got) == {"f", "g"} and (got["f"]["kf"], got["f"]["hops"], got["g"]["hops"]) == (1, 2, 0)
    assert (got["f"]["rel"]["x"], got["f"]["rel"]["y"]) == pytest.approx((3.0, 1.0))
    assert {r["frame"] for r in trajectory.walk_to_kept(frames, parents, culled, hops=1).collect()} == {"g"}


def test_relation_closures(spark):
    poses = spark.createDataFrame([("a", float(i), i) for i in range(20)], "e STRING, ts DOUBLE, index BIGINT")
    rel = spark.createDataFrame([("a", 1, 2.0, 12.0, 1.0, 2.0, 0.5), ("a", 2, 12.0, 2.0, 1.0, 2.0, 0.5), ("a", 3, 2.0, 4.0, 1.0, 0.0, 0.0), ("a", 4, -1.0, 12.0, 1.0, 0.0, 0.0), ("a", 5, 2.0, 12.4, 1.0, 0.0, 0.0), ("b", 6, 2.0, 12.0, 1.0, 0.0, 0.0)], "e STRING, rel_id BIGINT, t_i DOUBLE, t_j DOUBLE, dx DOUBLE, dy DOUBLE, dtheta DOUBLE")
    got = {r["rel_id"]: r for r in trajectory.relation_closures(rel, poses, "e", max_dt=0.1, least_gap=5).collect()}
    assert set(got) == {1, 2} and all((r["i"], r["j"]) == (2, 12) for r in got.values())
    assert (got[2]["dx"], got[2]["dtheta"]) == pytest.approx((-math.cos(0.5) - 2 * math.sin(0.5), -0.5))
    o = trajectory.relation_overlap(rel, poses, "e", "ts").collect()
    assert {r["e"]: (r["relations"], r["overlapping"]) for r in o} == {"a": (5, 4), "b": (1, 0)}


def test_ring_and_erased(spark):
    e = graph.undirected(spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 3), (2, 2, 9), (4, 1, None)], "a BIGINT, b BIGINT, w INT"))
    assert e.count() == 6
    rings = {r["kf"]: r["ring"] for r in graph.second_ring(e, spark.createDataFrame([(1, 1)], "frame BIGINT, kf BIGINT"), 5).collect()}
    assert rings == {1: 0, 2: 1, 3: 2}
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 5)], "kf_id BIGINT, parent BIGINT")
    got = {r["kf_id"]: r["parent"] for r in graph.erase_keyframes(tree, spark.createDataFrame([(2,), (3,), (5,)], "kf_id BIGINT")).collect()}
    assert got == {4: 1, 6: None}


def test_match_scans_finds_a_shift(spark):
    """A room's walls as a map; scans taken at shifted poses come back to them."""
    res = 0.1
    wall = [(i, j) for i in range(60) for j in range(40) if i in (0, 59) or j in (0, 39) or (i == 20 and j < 15)]
    cells = spark.createDataFrame([("s", i, j, 4.0) for i, j in wall], "m STRING, gx BIGINT, gy BIGINT, l DOUBLE")
    true = (3.0, 2.0, 0.1)
    c, s = math.cos(true[2]), math.sin(true[2])
    pts = [(i * res + res / 2 - true[0], j * res + res / 2 - true[1]) for i, j in wall[::3]]
    rows = [(k, "s", c * x + s * y, -s * x + c * y, (true[0] + d, true[1] - d / 2, true[2] + 0.02)) for k, d in ((1, 0.0), (2, 0.12), (3, -0.15)) for x, y in pts]
    df = spark.createDataFrame([*rows, (9, "none", 1.0, 1.0, (0.0, 0.0, 0.0)), (10, "s", 1.0, 1.0, None)], f"scan_id BIGINT, m STRING, x DOUBLE, y DOUBLE, odom {POSE}")
    for method, near in (("search", 0.11), ("refine", 0.11)):
        got = {r["scan_id"]: r for r in matching.match_scans(df, cells, ["m"], res, method=method, reach=0.4).collect()}
        assert set(got) == {1, 2, 3, 9} and got[9]["score"] == 0.5
        for k in (1, 2, 3):
            assert abs(got[k]["x"] - true[0]) < near and abs(got[k]["y"] - true[1]) < near and got[k]["score"] > 0.75, (method, got[k])
    with pytest.raises(ValueError):
        matching.match_scans(df, cells, ["m"], res, method="other")


def test_cell_scores_brute(spark):
    r = random.Random(2)
    occ = [("m", i, j, r.uniform(-3, 3)) for i in range(-4, 5) for j in range(-4, 5) if r.random() < 0.8]
    pts = [(1, "m", r.uniform(-2, 2), r.uniform(-2, 2), (0.1, -0.2, 0.0)) for _ in range(60)]
    got = {(x["turn"], x["di"], x["dj"]): (x["n"], x["score"]) for x in matching.cell_scores(spark.createDataFrame(pts, f"scan_id BIGINT, m STRING, x DOUBLE, y DOUBLE, odom {POSE}"), spark.createDataFrame(occ, "m STRING, gx BIGINT, gy BIGINT, l DOUBLE"), ["m"], 0.5, turns=1, turn=0.1, shifts=1, least=5).collect()}
    prob = {(i, j): 1 / (1 + math.exp(-l)) for _, i, j, l in occ}
    for k in (-1, 0, 1):
        c, s = math.cos(0.1 * k), math.sin(0.1 * k)
        at = [(math.floor(round((0.1 + c * (x - 0.1) - s * (y + 0.2)) / 0.5, 6)), math.floor(round((-0.2 + s * (x - 0.1) + c * (y + 0.2)) / 0.5, 6))) for _, _, x, y, _ in pts]
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                hit = [prob[i + di, j + dj] for i, j in at if (i + di, j + dj) in prob]
                assert got[k, di, dj][0] == len(hit) and got[k, di, dj][1] == pytest.approx(np.mean(hit))


def test_depths_and_crops(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0, None, float("nan"), 3.0]), (5, [1.0]), (8, [])], "row BIGINT, px ARRAY<DOUBLE>")
    look = {(r["row"], r["u"]): r["z"] for r in df.select("row", F.explode(F.array(*[F.lit(x) for x in (-0.6, 0.5, 1.5, 2.0, 3.0, 4.4, 9.0)])).alias("u"), "px").select("row", "u", maps.depth_lookup(F.col("px"), F.col("u"), 2.0, 1.2).alias("z")).collect()}
    assert (look[4, 0.5], look[4, 1.5], look[4, 3.0], look[4, 4.4], look[4, -0.6], look[5, 0.5], look[8, 2.0]) == (0.5, None, None, None, None, 0.5, None)
    cloud = maps.depth_points(df, "px", "row", ["row"], (1.0, 1.0, 0.0, 0.0), stride=4, least=0.5, most=3.0).collect()
    assert [(r["row"], r["u"]) for r in cloud] == [(4, 0)]  # 3.0 is not strictly below the greatest depth
    assert maps.crop(df.select(F.col("row").alias("x")), {"x": (4, 8)}).count() == 1


def test_surface(spark):
    pts = [("s", 2.05, 0.001 * i, (0.0, 0.0, 0.0)) for i in range(5)] + [("s", 0.0, -3.0, (0.0, 0.0, 0.0)), ("s", 1.0, 1.0, None)]
    field = maps.fuse_signed_distance(spark.createDataFrame(pts, f"m STRING, x DOUBLE, y DOUBLE, odom {POSE}"), ["m"], 0.1, 0.3)
    at = {(r["gx"], r["gy"]): (r["sdf"], r["weight"]) for r in field.collect()}
    assert at[20, 0][0] == pytest.approx(0) and at[20, 0][1] == 5 and at[17, 0][0] == pytest.approx(1) and at[23, 0][0] == pytest.approx(-1)
    assert {(r["gx"], r["gy"]) for r in maps.clean_surface(field, ["m"], 0.5, 3).collect()} == {(19, 0), (20, 0), (21, 0)}


def test_counted_rays_are_those_walked(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), i, r.uniform(-9, 9), r.uniform(-9, 9), (r.uniform(-2, 2), r.uniform(-2, 2), 0.0)) for i in range(300)] + [("a", 900, 1e4, -3e3, (0.0, 0.0, 0.0)), ("a", 901, 0.0, 0.0, (0.0, 0.0, 0.0)), ("a", 902, 1.0, 1.0, None), ("b", 903, None, 1.0, (0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, f"sensor_id STRING, scan_id BIGINT, x DOUBLE, y DOUBLE, odom {POSE}").withColumn("beam", F.lit(0))
    key = lambda x: (x["sensor_id"], x["gx"], x["gy"], x["free"], x["hits"])
    walked = {key(x) for x in maps.occupancy_counts(maps.ray_cells(df.where("odom IS NOT NULL AND x IS NOT NULL"), 0.5), ["sensor_id"]).collect()}
    assert {key(x) for x in maps.occupancy_counts(maps.count_rays(df, 0.5, "sensor_id"), ["sensor_id"]).collect()} == walked
    x0, y0, x1, y1 = (np.array(v) for v in ([0, 5, 0], [0, 5, 0], [3, 5, -2], [1, 5, 7]))
    dense, sparse = (maps._count_lines(np.array(g), x0, y0, x1, y1) for g in ([0, 0, 1], [0, 0, 10**6]))
    assert [v.tolist() for v in dense[1:]] == [v.tolist() for v in sparse[1:]]
    assert maps.count_rays(df.limit(0), 0.5, "sensor_id").count() == 0


def test_dense_chunks_are_cut(spark, monkeypatch):
    """A third of a table in half a second, many rows at one time: the answers stay those of a search of every row."""
    from waylattice.operators import asof

    r = random.Random(12)
    right = [(r.choice("ab"), r.randrange(0, 4000) / 8, i) for i in range(500)] + [("a", 100 + i / 1024, 1000 + i) for i in range(400)]
    left = [(r.choice("abc"), r.randrange(0, 8000) / 16, i) for i in range(300)] + [("a", 100.25, 1000 + i) for i in range(150)] + [("a", 100 + r.randrange(500) / 1000, 2000 + i) for i in range(200)] + [(None, 1.0, 9000), ("a", None, 9001)]
    lf, rf = spark.createDataFrame(left, "e STRING, t DOUBLE, l BIGINT"), spark.createDataFrame(right, "e STRING, ts DOUBLE, id BIGINT")
    want = {}
    for e, t, l in left:
        mine = [] if e is None or t is None else [(ts, i) for q, ts, i in right if q == e]
        before, after = [x for x in mine if x[0] <= t], [x for x in mine if x[0] >= t]
        one = lambda xs, top: (lambda ts: (ts, min(i for x, i in xs if x == ts)))(top(x for x, _ in xs)) if xs else None
        want[l] = one(before, max), one(after, min)
    for rows in (10**6, 64, 7):
        monkeypatch.setattr(asof, "HOT_ROWS", rows)
        got = {x["l"]: (x["prev"] and tuple(x["prev"]), x["next"] and tuple(x["next"])) for x in asof.neighbours(lf, rf, "e", "t", "ts", "id", 32.0).collect()}
        assert got == want, rows
