import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylattice.operators import keyframes, projection

random.seed(4)


def bits(a, b):
    return bin(a ^ b).count("1")


def test_search_by_projection_brute(spark):
    kp = [("f", i, random.uniform(0, 100), random.uniform(0, 60), random.randrange(4), random.getrandbits(16)) for i in range(150)]
    pts = [("f", i, random.uniform(0, 100), random.uniform(0, 60), random.randrange(4), random.getrandbits(16), random.choice([0.7, 1.0, 2.0])) for i in range(60)]
    k = spark.createDataFrame([(*r[:5], [r[5]]) for r in kp], "f STRING, idx BIGINT, u DOUBLE, v DOUBLE, octave INT, des ARRAY<BIGINT>")
    p = spark.createDataFrame([(*r[:5], [r[5]], r[6]) for r in pts], "f STRING, point BIGINT, u DOUBLE, v DOUBLE, level INT, des ARRAY<BIGINT>, scale DOUBLE")
    got = {(r["point"], r["idx"]) for r in projection.search_by_projection(p, k, "f", 8.0, 1, most=9, ratio=0.9).collect()}
    best = []
    for _, point, u, v, level, des, scale in pts:
        near = sorted((bits(des, d), i, o) for _, i, ku, kv, o, d in kp if math.hypot(ku - u, kv - v) <= 8.0 * scale and -1 <= o - level <= 0)
        if near and near[0][0] <= 9 and (len(near) == 1 or near[1][2] != near[0][2] or near[0][0] <= 0.9 * near[1][0]):
            best.append((near[0][0], point, near[0][1]))
    want = {}
    for d, point, i in sorted(best):
        want.setdefault(i, point)
    assert got == {(point, i) for i, point in want.items()}


def test_bucketed_and_mutual(spark):
    rows = lambda seed: [(random.Random(seed * 100 + i).randrange(4), i, random.Random(seed * 999 + i).getrandbits(12)) for i in range(40)]
    a, b = rows(1), rows(2)
    df = lambda r: spark.createDataFrame([(n, i, [d]) for n, i, d in r], "node INT, id BIGINT, des ARRAY<BIGINT>")
    got = {(r["id1"], r["id2"]) for r in projection.bucketed_matches(df(a), df(b), 1, most=4, ratio=0.9).collect()}
    best = []
    for n, i, d in a:
        near = sorted((bits(d, e), j) for m, j, e in b if m == n)
        if near and near[0][0] <= 4 and (len(near) == 1 or near[0][0] < 0.9 * near[1][0]):
            best.append((near[0][0], i, near[0][1]))
    want = {}
    for _, i, j in sorted(best):
        want.setdefault(j, i)
    assert got == {(i, j) for j, i in want.items()}
    fwd, back = spark.createDataFrame([(1, 2), (3, 4)], "a INT, b INT"), spark.createDataFrame([(2, 1), (4, 9)], "b INT, a INT")
    assert [tuple(r) for r in projection.mutual(fwd, back).collect()] == [(1, 2)]


def test_epipolar(spark):
    f = [0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]  # lines of equal v
    a = spark.createDataFrame([(1, 1, 5.0, 10.0, [0])], "node INT, id BIGINT, u DOUBLE, v DOUBLE, des ARRAY<BIGINT>")
    b = spark.createDataFrame([(1, 7, 50.0, 10.5, 1.0, [3]), (1, 8, 50.0, 30.0, 1.0, [0]), (2, 9, 50.0, 10.0, 1.0, [0])], "node INT, id BIGINT, u DOUBLE, v DOUBLE, sigma2 DOUBLE, des ARRAY<BIGINT>")
    assert [(r["id1"], r["id2"], r["distance"]) for r in projection.epipolar_candidates(a, b, f, 1, most=10).collect()] == [(1, 7, 2)]


def test_fuse_and_replace(spark):
    m = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 12, 7)], "kf INT, point INT, idx INT")
    o = spark.createDataFrame([(1, 5, 20), (1, 6, 21), (1, 7, 12)], "kf INT, idx INT, point INT")
    n = spark.createDataFrame([(10, 2), (20, 5), (11, 3), (21, 3)], "point INT, n BIGINT")
    merged = projection.fuse_points(m, o, n)
    assert {tuple(r) for r in merged.collect()} == {(20, 10), (11, 21)}
    obs = spark.createDataFrame([(10, 1, 9), (20, 1, 5), (21, 2, 1)], "point INT, kf INT, idx INT")
    assert {tuple(r) for r in keyframes.replace_points(obs, merged).collect()} == {(20, 1, 5), (11, 2, 1)}


def test_triangulate_and_depth():
    t1, t2 = np.eye(4), np.eye(4)
    t2[0, 3] = -0.5
    p = np.array([[0.2, -0.1, 3.0], [1.0, 0.5, 5.0]])
    q = p - [0.5, 0, 0]
    assert np.allclose(projection.triangulate(t1, t2, p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]), p)
    d = np.array([[0, 1000], [2000, 9000]])
    assert projection.backproject_depth(d, 1, 1, 0, 0, 1000.0, 1, 4.0).tolist() == [[1.0, 0.0, 1.0], [0.0, 2.0, 2.0]]


def test_redundant_keyframes_brute(spark):
    obs = [(p, k, random.randrange(4)) for p in range(60) for k in random.sample(range(8), random.randrange(1, 8))]
    kf = [(k, k * 1.0, None if k == 1 else k - 0.05 if k == 2 else k - 1.0) for k in range(8)]
    got = {r["kf"] for r in keyframes.redundant_keyframes(spark.createDataFrame(obs, "point INT, kf INT, octave INT"), spark.createDataFrame(kf, "kf INT, ts DOUBLE, parent_ts DOUBLE")).collect()}
    want = set()
    for k, ts, parent in kf:
        mine = [(p, o) for p, q, o in obs if q == k]
        red = sum(sum(1 for p2, k2, o2 in obs if p2 == p and k2 != k and o2 <= o + 1) >= 3 for p, o in mine)
        if k != 0 and red > 0.6 * max(len(mine), 1) and not (parent is not None and abs(ts - parent) < 0.1):
            want.add(k)
    assert got == want


def test_points_and_verdicts(spark):
    df = spark.createDataFrame([(100, 10, 0, 9), (100, 90, 2, 3), (100, 90, 3, 9), (100, 90, 1, 1), (0, 0, 1, 9)], "visible INT, found INT, age INT, observations INT")
    assert [r["verdict"] for r in keyframes.cull_points(df).collect()] == ["bad", "bad", "settled", "recent", "recent"]
    v = spark.createDataFrame([(False, 0.9, 0.0, 0.0), (True, 0.5, 0.0, 0.0), (True, 0.9, 2.0, 0.0), (True, 0.9, 0.1, 0.1), (True, None, 0.1, 0.1)], "ok BOOLEAN, s DOUBLE, m DOUBLE, r DOUBLE")
    assert [r[0] for r in v.select(keyframes.loop_verdict(F.col("ok"), F.col("s"), F.col("m"), F.col("r"))).collect()] == ["match_failed", "rejected_score", "rejected_residual", "accepted", "rejected_score"]
    k = spark.createDataFrame([("f", i, d, i % 2 == 0, False) for i, d in enumerate([0.0, 0.5, 1.5, 3.0, 9.0])], "f STRING, idx INT, depth DOUBLE, has_point BOOLEAN, outlier BOOLEAN")
    assert keyframes.close_counts(k, "f", 4.0).first()[1:] == (1, 2)
    assert {r["idx"] for r in keyframes.new_depth_points(k, "f", 1.0, 3).collect()} == {1, 2, 3}
    assert {r["idx"] for r in keyframes.new_depth_points(k, "f", 1.0, 3, k.where("idx = 2")).collect()} == {1, 3}
    bar = keyframes.reference_score(spark.createDataFrame([(1, 2, 0.4), (1, 3, 0.2)], "kf INT, other INT, score DOUBLE"), spark.createDataFrame([(1, 2), (1, 3), (5, 6)], "a INT, b INT"))
    assert {r["kf"]: r["bar"] for r in bar.collect()} == {1: pytest.approx(0.03), 5: pytest.approx(-1.7976931348623157e308)}


def test_loop_targets(spark):
    nodes = spark.createDataFrame([(100, 0.0, 0.0), (101, 50.0, 0.0)], "node INT, x DOUBLE, y DOUBLE")
    subs = spark.createDataFrame([(0, 1.0, 0.0, 30, True), (1, 2.0, 0.0, 30, True), (2, 3.0, 0.0, 5, True), (3, 0.5, 0.0, 30, False), (4, -1.5, 0.0, 30, True), (5, 0.1, 0.0, 30, True)], "submap INT, x DOUBLE, y DOUBLE, scans INT, finished BOOLEAN")
    own = spark.createDataFrame([(100, 4)], "node INT, submap INT")
    got = [(r["node"], r["submap"]) for r in keyframes.targets_of_nodes(nodes, subs, own, radius=6.0).orderBy("place").collect()]
    assert got == [(100, 0), (100, 1)]
    old = spark.createDataFrame([(n, n * 0.1, 0.0) for n in range(40)], "node INT, x DOUBLE, y DOUBLE")
    members = spark.createDataFrame([(n, 7) for n in range(30, 40)], "node INT, submap INT")
    got = [r["node"] for r in keyframes.nodes_of_targets(spark.createDataFrame([(7, 0.0, 0.0)], "submap INT, x DOUBLE, y DOUBLE"), old, members, radius=1.05, separation=22, stride=3, cap=3).orderBy("distance").collect()]
    assert got == [0, 3, 6]


def test_viewing(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "point INT, x DOUBLE, y DOUBLE, z DOUBLE")
    obs = spark.createDataFrame([(1, 1), (1, 2)], "point INT, kf INT")
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0)], "kf INT, cx DOUBLE, cy DOUBLE, cz DOUBLE")
    assert tuple(keyframes.viewing(pts, obs, c).first()) == (1, 0.0, 0.0, 1.0, 1.0, 2.0)
