"""Loop targets whose pairs are thinned out inside tasks, against brute force and against the way by cells."""

import numpy as np
import pytest

from waylattice.operators import keyframes


def _inputs(spark, seed=5, n=2400, per=20):
    """Nodes on a grid of a tenth (many at one place), submaps at their mean; some nodes twice, lost, or in two submaps."""
    r = np.random.default_rng(seed)
    xy = np.round(r.normal(0, 0.6, (n, 2)), 1)
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    nodes += [(5, 0.3, 0.3), (6, float("nan"), 0.0), (7, float("inf"), 0.0), (8, None, 1.0), (9, 1e300, -1e18)]
    subs = [(i, *(float(v) for v in np.round(xy[i : i + per].mean(0), 2)), per, i % 60 != 0) for i in range(0, n, per)]
    members = [(i, i // per * per) for i in range(n)] + [(i, i // per * per + per) for i in range(0, n - per, 7)]
    make = spark.createDataFrame
    return nodes, subs, members, make(nodes, "node BIGINT, x DOUBLE, y DOUBLE"), make(subs, "submap BIGINT, x DOUBLE, y DOUBLE, scans INT, finished BOOLEAN"), make(members, "node BIGINT, submap BIGINT")


def _apart(nodes, subs):
    """Distances of every node row (by row) to every submap."""
    n, s = (np.array([x[1:3] for x in rows], float) for rows in (nodes, subs))
    with np.errstate(all="ignore"):
        dx, dy = (n[:, i, None] - s[None, :, i] for i in range(2))
        return np.sqrt(dx * dx + dy * dy)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_targets_of_nodes_are_the_nearest(spark, limit):
    nodes, subs, members, n, s, m = _inputs(spark)
    own = set(members)
    met, want = {}, set()
    far = _apart(nodes, subs)
    for i, j in zip(*np.nonzero(far <= 0.7)):
        node, b = nodes[i][0], subs[j]
        if b[4] and b[0] <= subs[-1][0] - 1 and (node, b[0]) not in own:
            met.setdefault(node, []).append((far[i, j], b[0]))
    for node, pairs in met.items():
        want |= {(node, b, d, k + 1) for k, (d, b) in enumerate(sorted(pairs)[:4])}
    got = [tuple(x) for x in keyframes.targets_of_nodes(n, s, m, radius=0.7, broadcast_submaps=limit).select("node", "submap", "distance", "place").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000


@pytest.mark.parametrize("limit,chunk", [(1_000_000, 65_536), (1_000_000, 100), (3, 65_536)])
def test_nodes_of_targets_are_the_nearest(spark, limit, chunk, monkeypatch):
    nodes, subs, members, n, s, m = _inputs(spark)
    first = {}
    for node, b in members:
        first[b] = min(node, first.get(b, node))
    want = set()
    far = _apart(nodes, subs)
    for j, b in enumerate(subs):
        met = sorted((far[i, j], nodes[i][0]) for i in np.flatnonzero(far[:, j] <= 0.7) if nodes[i][0] <= first[b[0]] - 22)
        want |= {(b[0], node, d) for k, (d, node) in enumerate(met) if k % 3 == 0 and k // 3 < 10}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(chunk, 10_000)))
    try:
        met = keyframes.nodes_of_targets(s.select("submap", "x", "y"), n, m, radius=0.7, separation=22, stride=3, cap=10, broadcast_submaps=limit)
        got = [tuple(x) for x in met.select("submap", "node", "distance").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_pairs_do_not_move(spark):
    """Rows that leave the tasks grow with nodes and submaps; pairs within the radius are a hundred times as many."""
    r = np.random.default_rng(1)
    n, per = 20_000, 50
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(r.random((n, 2)))], "node BIGINT, x DOUBLE, y DOUBLE")
    subs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(range(0, n, per), r.random((n // per, 2)))], "submap BIGINT, x DOUBLE, y DOUBLE")
    members = spark.createDataFrame([(i, i // per * per) for i in range(n)], "node BIGINT, submap BIGINT")
    first = members.groupBy("submap").min("node").toDF("submap", "first")
    few = subs.join(first, "submap").toPandas()
    moved = keyframes._nearest_old_nodes(few, nodes, subs.schema["submap"], 1.5, 50, 28).count()
    assert 28 * (n // per - 2) <= moved <= 28 * (n // per) * 8


def test_submaps_of_nothing(spark):
    _, _, _, n, s, m = _inputs(spark, n=40)
    assert keyframes.targets_of_nodes(n, s.limit(0), m, radius=1.0).count() == 0
    assert keyframes.nodes_of_targets(s.select("submap", "x", "y").limit(0), n, m, radius=1.0, separation=5, stride=3, cap=3).count() == 0
    assert keyframes.targets_of_nodes(n.limit(0), s, m, radius=1.0).count() == 0
