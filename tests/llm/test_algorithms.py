import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waylattice.llm import nearest_time, percentiles, top_n
from waylattice.operators import bisect

random.seed(11)


def tops(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(*r, "x", 0, 0.0) for r in rows], "k BIGINT, c BIGINT, score DOUBLE, g STRING, v INT, s DOUBLE")
    return sorted((r["k"], r["rank"], r["c"], r["score"]) for r in top_n.top_n_per_group(df, "k", "c", "score", n, **kw).collect())


def brute_tops(rows, n=3):
    best = {}
    for k, c, s in rows:
        if k is not None and c is not None and s is not None and s == s and s >= 0:
            best[k, c] = max(best.get((k, c), -1), s)
    out = []
    for k in {k for k, _ in best}:
        items = sorted((-s, c) for (q, c), s in best.items() if q == k)[:n]
        out += [(k, i + 1, c, -s) for i, (s, c) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 1, "hot_rows": 100}, {"bits": 1}])
def test_top_n_brute(spark, kw):
    rows = [(1, c, random.choice([0.5, 0.25, 0.125])) for c in range(400)]  # a hot group full of ties
    rows += [(random.randrange(2, 30), random.randrange(50), random.choice([random.random(), 0.5, -1.0, None, float("nan"), 0.0, -0.0, float("inf")])) for _ in range(1200)]
    rows += [(None, 1, 1.0), (40, None, 1.0), (41, 7, 0.1), (41, -9223372036854775808, 0.1), (41, 9223372036854775807, 0.1), (41, 8, 0.1)]
    rows += rows[:200]
    assert tops(spark, rows, **kw) == brute_tops(rows)


def test_top_n_edges(spark):
    assert tops(spark, []) == []
    assert tops(spark, [(1, 1, None), (1, 2, -1.0)]) == []
    assert [r[2] for r in tops(spark, [(1, i, 1e-310 * (i % 3)) for i in range(9)], 4)] == [2, 5, 8, 1]
    with pytest.raises(ValueError):
        tops(spark, [], 0)
    with pytest.raises(TypeError):
        top_n.top_n_per_group(spark.createDataFrame([("a", "b", 1.0)], "k STRING, c STRING, s DOUBLE"), "k", "c", "s")


def test_order_code_sorts_as_doubles(spark):
    v = [float("-inf"), -1e300, -2.5, -1.0, -1e-310, -0.0, 0.0, 1e-310, 1.0, 2.5, 1e300, float("inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i INT, x DOUBLE").select("i", bisect.order_code(F.col("x")).alias("c"))
    c = [r["c"] for r in df.orderBy("i").collect()]
    assert c == sorted(c) and c[5] == c[6] and len(set(c)) == len(v) - 1


PCTS = (500, 900, 950, 990)


def pct_rows(spark, rows, f=percentiles.percentiles, **kw):
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "run STRING, day STRING, frame BIGINT, a DOUBLE, b DOUBLE, g INT, d STRING")
    return {(r["run"], r["day"], r["level"], r["metric"], round(r["p"] * 1000)): r for r in f(df, "run", "day", "frame", ["a", "b"], PCTS, **kw).collect()}


def brute_pcts(rows):
    once, out = {}, {}
    for run, day, frame, a, b in rows:
        if run is not None and frame is not None:
            once[run, frame] = (day, a, b)
    groups = {}
    for (run, _), (day, *vals) in once.items():
        for m, v in zip("ab", vals):
            if v is not None and v == v and v >= 0:
                groups.setdefault((run, day, "part", m), []).append(v)
                groups.setdefault((run, None, "all", m), []).append(v)
    for k, v in groups.items():
        v.sort()
        for p in PCTS:
            out[(*k, p)] = v[max(1, -(-len(v) * p // 1000)) - 1]
    return out


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 1, "hot_rows": 50}, {"bits": 2}])
def test_percentiles_brute(spark, kw):
    pick = lambda: random.choice([random.lognormvariate(0, 2), 0.5, 0.0, None, float("nan"), -1.0, float("inf")])
    rows = [(random.choice(["hot"] * 5 + ["x", "y"]), random.choice(["d1", "d2", None]), i, pick(), random.random() * 1e-3) for i in range(1500)]
    rows += rows[:300] + [(None, "d1", 1, 1.0, 1.0), ("x", "d1", None, 1.0, 1.0), ("alone", "d1", 1, None, 3.0)]
    got = {k: r["value"] for k, r in pct_rows(spark, rows, **kw).items()}
    assert got == brute_pcts(rows)
    bounds = pct_rows(spark, rows, percentiles.percentiles_bounded)
    assert bounds.keys() == got.keys()
    for k, v in got.items():
        lo, hi = bounds[k]["lower"], bounds[k]["upper"]
        assert lo <= v <= hi and (hi == lo or hi - lo <= 0.004 * v)


@pytest.mark.parametrize("broadcast_rows,hot_rows", [(4, 500), (4, 100), (20, 1000), (3, 40)])
def test_hot_runs_of_cold_days(spark, broadcast_rows, hot_rows):
    """Runs above the limit whose days are below it, and days on either side of it."""
    rows = [("hot", f"d{i % 20}" if i % 3 else None, i, random.random(), random.choice([1.0, 2.0])) for i in range(4000)]
    rows += [(f"r{i % 9}", f"d{i % 4}", i, random.random(), random.random()) for i in range(900)]
    got = {k: r["value"] for k, r in pct_rows(spark, rows, broadcast_rows=broadcast_rows, hot_rows=hot_rows).items()}
    assert got == brute_pcts(rows)


def test_hot_groups_of_top_n(spark):
    rows = [(1, c, random.random()) for c in range(3000)] + [(k, c, random.choice([0.5, random.random()])) for k in range(2, 60) for c in range(20)]
    assert tops(spark, rows, broadcast_rows=4, hot_rows=500) == brute_tops(rows)


def test_percentiles_empty(spark):
    assert pct_rows(spark, []) == {}


def test_days_combine_into_runs(spark):
    df = spark.createDataFrame([("r", f"d{i % 3}", i, float(i % 97)) for i in range(1000)], "run STRING, day STRING, frame BIGINT, a DOUBLE")
    days = bisect.summarise(percentiles.measured(df, "run", "day", "frame", ["a"]), percentiles.PART)
    whole = bisect.summarise(percentiles.measured(df.withColumn("day", F.lit("all")), "run", "day", "frame", ["a"]), percentiles.PART)
    cols = ["g", "m", "cell", "c", "lo", "hi"]
    assert sorted(bisect.combine(days, "g", "m").select(*cols).collect()) == sorted(whole.select(*cols).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=300, unique=True), st.lists(st.floats(-2e6, 2e6), max_size=50), st.sampled_from([1, 4, 32]))
def test_learned_index_positions(keys, queries, error):
    k = np.sort(np.array(keys))
    q = np.array(queries + keys[:5])
    assert (nearest_time.positions(k, q, error) == np.searchsorted(k, q)).all()


def test_learned_index_on_clustered_keys():
    k = np.unique(np.concatenate([np.linspace(0, 1, 5000), 1e9 + np.random.default_rng(1).random(5000), np.geomspace(1e-9, 1e12, 3000)]))
    q = np.concatenate([k, k + 1e-7, np.random.default_rng(2).random(2000) * 1e12])
    assert (nearest_time.positions(k, q, 16) == np.searchsorted(k, q)).all()
    starts, _ = nearest_time.fit_segments(np.arange(100000.0), 16)
    assert len(starts) == 1


@pytest.mark.parametrize("kw", [{}, {"shard_seconds": 3.0}, {"shard_rows": 20}, {"shard_seconds": 0.3, "shard_rows": 7}])
def test_nearest_in_time_brute(spark, kw):
    right = [(1000 + i, random.choice("aab"), random.randrange(0, 4000) / 100) for i in range(400)] + [(5, None, 1.0), (None, "a", 1.0), (6, "a", None), (7, "a", float("nan")), (8, "a", float("inf"))]
    left = [(random.randrange(2), i, random.choice("aabc"), random.randrange(0, 40000) / 1000) for i in range(300)] + [(0, 900, None, 1.0), (0, 901, "a", None), (0, 902, "a", float("nan")), (0, None, "a", 2.0)]
    left += [(1, 2000 + i, "a", 7.003) for i in range(60)] + left[:100]  # a hot moment, and deliveries
    lf = spark.createDataFrame([(*x, 1, "z") for x in left], "kind INT, id BIGINT, entity STRING, ts DOUBLE, side INT, cell STRING")
    rf = spark.createDataFrame([(*x, 1, "z") for x in right], "id BIGINT, entity STRING, ts DOUBLE, side INT, cell STRING")
    got = sorted((r["kind"], r["id"], r["match"]) for r in nearest_time.nearest_in_time(lf, rf, 0.06, **kw).collect())
    want = set()
    for kind, i, e, t in left:
        if i is None or e is None or t is None or t != t:
            continue
        near = min(((abs(rt - t), rt, ri) for ri, re, rt in right if ri is not None and re == e and rt is not None and abs(rt) < 1e15 and rt == rt), default=None)
        if near and near[0] <= 0.06:
            want.add((kind, i, near[2]))
    assert got == sorted(want)
    assert nearest_time.nearest_in_time(lf.limit(0), rf, 0.06).count() == 0
    assert nearest_time.nearest_in_time(lf, rf.limit(0), 0.06).count() == 0


def test_bursts_are_cut(spark, monkeypatch):
    """Half a second holds nearly all rows; no task sees more than its part and two neighbours."""
    r = random.Random(2)
    right = [(10_000 + i, "a", 500 + r.random() * 0.5) for i in range(3000)] + [(1, "a", 499.99), (2, "a", 500.6), (3, "b", 500.1)]
    left = [(0, i, "a", 500 + r.random() * 0.6) for i in range(800)] + [(1, i, "a", 500.25) for i in range(700)] + [(0, 5000, "b", 500.11)]
    lf = spark.createDataFrame(left, "kind INT, id BIGINT, entity STRING, ts DOUBLE")
    rf = spark.createDataFrame(right, "id BIGINT, entity STRING, ts DOUBLE")
    kernel = nearest_time._shard_kernel

    def bounded(tolerance, error):
        run = kernel(tolerance, error)

        def checked(table):
            assert table.num_rows <= 102
            return run(table)

        return checked

    monkeypatch.setattr(nearest_time, "_shard_kernel", bounded)
    got = {(x["kind"], x["id"]): x["match"] for x in nearest_time.nearest_in_time(lf, rf, 0.02, shard_rows=100).collect()}
    for kind, i, e, t in left:
        near = min((abs(rt - t), rt, ri) for ri, re, rt in right if re == e)
        assert got.get((kind, i)) == (near[2] if near[0] <= 0.02 else None)
