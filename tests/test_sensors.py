import math

import numpy as np
import pytest

from waylattice.operators import regular_grid as rg
from waylattice.operators import spikes as sp

SCANS = "scan_id BIGINT, sensor_id STRING, dataset STRING, t DOUBLE, ranges ARRAY<DOUBLE>, source STRING, rank INT, beam INT"


def datasets(spark):
    return spark.createDataFrame([("hall", 0.1, 12.0)], "name STRING, range_min DOUBLE, range_max DOUBLE")


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCANS)
    return {(r["scan_id"], r["beam"], r["reason"]) for r in sp.implausible_readings(df, datasets(spark)).collect()}


def series(n, beams=6, seed=1):
    rng = np.random.default_rng(seed)
    level = np.linspace(2, 8, beams)
    return np.round(level + 0.02 * rng.standard_normal((n, beams)), 4)


def test_spikes_stuck_and_limits(spark):
    m = series(700)
    m[100, 2] += 1.0  # a spike
    m[200:203, 3] -= 0.8  # three scans still are one
    m[300:306, 1] += 0.9  # six scans are not
    m[400:, 4] += 0.7  # a lasting change is not
    m[500:509, 0] = m[500, 0]  # nine equal values are stuck
    m[520:527, 0] = m[520, 0]  # seven are not
    rows = [(i, "a", "hall", float(i), m[i].tolist()) for i in range(700)]
    rows[50][4][1] = float("nan")
    rows[51][4][1] = float("inf")
    rows[52][4][1] = 0.05
    rows[53][4][1] = 12.0  # no return
    rows[54][4][1] = 12.5
    rows[55][4][1] = None
    got = found(spark, rows)
    assert {g for g in got if g[2] == "spike"} == {(100, 2, "spike"), *((i, 3, "spike") for i in range(200, 203))}
    assert {g for g in got if g[2] == "stuck"} == {(i, 0, "stuck") for i in range(500, 509)}
    assert {g for g in got if g[2] == "impossible"} == {(i, 1, "impossible") for i in (50, 51, 52, 54)}


def test_missing_reading_ends_a_run_and_order_is_by_time(spark):
    m = series(40, 2)
    m[10:22, 1] = m[10, 1]
    rows = [(i, "a", "hall", float(i), m[i].tolist()) for i in range(40)]
    rows[16][4][1] = None
    assert not {g for g in found(spark, rows) if g[2] == "stuck"}
    rows[16][4][1] = float(m[10, 1])
    assert len({g for g in found(spark, rows[::-1] + rows[5:15]) if g[2] == "stuck"}) == 12


def test_runs_and_spikes_at_block_edges(spark):
    n = sp.BLOCK_ROWS + 60
    m = series(n, 4)
    at = sp.BLOCK_ROWS
    m[at - 4 : at + 5, 0] = m[at - 4, 0]
    m[at - 1 : at + 1, 2] += 2.0
    got = found(spark, [(i, "a", "hall", float(i), m[i].tolist()) for i in range(n)])
    assert got == {(i, 0, "stuck") for i in range(at - 4, at + 5)} | {(i, 2, "spike") for i in (at - 1, at)}


def test_odd_rows(spark):
    m = series(30, 3)
    rows = [(i, "a", "hall", float(i), m[i].tolist()) for i in range(30)]
    rows += [(None, "a", "hall", 1.5, [1.0]), (900, None, "hall", 1.5, [1.0]), (901, "a", "hall", None, [99.0]), (902, "a", "hall", 3.5, None), (903, "a", "hall", 3.6, []), (904, "a", "hall", float("nan"), [99.0])]
    rows += [(905, "b", None, 1.0, [99.0, float("nan")]), (906, "c", "unknown", 1.0, [5.0])]
    assert found(spark, rows) == {(905, 1, "impossible")}
    assert found(spark, []) == set()
    assert len(found(spark, [(1, "a", "hall", 1.0, [0.01] * 5000)])) == 5000


def test_robust_components_separates():
    rng = np.random.default_rng(0)
    base = np.outer(np.linspace(1, 2, 200), rng.uniform(1, 5, 20))
    noise = 0.01 * rng.standard_normal(base.shape)
    m = base + noise
    m[17, 3] += 0.5
    low, sparse = sp.robust_components(m, 0.01)
    assert np.unravel_index(np.abs(sparse).argmax(), m.shape) == (17, 3) and sparse[17, 3] > 0.3
    assert (sparse != 0).sum() < 0.01 * m.size
    assert np.abs(low - base).max() < 0.1


def test_spikes_come_through_the_decomposition(spark, monkeypatch):
    """A beam that drifts with all others: its spike shows against the low-rank part only, and without a sparse part there are none."""
    m = series(700, 12)
    m += np.outer(1.5 * np.sin(np.arange(700) / 200), np.linspace(0.5, 1.5, 12))
    m = np.round(m, 4)
    m[330, 5] -= 0.9
    context = m[: sp.BLOCK_ROWS + sp.CONTEXT_ROWS]
    assert abs(m[330, 5] - np.median(context[:, 5])) < np.quantile(np.abs(context[:, 5] - np.median(context[:, 5])), 0.9)  # no outlier of its column
    rows = [(i, "a", "hall", float(i), m[i].tolist()) for i in range(700)]
    assert {g for g in found(spark, rows) if g[2] == "spike"} == {(330, 5, "spike")}
    level = np.stack([np.where(np.isnan(a), b, a) for a, b in (sp.levels(c) for c in context.T)]).T
    low, sparse = sp.robust_components(context, 0.03, level)
    assert sparse[330, 5] < -0.5 and np.linalg.matrix_rank(low) <= 3
    assert (330, 5) in {(r["scan"], r["beam"]) for r in _spikes_of_block(m)}
    monkeypatch.setattr(sp, "robust_components", lambda m, *_: (m, np.zeros_like(m)))
    assert not _spikes_of_block(m)
    # a column's median instead of the low-rank part misses it
    monkeypatch.setattr(sp, "robust_components", lambda m, scatter, level, least: (m, np.where(np.abs(m - np.median(m, axis=0)) > 10 * least, 1.0, 0.0)))
    assert (330, 5) not in {(r["scan"], r["beam"]) for r in _spikes_of_block(m)}


def _spikes_of_block(m):
    import pyarrow as pa

    n = len(m)
    t = pa.table({"rank": np.arange(n), "home": np.ones(n, bool), "scan": np.arange(n), "ranges": m.tolist(), "least": np.zeros(n), "most": np.full(n, 99.0)})
    out = sp._block((pa.scalar("a"), pa.scalar(0)), t)
    return [r for r in out.to_pylist() if r["reason"] == "spike"]


def test_stuck_runs_brute():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 2, (60, 4)).astype(float)
    m[rng.random(m.shape) < 0.1] = np.nan
    got = sp.stuck_runs(m, 4)
    for b in range(4):
        for i in range(60):
            if math.isnan(m[i, b]):
                assert not got[i, b]
                continue
            a = z = i
            while a > 0 and m[a - 1, b] == m[i, b]:
                a -= 1
            while z < 59 and m[z + 1, b] == m[i, b]:
                z += 1
            assert got[i, b] == (z - a + 1 >= 4)


READINGS = "stream STRING, source STRING, key BIGINT, ts DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, slot INT, lo INT, state STRING"


def grid(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0, "?") for r in rows], READINGS)
    return {(r["stream"], r["source"], r["slot"]): r for r in rg.regular_grid(df).collect()}


def test_grid_fills_a_sine(spark):
    t = [i for i in range(400) if i not in range(100, 110) and i % 17]
    rows = [("s", "a", i, i + 0.25, math.sin(i / 8), math.cos(i / 8), 1.0) for i in t]
    rows += rows[:50]  # delivered twice
    out = grid(spark, rows)
    assert len(out) == 400 - 1
    filled = [k[2] for k, r in out.items() if r["state"] == "filled"]
    assert sorted(filled) == [i for i in range(1, 400) if i not in t]
    assert max(abs(out["s", "a", i]["x"] - math.sin(i / 8)) for i in filled) < 0.1
    assert all(r["readings"] == 1 for k, r in out.items() if k[2] in t)


def test_grid_marks_long_gaps_over_chunks(spark):
    far = 3 * rg.CHUNK_SLOTS + 7
    out = grid(spark, [("s", "a", 1, 5.5, 1.0, 1.0, 1.0), ("s", "a", 2, far + 0.5, 2.0, 1.0, 1.0), ("s", "b", 3, 9.0, 0.0, 0.0, 0.0)])
    a = {k[2]: r["state"] for k, r in out.items() if k[1] == "a"}
    assert sorted(a) == list(range(5, far + 1))
    assert {s for i, s in a.items() if 5 < i < far} == {"gap"}
    assert out["s", "b", 9]["state"] == "observed"


def test_grid_odd_rows(spark):
    none = [(None, "a", 1, 1.0, 0.0, 0.0, 0.0), ("s", None, 1, 1.0, 0.0, 0.0, 0.0), ("s", "a", None, 1.0, 0.0, 0.0, 0.0), ("s", "a", 2, None, 0.0, 0.0, 0.0), ("s", "a", 3, float("nan"), 0.0, 0.0, 0.0), ("s", "a", 4, float("inf"), 0.0, 0.0, 0.0)]
    assert grid(spark, none) == {}
    assert grid(spark, []) == {}
    out = grid(spark, [("s", "a", 5, -1.5, None, float("nan"), 1.0), ("s", "a", 6, 1.5, 2.0, 2.0, 2.0), ("s", "a", 7, 1.7, 4.0, 2.0, 2.0)])
    assert sorted(k[2] for k in out) == [-2, -1, 0, 1]
    assert out["s", "a", 1]["x"] == 3.0
    # a slot whose readings say nothing of x is observed, with x unknown
    assert (out["s", "a", -2]["x"], out["s", "a", -2]["y"], out["s", "a", -2]["z"], out["s", "a", -2]["state"]) == (None, None, 1.0, "observed")
    # what is filled comes from the known ones alone, and stays unknown where no reading says anything
    out = grid(spark, [("s", "a", i, i + 0.5, None if i % 2 else 7.0, None, float("nan") if i == 3 else 2.0) for i in range(9) if i != 4])
    assert out["s", "a", 4]["state"] == "filled" and abs(out["s", "a", 4]["x"] - 7.0) < 1e-9 and out["s", "a", 4]["y"] is None and abs(out["s", "a", 4]["z"] - 2.0) < 1e-9
    assert out["s", "a", 3]["x"] is None and out["s", "a", 3]["z"] is None and out["s", "a", 2]["x"] == 7.0


def test_hidden_runs_are_filled_better_than_by_lines():
    """Known seconds of the poses, hidden: the imputation's error against that of straight lines."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/gt_poses.parquet", columns=["sequence_id", "ts", "tx", "ty", "tz"]).to_pandas().dropna()
    rng, ours, lines = np.random.default_rng(3), [], []
    for _, g in t.groupby("sequence_id"):
        slots = g.groupby(np.floor(g.ts).astype(int))[["tx", "ty", "tz"]].mean()
        # the longest stretch without a gap
        breaks = np.flatnonzero(np.diff(slots.index) > 1)
        spans = list(zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks + 1, [len(slots)]])))
        a, b = max(spans, key=lambda s: s[1] - s[0])
        if b - a < 80:
            continue
        x = slots.values[a:b].T[:, :600]
        hidden = np.zeros(x.shape[1], bool)
        for start in rng.integers(20, x.shape[1] - 20, x.shape[1] // 40):
            hidden[start : start + rng.choice([3, 8])] = True
        y = np.where(hidden, np.nan, x)
        known = np.flatnonzero(~hidden)
        line = np.stack([np.interp(np.arange(x.shape[1]), known, c[known]) for c in x])
        ours.append(np.sqrt(((rg.impute(y) - x)[:, hidden] ** 2).mean()))
        lines.append(np.sqrt(((line - x)[:, hidden] ** 2).mean()))
    assert len(ours) >= 2 and np.median(ours) < 0.6 * np.median(lines), (ours, lines)


def test_impute_keeps_known_values():
    s = np.array([[1.0, np.nan, 3.0, 4.0, np.nan, 6.0]])
    out = rg.impute(s.copy())
    assert np.allclose(out[0][[0, 2, 3, 5]], s[0][[0, 2, 3, 5]])
    assert not np.isnan(out).any()
    assert pytest.approx(rg.diagonal_means(np.lib.stride_tricks.sliding_window_view(np.arange(6.0)[None], 4, axis=1))[0].tolist()) == list(range(6))


def test_glitches_of_whole_scans_brute(spark):
    """Departures that many beams share are found one by one, also in a block with much more scatter than is usual."""
    rng = np.random.default_rng(5)
    n, beams = 3 * sp.BLOCK_ROWS, 90
    m = 5 + 0.02 * rng.standard_normal((n, beams))
    m[100:103, :40] += 0.4
    m[300] += 0.5 * rng.choice([-1, 1], beams)
    m[600:603, ::2] -= 0.6
    m[2 * sp.BLOCK_ROWS :, :] = 5 + 0.1 * rng.standard_normal((sp.BLOCK_ROWS, beams))  # a noisy block
    m[1300, :80] += 0.33
    m = np.round(m, 4)
    got = {g[:2] for g in found(spark, [(i, "a", "hall", float(i), m[i].tolist()) for i in range(n)]) if g[2] == "spike"}
    series = [sp.levels(m[:, b]) for b in range(beams)]
    before, after = (np.array([s[i] for s in series]).T for i in (0, 1))
    # of a block, as far as its context reaches: its first level of the whole table is the same
    spread = [np.abs((m - before)[a : a + sp.BLOCK_ROWS]) for a in range(0, n, sp.BLOCK_ROWS)]
    usual = sorted(sp.MAD_SCALE * np.median(s[np.isfinite(s)]) for s in spread)[1]
    limit, want = sp.SPIKE_FACTOR * usual, set()
    for i, b in np.argwhere((np.abs(m - before) > limit) & (np.abs(m - after) > limit)):
        over = np.minimum(np.abs(m[:, b] - before[i, b]), np.abs(m[:, b] - after[i, b])) > limit
        run = 1
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and over[j] and run <= sp.SPIKE_ROWS:
                run, j = run + 1, j + step
        if run <= sp.SPIKE_ROWS:
            want.add((int(i), int(b)))
    assert got == want
    assert {(i, b) for i in range(100, 103) for b in range(40)} <= got and {(300, b) for b in range(beams)} <= got and len([g for g in got if g[0] == 1300]) > 60
