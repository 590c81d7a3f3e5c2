import numpy as np
import pytest

from tests.compare import check, duck
from tests.conftest import SF
from waylattice.plans import catalog


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    check(spark, con, SF, catalog.QUERIES[name], catalog.SQL[name])


def pandas(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def test_aligned_errors_are_least(spark):
    plain, rigid, scaled = (pandas(spark, n).set_index("sequence_id") for n in ("ate_3d", "ate_aligned", "ate_aligned_scaled"))
    assert (rigid.n <= plain.n).all() and (rigid.rmse <= plain.rmse + 1e-6).all() and (scaled.rmse <= rigid.rmse + 1e-6).all()
    turn = pandas(spark, "rpe_3d_rotation")
    assert (turn.n > 0).all() and (turn["max"] >= turn["median"]).all() and (turn["median"] >= 0).all()


def test_greedy_pairs_are_one_to_one(spark):
    got = pandas(spark, "asof_greedy_1to1")
    assert len(got) and not got.pose_id.duplicated().any() and not got.match_id.duplicated().any() and (got["dt"] <= 0.02).all()


def test_adaptive_voxels_leave_enough(spark):
    from waylattice.plans import map_queries

    world = map_queries._world(spark, SF).toPandas()
    for r in pandas(spark, "adaptive_voxel").itertuples():
        mine = world[world.sensor_id == r.sensor_id]
        assert len(mine) == r.n
        if r.size > 0:
            assert len(set(zip(np.floor(mine.x / r.size), np.floor(mine.y / r.size)))) >= 200
        else:
            assert r.n <= 200


@pytest.mark.parametrize("name,per_scan", [("occupancy_fold_exact", False), ("occupancy_per_scan", True)])
def test_occupancy_folds(spark, name, per_scan):
    from waylattice.operators import maps
    from waylattice.plans import map_queries

    rays = map_queries._rays(spark, SF).toPandas().sort_values(["scan_id", "beam"])
    got = {(r.sensor_id, r.gx, r.gy): r.l for r in pandas(spark, name).itertuples()}
    want = {}
    clip = lambda x: max(-maps.LOG_ODDS_MOST, min(maps.LOG_ODDS_MOST, x))
    step = np.where(rays.hit, maps.LOG_ODDS_HIT, maps.LOG_ODDS_FREE)
    rays = rays.assign(step=step)
    if per_scan:
        rays = rays.groupby(["scan_id", "sensor_id", "gx", "gy"], as_index=False).step.sum().sort_values("scan_id")
    for r in rays.itertuples():
        k = (r.sensor_id, r.gx, r.gy)
        want[k] = clip(want.get(k, 0.0) + r.step)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-5


def test_samples_and_filters(spark):
    n = catalog.QUERIES["hash_ratio_sample"](spark, SF).count() / max(1, pandas(spark, "rolling_buffer").shape[0])
    assert 0.2 < n < 0.4
    for name in ("motion_filter", "debounce_filter", "submap_lifecycle", "pose_extrapolation", "pose_graph_optimisation"):
        rows = pandas(spark, name)
        assert len(rows) and not rows.isna().all(axis=None), name
    assert set(pandas(spark, "consistency_groups").columns)
    states = pandas(spark, "tracking_states").sort_values(["run_id", "frame_idx"])
    assert set(states.state) <= {"NOT_INITIALIZED", "OK", "LOST"} and (states.was == states.groupby("run_id").state.shift().fillna("NO_IMAGES_YET")).all()


def test_matched_scans_are_the_best(spark):
    scores = pandas(spark, "correlative_scores")
    best = pandas(spark, "match_scans").set_index("scan_id")
    top = scores.groupby("scan_id").score.max()
    assert len(best) == len(top) and (best.score.sort_index() == top.sort_index()).all()


def test_views_agree(spark):
    for name in ("sim3_blocks", "homography_blocks", "essential_blocks", "motion_only_blocks"):
        rows = pandas(spark, name)
        full = rows[rows.pairs >= 16]
        # positions near a plane leave the epipolar geometry loose
        assert len(full) and (full.inliers > (0.5 if name == "essential_blocks" else 0.8) * full.pairs).all(), name
    bundles = pandas(spark, "bundle_blocks")
    assert (bundles[bundles.points >= 32].off < 1e-2).all() and (bundles.inliers > 0.9 * bundles.observations).all(), bundles.to_string()
    graph = pandas(spark, "spatial_graph_blocks")
    assert (graph.after <= graph.before + 1e-9).all() and (graph.after < 1e-6).all()


def test_scans_found_on_their_map(spark):
    search, refined = (pandas(spark, n).set_index("scan_id") for n in ("scan_search", "scan_refinement"))
    assert len(search) == len(refined) and search.score.between(0, 1).all() and refined.score.between(0, 1).all()


def test_sensor_queries_without_sql(spark):
    found, reasons, grid, slots = (pandas(spark, n) for n in ("p3_found", "p3_reasons", "p4_grid", "p4_slots"))
    assert set(zip(found.scan_id, found.beam)) == set(zip(reasons.scan_id, reasons.beam)) and not found.duplicated().any()
    assert set(reasons.reason) <= {"impossible", "stuck", "spike"}
    assert len(grid) == len(slots) and ((grid.readings > 0) == (grid.state == "observed")).all()
    assert grid[grid.state == "gap"].x.isna().all() and set(grid.state) <= {"observed", "filled", "gap"}


def test_every_query_without_sql_is_checked():
    """The names above are all there are."""
    import inspect
    import sys

    text = inspect.getsource(sys.modules[__name__])
    assert not [n for n in set(catalog.QUERIES) - set(catalog.SQL) if f'"{n}"' not in text]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
