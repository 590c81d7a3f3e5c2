"""Scan matching on sparse maps: scores of turns and shifts by joins, and the best of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def cell_scores(points: DataFrame, occupancy: DataFrame, by: list[str], resolution: float, *, turns: int, turn: float, shifts: int, least: int = 20, pose: str = "odom") -> DataFrame:
    """Mean probability of the cells under a scan's points, for turns about its own pose and shifts by whole cells.

    ``points``: scan_id, by, x, y (in the world) and the pose; ``occupancy``: by,
    gx, gy, l. Points are counted per scan, turn and cell first, so shifts move
    counts of cells and not points. Cells without evidence count for nothing; an
    offset with fewer than ``least`` points on known cells is left out.

    Returns (scan_id, turn, di, dj, n, score), offsets as numbers of steps.
    """
    px, py = F.col(f"{pose}.x"), F.col(f"{pose}.y")
    around = points.withColumn("turn", F.explode(F.sequence(F.lit(-turns), F.lit(turns))))
    c, s = F.cos(F.col("turn") * turn), F.sin(F.col("turn") * turn)
    dx, dy = F.col("x") - px, F.col("y") - py
    at = around.select("scan_id", *by, "turn", geom.cell(px + c * dx - s * dy, resolution).alias("cx"), geom.cell(py + s * dx + c * dy, resolution).alias("cy"))
    counted = at.groupBy("scan_id", *by, "turn", "cx", "cy").agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(-shifts), F.lit(shifts)))
    moved = counted.withColumn("di", step).withColumn("dj", step).withColumns({"gx": F.col("cx") + F.col("di"), "gy": F.col("cy") + F.col("dj")})
    p = occupancy.select(*by, "gx", "gy", geom.probability(F.col("l")).alias("p"))
    met = moved.join(p, [*by, "gx", "gy"]).groupBy("scan_id", "turn", "di", "dj").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))
    return met.where(F.col("n") >= least).select("scan_id", "turn", "di", "dj", "n", "score")


def best_cells(scores: DataFrame) -> DataFrame:
    """The best offset of each scan; of equally good ones the one of fewest steps, then the first in order."""
    small = F.abs("turn") + F.abs("di") + F.abs("dj")
    rank = F.struct("score", (-small).alias("near"), (-F.col("turn")).alias("a"), (-F.col("di")).alias("b"), (-F.col("dj")).alias("c"))
    return scores.groupBy("scan_id").agg(F.max_by(F.struct("turn", "di", "dj", "n", "score"), rank).alias("m")).select("scan_id", "m.*")


#: Levels of the pyramid on which a pose is refined.
LEVELS = 3


def pooled(grid: np.ndarray, size: int) -> np.ndarray:
    """Greatest value of each ``size`` by ``size`` block; the grid is padded with even odds."""
    if size == 1:
        return grid
    h, w = (-(-n // size) * size for n in grid.shape)
    wide = np.pad(grid, ((0, h - grid.shape[0]), (0, w - grid.shape[1])), constant_values=0.5)
    return wide.reshape(h // size, size, w // size, size).max(axis=(1, 3))


MATCH = "scan_id BIGINT, x DOUBLE, y DOUBLE, theta DOUBLE, score DOUBLE"


def match_scans(scans: DataFrame, occupancy: DataFrame, by: list[str], resolution: float, *, method: str = "refine", reach: float = 1.0, turn: float = 0.04, turn_step: float = 0.02, pose: str = "odom") -> DataFrame:
    """Pose of every scan on its map: by Gauss-Newton on a pyramid from the pose given ('refine') or by branch and bound over a window around it ('search').

    ``scans``: points in the scan's own frame (scan_id, by, x, y) and the pose;
    ``occupancy``: by, gx, gy, l. A scan meets the cells within ``reach`` of its
    points only, so a task holds one scan and its patch of the map, both bounded
    by the beams of a scan. Unknown cells have even odds. Scans off the map come
    out with their own pose and the score it has there.

    Returns (scan_id, x, y, theta, score), score being the mean probability under the points.
    """
    from . import solvers

    if method not in ("refine", "search"):
        raise ValueError("method is 'refine' or 'search'")
    near = int(-(-reach // resolution)) + 1
    wx, wy = geom.se2_apply(F.col(pose), F.col("x"), F.col("y"))
    known = scans.where(F.col(f"{pose}.x").isNotNull() & F.col(f"{pose}.y").isNotNull() & F.col(f"{pose}.theta").isNotNull())
    cells = known.select("scan_id", *by, geom.cell(wx, resolution).alias("gx"), geom.cell(wy, resolution).alias("gy")).distinct()
    for c in ("gx", "gy"):
        cells = cells.withColumn(c, F.explode(F.sequence(F.col(c) - near, F.col(c) + near))).distinct()
    patch = cells.join(occupancy.select(*by, "gx", "gy", geom.probability(F.col("l")).alias("p")), [*by, "gx", "gy"]).select(F.col("scan_id").alias("of"), "gx", "gy", "p")  # a name of its own: the map is made from the scans
    points = known.select("scan_id", "x", "y", *[F.col(f"{pose}.{c}").alias(f"p{c}") for c in ("x", "y", "theta")])

    def run(mine: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=["scan_id", "x", "y", "theta", "score"])
        at = mine[["px", "py", "ptheta"]].iloc[0].to_numpy(float)
        xy = mine[["x", "y"]].to_numpy(float)
        found, score = at, 0.5
        if len(cells):
            gx, gy = cells.gx.to_numpy(), cells.gy.to_numpy()
            x0, y0 = gx.min() - 2, gy.min() - 2
            grid = np.full((gy.max() - y0 + 3, gx.max() - x0 + 3), 0.5)
            grid[gy - y0, gx - x0] = cells.p.to_numpy()
            origin = (x0 * resolution, y0 * resolution)
            if method == "refine":
                # coarse levels first; the value of a cell stands at its centre
                for level in (LEVELS - 1, *range(LEVELS - 2, -1, -1)):
                    size = resolution * 2**level
                    found, score = solvers.refine_pose(pooled(grid, 2**level), (origin[0] + size / 2, origin[1] + size / 2), size, xy, found)
            else:
                best = solvers.branch_and_bound(grid, origin, resolution, xy, at, reach=reach, turn=turn, turn_step=turn_step, depth=2)
                found, score = best if best is not None else (at, 0.0)
        return pd.DataFrame({"scan_id": [mine.scan_id.iloc[0]], "x": [found[0]], "y": [found[1]], "theta": [found[2]], "score": [score]})

    return points.groupBy("scan_id").cogroup(patch.groupBy("of")).applyInPandas(run, MATCH)
