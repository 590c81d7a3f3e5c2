"""Point clouds and occupancy maps as sparse tables of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..session import ship_package
from .bisect import exact_percentiles, meet

# --- fixed values ----------------------------------------------------------------------------------------------
LOG_ODDS_FREE, LOG_ODDS_HIT, LOG_ODDS_MOST, MERGED_MOST = -0.4, 0.85, 5.0, 10.0
# ---------------------------------------------------------------------------------------------------------------


def scan_points(scans: DataFrame, profiles: DataFrame, stride: int | None = None) -> DataFrame:
    """(scan_id, beam, x, y) of every finite reading within the profile's limits; the angle goes by the beam's own number.

    ``stride`` overrides the profile's beam_stride. Limits are inclusive;
    readings of just range_max are "no return" and make no point.
    """
    p = F.broadcast(profiles.select(F.col("name").alias("dataset"), "angle_min", "angle_inc", "range_min", "range_max", "beam_stride"))  # one row per kind of sensor
    step = F.col("beam_stride") if stride is None else F.lit(stride)
    beams = scans.join(p, "dataset").select("*", F.posexplode("ranges").alias("beam", "r")).where(
        F.col("r").isNotNull() & ~F.isnan("r") & (F.col("r") >= F.col("range_min")) & (F.col("r") < F.col("range_max")) & (F.col("beam") % step == 0)
    )
    a = F.col("angle_min") + F.col("beam") * F.col("angle_inc")
    return beams.select("scan_id", "sensor_id", "beam", (F.col("r") * F.cos(a)).alias("x"), (F.col("r") * F.sin(a)).alias("y"), "odom")


def world_points(points: DataFrame, pose: str = "odom") -> DataFrame:
    """Points moved by their scan's pose; points without one are left out."""
    x, y = geom.se2_apply(F.col(pose), F.col("x"), F.col("y"))
    return points.where(F.col(f"{pose}.x").isNotNull() & F.col(f"{pose}.y").isNotNull() & F.col(f"{pose}.theta").isNotNull()).withColumns({"x": x, "y": y})


def voxel_centroids(points: DataFrame, size: float, by: list[str], axes: list[str], least: int = 1) -> DataFrame:
    """Mean point and count of each voxel with at least ``least`` points."""
    keys = {f"v{a}": geom.cell(F.col(a), size) for a in axes}
    return points.withColumns(keys).groupBy(*by, *keys).agg(*[F.avg(a).alias(a) for a in axes], F.count("*").alias("n")).where(F.col("n") >= least)


def voxel_first(points: DataFrame, size: float, by: list[str], axes: list[str], order: str) -> DataFrame:
    """The first point of each voxel in ``order`` (a unique column)."""
    keys = {f"v{a}": geom.cell(F.col(a), size) for a in axes}
    return points.withColumns(keys).groupBy(*by, *keys).agg(F.min_by(F.struct(*axes), order).alias("p"), F.min(order).alias(order)).select(*by, order, "p.*")


def adaptive_voxel_size(points: DataFrame, by: str, axes: list[str], most: float, least_points: int, rounds: int = 8) -> DataFrame:
    """Per group the greatest voxel size found by ``rounds`` bisections of (0, most] that still leaves ``least_points`` voxels.

    Groups of at most that many points keep size 0 (all points). All groups are
    bisected together; every round counts distinct voxels in one aggregation.
    """
    from ..session import cut

    state = points.groupBy(by).agg(F.count("*").alias("n")).select(by, "n", F.lit(0.0).alias("lo"), F.lit(float(most)).alias("hi"), F.lit(float(most)).alias("mid"), F.lit(0.0).alias("best"))
    state = cut(state)
    for i in range(rounds + 1):  # the first round tries the greatest size itself
        open_ = state.where((F.col("n") > least_points) & (F.col("hi") > F.col("lo")))
        size = points.join(open_.select(by, "mid"), by)
        voxels = size.select(by, *[F.floor(F.col(a) / F.col("mid")).alias(f"v{a}") for a in axes]).distinct().groupBy(by).agg(F.count("*").alias("voxels"))
        met = state.join(voxels, by, "left")
        enough = F.coalesce(F.col("voxels") >= least_points, F.lit(False))
        lo, hi = F.when(enough, F.col("mid")).otherwise(F.col("lo")), F.when(enough, F.when(F.col("mid") == most, F.col("mid")).otherwise(F.col("hi"))).otherwise(F.col("mid"))
        closed = F.col("voxels").isNull()
        state = cut(met.select(by, "n", F.when(closed, F.col("lo")).otherwise(lo).alias("lo"), F.when(closed, F.col("hi")).otherwise(hi).alias("hi"), F.when(enough, F.col("mid")).otherwise(F.col("best")).alias("best")).withColumn("mid", (F.col("lo") + F.col("hi")) / 2))
    return state.select(by, "n", F.col("best").alias("size"))


def clip_outliers(points: DataFrame, by: list[str], axes: list[str], sigma: float = 3.5, floor: float = 0.01) -> DataFrame:
    """Points within ``sigma`` standard deviations (at least ``floor``) of their group's median on every axis."""
    spread = points.groupBy(*by).agg(*[F.stddev_pop(a).alias(f"d_{a}") for a in axes])
    stats = meet(spread, exact_percentiles(points, by, axes, {"m": 0.5}), by)
    near = F.lit(True)
    for a in axes:
        near = near & (F.abs(F.col(a) - F.col(f"m_{a}")) < sigma * F.greatest(F.col(f"d_{a}"), F.lit(floor)))
    return meet(points, stats, by).where(near).select(*points.columns)


def robust_bounds(points: DataFrame, by: list[str], axes: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Exact percentiles of each axis, by linear interpolation."""
    return exact_percentiles(points, by, axes, {"lo": low, "hi": high})


def within_reference(points: DataFrame, reference: DataFrame, by: list[str], axes: list[str], padding: float = 3.0) -> DataFrame:
    """Points in the bounding box of a reference cloud, padded, bounds included."""
    box = reference.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(a).between(F.col(f"lo_{a}") - padding, F.col(f"hi_{a}") + padding)
    return points.join(box, by).where(inside).select(*points.columns)


def bresenham(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Cells of the line from (x0, y0) to (x1, y1), ends included, as an array of structs (gx, gy, last).

    Steps along the longer axis; the other one is the rounded quotient, so the
    cells are those of the integer error walk, with ties away from the start.
    """
    dx, dy = x1 - x0, y1 - y0
    n = F.greatest(F.abs(dx), F.abs(dy))
    # floor((2 d i + n) / (2 n)) rounds d i / n half up without leaving the integers
    at = lambda d, i: F.when(n == 0, F.lit(0)).otherwise(F.signum(d).cast("bigint") * F.floor((F.abs(d) * i * 2 + n) / (n * 2)).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda i: F.struct((x0 + at(dx, i)).alias("gx"), (y0 + at(dy, i)).alias("gy"), (i == n).alias("last")))


def ray_cells(points: DataFrame, resolution: float, pose: str = "odom") -> DataFrame:
    """(scan_id, sensor_id, beam, gx, gy, hit): the cells every ray passes, its endpoint marked."""
    start = [geom.cell(F.col(f"{pose}.{c}"), resolution) for c in "xy"]
    end = [geom.cell(F.col(c), resolution) for c in "xy"]
    rays = points.withColumns({"x0": start[0], "y0": start[1], "x1": end[0], "y1": end[1]})
    return rays.select("scan_id", "sensor_id", "beam", F.explode(bresenham(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("c")).select("scan_id", "sensor_id", "beam", "c.gx", "c.gy", F.col("c.last").alias("hit"))


def sampled_ray_cells(points: DataFrame, resolution: float, steps: int = 40, pose: str = "odom") -> DataFrame:
    """The same by ``steps`` evenly spaced samples of each ray, rounded half to even; the last sample is the endpoint.

    A cell counts once per ray as free, and once per scan as hit.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")
    at = {c: F.col(f"{pose}.{c}") + (F.col(c) - F.col(f"{pose}.{c}")) * F.col("i") / (steps - 1) for c in "xy"}
    cells = points.select("scan_id", "sensor_id", "beam", "x", "y", pose, t).select("scan_id", "sensor_id", "beam", *[F.bround(F.round(at[c] / resolution, 6), 0).cast("bigint").alias(f"g{c}") for c in "xy"], (F.col("i") == steps - 1).alias("hit"))
    free = cells.where("NOT hit").distinct()
    hit = cells.where("hit").select("scan_id", "sensor_id", F.lit(-1).alias("beam"), "gx", "gy", "hit").distinct()
    return free.unionByName(hit)


#: Cells of rays that are made at once in a kernel.
RAY_CELLS = 2_000_000


def _count_lines(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, cell, free and hits of lines between cells, those of equal group and cell added up."""
    dx, dy = x1 - x0, y1 - y0
    n = np.maximum(np.abs(dx), np.abs(dy))
    row = np.repeat(np.arange(len(n)), n + 1)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    m = np.maximum(n, 1)[row]
    at = lambda start, d: start[row] + np.sign(d)[row] * ((np.abs(d)[row] * i * 2 + n[row]) // (2 * m))
    gx, gy, hit = at(x0, dx), at(y0, dy), i == n[row]
    left, low = gx.min(), gy.min()
    wide, high = int(gx.max() - left) + 1, int(gy.max() - low) + 1
    code = group[row]
    size = (int(code.max()) + 1) * wide * high
    if size <= 8 * len(row):  # a dense table of counts
        key = (code * wide + (gx - left)) * high + (gy - low)
        hits, total = np.bincount(key[hit], minlength=size), np.bincount(key, minlength=size)
        at_key = np.flatnonzero(total)
        return at_key // (wide * high), at_key // high % wide + left, at_key % high + low, (total - hits)[at_key], hits[at_key]
    order = np.lexsort((gy, gx, code))
    code, gx, gy, hit = code[order], gx[order], gy[order], hit[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(gx) != 0) | (np.diff(gy) != 0)]))
    hits = np.add.reduceat(hit.astype(np.int64), begin)
    return code[begin], gx[begin], gy[begin], np.diff(np.append(begin, len(code))) - hits, hits


def count_rays(points: DataFrame, resolution: float, by: str, pose: str = "odom") -> DataFrame:
    """(by, gx, gy, free, hits): partial counts of the cells that rays pass and end in, the cells being those of ``ray_cells``.

    The lines are walked in Arrow batches and added up there, so counts of cells
    are shuffled and not visits.
    """
    start = [geom.cell(F.col(f"{pose}.{c}"), resolution) for c in "xy"]
    end = [geom.cell(F.col(c), resolution) for c in "xy"]
    rays = points.select(F.col(by), *[v.alias(c) for v, c in zip(start + end, ("x0", "y0", "x1", "y1"))]).dropna(subset=["x0", "y0", "x1", "y1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            group = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            x0, y0, x1, y1 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            size = np.cumsum(np.maximum(np.abs(x1 - x0), np.abs(y1 - y0)) + 1)
            for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(size // RAY_CELLS)) + 1):
                if len(part):
                    code, *rest = _count_lines(group[part], x0[part], y0[part], x1[part], y1[part])
                    key = names.dictionary.take(pa.array(code, mask=code == len(names.dictionary)))
                    yield pa.record_batch([key, *[pa.array(v, pa.int64()) for v in rest]], names=[by, "gx", "gy", "free", "hits"])

    ship_package(points.sparkSession)
    return rays.mapInArrow(run, f"`{by}` {dict(points.dtypes)[by]}, gx BIGINT, gy BIGINT, free BIGINT, hits BIGINT")


def occupancy_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """Log odds of each cell from its counts, clipped once: sums move, not rows, and order doesn't matter.

    ``cells``: visits with ``hit`` or partial counts ``free`` and ``hits``.
    """
    counts = (F.sum("free"), F.sum("hits")) if "hits" in cells.columns else (F.count_if(~F.col("hit")), F.count_if("hit"))
    counted = cells.groupBy(*by, "gx", "gy").agg(counts[0].alias("free"), counts[1].alias("hits"))
    total = F.col("free") * LOG_ODDS_FREE + F.col("hits") * LOG_ODDS_HIT
    return counted.withColumn("l", F.greatest(F.lit(-LOG_ODDS_MOST), F.least(F.lit(LOG_ODDS_MOST), total)))


def occupancy_fold(cells: DataFrame, by: list[str], order: str, inner: str) -> DataFrame:
    """Log odds of each cell when every visit is clipped at once, in the order of ``order`` (an id, not negative), then ``inner``.

    A visit with its clip is a map x -> max(lo, min(hi, x + d)), and such maps
    compose to another one. So a cell's visits are folded by id first, the ids'
    maps by thousands, those by millions, and so on: no array holds more than
    1024 of them, however often a cell is seen.
    """
    delta = F.when(F.col("hit"), F.lit(LOG_ODDS_HIT)).otherwise(F.lit(LOG_ODDS_FREE))
    keys = [*by, "gx", "gy"]
    return fold_deltas(cells.select(*keys, F.col(order).cast("bigint").alias("_at"), F.col(inner).cast("bigint").alias("_then"), delta.alias("_delta")), keys)


#: Entries of one fold, and the levels of the tree that bring 2 ** 50 ids down to one map.
FOLD_BITS, FOLD_LEVELS = 10, 5


def fold_deltas(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of each key's deltas in the order of (_at, _then), clipped after each: (keys, visits, l). ``_at`` is not negative.

    Entries are folded by ``_at`` first; while some key still has more than one,
    they are folded by thousands.
    """
    least, most = F.lit(-LOG_ODDS_MOST), F.lit(LOG_ODDS_MOST)
    clip = lambda x, a, b: F.greatest(a, F.least(b, x))
    fields = lambda d, lo, hi: F.struct(d.alias("d"), lo.alias("lo"), hi.alias("hi"))
    start = fields(F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf")))
    then = lambda m, e: fields(m["d"] + e["d"], clip(m["lo"] + e["d"], e["lo"], e["hi"]), clip(m["hi"] + e["d"], e["lo"], e["hi"]))
    # the first level groups by blocks of ids at once: an entry of the list is a visit, so blocks are small
    maps = deltas.select(*keys, F.col("_at"), F.col("_then"), fields(F.col("_delta"), least, most).alias("_m"), F.lit(1).cast("bigint").alias("_n"))
    for level in range(FOLD_LEVELS):
        group = F.col("_at") if level == 0 else F.shiftright("_at", FOLD_BITS)
        entry = F.struct(F.col("_then" if level == 0 else "_at").alias("at"), "_m.d", "_m.lo", "_m.hi")
        folded = maps.groupBy(*keys, group.alias("_at")).agg(F.array_sort(F.collect_list(entry)).alias("_e"), F.sum("_n").alias("_n"))
        maps = folded.select(*keys, "_at", F.aggregate("_e", start, then).alias("_m"), "_n")
    # ids up to 2 ** 40 are now one or a few maps
    last = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_m.d", "_m.lo", "_m.hi"))).alias("_e"), F.sum("_n").alias("visits"))
    done = F.aggregate("_e", start, then)
    return last.select(*keys, "visits", clip(done["d"], done["lo"], done["hi"]).alias("l"))


def merge_tiles(cells: DataFrame, poses: DataFrame, tile: str, resolution: float, neutral: float = 1e-9) -> DataFrame:
    """Cells of all tiles moved by their tile's pose and summed, clipped, with probability; cells without evidence are left out."""
    placed = cells.where(F.abs("l") > neutral).join(poses, tile)
    x, y = geom.se2_apply(F.col("pose"), (F.col("gx") + 0.5) * resolution, (F.col("gy") + 0.5) * resolution)
    moved = placed.withColumns({"mx": geom.cell(x, resolution), "my": geom.cell(y, resolution)})
    total = moved.groupBy(F.col("mx").alias("gx"), F.col("my").alias("gy")).agg(F.sum("l").alias("l"))
    clipped = total.withColumn("l", F.greatest(F.lit(-MERGED_MOST), F.least(F.lit(MERGED_MOST), F.col("l"))))
    return clipped.withColumn("p", geom.probability(F.col("l")))


def max_pool(cells: DataFrame, by: list[str], value: str = "l") -> DataFrame:
    """Greatest value of each two by two block."""
    return cells.groupBy(*by, F.floor(F.col("gx") / 2).alias("gx"), F.floor(F.col("gy") / 2).alias("gy")).agg(F.max(value).alias(value))


def forward_max(cells: DataFrame, by: list[str], width: int, value: str = "l") -> DataFrame:
    """Greatest value of the ``width`` by ``width`` cells from each cell on, on sparse cells: every cell offers its value to those before it."""
    back = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i)
    spread = cells.withColumn("dx", F.explode(back)).withColumn("gx", F.col("gx") - F.col("dx")).groupBy(*by, "gx", "gy").agg(F.max(value).alias(value))
    return spread.withColumn("dy", F.explode(back)).withColumn("gy", F.col("gy") - F.col("dy")).groupBy(*by, "gx", "gy").agg(F.max(value).alias(value))


def occupied_share(cells: DataFrame, by: list[str], threshold: float = 0.65) -> DataFrame:
    """Cells, occupied cells and their share of the bounding rectangle."""
    p = geom.probability(F.col("l"))
    area = (F.max("gx") - F.min("gx") + 1) * (F.max("gy") - F.min("gy") + 1)
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(p >= threshold).alias("occupied"), area.alias("area")).withColumn("share", F.col("occupied") / F.col("area"))


def ring_sector(points: DataFrame, rings: int = 20, sectors: int = 60, radius: float = 20.0) -> DataFrame:
    """Scan context: the distinct (scan_id, ring, sector) that hold a point."""
    r = F.hypot("x", "y")
    ring = F.least(F.lit(rings - 1), F.floor(F.round(r / (radius / rings), 6)))
    turn = F.round(F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)) / (2 * math.pi / sectors), 6)
    return points.where((r > 0.05) & (r <= radius)).select("scan_id", ring.cast("int").alias("ring"), F.least(F.lit(sectors - 1), F.floor(turn)).cast("int").alias("sector")).distinct()


def best_shift(pairs: DataFrame, context: DataFrame, sectors: int = 60) -> DataFrame:
    """Best cyclic shift and cosine of the scan contexts of each pair (a, b); the smallest of equally good shifts."""
    size = context.groupBy("scan_id").agg(F.count("*").alias("n"))
    one = context.select(F.col("scan_id").alias("a"), "ring", F.col("sector").alias("sa"))
    two = context.select(F.col("scan_id").alias("b"), "ring", F.col("sector").alias("sb"))
    met = pairs.join(one, "a").join(two, ["b", "ring"]).groupBy("a", "b", F.pmod(F.col("sa") - F.col("sb"), F.lit(sectors)).alias("shift")).agg(F.count("*").alias("common"))
    best = met.groupBy("a", "b").agg(F.max(F.struct(F.col("common"), (-F.col("shift")).alias("order"))).alias("m"))
    na, nb = size.select(F.col("scan_id").alias("a"), F.col("n").alias("na")), size.select(F.col("scan_id").alias("b"), F.col("n").alias("nb"))
    return best.join(na, "a").join(nb, "b").select("a", "b", (-F.col("m.order")).alias("shift"), (F.col("m.common") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"))


def radius_nearest(queries: DataFrame, points: DataFrame, by: str, radius: float, k: int, gap: int, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """For each query the ``k`` nearest points within ``radius`` that come at least ``gap`` places earlier in its group.

    Both sides carry id, ord and axes. Points meet through grid cells of the
    radius' size: a query looks into its own cell and those around it. Ties go
    to the smaller id. Returns (query_id, point_id, distance, place).
    """
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    q = queries.select(F.col(by).alias("e"), F.col("id").alias("query_id"), F.col("ord").alias("q_ord"), *[F.col(a).alias(f"q_{a}") for a in axes])
    for a in axes:
        q = q.withColumn("o", F.explode(around)).withColumn(f"c_{a}", F.floor(F.col(f"q_{a}") / radius) + F.col("o")).drop("o")
    p = points.select(F.col(by).alias("e"), F.col("id").alias("point_id"), "ord", *axes, *[F.floor(F.col(a) / radius).alias(f"c_{a}") for a in axes])
    square = F.lit(0.0)
    for a in axes:
        square = square + (F.col(a) - F.col(f"q_{a}")) * (F.col(a) - F.col(f"q_{a}"))
    met = q.join(p, ["e", *[f"c_{a}" for a in axes]]).where(F.col("ord") < F.col("q_ord") - gap).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    # Spark keeps only k rows per query before the shuffle (window group limit)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "point_id"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("query_id", "point_id", "distance", "place")


def spaced_ray_cells(points: DataFrame, resolution: float, steps: int, pose: str = "odom") -> DataFrame:
    """(scan_id, sensor_id, beam, gx, gy, hit) of ``steps`` cells of each ray, evenly spaced along its line and rounded down; shorter lines have all of theirs."""
    start = [geom.cell(F.col(f"{pose}.{c}"), resolution) for c in "xy"]
    end = [geom.cell(F.col(c), resolution) for c in "xy"]
    rays = points.withColumns({"x0": start[0], "y0": start[1], "x1": end[0], "y1": end[1]})
    rays = rays.withColumn("n", F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))
    thin = F.col("n") + 1 > steps
    i = F.transform(F.sequence(F.lit(0).cast("bigint"), F.when(thin, F.lit(steps - 1).cast("bigint")).otherwise(F.col("n"))), lambda k: F.when(thin, F.floor(k * F.col("n") / (steps - 1) + 1e-9)).otherwise(k))
    at = lambda d, k: F.when(F.col("n") == 0, F.lit(0)).otherwise(F.signum(d).cast("bigint") * F.floor((F.abs(d) * k * 2 + F.col("n")) / (F.col("n") * 2)).cast("bigint"))
    walked = rays.select("scan_id", "sensor_id", "beam", "x0", "y0", "x1", "y1", "n", F.explode(i).alias("k"))
    return walked.select(
        "scan_id", "sensor_id", "beam", (F.col("x0") + at(F.col("x1") - F.col("x0"), F.col("k"))).alias("gx"), (F.col("y0") + at(F.col("y1") - F.col("y0"), F.col("k"))).alias("gy"), (F.col("k") == F.col("n")).alias("hit"),
    )


def occupancy_by_scan(cells: DataFrame, by: list[str]) -> DataFrame:
    """Log odds of each cell when the counts of every scan are added and clipped once per scan, in the order of their ids.

    A scan is counted before anything moves; its clipped sum is one entry of the fold.
    """
    keys = [*by, "gx", "gy"]
    delta = F.sum(F.when(F.col("hit"), F.lit(LOG_ODDS_HIT)).otherwise(F.lit(LOG_ODDS_FREE)))
    per = cells.groupBy(*keys, "scan_id").agg(delta.alias("_delta"))
    return fold_deltas(per.select(*keys, F.col("scan_id").cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_then"), "_delta"), keys)


def voxels_from_origin(points: DataFrame, size: float, by: list[str], axes: list[str], colours: list[str], least: int = 2) -> DataFrame:
    """Voxels counted from each cloud's own least corner: mean point, mean colours rounded down, count; those of fewer than ``least`` points are left out."""
    corner = points.groupBy(*by).agg(*[F.min(a).alias(f"_{a}") for a in axes])
    keys = {f"v{a}": F.floor(F.round((F.col(a) - F.col(f"_{a}")) / size, 6)).cast("bigint") for a in axes}
    out = meet(points, corner, by).withColumns(keys).groupBy(*by, *keys).agg(*[F.avg(a).alias(a) for a in axes], *[F.floor(F.avg(c)).cast("int").alias(c) for c in colours], F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def crop(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points strictly within fixed bounds of some axes."""
    inside = F.lit(True)
    for a, (lo, hi) in bounds.items():
        inside = inside & (F.col(a) > lo) & (F.col(a) < hi)
    return points.where(inside)


def compare_cells(maps: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Cells (by, gx, gy) of several maps: per group how many each has, all have and any has."""
    tagged = [m.select(*by, "gx", "gy", F.lit(name).alias("map")).distinct() for name, m in maps.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    held = both.groupBy(*by, "gx", "gy").agg(*[F.bool_or(F.col("map") == name).alias(f"in_{name}") for name in maps])
    everywhere = F.lit(True)
    for name in maps:
        everywhere = everywhere & F.col(f"in_{name}")
    return held.groupBy(*by).agg(*[F.count_if(f"in_{name}").alias(name) for name in maps], F.count_if(everywhere).alias("shared"), F.count("*").alias("any"))


def depth_points(images: DataFrame, pixels: str, row: str, by: list[str], camera: tuple[float, float, float, float], *, stride: int, least: float, most: float) -> DataFrame:
    """Camera points of depth images held as rows of pixels, on a stride grid, with depths strictly between ``least`` and ``most``: (by, u, v, x, y, z)."""
    fx, fy, cx, cy = camera
    seen = images.where(F.col(row) % stride == 0).select(*by, F.col(row).cast("int").alias("v"), F.posexplode(pixels).alias("u", "z")).where((F.col("u") % stride == 0) & (F.col("z") > least) & (F.col("z") < most))
    return seen.select(*by, "u", "v", ((F.col("u") - cx) / fx * F.col("z")).alias("x"), ((F.col("v") - cy) / fy * F.col("z")).alias("y"), "z")


def depth_lookup(pixels: Column, u: Column, factor: float = 1.0, most: float | None = None) -> Column:
    """Depth at the nearest pixel of a row, halves going to the even one; null off the row, without a positive depth, or beyond ``most``."""
    i = F.bround(u, 0).cast("int")
    z = F.when((i >= 0) & (i < F.size(pixels)), F.try_element_at(pixels, i + 1) / factor)
    ok = (z > 0) & ~F.isnan(z)
    return F.when(ok if most is None else ok & (z <= most), z)


def fuse_signed_distance(points: DataFrame, by: list[str], resolution: float, truncation: float, pose: str = "odom") -> DataFrame:
    """Truncated signed distance to the surface, averaged per cell: each ray marks the cells within ``truncation`` before (positive) and behind its end.

    ``points``: by, x, y in the scan's own frame, and its pose. Returns (by, gx, gy, sdf, weight), sdf in shares of the truncation.
    """
    n = round(truncation / resolution)
    r = F.hypot("x", "y")
    along = points.where(r > 0).withColumn("k", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("_f", (r + F.col("k") * resolution) / r).where("_f > 0")
    wx, wy = geom.se2_apply(F.col(pose), F.col("x") * F.col("_f"), F.col("y") * F.col("_f"))
    at = along.where(F.col(f"{pose}.x").isNotNull() & F.col(f"{pose}.y").isNotNull() & F.col(f"{pose}.theta").isNotNull()).select(*by, geom.cell(wx, resolution).alias("gx"), geom.cell(wy, resolution).alias("gy"), (-F.col("k") / float(n)).alias("d"))
    return at.groupBy(*by, "gx", "gy").agg(F.avg("d").alias("sdf"), F.count("*").alias("weight"))


def clean_surface(field: DataFrame, by: list[str], level: float, least: int) -> DataFrame:
    """Surface cells of a distance field: |sdf| under ``level``, seen ``least`` times, with another such cell among the eight around."""
    hit = field.where((F.abs("sdf") < level) & (F.col("weight") >= least))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    near = hit.select(*by, "gx", "gy", around.alias("o")).select(*by, (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy")).distinct()
    return hit.join(near, [*by, "gx", "gy"], "left_semi")
