"""Implausible readings of beam sensors: impossible, stuck, and spikes by robust principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import ranked

#: Consecutive scans of a source in one profile matrix, and rows of context on either side.
BLOCK_ROWS, CONTEXT_ROWS = 512, 32
#: Readings that make a level, and the fewest that do at the ends of a series.
LEVEL_ROWS, LEVEL_LEAST = 9, 3
STUCK_ROWS = 8
#: A spike differs from both levels by more than this many scatters, for at most so many scans.
SPIKE_FACTOR, SPIKE_ROWS = 10.0, 3
#: The sparse part are departures from the low-rank part of more than so many scatters; rounds of the decomposition at most.
CANDIDATE_FACTOR, ROUNDS = 4.0, 30
#: MAD to standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def robust_components(m: np.ndarray, scatter: float, level: np.ndarray | None = None, least: float | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Splits a complete matrix into low-rank normal behaviour and sparse departures of more than ``least``; the rest is noise of the given scatter.

    Alternating projections: the departures from the present normal behaviour are
    taken out where they exceed a limit (a hard threshold, so nothing of them is
    left for the low-rank part to follow), and what remains is projected onto its
    singular vectors above the spectral norm of pure noise. Where a ``level`` of
    every entry is known, the first departures are those from it, so not even a
    glitch of a whole scan enters the low-rank part. Else the limit falls from the
    greatest departure to ``least``, and singular values are lowered by that norm,
    so that departures stand out little by little. Ends when they settle.
    """
    rows, cols = m.shape
    least = CANDIDATE_FACTOR * scatter if least is None else least
    tau = scatter * (np.sqrt(rows) + np.sqrt(cols))
    low = m if level is None else level
    limit = max(np.abs(m - np.median(m, axis=0)).max(initial=0.0), least) if level is None else least
    away = np.abs(m - low) > limit
    for _ in range(rounds):
        rest = np.where(away, low, m)
        values, vectors = np.linalg.eigh(rest.T @ rest)
        size = np.sqrt(np.maximum(values, 0.0))
        basis, size = vectors[:, size > tau], size[size > tau]
        low = (rest @ basis) @ basis.T if level is not None else ((rest @ basis) * ((size - tau) / size)) @ basis.T
        last, limit = limit == least, max(0.5 * limit, least)
        before, away = away, np.abs(m - low) > limit
        if last and (before == away).all():
            break
    return low, np.where(away, m - low, 0.0)


def levels(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the readings just before and just after each reading; NaN where there are too few."""
    n, k = len(y), LEVEL_ROWS
    before, after = np.full(n, np.nan), np.full(n, np.nan)
    if n > k:
        run = np.sort(np.lib.stride_tricks.sliding_window_view(y, k), axis=1)[:, k // 2]
        before[k:], after[: n - k] = run[:-1], run[1:]
    for i in range(LEVEL_LEAST, min(k, n)):
        before[i] = np.median(y[:i])
        after[n - 1 - i] = np.median(y[n - i :])
    return before, after


def stuck_runs(m: np.ndarray, least: int = STUCK_ROWS) -> np.ndarray:
    """Entries that belong to a run of at least ``least`` equal values down a column; NaN ends a run."""
    rows = m.shape[0]
    at = np.arange(rows)[:, None]
    breaks = np.ones(m.shape, bool)
    breaks[1:] = m[1:] != m[:-1]
    start = np.maximum.accumulate(np.where(breaks, at, 0), axis=0)
    ends = np.ones(m.shape, bool)
    ends[:-1] = breaks[1:]
    end = np.minimum.accumulate(np.where(ends, at, rows - 1)[::-1], axis=0)[::-1]
    return (end - start + 1 >= least) & ~np.isnan(m)


def _dense(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the readings, and which of them exist; arrays shorter than the longest end early."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    inside = np.arange(max(size.max(initial=0), 1)) < size[:, None]
    m, has = np.full(inside.shape, np.nan), np.zeros(inside.shape, bool)
    m[inside] = flat.to_numpy(zero_copy_only=False)
    has[inside] = there
    return m, has


OUT = pa.schema([
    ("source", pa.string()), ("scan", pa.int64()), ("beam", pa.int32()), ("reason", pa.string()), ("value", pa.float64()),
    ("level", pa.float64()), ("scatter", pa.float64()), ("weight", pa.int64()), ("away", pa.list_(pa.float64())), ("block", pa.int64()),
])


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Flags of a block; with a column ``bar`` (the source's usual limit of a spike), only the spikes by that limit."""
    table = table.sort_by("rank")
    bar = table["bar"][0].as_py() if "bar" in table.column_names else None
    home = table["home"].to_numpy(zero_copy_only=False)
    m, has = _dense(table["ranges"])
    lo, hi = (table[c].to_numpy(zero_copy_only=False)[:, None] for c in ("least", "most"))
    with np.errstate(invalid="ignore"):
        legal_end = has & (m == hi)
        broken = has & ~np.isfinite(m)
        impossible = broken | (has & ((m < lo) | (m > hi)))
    value = np.where(has, m, np.nan)
    stuck = stuck_runs(value) & ~legal_end & ~broken
    good = has & ~impossible & ~legal_end
    y = np.where(good, m, np.nan)
    away, level, spread = {}, np.full(m.shape, np.nan), []
    series = []
    for b in range(m.shape[1]):
        at = np.flatnonzero(good[:, b])
        x = y[at, b]
        before, after = levels(x)
        series.append((at, x, before, after))
        level[at, b] = np.where(np.isnan(before), after, before)
        spread.append((x - before)[home[at]])
    spread = np.concatenate(spread) if spread else np.empty(0)
    spread = np.abs(spread[np.isfinite(spread)])
    scatter = float(MAD_SCALE * np.median(spread)) if len(spread) else 0.0
    candidate = np.zeros(m.shape, bool)
    least = CANDIDATE_FACTOR * scatter if bar is None else CANDIDATE_FACTOR / SPIKE_FACTOR * bar
    if least > 0 and good.any():
        used = good.sum(axis=0) > 2 * LEVEL_LEAST
        full, usual = (np.empty((m.shape[0], int(used.sum()))) for _ in range(2))
        for j, b in enumerate(np.flatnonzero(used)):
            at, x, before, after = series[b]
            full[:, j] = np.interp(np.arange(m.shape[0]), at, x)
            # the nearer of a reading's two levels
            near = np.where(np.isnan(before) | (np.abs(x - after) < np.abs(x - before)), after, before)
            usual[:, j] = np.interp(np.arange(m.shape[0]), at, near)
        if full.shape[1]:
            candidate[:, used] = robust_components(full, scatter, usual, least)[1] != 0
    candidate &= good & home[:, None]
    if bar is not None:
        impossible, stuck = np.zeros(m.shape, bool), np.zeros(m.shape, bool)
    found = []
    for b in np.flatnonzero(candidate.any(axis=0)):
        at, x, before, after = series[b]
        for i in np.flatnonzero(candidate[at, b] & np.isfinite(before) & np.isfinite(after)):
            # how far the readings around lie from the nearer of this one's two levels
            near = np.full(2 * SPIKE_ROWS + 1, 0.0)
            j0, j1 = max(0, i - SPIKE_ROWS), min(len(x), i + SPIKE_ROWS + 1)
            near[j0 - i + SPIKE_ROWS : j1 - i + SPIKE_ROWS] = np.minimum(np.abs(x[j0:j1] - before[i]), np.abs(x[j0:j1] - after[i]))
            if near[SPIKE_ROWS] > 0:
                found.append((at[i], b, near))
    scan = table["scan"].to_numpy()
    r1, c1 = np.nonzero(impossible & home[:, None])
    r2, c2 = np.nonzero(stuck & home[:, None])
    r3, c3 = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
    rows, cols = np.concatenate([r1, r2, r3]), np.concatenate([c1, c2, c3])
    n = len(rows) + 1
    return pa.table([
        pa.array([key[0].as_py()] * n, pa.string()),
        pa.array(np.append(scan[rows], 0)),
        pa.array(np.append(cols, -1).astype(np.int32)),
        pa.array(["impossible"] * len(r1) + ["stuck"] * len(r2) + ["spike"] * len(r3) + ["scatter"]),
        pa.array(np.append(m[rows, cols], np.nan), from_pandas=False),
        pa.array(np.append(level[rows, cols], np.nan)),
        pa.array([scatter] * n),
        pa.array([len(spread)] * n, pa.int64()),
        pa.array([None] * (len(r1) + len(r2)) + [f[2].tolist() for f in found] + [None], pa.list_(pa.float64())),
        pa.array([key[1].as_py()] * n, pa.int64()),
    ], schema=OUT)


def _usual(blocks: DataFrame) -> DataFrame:
    """Median scatter of each source's blocks, weighed by their readings, to a thousandth of its value."""
    cell = F.when(F.col("scatter") > 0, F.round(F.ln("scatter") * 1000)).otherwise(F.lit(-1e9))
    cells = blocks.groupBy("source", cell.alias("cell")).agg(F.sum("weight").alias("w"), F.max("scatter").alias("usual"))
    of_source = Window.partitionBy("source")  # cells are bounded by their width, however many blocks there are
    run = cells.withColumns({"upto": F.sum("w").over(of_source.orderBy("cell")), "all": F.sum("w").over(of_source)})
    return run.where("2 * upto >= all AND 2 * (upto - w) < all").select("source", "usual")


def implausible_readings(scans: DataFrame, datasets: DataFrame) -> DataFrame:
    """Flags readings of ``scans.ranges`` that are impossible, stuck or spikes, per scan and beam.

    ``scans``: scan_id, sensor_id, dataset, t, ranges; ``datasets``: name,
    range_min, range_max. Scans whose id, sensor or t is null or t is NaN, and
    scans without readings (null or empty) don't count; scan ids count once.

    impossible: NaN, infinite, or outside the limits of the dataset (limits that
    are null or of an unknown dataset are not tested). stuck: in a run of at
    least ``STUCK_ROWS`` scans with the same value; a missing reading ends it.
    spike: an entry of the sparse part of the robust principal components of the
    source's matrix of consecutive profiles (blocks with much more or no scatter
    of their own are split again by the usual one), then checked exactly against
    the levels before and after it and the source's usual scatter. Readings of just
    range_max mean "no return" and are never flagged.

    Returns (sensor_id, scan_id, beam, reason, value, level, scatter); a reading
    can have several reasons. Extra columns are ignored.
    """
    limits = datasets.groupBy(F.col("name").alias("dataset")).agg(F.min("range_min").alias("least"), F.max("range_max").alias("most"))
    usable = scans.where(
        F.col("scan_id").isNotNull() & F.col("sensor_id").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & (F.size("ranges") > 0)
    )
    once = usable.select(F.col("scan_id").alias("scan"), F.col("sensor_id").alias("source"), "dataset", "t", F.col("ranges").cast("array<double>").alias("ranges"))
    # deliveries that differ count with the least of them
    once = once.groupBy("scan").agg(F.min(F.struct("source", "t", "dataset", "ranges")).alias("d")).select("scan", "d.*")
    placed = ranked(once, "source", ["t", "scan"]).join(limits, "dataset", "left")
    placed = placed.withColumns({"least": F.coalesce("least", F.lit(float("-inf"))), "most": F.coalesce("most", F.lit(float("inf")))})
    own = F.expr(f"rank div {BLOCK_ROWS}")
    reached = F.sequence(
        F.greatest(F.lit(0), F.expr(f"(rank - {CONTEXT_ROWS}) div {BLOCK_ROWS}")).cast("bigint"), F.expr(f"(rank + {CONTEXT_ROWS}) div {BLOCK_ROWS}"),
    )
    spread = placed.withColumn("block", F.explode(reached)).withColumn("home", F.col("block") == own)
    ddl = "source STRING, scan BIGINT, beam INT, reason STRING, value DOUBLE, level DOUBLE, scatter DOUBLE, weight BIGINT, away ARRAY<DOUBLE>, block BIGINT"
    matrix = ["source", "block", "rank", "home", "scan", "ranges", "least", "most"]
    found = cut(spread.select(*matrix).groupBy("source", "block").applyInArrow(_block, ddl))
    # the usual scatter of a source: the median over its blocks, each weighing as many readings as it has
    usual = _usual(found.where("reason = 'scatter' AND weight > 0"))
    # blocks that may have left out readings beyond the usual scatter's limit
    again = found.where("reason = 'scatter'").join(usual, "source").where((F.col("usual") > 0) & ((F.col("scatter") == 0) | (CANDIDATE_FACTOR * F.col("scatter") > SPIKE_FACTOR * F.col("usual"))))
    again = cut(again.select("source", "block", (SPIKE_FACTOR * F.col("usual")).alias("bar")))
    if not again.isEmpty():
        more = spread.join(again, ["source", "block"]).select(*matrix, "bar").groupBy("source", "block").applyInArrow(_block, ddl).where("reason = 'spike'")
        spikes = F.col("reason") == "spike"
        found = found.join(again.select("source", "block", F.lit(True).alias("redone")), ["source", "block"], "left").where(~spikes | F.col("redone").isNull()).drop("redone").unionByName(more)
    rows = found.where("reason <> 'scatter'").join(usual, "source", "left")
    k = SPIKE_ROWS
    over = F.transform("away", lambda x: x > F.lit(SPIKE_FACTOR) * F.col("usual"))
    # the run of departures around the middle, as far as it can matter
    left = F.aggregate(F.reverse(F.slice(over, 1, k)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x, 1).otherwise(0)).alias("n"), (a["on"] & x).alias("on")))["n"]
    right = F.aggregate(F.slice(over, k + 2, k), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x, 1).otherwise(0)).alias("n"), (a["on"] & x).alias("on")))["n"]
    spike = F.element_at(over, k + 1) & (left + right + 1 <= k)
    return rows.where((F.col("reason") != "spike") | spike).select(
        F.col("source").alias("sensor_id"), F.col("scan").alias("scan_id"), "beam", "reason", "value", "level", F.col("usual").alias("scatter"),
    )
