"""Nearest record in time of the same entity, by a learned index per entity-time shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import ranked
from ..session import cut

#: Slack added to the overlap of shards, far above the rounding of epoch seconds.
SLACK = 1e-6
#: Shards of more rows than this are cut into parts of this many rows.
SHARD_ROWS = 400_000
#: Hot shards, of which there are at most (rows of the input / SHARD_ROWS), are broadcast up to this number.
HOT_SHARDS = 100_000


def fit_segments(keys: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and slopes of a piecewise-linear model of positions over sorted distinct keys.

    A segment's line runs from its first to its last point. Segments that miss
    some position by more than ``error`` are halved until none does; one of at
    most ``error + 1`` points can't, so this ends.
    """
    n = len(keys)
    starts = np.zeros(1, np.int64)
    position = np.arange(n, dtype=np.float64)
    while True:
        ends = np.append(starts[1:], n) - 1
        run = keys[ends] - keys[starts]
        with np.errstate(over="ignore", invalid="ignore"):
            slopes = np.where(run > 0, (ends - starts) / np.where(run > 0, run, 1.0), 0.0)
        slopes[~np.isfinite(slopes)] = 0.0  # keys closer than a division can tell: the bound then comes from halving
        size = ends - starts + 1
        with np.errstate(over="ignore"):
            miss = np.abs(np.repeat(starts + 0.0, size) + (keys - np.repeat(keys[starts], size)) * np.repeat(slopes, size) - position)
        bad = (np.maximum.reduceat(miss, starts) > error) & (size > error + 1)
        if not bad.any():
            return starts, slopes
        starts = np.sort(np.concatenate([starts, (starts + (size + 1) // 2)[bad]]))


def positions(keys: np.ndarray, queries: np.ndarray, error: int) -> np.ndarray:
    """For each query the number of keys below it, by predicted position and a bounded local search."""
    starts, slopes = fit_segments(keys, error)
    ends = np.append(starts[1:], len(keys))
    seg = np.clip(np.searchsorted(keys[starts], queries, side="right") - 1, 0, None)
    with np.errstate(over="ignore"):
        guess = starts[seg] + (queries - keys[starts][seg]) * slopes[seg]
    first, last = starts[seg], ends[seg]
    # the model errs by at most `error` at keys, hence by one more between two of them
    lo = np.clip(np.floor(guess) - error - 1, first, last).astype(np.int64)
    hi = np.clip(np.ceil(guess) + error + 2, first, last).astype(np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        below = open_ & (keys[np.minimum(mid, len(keys) - 1)] < queries)
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)


def nearest(keys: np.ndarray, queries: np.ndarray, error: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest key of each query, the earlier of two equally near ones, and the distance."""
    at = positions(keys, queries, error)
    left, right = np.clip(at - 1, 0, None), np.clip(at, None, len(keys) - 1)
    d_left, d_right = np.abs(queries - keys[left]), np.abs(keys[right] - queries)
    earlier = d_left <= d_right
    return np.where(earlier, left, right), np.where(earlier, d_left, d_right)


def _shard_kernel(tolerance: float, error: int):
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("match", pa.int64()), ("dt", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        side, ts, ident = (table.column(c).to_numpy() for c in ("side", "ts", "id"))
        right = side < 0
        keys, match = ts[right], ident[right]
        if not len(keys) or right.all():
            return schema.empty_table()
        order = np.argsort(keys, kind="stable")
        keys, match = keys[order], match[order]
        at, dt = nearest(keys, ts[~right], error)
        ok = dt <= tolerance
        return pa.table([side[~right][ok], ident[~right][ok], match[at[ok]], dt[ok]], schema=schema)

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    tolerance: float,
    *,
    shard_seconds: float = 1024.0,
    shard_rows: int = SHARD_ROWS,
    error: int = 16,
) -> DataFrame:
    """Pairs every left record with the nearest right record of its entity within ``tolerance`` seconds.

    ``left``: (kind INT >= 0, id BIGINT, entity, ts DOUBLE); ``right``: (id, entity, ts).
    The nearest right record is the one with the least absolute difference, then
    the earlier, then the one with the smaller id. Repeated left rows count once
    per (kind, id, entity, ts); of right rows with equal entity and ts only the
    smallest id can be nearest. Rows whose id, entity or ts is null, or whose ts
    is NaN or infinite, take no part. Either side may be empty.

    Shards are spans of ``shard_seconds`` of an entity. Right rows near an edge
    are also sent to the shard beyond it, so every neighbour within the tolerance
    is at hand. A shard with too many rows, left and right together, is put in
    order by a range sort and cut into parts of ``shard_rows`` rows, each with the
    last right row before it and the first one after it, which are all it can need
    of the others. So no task grows with a hot entity or a hot moment, be it a
    burst of right rows or of left rows.

    Returns (kind, id, match, dt).
    """
    if tolerance < 0 or shard_seconds <= 0 or shard_rows < 1:
        raise ValueError("tolerance must not be negative, shard_seconds and shard_rows positive")
    reach = tolerance + SLACK

    def usable(df: DataFrame) -> DataFrame:
        ts = F.col("ts")
        return df.where(F.col("id").isNotNull() & F.col("entity").isNotNull() & ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 1e15))

    def cell(ts: Column) -> Column:
        return F.floor(ts / F.lit(float(shard_seconds)))

    a = usable(left).select(F.col("kind").alias("side"), F.col("id").cast("bigint").alias("id"), "entity", "ts").distinct()
    b = usable(right).groupBy("entity", "ts").agg(F.min(F.col("id").cast("bigint")).alias("id")).withColumn("side", F.lit(-1))
    a = a.withColumn("cell", cell(F.col("ts")))
    b = b.withColumn("cell", F.explode(F.sequence(cell(F.col("ts") - reach), cell(F.col("ts") + reach))))
    columns = ["entity", "cell", "side", "id", "ts"]
    both = a.select(*columns).unionByName(b.select(*columns))
    kernel, ddl = _shard_kernel(tolerance, error), "kind INT, id BIGINT, match BIGINT, dt DOUBLE"
    # sizes are taken from the raw rows: an upper bound but for the rows that reach over an edge, and one cheap scan
    raw = usable(left).select("entity", cell(F.col("ts")).alias("cell")).unionByName(usable(right).select("entity", cell(F.col("ts")).alias("cell")))
    hot = cut(raw.groupBy("entity", "cell").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select("entity", "cell"))
    n_hot = hot.count()
    if not n_hot:
        return both.groupBy("entity", "cell").applyInArrow(kernel, ddl)
    few = F.broadcast(hot) if n_hot <= HOT_SHARDS else hot
    plain = both.join(few, ["entity", "cell"], "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    parts = _parts(both.join(few, ["entity", "cell"], "left_semi"), shard_rows)
    columns = ["entity", "cell", "part", "side", "id", "ts"]
    return plain.select(*columns).unionByName(parts.select(*columns)).groupBy("entity", "cell", "part").applyInArrow(kernel, ddl)


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """Rows of hot shards in parts of ``size`` rows in order of time, each with the right rows next to it."""
    shard = F.struct("entity", "cell")
    placed = cut(ranked(rows.withColumn("shard", shard), "shard", ["ts", "side", "id"]).withColumn("part", F.expr(f"rank div {int(size)}")))
    right = F.when(F.col("side") < 0, F.struct("ts", "id"))
    # one row per part, so a window over a shard's parts sees a fraction of 1 / size of its rows
    ends = placed.groupBy("entity", "cell", "part").agg(F.min(right).alias("first"), F.max(right).alias("last"))
    of_shard = Window.partitionBy("entity", "cell")
    before = F.last("last", True).over(of_shard.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", True).over(of_shard.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
    edges = ends.withColumns({"before": before, "after": after}).select("entity", "cell", "part", F.explode(F.array("before", "after")).alias("e")).where("e IS NOT NULL")
    columns = ["entity", "cell", "part", "side", "id", "ts"]
    return placed.select(*columns).unionByName(edges.select("entity", "cell", "part", F.lit(-1).alias("side"), "e.id", "e.ts"))
