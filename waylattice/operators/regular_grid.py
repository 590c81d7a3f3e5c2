"""Irregular readings onto a regular grid, with singular-spectrum imputation of the gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Slots of one chunk of a series, and slots of its neighbours that it sees (more than FILL_SLOTS, so that long runs are known as such).
CHUNK_SLOTS, HALO_SLOTS = 1024, 128
#: Embedding window, kept components and rounds of the imputation.
WINDOW, RANK, ROUNDS, SETTLED = 24, 4, 40, 1e-3
#: A longer run of missing slots is marked but not filled: nothing in it is known.
FILL_SLOTS = 120


def diagonal_means(x: np.ndarray) -> np.ndarray:
    """Series whose Hankel matrix is nearest to each matrix of a stack (channels, window, lags)."""
    channels, window, lags = x.shape
    n = window + lags - 1
    wide = np.zeros((channels, window, n + 1))
    wide[:, :, :lags] = x
    total = wide.reshape(channels, -1)[:, : window * n].reshape(channels, window, n).sum(axis=1)
    count = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(window, lags))
    return total / count


def impute(series: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = ROUNDS) -> np.ndarray:
    """Fills the NaN of (channels, slots) by iterative singular-spectrum analysis.

    Starts from straight lines between known slots. Each round embeds the series
    as Hankel trajectories, keeps ``rank`` singular vectors, averages the
    diagonals back and replaces only the missing slots, until they settle.
    Channels of under four known slots keep the straight lines; those without any
    stay NaN.
    """
    n = series.shape[1]
    out = np.array(series, float)
    missing = np.isnan(out)
    count = n - missing.sum(axis=1)
    for c in np.flatnonzero((count > 0) & (count < n)):
        known = np.flatnonzero(~missing[c])
        out[c] = np.interp(np.arange(n), known, out[c, known])
    window = min(window, n // 2)
    live = np.flatnonzero((count >= 4) & (count < n))
    if window < 2 or not len(live):
        return out
    full, gaps = out[live], missing[live]
    centre = full.mean(axis=1, keepdims=True)
    scale = np.maximum(full.std(axis=1, keepdims=True), 1e-12)
    z = (full - centre) / scale
    for _ in range(rounds):
        path = np.lib.stride_tricks.sliding_window_view(z, n - window + 1, axis=1)
        basis = np.linalg.eigh(path @ path.transpose(0, 2, 1))[1][:, :, -min(rank, window - 1) :]
        smooth = diagonal_means(basis @ (basis.transpose(0, 2, 1) @ path))
        step = np.abs((smooth - z)[gaps]).max()
        z[gaps] = smooth[gaps]
        if step < SETTLED:
            break
    out[live] = np.where(gaps, z * scale + centre, full)
    return out


OUT = pa.schema([
    ("stream", pa.string()), ("source", pa.string()), ("slot", pa.int64()),
    ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("readings", pa.int64()), ("state", pa.string()),
])


def _chunk(key: tuple, table: pa.Table) -> pa.Table:
    stream, source, chunk = (k.as_py() for k in key)
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    start, stop = max(lo, chunk * CHUNK_SLOTS - HALO_SLOTS), min(hi + 1, (chunk + 1) * CHUNK_SLOTS + HALO_SLOTS)
    real = table.filter(pa.compute.is_valid(table["slot"]))
    slot = real["slot"].to_numpy()
    n = stop - start
    values, readings = np.full((3, n), np.nan), np.zeros(n, np.int64)
    for i, c in enumerate(("x", "y", "z")):
        values[i, slot - start] = real[c].to_numpy(zero_copy_only=False)
    readings[slot - start] = real["readings"].to_numpy()
    missing = readings == 0
    # length of the run of missing slots around each; runs that leave the chunk's view count as far as they are seen
    edge = np.flatnonzero(np.diff(np.concatenate([[0], missing, [0]])))
    length = np.zeros(n, np.int64)
    for a, b in zip(edge[::2], edge[1::2]):
        length[a:b] = b - a
    full = np.where(missing, impute(values), values)
    full[:, missing & (length > FILL_SLOTS)] = np.nan
    unfilled = missing & np.isnan(full).all(axis=0)
    mine = np.arange(start, stop) // CHUNK_SLOTS == chunk
    state = np.where(~missing, "observed", np.where(unfilled, "gap", "filled"))[mine]
    k = int(mine.sum())
    none = np.isnan(full[:, mine])
    return pa.table([
        pa.array([stream] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(np.arange(start, stop)[mine]),
        *[pa.array(full[i, mine], mask=none[i]) for i in range(3)], pa.array(readings[mine]), pa.array(state.tolist(), pa.string()),
    ], schema=OUT)


def regular_grid(readings: DataFrame) -> DataFrame:
    """One row per whole second of each (stream, source) between its first and last usable reading.

    ``readings``: (stream, source, key, ts, x, y, z), usable rows only; rows with
    a null among stream, source, key or ts, or a ts that is not finite, are left
    out. Deliveries of one key count once. A slot's value is the mean of its
    readings, coordinate by coordinate; those that are null or NaN say nothing,
    and a coordinate that no reading of the slot tells is null.

    Slots without a reading are 'filled' by singular-spectrum imputation of the known ones, or
    marked 'gap' (null values) when the run of missing slots is longer than
    ``FILL_SLOTS``; others are 'observed'. Series are cut into chunks that see a
    part of their neighbours, so no series is ever gathered in one task.

    Returns (stream, source, slot, x, y, z, readings, state). An empty table
    gives none; a source with a single slot gives that slot.
    """
    ts = F.col("ts")
    usable = readings.where(
        F.col("stream").isNotNull() & F.col("source").isNotNull() & F.col("key").isNotNull() & ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 1e15)
    )
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("x", "y", "z")}
    once = usable.select("stream", "source", "key", F.floor(ts).alias("slot"), *[clean[c].alias(c) for c in clean]).groupBy("stream", "key").agg(
        F.min("source").alias("source"), F.min("slot").alias("slot"), *[F.min(c).alias(c) for c in clean],
    )
    slots = cut(once.groupBy("stream", "source", "slot").agg(F.count("*").alias("readings"), *[F.avg(c).alias(c) for c in clean]))
    spans = slots.groupBy("stream", "source").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    cell = lambda c: F.floor(c / F.lit(CHUNK_SLOTS))
    # one empty row per chunk, so that chunks that lie wholly in a gap come out too
    chunks = spans.withColumn("chunk", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    slot = F.col("slot")
    copies = slots.withColumn("chunk", F.explode(F.sequence(cell(slot - HALO_SLOTS), cell(slot + HALO_SLOTS))))
    none = {c: F.lit(None).cast(t) for c, t in (("slot", "bigint"), ("x", "double"), ("y", "double"), ("z", "double"), ("readings", "bigint"))}
    keyed = ["stream", "source", "chunk"]
    # the span of a series rides on its chunks' rows: no join of all slots with all sources
    rows = copies.select(*keyed, "slot", "x", "y", "z", "readings", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")).unionByName(
        chunks.select(*keyed, *[none[c].alias(c) for c in none], "lo", "hi")
    )
    ddl = "stream STRING, source STRING, slot BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, readings BIGINT, state STRING"
    return rows.groupBy(*keyed).applyInArrow(_with_span, ddl)


def _with_span(key: tuple, table: pa.Table) -> pa.Table:
    span = table.filter(pa.compute.is_valid(table["lo"]))
    if not span.num_rows:  # a halo beyond the end of its series
        return OUT.empty_table()
    n = table.num_rows
    for i, c in ((table.schema.get_field_index(c), c) for c in ("lo", "hi")):
        table = table.set_column(i, c, pa.array([span[c][0].as_py()] * n, pa.int64()))
    return _chunk(key, table)
