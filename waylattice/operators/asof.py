"""As-of joins in time, without gathering an entity in one task."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import in_blocks, ranked, window

CHUNK_SECONDS = 512.0
#: Rows from which a chunk is cut by rows, and such chunks that are broadcast at most.
HOT_ROWS, HOT_CHUNKS = 1_000_000, 100_000


def _finite(ts: Column) -> Column:
    return ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 1e15)


def _chunk_ends(both: DataFrame) -> DataFrame:
    """Of each chunk (e, c, k) the number of rows, and the first and last right row."""
    at = F.when(F.col("r").isNotNull(), F.col("t"))
    return both.groupBy("e", "c", "k").agg(F.count("*").alias("n"), F.min_by("r", at).alias("first"), F.max_by("r", at).alias("last"))


def neighbours(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_id: str, chunk_seconds: float = CHUNK_SECONDS, carry: Sequence[str] = ()) -> DataFrame:
    """Adds to each left row ``prev`` and ``next``: structs (ts, id) of the last right row at or before it and the first at or after it.

    The structs hold the right columns of ``carry`` too, so that no join by id
    needs to follow. Of right rows at the same time the smallest id stands for all. Chunks of
    time are windows of their own, those of more than HOT_ROWS rows being cut by
    rows; what the chunks before and after hold comes from a table of one row per
    chunk. Left rows without entity or finite time
    keep null neighbours; such right rows take no part.
    """
    cell = lambda c: F.floor(c / F.lit(chunk_seconds))
    names = left.columns
    keyed = left.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(by).alias("e"), F.col(left_ts).cast("double").alias("t"))
    usable, other = keyed.where(F.col("e").isNotNull() & _finite(F.col("t"))), keyed.where(~(F.col("e").isNotNull() & F.coalesce(_finite(F.col("t")), F.lit(False))))
    r = right.where(F.col(by).isNotNull() & _finite(F.col(right_ts).cast("double")) & F.col(right_id).isNotNull())
    first = F.min(F.struct(F.col(right_id).alias("id"), *[F.col(f"`{c}`") for c in carry]))
    r = r.groupBy(F.col(by).alias("e"), F.col(right_ts).cast("double").alias("t")).agg(first.alias("m")).withColumn("r", F.struct(F.col("t").alias("ts"), "m.id", *[f"m.`{c}`" for c in carry]))
    empty = F.lit(None).cast(r.schema["r"].dataType)
    both = usable.select("e", "t", "row", empty.alias("r")).unionByName(r.select("e", "t", F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), "r")).withColumns({"c": cell(F.col("t")), "k": F.lit(0).cast("bigint")})
    ends = cut(_chunk_ends(both))
    hot = ends.where(F.col("n") > HOT_ROWS).select("e", "c")
    n_hot = hot.count()
    if n_hot:
        # chunks with too many rows are cut by rows; there are at most (rows of the input / HOT_ROWS) of them
        few = F.broadcast(hot) if n_hot <= HOT_CHUNKS else hot
        dense = both.join(few, ["e", "c"], "left_semi").withColumn("late", F.col("r").isNull()).drop("k")
        dense = cut(ranked(dense, "e", ["t", "late"], "place").withColumn("k", F.expr(f"place div {HOT_ROWS}")).drop("place", "late"))
        both = both.join(few, ["e", "c"], "left_anti").unionByName(dense)
        ends = cut(ends.join(few, ["e", "c"], "left_anti").unionByName(_chunk_ends(dense)))
    # what follows is looked up in descending order: frames that grow cost one step a row, frames that shrink a whole pass
    chunks, falling = Window.partitionBy("e").orderBy("c", "k"), Window.partitionBy("e").orderBy(F.desc("c"), F.desc("k"))
    ends = ends.select(
        "e", "c", "k",
        F.last("last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.last("first", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"),
    )
    inside, back = (Window.partitionBy("e", "c", "k").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("t", F.desc("t")))
    met = both.join(ends, ["e", "c", "k"]).select(
        "row", "t",
        F.coalesce(F.last("r", ignorenulls=True).over(inside), "carried").alias("prev"),
        F.coalesce(F.last("r", ignorenulls=True).over(back), "ahead").alias("next"),
    )
    # of rows at one time the right one stands first, perhaps in the part before
    met = met.select("row", "prev", F.when(F.col("prev.ts") == F.col("t"), F.col("prev")).otherwise(F.col("next")).alias("next"))
    met = met.where("row IS NOT NULL").unionByName(other.select("row", empty.alias("prev"), empty.alias("next")))
    return met.select("row.*", "prev", "next")


def asof_nearest(
    left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_id: str, *, tolerance: float | None = None, tie: str = "earlier", how: str = "left", chunk_seconds: float = CHUNK_SECONDS, carry: Sequence[str] = (),
) -> DataFrame:
    """Nearest right row in time: adds ``match_id``, ``match_ts`` and ``dt`` (absolute), and ``match_<c>`` for each right column c of ``carry``.

    ``tie`` decides between equally near rows; ``how`` 'inner' leaves out left
    rows without a match within ``tolerance``, 'left' keeps them with nulls.
    """
    if tie not in ("earlier", "later") or how not in ("left", "inner"):
        raise ValueError("tie is 'earlier' or 'later', how 'left' or 'inner'")
    ts = F.col(left_ts).cast("double")
    met = neighbours(left, right, by, left_ts, right_ts, right_id, chunk_seconds, carry)
    before, after = ts - F.col("prev.ts"), F.col("next.ts") - ts
    first = before <= after if tie == "earlier" else before < after
    chosen = F.when(F.col("next").isNull(), F.col("prev")).when(F.col("prev").isNull(), F.col("next")).when(first, F.col("prev")).otherwise(F.col("next"))
    met = met.withColumn("m", chosen).drop("prev", "next")
    dt = F.abs(ts - F.col("m.ts"))
    fits = F.col("m").isNotNull() if tolerance is None else (dt <= tolerance)
    out = met.withColumns({"match_id": F.when(fits, F.col("m.id")), "match_ts": F.when(fits, F.col("m.ts")), "dt": F.when(fits, dt), **{f"match_{c}": F.when(fits, F.col(f"m.`{c}`")) for c in carry}}).drop("m")
    return out.where(F.col("match_id").isNotNull()) if how == "inner" else out


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_id: str, *, tolerance: float | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Last right row at or before each left row: adds ``match_id``, ``match_ts``, ``dt`` and ``match_<c>`` for each right column c of ``carry``; null where there is none."""
    met = neighbours(left, right, by, left_ts, right_ts, right_id, carry=carry)
    dt = F.col(left_ts).cast("double") - F.col("prev.ts")
    fits = F.col("prev").isNotNull() if tolerance is None else (dt <= tolerance)
    return met.withColumns({"match_id": F.when(fits, F.col("prev.id")), "match_ts": F.when(fits, F.col("prev.ts")), "dt": F.when(fits, dt), **{f"match_{c}": F.when(fits, F.col(f"prev.`{c}`")) for c in carry}}).drop("prev", "next")


def asof_exact_then_nearest(left: DataFrame, right: DataFrame, by: str, key: str, left_ts: str, right_ts: str, right_id: str, *, tolerance: float) -> DataFrame:
    """Rows that share ``key`` with a right row of their entity match it; the rest take the nearest within ``tolerance``."""
    # of several right rows with one key the smallest id
    first = F.min(F.struct(F.col(right_id).alias("id"), F.col(right_ts).alias("ts")))
    keys = right.where(F.col(right_id).isNotNull()).groupBy(by, key).agg(first.alias("_m")).select(by, key, F.col("_m.id").alias("exact_id"), F.col("_m.ts").alias("exact_ts"))
    exact = left.join(keys, [by, key], "left")
    done = exact.where("exact_id IS NOT NULL").select(*left.columns, F.col("exact_id").alias("match_id"), F.col("exact_ts").alias("match_ts"), F.abs(F.col(left_ts) - F.col("exact_ts")).alias("dt"))
    rest = exact.where("exact_id IS NULL").select(*left.columns)
    return done.unionByName(asof_nearest(rest, right, by, left_ts, right_ts, right_id, tolerance=tolerance))


def asof_first_come(left: DataFrame, right: DataFrame, by: str, left_ts: str, left_id: str, right_ts: str, right_id: str, *, tolerance: float) -> DataFrame:
    """One to one: each left row's nearest right row (earlier on a tie); of several that want the same the first in time gets it, the others none."""
    near = asof_nearest(left, right, by, left_ts, right_ts, right_id, tolerance=tolerance, how="inner")
    order = Window.partitionBy(by, "match_id").orderBy(left_ts, left_id)
    return near.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def asof_greedy(left: DataFrame, right: DataFrame, by: str, left_ts: str, left_id: str, right_ts: str, right_id: str, *, tolerance: float) -> DataFrame:
    """One to one, greedy in time: each left row takes the nearer of its two neighbours that is still free (the later on a tie), if within ``tolerance``.

    What a row takes depends on the rows before it only as long as neighbours
    are shared; rows are cut into such chains, and only chains are resolved one
    row at a time.
    """
    ts = F.col(left_ts).cast("double")
    met = neighbours(left, right, by, left_ts, right_ts, right_id).where("prev IS NOT NULL OR next IS NOT NULL")
    # a right row at just the time of a left row is its right neighbour; the left one is then not seen twice
    met = met.withColumn("prev", F.when(F.col("prev.id") != F.coalesce(F.col("next.id"), F.lit(-1)), F.col("prev")))
    order = window(by)
    cut_up = in_blocks(met, by, [left_ts, left_id], before=1)
    linked = F.coalesce(F.lag("next.id").over(order) == F.col("prev.id"), F.lit(False)) | F.coalesce(F.lag("next.id").over(order) == F.col("next.id"), F.lit(False)) | F.coalesce(F.lag("prev.id").over(order) == F.col("prev.id"), F.lit(False))
    # a chain is named by the place of its first row, which may lie blocks before
    cut_up = cut_up.withColumn("_start", F.when(linked, None).otherwise(F.col("_rank")))
    ends = cut_up.where("_own").groupBy(F.col(by).alias("_e"), F.col("_block").alias("_b")).agg(F.max("_start").alias("_last"))
    ends = ends.select("_e", "_b", F.max("_last").over(Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max(F.when(F.col("_own"), F.col("_start"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = cut_up.withColumn("_here", here).where("_own").join(ends, (F.col(by) == F.col("_e")) & (F.col("_block") == F.col("_b")))
    chains = named.withColumn("chain", F.coalesce("_here", "_carried")).select(
        F.col(by).alias("e"), "chain", F.col(left_id).alias("l"), ts.alias("t"), F.col("prev.id").alias("pi"), F.col("prev.ts").alias("pt"), F.col("next.id").alias("ni"), F.col("next.ts").alias("nt"),
    )

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for r in rows.sort_values(["t", "l"]).itertuples():
            best = None
            for ident, at in ((r.ni, r.nt), (r.pi, r.pt)):
                if ident == ident and ident is not None and ident not in used and (best is None or abs(at - r.t) < best[1]):
                    best = (ident, abs(at - r.t), at)
            if best and best[1] <= tolerance:
                used.add(best[0])
                out.append((r.e, r.l, int(best[0]), best[2], best[1]))
        return pd.DataFrame(out, columns=["e", "l", "m", "mt", "dt"])

    kind = {f.name: f.dataType.simpleString() for f in chains.schema}
    single = chains.groupBy("e", "chain").agg(F.count("*").alias("n"))
    sized = chains.join(single, ["e", "chain"])
    alone = sized.where("n = 1").withColumn("b", F.when(F.col("ni").isNull(), False).when(F.col("pi").isNull(), True).otherwise(F.col("nt") - F.col("t") <= F.col("t") - F.col("pt")))
    alone = alone.select("e", "l", F.when(F.col("b"), F.col("ni")).otherwise(F.col("pi")).alias("m"), F.when(F.col("b"), F.col("nt")).otherwise(F.col("pt")).alias("mt"), F.abs(F.when(F.col("b"), F.col("nt")).otherwise(F.col("pt")) - F.col("t")).alias("dt")).where(F.col("dt") <= tolerance)
    shared = sized.where("n > 1").drop("n").groupBy("e", "chain").applyInPandas(resolve, f"e {kind['e']}, l {kind['l']}, m BIGINT, mt DOUBLE, dt DOUBLE")
    return alone.unionByName(shared).select(F.col("e").alias(by), F.col("l").alias(left_id), F.col("m").alias("match_id"), F.col("mt").alias("match_ts"), "dt")
