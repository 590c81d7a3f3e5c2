"""Places and windows over ordered groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a block; a window function sees at most these and its context.
BLOCK = 65_536


def ranked(df: DataFrame, by: str, order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place from 0 within its group.

    A range sort spreads even a single large group over all partitions; the
    places follow from the rows' offsets and the counts of the partitions before.
    ``order`` should be unique within a group; rows of a null group have places too.
    """
    placed = cut(df.orderBy(by, *order).withColumn("_place", F.monotonically_increasing_id()))
    split = placed.select("*", F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_offset"))
    parts = split.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"), F.min("_offset").alias("_first"))
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_by", "_of", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"))
    met = split.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return met.select(*df.columns, (F.col("_ahead") + F.col("_offset")).alias(name))


def in_blocks(df: DataFrame, by: str, order: list[str], *, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Cuts every group into blocks of ``size`` rows in order, each with ``before`` rows of the block before it and ``after`` of the one after it.

    Adds ``_rank``, ``_block`` and ``_own`` (the row is the block's, not context).
    """
    rank = F.col("_rank")
    cell = lambda c: F.floor(c / F.lit(size))
    reached = F.sequence(F.greatest(F.lit(0).cast("bigint"), cell(rank - after)), cell(rank + before))
    out = ranked(df, by, order, "_rank").withColumn("_block", F.explode(reached))
    return out.withColumn("_own", F.col("_block") == cell(rank))


def window(by: str) -> WindowSpec:
    """Window over a block in order."""
    return Window.partitionBy(by, "_block").orderBy("_rank")


def own(df: DataFrame) -> DataFrame:
    """The blocks' own rows, without what ``in_blocks`` added."""
    return df.where("_own").drop("_rank", "_block", "_own")


def runs(df: DataFrame, by: str, order: list[str], begins: Column, name: str = "run") -> DataFrame:
    """Adds the place of the first row of each row's run: a run begins with its group and wherever ``begins`` holds.

    ``begins`` may look one row back, by ``F.lag`` over ``window(by)``. Runs may
    reach over any number of blocks: of each block only the last beginning is carried on.
    """
    cut_up = in_blocks(df, by, order, before=1)
    cut_up = cut_up.withColumn("_start", F.when((F.col("_rank") == 0) | F.coalesce(begins, F.lit(False)), F.col("_rank"))).where("_own")
    ends = cut_up.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(F.max("_start").alias("_last"))
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    ends = ends.select("_by", "_at", F.max("_last").over(earlier).alias("_carried"))
    here = F.max("_start").over(window(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = cut_up.withColumn("_here", here).join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_at")))
    return named.select(*df.columns, F.coalesce("_here", "_carried").alias(name))
