"""Percentiles of very large columns: day summaries that add up, then exact bisection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bisect import BROADCAST_ROWS, HOT_ROWS, combine, locate, order_code, resolve, summarise
from ..session import cut


def measured(df: DataFrame, group: str, part: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """One row (g, d, m, v, x) per usable value: each (group, key) once, neither null, NaN nor negative.

    Deliveries of one key that differ count with the smallest value of each
    metric. Rows with null group or key are left out; a null part is a part.
    """
    value = {m: F.col(m).cast("double") for m in metrics}
    usable = {m: F.when(~F.isnan(v) & (v >= 0), v + F.lit(0.0)) for m, v in value.items()}
    once = (
        df.where(F.col(group).isNotNull() & F.col(key).isNotNull())
        .select(F.col(group).alias("g"), F.col(part).alias("d"), F.col(key).alias("k"), *[usable[m].alias(f"m{i}") for i, m in enumerate(metrics)])
        .groupBy("g", "k")
        .agg(F.min("d").alias("d"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(metrics))])
    )
    pairs = ", ".join(f"{i}, m{i}" for i in range(len(metrics)))
    return once.select("g", "d", F.expr(f"stack({len(metrics)}, {pairs}) AS (m, v)")).where("v IS NOT NULL").withColumn("x", order_code(F.col("v")))


#: Keys of a summary per part, and of one per group.
PART, GROUP = ["g", "d", "m"], ["g", "m"]


def _ranks(per_mille: Sequence[int]) -> Column:
    """The rank of p is ceil(p * n), at least 1: the smallest value with at least the share p of the values at or below it."""
    return F.array(*[F.struct(F.lit(int(p)).alias("p"), F.greatest(F.lit(1), F.expr(f"(n * {int(p)} + 999) div 1000")).alias("rank")) for p in per_mille])


def _targets(summary: DataFrame, per_mille: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The cells of the percentiles of the parts, and of the groups they add up to."""
    return locate(summary, PART, _ranks(per_mille)), locate(combine(summary, *GROUP), GROUP, _ranks(per_mille))


def _both(parts: DataFrame, groups: DataFrame) -> DataFrame:
    whole = groups.withColumn("d", F.lit(None).cast(parts.schema["d"].dataType)).withColumn("whole", F.lit(True))
    return parts.withColumn("whole", F.lit(False)).unionByName(whole)


def _named(found: DataFrame, group: str, part: str, metrics: Sequence[str]) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("m") + 1)
    return found.select(
        F.col("g").alias(group), F.col("d").alias(part), F.when(F.col("whole"), "all").otherwise("part").alias("level"),
        names.alias("metric"), (F.col("p") / 1000.0).alias("p"), F.col("n"), *[F.col(c) for c in ("value", "lower", "upper") if c in found.columns],
    )


def percentiles_bounded(df: DataFrame, group: str, part: str, key: str, metrics: Sequence[str], per_mille: Sequence[int] = (500, 900, 950, 990)) -> DataFrame:
    """Percentiles from the summaries alone: lower and upper bound, in one pass over the rows; the bounds are within 0.4 % of the value."""
    found = _both(*_targets(cut(summarise(measured(df, group, part, key, metrics), PART)), per_mille))
    return _named(found.withColumns({"lower": F.col("v_lo"), "upper": F.col("v_hi")}), group, part, metrics)


def percentiles(
    df: DataFrame,
    group: str,
    part: str,
    key: str,
    metrics: Sequence[str],
    per_mille: Sequence[int] = (500, 900, 950, 990),
    *,
    bits: int = 9,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact percentiles of each metric per group and per (group, part), without sorting a group.

    The first pass counts values in fixed dyadic cells per part; counts of parts
    add up to those of the group. Parts and groups are then resolved each on
    their own keys: every pass bisects all intervals that still hold more than
    one value ``bits`` times at once, by counting the rows of every unresolved
    percentile in the bins of its interval, until the target rank falls on a
    single value. The error is zero.

    Usable values are neither null, NaN nor negative; each (group, key) counts
    once. A group without usable values of a metric has no row for it. Infinite
    values are values. Extra columns are ignored; an empty table gives none.

    Returns (group, part, level, metric, p, n, value), level 'all' (part null)
    or 'part'.
    """
    values = cut(measured(df, group, part, key, metrics))
    parts, groups = _targets(cut(summarise(values, PART)), per_mille)
    kw = {"bits": bits, "broadcast_rows": broadcast_rows, "hot_rows": hot_rows}
    return _named(_both(resolve(values, parts, PART, **kw), resolve(values, groups, GROUP, **kw)), group, part, metrics)
