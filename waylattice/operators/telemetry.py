"""Run logs: sections, edges, counters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bisect import exact_percentiles, meet
from .blocks import in_blocks, own, ranked, window


def sections(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Calls, total, mean, greatest and last duration of each section (column) per group; zero and missing ones are no calls."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = rows.select(*by, order, F.expr(f"stack({len(columns)}, {pairs}) AS (section, sec)")).where("sec > 0 AND NOT isnan(sec)")
    return long.groupBy(*by, "section").agg(F.count("*").alias("calls"), F.sum("sec").alias("total"), F.avg("sec").alias("mean"), F.max("sec").alias("most"), F.max_by("sec", order).alias("last"))


def rising_edges(rows: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """Rows at which a flag becomes true, the row before (or none) having it false."""
    cut_up = in_blocks(rows.withColumn("_flag", F.coalesce(flag, F.lit(False))), by, [order], before=1)
    return own(cut_up.withColumn("_was", F.lag("_flag", 1, False).over(window(by)))).where("_flag AND NOT _was").drop("_flag", "_was")


def new_highs(rows: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """Rows whose counter exceeds all before it; the first row counts."""
    cut_up = in_blocks(rows, by, [order])
    # the greatest value of the blocks before comes from a table of one row per block
    most = cut_up.groupBy(by, "_block").agg(F.max(counter).alias("_most"))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(by, "_block", F.max("_most").over(earlier).alias("_carried"))
    here = F.max(counter).over(window(by).rowsBetween(Window.unboundedPreceding, -1))
    met = cut_up.withColumn("_here", here).join(most, [by, "_block"]).withColumn("_before", F.greatest("_here", "_carried"))
    return own(met.where(F.col("_before").isNull() | (F.col(counter) > F.col("_before")))).select(*rows.columns)


def run_summary(rows: DataFrame, by: str, order: str, counter: str, measure: str) -> DataFrame:
    """Rows, final count and when it was first reached, and mean, median and greatest measure of each run."""
    v = F.when((F.col(measure) >= 0) & ~F.isnan(measure), F.col(measure))
    most = rows.groupBy(by).agg(F.count("*").alias("rows"), F.max(counter).alias("final"), F.avg(v).alias("mean"), F.max(v).alias("most"))
    first = rows.join(most.select(by, F.col("final").alias(counter)), [by, counter]).groupBy(by).agg(F.min(order).alias("reached_at"))
    median = exact_percentiles(rows.select(by, v.alias("v")), [by], ["v"], {"median": 0.5}).withColumnRenamed("median_v", "median")
    return meet(meet(most, first, [by]), median, [by], "left")


def rolling(rows: DataFrame, by: str, order: str, value: str, size: int = 30) -> DataFrame:
    """Mean and count of the last ``size`` rows."""
    w = window(by).rowsBetween(1 - size, 0)
    return own(in_blocks(rows, by, [order], before=size - 1).withColumns({"buffered": F.count("*").over(w), "rolling_mean": F.avg(value).over(w)}))


def every_nth(rows: DataFrame, by: str, order: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each group from the first on: keyframe stride."""
    return ranked(rows, by, [order], "nth").where(F.col("nth") % stride == 0)


def ratio_sample(rows: DataFrame, seed: str, key: str, ratio: float) -> DataFrame:
    """Rows whose hash of (seed, key) falls under ``ratio``: the same at every run and on every partitioning."""
    u = F.pmod(F.xxhash64(seed, key), F.lit(1_000_000)) / 1_000_000.0
    return rows.where(u < ratio)
