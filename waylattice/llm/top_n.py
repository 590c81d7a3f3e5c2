"""The N best items of every group, by simultaneous bisection of all groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bisect import BROADCAST_ROWS, HOT_ROWS, SUMMARY_BITS, attach, bin_of, order_code, span_shift
from ..session import cut

#: Cutoff item of a group whose whole score level is kept.
ALL_ITEMS = 0x7FFFFFFFFFFFFFFF


def top_n_per_group(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int = 5,
    *,
    min_score: float | None = 0.0,
    bits: int = 9,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The ``n`` first items of each group by score descending, then item ascending.

    The first pass counts the rows of every group in fixed dyadic cells of an
    order-preserving code of the score and finds the cell that holds the n-th row.
    All rows then meet their group's cutoff once, and those above it are kept: the
    rows surely among the first and those of that one cell. Every further pass
    counts the kept rows of each unresolved group in up to ``2**bits`` bins of its
    interval (that is ``bits`` bisections at once), moves the cutoff into the bin
    that holds the n-th row and narrows the interval to it: first on the score, and
    among equal scores on the identifier. A group is resolved as soon as its bin
    boundary leaves exactly ``n`` rows. No group is ever gathered: a pass moves
    counts, not rows.

    An item counts once per group, with its highest score. Rows with null group,
    item or score, with a NaN score or one below ``min_score`` (None: no limit)
    take no part; a group without other rows does not appear. Groups with fewer
    than ``n`` items come out whole. ``item`` must be integral. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.

    Returns (group, item, score, rank), rank from 1.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if df.schema[item].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{item} must be integral")
    value = F.col(score).cast("double")
    keep = F.col(group).isNotNull() & F.col(item).isNotNull() & value.isNotNull() & ~F.isnan(value)
    if min_score is not None:
        keep &= value >= F.lit(float(min_score))
    best = (
        df.where(keep)
        .select(F.col(group).alias("g"), F.col(item).cast("bigint").alias("i"), (value + F.lit(0.0)).alias("s"))
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
    )
    # v rises as the score falls, so that a smaller (v, i) is always the better row
    rows = cut(best.withColumn("v", F.bitwise_not(order_code(F.col("s")))))
    cells = rows.groupBy("g", F.shiftright("v", 64 - SUMMARY_BITS).alias("b")).agg(
        F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("i").alias("i_lo"), F.max("i").alias("i_hi"),
    )
    of_group = Window.partitionBy("g")  # cells of a group, not its rows
    counted = cells.withColumns({"upto": F.sum("c").over(of_group.orderBy("b")), "w": F.sum("c").over(of_group)})
    counted = counted.withColumns({"need": F.least(F.lit(n).cast("bigint"), F.col("w")), "level": F.lit(0), "tie": F.lit(0).cast("bigint")})
    passed = cut(_next(counted))
    groups, left, total = passed.agg(F.count("*"), F.count_if(~F.col("resolved")), F.coalesce(F.sum("w"), F.lit(0))).first()
    kw = {"broadcast_rows": broadcast_rows, "hot_rows": hot_rows}
    kept = cut(attach(rows, passed.select("g", "w", "cut_v"), ["g"], "w", total, n_state=groups, **kw).where("v <= cut_v").select("g", "i", "s", "v"))
    done, active = [passed.where("resolved")], passed.where("NOT resolved")
    while left:
        state = active.select("g", "w", "need", "level", "tie", "lo", "hi").withColumn("shift", span_shift(F.col("lo"), F.col("hi"), bits))
        passed = cut(_narrow(attach(kept, state, ["g"], "w", total, n_state=left, **kw)))
        done.append(passed.where("resolved"))
        active = passed.where("NOT resolved")
        left = active.count()
    cutoffs = reduce(DataFrame.unionByName, [x.select("g", "w", "cut_v", "cut_i") for x in done])
    best = attach(kept, cutoffs, ["g"], "w", total, n_state=groups, **kw).where((F.col("v") < F.col("cut_v")) | ((F.col("v") == F.col("cut_v")) & (F.col("i") <= F.col("cut_i"))))
    order = Window.partitionBy("g").orderBy("v", "i")  # n rows at most
    return best.select(
        F.col("g").alias(group), F.col("i").cast(df.schema[item].dataType).alias(item), F.col("s").alias(score), F.row_number().over(order).alias("rank"),
    )


def _narrow(met: DataFrame) -> DataFrame:
    """One pass: rows with their group's interval to the group's next interval or its cutoff."""
    by_score = F.col("level") == 0
    met = met.withColumn("x", F.when(by_score, F.col("v")).otherwise(F.col("i"))).where(
        (by_score | (F.col("v") == F.col("tie"))) & F.col("x").between(F.col("lo"), F.col("hi"))
    )
    counted = (
        met.withColumn("b", bin_of(F.col("x"), F.col("lo"), F.col("shift")))
        .groupBy("g", "b", "w", "need", "level", "tie")
        .agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("i").alias("i_lo"), F.max("i").alias("i_hi"))
    )
    return _next(counted.withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("b"))))


def _next(counted: DataFrame) -> DataFrame:
    """The bin in which each group's count reaches what it needs, as its next interval or its cutoff."""
    at = counted.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
    at = at.withColumn("need", F.col("need") - (F.col("upto") - F.col("c")))
    exact = F.col("c") == F.col("need")
    tied = (F.col("level") == 0) & (F.col("lo") == F.col("hi"))
    return at.select(
        "g", "w", "need",
        exact.alias("resolved"),
        F.when(F.col("level") == 0, F.col("hi")).otherwise(F.col("tie")).alias("cut_v"),
        F.when(F.col("level") == 0, F.lit(ALL_ITEMS)).otherwise(F.col("hi")).alias("cut_i"),
        F.when(tied, F.lit(1)).otherwise(F.col("level")).alias("level"),
        F.when(tied, F.col("lo")).otherwise(F.col("tie")).alias("tie"),
        F.when(tied, F.col("i_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(tied, F.col("i_hi")).otherwise(F.col("hi")).alias("hi"),
    )
