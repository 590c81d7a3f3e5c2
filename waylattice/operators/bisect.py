"""Order statistics of many groups at once, by bisection: counts move, groups are never gathered or sorted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a state table that are broadcast at most (some tens of bytes each).
BROADCAST_ROWS = 200_000
#: Rows from which a single key is joined by broadcast instead of by shuffle.
HOT_ROWS = 1_000_000
#: Bits of a value's code that name its cell in a summary: sign, exponent and 8 of the mantissa.
SUMMARY_BITS = 20


def order_code(value: Column) -> Column:
    """BIGINT that sorts as the DOUBLE ``value`` does (IEEE bits, negatives mirrored; -0.0 equals 0.0).

    ``value`` must be neither null nor NaN.
    """
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def span_shift(lo: Column, hi: Column, bits: int) -> Column:
    """Right shift that maps halved codes of [lo, hi] onto less than ``2**bits + 1`` bins; -1 if the span is one half step."""
    width = F.shiftright(hi, 1) - F.shiftright(lo, 1)
    return F.when(width <= 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.length(F.bin(width)) - F.lit(bits))).cast("int")


def bin_of(code: Column, lo: Column, shift: Column) -> Column:
    """Bin of ``code`` in its interval, never falling as ``code`` rises.

    Codes are halved first, so that the difference of two of them can't overflow;
    when lo and hi fall on the same half (shift -1) they are told apart directly.
    """
    half = F.shiftright(code, 1) - F.shiftright(lo, 1)
    return F.when(shift < 0, code - lo).otherwise(F.call_function("shiftright", half, F.greatest(shift, F.lit(0))))


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", *, broadcast: bool = False) -> DataFrame:
    """Join on equal keys, null keys included."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_{c}"]) for c in on])
    return left.join(F.broadcast(other) if broadcast else other, same, how).drop(*[f"_{c}" for c in on])


def attach(rows: DataFrame, state: DataFrame, on: Sequence[str], weight: str, total: int, *, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, n_state: int | None = None) -> DataFrame:
    """Inner join of all rows with the state rows of their key, null keys included.

    A small state is broadcast. A larger one is split by key: keys with many rows
    are at most ``total / limit`` in number, so all their state rows are broadcast
    and their rows never leave their partitions; the others meet in a shuffle in
    which no key is large. ``weight`` is the state column that holds a key's
    number of rows (the greatest counts where its state rows differ); a key has a
    handful of state rows, one per rank wanted. ``n_state`` is an upper bound of the
    state's rows, if one is known; ``total`` is that of all keys' rows.
    """
    if (state.count() if n_state is None else n_state) <= broadcast_rows:
        return meet(rows, state, on, broadcast=True)
    limit = max(hot_rows, total // broadcast_rows + 1)
    hot = state.groupBy(*on).agg(F.max(weight).alias("_most")).where(F.col("_most") > limit).select(*on)
    few, rest = meet(state, hot, on, "left_semi", broadcast=True), meet(state, hot, on, "left_anti", broadcast=True)
    return meet(rows, few, on, broadcast=True).unionByName(meet(meet(rows, hot, on, "left_anti", broadcast=True), rest, on))


def summarise(values: DataFrame, on: Sequence[str], bits: int = SUMMARY_BITS) -> DataFrame:
    """(on, x, v) to counts per key and cell, with the cell's least and greatest code and value.

    The cells are the same dyadic intervals everywhere, so summaries of separate
    partitions or days combine by ``combine`` without loss.
    """
    return values.groupBy(*on, F.shiftright("x", 64 - bits).alias("cell")).agg(
        F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi"),
    )


def combine(summary: DataFrame, *keys: str) -> DataFrame:
    """Adds summaries up to coarser groups."""
    return summary.groupBy(*keys, "cell").agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("v_lo").alias("v_lo"), F.max("v_hi").alias("v_hi"),
    )


def locate(summary: DataFrame, keys: Sequence[str], ranks: Column) -> DataFrame:
    """The cell that holds each wanted rank (from 1), and the rank within it as ``need``.

    ``ranks`` is an array of structs with fields ``p`` (a name) and ``rank``,
    made from ``n``, the number of values of a key.
    """
    w = Window.partitionBy(*keys)  # cells of a key: bounded by their number of bits
    run = summary.withColumn("upto", F.sum("c").over(w.orderBy("cell"))).withColumn("n", F.sum("c").over(w))
    return (
        run.withColumn("_r", F.explode(ranks)).withColumns({"p": F.col("_r.p"), "rank": F.col("_r.rank")})
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        .withColumn("need", F.col("rank") - (F.col("upto") - F.col("c")))
        .drop("upto", "rank", "_r")
    )


def resolve(values: DataFrame, targets: DataFrame, on: Sequence[str], *, bits: int = 9, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact values of the ranks that ``locate`` has placed in cells: (on, p, n, value).

    ``values``: (on, x, v), x the order code of v. Each pass bisects all intervals
    that still hold more than one value ``bits`` times at once, by counting rows in
    bins. All rows are met in the first pass only; it keeps those inside the
    intervals, and later passes read these.
    """
    on = list(on)
    carried = [*on, "p", "n", "need", "c", "lo", "hi", "v_lo", "v_hi"]
    at = _settle(cut(targets.select(*carried)))
    done, active, rows = [at.where("value IS NOT NULL")], at.where("value IS NULL"), None
    # ranks still open, and a bound of the values of all keys
    n_open, total = at.agg(F.count_if(F.col("value").isNull()), F.coalesce(F.sum("n"), F.lit(0))).first()
    while n_open:
        state = active.select(*on, "p", "n", "need", "lo", "hi").withColumn("shift", span_shift(F.col("lo"), F.col("hi"), bits))
        # several ranks of a key share an interval; its rows are counted once for all of them
        spans = state.groupBy(*on, "lo", "hi", "shift").agg(F.max("n").alias("w"))
        first = rows is None
        inside = attach(values if first else rows, spans, on, "w", total, broadcast_rows=broadcast_rows, hot_rows=hot_rows, n_state=n_open).where(F.col("x").between(F.col("lo"), F.col("hi")))
        if first:
            inside = cut(inside.select(*on, "x", "v", "lo", "hi", "shift"))
            rows = inside.select(*on, "x", "v")
        counted = (
            inside.withColumn("b", bin_of(F.col("x"), F.col("lo"), F.col("shift")))
            .groupBy(*on, F.col("lo").alias("from"), F.col("hi").alias("to"), "b")
            .agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi"))
        )
        counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*on, "from", "to").orderBy("b")))  # bins of an interval
        wanted = state.select(*on, F.col("lo").alias("from"), F.col("hi").alias("to"), "p", "n", "need")
        hit = meet(counted, wanted, [*on, "from", "to"]).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        at = _settle(cut(hit.withColumn("need", F.col("need") - (F.col("upto") - F.col("c"))).select(*carried)))
        done.append(at.where("value IS NOT NULL"))
        active = at.where("value IS NULL")
        n_open = active.count()
    return reduce(DataFrame.unionByName, [x.select(*on, "p", "n", "value") for x in done])


def _settle(at: DataFrame) -> DataFrame:
    """The value of each interval whose target rank is its first or last row or that holds one value only."""
    first = (F.col("need") == 1) | (F.col("lo") == F.col("hi"))
    return at.withColumn("value", F.when(first, F.col("v_lo")).when(F.col("need") == F.col("c"), F.col("v_hi")))


def exact_percentiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per group, columns named ``{name}_{column}``.

    ``shares`` maps names to shares between 0 and 1. Nulls and NaN take no part;
    a group without values of a column has null there, one without any is absent.
    """
    by = list(by)
    pairs = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(columns))
    long = df.select(*by, F.expr(f"stack({len(columns)}, {pairs}) AS (m, v)")).where("v IS NOT NULL AND NOT isnan(v)")
    values = cut(long.withColumn("v", F.col("v") + F.lit(0.0)).withColumn("x", order_code(F.col("v"))))
    on = [*by, "m"]
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    ranks = F.array(*[
        F.struct(F.lit(2 * i + k).alias("p"), (f(place[name]) + 1).cast("bigint").alias("rank")) for i, name in enumerate(shares) for k, f in ((0, F.floor), (1, F.ceil))
    ])
    found = resolve(values, locate(summarise(values, on), on, ranks), on)
    out = []
    for m, c in enumerate(columns):
        for i, (name, p) in enumerate(shares.items()):
            low, high = (F.max(F.when((F.col("m") == m) & (F.col("p") == 2 * i + k), F.col("value"))) for k in (0, 1))
            at = F.lit(float(p)) * (F.max(F.when(F.col("m") == m, F.col("n"))) - 1)
            out.append((low + F.when(high > low, high - low).otherwise(F.lit(0.0)) * (at - F.floor(at))).alias(f"{name}_{c}"))
    return found.groupBy(*by).agg(*out)
