"""Rules of keyframe-based mapping as column expressions and joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import geom
from ..session import cut
from . import nearest

#: Submaps that go to all tasks at most (some tens of bytes each).
BROADCAST_SUBMAPS = 500_000

# --- fixed values ----------------------------------------------------------------------------------------------
FOUND_RATIO, YOUNG, OLD, FEW_OBSERVATIONS = 0.25, 2, 3, 3
REDUNDANT, OTHERS, PARENT_SECONDS = 0.60, 3, 0.10
LOOP_SCORE, LOOP_METRES, LOOP_RADIANS = 0.62, 1.0, 0.20944
# ---------------------------------------------------------------------------------------------------------------


def insertion_reasons(c: dict[str, Column]) -> dict[str, Column]:
    """Why a keyframe is inserted: c1a (long since the last), or c1b (idle) or c1c (weak tracking), and then c2 (few points, many missing close ones)."""
    c1a = c["frames_since"] >= c["most_frames"]
    c1b = (c["frames_since"] >= c["least_frames"]) & c["idle"]
    c1c = (c["tracked"] < c["reference"] * 0.25) | c["need_close"]
    c2 = ((c["tracked"] < c["reference"] * c["reference_ratio"]) | c["need_close"]) & (c["tracked"] > 15)
    return {"c1a": c1a, "c1b": c1b, "c1c": c1c, "c2": c2, "insert": c1a | ((c1b | c1c) & c2)}


def close_counts(points: DataFrame, by: str, threshold: float, least: float = 0.01) -> DataFrame:
    """Close keypoints (depth in (least, threshold)) that are tracked and that are not: tracked = has a point and is no outlier."""
    near = (F.col("depth") > least) & (F.col("depth") < threshold)
    tracked = F.col("has_point") & ~F.col("outlier")
    return points.groupBy(by).agg(F.count_if(near & tracked).alias("tracked"), F.count_if(near & ~tracked).alias("untracked"))


def new_depth_points(keypoints: DataFrame, by: str, threshold: float, nearest: int, observed: DataFrame | None = None) -> DataFrame:
    """Keypoints from which points are made: depths above 0.01, all below the threshold or the ``nearest`` ones, without an observed point."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("depth", "idx"))
    out = keypoints.where("depth > 0.01").withColumn("place", place).where((F.col("place") <= nearest) | (F.col("depth") < threshold)).drop("place")
    return out if observed is None else out.join(observed.select(by, "idx"), [by, "idx"], "left_anti")


def cull_points(points: DataFrame) -> DataFrame:
    """Verdict on recent points: 'bad' (found too seldom, or old enough with few observations), 'settled' (old), else 'recent'. Columns visible, found, age, observations."""
    seldom = F.try_divide(F.col("found").cast("double"), F.col("visible")) < FOUND_RATIO
    verdict = F.when(F.coalesce(seldom, F.lit(False)), "bad").when((F.col("age") >= YOUNG) & (F.col("observations") <= FEW_OBSERVATIONS), "bad").when(F.col("age") >= OLD, "settled").otherwise("recent")
    return points.withColumn("verdict", verdict)


def redundant_keyframes(observations: DataFrame, keyframes: DataFrame, ratio: float = REDUNDANT, least_points: int = 0) -> DataFrame:
    """Keyframes to remove: most of whose points ``OTHERS`` or more others see at an octave at most one coarser.

    Keyframe 0 and those within ``PARENT_SECONDS`` of their parent stay, as do
    those of at most ``least_points`` points. One pass over the present counts:
    keyframes are judged side by side and not one after another.
    ``observations``: (point, kf, octave); ``keyframes``: (kf, ts, parent_ts).

    The others of an observation are counted per octave, so that no pair of a
    point's observations is ever formed.
    """
    per = observations.groupBy("point", "octave").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("point").orderBy("octave").rangeBetween(Window.unboundedPreceding, 1))
    seen = observations.join(per.withColumn("others", upto - 1).select("point", "octave", "others"), ["point", "octave"])
    share = seen.groupBy("kf").agg(F.count("*").alias("points"), F.count_if(F.col("others") >= OTHERS).alias("redundant"))
    near = F.coalesce(F.abs(F.col("ts") - F.col("parent_ts")) < PARENT_SECONDS, F.lit(False))
    judged = share.join(keyframes, "kf").where((F.col("kf") != 0) & ~near & (F.col("points") > least_points))
    return judged.where(F.col("redundant") > ratio * F.greatest(F.col("points"), F.lit(1))).select("kf", "points", "redundant")


def loop_verdict(success: Column, score: Column, metres: Column, radians: Column, *, least: float = LOOP_SCORE) -> Column:
    """Gates of a verified loop in their order: match, score, residual."""
    low = F.coalesce(score < least, F.lit(True))
    far = (metres > LOOP_METRES) | (F.abs(radians) > LOOP_RADIANS)
    return F.when(~success, "match_failed").when(low, "rejected_score").when(far, "rejected_residual").otherwise("accepted")


def targets_of_nodes(nodes: DataFrame, submaps: DataFrame, members: DataFrame, *, radius: float, least_scans: int = 20, recent: int = 1, k: int = 4, broadcast_submaps: int = BROADCAST_SUBMAPS) -> DataFrame:
    """For each new node the ``k`` nearest finished submaps within ``radius`` that are not its own and not the ``recent`` last ones.

    ``nodes``: (node, x, y); ``submaps``: (submap, x, y, scans, finished);
    ``members``: (node, submap). The submaps go to all tasks, which keep of each
    node's pairs the best only. More than ``broadcast_submaps`` of them meet the
    nodes through cells of the radius' size, where all pairs move.
    """
    last = submaps.agg(F.max("submap")).first()[0]
    s = submaps.where(F.col("finished") & (F.col("scans") >= least_scans) & (F.col("submap") <= F.lit(last) - recent)).select("submap", "x", "y")
    few = s.limit(broadcast_submaps + 1).toPandas()
    if len(few) > broadcast_submaps:
        return _targets_by_cells(nodes, s, members, radius, k)
    few = _finite(few).sort_values("submap")
    ids, x, y = few["submap"].to_numpy(), few["x"].to_numpy(float), few["y"].to_numpy(float)
    schema = StructType([nodes.schema["node"], submaps.schema["submap"], StructField("distance", DoubleType()), StructField("place", IntegerType())])

    def kernel(batches):
        points = nearest.Points(x, y, radius)
        for t in nearest.chunks(batches, 16_384):
            places, own = t["places"].combine_chunks(), t["own"].combine_chunks()
            of, at = pc.list_parent_indices(places).to_numpy(), pc.list_flatten(places)
            qx, qy = (at.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            good = np.isfinite(qx) & np.isfinite(qy)
            of, qx, qy = of[good], qx[good], qy[good]
            is_own = _membership(ids, pc.list_parent_indices(own).to_numpy(), pc.list_flatten(own).to_numpy(zero_copy_only=False))
            # of owners without a place there is nothing to say
            owners, dense = np.unique(of, return_inverse=True)
            for q, p, d, place in nearest.nearest(points, dense, qx, qy, np.full(len(qx), radius), k, lambda q, p: ~is_own(of[q], p)):
                yield pa.RecordBatch.from_arrays([t["node"].combine_chunks().take(pa.array(of[q])), pa.array(ids[p]), pa.array(d), pa.array((place + 1).astype(np.int32))], names=schema.names)

    both = nodes.select("node", F.struct(F.col("x").cast("double"), F.col("y").cast("double")).alias("place"), F.lit(None).cast(members.schema["submap"].dataType).alias("own"))
    both = both.unionByName(members.where("node IS NOT NULL").select("node", F.lit(None).cast(both.schema["place"].dataType).alias("place"), F.col("submap").alias("own")))
    # a node may have been told several places and be in several submaps
    grouped = both.groupBy("node").agg(F.collect_list("place").alias("places"), F.collect_set("own").alias("own")).where(F.size("places") > 0)
    return grouped.mapInArrow(kernel, schema)


def _finite(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[np.isfinite(rows["x"].to_numpy(float)) & np.isfinite(rows["y"].to_numpy(float))]


def _membership(ids: np.ndarray, row: np.ndarray, submap: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of a row and an index of ``ids`` are among the pairs of row and submap."""
    names, rank = np.unique(ids, return_inverse=True)
    at = np.minimum(np.searchsorted(names, submap), max(0, len(names) - 1))
    known = names[at] == submap if len(names) else np.zeros(len(submap), bool)
    pairs = np.unique(row[known] * len(names) + at[known])

    def test(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return np.zeros(len(r), bool)
        code = r * len(names) + rank[p]
        return pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code

    return test


def _distance() -> Column:
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    return F.sqrt(dx * dx + dy * dy)


def _cell(at: Column, radius: float) -> Column:
    """Cell of the radius' size; what lies beyond 2^60 of them, or nowhere, shares the last ones."""
    return F.floor(F.least(F.greatest(at / radius, F.lit(-(2.0**60))), F.lit(2.0**60)))


def _targets_by_cells(nodes: DataFrame, submaps: DataFrame, members: DataFrame, radius: float, k: int) -> DataFrame:
    s = submaps.select("submap", F.col("x").alias("sx"), F.col("y").alias("sy"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    n = nodes
    for a in "xy":
        n = n.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{a}", _cell(F.col(a), radius) + F.col("o")).drop("o")
    met = n.join(s, ["cx", "cy"]).withColumn("distance", _distance()).where(F.col("distance") <= radius)
    met = met.join(members, ["node", "submap"], "left_anti")
    place = F.row_number().over(Window.partitionBy("node").orderBy("distance", "submap"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("node", "submap", "distance", "place")


def nodes_of_targets(submaps: DataFrame, nodes: DataFrame, members: DataFrame, *, radius: float, separation: int, stride: int = 1, cap: int | None = None, broadcast_submaps: int = BROADCAST_SUBMAPS) -> DataFrame:
    """For each newly finished submap the old nodes near it: not its own, ``separation`` ids before its first node, every ``stride``-th by distance, at most ``cap``.

    With ``cap`` and up to ``broadcast_submaps`` submaps, these go to all tasks.
    Nodes are laid out by place; any chunk of them that holds enough old nodes
    near a submap bounds how far its last one lies, and only pairs within the
    least bound move. Otherwise both meet through cells, where all pairs move.
    """
    first = members.groupBy("submap").agg(F.min("node").alias("first"))
    s = submaps.join(first, "submap").select("submap", "x", "y", "first")
    few = None if cap is None or separation <= 0 else s.limit(broadcast_submaps + 1).toPandas()  # own nodes are no older than the first
    if few is None or len(few) > broadcast_submaps:
        met = _old_nodes_by_cells(s, nodes, members, radius, separation)
    else:
        met = _nearest_old_nodes(_finite(few), nodes, submaps.schema["submap"], radius, separation, (cap - 1) * stride + 1)
    place = F.row_number().over(Window.partitionBy("submap").orderBy("distance", "node")) - 1
    out = met.withColumn("place", place).where(F.col("place") % stride == 0).withColumn("place", F.col("place") / stride)
    if cap is not None:
        out = out.where(F.col("place") < cap)
    return out.select("submap", "node", "distance")


def _old_nodes_by_cells(submaps: DataFrame, nodes: DataFrame, members: DataFrame, radius: float, separation: int) -> DataFrame:
    s = submaps.select("submap", F.col("x").alias("sx"), F.col("y").alias("sy"), "first")
    for a in "xy":
        s = s.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{a}", _cell(F.col(f"s{a}"), radius) + F.col("o")).drop("o")
    n = nodes.withColumns({f"c{a}": _cell(F.col(a), radius) for a in "xy"})
    met = s.join(n, ["cx", "cy"]).withColumn("distance", _distance())
    return met.where((F.col("distance") <= radius) & (F.col("node") <= F.col("first") - separation)).join(members, ["submap", "node"], "left_anti").select("submap", "node", "distance")


def _nearest_old_nodes(submaps: pd.DataFrame, nodes: DataFrame, submap: StructField, radius: float, separation: int, k: int) -> DataFrame:
    """Of each submap at least the ``k`` nearest old nodes within ``radius``: (submap, node, distance)."""
    ids, x, y, before = submaps["submap"].to_numpy(), submaps["x"].to_numpy(float), submaps["y"].to_numpy(float), submaps["first"].to_numpy() - separation

    def met(batches, reach: np.ndarray, inside: bool):
        """Each chunk's nearest nodes to the submaps that lie in it (``inside``), or that reach it."""
        for t in nearest.chunks(batches):
            node, px, py = (t[c].combine_chunks() for c in ("node", "x", "y"))
            ids_, px, py = node.to_numpy(), px.to_numpy(), py.to_numpy()
            far = 0.0 if inside else reach
            near = np.flatnonzero((x + far >= px.min()) & (x - far <= px.max()) & (y + far >= py.min()) & (y - far <= py.max()) & (before >= ids_.min()))
            for q, p, d, place in nearest.nearest(nearest.Points(px, py, radius), np.arange(len(near)), x[near], y[near], reach[near], k, lambda q, p: ids_[p] <= before[near[q]], ids_):
                yield near[q], node, p, d, place

    def bounds(batches):
        for q, _, _, d, place in met(batches, np.full(len(x), radius), True):
            last = place == k - 1
            yield pa.RecordBatch.from_arrays([pa.array(q[last]), pa.array(d[last])], names=["at", "bound"])

    laid = nodes.where(F.col("node").isNotNull() & geom.finite(F.col("x")) & geom.finite(F.col("y"))).select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    laid = cut(laid.orderBy(_interleaved(F.col("x") * (16 / radius), F.col("y") * (16 / radius)), "node"))
    least = laid.mapInArrow(bounds, "at BIGINT, bound DOUBLE").groupBy("at").agg(F.min("bound").alias("bound")).toPandas()
    reach = np.full(len(x), radius)
    reach[least["at"].to_numpy(int)] = least["bound"].to_numpy(float)
    schema = StructType([submap, nodes.schema["node"], StructField("distance", DoubleType())])

    def pairs(batches):
        for q, node, p, d, _ in met(batches, reach, False):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), node.take(pa.array(p)), pa.array(d)], names=schema.names)

    return laid.mapInArrow(pairs, schema)


def _interleaved(x: Column, y: Column) -> Column:
    """Number whose bits are in turn those of both cells (16 bits each), so that rows near each other in its order lie near each other."""

    def spread(c: Column) -> Column:
        c = F.pmod(F.floor(c), F.lit(65_536)).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def reference_score(scores: DataFrame, edges: DataFrame, relax: float = 0.15) -> DataFrame:
    """Least score of each keyframe with its neighbours, times ``relax``: the bar for its loop candidates; keyframes without neighbours have the least number there is."""
    met = edges.select(F.col("a").alias("kf"), F.col("b").alias("other")).join(scores, ["kf", "other"], "left")
    bar = met.groupBy("kf").agg(F.min("score").alias("least"))
    return bar.select("kf", F.coalesce(F.col("least") * relax, F.lit(-1.7976931348623157e308)).alias("bar"))


def viewing(points: DataFrame, observations: DataFrame, centres: DataFrame) -> DataFrame:
    """Mean viewing direction and distance range of each point over its observers. ``centres``: (kf, cx, cy, cz); observations: (point, kf)."""
    met = observations.join(points, "point").join(centres, "kf")
    d = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    sums = met.where(n > 0).groupBy("point").agg(*[F.avg(c / n).alias(f"n{a}") for c, a in zip(d, "xyz")], F.min(n).alias("least"), F.max(n).alias("most"))
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return sums.select("point", *[F.when(length > 0, F.col(f"n{a}") / length).alias(f"n{a}") for a in "xyz"], "least", "most")


def replace_points(observations: DataFrame, merged: DataFrame) -> DataFrame:
    """Observations after merges (kept, dropped): dropped points' observations go to the kept one, once per keyframe (the smaller idx)."""
    moved = observations.join(merged.select(F.col("dropped").alias("point"), "kept"), "point", "left")
    return moved.groupBy(F.coalesce("kept", "point").alias("point"), "kf").agg(F.min("idx").alias("idx"))


def grid_coverage(points: DataFrame, by: list[str], u: str, v: str, width: float, height: float, rows: int = 4, cols: int = 4) -> DataFrame:
    """Share of the cells of an image grid that hold a keypoint; keypoints off the image count for none."""
    cell = F.least(F.lit(rows - 1), F.floor(F.col(v) / height * rows)) * cols + F.least(F.lit(cols - 1), F.floor(F.col(u) / width * cols))
    inside = (F.col(u) >= 0) & (F.col(u) < width) & (F.col(v) >= 0) & (F.col(v) < height)
    return points.groupBy(*by).agg(F.count("*").alias("keypoints"), F.count_distinct(F.when(inside, cell)).alias("cells")).withColumn("coverage", F.col("cells") / float(rows * cols))
