"""Matching by projection: points into images, keyframes with each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import hamming


def search_by_projection(projected: DataFrame, keypoints: DataFrame, by: str, radius: float, words: int, *, most: int, ratio: float | None = None, levels: tuple[int, int] = (-1, 0), claim: bool = True) -> DataFrame:
    """Keypoint for each projected point: (by, point, idx, distance).

    ``projected``: by, point, u, v, level (predicted), des, scale (of the radius);
    ``keypoints``: by, idx, u, v, octave, des. Candidates lie within the radius
    and octave - level in ``levels``; the one of least Hamming distance at most
    ``most`` wins, the smaller idx among equals. With ``ratio`` a best one needs
    to beat the second of its own octave. With ``claim`` a keypoint goes to the
    nearest of its points (the smaller point among equals).

    Both sides meet through cells of the greatest radius, each point looking into
    its own cell and those around it.
    """
    size = float(radius)
    # the radius grows with the point's scale: points look as many cells around as theirs needs
    p = projected.select(F.col(by).alias("e"), "point", F.col("u").alias("pu"), F.col("v").alias("pv"), "level", F.col("des").alias("pd"), (F.lit(size) * F.coalesce("scale", F.lit(1.0))).alias("r"))
    for a in "uv":
        p = p.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"p{a}") - F.col("r")) / size), F.floor((F.col(f"p{a}") + F.col("r")) / size))))
    k = keypoints.select(F.col(by).alias("e"), "idx", "u", "v", "octave", "des", F.floor(F.col("u") / size).alias("cu"), F.floor(F.col("v") / size).alias("cv"))
    inside = (F.col("u") - F.col("pu")) * (F.col("u") - F.col("pu")) + (F.col("v") - F.col("pv")) * (F.col("v") - F.col("pv")) <= F.col("r") * F.col("r")
    met = p.join(k, ["e", "cu", "cv"]).where(inside & (F.col("octave") - F.col("level")).between(*levels))
    met = met.select("e", "point", "idx", "octave", hamming(F.col("pd"), F.col("des"), words).alias("distance"))
    order = Window.partitionBy("e", "point").orderBy("distance", "idx")
    ranked = met.withColumns({"place": F.row_number().over(order), "d2": F.lead("distance").over(order), "o2": F.lead("octave").over(order)})
    best = ranked.where((F.col("place") == 1) & (F.col("distance") <= most))
    if ratio is not None:
        best = best.where(F.col("d2").isNull() | (F.col("o2") != F.col("octave")) | (F.col("distance") <= ratio * F.col("d2")))
    if claim:
        first = F.row_number().over(Window.partitionBy("e", "idx").orderBy("distance", "point"))
        best = best.withColumn("first", first).where("first = 1")
    return best.select(F.col("e").alias(by), "point", "idx", "distance")


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs (a, b) that are each other's match: forward (a, b), backward (b, a)."""
    return forward.join(backward.select(F.col("b"), F.col("a")), ["a", "b"])


def bucketed_matches(first: DataFrame, second: DataFrame, words: int, *, most: int, ratio: float, same: bool = False) -> DataFrame:
    """Matches within shared vocabulary nodes: rows (node, id, des) of two frames to (id1, id2, distance).

    With ``same`` both are rows of one table, and none is its own match. The ratio test applies where a node offers two neighbours; each second row
    goes to its nearest first row, the smaller id among equals.
    """
    a = first.select("node", F.col("id").alias("id1"), F.col("des").alias("d1"))
    b = second.select("node", F.col("id").alias("id2"), F.col("des").alias("d2"))
    met = a.join(b, "node").where("id1 <> id2" if same else "true").select("id1", "id2", hamming(F.col("d1"), F.col("d2"), words).alias("distance"))
    order = Window.partitionBy("id1").orderBy("distance", "id2")
    best = met.withColumns({"place": F.row_number().over(order), "next": F.lead("distance").over(order)}).where((F.col("place") == 1) & (F.col("distance") <= most))
    best = best.where(F.col("next").isNull() | (F.col("distance") < ratio * F.col("next")))
    first_come = F.row_number().over(Window.partitionBy("id2").orderBy("distance", "id1"))
    return best.withColumn("first", first_come).where("first = 1").select("id1", "id2", "distance")


def epipolar_candidates(first: DataFrame, second: DataFrame, f12: list[float], words: int, *, most: int, chi2: float = 3.84, same: bool = False) -> DataFrame:
    """Matches for triangulation: within shared nodes, near each other's epipolar line (F12 by rows), nearest descriptor first.

    Rows: (node, id, u, v, sigma2, des). With ``same`` both are rows of one table, and none is its own match.
    """
    a = first.select("node", F.col("id").alias("id1"), F.col("u").alias("u1"), F.col("v").alias("v1"), F.col("des").alias("d1"))
    b = second.select("node", F.col("id").alias("id2"), F.col("u").alias("u2"), F.col("v").alias("v2"), "sigma2", F.col("des").alias("d2"))
    f = [F.lit(float(x)) for x in f12]
    la = F.col("u1") * f[0] + F.col("v1") * f[3] + f[6]
    lb = F.col("u1") * f[1] + F.col("v1") * f[4] + f[7]
    lc = F.col("u1") * f[2] + F.col("v1") * f[5] + f[8]
    off = la * F.col("u2") + lb * F.col("v2") + lc
    near = (off * off < chi2 * F.col("sigma2") * (la * la + lb * lb)) & (la * la + lb * lb > 0)
    met = a.join(b, "node").where(near if not same else near & (F.col("id1") != F.col("id2"))).select("id1", "id2", hamming(F.col("d1"), F.col("d2"), words).alias("distance")).where(F.col("distance") <= most)
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("id1").orderBy("distance", "id2"))).where("place = 1")
    return met.withColumn("first", F.row_number().over(Window.partitionBy("id2").orderBy("distance", "id1"))).where("first = 1").select("id1", "id2", "distance")


def fuse_points(matches: DataFrame, observed: DataFrame, counts: DataFrame) -> DataFrame:
    """Points to merge: a projected point and the point its keypoint holds; the one with more observations stays, the projected one among equals.

    ``matches``: (kf, point, idx); ``observed``: (kf, idx, point); ``counts``:
    (point, n). Returns (kept, dropped) for keypoints that hold another point.
    """
    held = observed.select("kf", "idx", F.col("point").alias("old"))
    met = matches.join(held, ["kf", "idx"]).where("point <> old")
    n = counts.select(F.col("point").alias("old"), F.col("n").alias("n_old"))
    met = met.join(counts, "point", "left").join(n, "old", "left").na.fill(0, ["n", "n_old"])
    stays = F.col("n") >= F.col("n_old")
    return met.select(F.when(stays, F.col("point")).otherwise(F.col("old")).alias("kept"), F.when(stays, F.col("old")).otherwise(F.col("point")).alias("dropped")).distinct()


def correspondences(matches: DataFrame, observed: DataFrame) -> DataFrame:
    """Pairs of map points behind keypoint matches (kf1, idx1, kf2, idx2); keypoints without a point are left out."""
    one = observed.select(F.col("kf").alias("kf1"), F.col("idx").alias("idx1"), F.col("point").alias("point1"))
    two = observed.select(F.col("kf").alias("kf2"), F.col("idx").alias("idx2"), F.col("point").alias("point2"))
    return matches.join(one, ["kf1", "idx1"]).join(two, ["kf2", "idx2"]).where("point1 IS NOT NULL AND point2 IS NOT NULL")


def visible(x: Column, y: Column, z: Column, distance: Column, cosine: Column, least: Column, most: Column, u: Column, v: Column, width: float, height: float) -> Column:
    """Whether a point can be seen: before the camera, in the image, within its distance range, and from a like direction."""
    return (z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height) & distance.between(least, most) & (cosine > 0.5)


def triangulate(t1: np.ndarray, t2: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """World points of normalised image points in two views (4 x 4 camera poses), by the linear method."""
    out = np.empty((len(p1), 3))
    for n, ((x1, y1), (x2, y2)) in enumerate(zip(p1, p2)):
        a = np.stack([x1 * t1[2] - t1[0], y1 * t1[2] - t1[1], x2 * t2[2] - t2[0], y2 * t2[2] - t2[1]])
        h = np.linalg.svd(a)[2][-1]
        out[n] = h[:3] / h[3] if h[3] else np.nan
    return out


def backproject_depth(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float, factor: float, stride: int, most: float) -> np.ndarray:
    """Camera points of a depth image on a stride grid, of depths above 0 up to ``most``."""
    v, u = np.mgrid[0 : depth.shape[0] : stride, 0 : depth.shape[1] : stride]
    z = depth[v, u].astype(float) / factor
    ok = (z > 0) & (z <= most)
    return np.stack([(u[ok] - cx) / fx * z[ok], (v[ok] - cy) / fy * z[ok], z[ok]], axis=1)
