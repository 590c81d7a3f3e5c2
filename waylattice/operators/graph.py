"""Keyframe graphs: covisibility, neighbours, spanning trees, inverted-index overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_LEAST = 15


def shared_items(observations: DataFrame, owner: str, item: str, queries: Column | None = None) -> DataFrame:
    """(a, b, shared): items that two owners share, a < b; with ``queries`` (a predicate on ``owner``) a is a query and b any other owner.

    The equi-join on the item is the inverted index; items that occur once for
    an owner several times count once.
    """
    seen = observations.where(F.col(owner).isNotNull() & F.col(item).isNotNull()).select(F.col(owner).alias("o"), F.col(item).alias("i")).distinct()
    a = seen.select(F.col("o").alias("a"), "i")
    if queries is not None:
        a = observations.where(queries).where(F.col(owner).isNotNull() & F.col(item).isNotNull()).select(F.col(owner).alias("a"), F.col(item).alias("i")).distinct()
    met = a.join(seen.select(F.col("o").alias("b"), "i"), "i").where("a <> b" if queries is not None else "a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def best_neighbours(edges: DataFrame, n: int) -> DataFrame:
    """Of edges (a, b, w) the ``n`` heaviest of each a, the smaller b first among equals; adds ``place``."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    return edges.withColumn("place", place).where(F.col("place") <= n)


def connections(edges: DataFrame, least: int = EDGE_LEAST) -> DataFrame:
    """Ordered connections of each keyframe: edges (a, b, w) of weight ``least`` or more, else its single heaviest."""
    best = edges.groupBy("a").agg(F.max(F.struct("w", (-F.col("b")).alias("order"), "b")).alias("m")).where(F.col("m.w") < least)
    return edges.where(F.col("w") >= least).select("a", "b", "w").unionByName(best.select("a", "m.b", "m.w"))


def parents(edges: DataFrame) -> DataFrame:
    """Spanning parent of each keyframe: the older keyframe (smaller id) it shares most with."""
    return edges.where("b < a").groupBy("a").agg(F.max(F.struct(F.col("w"), (-F.col("b")).alias("order"), F.col("b").alias("parent"))).alias("m")).select(F.col("a").alias("kf_id"), "m.parent", F.col("m.w").alias("shared"))


def edge_union(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Undirected edges (a, b, w) of several kinds in one table: per kind and unordered pair the greatest weight; loops to itself and negative ids are left out."""
    parts = [e.select(F.lit(kind).alias("kind"), F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.col("w").alias("weight")) for kind, e in kinds]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("source <> target AND source >= 0 AND target >= 0").groupBy("kind", "source", "target").agg(F.max("weight").alias("weight"))


def essential_edges(edges: DataFrame) -> DataFrame:
    """Of each pair the edge of the first kind: loop, then spanning_tree, then covisibility, with its information."""
    from ..functions.geom import edge_information

    order = F.when(F.col("kind") == "loop", 0).when(F.col("kind") == "spanning_tree", 1).otherwise(2)
    once = edges.groupBy("source", "target").agg(F.min_by(F.struct("kind", "weight"), order).alias("e")).select("source", "target", "e.kind", "e.weight")
    return once.withColumn("information", edge_information(F.col("kind"), F.col("weight")))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w) in both directions, each with its greatest weight; loops to itself and null weights are left out."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.where("a <> b AND w IS NOT NULL").groupBy("a", "b").agg(F.max("w").alias("w"))


def second_ring(edges: DataFrame, frames: DataFrame, n: int) -> DataFrame:
    """(frame, kf, ring): a frame's own keyframe (0), its ``n`` best neighbours (1) and their ``n`` best ones (2), each in its nearest ring. ``frames``: (frame, kf)."""
    near = best_neighbours(edges, n).select("a", "b")
    one = frames.join(near, F.col("kf") == F.col("a")).select("frame", F.col("b").alias("kf"))
    two = one.join(near, F.col("kf") == F.col("a")).select("frame", F.col("b").alias("kf"))
    rings = [x.select("frame", "kf", F.lit(i).alias("ring")) for i, x in enumerate((frames, one, two))]
    return rings[0].unionByName(rings[1]).unionByName(rings[2]).groupBy("frame", "kf").agg(F.min("ring").alias("ring"))


def essential_vertices(keyframes: DataFrame, edges: DataFrame, corrected: DataFrame) -> DataFrame:
    """Keyframes of the optimisation (kf_id, corrected): those of the map, those named by an edge and those corrected, each once."""
    named = edges.select(F.col("source").alias("kf_id")).unionByName(edges.select(F.col("target").alias("kf_id"))).unionByName(keyframes.select("kf_id"))
    all_ = named.select("kf_id", F.lit(False).alias("c")).unionByName(corrected.select("kf_id", F.lit(True).alias("c")))
    return all_.where("kf_id >= 0").groupBy("kf_id").agg(F.max("c").alias("corrected"))


def erase_keyframes(parents: DataFrame, erased: DataFrame, hops: int = 10) -> DataFrame:
    """Spanning tree (kf_id, parent) without the erased keyframes: children take the nearest ancestor that is left, up to ``hops`` steps; none: null."""
    up = ancestors(parents, hops).join(erased.select(F.col("kf_id").alias("ancestor")), "ancestor", "left_anti")
    nearest = up.groupBy("kf_id").agg(F.min_by("ancestor", "hops").alias("parent"))
    return parents.select("kf_id").join(erased.select("kf_id"), "kf_id", "left_anti").join(nearest, "kf_id", "left")


def ancestors(parents: DataFrame, hops: int = 10) -> DataFrame:
    """(kf_id, ancestor, hops) along the parents, up to ``hops`` steps, by repeated joins."""
    up = parents.select(F.col("kf_id").alias("p_id"), F.col("parent").alias("grand"))
    level = parents.select("kf_id", F.col("parent").alias("ancestor")).withColumn("hops", F.lit(1))
    out = level
    for n in range(2, hops + 1):
        level = level.join(up, level["ancestor"] == up["p_id"]).select("kf_id", F.col("grand").alias("ancestor"), F.lit(n).alias("hops"))
        out = out.unionByName(level)
    return out


def local_map(votes: DataFrame, edges: DataFrame, cap: int = 80, ring: int = 10) -> DataFrame:
    """Keyframes of the local map of each frame: those with votes (frame, kf, votes) in their order, then their best neighbours, first come, ``cap`` in all."""
    # a frame with ``cap`` keyframes of its own takes no others, so no more of them are looked at (Spark limits them before the shuffle)
    own = votes.select("frame", "kf", F.lit(0).alias("ring"), F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("votes"), "kf")).alias("order")).where(F.col("order") <= cap)
    near = own.join(best_neighbours(edges, ring), own["kf"] == F.col("a")).select("frame", F.col("b").alias("kf"), F.lit(1).alias("ring"), "order")
    once = own.unionByName(near).groupBy("frame", "kf").agg(F.min(F.struct("ring", "order")).alias("at"))
    place = F.row_number().over(Window.partitionBy("frame").orderBy("at.ring", "at.order", "kf"))
    return once.withColumn("place", place).where(F.col("place") <= cap).select("frame", "kf", "place")


def normalised_bags(words: DataFrame, owner: str, weight: str) -> DataFrame:
    """Adds ``v``: the share of its owner's weights that a word has."""
    total = words.groupBy(owner).agg(F.sum(weight).alias("_total"))
    return words.join(total, owner).where("_total > 0").withColumn("v", F.col(weight) / F.col("_total")).drop("_total")


def bag_scores(queries: DataFrame, bags: DataFrame, owner: str, word: str, value: str) -> DataFrame:
    """Similarity of bags of words of total one: one less half the sum of absolute differences, which only shared words make.

    Returns (query, other, shared, score) for each query and other owner that share a word.
    """
    a = queries.select(F.col(owner).alias("query"), F.col(word).alias("w"), F.col(value).alias("x"))
    b = bags.select(F.col(owner).alias("other"), F.col(word).alias("w"), F.col(value).alias("y"))
    part = (F.col("x") + F.col("y") - F.abs(F.col("x") - F.col("y"))) / 2
    return a.join(b, "w").where("query <> other").groupBy("query", "other").agg(F.count("*").alias("shared"), F.sum(part).alias("score"))


def relocalisation(scores: DataFrame, ratio: float, keep: int) -> DataFrame:
    """Of (query, kf, shared, score) those with more than ``ratio`` (rounded down) of the query's most shared words, the ``keep`` best; adds ``place``."""
    most = scores.groupBy("query").agg(F.max("shared").alias("_most"))
    enough = scores.join(most, "query").where(F.col("shared") > F.floor(F.col("_most") * ratio)).drop("_most")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "kf"))
    return enough.withColumn("place", place).where(F.col("place") <= keep)
