"""Binary descriptors: nearest neighbours, ratio test, medoids, rotation agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import hamming


def sign_bits(vector: Column, size: int) -> Column:
    """Signs of a vector packed into BIGINTs, 32 to each."""
    words = []
    for w in range(0, size, 32):
        part = F.lit(0).cast("bigint")
        for i in range(w, min(w + 32, size)):
            part = part + F.when(vector[i] > 0, F.lit(1 << (i - w))).otherwise(F.lit(0)).cast("bigint")
        words.append(part)
    return F.array(*words)


def nearest_two(queries: DataFrame, train: DataFrame, words: int, blocks: int = 16) -> DataFrame:
    """Of each query (id, des) the nearest and second nearest train row: (query_id, best, d1, d2), the smaller id among equals.

    A stated query set against all rows, in blocks: each block of train rows
    meets all queries and keeps two per query, before the blocks meet.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("des").alias("q"))
    t = train.select(F.col("id").alias("t_id"), F.col("des").alias("t"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    each = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = t.join(each, "block").where("query_id <> t_id").select("query_id", "block", F.struct(hamming(F.col("q"), F.col("t"), words).alias("d"), F.col("t_id").alias("id")).alias("m"))
    least = Window.partitionBy("query_id", "block").orderBy("m")
    few = near.withColumn("k", F.row_number().over(least)).where("k <= 2")
    best = few.groupBy("query_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return best.select("query_id", F.col("m")[0]["id"].alias("best"), F.col("m")[0]["d"].alias("d1"), F.try_element_at("m", F.lit(2))["d"].alias("d2"))


def ratio_matches(nearest: DataFrame, ratio: float, most: int | None = None, *, needs_two: bool = True) -> DataFrame:
    """Matches whose distance is below ``ratio`` times the second one and at most ``most``; a query with one neighbour passes only if ``needs_two`` is off."""
    clear = F.col("d1") < ratio * F.col("d2")
    ok = F.coalesce(clear, F.lit(not needs_two))
    return nearest.where(ok if most is None else ok & (F.col("d1") <= most))


def unique_train(matches: DataFrame) -> DataFrame:
    """Of several queries with one train row the nearest, the smaller query among equals."""
    place = F.row_number().over(Window.partitionBy("best").orderBy("d1", "query_id"))
    return matches.withColumn("place", place).where("place = 1").drop("place")


def medoid_of_queries(queries: DataFrame, rows: DataFrame, by: str, words: int, blocks: int = 16) -> DataFrame:
    """Per group, of its query rows the one with the least median distance to all rows of the group (itself included); the smallest id among equals.

    A stated query set against all rows, in blocks: distances are counted per
    value before the shuffle, so a query sends at most 32 * words + 1 counts, and
    its median comes from these.
    """
    q = queries.select(by, F.col("id").alias("a"), F.col("des").alias("x")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    t = rows.select(by, F.col("des").alias("y"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    counts = t.join(q, [by, "block"]).groupBy(by, "a", hamming(F.col("x"), F.col("y"), words).alias("d")).agg(F.count("*").alias("c"))
    of = Window.partitionBy(by, "a")  # distances are few
    run = counts.withColumns({"upto": F.sum("c").over(of.orderBy("d")), "n": F.sum("c").over(of)})
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("d")))
    median = run.groupBy(by, "a").agg(((at(F.expr("(n + 1) div 2")) + at(F.expr("(n + 2) div 2"))) / 2.0).alias("median"))
    return median.groupBy(by).agg(F.min(F.struct("median", F.col("a").alias("id"))).alias("m")).select(by, "m.id", "m.median")


def medoid(rows: DataFrame, by: str, words: int) -> DataFrame:
    """Per group the row with the least median distance to all of its group, itself included; the smallest id among equals.

    Groups are the few observations of one point. The distances of a row are
    counted per value, so a group costs its pairs' counts and no list of them.
    """
    a = rows.select(by, F.col("id").alias("a"), F.col("des").alias("x"))
    b = rows.select(by, F.col("id").alias("b"), F.col("des").alias("y"))
    median = a.join(b, by).groupBy(by, "a").agg(F.percentile(hamming(F.col("x"), F.col("y"), words), 0.5).alias("median"))
    return median.groupBy(by).agg(F.min(F.struct("median", F.col("a").alias("id"))).alias("m")).select(by, "m.id", "m.median")


def rotation_histogram(matches: DataFrame, by: str, angle: str, bins: int = 12, keep: int = 3, least: float = 0.1) -> DataFrame:
    """Matches whose rotation falls in the ``keep`` fullest bins of their group; the second and third count only with ``least`` of the first.

    The bin is the angle's rounded (half to even) share of the circle, the last
    one being the first again. Equally full bins rank by their number.
    """
    b = F.bround(F.pmod(F.col(angle), F.lit(360.0)) * bins / 360.0, 0).cast("int") % bins
    placed = matches.withColumn("bin", b)
    counts = placed.groupBy(by, "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(F.desc("c"), "bin")
    good = counts.withColumns({"k": F.row_number().over(w), "most": F.max("c").over(Window.partitionBy(by))}).where((F.col("k") == 1) | ((F.col("k") <= keep) & (F.col("c") >= least * F.col("most"))))
    return placed.join(good.select(by, "bin"), [by, "bin"], "left_semi")


def octave_histogram(keypoints: DataFrame, image: str, octave: str) -> DataFrame:
    """Keypoints per octave and their mean number per image."""
    images = keypoints.agg(F.count_distinct(image)).first()[0]
    counts = keypoints.groupBy(F.col(octave).alias("octave")).agg(F.count("*").alias("keypoints"))
    return counts.select("octave", "keypoints", F.try_divide(F.col("keypoints").cast("double"), F.lit(images)).alias("per_image"))
