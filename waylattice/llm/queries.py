"""The pN_ queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .contamination import leaked_passages
from .mixture import mix_sources
from .nearest_time import nearest_in_time
from .percentiles import percentiles, percentiles_bounded
from .subjects import subject_areas
from .top_n import top_n_per_group

TIMINGS = ("slam_track_sec", "frame_total_sec", "rss_mb")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    poses = table(spark, d, "est_poses").select(F.lit(0).alias("kind"), F.col("pose_id").alias("id"), F.col("sequence_id").alias("entity"), "ts")
    frames = table(spark, d, "associations").select(F.lit(1).alias("kind"), F.col("entry_id").alias("id"), F.col("sequence_id").alias("entity"), F.col("rgb_ts").alias("ts"))
    truth = table(spark, d, "gt_poses").select(F.col("pose_id").alias("id"), F.col("sequence_id").alias("entity"), "ts")
    found = nearest_in_time(poses.unionByName(frames), truth, 0.02)
    return found.select(F.when(F.col("kind") == 0, "pose").otherwise("frame").alias("kind"), F.col("match").alias("gt_pose_id"), F.col("id").alias("record_id"), "dt")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).drop("dt")


def p1_time_diff(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("time_diff", F.round("dt", 6)).drop("dt")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "loop_debug"), "current_kf_id", "candidate_kf_id", "candidate_score", 5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("candidate_kf_id", "current_kf_id")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("current_kf_id", "candidate_kf_id", "candidate_score", "rank")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(table(spark, d, "frame_timing"), "run_id", "run_day", "frame_idx", TIMINGS)


def p5_bounded(spark: SparkSession, d: str) -> DataFrame:
    return percentiles_bounded(table(spark, d, "frame_timing"), "run_id", "run_day", "frame_idx", TIMINGS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), by_size=True)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each target; sources without documents reach nothing."""
    name = F.lower(F.trim("source"))
    targets = table(spark, d, "source_targets").select(name.alias("source"), "target_share", "max_repeats")
    used = _mixture(spark, d).groupBy("source").agg(
        F.first("reached_share").alias("reached"), F.first("reached_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"),
    )
    return targets.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("reached", F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean posterior of each subject in the corpus."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("posterior"), 6).alias("posterior"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_time_diff, p2_found, p2_ranked, p5_percentiles, p5_bounded, p6_found, p7_mixture, p7_shares, p8_found, p8_composition)
}
