"""Queries of operators that keep state or iterate; SQL can't say most of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import solvers
from ..operators.blocks import in_blocks, own, ranked, window
from ..operators.trajectory import extrapolate
from ..streaming import stateful
from . import views
from .trajectory_queries import _rounded
from .views import with_views

QUERIES, SQL = {}, {}
#: Ways of retrieval that propose candidates: a handful; every keyframe is asked of each.
MOST_SOURCES = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _planar(spark: SparkSession, d: str) -> DataFrame:
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    return views.gt(spark, d).select("sequence_id", "pose_id", F.col("ts").alias("t"), F.col("tx").alias("x"), F.col("ty").alias("y"), geom.quaternion_to_yaw(*q).alias("theta"))


@query()
def motion_filter(spark: SparkSession, d: str) -> DataFrame:
    """Poses that a motion filter keeps."""
    out = stateful.in_runs(_planar(spark, d), "sequence_id", ["t", "pose_id"], stateful.motion_runs(2.0, "sequence_id"), lambda: stateful.MotionFilter(0.2, math.radians(5), 2.0))
    return out.where("keep").select("sequence_id", "pose_id")


@query()
def debounce_filter(spark: SparkSession, d: str) -> DataFrame:
    """Poses that a debounce filter lets through."""
    out = stateful.in_runs(_planar(spark, d), "sequence_id", ["t", "pose_id"], stateful.debounce_runs(0.2, math.radians(5), "sequence_id"), lambda: stateful.Debounce(0.2, math.radians(5)))
    return out.where("NOT similar").select("sequence_id", "pose_id")


@query("""WITH w AS (SELECT sequence_id, pose_id, ts, tx, ty, ts - min(ts) OVER w AS span, tx - first_value(tx) OVER w AS dx, ty - first_value(ty) OVER w AS dy FROM v_gt WINDOW w AS (PARTITION BY sequence_id ORDER BY ts RANGE BETWEEN 1.5 PRECEDING AND CURRENT ROW)),
v AS (SELECT sequence_id, ts, tx, ty, CASE WHEN span > 0 THEN dx / span ELSE 0 END AS vx, CASE WHEN span > 0 THEN dy / span ELSE 0 END AS vy FROM w),
l AS (SELECT sequence_id, tx, ty, lag(tx) OVER o AS x0, lag(ty) OVER o AS y0, lag(vx) OVER o AS vx0, lag(vy) OVER o AS vy0, greatest(0, least(0.5, ts - lag(ts) OVER o)) AS dt FROM v WINDOW o AS (PARTITION BY sequence_id ORDER BY ts))
SELECT sequence_id, count(*) AS n, round(avg(sqrt((tx - x0 - vx0 * dt) * (tx - x0 - vx0 * dt) + (ty - y0 - vy0 * dt) * (ty - y0 - vy0 * dt))), 6) AS error FROM l WHERE x0 IS NOT NULL GROUP BY sequence_id""")
def pose_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of poses predicted from the velocity before."""
    p = _planar(spark, d)
    none = F.lit(None).cast("struct<x: double, y: double, theta: double>")
    out = extrapolate(p.select("sequence_id", "pose_id", "t", F.struct("x", "y", "theta").alias("pose"), none.alias("odom")), "sequence_id", ["t", "pose_id"]).where("predicted IS NOT NULL")
    off = F.hypot(F.col("pose.x") - F.col("predicted.x"), F.col("pose.y") - F.col("predicted.y"))
    return out.groupBy("sequence_id").agg(F.count("*").alias("n"), F.round(F.avg(off), 6).alias("error"))


@query("""WITH r AS (SELECT scan_id, row_number() OVER (PARTITION BY sensor_id ORDER BY t, scan_id) - 1 AS n FROM v_scans WHERE NOT isnan(t)), k AS (SELECT scan_id, n, (n - 150) // 100 * 2 + 2 + CASE WHEN (n - 150) % 100 >= 50 THEN 1 ELSE 0 END AS older FROM r)
SELECT scan_id, CASE WHEN n < 100 THEN [0, 1] WHEN n < 150 THEN [2] ELSE [older, older + 1] END::BIGINT[] AS inserted FROM k""")
def submap_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Submaps into which each scan goes, of a hundred scans each."""
    s = ranked(views.scans(spark, d).where(~F.isnan("t")).select("scan_id", "sensor_id", "t"), "sensor_id", ["t", "scan_id"], "place")
    return s.select("scan_id", stateful.submaps_of(F.col("place"), 100).alias("inserted"))


@query()
def consistency_groups(spark: SparkSession, d: str) -> DataFrame:
    """Loop candidates whose groups agree over successive keyframes, per source: all with a score of at least 0.3, best first.

    The queries of a source are all logged current keyframes: one for which the
    source has no such candidate clears the groups, so what follows it is a run of
    its own.
    """
    log = views.loops(spark, d)
    scored = log.where("candidate_score >= 0.3 AND NOT isnan(candidate_score) AND candidate_source IS NOT NULL").groupBy("candidate_source", "current_kf_id", "candidate_kf_id").agg(F.max("candidate_score").alias("score"))
    sources = [r[0] for r in log.where("candidate_source IS NOT NULL").select("candidate_source").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources of candidates")
    names = F.array(*[F.lit(s) for s in sorted(sources)]).cast("array<string>")
    asked = log.select("current_kf_id").distinct().select(F.explode(names).alias("candidate_source"), "current_kf_id")
    empty = asked.join(scored, ["candidate_source", "current_kf_id"], "left_anti").withColumns({"candidate_kf_id": F.lit(-1).cast("bigint"), "score": F.lit(0.0), "found": F.lit(False)})
    rows = scored.withColumn("found", F.lit(True)).unionByName(empty).select("candidate_source", F.col("current_kf_id").alias("query"), F.col("candidate_kf_id").alias("candidate"), (-F.col("score")).alias("worse"), "found")
    # a candidate's group: keyframes within five of it
    after_none = ~F.lag("found").over(window("candidate_source"))
    out = stateful.in_runs(rows, "candidate_source", ["query", "worse", "candidate"], after_none, lambda: stateful.CandidateConsistency(reach=5))
    return out.where("passed").select("candidate_source", F.col("query").alias("current_kf_id"), F.col("candidate").alias("candidate_kf_id"))


@query()
def pose_graph_optimisation(spark: SparkSession, d: str) -> DataFrame:
    """Pose graph per sequence of one pose a second: estimated motion as odometry, ground-truth relations ten seconds apart as loops."""
    m = views.matched(spark, d).select("sequence_id", "pose_id", "ts", views.planar("e_").alias("e"), views.planar("g_").alias("g"))
    nodes = m.groupBy("sequence_id", F.floor("ts").alias("node")).agg(F.min_by(F.struct("e", "g"), F.struct("ts", "pose_id")).alias("p")).select("sequence_id", "node", "p.e", "p.g")
    w = window("sequence_id")
    ahead = own(in_blocks(nodes, "sequence_id", ["node"], after=10).withColumns({"n1": F.lead("node").over(w), "e1": F.lead("e").over(w), "n10": F.lead("node", 10).over(w), "g10": F.lead("g", 10).over(w)}))

    def edge(frm: str, to: str, node: str, loop: bool, w_xy: float, w_theta: float) -> DataFrame:
        z = geom.se2_between(F.col(frm), F.col(to))
        return ahead.where(F.col(node).isNotNull()).withColumn("z", z).select("sequence_id", F.col("node").alias("i"), F.col(node).alias("j"), F.col("z.x").alias("dx"), F.col("z.y").alias("dy"), F.col("z.theta").alias("dtheta"), F.lit(w_xy).alias("w_xy"), F.lit(w_theta).alias("w_theta"), F.lit(loop).alias("loop"))

    edges = edge("e", "e1", "n1", False, 500.0, 1600.0).unionByName(edge("g", "g10", "n10", True, 11000.0, 100000.0))
    return _rounded(solvers.solve_pose_graphs(nodes.select("sequence_id", "node", "e.*"), edges, "sequence_id"), 4)


@query("""SELECT sequence_id, min(lo) AS first_ts, max(hi) AS last_ts, count(*) AS runs FROM (SELECT sequence_id, run, min(ts) AS lo, max(ts) AS hi FROM (
  SELECT sequence_id, ts, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY ts) AS run FROM (SELECT sequence_id, ts, ts - lag(ts) OVER (PARTITION BY sequence_id ORDER BY ts) AS gap FROM v_gt)) GROUP BY sequence_id, run) GROUP BY sequence_id""")
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each sequence: a gap of over five seconds begins a new one."""
    cut_up = in_blocks(views.gt(spark, d).select("sequence_id", "ts"), "sequence_id", ["ts"], before=1)
    p = own(cut_up.withColumn("gap", F.col("ts") - F.lag("ts").over(window("sequence_id"))))
    return p.groupBy("sequence_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.count_if(F.col("gap") > 5) + 1).alias("runs"))


@query()
def tracking_states(spark: SparkSession, d: str) -> DataFrame:
    """State of tracking after each frame of the runs; timings and counters stand in for what each attempt gives."""
    t = views.timing(spark, d).select(
        "run_id", "frame_idx", (F.col("map_points") > 0).alias("initialised"), ((F.col("slam_track_sec") >= 0) & ~F.isnan("slam_track_sec")).alias("by_motion"), (F.col("keyframes") > 0).alias("by_keyframe"),
        (F.col("local_mapping_sec") >= 0).alias("in_map"), (F.col("load_rgb_sec") > 0).alias("relocalised"),
    )
    out = stateful.in_order(t, "run_id", ["frame_idx"], stateful.Tracking)
    return out.select("run_id", "frame_idx", "was", "state", "how", "model")
