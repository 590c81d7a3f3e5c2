"""Queries of scalar geometry, keyframe rules and projection matching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import graph, keyframes, projection
from ..sources import text
from ..sources.tables import table
from . import map_queries, views
from .map_queries import _DES, _LOG_EDGES
from .trajectory_queries import _WRAP, _rounded
from .views import with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


@query(f"""WITH s AS (SELECT DISTINCT ON (scan_id) scan_id, odom, laser_pose FROM scans WHERE scan_id IS NOT NULL AND sensor_id IS NOT NULL AND t IS NOT NULL AND len(ranges) > 0)
SELECT scan_id, round(cos(odom.theta) * (laser_pose.x - odom.x) + sin(odom.theta) * (laser_pose.y - odom.y), 6) AS x, round(-sin(odom.theta) * (laser_pose.x - odom.x) + cos(odom.theta) * (laser_pose.y - odom.y), 6) AS y,
  round({_WRAP.format('laser_pose.theta - odom.theta')}, 6) AS theta FROM s WHERE odom.theta IS NOT NULL AND laser_pose.theta IS NOT NULL AND odom.x IS NOT NULL AND laser_pose.x IS NOT NULL""")
def odom_to_laser(spark: SparkSession, d: str) -> DataFrame:
    """The laser's pose in the frame of the odometry."""
    s = views.scans(spark, d).where("odom.theta IS NOT NULL AND laser_pose.theta IS NOT NULL AND odom.x IS NOT NULL AND laser_pose.x IS NOT NULL")
    return _rounded(s.select("scan_id", geom.se2_between(F.col("odom"), F.col("laser_pose")).alias("p")).select("scan_id", "p.x", "p.y", "p.theta"))


@query("""WITH c AS (SELECT pose_id, tx AS x, ty AS y, tz + 3 AS z FROM v_gt)
SELECT pose_id, round(500 * x / z + 320, 6) AS u, round(500 * y / z + 240, 6) AS v, round(500 * x / z + 320 - 40 / z, 6) AS ur, (500 * x / z + 320 >= 0 AND 500 * x / z + 320 < 640 AND 500 * y / z + 240 >= 0 AND 500 * y / z + 240 < 480) AS seen FROM c WHERE z > 0""")
def pinhole_projection(spark: SparkSession, d: str) -> DataFrame:
    """Positions three metres ahead of a camera, in its stereo image."""
    c = views.gt(spark, d).select("pose_id", F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("tz") + 3).alias("z")).where("z > 0")
    u, v, ur = geom.project_stereo(F.col("x"), F.col("y"), F.col("z"), 500.0, 500.0, 320.0, 240.0, 40.0)
    return _rounded(c.select("pose_id", u.alias("u"), v.alias("v"), ur.alias("ur"), geom.in_image(u, v, F.col("z"), 640, 480).alias("seen")))


@query("""WITH p AS (SELECT sequence_id, 500 * tx / (tz + 3) + 320 AS u, 500 * ty / (tz + 3) + 240 AS v FROM v_gt WHERE tz + 3 > 0),
c AS (SELECT sequence_id, count(*) AS keypoints, count(DISTINCT CASE WHEN u >= 0 AND u < 640 AND v >= 0 AND v < 480 THEN least(3, floor(v / 480 * 4)) * 4 + least(3, floor(u / 640 * 4)) END) AS cells FROM p GROUP BY sequence_id)
SELECT sequence_id, keypoints, cells, cells / 16.0::DOUBLE AS coverage FROM c""")
def image_grid_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = views.gt(spark, d).where("tz + 3 > 0").select("sequence_id", (500 * F.col("tx") / (F.col("tz") + 3) + 320).alias("u"), (500 * F.col("ty") / (F.col("tz") + 3) + 240).alias("v"))
    return keyframes.grid_coverage(c, ["sequence_id"], "u", "v", 640.0, 480.0)


@query("""SELECT pose_id, round(CASE WHEN e <= 0.02 THEN 1.0 ELSE 0.02 / e END, 6) AS weight FROM (SELECT pose_id, sqrt((e_tx - g_tx) * (e_tx - g_tx) + (e_ty - g_ty) * (e_ty - g_ty) + (e_tz - g_tz) * (e_tz - g_tz)) AS e FROM v_near)""")
def robust_weights(spark: SparkSession, d: str) -> DataFrame:
    """Huber weight of each pose's error."""
    from ..operators.trajectory import distance

    e = distance([F.col("e_t" + c) for c in "xyz"], [F.col("g_t" + c) for c in "xyz"])
    return _rounded(views.matched(spark, d).withColumn("e", e).select("pose_id", geom.huber_weight(F.col("e"), 0.02).alias("weight")))


@query("""SELECT event_id, CASE WHEN NOT coalesce(passed_consistency, false) THEN 'match_failed' WHEN candidate_score IS NULL OR isnan(candidate_score) OR candidate_score < 0.62 THEN 'rejected_score' WHEN candidate_ts IS NOT NULL AND abs(current_ts - candidate_ts) / 1000.0 > 1.0 THEN 'rejected_residual' ELSE 'accepted' END AS verdict FROM v_loops""")
def loop_verification(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each candidate: match, score, residual (here the time between, in kiloseconds)."""
    score = F.nanvl("candidate_score", F.lit(None).cast("double"))
    off = F.coalesce(F.abs(F.col("current_ts") - F.col("candidate_ts")) / 1000.0, F.lit(0.0))
    return views.loops(spark, d).select("event_id", keyframes.loop_verdict(F.coalesce("passed_consistency", F.lit(False)), score, off, F.lit(0.0)).alias("verdict"))


@query("""SELECT current_kf_id, candidate_kf_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY current_kf_id, candidate_kf_id ORDER BY coalesce(passed_consistency, false) DESC, final_inliers DESC NULLS LAST, event_id) AS k FROM v_loops) WHERE k = 1""")
def best_record_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of several records of a pair the accepted one with most inliers."""
    best = text.best_per_pair(views.loops(spark, d), ["current_kf_id", "candidate_kf_id"], F.coalesce("passed_consistency", F.lit(False)), F.col("final_inliers"), -F.col("event_id"))
    return best.select("current_kf_id", "candidate_kf_id", "event_id")


@query("""WITH s AS (SELECT current_kf_id, candidate_kf_id, max(candidate_score) AS score FROM v_loops WHERE candidate_score >= 0 AND NOT isnan(candidate_score) GROUP BY ALL), e AS (SELECT DISTINCT current_kf_id, candidate_kf_id FROM v_loops)
SELECT current_kf_id AS kf, round(min(score) * 0.15, 9) AS bar FROM e LEFT JOIN s USING (current_kf_id, candidate_kf_id) GROUP BY current_kf_id""")
def reference_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Bar for each keyframe's candidates, from its least score; null for the gate that is off."""
    log = views.loops(spark, d)
    scores = log.where("candidate_score >= 0 AND NOT isnan(candidate_score)").groupBy(F.col("current_kf_id").alias("kf"), F.col("candidate_kf_id").alias("other")).agg(F.max("candidate_score").alias("score"))
    edges = log.select(F.col("current_kf_id").alias("a"), F.col("candidate_kf_id").alias("b")).distinct()
    return _rounded(keyframes.reference_score(scores, edges).select("kf", F.when(F.col("bar") > -1e300, F.col("bar")).alias("bar")), 9)


_CULL = """o AS (SELECT DISTINCT l_partkey AS point, l_orderkey AS kf, min(l_linenumber) AS octave FROM lineitem GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY point ORDER BY octave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) - 1 AS others FROM o),
s AS (SELECT kf, count(*) AS points, count(*) FILTER (WHERE others >= 3) AS redundant FROM c GROUP BY kf)"""


@query(f"WITH {_CULL} SELECT kf, points, redundant FROM s JOIN orders ON kf = o_orderkey WHERE kf <> 0 AND redundant > 0.6 * points")
def keyframe_culling(spark: SparkSession, d: str) -> DataFrame:
    """Redundant keyframes; orders stand for keyframes, parts for points, line numbers for octaves."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("point"), F.col("l_orderkey").alias("kf")).agg(F.min("l_linenumber").alias("octave"))
    kf = table(spark, d, "orders").select(F.col("o_orderkey").alias("kf"), F.lit(0.0).alias("ts"), F.lit(None).cast("double").alias("parent_ts"))
    return keyframes.redundant_keyframes(o, kf)


@query("""SELECT frame_idx, run_id, CASE WHEN map_points > 0 AND keyframes * 10.0 / map_points < 0.25 THEN 'bad' WHEN recent_frames >= 2 AND keyframes <= 3 THEN 'bad' WHEN recent_frames >= 3 THEN 'settled' ELSE 'recent' END AS verdict FROM v_timing""")
def point_culling(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the point rule on the counters of each frame."""
    t = views.timing(spark, d).select("run_id", "frame_idx", F.col("map_points").alias("visible"), (F.col("keyframes") * 10).alias("found"), F.col("recent_frames").alias("age"), F.col("keyframes").alias("observations"))
    return keyframes.cull_points(t).select("run_id", "frame_idx", "verdict")


@query("""WITH m AS (SELECT run_id, frame_idx, frame_idx % 30 >= 20 AS c1a, frame_idx % 30 >= 5 AND local_mapping_sec = 0 AS c1b, map_points < keyframes * 100 * 0.25 OR loop_closing_sec > 0 AS c1c, (map_points < keyframes * 100 * 0.9 OR loop_closing_sec > 0) AND map_points > 15 AS c2 FROM v_timing)
SELECT run_id, frame_idx, c1a, c1b, c1c, c2, c1a OR ((c1b OR c1c) AND c2) AS "insert" FROM m""")
def keyframe_insertion(spark: SparkSession, d: str) -> DataFrame:
    """Reasons for inserting a keyframe at each frame, on the run log's counters."""
    c = {
        "frames_since": F.col("frame_idx") % 30, "most_frames": F.lit(20), "least_frames": F.lit(5), "idle": F.col("local_mapping_sec") == 0, "tracked": F.col("map_points"), "reference": F.col("keyframes") * 100,
        "reference_ratio": F.lit(0.9), "need_close": F.col("loop_closing_sec") > 0,
    }
    return views.timing(spark, d).select("run_id", "frame_idx", *[v.alias(k) for k, v in keyframes.insertion_reasons(c).items()])


@query(f"""WITH {_DES}, m AS (SELECT q.id AS id1, t.id AS id2, bit_count(xor(q.a, t.a)) + bit_count(xor(q.b, t.b)) AS d FROM des q JOIN des t ON q.label = t.label WHERE q.id % 20 = 0 AND t.id <> q.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS k, lead(d) OVER (PARTITION BY id1 ORDER BY d, id2) AS d2 FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY d, id1) AS place FROM k WHERE k = 1 AND d <= 30 AND (d2 IS NULL OR d < 0.95 * d2))
SELECT id1, id2, CAST(d AS INTEGER) AS distance FROM u WHERE place = 1""")
def bucketed_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches within shared vocabulary nodes (labels); queries are the rows whose id is divisible by 20."""
    des = map_queries._descriptors(spark, d).withColumnRenamed("label", "node")
    got = projection.bucketed_matches(des.where("id % 20 = 0"), des, 2, most=30, ratio=0.95, same=True)
    return got.select("id1", "id2", F.col("distance").cast("int").alias("distance"))


@query("""WITH q AS (SELECT sequence_id, pose_id AS point, tx * 100 AS pu, ty * 100 AS pv, CAST(round(abs(tz) * 100, 0) AS BIGINT) AS des FROM v_est WHERE pose_id % 20 = 0),
k AS (SELECT sequence_id, pose_id AS idx, tx * 100 AS u, ty * 100 AS v, CAST(round(abs(tz) * 100, 0) AS BIGINT) AS des FROM v_gt),
m AS (SELECT q.sequence_id, point, idx, bit_count(xor(q.des, k.des)) AS d FROM q JOIN k ON q.sequence_id = k.sequence_id AND (u - pu) * (u - pu) + (v - pv) * (v - pv) <= 9.0),
b AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, point ORDER BY d, idx) AS k FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, idx ORDER BY d, point) AS first FROM b WHERE k = 1 AND d <= 4)
SELECT sequence_id, point, idx, CAST(d AS INTEGER) AS distance FROM c WHERE first = 1""")
def projection_search(spark: SparkSession, d: str) -> DataFrame:
    """Matches by place and descriptor: estimated poses whose id is divisible by 20 against all ground truth, within three centimetres."""
    code = F.array(F.round(F.abs("tz") * 100, 0).cast("bigint"))
    p = views.est(spark, d).where("pose_id % 20 = 0").select("sequence_id", F.col("pose_id").alias("point"), (F.col("tx") * 100).alias("u"), (F.col("ty") * 100).alias("v"), F.lit(0).alias("level"), code.alias("des"), F.lit(1.0).alias("scale"))
    k = views.gt(spark, d).select("sequence_id", F.col("pose_id").alias("idx"), (F.col("tx") * 100).alias("u"), (F.col("ty") * 100).alias("v"), F.lit(0).alias("octave"), code.alias("des"))
    got = projection.search_by_projection(p, k, "sequence_id", 3.0, 1, most=4)
    return got.select("sequence_id", "point", "idx", F.col("distance").cast("int").alias("distance"))


@query(f"""WITH {_LOG_EDGES}, own AS (SELECT a AS frame, b AS kf, 0 AS ring, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS o FROM edges),
best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges) WHERE k <= 10),
every AS (SELECT * FROM own UNION ALL SELECT frame, b, 1, o FROM own JOIN best ON own.kf = best.a),
once AS (SELECT frame, kf, min(ring * 1000000 + o) AS place_at FROM every GROUP BY frame, kf)
SELECT frame, kf, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY place_at, kf) AS k FROM once) WHERE k <= 80""")
def local_map_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Local map of each keyframe: those it shares words with, then their best neighbours, eighty at most."""
    e = map_queries._graph(spark, d)
    return graph.local_map(e.select(F.col("a").alias("frame"), F.col("b").alias("kf"), F.col("w").alias("votes")), e)


@query(f"SELECT {', '.join(f'round({e}, 9) AS {n}' for n, e in (('fov', f'2 * atan(640 / (2 * 500.0))'), ('focal', f'640 / (2 * tan({math.pi / 3} / 2))')))}, s.name AS dataset FROM datasets s")
def camera_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Field of view and focal length conversions."""
    return table(spark, d, "datasets").select(F.col("name").alias("dataset"), F.round(geom.focal_to_fov(F.lit(500.0), F.lit(640)), 9).alias("fov"), F.round(geom.fov_to_focal(F.lit(math.pi / 3), F.lit(640)), 9).alias("focal"))
