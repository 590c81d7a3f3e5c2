"""Queries on trajectories: association in time, errors, motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import asof, trajectory
from ..operators.blocks import in_blocks, own, window
from . import views
from .views import _YAW, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


@query("""
SELECT entry_id, match_id, round(dt, 6) AS dt FROM (
  SELECT f.entry_id, CASE WHEN abs(g.ts - f.rgb_ts) <= 0.05 THEN g.pose_id END AS match_id, CASE WHEN abs(g.ts - f.rgb_ts) <= 0.05 THEN abs(g.ts - f.rgb_ts) END AS dt,
    row_number() OVER (PARTITION BY f.entry_id ORDER BY CASE WHEN abs(g.ts - f.rgb_ts) <= 0.05 THEN abs(g.ts - f.rgb_ts) END NULLS LAST, g.ts) AS k
  FROM v_frames f LEFT JOIN v_gt g ON f.sequence_id = g.sequence_id AND g.ts BETWEEN f.rgb_ts - 0.051 AND f.rgb_ts + 0.051
) WHERE k = 1""")
def asof_nearest_left(spark: SparkSession, d: str) -> DataFrame:
    """Every frame with its nearest ground truth, null beyond 0.05 s."""
    out = asof.asof_nearest(views.frames(spark, d), views.gt(spark, d), "sequence_id", "rgb_ts", "ts", "pose_id", tolerance=0.05)
    return out.select("entry_id", "match_id", F.round("dt", 6).alias("dt"))


@query("""
WITH sides AS (
  SELECT e.pose_id, e.ts, p.ts AS p_ts, p.pose_id AS p_id, n.ts AS n_ts, n.pose_id AS n_id
  FROM v_est e ASOF LEFT JOIN v_gt p ON e.sequence_id = p.sequence_id AND e.ts >= p.ts ASOF LEFT JOIN v_gt n ON e.sequence_id = n.sequence_id AND e.ts <= n.ts
)
SELECT pose_id, CASE WHEN n_id IS NULL THEN p_id WHEN p_id IS NULL THEN n_id WHEN ts - p_ts < n_ts - ts THEN p_id ELSE n_id END AS match_id FROM sides""")
def asof_nearest_later(spark: SparkSession, d: str) -> DataFrame:
    """Nearest ground truth without tolerance; the later of two equally near."""
    out = asof.asof_nearest(views.est(spark, d), views.gt(spark, d), "sequence_id", "ts", "ts", "pose_id", tie="later")
    return out.select("pose_id", "match_id")


@query("""
SELECT e.pose_id, f.entry_id AS match_id, round(e.ts - f.rgb_ts, 6) AS age
FROM v_est e ASOF LEFT JOIN (SELECT sequence_id, rgb_ts, min(entry_id) AS entry_id FROM v_frames WHERE rgb_ts IS NOT NULL GROUP BY ALL) f
ON e.sequence_id = f.sequence_id AND e.ts >= f.rgb_ts""")
def asof_backward_ffill(spark: SparkSession, d: str) -> DataFrame:
    """Each pose with the last frame at or before it."""
    out = asof.asof_backward(views.est(spark, d), views.frames(spark, d), "sequence_id", "ts", "rgb_ts", "entry_id")
    return out.select("pose_id", "match_id", F.round("dt", 6).alias("age"))


def _streams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = views.frames(spark, d)
    rgb = f.where("rgb_ts IS NOT NULL").groupBy("sequence_id", F.col("rgb_ts")).agg(F.min("entry_id").alias("rgb_id"))
    depth = f.where("depth_ts IS NOT NULL").groupBy("sequence_id", F.col("depth_ts")).agg(F.min("entry_id").alias("depth_id"))
    return rgb, depth


@query("""
WITH rgb AS (SELECT sequence_id, rgb_ts, min(entry_id) AS rgb_id FROM v_frames WHERE rgb_ts IS NOT NULL GROUP BY ALL),
dep AS (SELECT sequence_id, depth_ts, min(entry_id) AS depth_id FROM v_frames WHERE depth_ts IS NOT NULL GROUP BY ALL),
near AS (SELECT r.sequence_id, rgb_id, rgb_ts, depth_id, row_number() OVER (PARTITION BY r.sequence_id, rgb_ts ORDER BY abs(depth_ts - rgb_ts), depth_ts) AS k
  FROM rgb r JOIN dep p ON r.sequence_id = p.sequence_id AND depth_ts BETWEEN rgb_ts - 0.021 AND rgb_ts + 0.021 WHERE abs(depth_ts - rgb_ts) <= 0.02),
won AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, depth_id ORDER BY rgb_ts, rgb_id) AS place FROM near WHERE k = 1)
SELECT sequence_id, rgb_id, depth_id FROM won WHERE place = 1""")
def asof_nearest_1to1(spark: SparkSession, d: str) -> DataFrame:
    """Colour and depth images paired one to one; whoever comes first keeps the image."""
    rgb, depth = _streams(spark, d)
    out = asof.asof_first_come(rgb, depth, "sequence_id", "rgb_ts", "rgb_id", "depth_ts", "depth_id", tolerance=0.02)
    return out.select("sequence_id", "rgb_id", F.col("match_id").alias("depth_id"))


@query()
def asof_greedy_1to1(spark: SparkSession, d: str) -> DataFrame:
    """Estimated poses and ground truth one to one, greedily in time."""
    return asof.asof_greedy(views.est(spark, d), views.gt(spark, d), "sequence_id", "ts", "pose_id", "ts", "pose_id", tolerance=0.02)


_SUMMARY = "count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(max(e), 6) AS max"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT sequence_id, {_SUMMARY} FROM (SELECT sequence_id, sqrt((e_tx - g_tx) * (e_tx - g_tx) + (e_ty - g_ty) * (e_ty - g_ty) + (e_tz - g_tz) * (e_tz - g_tz)) AS e FROM v_near) GROUP BY sequence_id")
def ate_3d(spark: SparkSession, d: str) -> DataFrame:
    """Absolute trajectory error per sequence, without alignment."""
    m = views.matched(spark, d)
    m = m.withColumn("e", trajectory.distance([F.col("e_tx"), F.col("e_ty"), F.col("e_tz")], [F.col("g_tx"), F.col("g_ty"), F.col("g_tz")]))
    return _rounded(trajectory.error_summary(m, ["sequence_id"], "e"))


@query(f"SELECT sequence_id, {_SUMMARY} FROM (SELECT sequence_id, sqrt((e_tx - g_tx) * (e_tx - g_tx) + (e_ty - g_ty) * (e_ty - g_ty)) AS e FROM v_near) GROUP BY sequence_id")
def ate_2d(spark: SparkSession, d: str) -> DataFrame:
    m = views.matched(spark, d).withColumn("e", trajectory.distance([F.col("e_tx"), F.col("e_ty")], [F.col("g_tx"), F.col("g_ty")]))
    return _rounded(trajectory.error_summary(m, ["sequence_id"], "e"))


@query()
def ate_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Absolute trajectory error after the best rigid alignment of each sequence."""
    m = trajectory.align(views.matched(spark, d), ["sequence_id"], ["e_tx", "e_ty", "e_tz"], ["g_tx", "g_ty", "g_tz"])
    return _rounded(trajectory.error_summary(m, ["sequence_id"], "error"))


@query()
def ate_aligned_scaled(spark: SparkSession, d: str) -> DataFrame:
    """The same with a free scale."""
    m = trajectory.align(views.matched(spark, d), ["sequence_id"], ["e_tx", "e_ty", "e_tz"], ["g_tx", "g_ty", "g_tz"], with_scale=True)
    return _rounded(trajectory.error_summary(m, ["sequence_id"], "error"))


_MOMENTS = ", ".join([f"round(avg(e_t{a}), 6) AS s{i}, round(avg(g_t{a}), 6) AS t{i}" for i, a in enumerate("xyz")] + [f"round(covar_pop(g_t{a}, e_t{b}), 6) AS c{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")])


@query(f"SELECT sequence_id, count(*) AS n, {_MOMENTS}, round(var_pop(e_tx) + var_pop(e_ty) + var_pop(e_tz), 6) AS spread FROM v_near GROUP BY sequence_id")
def alignment_moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trajectory.alignment_moments(views.matched(spark, d), ["sequence_id"], ["e_tx", "e_ty", "e_tz"], ["g_tx", "g_ty", "g_tz"]))


def _between(a: str, b: str) -> str:
    """SQL of b in the frame of a, for prefixed planar poses."""
    return (
        f"cos({a}h) * ({b}x - {a}x) + sin({a}h) * ({b}y - {a}y) AS x, -sin({a}h) * ({b}x - {a}x) + cos({a}h) * ({b}y - {a}y) AS y, {b}h - {a}h AS h"
    )


_WRAP = "((({0}) + pi()) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"


def _rpe_sql(lag: int) -> str:
    return f"""
WITH p AS (SELECT sequence_id, pose_id, ts, e_tx AS ex, e_ty AS ey, {_YAW.format('e_')} AS eh, g_tx AS gx, g_ty AS gy, {_YAW.format('g_')} AS gh FROM v_near),
l AS (SELECT *, {', '.join(f'lead({c}, {lag}) OVER w AS {c}2' for c in ('ex', 'ey', 'eh', 'gx', 'gy', 'gh'))} FROM p WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, pose_id)),
m AS (SELECT sequence_id, cos(gh) * (gx2 - gx) + sin(gh) * (gy2 - gy) AS ax, -sin(gh) * (gx2 - gx) + cos(gh) * (gy2 - gy) AS ay, gh2 - gh AS ah,
  cos(eh) * (ex2 - ex) + sin(eh) * (ey2 - ey) AS bx, -sin(eh) * (ex2 - ex) + cos(eh) * (ey2 - ey) AS byy, eh2 - eh AS bh FROM l WHERE ex2 IS NOT NULL),
o AS (SELECT sequence_id, sqrt((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)) AS te, abs({_WRAP.format('bh - ah')}) * 180 / pi() AS re FROM m)
SELECT sequence_id, count(*) AS n, round(sqrt(avg(te * te)), 6) AS trans_rmse, round(sqrt(avg(re * re)), 4) AS rot_rmse FROM o GROUP BY sequence_id"""


def _rpe_2d(spark: SparkSession, d: str, lag: int) -> DataFrame:
    pairs = views.matched(spark, d).select("sequence_id", "pose_id", "ts", views.planar("e_").alias("est"), views.planar("g_").alias("gt"))
    e = trajectory.relative_errors_2d(pairs, "sequence_id", ["ts", "pose_id"], lag)
    square = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return e.groupBy("sequence_id").agg(F.count("*").alias("n"), F.round(square("trans_error"), 6).alias("trans_rmse"), F.round(square("rot_error_deg"), 4).alias("rot_rmse"))


@query(_rpe_sql(1))
def rpe_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rpe_2d(spark, d, 1)


@query(_rpe_sql(10))
def rpe_2d_lag10(spark: SparkSession, d: str) -> DataFrame:
    return _rpe_2d(spark, d, 10)


@query("""
WITH q AS (SELECT sequence_id, pose_id, ts, e_tx, e_ty, e_tz, g_tx, g_ty, g_tz,
  sqrt(e_qx * e_qx + e_qy * e_qy + e_qz * e_qz + e_qw * e_qw) AS en, sqrt(g_qx * g_qx + g_qy * g_qy + g_qz * g_qz + g_qw * g_qw) AS gn, * FROM v_near),
u AS (SELECT sequence_id, pose_id, ts, e_tx, e_ty, e_tz, g_tx, g_ty, g_tz, e_qx / en AS ea, e_qy / en AS eb, e_qz / en AS ec, e_qw / en AS ed, g_qx / gn AS ga, g_qy / gn AS gb, g_qz / gn AS gc, g_qw / gn AS gd FROM q),
l AS (SELECT *, lead(e_tx) OVER w - e_tx AS ex, lead(e_ty) OVER w - e_ty AS ey, lead(e_tz) OVER w - e_tz AS ez, lead(g_tx) OVER w - g_tx AS gx, lead(g_ty) OVER w - g_ty AS gy, lead(g_tz) OVER w - g_tz AS gz
  FROM u WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, pose_id)),
b AS (SELECT sequence_id, -- steps in the frame of their first pose
  (1 - 2 * (eb * eb + ec * ec)) * ex + 2 * (ea * eb + ec * ed) * ey + 2 * (ea * ec - eb * ed) * ez AS e1, 2 * (ea * eb - ec * ed) * ex + (1 - 2 * (ea * ea + ec * ec)) * ey + 2 * (eb * ec + ea * ed) * ez AS e2,
  2 * (ea * ec + eb * ed) * ex + 2 * (eb * ec - ea * ed) * ey + (1 - 2 * (ea * ea + eb * eb)) * ez AS e3,
  (1 - 2 * (gb * gb + gc * gc)) * gx + 2 * (ga * gb + gc * gd) * gy + 2 * (ga * gc - gb * gd) * gz AS g1, 2 * (ga * gb - gc * gd) * gx + (1 - 2 * (ga * ga + gc * gc)) * gy + 2 * (gb * gc + ga * gd) * gz AS g2,
  2 * (ga * gc + gb * gd) * gx + 2 * (gb * gc - ga * gd) * gy + (1 - 2 * (ga * ga + gb * gb)) * gz AS g3 FROM l WHERE ex IS NOT NULL)
SELECT sequence_id, count(*) AS n, round(sqrt(avg((e1 - g1) * (e1 - g1) + (e2 - g2) * (e2 - g2) + (e3 - g3) * (e3 - g3))), 6) AS trans_rmse FROM b GROUP BY sequence_id""")
def rpe_3d(spark: SparkSession, d: str) -> DataFrame:
    """Relative pose error over consecutive pairs, rigid transforms in space."""
    e = trajectory.relative_errors_3d(views.matched(spark, d), "sequence_id", ["ts", "pose_id"])
    return e.groupBy("sequence_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("trans_error") * F.col("trans_error"))), 6).alias("trans_rmse"))


@query()
def rpe_3d_rotation(spark: SparkSession, d: str) -> DataFrame:
    e = trajectory.relative_errors_3d(views.matched(spark, d), "sequence_id", ["ts", "pose_id"])
    return _rounded(trajectory.error_summary(e, ["sequence_id"], "rot_error_deg"), 4)


@query("""
SELECT sequence_id, count(*) AS poses, round(coalesce(sum(step), 0), 6) AS length FROM (
  SELECT sequence_id, sqrt((tx - lag(tx) OVER w) * (tx - lag(tx) OVER w) + (ty - lag(ty) OVER w) * (ty - lag(ty) OVER w) + (tz - lag(tz) OVER w) * (tz - lag(tz) OVER w)) AS step
  FROM v_gt WINDOW w AS (PARTITION BY sequence_id ORDER BY ts)) GROUP BY sequence_id""")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trajectory.path_length(views.gt(spark, d), "sequence_id", ["ts"], ["tx", "ty", "tz"]))


@query(f"""
WITH p AS (SELECT sequence_id, pose_id, ts, tx AS x, ty AS y, {_YAW.format('')} AS h FROM v_est),
l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(h) OVER w AS h0 FROM p WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, pose_id)),
m AS (SELECT sequence_id, pose_id, ts, cos(h0) * (x - x0) + sin(h0) * (y - y0) AS dx, -sin(h0) * (x - x0) + cos(h0) * (y - y0) AS dy, {_WRAP.format('h - h0')} AS dh FROM l),
k AS (SELECT *, lag(dx) OVER w AS dx0, lag(dy) OVER w AS dy0, lag(dh) OVER w AS dh0 FROM m WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, pose_id))
SELECT sequence_id, count(*) AS n, round(avg(sqrt((dx - dx0) * (dx - dx0) + (dy - dy0) * (dy - dy0))), 6) AS jerk, round(avg(abs({_WRAP.format('dh - dh0')}) * 180 / pi()), 4) AS turn_deg FROM k WHERE dx0 IS NOT NULL GROUP BY sequence_id""")
def motion_stability(spark: SparkSession, d: str) -> DataFrame:
    poses = views.est(spark, d).select("sequence_id", "pose_id", "ts", views.planar().alias("pose"))
    s = trajectory.motion_stability_2d(poses, "sequence_id", ["ts", "pose_id"])
    return s.groupBy("sequence_id").agg(F.count("*").alias("n"), F.round(F.avg("jerk"), 6).alias("jerk"), F.round(F.avg("turn_deg"), 4).alias("turn_deg"))


@query("""
SELECT pose_id, CASE WHEN dt > 0 THEN round((tx - x0) / dt, 6) END AS v_tx, CASE WHEN dt > 0 THEN round((ty - y0) / dt, 6) END AS v_ty FROM (
  SELECT *, ts - min(ts) OVER w AS dt, first_value(tx) OVER w AS x0, first_value(ty) OVER w AS y0 FROM v_gt WINDOW w AS (PARTITION BY sequence_id ORDER BY ts RANGE BETWEEN 1.5 PRECEDING AND CURRENT ROW))""")
def velocity_range_window(spark: SparkSession, d: str) -> DataFrame:
    """Velocity over the poses of the last 1.5 s."""
    v = trajectory.velocity(views.gt(spark, d), "sequence_id", "ts", ["tx", "ty"])
    return v.select("pose_id", F.round("v_tx", 6).alias("v_tx"), F.round("v_ty", 6).alias("v_ty"))


def _planar_gt(spark: SparkSession, d: str) -> DataFrame:
    return views.gt(spark, d).select("sequence_id", "pose_id", "ts", views.planar().alias("pose"))


@query(f"""
WITH g AS (SELECT sequence_id, pose_id, ts, tx AS x, ty AS y, {_YAW.format('')} AS h FROM v_gt),
r AS (SELECT sequence_id, pose_id AS rel_id, ts AS t_i, lead(ts, 10) OVER w AS t_j, cos(h) * (lead(x, 10) OVER w - x) + sin(h) * (lead(y, 10) OVER w - y) AS dx,
  -sin(h) * (lead(x, 10) OVER w - x) + cos(h) * (lead(y, 10) OVER w - y) AS dy, lead(h, 10) OVER w - h AS dh FROM g WINDOW w AS (PARTITION BY sequence_id ORDER BY ts)),
e AS (SELECT sequence_id, ts, min(pose_id) AS pose_id FROM v_est GROUP BY ALL),
f AS (SELECT sequence_id, pose_id, tx AS x, ty AS y, {_YAW.format('')} AS h FROM v_est),
i AS (SELECT * FROM (SELECT r.*, e.pose_id AS i_id, row_number() OVER (PARTITION BY rel_id ORDER BY abs(e.ts - t_i), e.ts) AS k FROM r JOIN e ON r.sequence_id = e.sequence_id AND e.ts BETWEEN t_i - 0.0501 AND t_i + 0.0501 WHERE abs(e.ts - t_i) <= 0.05) WHERE k = 1),
j AS (SELECT * FROM (SELECT i.* EXCLUDE (k), e.pose_id AS j_id, row_number() OVER (PARTITION BY rel_id ORDER BY abs(e.ts - t_j), e.ts) AS k FROM i JOIN e ON i.sequence_id = e.sequence_id AND e.ts BETWEEN t_j - 0.0501 AND t_j + 0.0501 WHERE abs(e.ts - t_j) <= 0.05) WHERE k = 1),
o AS (SELECT j.sequence_id, cos(a.h) * (b.x - a.x) + sin(a.h) * (b.y - a.y) - dx AS ox, -sin(a.h) * (b.x - a.x) + cos(a.h) * (b.y - a.y) - dy AS oy FROM j JOIN f a ON a.pose_id = i_id JOIN f b ON b.pose_id = j_id)
SELECT sequence_id, count(*) AS n, round(sqrt(avg(ox * ox + oy * oy)), 6) AS rmse FROM o GROUP BY sequence_id""")
def relations_error(spark: SparkSession, d: str) -> DataFrame:
    """Relations between ground-truth poses ten apart, held against the estimated trajectory."""
    w = window("sequence_id")
    rel = own(in_blocks(_planar_gt(spark, d), "sequence_id", ["ts"], after=10).withColumns({"t_j": F.lead("ts", 10).over(w), "pose_j": F.lead("pose", 10).over(w)})).where("t_j IS NOT NULL")
    rel = rel.withColumn("r", geom.se2_between(F.col("pose"), F.col("pose_j"))).select(
        "sequence_id", F.col("pose_id").alias("rel_id"), F.col("ts").alias("t_i"), "t_j", F.col("r.x").alias("dx"), F.col("r.y").alias("dy"), F.col("r.theta").alias("dtheta"),
    )
    poses = views.est(spark, d).select("sequence_id", "pose_id", "ts", views.planar().alias("pose"))
    e = trajectory.relation_errors(rel, poses, "sequence_id", max_dt=0.05)
    return e.groupBy("sequence_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("trans_error") * F.col("trans_error"))), 6).alias("rmse"))


@query(f"""
WITH n AS (SELECT sequence_id, ts, match_id AS node_id, g_tx - e_tx AS ox, g_ty - e_ty AS oy FROM v_near QUALIFY row_number() OVER (PARTITION BY sequence_id, ts ORDER BY pose_id) = 1)
SELECT e.pose_id, round(e.tx + coalesce(n.ox, 0), 6) AS x, round(e.ty + coalesce(n.oy, 0), 6) AS y
FROM v_est e ASOF LEFT JOIN n ON e.sequence_id = n.sequence_id AND e.ts >= n.ts""")
def dense_correction(spark: SparkSession, d: str) -> DataFrame:
    """Every estimated pose moved by the offset of the last pose that has ground truth."""
    off = F.struct((F.col("g_tx") - F.col("e_tx")).alias("x"), (F.col("g_ty") - F.col("e_ty")).alias("y"), F.lit(0.0).alias("theta"))
    nodes = views.matched(spark, d).select("sequence_id", "ts", F.col("pose_id").alias("node_id"), off.alias("delta"))
    poses = views.est(spark, d).select("sequence_id", "pose_id", "ts", views.planar().alias("pose"))
    out = trajectory.correct_by_keyframes(poses, nodes, "sequence_id")
    return out.select("pose_id", F.round("corrected.x", 6).alias("x"), F.round("corrected.y", 6).alias("y"))
