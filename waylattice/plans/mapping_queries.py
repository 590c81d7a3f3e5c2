"""Queries of mapping rules: closures, predictions, projections, targets, fusion, clouds, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import asof, descriptors, graph, keyframes, maps, projection, trajectory
from ..operators.blocks import in_blocks, own, ranked, window
from ..session import cut
from ..sources.tables import table
from . import map_queries as mq
from . import views
from .map_queries import _DES, _LOG_EDGES, _POINTS, _RAYS, _SIZE, _WORLD, _cell
from .trajectory_queries import _WRAP, _rounded
from .views import _YAW, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# Association


@query("""WITH right_ AS (SELECT sequence_id, CAST(floor(ts * 50) AS BIGINT) AS slot, min(pose_id) AS pose_id, min_by(ts, pose_id) AS ts FROM v_gt GROUP BY 1, 2),
l AS (SELECT *, CAST(floor(ts * 50) AS BIGINT) AS slot FROM v_est),
e AS (SELECT l.pose_id, l.sequence_id, l.ts, r.pose_id AS exact_id, abs(l.ts - r.ts) AS dt FROM l LEFT JOIN right_ r USING (sequence_id, slot)),
n AS (SELECT e.pose_id, g.pose_id AS m, abs(g.ts - e.ts) AS d, row_number() OVER (PARTITION BY e.pose_id ORDER BY abs(g.ts - e.ts), g.ts) AS k FROM e JOIN v_gt g ON e.sequence_id = g.sequence_id AND g.ts BETWEEN e.ts - 0.051 AND e.ts + 0.051 WHERE exact_id IS NULL AND abs(g.ts - e.ts) <= 0.05)
SELECT e.pose_id, coalesce(exact_id, m) AS match_id, round(coalesce(e.dt, n.d), 6) AS dt FROM e LEFT JOIN n ON e.pose_id = n.pose_id AND n.k = 1""")
def asof_exact_then_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Poses matched by a shared slot of a fiftieth of a second, the rest by the nearest within 0.05 s."""
    slot = F.floor(F.col("ts") * 50).alias("slot")
    left, right = views.est(spark, d).select("sequence_id", "pose_id", "ts", slot), views.gt(spark, d).select("sequence_id", F.col("pose_id").alias("gt_id"), F.col("ts").alias("gt_ts"), slot)
    out = asof.asof_exact_then_nearest(left, right, "sequence_id", "slot", "ts", "gt_ts", "gt_id", tolerance=0.05)
    return out.select("pose_id", "match_id", F.round("dt", 6).alias("dt"))


@query("""WITH g AS (SELECT sequence_id, ts, min(pose_id) AS pose_id FROM v_est GROUP BY ALL), f AS (SELECT * FROM v_frames WHERE rgb_ts IS NOT NULL),
s AS (SELECT f.entry_id, f.rgb_ts, p.ts AS p_ts, p.pose_id AS p_id, n.ts AS n_ts, n.pose_id AS n_id FROM f ASOF LEFT JOIN g p ON f.sequence_id = p.sequence_id AND f.rgb_ts >= p.ts ASOF LEFT JOIN g n ON f.sequence_id = n.sequence_id AND f.rgb_ts <= n.ts)
SELECT entry_id, CASE WHEN n_id IS NULL THEN p_id WHEN p_id IS NULL THEN n_id WHEN rgb_ts - p_ts <= n_ts - rgb_ts THEN p_id ELSE n_id END AS match_id FROM s""")
def image_pose_argmin(spark: SparkSession, d: str) -> DataFrame:
    """Every image with the estimated pose nearest in time, however far; the earlier on a tie."""
    f = views.frames(spark, d).where("rgb_ts IS NOT NULL")
    return asof.asof_nearest(f, views.est(spark, d), "sequence_id", "rgb_ts", "ts", "pose_id").select("entry_id", "match_id")


@query("""WITH f AS (SELECT e.pose_id AS e_id, g.pose_id AS g_id, row_number() OVER (PARTITION BY e.pose_id ORDER BY abs(g.ts - e.ts), g.ts) AS k FROM v_est e JOIN v_gt g ON e.sequence_id = g.sequence_id AND g.ts BETWEEN e.ts - 0.021 AND e.ts + 0.021 WHERE abs(g.ts - e.ts) <= 0.02),
eo AS (SELECT sequence_id, ts, min(pose_id) AS pose_id FROM v_est GROUP BY ALL),
b AS (SELECT g.pose_id AS g_id, e.pose_id AS e_id, row_number() OVER (PARTITION BY g.pose_id ORDER BY abs(g.ts - e.ts), e.ts) AS k FROM v_gt g JOIN eo e ON e.sequence_id = g.sequence_id AND e.ts BETWEEN g.ts - 0.021 AND g.ts + 0.021 WHERE abs(g.ts - e.ts) <= 0.02)
SELECT f.e_id, f.g_id FROM f JOIN b ON f.e_id = b.e_id AND f.g_id = b.g_id WHERE f.k = 1 AND b.k = 1""")
def mutual_matches(spark: SparkSession, d: str) -> DataFrame:
    """Poses of the two trajectories that are each other's nearest in time."""
    e, g = views.est(spark, d).select("sequence_id", "pose_id", "ts"), views.gt(spark, d).select("sequence_id", "pose_id", "ts")
    near = lambda a, b: asof.asof_nearest(a, b, "sequence_id", "ts", "ts", "pose_id", tolerance=0.02, how="inner")
    there = near(e, g).select(F.col("pose_id").alias("a"), F.col("match_id").alias("b"))
    back = near(g, e).select(F.col("pose_id").alias("b"), F.col("match_id").alias("a"))
    return projection.mutual(there, back).select(F.col("a").alias("e_id"), F.col("b").alias("g_id"))


def _relations(spark: SparkSession, d: str, lag: int) -> DataFrame:
    w = window("sequence_id")
    p = views.gt(spark, d).select("sequence_id", "pose_id", "ts", views.planar().alias("pose"))
    rel = own(in_blocks(p, "sequence_id", ["ts"], after=lag).withColumns({"t_j": F.lead("ts", lag).over(w), "pose_j": F.lead("pose", lag).over(w)})).where("t_j IS NOT NULL")
    rel = rel.withColumn("r", geom.se2_between(F.col("pose"), F.col("pose_j")))
    return rel.select("sequence_id", F.col("pose_id").alias("rel_id"), F.col("ts").alias("t_i"), "t_j", F.col("r.x").alias("dx"), F.col("r.y").alias("dy"), F.col("r.theta").alias("dtheta"))


_RELATIONS = f"""g AS (SELECT sequence_id, pose_id, ts, tx AS x, ty AS y, {_YAW.format('')} AS h FROM v_gt),
r AS (SELECT sequence_id, pose_id AS rel_id, ts AS t_i, lead(ts, 40) OVER w AS t_j, cos(h) * (lead(x, 40) OVER w - x) + sin(h) * (lead(y, 40) OVER w - y) AS dx,
  -sin(h) * (lead(x, 40) OVER w - x) + cos(h) * (lead(y, 40) OVER w - y) AS dy, lead(h, 40) OVER w - h AS dh FROM g WINDOW w AS (PARTITION BY sequence_id ORDER BY ts))"""
# every other relation is given the other way round
_TURNED = f"""{_RELATIONS}, q AS (SELECT sequence_id, rel_id, CASE WHEN odd THEN t_j ELSE t_i END AS t_i, CASE WHEN odd THEN t_i ELSE t_j END AS t_j,
  CASE WHEN odd THEN -cos(dh) * dx - sin(dh) * dy ELSE dx END AS dx, CASE WHEN odd THEN sin(dh) * dx - cos(dh) * dy ELSE dy END AS dy, CASE WHEN odd THEN -dh ELSE dh END AS dh FROM (SELECT *, rel_id % 2 = 1 AS odd FROM r WHERE t_j IS NOT NULL))"""


@query(f"""WITH {_TURNED}, e AS (SELECT sequence_id, ts, row_number() OVER (PARTITION BY sequence_id ORDER BY ts) - 1 AS index FROM (SELECT DISTINCT sequence_id, ts FROM v_est)),
s AS (SELECT sequence_id, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1), i AS (SELECT q.* FROM q JOIN s USING (sequence_id) WHERE t_i BETWEEN a AND b AND t_j BETWEEN a AND b),
x AS (SELECT * FROM (SELECT i.*, e.index AS i0, row_number() OVER (PARTITION BY rel_id ORDER BY abs(e.ts - t_i), e.ts) AS k FROM i JOIN e ON i.sequence_id = e.sequence_id AND e.ts BETWEEN t_i - 0.051 AND t_i + 0.051 WHERE abs(e.ts - t_i) <= 0.05) WHERE k = 1),
y AS (SELECT * FROM (SELECT x.* EXCLUDE (k), e.index AS j0, row_number() OVER (PARTITION BY rel_id ORDER BY abs(e.ts - t_j), e.ts) AS k FROM x JOIN e ON x.sequence_id = e.sequence_id AND e.ts BETWEEN t_j - 0.051 AND t_j + 0.051 WHERE abs(e.ts - t_j) <= 0.05) WHERE k = 1)
SELECT sequence_id, rel_id, least(i0, j0) AS i, greatest(i0, j0) AS j, round(CASE WHEN i0 > j0 THEN -cos(dh) * dx - sin(dh) * dy ELSE dx END, 6) AS dx, round(CASE WHEN i0 > j0 THEN sin(dh) * dx - cos(dh) * dy ELSE dy END, 6) AS dy FROM y WHERE abs(i0 - j0) >= 5""")
def relation_closures(spark: SparkSession, d: str) -> DataFrame:
    """Relations between ground-truth poses forty apart, half of them reversed, as closures of the estimated trajectory."""
    rel = _relations(spark, d, 40)
    z, odd = geom.se2(F.col("dx"), F.col("dy"), F.col("dtheta")), F.col("rel_id") % 2 == 1
    turned = rel.withColumn("z", F.when(odd, geom.se2_inverse(z)).otherwise(z)).select(
        "sequence_id", "rel_id", F.when(odd, F.col("t_j")).otherwise(F.col("t_i")).alias("t_i"), F.when(odd, F.col("t_i")).otherwise(F.col("t_j")).alias("t_j"), F.col("z.x").alias("dx"), F.col("z.y").alias("dy"), F.col("z.theta").alias("dtheta"),
    )
    e = ranked(views.est(spark, d).select("sequence_id", "ts").distinct(), "sequence_id", ["ts"], "index")
    out = trajectory.relation_closures(turned, e, "sequence_id", max_dt=0.05, least_gap=5)
    return _rounded(out.drop("dtheta"))


@query(f"""WITH {_RELATIONS}, s AS (SELECT sequence_id, min(ts) AS a, max(ts) AS b FROM v_est GROUP BY 1), t AS (SELECT sequence_id, t_i AS t FROM r WHERE t_j IS NOT NULL UNION ALL SELECT sequence_id, t_j FROM r WHERE t_j IS NOT NULL)
SELECT sequence_id, count(*) // 2 AS relations, round(min(t), 6) AS first, round(max(t), 6) AS last, count(*) FILTER (WHERE coalesce(t BETWEEN a AND b, false)) // 2 AS overlapping FROM t LEFT JOIN s USING (sequence_id) GROUP BY sequence_id""")
def relation_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many relations lie within the time of the estimated trajectory."""
    return _rounded(trajectory.relation_overlap(_relations(spark, d, 40), views.est(spark, d), "sequence_id", "ts"))


@query("""WITH l AS (SELECT pose_id, e_tx - lag(e_tx) OVER w - (g_tx - lag(g_tx) OVER w) AS a, e_ty - lag(e_ty) OVER w - (g_ty - lag(g_ty) OVER w) AS b, e_tz - lag(e_tz) OVER w - (g_tz - lag(g_tz) OVER w) AS c FROM v_near WINDOW w AS (PARTITION BY sequence_id ORDER BY ts, pose_id))
SELECT pose_id, round(sqrt(a * a + b * b + c * c), 6) AS trans_error FROM l WHERE a IS NOT NULL""")
def rpe_translation_series(spark: SparkSession, d: str) -> DataFrame:
    """Relative error of positions alone, pose by pose."""
    m = trajectory.translation_steps(views.matched(spark, d), "sequence_id", ["ts", "pose_id"], ["e_tx", "e_ty", "e_tz"], ["g_tx", "g_ty", "g_tz"])
    return m.select("pose_id", F.round("trans_error", 6).alias("trans_error"))


_GOOD = "odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL AND laser_pose.x IS NOT NULL AND laser_pose.y IS NOT NULL AND laser_pose.theta IS NOT NULL"


@query(f"""WITH s AS (SELECT DISTINCT ON (scan_id) scan_id, sensor_id, t, odom.x AS ox, odom.y AS oy, odom.theta AS oh, laser_pose.x AS px, laser_pose.y AS py, laser_pose.theta AS ph FROM scans
  WHERE scan_id IS NOT NULL AND sensor_id IS NOT NULL AND t IS NOT NULL AND len(ranges) > 0 AND {_GOOD}),
l AS (SELECT scan_id, ox, oy, oh, lag(ox) OVER w AS ox0, lag(oy) OVER w AS oy0, lag(oh) OVER w AS oh0, lag(px) OVER w AS px0, lag(py) OVER w AS py0, lag(ph) OVER w AS ph0 FROM s WINDOW w AS (PARTITION BY sensor_id ORDER BY t, scan_id)),
m AS (SELECT *, cos(oh0) * (ox - ox0) + sin(oh0) * (oy - oy0) AS dx, -sin(oh0) * (ox - ox0) + cos(oh0) * (oy - oy0) AS dy FROM l)
SELECT scan_id, round(px0 + cos(ph0) * dx - sin(ph0) * dy, 6) AS x, round(py0 + sin(ph0) * dx + cos(ph0) * dy, 6) AS y FROM m""")
def odometry_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Pose of each scan predicted from the one before and what the odometry moved."""
    s = views.scans(spark, d).where(_GOOD)
    out = trajectory.predict_by_odometry(s, "sensor_id", ["t", "scan_id"], "odom", "laser_pose")
    return out.select("scan_id", F.round("predicted.x", 6).alias("x"), F.round("predicted.y", 6).alias("y"))


_WALK_REL = "cos({p}.h) * ({c}.x - {p}.x) + sin({p}.h) * ({c}.y - {p}.y)"


@query(f"""WITH RECURSIVE {_LOG_EDGES}, p AS (SELECT a AS kf, b AS parent, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges WHERE b < a) WHERE k = 1),
gone AS (SELECT kf FROM p WHERE shared < 150), step AS (SELECT kf, parent, (kf - parent) / 1000.0::DOUBLE AS sx, (kf % 10) / 10.0::DOUBLE AS sy, ((kf % 7) - 3) / 10.0::DOUBLE AS sh FROM p),
up AS (SELECT kf AS frame, kf, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS h, 0 AS hops FROM p
  UNION ALL SELECT frame, parent, sx + cos(sh) * x - sin(sh) * y, sy + sin(sh) * x + cos(sh) * y, sh + h, hops + 1 FROM up JOIN step USING (kf) WHERE hops < 10 AND kf IN (SELECT kf FROM gone))
SELECT frame, kf, round(x, 6) AS x, round(y, 6) AS y, CAST(hops AS INTEGER) AS hops FROM up WHERE kf NOT IN (SELECT kf FROM gone)""")
def culled_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every keyframe's pose against its nearest kept ancestor, weakly tied keyframes being culled; steps stand in for relative poses."""
    tree = graph.parents(mq._graph(spark, d)).withColumnRenamed("kf_id", "kf")
    step = geom.se2((F.col("kf") - F.col("parent")) / 1000.0, (F.col("kf") % 10) / 10.0, ((F.col("kf") % 7) - 3) / 10.0)
    still = geom.se2(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    out = trajectory.walk_to_kept(tree.select(F.col("kf").alias("frame"), "kf", still.alias("rel")), tree.select("kf", "parent", step.alias("rel")), tree.where("shared < 150").select("kf"))
    return out.select("frame", "kf", F.round("rel.x", 6).alias("x"), F.round("rel.y", 6).alias("y"), "hops")


# Geometry


_R = {  # rotation matrix of a unit quaternion, by rows
    0: "1 - 2 * ({q}y * {q}y + {q}z * {q}z)", 1: "2 * ({q}x * {q}y - {q}z * {q}w)", 2: "2 * ({q}x * {q}z + {q}y * {q}w)", 3: "2 * ({q}x * {q}y + {q}z * {q}w)", 4: "1 - 2 * ({q}x * {q}x + {q}z * {q}z)",
    5: "2 * ({q}y * {q}z - {q}x * {q}w)", 6: "2 * ({q}x * {q}z - {q}y * {q}w)", 7: "2 * ({q}y * {q}z + {q}x * {q}w)", 8: "1 - 2 * ({q}x * {q}x + {q}y * {q}y)",
}


def _unit(prefix: str, out: str) -> str:
    n = f"sqrt({' + '.join(f'{prefix}q{c} * {prefix}q{c}' for c in 'xyzw')})"
    return ", ".join(f"{prefix}q{c} / {n} AS {out}{c}" for c in "xyzw")


@query(f"WITH u AS (SELECT pose_id, {_unit('', 'q')} FROM (SELECT pose_id, qx, qy, qz, qw FROM v_est WHERE qx * qx + qy * qy + qz * qz + qw * qw > 0)) SELECT pose_id, {', '.join(f'round({e.format(q=chr(113))}, 6) AS r{i}' for i, e in _R.items())} FROM u".replace("SELECT pose_id, qx / ", "SELECT pose_id, qx / "))
def rotation_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Rotation matrix of every estimated pose."""
    e = views.est(spark, d)
    r = geom.quaternion_to_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    return _rounded(e.select("pose_id", r.alias("r")).where("r IS NOT NULL").select("pose_id", *[F.col("r")[i].alias(f"r{i}") for i in range(9)]))


SQL["rotation_matrices"] = with_views(f"WITH u AS (SELECT pose_id, {_unit('', 'a')} FROM v_est WHERE qx * qx + qy * qy + qz * qz + qw * qw > 0) SELECT pose_id, {', '.join(f'round({e.format(q=chr(97))}, 6) AS r{i}' for i, e in _R.items())} FROM u")


@query(f"""WITH u AS (SELECT pose_id, e_tx - g_tx AS dx, e_ty - g_ty AS dy, e_tz - g_tz AS dz, {_unit('g_', 'a')}, {_unit('e_', 'b')} FROM v_near)
SELECT pose_id, {', '.join(f"round(({_R[i].format(q='a')}) * dx + ({_R[3 + i].format(q='a')}) * dy + ({_R[6 + i].format(q='a')}) * dz, 6) AS t{c}" for i, c in enumerate('xyz'))},
  round(2 * acos(least(1.0, abs(ax * bx + ay * by + az * bz + aw * bw))) * 180 / pi(), 3) AS degrees FROM u""".replace("ay * by +", "ay * \"by\" +").replace("AS by", "AS \"by\""))
def se3_between(spark: SparkSession, d: str) -> DataFrame:
    """Each estimated pose in the frame of its ground truth: inverse, composition and angle of rigid transforms."""
    m = views.matched(spark, d).select("pose_id", views.spatial("e_").alias("e"), views.spatial("g_").alias("g"), geom.quaternion_between_angle_deg([F.col("e_" + c) for c in ("qx", "qy", "qz", "qw")], [F.col("g_" + c) for c in ("qx", "qy", "qz", "qw")]).alias("degrees"))
    off = m.withColumn("off", geom.se3_compose(geom.se3_inverse(F.col("g")), F.col("e")))
    return off.select("pose_id", *[F.round(F.col("off.t")[i], 6).alias(f"t{c}") for i, c in enumerate("xyz")], F.round("degrees", 3).alias("degrees"))


@query(f"""WITH u AS (SELECT pose_id, tx, ty, tz, 1 + abs(tz) AS s, {_unit('', 'a')} FROM v_est)
SELECT pose_id, {', '.join(f"round(s * (({_R[3 * i].format(q='a')}) * 1.0 + ({_R[3 * i + 1].format(q='a')}) * 2.0 + ({_R[3 * i + 2].format(q='a')}) * 3.0) + t{c}, 6) AS {c}" for i, c in enumerate('xyz'))}, 1.0::DOUBLE AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z FROM u""")
def sim3_transforms(spark: SparkSession, d: str) -> DataFrame:
    """A point moved by each pose with a scale of its own, and moved back."""
    e = views.est(spark, d)
    r = geom.quaternion_to_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    m = e.select("pose_id", geom.sim3(r, [F.col("tx"), F.col("ty"), F.col("tz")], 1 + F.abs("tz")).alias("s"))
    there = geom.sim3_apply(F.col("s"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    m = m.select("pose_id", "s", *[c.alias(a) for c, a in zip(there, "xyz")])
    back = geom.sim3_apply(geom.sim3_inverse(F.col("s")), [F.col(a) for a in "xyz"])
    return _rounded(m.select("pose_id", "x", "y", "z", *[c.alias(f"back_{a}") for c, a in zip(back, "xyz")]))


@query("SELECT pose_id, CAST(greatest(0, least(7, ceil(round(ln(10 / dist) / ln(1.2), 9)))) AS INTEGER) AS level FROM (SELECT pose_id, sqrt(tx * tx + ty * ty + (tz + 3) * (tz + 3)) AS dist FROM v_gt) WHERE dist > 0")
def predicted_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pyramid level at which each position is seen from three metres behind the origin."""
    p = views.gt(spark, d).select("pose_id", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + (F.col("tz") + 3) * (F.col("tz") + 3)).alias("dist")).where("dist > 0")
    return p.select("pose_id", geom.predicted_level(F.col("dist"), F.lit(10.0), 1.2, 8).alias("level"))


@query("""WITH p AS (SELECT pose_id, tx AS x, ty AS y, tz + 3 AS z, sqrt(tx * tx + ty * ty + (tz + 3) * (tz + 3)) AS n FROM v_gt)
SELECT pose_id, coalesce(z > 0 AND 500 * x / z + 320 >= 0 AND 500 * x / z + 320 < 640 AND 500 * y / z + 240 >= 0 AND 500 * y / z + 240 < 480 AND n BETWEEN 1.0 AND 5.0 AND z / n > 0.5, false) AS visible FROM p""")
def point_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether each position can be seen: depth, image, distance range and direction."""
    x, y, z = F.col("tx"), F.col("ty"), F.col("tz") + 3
    n = F.sqrt(x * x + y * y + z * z)
    u, v = geom.project(x, y, z, 500.0, 500.0, 320.0, 240.0)
    seen = projection.visible(x, y, z, n, z / n, F.lit(1.0), F.lit(5.0), u, v, 640.0, 480.0)
    return views.gt(spark, d).select("pose_id", F.coalesce(seen, F.lit(False)).alias("visible"))


_VOXEL = f"g AS (SELECT sequence_id || ':' || {_cell('tx', 0.5)} || ':' || {_cell('ty', 0.5)} || ':' || {_cell('tz', 0.5)} AS point, tx AS x, ty AS y, tz AS z FROM v_gt)"


@query(f"""WITH {_VOXEL}, p AS (SELECT point, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g GROUP BY 1),
o AS (SELECT sequence_id || ':' || {_cell('tx', 0.5)} || ':' || {_cell('ty', 0.5)} || ':' || {_cell('tz', 0.5)} AS point, tx, ty, tz FROM v_est),
m AS (SELECT point, x - tx AS dx, y - ty AS dy, z - tz AS dz FROM o JOIN p USING (point)), n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM m),
a AS (SELECT point, avg(dx / n) AS ax, avg(dy / n) AS ay, avg(dz / n) AS az, min(n) AS least, max(n) AS most FROM n WHERE n > 0 GROUP BY 1)
SELECT point, round(least, 6) AS least, round(most, 6) AS most, round(sqrt(ax * ax + ay * ay + az * az), 4) AS agreement FROM a""")
def viewing_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Distance range of each point (mean of a voxel's positions) over the estimated poses in it, and whether a mean direction exists."""
    key = lambda: F.concat_ws(":", "sequence_id", *[geom.cell(F.col(c), 0.5).cast("string") for c in ("tx", "ty", "tz")]).alias("point")
    points = views.gt(spark, d).select(key(), *[F.col("t" + a).alias(a) for a in "xyz"]).groupBy("point").agg(*[F.avg(a).alias(a) for a in "xyz"])
    e = views.est(spark, d).select(key(), F.col("pose_id").alias("kf"), *[F.col("t" + a).alias("c" + a) for a in "xyz"])
    seen = keyframes.viewing(points, e.select("point", "kf"), e.select("kf", "cx", "cy", "cz"))
    # the length of the mean direction before it is made a unit one
    met = e.join(points, "point").withColumn("n", F.sqrt(sum(((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))).where("n > 0")
    mean = met.groupBy("point").agg(*[F.avg((F.col(a) - F.col("c" + a)) / F.col("n")).alias("m" + a) for a in "xyz"])
    agreement = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    return seen.join(mean, "point").select("point", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.round(agreement, 4).alias("agreement"))


@query("""WITH m AS (SELECT pose_id, sqrt((e_tx - g_tx) * (e_tx - g_tx) + (e_ty - g_ty) * (e_ty - g_ty) + (e_tz - g_tz) * (e_tz - g_tz)) AS e FROM v_near),
k AS (SELECT sequence_id, tz + 1 AS depth, m.pose_id IS NOT NULL AS has_point, coalesce(m.e > 0.05, false) AS outlier FROM v_est LEFT JOIN m USING (pose_id))
SELECT sequence_id, count(*) FILTER (WHERE depth > 0.01 AND depth < 2.0 AND has_point AND NOT outlier) AS tracked, count(*) FILTER (WHERE depth > 0.01 AND depth < 2.0 AND NOT (has_point AND NOT outlier)) AS untracked FROM k GROUP BY 1""")
def close_point_counts(spark: SparkSession, d: str) -> DataFrame:
    """Close keypoints that are tracked and that are not."""
    m = views.matched(spark, d)
    e = trajectory.distance([F.col("e_t" + c) for c in "xyz"], [F.col("g_t" + c) for c in "xyz"])
    k = views.est(spark, d).join(m.select("pose_id", e.alias("e")), "pose_id", "left")
    k = k.select("sequence_id", (F.col("tz") + 1).alias("depth"), F.col("e").isNotNull().alias("has_point"), F.coalesce(F.col("e") > 0.05, F.lit(False)).alias("outlier"))
    return keyframes.close_counts(k, "sequence_id", 2.0)


@query("""WITH k AS (SELECT sequence_id, pose_id AS idx, abs(tz) AS depth FROM v_est), p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY depth, idx) AS place FROM k WHERE depth > 0.01)
SELECT sequence_id, idx FROM p WHERE (place <= 100 OR depth < 0.5) AND idx NOT IN (SELECT pose_id FROM v_near)""")
def new_depth_points(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints from which new points are made: close ones or the hundred nearest, without a point of their own."""
    k = views.est(spark, d).select("sequence_id", F.col("pose_id").alias("idx"), F.abs("tz").alias("depth"))
    seen = views.matched(spark, d).select("sequence_id", F.col("pose_id").alias("idx"))
    return keyframes.new_depth_points(k, "sequence_id", 0.5, 100, seen).select("sequence_id", "idx")


# Submaps


def _submaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (poses), submaps of two hundred of them, and which node is a member of which."""
    n = ranked(views.est(spark, d).select("sequence_id", F.col("pose_id").alias("node"), "ts", F.col("tx").alias("x"), F.col("ty").alias("y")), "sequence_id", ["ts", "node"], "place").withColumn("block", F.expr("place div 200"))
    # written once: three readers follow, and an average computed again could differ in its last bit
    s = cut(n.groupBy("sequence_id", "block").agg(F.min("node").alias("submap"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("scans")))
    n = cut(n.join(s.select("sequence_id", "block", "submap"), ["sequence_id", "block"]).select("node", "x", "y", "submap"))
    return n.select("node", "x", "y"), s.select("submap", "x", "y", "scans", (F.col("scans") == 200).alias("finished")), n.select("node", "submap")


_SUBMAPS = """nodes AS (SELECT pose_id AS node, tx AS x, ty AS y, sequence_id, (row_number() OVER (PARTITION BY sequence_id ORDER BY ts, pose_id) - 1) // 200 AS block FROM v_est),
subs AS (SELECT sequence_id, block, min(node) AS submap, avg(x) AS sx, avg(y) AS sy, count(*) AS scans FROM nodes GROUP BY 1, 2), members AS (SELECT node, submap FROM nodes JOIN subs USING (sequence_id, block))"""


@query(f"""WITH {_SUBMAPS}, m AS (SELECT node, submap, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS distance FROM nodes JOIN subs ON scans = 200 AND submap <= (SELECT max(submap) FROM subs) - 1 WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 1.5),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, submap) AS place FROM m WHERE NOT EXISTS (SELECT 1 FROM members b WHERE b.node = m.node AND b.submap = m.submap))
SELECT node, submap, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4""")
def targets_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Finished submaps near each node that are not its own, the four nearest."""
    return _rounded(keyframes.targets_of_nodes(*_submaps(spark, d), radius=1.5))


@query(f"""WITH {_SUBMAPS}, f AS (SELECT submap, min(node) AS first FROM members GROUP BY 1),
m AS (SELECT submap, node, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS distance FROM subs JOIN f USING (submap) JOIN nodes ON node <= first - 50 WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 1.5),
k AS (SELECT *, row_number() OVER (PARTITION BY submap ORDER BY distance, node) - 1 AS place FROM m WHERE NOT EXISTS (SELECT 1 FROM members b WHERE b.node = m.node AND b.submap = m.submap))
SELECT submap, node, round(distance, 6) AS distance FROM k WHERE place % 3 = 0 AND place / 3 < 100""")
def nodes_of_targets(spark: SparkSession, d: str) -> DataFrame:
    """Old nodes near each submap: every third by distance, a hundred at most."""
    nodes, subs, members = _submaps(spark, d)
    return _rounded(keyframes.nodes_of_targets(subs.select("submap", "x", "y"), nodes, members, radius=1.5, separation=50, stride=3, cap=100))


# Points and observations: orders stand for keyframes, line numbers for keypoints, parts for points


def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    """(kf, idx, point, seen): a keypoint holds one point, the smaller one where the table has several lines of one number."""
    first = F.min(F.struct("l_partkey", "l_suppkey"))
    o = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL").groupBy(F.col("l_orderkey").alias("kf"), F.col("l_linenumber").alias("idx")).agg(first.alias("m"))
    return o.select("kf", "idx", F.col("m.l_partkey").alias("point"), F.col("m.l_suppkey").alias("seen"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    o = _keypoints(spark, d)
    return projection.fuse_points(o.select("kf", F.col("seen").alias("point"), "idx"), o.select("kf", "idx", "point"), o.groupBy("point").agg(F.count("*").alias("n")))


_KEYPOINTS = "o AS (SELECT l_orderkey AS kf, l_linenumber AS idx, l_partkey AS part, l_suppkey AS supp FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"
_FUSED = _KEYPOINTS + """, n AS (SELECT part AS point, count(*) AS n FROM o GROUP BY 1),
m AS (SELECT supp AS point, part AS old, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS n_old FROM o LEFT JOIN n a ON a.point = supp LEFT JOIN n b ON b.point = part WHERE supp <> part),
fused AS (SELECT DISTINCT CASE WHEN n >= n_old THEN point ELSE old END AS kept, CASE WHEN n >= n_old THEN old ELSE point END AS dropped FROM m)"""


@query(f"WITH {_FUSED} SELECT kept, dropped FROM fused")
def fused_points(spark: SparkSession, d: str) -> DataFrame:
    """Points to merge, the one with more observations staying."""
    return _fused(spark, d)


@query(f"""WITH {_FUSED}, once AS (SELECT dropped, min(kept) AS kept FROM fused GROUP BY 1)
SELECT coalesce(kept, part) AS point, kf, min(idx) AS idx FROM o LEFT JOIN once ON dropped = part GROUP BY 1, 2""")
def replaced_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations after the merges, once per keyframe; of several points a dropped one goes to the smallest."""
    return keyframes.replace_points(_keypoints(spark, d).select("point", "kf", "idx"), _fused(spark, d).groupBy("dropped").agg(F.min("kept").alias("kept")))


@query(f"""WITH {_KEYPOINTS} SELECT a.kf AS kf1, a.idx AS idx1, b.kf AS kf2, b.idx AS idx2, a.part AS point1, b.part AS point2 FROM o a JOIN o b ON b.kf = a.kf + 1 AND b.idx = a.idx""")
def point_correspondences(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points behind matches between consecutive keyframes."""
    o = _keypoints(spark, d).select("kf", "idx", "point")
    matches = o.select(F.col("kf").alias("kf1"), F.col("idx").alias("idx1"), (F.col("kf") + 1).alias("kf2"), F.col("idx").alias("idx2"))
    return projection.correspondences(matches, o)


_F12 = [0.0, -0.01, 0.2, 0.01, 0.0, -0.3, -0.2, 0.3, 0.0]


@query(f"""WITH {_DES}, k AS (SELECT des.*, e.embedding[1] * 100 AS u, e.embedding[2] * 100 AS v FROM des JOIN embeddings e ON e.vec_id = des.id),
m AS (SELECT q.id AS id1, t.id AS id2, bit_count(xor(q.a, t.a)) + bit_count(xor(q.b, t.b)) AS d, q.u * {_F12[0]}::DOUBLE + q.v * {_F12[3]}::DOUBLE + {_F12[6]}::DOUBLE AS la, q.u * {_F12[1]}::DOUBLE + q.v * {_F12[4]}::DOUBLE + {_F12[7]}::DOUBLE AS lb, q.u * {_F12[2]}::DOUBLE + q.v * {_F12[5]}::DOUBLE + {_F12[8]}::DOUBLE AS lc, t.u AS tu, t.v AS tv
  FROM k q JOIN k t ON q.label = t.label WHERE q.id % 20 = 0 AND q.id <> t.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS k FROM m WHERE d <= 30 AND la * la + lb * lb > 0 AND (la * tu + lb * tv + lc) * (la * tu + lb * tv + lc) < 3.84 * (la * la + lb * lb)),
w AS (SELECT *, row_number() OVER (PARTITION BY id2 ORDER BY d, id1) AS first FROM n WHERE k = 1)
SELECT id1, id2, CAST(d AS INTEGER) AS distance FROM w WHERE first = 1""")
def epipolar_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches near each other's epipolar line within a node; queries are the rows whose id is divisible by 20, against all rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0] * 100).cast("double").alias("u"), (F.col("embedding")[1] * 100).cast("double").alias("v"))
    k = mq._descriptors(spark, d).withColumnRenamed("label", "node").join(e, "id").withColumn("sigma2", F.lit(1.0))
    out = projection.epipolar_candidates(k.where("id % 20 = 0"), k, _F12, 2, most=30, same=True)
    return out.select("id1", "id2", F.col("distance").cast("int").alias("distance"))


# Words: the bag of a keyframe are the parts of an order, weighed by their quantity


@query("""WITH w AS (SELECT l_orderkey AS kf, l_partkey AS word, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2), n AS (SELECT kf, word, q / sum(q) OVER (PARTITION BY kf) AS v FROM w)
SELECT a.kf AS query, b.kf AS kf, count(*) AS shared, round(sum((a.v + b.v - abs(a.v - b.v)) / 2), 6) AS score FROM n a JOIN n b USING (word) WHERE a.kf % 20 = 0 AND a.kf <> b.kf GROUP BY 1, 2""")
def word_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of each query's bag of words (ids divisible by 20) with every other one that shares a word, by the inverted index."""
    return _rounded(_word_scores(spark, d))


def _word_scores(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL").groupBy(F.col("l_orderkey").alias("kf"), F.col("l_partkey").alias("word")).agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    bags = graph.normalised_bags(w, "kf", "q")
    return graph.bag_scores(bags.where("kf % 20 = 0"), bags, "kf", "word", "v").withColumnRenamed("other", "kf")


@query("""WITH w AS (SELECT l_orderkey AS kf, l_partkey AS word, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2), n AS (SELECT kf, word, q / sum(q) OVER (PARTITION BY kf) AS v FROM w),
s AS (SELECT a.kf AS query, b.kf AS kf, count(*) AS shared, round(sum((a.v + b.v - abs(a.v - b.v)) / 2), 6) AS score FROM n a JOIN n b USING (word) WHERE a.kf % 20 = 0 AND a.kf <> b.kf GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kf) AS place FROM s WHERE shared > floor(0.8 * (SELECT max(shared) FROM s t WHERE t.query = s.query)))
SELECT query, kf, shared, score, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""")
def relocalisation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for relocalising each query: more than four fifths of the most common words, the ten best scores."""
    return graph.relocalisation(_rounded(_word_scores(spark, d)), 0.8, 10).select("query", "kf", "shared", "score", "place")


SQL["relocalisation_candidates"] = with_views("""WITH w AS (SELECT l_orderkey AS kf, l_partkey AS word, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY 1, 2), n AS (SELECT kf, word, q / sum(q) OVER (PARTITION BY kf) AS v FROM w),
s AS (SELECT a.kf AS query, b.kf AS kf, count(*) AS shared, round(sum((a.v + b.v - abs(a.v - b.v)) / 2), 6) AS score FROM n a JOIN n b USING (word) WHERE a.kf % 20 = 0 AND a.kf <> b.kf GROUP BY 1, 2),
m AS (SELECT *, max(shared) OVER (PARTITION BY query) AS most FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kf) AS place FROM m WHERE shared > floor(0.8 * most))
SELECT query, kf, shared, score, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""")


# Clouds and maps


@query("""WITH o AS (SELECT sequence_id, min(tx) AS ox, min(ty) AS oy, min(tz) AS oz FROM v_gt GROUP BY 1), k AS (SELECT sequence_id, CAST(floor(round((tx - ox) / 0.2, 6)) AS BIGINT) AS vtx, CAST(floor(round((ty - oy) / 0.2, 6)) AS BIGINT) AS vty, CAST(floor(round((tz - oz) / 0.2, 6)) AS BIGINT) AS vtz, tx, abs(pose_id % 256) AS red FROM v_gt JOIN o USING (sequence_id))
SELECT sequence_id, vtx, vty, vtz, round(avg(tx), 9) AS tx, CAST(floor(avg(red)) AS INTEGER) AS red, count(*) AS n FROM k GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")
def voxels_from_origin(spark: SparkSession, d: str) -> DataFrame:
    """Voxels from each cloud's own corner with mean colours, of at least two points."""
    p = views.gt(spark, d).withColumn("red", F.abs(F.col("pose_id") % 256))
    return _rounded(maps.voxels_from_origin(p, 0.2, ["sequence_id"], ["tx", "ty", "tz"], ["red"]).select("sequence_id", "vtx", "vty", "vtz", "tx", "red", "n"), 9)


@query("SELECT pose_id FROM v_gt WHERE tx > -1.5 AND tx < 1.5 AND tz > -0.5 AND tz < 0.5")
def cropped_points(spark: SparkSession, d: str) -> DataFrame:
    return maps.crop(views.gt(spark, d), {"tx": (-1.5, 1.5), "tz": (-0.5, 0.5)}).select("pose_id")


@query("""WITH r AS (SELECT scan_id, sensor_id, unnest(ranges) AS z, generate_subscripts(ranges, 1) - 1 AS u FROM v_scans WHERE scan_id % 4 = 0)
SELECT scan_id, CAST(u AS INTEGER) AS u, round((u - 90) / 60.0 * z, 6) AS x, round(((scan_id % 480)::INTEGER - 240) / 60.0 * z, 6) AS y, z FROM r WHERE u % 4 = 0 AND z > 0.3 AND z < 8.0 AND NOT isnan(z)""")
def depth_cloud(spark: SparkSession, d: str) -> DataFrame:
    """Scans read as rows of depth images, a pixel of four by four, to camera points within strict depths."""
    rows = views.scans(spark, d).withColumn("row", F.col("scan_id"))
    out = maps.depth_points(rows, "ranges", "row", ["scan_id"], (60.0, 60.0, 90.0, 240.0), stride=4, least=0.3, most=8.0)
    # an image has 480 rows
    return _rounded(out.select("scan_id", "u", "x", ((F.col("scan_id") % 480 - 240) / 60.0 * F.col("z")).alias("y"), "z").where(~F.isnan("z")).select("scan_id", "u", "x", "y", "z"), 6)


SQL["depth_cloud"] = SQL["depth_cloud"].replace("AS y, z FROM r", "AS y, round(z, 6) AS z FROM r")


@query("""WITH s AS (SELECT scan_id, ranges, CAST(round_even(abs(scan_id % 400) / 2.0::DOUBLE, 0) AS INTEGER) AS i FROM v_scans), z AS (SELECT scan_id, CASE WHEN i < len(ranges) THEN ranges[i + 1] END AS z FROM s)
SELECT scan_id, round(CASE WHEN z > 0 AND NOT isnan(z) AND z <= 10 THEN z END, 6) AS depth FROM z""")
def depth_at_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Depth at one pixel of each scan, halves rounded to even; null where there is none."""
    return views.scans(spark, d).select("scan_id", F.round(maps.depth_lookup(F.col("ranges"), F.abs(F.col("scan_id") % 400) / 2.0, most=10.0), 6).alias("depth"))


_THIN = f"""{_RAYS.split(', occ AS')[0].split(', walk AS')[0].split(',' + chr(10) + 'walk AS')[0]},
walk AS (SELECT *, CASE WHEN n + 1 > 20 THEN CAST(floor(k * n / 19.0::DOUBLE + 1e-9) AS BIGINT) ELSE k END AS i FROM (SELECT *, unnest(generate_series(0, least(n, 19))) AS k FROM steps))"""


@query(f"""WITH {_THIN}, cells AS (SELECT sensor_id, x0 + {mq._AT.format('dx')} AS gx, y0 + {mq._AT.format('dy')} AS gy, i = n AS hit FROM walk)
SELECT sensor_id, gx, gy, count(*) FILTER (WHERE NOT hit) AS free, count(*) FILTER (WHERE hit) AS hits FROM cells GROUP BY sensor_id, gx, gy""")
def occupancy_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy counts from twenty evenly spaced cells of each ray's line."""
    cells = maps.spaced_ray_cells(mq._world(spark, d), _SIZE, 20)
    return maps.occupancy_counts(cells, ["sensor_id"]).select("sensor_id", "gx", "gy", "free", "hits")


@query()
def occupancy_per_scan(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy map with one clip per scan, scans in order."""
    return _rounded(maps.occupancy_by_scan(mq._rays(spark, d), ["sensor_id"]))


_ENDS = f"""b AS (SELECT s.scan_id, s.sensor_id, o.odom, o.laser_pose, p.x, p.y FROM pts p JOIN v_scans s USING (scan_id) JOIN (SELECT DISTINCT ON (scan_id) scan_id, odom, laser_pose FROM scans) o USING (scan_id)),
a AS (SELECT DISTINCT sensor_id, {_cell('odom.x + cos(odom.theta) * x - sin(odom.theta) * y', _SIZE)} AS gx, {_cell('odom.y + sin(odom.theta) * x + cos(odom.theta) * y', _SIZE)} AS gy FROM b WHERE odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL),
c AS (SELECT DISTINCT sensor_id, {_cell('laser_pose.x + cos(laser_pose.theta) * x - sin(laser_pose.theta) * y', _SIZE)} AS gx, {_cell('laser_pose.y + sin(laser_pose.theta) * x + cos(laser_pose.theta) * y', _SIZE)} AS gy FROM b WHERE laser_pose.x IS NOT NULL AND laser_pose.y IS NOT NULL AND laser_pose.theta IS NOT NULL)"""


@query(f"""WITH {_POINTS}, {_ENDS}, u AS (SELECT sensor_id, gx, gy, bool_or(o) AS o, bool_or(l) AS l FROM (SELECT *, true AS o, false AS l FROM a UNION ALL SELECT *, false, true FROM c) GROUP BY 1, 2, 3)
SELECT sensor_id, count_if(o) AS odom, count_if(l) AS laser, count_if(o AND l) AS shared, count(*) AS any FROM u GROUP BY 1""".replace("AS any", 'AS "any"'))
def map_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Cells hit in maps built from two poses of the same scans: odometry and laser."""
    pts = mq._points(spark, d)
    laser = pts.join(views.scans(spark, d).select("scan_id", "laser_pose"), "scan_id")
    hit = lambda p, pose: maps.world_points(p, pose).select("sensor_id", geom.cell(F.col("x"), _SIZE).alias("gx"), geom.cell(F.col("y"), _SIZE).alias("gy"))
    out = maps.compare_cells({"odom": hit(pts, "odom"), "laser": hit(laser, "laser_pose")}, ["sensor_id"])
    return out.select("sensor_id", "odom", "laser", "shared", "any")


# Scan matching


@query(f"""WITH {_RAYS}, prob AS (SELECT sensor_id, gx, gy, 1 / (1 + exp(-l)) AS p FROM occ),
k AS (SELECT scan_id, sensor_id, t, x, y, ox, oy FROM world w JOIN (SELECT scan_id, t FROM v_scans) USING (scan_id)),
r AS (SELECT scan_id, sensor_id, kk, CAST(floor(round((ox + cos(kk * 0.02) * (x - ox) - sin(kk * 0.02) * (y - oy)) / {_SIZE}, 6)) AS BIGINT) AS gx, CAST(floor(round((oy + sin(kk * 0.02) * (x - ox) + cos(kk * 0.02) * (y - oy)) / {_SIZE}, 6)) AS BIGINT) AS gy FROM k, (SELECT unnest([-1, 0, 1]) AS kk)),
c AS (SELECT scan_id, sensor_id, kk, gx, gy, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT scan_id, kk, di, dj, sum(p * n) / sum(n) AS score, sum(n) AS n FROM c, (SELECT unnest([-1, 0, 1]) AS di) a, (SELECT unnest([-1, 0, 1]) AS dj) b JOIN prob ON prob.sensor_id = c.sensor_id AND prob.gx = c.gx + di AND prob.gy = c.gy + dj GROUP BY scan_id, kk, di, dj HAVING sum(n) >= 20)
SELECT scan_id, CAST(kk AS INTEGER) AS turn, CAST(di AS INTEGER) AS di, CAST(dj AS INTEGER) AS dj, CAST(n AS BIGINT) AS n, round(score, 6) AS score FROM m""")
def correlative_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability under each scan's points for three turns and nine shifts by whole cells, on its sensor's map."""
    from ..operators import matching

    return _rounded(matching.cell_scores(mq._world(spark, d), mq._occupancy(spark, d), ["sensor_id"], _SIZE, turns=1, turn=0.02, shifts=1))


@query()
def match_scans(spark: SparkSession, d: str) -> DataFrame:
    """The best of these offsets per scan; of equally good ones the smallest."""
    from ..operators import matching

    return matching.best_cells(correlative_scores(spark, d))


SQL["match_scans"] = f"SELECT * FROM ({SQL['correlative_scores']}) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, abs(turn) + abs(di) + abs(dj), turn, di, dj) = 1"


# Time


@query("""SELECT stream, count(*) AS rows, count(*) FILTER (WHERE late > 300) AS late, round(max(late), 3) AS most FROM (
  SELECT 'scans' AS stream, date_diff('millisecond', TIMESTAMP '1970-01-01', received_at) / 1000.0::DOUBLE - t AS late FROM scans WHERE t IS NOT NULL AND NOT isnan(t)
  UNION ALL SELECT 'gt_poses', date_diff('millisecond', TIMESTAMP '1970-01-01', received_at) / 1000.0::DOUBLE - ts FROM gt_poses WHERE ts IS NOT NULL AND NOT isnan(ts)) GROUP BY 1""")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two streams that arrive more than five minutes after their time."""
    from ..streaming.stateful import late_split

    parts = []
    for name, ts in (("scans", "t"), ("gt_poses", "ts")):
        t = table(spark, d, name).where(F.col(ts).isNotNull() & ~F.isnan(ts)).select(F.lit(name).alias("stream"), F.col(ts).alias("ts"), (F.unix_millis(F.col("received_at").cast("timestamp")) / 1000.0).alias("arrived"))
        parts.append(late_split(t, "ts", "arrived", 300.0))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("stream").agg(F.count("*").alias("rows"), F.count_if("late").alias("late"), F.round(F.max("lag"), 3).alias("most"))


@query("SELECT sensor_id, CAST(floor(t / 60) * 60 AS BIGINT) AS start, count(*) AS n FROM v_scans WHERE NOT isnan(t) GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scans per sensor and minute."""
    from ..streaming.stateful import windowed_counts

    s = views.scans(spark, d).where(~F.isnan("t")).select("sensor_id", F.timestamp_seconds("t").alias("at"))
    return windowed_counts(s, "at", "sensor_id", "60 seconds", "1 hour").select("sensor_id", F.unix_seconds("start").alias("start"), "n")


@query("""WITH s AS (SELECT sensor_id, t FROM v_scans WHERE NOT isnan(t)), w AS (SELECT sensor_id, CAST(floor(t / 30) * 30 - 30 * k AS BIGINT) AS start FROM s, (SELECT unnest([0, 1]) AS k)) SELECT sensor_id, start, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scans per sensor in minutes that begin every half minute."""
    from ..streaming.stateful import windowed_counts

    s = views.scans(spark, d).where(~F.isnan("t")).select("sensor_id", F.timestamp_seconds("t").alias("at"))
    return windowed_counts(s, "at", "sensor_id", "60 seconds", "1 hour", "30 seconds").select("sensor_id", F.unix_seconds("start").alias("start"), "n")


@query("""WITH s AS (SELECT sensor_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY sensor_id ORDER BY t) < 10 THEN 0 ELSE 1 END AS new FROM (SELECT sensor_id, floor(t * 1000) / 1000 AS t FROM v_scans WHERE NOT isnan(t))),
g AS (SELECT sensor_id, t, sum(new) OVER (PARTITION BY sensor_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT sensor_id, CAST(floor(min(t)) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY sensor_id, g""")
def scan_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each sensor without a gap of ten seconds."""
    from ..streaming.stateful import sessions

    s = views.scans(spark, d).where(~F.isnan("t")).select("sensor_id", F.timestamp_millis(F.floor(F.col("t") * 1000)).alias("at"))
    return sessions(s, "at", "sensor_id", "10 seconds").select("sensor_id", F.unix_seconds("start").alias("start"), "n")


# Reports


@query("""SELECT sequence_id, count(*) AS frames, count(DISTINCT rgb) AS images, sum(octet_length(encode(rgb))) + sum(coalesce(octet_length(encode(depth)), 0)) AS path_bytes FROM v_frames GROUP BY 1""")
def frame_memory(spark: SparkSession, d: str) -> DataFrame:
    """Frames, images and bytes of their paths per sequence."""
    f = views.frames(spark, d)
    return f.groupBy("sequence_id").agg(F.count("*").alias("frames"), F.count_distinct("rgb").alias("images"), (F.sum(F.octet_length("rgb")) + F.sum(F.coalesce(F.octet_length("depth"), F.lit(0)))).alias("path_bytes"))


@query("SELECT l_linenumber AS octave, count(*) AS keypoints, round(count(*) * 1.0::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS per_image FROM lineitem GROUP BY 1")
def octave_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints per octave, and how many of them an image has."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("octave"))
    return _rounded(descriptors.octave_histogram(o, "image", "octave"))


@query("""SELECT entry_id, printf('%.6f', rgb_ts) AS stamp, regexp_extract(rgb, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM v_frames WHERE rgb_ts IS NOT NULL AND rgb IS NOT NULL""")
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by time stamp and by the file's stem."""
    f = views.frames(spark, d).where("rgb_ts IS NOT NULL AND rgb IS NOT NULL")
    return f.select("entry_id", F.format_string("%.6f", "rgb_ts").alias("stamp"), F.regexp_extract("rgb", r"([^/]*?)(\\.[^./]*)?$".replace("\\\\", "\\"), 1).alias("stem"))


@query("SELECT pose_id, tx IS NOT NULL AND NOT isnan(tx) AND NOT isinf(tx) AND ty IS NOT NULL AND NOT isnan(ty) AND NOT isinf(ty) AND tz IS NOT NULL AND NOT isnan(tz) AND NOT isinf(tz) AS finite FROM (SELECT DISTINCT pose_id, tx, ty, tz FROM est_poses WHERE pose_id IS NOT NULL)")
def finite_poses(spark: SparkSession, d: str) -> DataFrame:
    """Whether each pose's position is finite."""
    ok = F.lit(True)
    for c in ("tx", "ty", "tz"):
        ok = ok & geom.finite(F.col(c))
    return table(spark, d, "est_poses").where("pose_id IS NOT NULL").select("pose_id", "tx", "ty", "tz").distinct().select("pose_id", ok.alias("finite"))


@query(f"""WITH {_POINTS}, r AS (SELECT sensor_id, odom, x, y, sqrt(x * x + y * y) AS r, k FROM pts, (SELECT unnest(generate_series(-3, 3)) AS k) WHERE odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL),
f AS (SELECT *, (r + k * 0.1) / r AS f FROM r WHERE r > 0), c AS (SELECT sensor_id, {_cell('odom.x + cos(odom.theta) * (x * f) - sin(odom.theta) * (y * f)', 0.1)} AS gx, {_cell('odom.y + sin(odom.theta) * (x * f) + cos(odom.theta) * (y * f)', 0.1)} AS gy, -k / 3.0::DOUBLE AS d FROM f WHERE f > 0),
t AS (SELECT sensor_id, gx, gy, avg(d) AS sdf, count(*) AS weight FROM c GROUP BY 1, 2, 3), h AS (SELECT * FROM t WHERE abs(sdf) < 0.39 AND weight >= 3)
SELECT sensor_id, gx, gy, round(sdf, 6) AS sdf, weight FROM h WHERE EXISTS (SELECT 1 FROM h o WHERE o.sensor_id = h.sensor_id AND o.gx BETWEEN h.gx - 1 AND h.gx + 1 AND o.gy BETWEEN h.gy - 1 AND h.gy + 1 AND (o.gx <> h.gx OR o.gy <> h.gy))""")
def fused_surface(spark: SparkSession, d: str) -> DataFrame:
    """Surface of the truncated signed distances of all scans, without lone cells."""
    field = maps.fuse_signed_distance(mq._points(spark, d), ["sensor_id"], 0.1, 0.3)
    return _rounded(maps.clean_surface(field, ["sensor_id"], 0.39, 3))


@query(f"""WITH {_SUBMAPS}, f AS (SELECT submap, min(node) AS first FROM members GROUP BY 1), dist AS (SELECT node, submap, scans, first, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS distance FROM nodes, subs JOIN f USING (submap)),
fresh AS (SELECT * FROM dist m WHERE distance <= 1.5 AND NOT EXISTS (SELECT 1 FROM members b WHERE b.node = m.node AND b.submap = m.submap)),
one AS (SELECT node, submap, distance FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, submap) AS place FROM fresh WHERE scans = 200 AND submap <= (SELECT max(submap) FROM subs) - 1) WHERE place <= 4),
two AS (SELECT submap, node, distance FROM (SELECT *, row_number() OVER (PARTITION BY submap ORDER BY distance, node) - 1 AS place FROM fresh WHERE node <= first - 50) WHERE place % 3 = 0 AND place / 3 < 100),
u AS (SELECT DISTINCT node, submap AS target, exp(-distance) AS score, distance AS residual FROM (SELECT node, submap, distance FROM one UNION ALL SELECT node, submap, distance FROM two)),
g AS (SELECT *, CASE WHEN score < 0.4 THEN 'rejected_score' WHEN residual > 0.8 THEN 'rejected_residual' ELSE 'accepted' END AS gate FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY node, gate ORDER BY score DESC, target) AS place FROM g)
SELECT node, target, CASE WHEN gate = 'accepted' AND place > 1 THEN 'accepted_limit' ELSE gate END AS status FROM k""")
def loop_manager(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of new nodes and of finished submaps together, with what becomes of each; nearness stands in for the score."""
    nodes, subs, members = _submaps(spark, d)
    one = keyframes.targets_of_nodes(nodes, subs, members, radius=1.5)
    two = keyframes.nodes_of_targets(subs.select("submap", "x", "y"), nodes, members, radius=1.5, separation=50, stride=3, cap=100)
    from ..operators import loops

    both = one.select("node", F.col("submap").alias("target"), "distance").unionByName(two.select("node", F.col("submap").alias("target"), "distance"))
    scored = both.select("node", "target", F.exp(-F.col("distance")).alias("score"), F.col("distance").alias("residual"))
    return loops.manage_loops(scored, members.withColumnRenamed("submap", "target"), least=0.4, metres=0.8, per_node=1).select("node", "target", "status")


@query(f"""WITH s AS (SELECT DISTINCT ON (scan_id) scan_id, sensor_id, t, odom.x AS ox, odom.y AS oy, odom.theta AS oh, laser_pose.x AS px, laser_pose.y AS py, laser_pose.theta AS ph FROM scans
  WHERE scan_id IS NOT NULL AND sensor_id IS NOT NULL AND t IS NOT NULL AND len(ranges) > 0 AND {_GOOD}),
w AS (SELECT *, min({{'t': t, 'x': px, 'y': py, 'h': ph}}) OVER w AS a, max({{'t': t, 'x': px, 'y': py, 'h': ph}}) OVER w AS b, min({{'t': t, 'x': ox, 'y': oy, 'h': oh}}) OVER w AS c, max({{'t': t, 'x': ox, 'y': oy, 'h': oh}}) OVER w AS d
  FROM s WINDOW w AS (PARTITION BY sensor_id ORDER BY t RANGE BETWEEN 1.5 PRECEDING AND CURRENT ROW)),
v AS (SELECT scan_id, sensor_id, t, px, py, ph, oh, CASE WHEN b.t > a.t THEN 0.5 * (b.x - a.x) / (b.t - a.t) + 0.5 * (d.x - c.x) / (d.t - c.t) ELSE 0 END AS vx, CASE WHEN b.t > a.t THEN 0.5 * (b.y - a.y) / (b.t - a.t) + 0.5 * (d.y - c.y) / (d.t - c.t) ELSE 0 END AS vy,
  CASE WHEN b.t > a.t THEN 0.5 * {_WRAP.format('b.h - a.h')} / (b.t - a.t) + 0.5 * {_WRAP.format('d.h - c.h')} / (d.t - c.t) ELSE 0 END AS vh FROM w),
l AS (SELECT *, lag(px) OVER o AS x0, lag(py) OVER o AS y0, lag(ph) OVER o AS h0, lag(vx) OVER o AS vx0, lag(vy) OVER o AS vy0, lag(vh) OVER o AS vh0, greatest(0, least(0.5, t - lag(t) OVER o)) AS dt, first_value(ph - oh) OVER o AS off FROM v WINDOW o AS (PARTITION BY sensor_id ORDER BY t, scan_id)),
p AS (SELECT *, h0 + vh0 * dt AS h1 FROM l)
SELECT scan_id, round(x0 + vx0 * dt, 6) AS x, round(y0 + vy0 * dt, 6) AS y, round(cos(h1 + 0.1 * {_WRAP.format('oh + off - h1')}), 6) AS heading_cos FROM p""")
def extrapolated_poses(spark: SparkSession, d: str) -> DataFrame:
    """Each scan's pose foreseen from the last 1.5 s: half from odometry, the heading drawn to that of the odometry."""
    s = views.scans(spark, d).where(_GOOD).select("scan_id", "sensor_id", "t", F.col("laser_pose").alias("pose"), "odom", F.col("odom.theta").alias("yaw"))
    out = trajectory.extrapolate(s, "sensor_id", ["t", "scan_id"], blend=0.5, yaw="yaw", alpha=0.1)
    return out.select("scan_id", F.round("predicted.x", 6).alias("x"), F.round("predicted.y", 6).alias("y"), F.round(F.cos("predicted.theta"), 6).alias("heading_cos"))


# Least squares of views, block by block of the matched poses


def _blocks(spark: SparkSession, d: str, size: int) -> DataFrame:
    m = ranked(views.matched(spark, d), "sequence_id", ["ts", "pose_id"], "place")
    return m.withColumn("block", F.expr(f"place div {size}"))


def _xyz(rows, prefix: str):
    return rows.sort_values("place")[[f"{prefix}_t{c}" for c in "xyz"]].to_numpy(float)


_VIEW = (500.0, 500.0, 320.0, 240.0)


def _pixels(xyz):
    import numpy as np

    z = np.maximum(xyz[:, 2] + 3, 1e-3)
    return np.stack([_VIEW[0] * xyz[:, 0] / z + _VIEW[2], _VIEW[1] * xyz[:, 1] / z + _VIEW[3]], axis=1)


@query()
def sim3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Similarity that takes each block of estimated poses to the ground truth, robustly: scale and inliers."""
    from ..operators import vision

    def kernel(rows):
        _, _, s, inside = vision.sim3_ransac(_xyz(rows, "e"), _xyz(rows, "g"), 0.1)
        return {"pairs": len(rows), "inliers": int(inside.sum()), "scale": s}

    return vision.solve_groups(_blocks(spark, d, 256), ["sequence_id", "block"], kernel, "pairs INT, inliers INT, scale DOUBLE")


@query()
def homography_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Homography between the images of both trajectories per block: inliers."""
    from ..operators import vision

    def kernel(rows):
        h, inside = vision.homography_ransac(_pixels(_xyz(rows, "e")), _pixels(_xyz(rows, "g")), 10.0)
        return {"pairs": len(rows), "inliers": int(inside.sum()), "h": h.ravel().tolist()}

    return vision.solve_groups(_blocks(spark, d, 256), ["sequence_id", "block"], kernel, "pairs INT, inliers INT, h ARRAY<DOUBLE>")


@query()
def essential_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Epipolar geometry between the images of both trajectories per block: inliers and turn."""
    import numpy as np

    from ..operators import vision

    k = np.array([[_VIEW[0], 0, _VIEW[2]], [0, _VIEW[1], _VIEW[3]], [0, 0, 1.0]])

    def kernel(rows):
        _, r, _, inside = vision.essential_ransac(_pixels(_xyz(rows, "e")), _pixels(_xyz(rows, "g")), k, 3.0)
        return {"pairs": len(rows), "inliers": int(inside.sum()), "turn_deg": float(np.degrees(np.linalg.norm(vision.rotation_vector(r))))}

    return vision.solve_groups(_blocks(spark, d, 256), ["sequence_id", "block"], kernel, "pairs INT, inliers INT, turn_deg DOUBLE")


@query()
def motion_only_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Camera pose that explains the estimated positions' pixels by the true points, per block."""
    import numpy as np

    from ..operators import vision

    def kernel(rows):
        points = _xyz(rows, "g") + [0, 0, 3.0]
        r, t, inside = vision.motion_only(np.eye(3), np.zeros(3), points, _pixels(_xyz(rows, "e")), _VIEW, np.full(len(rows), 25.0))
        return {"pairs": len(rows), "inliers": int(inside.sum()), "shift": float(np.linalg.norm(t)), "turn_deg": float(np.degrees(np.linalg.norm(vision.rotation_vector(r))))}

    return vision.solve_groups(_blocks(spark, d, 256), ["sequence_id", "block"], kernel, "pairs INT, inliers INT, shift DOUBLE, turn_deg DOUBLE")


@query()
def bundle_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Local bundles: four cameras beside each other see a block's true points; their positions start a little off."""
    import numpy as np

    from ..operators import vision

    def kernel(rows):
        points = _xyz(rows, "g") + [0, 0, 3.0]
        m, n = len(points), 4
        rs, ts = np.stack([np.eye(3)] * n), np.stack([np.array([0.1 * k, 0.02 * k, 0.0]) for k in range(n)])
        cam_of, point_of = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        pixels = np.concatenate([vision._project(r, t, points, _VIEW)[0] for r, t in zip(rs, ts)])
        start = ts + np.r_[np.zeros((2, 3)), np.full((n - 2, 3), 0.01)]
        _, found, _, inside = vision.bundle_adjust(rs, start, points, cam_of, point_of, pixels, _VIEW, fixed=2)
        return {"points": m, "observations": len(pixels), "inliers": int(inside.sum()), "off": float(np.abs(found - ts).max())}

    return vision.solve_groups(_blocks(spark, d, 64), ["sequence_id", "block"], kernel, "points INT, observations INT, inliers INT, off DOUBLE")


@query()
def spatial_graph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Essential graph of each block of poses: estimated poses as they are, true relations between neighbours as edges; error before and after."""
    import numpy as np

    from ..operators import vision

    def turned(q):
        x, y, z, w = q / max(np.linalg.norm(q), 1e-12)
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])

    def kernel(rows):
        rows = rows.sort_values("place")
        e, g = ((np.stack([turned(q) for q in rows[[f"{s}_q{c}" for c in "xyzw"]].to_numpy(float)]), rows[[f"{s}_t{c}" for c in "xyz"]].to_numpy(float)) for s in "eg")
        n = len(rows)
        i = np.r_[np.arange(n - 1), np.arange(max(n - 2, 0))]
        j = np.r_[np.arange(1, n), np.arange(2, max(n, 2))]
        zr = np.stack([g[0][a].T @ g[0][b] for a, b in zip(i, j)]) if len(i) else np.empty((0, 3, 3))
        zt = np.stack([g[0][a].T @ (g[1][b] - g[1][a]) for a, b in zip(i, j)]) if len(i) else np.empty((0, 3))
        error = lambda rs, ts: float(np.sqrt(np.mean([np.sum((rs[a].T @ (ts[b] - ts[a]) - t) ** 2) for a, b, t in zip(i, j, zt)]))) if len(i) else 0.0
        rs, ts = vision.spatial_graph(*e, i, j, zr, zt, np.ones(len(i)))
        return {"poses": n, "edges": len(i), "before": error(*e), "after": error(rs, ts)}

    return vision.solve_groups(_blocks(spark, d, 24), ["sequence_id", "block"], kernel, "poses INT, edges INT, before DOUBLE, after DOUBLE")


@query()
def scan_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Pose of every scan refined on its sensor's map."""
    from ..operators import matching

    return matching.match_scans(mq._points(spark, d), mq._occupancy(spark, d), ["sensor_id"], _SIZE)


@query()
def scan_search(spark: SparkSession, d: str) -> DataFrame:
    """Pose of every scan by branch and bound on its sensor's map, half a metre around."""
    from ..operators import matching

    return matching.match_scans(mq._points(spark, d), mq._occupancy(spark, d), ["sensor_id"], _SIZE, method="search", reach=0.5)
