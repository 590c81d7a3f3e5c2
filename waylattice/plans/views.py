"""Clean views of the domain tables: every delivery once, unusable rows left out. Each has its SQL beside it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..sources.tables import table

POSE = ["pose_id", "sequence_id", "ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def _poses(spark: SparkSession, d: str, name: str) -> DataFrame:
    usable = " AND ".join(["pose_id IS NOT NULL", "sequence_id IS NOT NULL", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in POSE[2:])])
    return table(spark, d, name).select(*POSE).where(usable).distinct()


def est(spark: SparkSession, d: str) -> DataFrame:
    return _poses(spark, d, "est_poses")


def gt(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth, of poses recorded twice at one time the one with the smaller id."""
    rest = F.struct(*POSE[3:])
    once = _poses(spark, d, "gt_poses").groupBy("sequence_id", "ts").agg(F.min_by(rest, "pose_id").alias("p"), F.min("pose_id").alias("pose_id"))
    return once.select("pose_id", "sequence_id", "ts", "p.*")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "associations").where("entry_id IS NOT NULL AND sequence_id IS NOT NULL").select("entry_id", "sequence_id", "rgb_ts", "rgb", "depth_ts", "depth").distinct()


def scans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scans").where("scan_id IS NOT NULL AND sensor_id IS NOT NULL AND t IS NOT NULL AND size(ranges) > 0").select("scan_id", "sensor_id", "dataset", "t", "ranges", "odom", "laser_pose").dropDuplicates(["scan_id"])


def loops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loop_debug").drop("received_at").distinct()


def timing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_timing").drop("received_at").distinct()


def matched(spark: SparkSession, d: str, tolerance: float = 0.02) -> DataFrame:
    """Estimated poses with their nearest ground truth (earlier on a tie): e_* and g_* columns."""
    from ..operators.asof import asof_nearest

    truth = gt(spark, d)
    near = asof_nearest(est(spark, d), truth, "sequence_id", "ts", "ts", "pose_id", tolerance=tolerance, how="inner", carry=POSE[3:])
    return near.withColumnsRenamed({**{c: "e_" + c for c in POSE[3:]}, **{"match_" + c: "g_" + c for c in POSE[3:]}})


def planar(prefix: str = "") -> "F.Column":
    """Planar pose struct of a spatial one."""
    q = [F.col(prefix + c) for c in POSE[6:]]
    return geom.se2(F.col(prefix + "tx"), F.col(prefix + "ty"), geom.quaternion_to_yaw(*q))


def spatial(prefix: str = "") -> "F.Column":
    return geom.se3(geom.quaternion_to_matrix(*[F.col(prefix + c) for c in POSE[6:]]), [F.col(prefix + c) for c in POSE[3:6]])


def nan_safe(sql: str) -> str:
    """SQL whose tests for NaN don't trust the files' statistics, which leave NaN out of least and greatest values."""
    return re.sub(r"isnan\(([\w.]+)\)", r"(CAST(\1 AS VARCHAR) = 'nan')", sql)


def with_views(sql: str) -> str:
    """Puts the SQL of the views that a query names before it."""
    used, text = [], sql
    for name in reversed(list(VIEWS)):
        if f" {name}" in text or f"({name}" in text:
            used.insert(0, f"{name} AS ({VIEWS[name]})")
            text += VIEWS[name]
    body = sql.strip()
    if not used:
        return body
    first = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
    return (first or "WITH ") + ",\n".join(used) + (",\n" if first else "\n") + body[len(first):]


_USABLE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in POSE[2:])
_YAW = "atan2(2.0 * ({0}qw * {0}qz + {0}qx * {0}qy), 1.0 - 2.0 * ({0}qy * {0}qy + {0}qz * {0}qz))"
VIEWS = {
    "v_est": f"SELECT DISTINCT {', '.join(POSE)} FROM est_poses WHERE sequence_id IS NOT NULL AND {_USABLE}",
    "v_gt": f"""SELECT {', '.join(POSE)} FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, ts ORDER BY pose_id) AS k
      FROM (SELECT DISTINCT {', '.join(POSE)} FROM gt_poses WHERE sequence_id IS NOT NULL AND {_USABLE})) WHERE k = 1""",
    "v_frames": "SELECT DISTINCT entry_id, sequence_id, rgb_ts, rgb, depth_ts, depth FROM associations WHERE entry_id IS NOT NULL AND sequence_id IS NOT NULL",
    "v_scans": "SELECT DISTINCT ON (scan_id) scan_id, sensor_id, dataset, t, ranges, odom FROM scans WHERE scan_id IS NOT NULL AND sensor_id IS NOT NULL AND t IS NOT NULL AND len(ranges) > 0",
    "v_loops": "SELECT DISTINCT * EXCLUDE (received_at) FROM loop_debug",
    "v_timing": "SELECT DISTINCT * EXCLUDE (received_at) FROM frame_timing",
    "v_near": """SELECT * FROM (SELECT e.pose_id, e.sequence_id, e.ts, e.tx AS e_tx, e.ty AS e_ty, e.tz AS e_tz, e.qx AS e_qx, e.qy AS e_qy, e.qz AS e_qz, e.qw AS e_qw,
      g.pose_id AS match_id, g.tx AS g_tx, g.ty AS g_ty, g.tz AS g_tz, g.qx AS g_qx, g.qy AS g_qy, g.qz AS g_qz, g.qw AS g_qw,
      row_number() OVER (PARTITION BY e.pose_id ORDER BY abs(g.ts - e.ts), g.ts) AS k
      FROM v_est e JOIN v_gt g ON e.sequence_id = g.sequence_id AND g.ts BETWEEN e.ts - 0.021 AND e.ts + 0.021 WHERE abs(g.ts - e.ts) <= 0.02) WHERE k = 1""",
}
