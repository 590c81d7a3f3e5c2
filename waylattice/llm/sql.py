"""SQL with the same results as the queries of this subpackage, where SQL can say it."""

from ..plans.views import nan_safe

_P1 = """
WITH gt AS (
  SELECT sequence_id, ts, min(pose_id) AS pose_id FROM gt_poses
  WHERE sequence_id IS NOT NULL AND ts IS NOT NULL GROUP BY sequence_id, ts
), rec AS (
  SELECT DISTINCT 'pose' AS kind, pose_id AS record_id, sequence_id, ts FROM est_poses
  WHERE sequence_id IS NOT NULL AND ts IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'frame', entry_id, sequence_id, rgb_ts FROM associations
  WHERE sequence_id IS NOT NULL AND rgb_ts IS NOT NULL
), pairs AS (
  SELECT r.kind, r.record_id, g.pose_id AS gt_pose_id, g.ts AS gt_ts, abs(g.ts - r.ts) AS dt
  FROM rec r JOIN gt g ON r.sequence_id = g.sequence_id AND g.ts BETWEEN r.ts - 0.021 AND r.ts + 0.021
  WHERE abs(g.ts - r.ts) <= 0.02
), best AS (
  SELECT *, row_number() OVER (PARTITION BY kind, record_id ORDER BY dt, gt_ts, gt_pose_id) AS k FROM pairs
)
"""

_P2 = """
WITH once AS (
  SELECT current_kf_id, candidate_kf_id, max(candidate_score) AS candidate_score FROM loop_debug
  WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score) AND candidate_score >= 0
    AND current_kf_id IS NOT NULL AND candidate_kf_id IS NOT NULL
  GROUP BY current_kf_id, candidate_kf_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY current_kf_id ORDER BY candidate_score DESC, candidate_kf_id) AS INTEGER) AS rank FROM once
)
"""

_P5 = """
WITH once AS (
  SELECT run_id, frame_idx, min(run_day) AS run_day,
    min(CASE WHEN NOT isnan(slam_track_sec) AND slam_track_sec >= 0 THEN slam_track_sec END) AS slam_track_sec,
    min(CASE WHEN NOT isnan(frame_total_sec) AND frame_total_sec >= 0 THEN frame_total_sec END) AS frame_total_sec,
    min(CASE WHEN NOT isnan(rss_mb) AND rss_mb >= 0 THEN rss_mb END) AS rss_mb
  FROM frame_timing WHERE run_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY run_id, frame_idx
), vals AS (
  SELECT run_id, run_day, 'slam_track_sec' AS metric, slam_track_sec AS v FROM once WHERE slam_track_sec IS NOT NULL
  UNION ALL SELECT run_id, run_day, 'frame_total_sec', frame_total_sec FROM once WHERE frame_total_sec IS NOT NULL
  UNION ALL SELECT run_id, run_day, 'rss_mb', rss_mb FROM once WHERE rss_mb IS NOT NULL
), leveled AS (
  SELECT run_id, run_day, 'part' AS level, metric, v FROM vals
  UNION ALL SELECT run_id, CAST(NULL AS DATE), 'all', metric, v FROM vals
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, run_day, level, metric ORDER BY v) AS r,
    count(*) OVER (PARTITION BY run_id, run_day, level, metric) AS n FROM leveled
)
SELECT run_id, run_day, level, metric, p / 1000.0::DOUBLE AS p, n, v AS value
FROM ranked JOIN (VALUES (500), (900), (950), (990)) q(p) ON r = greatest(1, (n * p + 999) // 1000)
"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT kind, gt_pose_id, record_id FROM best WHERE k = 1",
    "p1_time_diff": _P1 + "SELECT kind, gt_pose_id, record_id, round(dt, 6) AS time_diff FROM best WHERE k = 1",
    "p2_found": _P2 + "SELECT candidate_kf_id, current_kf_id FROM ranked WHERE rank <= 5",
    "p2_ranked": _P2 + "SELECT current_kf_id, candidate_kf_id, candidate_score, rank FROM ranked WHERE rank <= 5",
    "p5_percentiles": _P5,
}

SQL = {k: nan_safe(v) for k, v in SQL.items()}
