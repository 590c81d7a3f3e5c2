"""Queries on sensor readings: implausible values and regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regular_grid import regular_grid
from ..operators.spikes import implausible_readings
from ..sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "scans"), table(spark, d, "datasets")).select("scan_id", "beam").distinct()


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "scans"), table(spark, d, "datasets"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    poses = []
    for name in ("gt_poses", "est_poses"):
        usable = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("ts", "tx", "ty", "tz"))
        poses.append(table(spark, d, name).where(usable).select(
            F.lit(name).alias("stream"), F.col("sequence_id").alias("source"), F.col("pose_id").alias("key"), "ts",
            F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"),
        ))
    # a scan's value is the mean of its finite readings, unknown if it has none
    finite = F.filter("ranges", lambda r: r.isNotNull() & ~F.isnan(r) & (F.abs(r) < 1e300))
    mean = F.try_divide(F.aggregate(finite, F.lit(0.0), lambda a, r: a + r), F.size(finite))
    scans = table(spark, d, "scans").where("t IS NOT NULL AND size(ranges) > 0").select(
        F.lit("scans").alias("stream"), F.col("sensor_id").alias("source"), F.col("scan_id").alias("key"), F.col("t").alias("ts"),
        mean.alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("z"),
    )
    return poses[0].unionByName(poses[1]).unionByName(scans)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(_readings(spark, d)).where("state <> 'observed'").select("stream", F.col("source").alias("source_id"), "slot")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(_readings(spark, d))


def p4_slots(spark: SparkSession, d: str) -> DataFrame:
    """The part of the grid that SQL can check in full: slots, counts and means of observed ones."""
    seen = F.col("readings") > 0
    return regular_grid(_readings(spark, d)).select(
        "stream", F.col("source").alias("source_id"), "slot", "readings", seen.alias("observed"), F.when(seen, F.round("x", 9)).alias("x"),
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p4_found, p4_grid, p4_slots)}

_P3 = """
WITH once AS (
  SELECT DISTINCT ON (s.scan_id) s.scan_id, s.sensor_id, s.t, s.ranges, d.range_min, d.range_max
  FROM scans s JOIN datasets d ON s.dataset = d.name WHERE s.t IS NOT NULL AND len(s.ranges) > 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t, scan_id) AS k FROM once
), reads AS (
  SELECT scan_id, sensor_id, k, range_min, range_max, unnest(ranges) AS r, generate_subscripts(ranges, 1) - 1 AS beam FROM ordered
), bad AS (
  SELECT scan_id, CAST(beam AS INTEGER) AS beam, 'impossible' AS reason FROM reads
  WHERE r IS NOT NULL AND r <> range_max AND (isnan(r) OR isinf(r) OR r < range_min OR r > range_max)
), islands AS (
  SELECT *, k - row_number() OVER (PARTITION BY sensor_id, beam, r ORDER BY k) AS island FROM reads WHERE r IS NOT NULL AND NOT isnan(r) AND NOT isinf(r)
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY sensor_id, beam, r, island) AS n FROM islands
)
"""

_P4 = """
WITH usable AS (
  SELECT DISTINCT 'gt_poses' AS stream, sequence_id AS source_id, pose_id AS key, CAST(floor(ts) AS BIGINT) AS slot, tx AS x FROM gt_poses
  WHERE sequence_id IS NOT NULL AND ts IS NOT NULL AND NOT isnan(tx) AND NOT isnan(ty) AND NOT isnan(tz)
  UNION ALL
  SELECT DISTINCT 'est_poses', sequence_id, pose_id, CAST(floor(ts) AS BIGINT), tx FROM est_poses
  WHERE sequence_id IS NOT NULL AND ts IS NOT NULL AND NOT isnan(tx) AND NOT isnan(ty) AND NOT isnan(tz)
  UNION ALL
  SELECT DISTINCT 'scans', sensor_id, scan_id, CAST(floor(t) AS BIGINT), list_avg(list_filter(ranges, lambda r: r IS NOT NULL AND NOT isnan(r) AND NOT isinf(r)))
  FROM scans WHERE sensor_id IS NOT NULL AND t IS NOT NULL AND len(ranges) > 0
), slots AS (
  SELECT stream, source_id, slot, count(*) AS readings, avg(x) AS x FROM usable GROUP BY ALL
), spans AS (
  SELECT stream, source_id, min(slot) AS lo, max(slot) AS hi FROM slots GROUP BY ALL
), grid AS (
  SELECT stream, source_id, unnest(generate_series(lo, hi)) AS slot FROM spans
)
"""

SQL = {
    "p4_found": _P4 + "SELECT g.stream, g.source_id, g.slot FROM grid g LEFT JOIN slots s USING (stream, source_id, slot) WHERE s.readings IS NULL",
    "p4_slots": _P4 + "SELECT g.stream, g.source_id, g.slot, coalesce(s.readings, 0) AS readings, s.readings IS NOT NULL AS observed, round(s.x, 9) AS x FROM grid g LEFT JOIN slots s USING (stream, source_id, slot)",
}
SQL["p3_limits_runs"] = _P3 + "SELECT scan_id, beam, reason FROM bad UNION ALL SELECT scan_id, CAST(beam AS INTEGER), 'stuck' FROM runs WHERE n >= 8 AND r <> range_max"


def p3_limits_runs(spark: SparkSession, d: str) -> DataFrame:
    """The two kinds of implausible reading that SQL can say."""
    return p3_reasons(spark, d).where("reason <> 'spike'").select("scan_id", "beam", "reason")


QUERIES["p3_limits_runs"] = p3_limits_runs
