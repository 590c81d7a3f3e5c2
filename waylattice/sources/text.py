"""Text formats of scans, trajectories, relations and clouds as DataFrames.

Lenient readers drop lines that don't parse; strict ones raise. Every reader is
one scan of the text with expressions; only files' small headers are read on
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geom import wrap_angle
from ..session import ship_package


def _tokens(spark: SparkSession, path: str, *, comments: bool = True) -> DataFrame:
    """(value, tok, line): split lines that are neither empty nor comments, with their order in the file."""
    ship_package(spark)
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(F.length("value") > 0)
    if comments:
        lines = lines.where(~F.col("value").startswith("#"))
    return lines.withColumn("tok", F.split("value", r"\s+"))


def _num(i: Column | int) -> Column:
    """Number at a token; null where it is missing or no number. Negative places count from the end."""
    at = F.lit(i + 1 if i >= 0 else i) if isinstance(i, int) else i + 1
    return F.try_element_at("tok", at.cast("int")).try_cast("double")


def _ranges(first: int, n: Column) -> Column:
    return F.transform(F.slice("tok", first + 1, n), lambda v: v.try_cast("double"))


def _triple(x: Column, y: Column, theta: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull() & theta.isNotNull(), F.struct(x.alias("x"), y.alias("y"), theta.alias("theta")))


def _complete(df: DataFrame) -> DataFrame:
    """Scans all of whose readings are numbers."""
    return df.where(F.col("t").isNotNull() & ~F.exists("ranges", lambda r: r.isNull())).orderBy("line").drop("line")


def read_carmen(spark: SparkSession, path: str, *, variant: str = "freiburg") -> DataFrame:
    """FLASER lines to (t, ranges, odom, laser_pose).

    'freiburg': laser pose first, odometry second, time third from the end;
    'intel': the first triple is odometry (and laser pose), time at token n + 8.
    """
    if variant not in ("freiburg", "intel"):
        raise ValueError("variant is 'freiburg' or 'intel'")
    n = F.try_element_at("tok", F.lit(2)).try_cast("int")
    extra = 6 if variant == "freiburg" else 7
    lines = _tokens(spark, path).where((F.col("tok")[0] == "FLASER") & (n >= 0)).where(F.size("tok") >= n + 2 + extra)
    one = _triple(*[_num(n + 2 + i) for i in range(3)])
    two = _triple(*[_num(n + 5 + i) for i in range(3)])
    if variant == "freiburg":
        out = lines.select("line", _num(-3).alias("t"), _ranges(2, n).alias("ranges"), two.alias("odom"), one.alias("laser_pose"))
    else:
        out = lines.select("line", _num(n + 8).alias("t"), _ranges(2, n).alias("ranges"), one.alias("odom"), one.alias("laser_pose"))
    return _complete(out.where("odom IS NOT NULL AND laser_pose IS NOT NULL"))


def read_lab_carmen(spark: SparkSession, path: str) -> DataFrame:
    """FLASER_MIN lines: time, number of readings, readings; no odometry."""
    n = F.try_element_at("tok", F.lit(3)).try_cast("int")
    lines = _tokens(spark, path).where((F.col("tok")[0] == "FLASER_MIN") & (n >= 0)).where(F.size("tok") >= n + 3)
    none = F.lit(None).cast("struct<x: double, y: double, theta: double>")
    return _complete(lines.select("line", _num(1).alias("t"), _ranges(3, n).alias("ranges"), none.alias("odom"), none.alias("laser_pose")))


IMU_COLUMNS = ["timestamp", "qx", "qy", "qz", "qw", "wx", "wy", "wz", "ax", "ay", "az"]


def read_imu_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inertial samples from CSV with a header, in any order of columns; rows with a value that is no number are dropped."""
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select(*[F.col(c).try_cast("double").alias(c) for c in IMU_COLUMNS], F.col("frame_id") if "frame_id" in raw.columns else F.lit("").alias("frame_id"))
    return typed.where(" AND ".join(f"{c} IS NOT NULL" for c in IMU_COLUMNS))


def read_stamped_list(spark: SparkSession, path: str) -> DataFrame:
    """Lists of stamped files (ts, path); comments and short lines are skipped."""
    return _tokens(spark, path).where(F.size("tok") >= 2).select(_num(0).alias("ts"), F.col("tok")[1].alias("path")).where("ts IS NOT NULL")


def read_associations(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Colour and depth pairs (rgb_ts, rgb, depth_ts, depth); three columns are (ts, rgb, depth). ``strict`` raises on fewer than four."""
    lines = _tokens(spark, path)
    short = F.size("tok") < (4 if strict else 3)
    if strict:
        lines = lines.withColumn("tok", F.when(short, F.raise_error(F.concat(F.lit("association line needs four columns: "), F.col("value")))).otherwise(F.col("tok")))
    else:
        lines = lines.where(~short)
    four = F.size("tok") >= 4
    out = lines.select(
        _num(0).alias("rgb_ts"), F.col("tok")[1].alias("rgb"), F.when(four, _num(2)).otherwise(_num(0)).alias("depth_ts"), F.when(four, F.try_element_at("tok", F.lit(4))).otherwise(F.col("tok")[2]).alias("depth"), "line",
    )
    return out.where("rgb_ts IS NOT NULL AND depth_ts IS NOT NULL").orderBy("line").drop("line")


POSE_COLUMNS = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def read_poses(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Trajectory of eight columns in order of time; a strict reader raises on lines that are not just that, a lenient one drops them."""
    lines = _tokens(spark, path)
    values = [_num(i) for i in range(8)]
    good = F.size("tok") >= 8 if not strict else F.size("tok") == 8
    for v in values:
        good = good & v.isNotNull()
    if strict:
        lines = lines.withColumn("tok", F.when(good, F.col("tok")).otherwise(F.raise_error(F.concat(F.lit("not a pose of eight numbers: "), F.col("value")))))
    else:
        lines = lines.where(good)
    return lines.select(*[v.alias(c) for v, c in zip(values, POSE_COLUMNS)]).orderBy("ts")


def read_local_trajectory(spark: SparkSession, path: str, *, min_score: float = 0.0) -> DataFrame:
    """t x y theta score lines with at least that score, angles wrapped."""
    out = _tokens(spark, path).where(F.size("tok") >= 5).select("line", *[_num(i).alias(c) for i, c in enumerate(("t", "x", "y", "theta", "score"))])
    return out.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND theta IS NOT NULL").where(F.col("score") >= min_score).withColumn("theta", wrap_angle(F.col("theta"))).orderBy("line").drop("line")


def read_pose_graph_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """x y theta lines; of four or more columns the first is a time and is skipped."""
    lines = _tokens(spark, path).where(F.size("tok") >= 3)
    four = F.size("tok") >= 4
    out = lines.select("line", *[F.when(four, _num(i + 1)).otherwise(_num(i)).alias(c) for i, c in enumerate(("x", "y", "theta"))])
    return out.where("x IS NOT NULL AND y IS NOT NULL AND theta IS NOT NULL").orderBy("line").drop("line")


def read_relations(spark: SparkSession, path: str, *, angle: str = "column7") -> DataFrame:
    """Relations t_i t_j dx dy ... dtheta.

    'column7': the angle is column 7 of lines of just eight columns, else column
    4; 'last': it is the last column.
    """
    if angle not in ("column7", "last"):
        raise ValueError("angle is 'column7' or 'last'")
    theta = _num(-1) if angle == "last" else F.when(F.size("tok") == 8, _num(7)).otherwise(_num(4))
    out = _tokens(spark, path).where(F.size("tok") >= 5).select("line", *[_num(i).alias(c) for i, c in enumerate(("t_i", "t_j", "dx", "dy"))], theta.alias("dtheta"))
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in ("t_i", "t_j", "dx", "dy", "dtheta"))).orderBy("line").drop("line")


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The ``# key=value`` lines of a file."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^#\s*[\w.]+\s*=")).select(
        F.regexp_extract("value", r"^#\s*([\w.]+)\s*=", 1).alias("k"), F.trim(F.regexp_extract("value", r"=(.*)$", 1)).alias("v")
    )
    return {r["k"]: r["v"] for r in rows.dropDuplicates(["k"]).collect()}  # one row per key


def read_ply(spark: SparkSession, path: str, *, most: int | None = None) -> DataFrame:
    """Points of ASCII PLY files (x, y, z and further columns by the names of each file's own header); above ``most`` points every n-th.

    Files of one folder may differ in their columns; a column that a file lacks is null.
    """
    from ..operators.blocks import ranked

    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_path").alias("file"))
    marks = lines.where(F.trim("value") == "end_header").groupBy("file").agg(F.min("line").alias("end"))
    # headers only: a few lines per file
    head = lines.join(F.broadcast(marks), "file").where("line <= end").orderBy("file", "line").collect()
    columns: dict[str, list[str]] = {}
    count, inside = 0, False
    for r in head:
        t = r["value"].split()
        if t[:1] == ["element"]:
            inside = t[1:2] == ["vertex"]
            count += int(t[2]) if inside else 0
        elif t[:1] == ["property"] and inside:
            columns.setdefault(r["file"], []).append(t[-1])
    names = list(dict.fromkeys(c for cs in columns.values() for c in cs))
    places = spark.createDataFrame([(f, {c: i + 1 for i, c in enumerate(cs)}, len(cs)) for f, cs in columns.items()], "file STRING, at MAP<STRING, INT>, width INT")
    body = lines.join(F.broadcast(marks), "file").where("line > end").join(F.broadcast(places), "file").withColumn("tok", F.split(F.trim("value"), r"\s+"))
    points = body.where(F.size("tok") >= F.col("width")).select("line", *[F.try_element_at("tok", F.try_element_at("at", F.lit(c))).try_cast("double").alias(c) for c in names])
    points = points.where(F.col(names[0]).isNotNull()) if names else points
    if most and count > most:
        points = ranked(points.withColumn("cloud", F.lit(0)), "cloud", ["line"], "n").where(F.col("n") % -(-count // most) == 0).drop("n", "cloud")
    return points.drop("line")


def parse_bool(c: Column) -> Column:
    """True of true-like texts; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def parse_int(c: Column) -> Column:
    """Whole number of a text, through a number with a point if need be; null if it is none."""
    return F.trim(c).try_cast("double").try_cast("bigint")


def parse_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def parse_int_list(c: Column) -> Column:
    """Whole numbers of a cell like ``[1, 2]`` or ``1;2``; an empty or null cell has none."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]\s]", ""), "[,;|]")
    return F.filter(F.transform(parts, lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())


def read_typed_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """CSV with a header and typed columns ('bool', 'int', 'float', 'ints', 'string'); cells that don't parse are null, missing columns too."""
    raw = spark.read.option("header", True).csv(path)
    make = {"bool": parse_bool, "int": parse_int, "float": parse_float, "ints": parse_int_list, "string": lambda c: c}
    return raw.select(*[make[t](F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c, t in types.items()])


def read_keyframes_json(spark: SparkSession, path: str) -> DataFrame:
    """Keyframes from a JSON list (or an object with the list under ``keyframes``): kf_id, ts, pose (sixteen numbers by rows)."""
    raw = spark.read.option("multiLine", True).json(path)
    if "keyframes" in raw.columns:
        raw = raw.select(F.explode("keyframes").alias("k")).select("k.*")
    ids = [c for c in ("kf_id", "kid", "id") if c in raw.columns]
    times = [c for c in ("timestamp", "ts") if c in raw.columns]
    poses = [c for c in ("pose", "Twc", "T_wc") if c in raw.columns]
    pose = F.col(poses[0]) if poses else F.lit(None).cast("array<double>")
    if poses and dict(raw.dtypes)[poses[0]].startswith("array<array"):
        pose = F.flatten(pose)
    return raw.select(F.col(ids[0]).cast("bigint").alias("kf_id"), F.col(times[0]).cast("double").alias("ts"), pose.cast("array<double>").alias("pose"))


def keyframes_from_log(log: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """Keyframes of a run log that lacks a list of them: the rows whose keyframe count rises, numbered from 0."""
    from ..operators.telemetry import new_highs

    from ..operators.blocks import ranked

    return ranked(new_highs(log, by, order, counter), by, [order], "kf_id")


def best_per_pair(rows: DataFrame, keys: list[str], *ranking: Column) -> DataFrame:
    """Of several records of a pair the one with the greatest ranking."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(r) for r in ranking]))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def read_inserted_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Debug table of a local run to its inserted nodes (scan_idx, node_id, pose): columns 0 scan, 2 to 4 pose, 11 inserted, 19 nodes so far; the first three lines are a header."""
    lines = _tokens(spark, path).where(F.size("tok") >= 20)
    out = lines.select(_num(0).cast("bigint").alias("scan_idx"), (_num(19).cast("bigint") - 1).alias("node_id"), _triple(_num(2), _num(3), _num(4)).alias("pose"), _num(11).alias("inserted"))
    return out.where("inserted = 1 AND scan_idx IS NOT NULL AND node_id IS NOT NULL AND pose IS NOT NULL").drop("inserted")


def read_optimised_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node x y theta lines to (node_id, pose); of a node named twice the last line counts."""
    out = _tokens(spark, path).where(F.size("tok") >= 4).select(_num(0).cast("bigint").alias("node_id"), _triple(_num(1), _num(2), _num(3)).alias("pose"), "line").where("node_id IS NOT NULL AND pose IS NOT NULL")
    return out.groupBy("node_id").agg(F.max_by("pose", "line").alias("pose"))


def common_samples(scans: DataFrame, inserted: DataFrame, optimised: DataFrame) -> DataFrame:
    """Scans (scan_idx, ...) that were inserted as nodes and optimised: adds node_id, pose_local and pose_optimised."""
    nodes = inserted.withColumnRenamed("pose", "pose_local").join(optimised.withColumnRenamed("pose", "pose_optimised"), "node_id")
    return scans.join(nodes, "scan_idx")


def read_full_trajectory(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """t x y theta [score] lines to (t, x, y, theta, score): score 0 where the column is missing, rows of negative score dropped, angles wrapped.

    ``strict`` raises on lines of less than five columns.
    """
    lines = _tokens(spark, path)
    if strict:
        lines = lines.withColumn("tok", F.when(F.size("tok") < 5, F.raise_error(F.concat(F.lit("trajectory line needs five columns: "), F.col("value")))).otherwise(F.col("tok")))
    out = lines.where(F.size("tok") >= 4).select("line", *[_num(i).alias(c) for i, c in enumerate(("t", "x", "y", "theta"))], F.coalesce(_num(4), F.lit(0.0)).alias("score"))
    out = out.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND theta IS NOT NULL AND score >= 0")
    return out.withColumn("theta", wrap_angle(F.col("theta"))).orderBy("line").drop("line")


def read_stamps(spark: SparkSession, path: str) -> DataFrame:
    """Times, one to a line, with their place in the file: (index, t)."""
    from ..operators.blocks import ranked

    t = _tokens(spark, path).select("line", _num(0).alias("t"), F.lit(0).alias("all")).where("t IS NOT NULL")
    return ranked(t, "all", ["line"], "index").select("index", "t")


def associate_streams(rgb: DataFrame, depth: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Associations of two stamped lists (ts, path) where no file gives them: nearest in time, one to one, first come first served."""
    from ..operators.asof import asof_first_come

    one = lambda df, n: df.where("ts IS NOT NULL").groupBy(F.col("ts").alias(f"{n}_ts")).agg(F.min("path").alias(n)).withColumn("all", F.lit(0))
    a, b = one(rgb, "rgb"), one(depth, "depth")
    met = asof_first_come(a, b, "all", "rgb_ts", "rgb", "depth_ts", "depth", tolerance=tolerance)
    return met.select("rgb_ts", "rgb", F.col("match_ts").alias("depth_ts"), F.col("match_id").alias("depth"))


def newest(folder: str, pattern: str) -> str | None:
    """The file of a folder that was written last, of those that fit a pattern; of equally old ones the last by name."""
    from pathlib import Path

    files = sorted(Path(folder).glob(pattern), key=lambda p: (p.stat().st_mtime, p.name))
    return str(files[-1]) if files else None


# --- fixed values: columns of the loop logs' files, as they are written ----------------------------------------
LOG_TABLES = {
    "oracle": {"current_kf_id": "int", "candidate_kf_id": "int", "accepted": "bool", "rejection_stage": "string", "rejection_reason": "string", "candidate_source": "string", "bow_score": "float", "common_words": "int", "seed_inliers": "int", "refined_inliers": "int", "guided_projection_matches": "int", "final_matched_map_points": "int"},
    "profile": {"current_kf_id": "int", "num_raw_dbow_candidates": "int", "num_raw_inverted_candidates": "int", "num_candidates_after_temporal_filter": "int", "num_candidates_after_min_score": "int", "top_candidate_id": "int", "top_candidate_score": "float"},
    "source": {"current_kf_id": "int", "candidate_source": "string", "dbow3_candidates": "ints", "inverted_candidates": "ints", "chosen_candidates": "ints"},
    "density": {"current_kf_id": "int", "candidate_kf_id": "int", "candidate_group_size": "int", "current_local_map_points": "int", "candidate_local_map_points": "int", "final_matched_map_points": "int"},
}
# ---------------------------------------------------------------------------------------------------------------


def read_log_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the loop logs (LOG_TABLES), each key once: by pair_key the accepted record of most matches, by keyframe the last line."""
    rows = read_typed_csv(spark, path, LOG_TABLES[kind]).where("current_kf_id IS NOT NULL")
    if kind in ("oracle", "density"):
        pair = F.concat_ws("-", F.least("current_kf_id", "candidate_kf_id").cast("string"), F.greatest("current_kf_id", "candidate_kf_id").cast("string"))
        keyed = rows.where("candidate_kf_id IS NOT NULL").withColumn("pair_key", pair)
        first = F.col("accepted").cast("int") if kind == "oracle" else F.lit(0)
        return best_per_pair(keyed, ["pair_key"], first, F.col("final_matched_map_points"), F.monotonically_increasing_id())
    return best_per_pair(rows, ["current_kf_id"], F.monotonically_increasing_id())
