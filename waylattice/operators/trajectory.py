"""Trajectory errors, motion and alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..session import cut
from .bisect import exact_percentiles, meet
from .blocks import in_blocks, own, window


def error_summary(df: DataFrame, by: list[str], error: str, prefix: str = "") -> DataFrame:
    """Count, RMSE, mean, median and greatest error per group."""
    e = F.col("_e")
    errors = cut(df.select(*by, F.col(error).cast("double").alias("_e")).where(e.isNotNull() & ~F.isnan(e)))
    sums = errors.groupBy(*by).agg(F.count("*").alias(f"{prefix}n"), F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"), F.avg(e).alias(f"{prefix}mean"), F.max(e).alias(f"{prefix}max"))
    median = exact_percentiles(errors, by, ["_e"], {"median": 0.5}).withColumnRenamed("median__e", f"{prefix}median")
    return meet(sums, median, by)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def step_lengths(poses: DataFrame, by: str, order: list[str], position: list[str], lag: int = 1) -> DataFrame:
    """Adds ``step``: distance from the pose ``lag`` rows before; null for the first ones."""
    w = window(by)
    cut_up = in_blocks(poses, by, order, before=lag)
    return own(cut_up.withColumn("step", distance([F.col(c) for c in position], [F.lag(c, lag).over(w) for c in position])))


def path_length(poses: DataFrame, by: str, order: list[str], position: list[str]) -> DataFrame:
    return step_lengths(poses, by, order, position).groupBy(by).agg(F.count("*").alias("poses"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def relative_errors_2d(pairs: DataFrame, by: str, order: list[str], delta: int = 1) -> DataFrame:
    """Errors of relative motion over ``delta`` rows: pairs with structs ``est`` and ``gt`` (x, y, theta) to (trans_error, rot_error_deg)."""
    w = window(by)
    later = own(in_blocks(pairs, by, order, after=delta).withColumns({"est2": F.lead("est", delta).over(w), "gt2": F.lead("gt", delta).over(w)})).where("est2 IS NOT NULL")
    off = geom.se2_between(geom.se2_between(F.col("gt"), F.col("gt2")), geom.se2_between(F.col("est"), F.col("est2")))
    return later.withColumn("off", off).withColumns({"trans_error": F.hypot("off.x", "off.y"), "rot_error_deg": F.degrees(F.abs(F.col("off.theta")))}).drop("est2", "gt2", "off")


def relative_errors_3d(pairs: DataFrame, by: str, order: list[str], delta: int = 1) -> DataFrame:
    """The same in space: pairs with positions and quaternions e_tx .. e_qw and g_tx .. g_qw."""
    w = window(by)
    unit = pairs
    for p in "eg":
        q = [F.col(f"{p}_{c}") for c in ("qx", "qy", "qz", "qw")]
        n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        unit = unit.withColumns({f"{p}_{i}": c / n for i, c in enumerate(q)})
    # the window keeps the scaled quaternions apart from what is made of them
    names = [f"{p}_{c}" for p in "eg" for c in ("tx", "ty", "tz", "0", "1", "2", "3")]
    later = own(in_blocks(unit, by, order, after=delta).withColumns({c + "n": F.lead(c, delta).over(w) for c in names})).where("e_txn IS NOT NULL")
    for p in "eg":
        q, q2 = ([F.col(f"{p}_{i}{n}") for i in range(4)] for n in ("", "n"))
        step = [F.col(f"{p}_t{c}n") - F.col(f"{p}_t{c}") for c in "xyz"]
        later = later.withColumns({**{f"{p}_s{i}": c for i, c in enumerate(geom.quaternion_rotate_back(q, step))}, **{f"{p}_r{i}": c for i, c in enumerate(geom.quaternion_product(geom.conjugate(q), q2))}})
    off = geom.quaternion_product(geom.conjugate([F.col(f"g_r{i}") for i in range(4)]), [F.col(f"e_r{i}") for i in range(4)])
    move = distance([F.col(f"e_s{i}") for i in range(3)], [F.col(f"g_s{i}") for i in range(3)])
    angle = F.degrees(2.0 * F.atan2(F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]), F.abs(off[3])))
    return later.select(*pairs.columns, move.alias("trans_error"), angle.alias("rot_error_deg"))


def motion_stability_2d(poses: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Second differences of motion: ``jerk`` of the step between poses and ``turn_deg`` of its rotation, with struct ``pose``."""
    w = window(by)
    moved = in_blocks(poses, by, order, before=2).withColumn("move", geom.se2_between(F.lag("pose", 1).over(w), F.col("pose")))
    moved = own(moved.withColumn("last_move", F.lag("move", 1).over(w))).where("last_move.x IS NOT NULL")
    off = geom.se2_between(F.col("last_move"), F.col("move"))
    return moved.withColumn("off", off).withColumns({"jerk": F.hypot("off.x", "off.y"), "turn_deg": F.degrees(F.abs(F.col("off.theta")))}).drop("move", "last_move", "off")


def velocity(poses: DataFrame, by: str, ts: str, position: list[str], seconds: float = 1.5, chunk_seconds: float = 512.0) -> DataFrame:
    """Velocity from the oldest pose of the last ``seconds`` to the present one; null if no time lies between them.

    Windows are chunks of time that also hold the poses of the last ``seconds`` before them.
    """
    cell = lambda c: F.floor(c / F.lit(chunk_seconds))
    t = F.col(ts)
    chunked = poses.withColumn("_chunk", F.explode(F.sequence(cell(t), cell(t + F.lit(float(seconds)))))).withColumn("_own", F.col("_chunk") == cell(t))
    frame = f"OVER (PARTITION BY `{by}`, _chunk ORDER BY `{ts}` RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"
    dt = F.expr(f"`{ts}` - min(`{ts}`) {frame}")
    return chunked.withColumns({f"v_{c}": F.when(dt > 0, F.expr(f"`{c}` - first(`{c}`) {frame}") / dt) for c in position}).where("_own").drop("_chunk", "_own")


def alignment_moments(pairs: DataFrame, by: list[str], source: list[str], target: list[str]) -> DataFrame:
    """Count, means, covariance (target by source, nine columns c00..c22) and source variance per group, in one aggregation."""
    s, t = [F.col(c) for c in source], [F.col(c) for c in target]
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"s{i}") for i, c in enumerate(s)], *[F.avg(c).alias(f"t{i}") for i, c in enumerate(t)],
        *[F.covar_pop(t[i], s[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)], sum((F.var_pop(c) for c in s[1:]), F.var_pop(s[0])).alias("spread"),
    )


def solve_alignment(row: dict, with_scale: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and scale that take source to target best, from one row of ``alignment_moments``."""
    if row["n"] < 3:
        raise ValueError("alignment needs at least three pairs")
    c = np.array([[row[f"c{i}{j}"] for j in range(3)] for i in range(3)])
    u, d, vt = np.linalg.svd(c)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ sign @ vt
    scale = float(np.trace(np.diag(d) @ sign) / row["spread"]) if with_scale and row["spread"] > 0 else 1.0
    t = np.array([row[f"t{i}"] for i in range(3)]) - scale * r @ np.array([row[f"s{i}"] for i in range(3)])
    return r, t, scale


def align(pairs: DataFrame, by: list[str], source: list[str], target: list[str], *, with_scale: bool = False) -> DataFrame:
    """Adds ``aligned`` (array of three) and ``error``: each source position moved by its group's best rigid or similarity transform.

    The moments are one distributed aggregation; the three-by-three solve runs
    once per group, in Arrow batches. Groups of under three pairs are left out.
    """
    fields = "r ARRAY<DOUBLE>, t ARRAY<DOUBLE>, scale DOUBLE"
    pairs = cut(pairs)  # read twice

    @F.pandas_udf(fields)
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = [solve_alignment(r, with_scale) for r in rows.to_dict("records")]
        return pd.DataFrame({"r": [x[0].ravel().tolist() for x in out], "t": [x[1].tolist() for x in out], "scale": [x[2] for x in out]})

    moments = alignment_moments(pairs, by, source, target).where("n >= 3")
    names = [c for c in moments.columns if c not in by]
    solved = moments.select(*by, solve(F.struct(*names)).alias("m"))
    moved = geom.se3_apply(F.col("m"), [F.col(c) for c in source], F.col("m.scale"))
    out = pairs.join(solved, by).withColumn("aligned", F.array(*moved)).drop("m")
    return out.withColumn("error", distance([F.col("aligned")[i] for i in range(3)], [F.col(c) for c in target]))


def relation_errors(relations: DataFrame, poses: DataFrame, by: str, *, max_dt: float | None = None, convention: str = "ij") -> DataFrame:
    """Errors of an estimated trajectory against given relations (by, t_i, t_j, dx, dy, dtheta).

    Both ends take the nearest pose in time (earlier on a tie); relations whose
    ends are further than ``max_dt`` are left out. ``poses``: by, pose_id, ts,
    pose (x, y, theta). 'ij' measures j from i, 'ji' i from j, 'inverse' the
    inverse of 'ij'.
    """
    from .asof import asof_nearest

    seen = relations
    for end in "ij":
        seen = asof_nearest(seen, poses, by, f"t_{end}", "ts", "pose_id", tolerance=max_dt, how="inner", carry=["pose"])
        seen = seen.withColumnsRenamed({"match_id": f"{end}_id", "match_ts": f"{end}_ts", "dt": f"dt_{end}", "match_pose": f"pose_{end}"})
    ij = geom.se2_between(F.col("pose_i"), F.col("pose_j"))
    got = {"ij": ij, "ji": geom.se2_between(F.col("pose_j"), F.col("pose_i")), "inverse": geom.se2_inverse(ij)}[convention]
    return seen.withColumn("got", got).withColumns({
        "trans_error": F.hypot(F.col("got.x") - F.col("dx"), F.col("got.y") - F.col("dy")), "rot_error": F.abs(geom.wrap_angle(F.col("got.theta") - F.col("dtheta"))),
    }).drop("got", "pose_i", "pose_j")


def correct_by_keyframes(poses: DataFrame, corrections: DataFrame, by: str) -> DataFrame:
    """Dense correction: each pose takes the correction (struct of x, y, theta) of the last keyframe at or before it; the identity before the first."""
    from .asof import asof_backward

    met = asof_backward(poses, corrections, by, "ts", "ts", "node_id", carry=["delta"]).withColumnRenamed("match_delta", "delta")
    still = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("theta"))
    return met.withColumn("corrected", geom.se2_compose(F.coalesce("delta", still), F.col("pose"))).drop("delta", "match_ts", "dt")


def relation_closures(relations: DataFrame, poses: DataFrame, by: str, *, max_dt: float, least_gap: int) -> DataFrame:
    """Loop closures from relations (by, rel_id, t_i, t_j, dx, dy, dtheta): indices of the nearest poses, i < j, the relation turned round where need be.

    ``poses``: by, ts, index (its place in the trajectory). Relations that reach
    beyond the trajectory, whose ends are further than ``max_dt`` from a pose, or
    that join poses less than ``least_gap`` places apart are left out.
    Returns (by, rel_id, i, j, dx, dy, dtheta).
    """
    from .asof import asof_nearest

    span = poses.groupBy(by).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    inside = relations.join(span, by).where(F.col("t_i").between(F.col("_from"), F.col("_to")) & F.col("t_j").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    for end in ("i", "j"):
        inside = asof_nearest(inside, poses, by, f"t_{end}", "ts", "index", tolerance=max_dt, how="inner").withColumnRenamed("match_id", end).drop("match_ts", "dt")
    far = inside.where(F.abs(F.col("i") - F.col("j")) >= max(int(least_gap), 1))
    z = geom.se2(F.col("dx"), F.col("dy"), F.col("dtheta"))
    z = F.when(F.col("i") > F.col("j"), geom.se2_inverse(z)).otherwise(geom.se2(F.col("dx"), F.col("dy"), geom.wrap_angle(F.col("dtheta"))))
    out = far.withColumn("z", z)
    return out.select(by, "rel_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("z.x").alias("dx"), F.col("z.y").alias("dy"), F.col("z.theta").alias("dtheta"))


def relation_overlap(relations: DataFrame, times: DataFrame, by: str, ts: str) -> DataFrame:
    """Per entity the relations, their time span, and half the number (rounded down) of their ends within the span of ``times``."""
    span = times.groupBy(by).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    ends = relations.select(by, F.explode(F.array("t_i", "t_j")).alias("t")).where("t IS NOT NULL AND NOT isnan(t)").join(span, by, "left")
    n = ends.groupBy(by).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("t").between(F.col("_from"), F.col("_to"))).alias("k"))
    return n.select(by, F.expr("n div 2").alias("relations"), "first", "last", F.expr("k div 2").alias("overlapping"))


def translation_steps(pairs: DataFrame, by: str, order: list[str], estimate: list[str], truth: list[str]) -> DataFrame:
    """Relative error of positions alone over consecutive pairs: adds ``trans_error`` (length of the difference of the steps); a rotation error isn't known."""
    w = window(by)
    names = [*estimate, *truth]
    later = own(in_blocks(pairs, by, order, before=1).withColumns({f"_{c}": F.lag(c).over(w) for c in names})).where(F.col(f"_{names[0]}").isNotNull())
    step = [(F.col(e) - F.col(f"_{e}")) - (F.col(g) - F.col(f"_{g}")) for e, g in zip(estimate, truth)]
    length = F.sqrt(sum((s * s for s in step[1:]), step[0] * step[0]))
    return later.withColumn("trans_error", length).drop(*[f"_{c}" for c in names])


def predict_by_odometry(poses: DataFrame, by: str, order: list[str], odom: str, pose: str) -> DataFrame:
    """Adds ``predicted``: the pose of the row before moved by what the odometry moved since; null for the first row and where one is missing."""
    w = window(by)
    last = in_blocks(poses, by, order, before=1).withColumns({"_o": F.lag(odom).over(w), "_p": F.lag(pose).over(w)})
    moved = geom.se2_compose(F.col("_p"), geom.se2_between(F.col("_o"), F.col(odom)))
    known = F.col("_p.x").isNotNull() & F.col("_o.x").isNotNull() & F.col(f"{odom}.x").isNotNull()
    return own(last.withColumn("predicted", F.when(known, moved))).drop("_o", "_p")


def walk_to_kept(frames: DataFrame, parents: DataFrame, culled: DataFrame, hops: int = 10) -> DataFrame:
    """Pose of each frame against the nearest kept keyframe, over the parents of culled ones.

    ``frames``: frame, kf, rel (planar pose of the frame in its keyframe);
    ``parents``: kf, parent, rel (pose of kf in its parent); ``culled``: kf. After
    ``hops`` steps, or where there is no parent, a frame that is still at a culled
    keyframe is left out. Returns (frame, kf, rel, hops).
    """
    gone = culled.select("kf").distinct().withColumn("_gone", F.lit(True))
    up = parents.select("kf", "parent", F.col("rel").alias("_step"))
    at = frames.select("frame", "kf", "rel").withColumn("hops", F.lit(0)).join(gone, "kf", "left")
    done = [at.where("_gone IS NULL")]
    left = at.where("_gone")
    for n in range(1, hops + 1):
        moved = left.drop("_gone").join(up, "kf").select("frame", F.col("parent").alias("kf"), geom.se2_compose(F.col("_step"), F.col("rel")).alias("rel"), F.lit(n).alias("hops"))
        left = moved.join(gone, "kf", "left")
        done.append(left.where("_gone IS NULL"))
        left = left.where("_gone")
    out = done[0].select("frame", "kf", "rel", "hops")
    for x in done[1:]:
        out = out.unionByName(x.select("frame", "kf", "rel", "hops"))
    return out


def extrapolate(
    rows: DataFrame, by: str, order: list[str], *, seconds: float = 1.5, cap: float = 0.5, blend: float = 0.0, gyro: str | None = None, yaw: str | None = None, alpha: float = 0.0,
    most_speed: float = 1e9, most_turn: float = 1e9,
) -> DataFrame:
    """Adds ``predicted``: each pose as foreseen from the rows before it; null for the first.

    ``rows``: by, t, pose and odom (planar structs, odom may be null). The velocity
    is that of the last ``seconds`` up to the row before (0 if no time lies between
    them), that of the odometry having the share ``blend`` where it is known,
    clipped to ``most_speed`` and ``most_turn``; the step is at most ``cap`` seconds
    long. With ``gyro`` the turn rate of the row before is used instead; with
    ``yaw`` the heading goes the share ``alpha`` of the way to that absolute
    heading, whose offset is that of the entity's first row with one.
    """
    flat = rows.withColumns({**{f"_p{c}": F.col(f"pose.{f}") for c, f in (("x", "x"), ("y", "y"), ("h", "theta"))}, **{f"_o{c}": F.col(f"odom.{f}") for c, f in (("x", "x"), ("y", "y"), ("h", "theta"))}})
    cell = lambda c: F.floor(c / F.lit(512.0))
    t = F.col("t")
    chunked = flat.withColumn("_chunk", F.explode(F.sequence(cell(t), cell(t + F.lit(float(seconds)))))).withColumn("_mine", F.col("_chunk") == cell(t))
    frame = f"OVER (PARTITION BY `{by}`, _chunk ORDER BY t RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"
    rate = {}
    for s in "po":
        known = f"CASE WHEN _{s}x IS NOT NULL AND _{s}y IS NOT NULL AND _{s}h IS NOT NULL THEN struct(t, _{s}x AS x, _{s}y AS y, _{s}h AS h) END"
        first, last = f"min({known}) {frame}", f"max({known}) {frame}"
        rate |= {f"_{s}a": F.expr(first), f"_{s}b": F.expr(last)}
    seen = chunked.withColumns(rate).where("_mine").drop("_chunk", "_mine")

    def velocity_of(s: str, c: str) -> Column:
        dt = F.col(f"_{s}b.t") - F.col(f"_{s}a.t")
        d = F.col(f"_{s}b.{c}") - F.col(f"_{s}a.{c}")
        return F.when(dt > 0, (geom.wrap_angle(d) if c == "h" else d) / dt)

    speed = {}
    for c, most in (("x", most_speed), ("y", most_speed), ("h", most_turn)):
        own_v, odom_v = F.coalesce(velocity_of("p", c), F.lit(0.0)), velocity_of("o", c)
        v = F.when(odom_v.isNotNull(), (1 - blend) * own_v + blend * odom_v).otherwise(own_v) if blend else own_v
        if c == "h" and gyro is not None:
            v = F.coalesce(F.col(gyro), v)
        speed[f"_v{c}"] = F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), v))
    held = seen.withColumns(speed).withColumn("_last", F.struct("t", F.col("_px").alias("x"), F.col("_py").alias("y"), F.col("_ph").alias("h"), "_vx", "_vy", "_vh"))
    w = window(by)
    met = own(in_blocks(held, by, order, before=1).withColumn("_was", F.lag("_last").over(w)))
    dt = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), t - F.col("_was.t")))
    heading = geom.wrap_angle(F.col("_was.h") + F.col("_was._vh") * dt)
    if yaw is not None and alpha > 0:
        first = rows.where(F.col(yaw).isNotNull() & F.col("pose.theta").isNotNull()).groupBy(by).agg(F.min_by(F.col("pose.theta") - F.col(yaw), F.struct(*order)).alias("_offset"))
        met = met.join(first, by, "left")
        aim = geom.wrap_angle(F.col(yaw) + F.col("_offset"))
        heading = F.coalesce(geom.wrap_angle(heading + alpha * geom.wrap_angle(aim - heading)), heading)
    predicted = F.when(F.col("_was.x").isNotNull(), geom.se2(F.col("_was.x") + F.col("_was._vx") * dt, F.col("_was.y") + F.col("_was._vy") * dt, heading))
    return met.select(*rows.columns, predicted.alias("predicted"))
