"""Planar and spatial geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap_angle(a: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(a + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def se2(x, y, theta) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), theta.alias("theta"))


def se2_compose(a: Column, b: Column) -> Column:
    """a then b, b given in the frame of a."""
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(a["x"] + c * b["x"] - s * b["y"], a["y"] + s * b["x"] + c * b["y"], wrap_angle(a["theta"] + b["theta"]))


def se2_inverse(a: Column) -> Column:
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(-c * a["x"] - s * a["y"], s * a["x"] - c * a["y"], wrap_angle(-a["theta"]))


def se2_between(a: Column, b: Column) -> Column:
    """b in the frame of a."""
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return se2(c * dx + s * dy, -s * dx + c * dy, wrap_angle(b["theta"] - a["theta"]))


def se2_distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def se2_apply(pose: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """World position of a point given in the frame of a pose."""
    c, s = F.cos(pose["theta"]), F.sin(pose["theta"])
    return pose["x"] + c * x - s * y, pose["y"] + s * x + c * y


def d_world_d_theta(pose: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Derivative of ``se2_apply`` by the angle."""
    c, s = F.cos(pose["theta"]), F.sin(pose["theta"])
    return -s * x - c * y, c * x - s * y


def s1_diff_deg(a: Column, b: Column) -> Column:
    """Signed difference of two angles in degrees, in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def s1_dist_deg(a: Column, b: Column) -> Column:
    return F.abs(s1_diff_deg(a, b))


# Rotations are arrays of nine values by rows; rigid transforms structs of r (nine values) and t (three).


def quaternion_to_matrix(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """Rotation of a quaternion of any length; null if the length is zero."""
    n = qx * qx + qy * qy + qz * qz + qw * qw
    s = F.when(n > 0, F.lit(2.0) / n)
    xx, yy, zz, xy, xz, yz = qx * qx * s, qy * qy * s, qz * qz * s, qx * qy * s, qx * qz * s, qy * qz * s
    wx, wy, wz = qw * qx * s, qw * qy * s, qw * qz * s
    return F.when(n > 0, F.array(1.0 - (yy + zz), xy - wz, xz + wy, xy + wz, 1.0 - (xx + zz), yz - wx, xz - wy, yz + wx, 1.0 - (xx + yy)))


def quaternion_to_yaw(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    return F.atan2(2.0 * (qw * qz + qx * qy), 1.0 - 2.0 * (qy * qy + qz * qz))


def matrix_yaw(r: Column) -> Column:
    return F.atan2(r[3], r[0])


def rotation_angle_deg(r: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1.0) / 2.0))))


def rotation_between_angle_deg(a: Column, b: Column) -> Column:
    """Angle of the rotation that takes a to b."""
    trace = a[0] * b[0]
    for i in range(1, 9):
        trace = trace + a[i] * b[i]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))))


def quaternion_between_angle_deg(a: list[Column], b: list[Column]) -> Column:
    """Angle between two rotations given as quaternions (x, y, z, w) of any length."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    na, nb = (q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3] for q in (a, b))
    return F.degrees(2.0 * F.acos(F.least(F.lit(1.0), F.abs(dot) / F.sqrt(na * nb))))


def rotate(r: Column, v: list[Column]) -> list[Column]:
    return [r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)]


def rotate_back(r: Column, v: list[Column]) -> list[Column]:
    return [r[i] * v[0] + r[i + 3] * v[1] + r[i + 6] * v[2] for i in range(3)]


def matrix_product(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[j + 3] + a[3 * i + 2] * b[j + 6] for i in range(3) for j in range(3)])


def transpose(r: Column) -> Column:
    return F.array(*[r[3 * j + i] for i in range(3) for j in range(3)])


def se3(r: Column, t: list[Column]) -> Column:
    return F.struct(r.alias("r"), F.array(*t).alias("t"))


def se3_compose(a: Column, b: Column) -> Column:
    moved = rotate(a["r"], [b["t"][i] for i in range(3)])
    return se3(matrix_product(a["r"], b["r"]), [moved[i] + a["t"][i] for i in range(3)])


def se3_inverse(a: Column) -> Column:
    back = rotate_back(a["r"], [a["t"][i] for i in range(3)])
    return se3(transpose(a["r"]), [-x for x in back])


def se3_apply(a: Column, p: list[Column], scale: float | Column = 1.0) -> list[Column]:
    """Rigid (or with a scale, similarity) transform of a point."""
    moved = rotate(a["r"], p)
    return [moved[i] * scale + a["t"][i] for i in range(3)]


# Similarity transforms are structs of r, t and s: p goes to s R p + t.


def sim3(r: Column, t: list[Column], s: Column) -> Column:
    return F.struct(r.alias("r"), F.array(*t).alias("t"), s.alias("s"))


def sim3_compose(a: Column, b: Column) -> Column:
    moved = rotate(a["r"], [b["t"][i] for i in range(3)])
    return sim3(matrix_product(a["r"], b["r"]), [a["s"] * moved[i] + a["t"][i] for i in range(3)], a["s"] * b["s"])


def sim3_inverse(a: Column) -> Column:
    back = rotate_back(a["r"], [a["t"][i] for i in range(3)])
    return sim3(transpose(a["r"]), [-x / a["s"] for x in back], 1.0 / a["s"])


def sim3_apply(a: Column, p: list[Column]) -> list[Column]:
    return se3_apply(a, p, a["s"])


# Quaternions are lists of four columns x, y, z, w.


def conjugate(q: list[Column]) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    return [
        a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1],
        a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0],
        a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3],
        a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2],
    ]


def quaternion_rotate_back(q: list[Column], v: list[Column]) -> list[Column]:
    """v in the frame of a unit quaternion's rotation."""
    x, y, z, w = q
    return [
        (1 - 2 * (y * y + z * z)) * v[0] + 2 * (x * y + z * w) * v[1] + 2 * (x * z - y * w) * v[2],
        2 * (x * y - z * w) * v[0] + (1 - 2 * (x * x + z * z)) * v[1] + 2 * (y * z + x * w) * v[2],
        2 * (x * z + y * w) * v[0] + 2 * (y * z - x * w) * v[1] + (1 - 2 * (x * x + y * y)) * v[2],
    ]


def skew(v: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def normalise(v: list[Column]) -> list[Column]:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in v]


# Cameras


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point before the camera; null where z is not positive."""
    return F.when(z > 0, fx * x / z + cx), F.when(z > 0, fy * y / z + cy)


def project_stereo(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, bf: float) -> tuple[Column, Column, Column]:
    u, v = project(x, y, z, fx, fy, cx, cy)
    return u, v, u - F.when(z > 0, F.lit(bf) / z)


def backproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    return (u - cx) / fx * depth, (v - cy) / fy * depth, depth


def in_image(u: Column, v: Column, z: Column, width: float, height: float) -> Column:
    """Half-open image bounds and positive depth."""
    return (u >= 0) & (u < width) & (v >= 0) & (v < height) & (z > 0)


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2.0 * F.tan(fov / 2.0))


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2.0 * F.atan(pixels / (2.0 * focal))


# Grids, robust weights, descriptors


def probability(log_odds: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-log_odds))


def cell(x: Column, resolution: float, origin: float = 0.0) -> Column:
    """Cell of a coordinate; coordinates are taken to the micrometre, so that rounding noise moves none."""
    return F.floor(F.round((x - F.lit(origin)) / F.lit(resolution), 6)).cast("bigint")


def huber_weight(residual: Column, delta: float) -> Column:
    r = F.abs(residual)
    return F.when(r <= delta, F.lit(1.0)).otherwise(delta / r)


def edge_information(kind: Column, shared: Column) -> Column:
    """Weight of a graph edge: loop 10, spanning tree 1, covisibility a hundredth of the shared points within [0.5, 5]."""
    return F.when(kind == "loop", 10.0).when(kind == "spanning_tree", 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(5.0), shared * 0.01)))


def predicted_level(distance: Column, most: Column, scale: float, levels: int) -> Column:
    """Pyramid level at which a point of greatest distance ``most`` appears at a distance."""
    raw = F.ceil(F.round(F.log(most / distance) / math.log(scale), 9))
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), raw)).cast("int")


def hamming(a: Column, b: Column, words: int) -> Column:
    """Differing bits of two descriptors held as arrays of BIGINT."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def pair_key(a: Column, b: Column) -> Column:
    """Name of an unordered pair: smaller-larger."""
    return F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
