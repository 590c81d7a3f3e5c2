"""Writers: trajectories, clouds, tables, graphs and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_trajectory(poses: DataFrame, path: str) -> None:
    """Text folder of ``ts tx ty tz qx qy qz qw`` lines, in order of time over its parts."""
    line = F.format_string("%.6f %.9f %.9f %.9f %.9f %.9f %.9f %.9f", *[F.col(c).cast("double") for c in ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    poses.orderBy("ts").select(line.alias("value")).write.mode("overwrite").text(path)


def write_planar_trajectory(poses: DataFrame, path: str) -> None:
    """Text folder of ``t x y theta score`` lines."""
    line = F.format_string("%.6f %.6f %.6f %.6f %.6f", *[F.col(c).cast("double") for c in ("t", "x", "y", "theta", "score")])
    poses.orderBy("t").select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV folder with fixed columns; those that are missing are blank, numbers that are NaN too."""
    have = dict(rows.dtypes)
    blank = lambda c: F.when(~F.isnan(c), F.col(c)) if have[c] in ("double", "float") else F.col(c)
    rows.select(*[(blank(c) if c in have else F.lit(None).cast("string")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_ply(points: DataFrame, path: str, colours: bool = False) -> None:
    """ASCII PLY: a folder whose parts in order are one file, the header being the first part's head."""
    names = ["x", "y", "z"] + (["red", "green", "blue"] if colours else [])
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in names[:3]], *[f"property uchar {c}" for c in names[3:]], "end_header"]
    body = F.format_string(" ".join(["%.6f"] * 3 + ["%d"] * (len(names) - 3)), *[F.col(c).cast("double" if c in "xyz" else "int") for c in names])
    spark = points.sparkSession
    top = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "o BIGINT, value STRING")
    rows = points.select((F.monotonically_increasing_id() + len(head)).alias("o"), body.alias("value"))
    top.unionByName(rows).orderBy("o").select("value").write.mode("overwrite").text(path)


def write_json_rows(rows: DataFrame, path: str) -> None:
    """JSON lines folder."""
    rows.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Keyframes and their edges as two JSON folders below ``path``."""
    write_json_rows(nodes, f"{path}/keyframes")
    write_json_rows(edges, f"{path}/edges")


def write_metrics(metrics: dict[str, Any], path: str | Path) -> None:
    """A small JSON file."""
    Path(path).write_text(json.dumps(metrics, indent=2, sort_keys=True, default=str) + "\n")


def markdown_table(rows: Sequence[dict[str, Any]], columns: Sequence[str]) -> str:
    """Markdown of a few rows; missing values are blank."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def slug(text: str) -> str:
    """Name for files: lower-case letters, digits and single underscores."""
    import re

    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", text.lower())).strip("_") or "run"


def write_camera_trajectory(poses: DataFrame, path: str) -> None:
    """``write_trajectory`` for world-to-camera transforms: ts and ``pose`` (struct of r, t); each is inverted first."""
    from ..functions import geom

    inverse = geom.se3_inverse(F.col("pose"))
    r = lambda i: F.col("inv.r")[i]
    # the greatest of the four components is taken by its square root, the others follow
    w, x, y, z = 1 + r(0) + r(4) + r(8), 1 + r(0) - r(4) - r(8), 1 - r(0) + r(4) - r(8), 1 - r(0) - r(4) + r(8)
    pick = F.when((w >= x) & (w >= y) & (w >= z), 0).when((x >= y) & (x >= z), 1).when(y >= z, 2).otherwise(3)
    rows = {  # x, y, z, w, each times four times the greatest
        0: (r(7) - r(5), r(2) - r(6), r(3) - r(1), w), 1: (x, r(1) + r(3), r(2) + r(6), r(7) - r(5)),
        2: (r(1) + r(3), y, r(5) + r(7), r(2) - r(6)), 3: (r(2) + r(6), r(5) + r(7), z, r(3) - r(1)),
    }
    square = {0: w, 1: x, 2: y, 3: z}
    placed = poses.select("ts", inverse.alias("inv")).withColumn("pick", pick)
    values = []
    for i, name in enumerate(("qx", "qy", "qz", "qw")):
        v = F.lit(None).cast("double")
        for k in range(4):
            v = F.when(F.col("pick") == k, rows[k][i] / (2 * F.sqrt(square[k]))).otherwise(v)
        values.append(v.alias(name))
    write_trajectory(placed.select("ts", *[F.col("inv.t")[i].alias(c) for i, c in enumerate(("tx", "ty", "tz"))], *values), path)


def write_with_meta(poses: DataFrame, path: str, meta: dict[str, Any]) -> None:
    """Planar trajectory and, beside it, its settings as JSON."""
    write_planar_trajectory(poses, path)
    write_metrics(meta, f"{path}.meta.json")


def write_sections(sections: DataFrame, path: str) -> None:
    """Profiler sections as CSV and JSON folders below ``path``."""
    write_csv(sections, f"{path}/csv", sections.columns)
    write_json_rows(sections, f"{path}/json")


def write_map(cells: DataFrame, path: str, resolution: float) -> None:
    """Sparse occupancy map: its cells as parquet and its frame (resolution, bounds, cells) as JSON below ``path``."""
    b = cells.agg(*[f(c).alias(f"{n}_{c}") for c in ("gx", "gy") for n, f in (("least", F.min), ("most", F.max))], F.count("*").alias("cells")).first().asDict()
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    write_metrics({"resolution": resolution, **b}, f"{path}/frame.json")


def run_summary(run: DataFrame, by: str, order: str) -> DataFrame:
    """Rows, first and last ``order`` and the greatest of every numeric column per run: what a run's summary file holds."""
    numeric = [f.name for f in run.schema if f.name not in (by, order) and f.dataType.typeName() in ("integer", "long", "float", "double")]
    return run.groupBy(by).agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), *[F.max(F.when(~F.isnan(c), F.col(c)) if dict(run.dtypes)[c] in ("double", "float") else F.col(c)).alias(f"most_{c}") for c in numeric])


def write_report(title: str, tables: dict[str, Sequence[dict[str, Any]]], path: str | Path) -> None:
    """Markdown report of a few small tables under headings."""
    parts = [f"# {title}\n"]
    for name, rows in tables.items():
        parts.append(f"## {name}\n\n" + (markdown_table(rows, list(rows[0])) if rows else "No rows.\n"))
    Path(path).write_text("\n".join(parts))
