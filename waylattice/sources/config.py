"""Small configuration files, read on the driver: datasets, cameras, indented key-value files."""

from __future__ import annotations

import ast
import re
from pathlib import Path
from typing import Any

# --- fixed values: rounded factory calibrations of the public RGB-D sequences -----------------------------------
CAMERAS = {
    "fr1": {"fx": 517.3, "fy": 516.5, "cx": 318.6, "cy": 255.3},
    "fr2": {"fx": 520.9, "fy": 521.0, "cx": 325.1, "cy": 249.7},
    "fr3": {"fx": 535.4, "fy": 539.2, "cx": 320.1, "cy": 247.6},
}
WIDTH, HEIGHT, DEPTH_FACTOR, BASELINE, DEPTH_THRESHOLD, FPS = 640, 480, 5000.0, 0.08, 40.0, 30.0
# ----------------------------------------------------------------------------------------------------------------


#: A line of settings: indent, key, value. Comments, document marks and lines without a colon are none.
_LINE = re.compile(r"^([ \t]*)([^\s#%:-][^:#\n]*?|-[^\s-][^:#\n]*?)[ \t]*:(?:[ \t]+(.*?))?[ \t]*$", re.M)
WORDS = {"true": True, "false": False, "null": None, "none": None, "~": None}


def scalar(text: str) -> Any:
    """Value of a cell: true, false, nothing, a number, a literal list or text; an empty cell is an empty text."""
    text = text.strip()
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        pass
    if text[:1] in ("[", "{", "(", "'", '"'):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text.strip("'\"")
    return text


def settings(text: str) -> dict[str, Any]:
    """Dotted keys and values of an indented settings text.

    A key belongs to the last line before it that is indented less. Lines that
    have neither a value nor anything below them hold an empty text.
    """
    lines = [(len(m[1].expandtabs()), m[2].strip(), re.sub(r"(^|\s+)#.*$", "", m[3] or "")) for m in _LINE.finditer(text)]
    depth = [d for d, _, _ in lines]
    above = [max((j for j in range(i) if depth[j] < depth[i]), default=None) for i in range(len(lines))]
    names: list[str] = []
    for (_, key, _), j in zip(lines, above):
        names.append(key if j is None else f"{names[j]}.{key}")
    return {name: scalar(value) for i, (name, (_, _, value)) in enumerate(zip(names, lines)) if value or i not in above}


def camera(config: str | Path | dict[str, Any]) -> dict[str, float]:
    """Camera of a settings file, by nested keys (camera., image., depth.) or plain ones, with or without ``Camera.``.

    bf is fx times the baseline where it is not given; a distortion list stands for k1, k2, p1, p2, k3.
    """
    flat = {k.lower(): v for k, v in (config if isinstance(config, dict) else settings(Path(config).read_text())).items()}

    def get(*names: str, default: float | None = None) -> float:
        spellings = [prefix + n for n in names for prefix in ("", "camera.", "image.", "depth.")]
        value = next((flat[n] for n in spellings if flat.get(n) not in (None, "")), default)
        if value is None:
            raise ValueError(f"camera settings lack {names[0]}")
        return float(value)

    bent = flat.get("camera.distortion") or [0.0] * 5
    out = {k: get(k) for k in ("fx", "fy", "cx", "cy")} | {"width": get("width", default=WIDTH), "height": get("height", default=HEIGHT), "fps": get("fps", default=FPS)}
    out |= {k: get(k, default=float(x)) for k, x in zip(("k1", "k2", "p1", "p2", "k3"), bent)}
    out |= {"baseline": get("b", "baseline", "baseline_m", default=BASELINE), "depth_threshold": get("thdepth", "depth_threshold", default=DEPTH_THRESHOLD)}
    out["depth_factor"] = get("depthmapfactor", "depth_map_factor", "depth_factor", "depth_scale", default=1000.0)
    if out["depth_factor"] <= 0:
        raise ValueError("the depth factor must be positive")
    return out | {"bf": get("bf", default=out["fx"] * out["baseline"])}


def public_camera(dataset: str) -> dict[str, float]:
    """Camera of a public sequence by its name; that of the first series where the name tells none."""
    name = dataset.lower()
    key = next((k for k in ("fr2", "fr3") if any(n in name for n in (k, k.replace("fr", "freiburg"), k.replace("fr", "freiburg_")))), "fr1")
    c = CAMERAS[key]
    return c | {"width": WIDTH, "height": HEIGHT, "depth_factor": DEPTH_FACTOR, "bf": c["fx"] * BASELINE, "depth_threshold": DEPTH_THRESHOLD}


def dataset_kind(folder: str | Path) -> str:
    """'tum' (by its name or a ground truth) or 'lab' (camera settings, both image folders and associations); raises if neither or both fit."""
    path = Path(folder)
    tum = path.name.lower().startswith("rgbd_dataset_freiburg") or (path / "groundtruth.txt").exists()
    lab = all((path / f).exists() for f in ("camera.yaml", "associations.txt")) and all((path / f).is_dir() for f in ("rgb", "depth"))
    if tum == lab:
        raise ValueError(f"can't tell the kind of {folder}: " + ("both fit" if tum else "nothing fits"))
    return "tum" if tum else "lab"


def resolve_camera(folder: str | Path, config: str | Path | None = None) -> dict[str, float]:
    """Camera of a dataset folder: of the settings given, else those in the folder, else by the name of a public sequence."""
    path = Path(config) if config is not None else Path(folder) / "camera.yaml"
    if path.exists():
        return camera(path)
    if config is not None or dataset_kind(folder) == "lab":
        raise FileNotFoundError(f"no camera settings at {path}")
    return public_camera(Path(folder).name)


def dataset_profile(datasets, name: str, variant: str | None = None) -> dict[str, Any]:
    """Row of a dataset table by name (and ``:variant``); raises if there is none."""
    wanted = name if variant is None else f"{name}:{variant}"
    rows = datasets.where(datasets["name"] == wanted).limit(1).collect()
    if not rows:
        raise ValueError(f"unknown dataset {wanted!r}")
    return rows[0].asDict()


def open_dataset(spark, name: str, path: str):
    """Scans of a known kind of dataset, by its name: the reader that belongs to it over ``path``."""
    from . import text

    readers = {"fr079": lambda: text.read_carmen(spark, path), "intel": lambda: text.read_carmen(spark, path, variant="intel"), "lab_run_2": lambda: text.read_lab_carmen(spark, path)}
    kind = name.split(":")[0]
    if kind not in readers:
        raise ValueError(f"unknown dataset {name!r}; known are {sorted(readers)}")
    return readers[kind]()
