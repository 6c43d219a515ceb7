"""Configuration and calibration files in the YAML dialect of computer-vision tools."""

from __future__ import annotations

import re

import yaml

from ..schema import CameraConfig, PipelineConfig


class _Loader(yaml.SafeLoader):
    pass


def _matrix(loader: yaml.SafeLoader, node: yaml.Node) -> list[list[float]]:
    m = loader.construct_mapping(node, deep=True)
    rows, cols, data = int(m["rows"]), int(m["cols"]), m["data"]
    return [[float(x) for x in data[i * cols : (i + 1) * cols]] for i in range(rows)]


_Loader.add_constructor("tag:yaml.org,2002:opencv-matrix", _matrix)


def parse(text: str) -> dict:
    """The first line may be ``%YAML:1.0``; matrices become lists of rows."""
    text = re.sub(r"\A%YAML[^\n]*\n(---[^\n]*\n)?", "", text)
    text = re.sub(r"(?m)^(\s*[A-Za-z_][\w.]*):(?=[^\s\[{])", r"\1: ", text)
    return yaml.load(text, _Loader) or {}


#: The five models and their groups of parameters.
GROUPS = {
    "pinhole": {"distortion_parameters": ("k1", "k2", "p1", "p2"), "projection_parameters": ("fx", "fy", "cx", "cy")},
    "pinhole_full": {"distortion_parameters": ("k1", "k2", "k3", "k4", "k5", "k6", "p1", "p2"), "projection_parameters": ("fx", "fy", "cx", "cy")},
    "mei": {"mirror_parameters": ("xi",), "distortion_parameters": ("k1", "k2", "p1", "p2"), "projection_parameters": ("gamma1", "gamma2", "u0", "v0")},
    "kannala_brandt": {"projection_parameters": ("k2", "k3", "k4", "k5", "mu", "mv", "u0", "v0")},
    "scaramuzza": {"affine_parameters": ("ac", "ad", "ae", "cx", "cy")},
}
POLY, INV_POLY = 5, 20


def camera(text: str) -> dict:
    """A calibration as the flat dictionary that the camera functions take."""
    d = parse(text)
    kind = str(d.get("model_type", "")).lower()
    if kind not in GROUPS:
        raise ValueError(f"no camera model {d.get('model_type')!r}: {', '.join(GROUPS)}")
    out = {"model_type": kind, "camera_name": d.get("camera_name", ""), "image_width": int(d["image_width"]), "image_height": int(d["image_height"])}
    for group, names in GROUPS[kind].items():
        out |= {n: float(d[group][n]) for n in names}
    if kind == "scaramuzza":
        out["poly"] = [float(d["poly_parameters"][f"p{i}"]) for i in range(POLY)]
        out["inv_poly"] = [float(d["inv_poly_parameters"][f"p{i}"]) for i in range(INV_POLY)]
    return out


def camera_yaml(p: dict) -> str:
    """The calibration as a file that ``camera`` reads back."""
    lines = ["%YAML:1.0", "---", f"model_type: {p['model_type'].upper()}", f"camera_name: {p.get('camera_name', '')}", f"image_width: {p['image_width']}", f"image_height: {p['image_height']}"]
    groups = {g: {n: p[n] for n in names} for g, names in GROUPS[p["model_type"]].items()}
    if p["model_type"] == "scaramuzza":
        groups = {"poly_parameters": {f"p{i}": v for i, v in enumerate(p["poly"])}, "inv_poly_parameters": {f"p{i}": v for i, v in enumerate(p["inv_poly"])}} | groups
    for g, values in groups.items():
        lines += [f"{g}:", *[f"   {k}: {float(v)!r}" for k, v in values.items()]]
    return "\n".join(lines) + "\n"


#: The file's name of each setting.
_PIPELINE = {
    "pose_smooth_window": "pose_smooth_window", "large_slope_threshold": "large_slope_thresold", "min_patch_size": "patch.min_size",
    "dashed_min_height": "patch.dashed_min_h", "dashed_max_height": "patch.dashed_max_h", "dashed_max_distance": "patch.dashed_max_dist",
    "guide_max_height": "patch.guide_max_h", "guide_max_distance": "patch.guide_max_dist", "solid_max_distance": "patch.solid_max_dist", "stop_max_distance": "patch.stop_max_dist",
    "mapping_step": "mapping.step", "active_distance": "mapping.patch_freeze_distance", "freeze_line_distance": "mapping.line_freeze_distance", "freeze_line_length": "mapping.line_freeze_max_length",
    "window_size": "localization.max_windowsize", "keyframe_step": "localization.every_n_frames", "keyframe_distance": "localization.min_keyframe_dist", "max_strict_match_dist": "localization.max_strict_match_dist",
}


def pipeline(text: str, names: dict[str, str] = _PIPELINE) -> PipelineConfig:
    """Settings that the file has, the others at their defaults; distances keep their fractions."""
    d = parse(text)
    kinds = {f: type(v) for f, v in PipelineConfig().__dict__.items()}
    return PipelineConfig(**{k: kinds[k](d[n]) for k, n in names.items() if n in d})


def raster(text: str, intrinsics: dict | None = None, keys: tuple[str, str, str] = ("IPM_HEIGHT", "IPM_WIDTH", "IPM_RESO"), angles: tuple[str, str, str] = ("cg_alpha", "cg_theta", "cg_h"), mounting: str = "Tic") -> CameraConfig:
    """The bird's-eye raster and the camera's mounting (a 4 x 4 matrix); ``keys`` and ``angles`` name them in the file, angles in degrees."""
    import math

    d = parse(text)
    out: dict = {"height": int(d[keys[0]]), "width": int(d[keys[1]]), "resolution": float(d[keys[2]]), "intrinsics": intrinsics or {}}
    for name, key in zip(("alpha", "theta"), angles):
        if key in d:
            out[name] = math.radians(float(d[key]))
    if angles[2] in d and float(d[angles[2]]) > 0:
        out["h"] = float(d[angles[2]])
    if mounting in d:
        m = d[mounting]
        out["rotation"] = tuple(v for row in m[:3] for v in row[:3])
        out["translation"] = tuple(row[3] for row in m[:3])
    return CameraConfig(**out)
