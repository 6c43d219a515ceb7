"""Raster work, one frame at a time: component labels, undistortion, bird's-eye warp.

Frames are independent, so each is a row (or a small group) and runs where it
lies; NumPy does the pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schema import CameraConfig
from .grouped import Group, by_group


def label_components(fg: np.ndarray) -> np.ndarray:
    """4-neighbour components of a boolean image, numbered from 1 in the order of their first pixel; 0 is background.

    Runs of a row are joined to the runs they touch in the row above.
    """
    h, w = fg.shape
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    runs = []
    for row in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], fg[row].astype(np.int8), [0]))))
        now, k = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(parent)
            parent.append(i)
            while k < len(above) and above[k][1] <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b:
                x, y = find(i), find(above[j][2])
                parent[max(x, y)] = min(x, y)
                j += 1
            now.append((a, b, i))
        runs += [(row, *r) for r in now]
        above = now
    out = np.zeros((h, w), np.int32)
    number: dict[int, int] = {}
    for row, a, b, i in runs:
        out[row, a:b] = number.setdefault(find(i), len(number) + 1)
    return out


def label_mask(gray: np.ndarray, apart: int = 5) -> np.ndarray:
    """Components of a label image; the label ``apart`` forms its own, all other labels count as one foreground."""
    rest = label_components((gray > 0) & (gray != apart))
    own = label_components(gray == apart)
    own[own > 0] += rest.max(initial=0)
    return rest + own


def components(pixels: DataFrame, apart: int = 5) -> DataFrame:
    """``frame_id, row, col, gray, component`` of the foreground pixels; a component's number is its first pixel's row * 65536 + col."""
    def one(g: Group) -> Group:
        row, col = g["row"], g["col"]
        image = np.zeros((row.max() + 1, col.max() + 1), np.int32)
        image[row, col] = g["gray"]
        labels = label_mask(image, apart)
        at = labels[row, col]
        fg = at > 0
        first = np.full(labels.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, at[fg], row[fg].astype(np.int64) * 65536 + col[fg])
        return {"frame_id": g["frame_id"][fg], "row": row[fg], "col": col[fg], "gray": g["gray"][fg], "component": first[at[fg]]}

    rows = pixels.select("frame_id", "row", "col", "gray")
    return by_group(rows, ["frame_id"], ["row", "col"], one, "frame_id long, row int, col int, gray int, component long")


def homography(k: np.ndarray, r: np.ndarray, d: float, cam: CameraConfig) -> np.ndarray:
    """Camera pixels to bird's-eye pixels, in single precision."""
    s = np.float32(cam.resolution)
    to_ground = np.array([[s / d, 0, -(cam.width // 2) * s / d], [0, 0, 1], [0, -s / d, (cam.height - 1) * s / d]], float)
    return np.linalg.inv(k @ r * d @ to_ground).astype(np.float32)


def gather(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Nearest pixels at (u, v), half rounding up; zero outside."""
    with np.errstate(invalid="ignore"):
        c, r = np.floor(u + 0.5), np.floor(v + 0.5)
    ok = np.isfinite(c) & np.isfinite(r) & (c >= 0) & (r >= 0) & (c < image.shape[1]) & (r < image.shape[0])
    out = np.zeros((*u.shape, *image.shape[2:]), image.dtype)
    out[ok] = image[r[ok].astype(int), c[ok].astype(int)]
    return out


def warp(image: np.ndarray, transform: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-neighbour perspective warp."""
    inv = np.linalg.inv(transform.astype(float))
    u, v = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y, w = (inv[i, 0] * u + inv[i, 1] * v + inv[i, 2] for i in range(3))
        return gather(image, x / w, y / w)


def ground_mask(k: np.ndarray, r: np.ndarray, d: float, cam: CameraConfig, height: int, width: int) -> np.ndarray:
    """The part of a camera image that shows the far half of the bird's-eye raster: inside the polygon of its corners."""
    corners = np.array([(0, 0), (cam.width - 1, 0), (cam.width - 1, cam.height // 2), (0, cam.height // 2)], float)
    ground = np.column_stack(((corners[:, 0] - cam.width // 2) * cam.resolution, np.full(4, d), (cam.height - corners[:, 1] - 1) * cam.resolution))
    q = ground @ (k @ r).T
    q = q[:, :2] / q[:, 2:]
    u, v = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    side = [(b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0]) for a, b in zip(q, np.roll(q, -1, axis=0))]
    return np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)


def undistort_map(height: int, width: int, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the undistorted pinhole image lies in the raw one."""
    u, v = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    x, y = (u - p["cx"]) / p["fx"], (v - p["cy"]) / p["fy"]
    r2 = x * x + y * y
    k = 1 + p["k1"] * r2 + p["k2"] * r2 * r2
    xd = x * k + 2 * p["p1"] * x * y + p["p2"] * (r2 + 2 * x * x)
    yd = y * k + 2 * p["p2"] * x * y + p["p1"] * (r2 + 2 * y * y)
    return p["fx"] * xd + p["cx"], p["fy"] * yd + p["cy"]


def birds_eye(images: DataFrame, cam: CameraConfig) -> DataFrame:
    """Rows (frame_id, height, width, channels, data, r, d) to bird's-eye rasters of the same columns.

    ``r`` is the frame's level-to-camera rotation (nine doubles), ``d`` its
    height over ground.  A mask shorter than the camera's image belongs to its
    bottom.  Maps that do not depend on the frame are made once a task.
    """
    p = cam.intrinsics
    k = np.array([[p["fx"], 0, p["cx"]], [0, p["fy"], p["cy"]], [0, 0, 1]])
    full_h, full_w = int(p["image_height"]), int(p["image_width"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mu, mv = undistort_map(full_h, full_w, p)
        for b in batches:
            rows = []
            for f in b.itertuples(index=False):
                raw = np.frombuffer(f.data, np.uint8).reshape(f.height, f.width, f.channels)
                whole = np.zeros((full_h, full_w, f.channels), np.uint8)
                whole[full_h - f.height :, : f.width] = raw
                flat = gather(whole, mu, mv)
                out = warp(flat, homography(k, np.array(f.r, float).reshape(3, 3), f.d, cam), cam.height, cam.width)
                rows.append((f.frame_id, cam.height, cam.width, f.channels, out.tobytes(), f.r, f.d))
            yield pd.DataFrame(rows, columns=["frame_id", "height", "width", "channels", "data", "r", "d"])

    return images.select("frame_id", "height", "width", "channels", "data", "r", "d").mapInPandas(work, "frame_id long, height int, width int, channels int, data binary, r array<double>, d double")


def pixels_of(images: DataFrame, minimum: int = 1) -> DataFrame:
    """One-channel rasters as rows (frame_id, row, col, gray), background left out."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples(index=False):
                a = np.frombuffer(f.data, np.uint8).reshape(f.height, f.width)
                r, c = np.nonzero(a >= minimum)
                yield pd.DataFrame({"frame_id": f.frame_id, "row": r.astype(np.int32), "col": c.astype(np.int32), "gray": a[r, c].astype(np.int32)})

    return images.select("frame_id", "height", "width", "data").mapInPandas(work, "frame_id long, row int, col int, gray int")
