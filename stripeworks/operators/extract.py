"""Marking instances from bird's-eye label rasters: one frame at a time, where the frame lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera, linear, markings
from ..schema import CameraConfig, PipelineConfig, RoadClass
from . import raster

_CLASS = {2: RoadClass.DASHED, 3: RoadClass.GUIDE, 4: RoadClass.ZEBRA, 5: RoadClass.STOP}
#: Skeleton points are half a metre apart.
STEP = 0.5
MAX_RMS, MAX_SIGMA, LINE_RATIO, DOUBT = 5.0, 1.0, 2.0, 100.0

INSTANCES = (
    "frame_id long, k int, road_class int, pixels int, top int, left int, height int, width int, mean_u double, mean_v double, dir_u double, dir_v double, "
    "sigma_along double, sigma_across double, out_range boolean, line_valid boolean, line array<struct<u:double,v:double>>, corners array<struct<u:double,v:double>>, edge_sigma array<double>"
)


def _class_of(gray: np.ndarray) -> RoadClass:
    """The most frequent class; of equal ones the smallest."""
    values, n = np.unique([int(_CLASS.get(int(g), RoadClass.SOLID)) for g in gray], return_counts=True)
    return RoadClass(int(values[np.argmax(n)]))


def _points(a: np.ndarray) -> list[dict]:
    return [{"u": float(u), "v": float(v)} for u, v in a]


class Extractor:
    """Thresholds and camera of a run; ``instances`` takes one frame."""

    def __init__(self, cfg: PipelineConfig, cam: CameraConfig):
        self.cfg, self.cam = cfg, cam

    def variances(self, p: np.ndarray):
        c = self.cam
        return camera.pixel_variances(p[:, 0], p[:, 1], c.h, c.height, c.width, c.resolution, c.intrinsics["fx"], c.intrinsics["fy"])

    def sigma(self, p: np.ndarray, d: np.ndarray) -> float:
        xx, xy, yy = (float(v[0]) for v in self.variances(p[None]))
        return float(np.sqrt(d[0] * d[0] * xx + 2 * d[0] * d[1] * xy + d[1] * d[1] * yy))

    def skeleton(self, p: np.ndarray, mean: np.ndarray, direction: np.ndarray, along: float, bottom: float, cls: RoadClass) -> tuple[bool, np.ndarray]:
        """Whether a line was found, and its points: a cubic across the main direction, sampled along it."""
        angle = np.arctan2(direction[1], direction[0]) + np.pi / 2
        turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        q = (p - mean) @ turn.T
        k = np.polynomial.polynomial.polyfit(q[:, 1], q[:, 0], 3)
        rms = np.sqrt(np.mean((np.polynomial.polynomial.polyval(q[:, 1], k) - q[:, 0]) ** 2))
        if not rms < MAX_RMS:
            return False, np.zeros((0, 2))
        reach = along * 2 / (STEP / self.cam.resolution)
        y = np.arange(np.ceil(-reach), reach) * STEP / self.cam.resolution
        pts = np.column_stack((np.polynomial.polynomial.polyval(y, k), y)) @ turn + mean
        limit = self.cfg.solid_max_distance if cls == RoadClass.SOLID else self.cfg.stop_max_distance
        pts = pts[(pts[:, 1] <= bottom) & ((self.cam.height - pts[:, 1]) * self.cam.resolution < limit)]
        if len(pts) < 2:
            return False, pts
        xx, _, yy = self.variances(pts)
        return bool(np.sqrt(xx + yy).min() <= MAX_SIGMA), pts

    def box(self, p: np.ndarray, mean: np.ndarray, d: np.ndarray, doubtful: bool) -> tuple[np.ndarray, list[float]]:
        """Corners (bottom left, bottom right, top right, top left) and the sigmas of the edges (bottom, right, top, left)."""
        d = d / np.linalg.norm(d)
        d = -d if d[1] < 0 else d
        across = np.array([-d[1], d[0]])
        angle = -np.arctan2(d[1], d[0]) + np.pi / 2
        turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        q = (p - mean) @ turn
        at = [int(np.argmin(q[:, 0])), int(np.argmax(q[:, 0])), int(np.argmin(q[:, 1])), int(np.argmax(q[:, 1]))]
        left, right, top, bottom = q[at[0], 0], q[at[1], 0], q[at[2], 1], q[at[3], 1]
        corners = np.array([[left, bottom], [right, bottom], [right, top], [left, top]]) @ turn.T + mean
        sigma = [self.sigma(p[at[3]], d), self.sigma(p[at[1]], across), self.sigma(p[at[2]], d), self.sigma(p[at[0]], across)]
        if doubtful:
            sigma = [s * DOUBT if i != 2 else s for i, s in enumerate(sigma)]
        return corners, sigma

    def instances(self, frame_id: int, mask: np.ndarray, black: np.ndarray | None = None) -> list[tuple]:
        """The frame's instances; ``black`` marks pixels that the camera did not see."""
        labels = raster.label_mask(mask)
        rows, cols = np.nonzero(labels)
        order = np.argsort(labels[rows, cols], kind="stable")
        rows, cols = rows[order], cols[order]
        ends = np.flatnonzero(np.diff(np.concatenate(([0], labels[rows, cols], [0]))))
        edge = np.zeros(mask.shape, bool)
        edge[-1], edge[:, 0], edge[:, -1] = True, True, True
        if black is not None:
            below = np.zeros_like(edge)
            below[:-1] = black[1:]
            edge |= below
            edge[:, 1:] |= below[:, :-1]
            edge[:, :-1] |= below[:, 1:]
        found = []
        for a, b in zip(ends[:-1], ends[1:]):
            r, c = rows[a:b], cols[a:b]
            if len(r) < self.cfg.min_patch_size:
                continue
            cls = _class_of(mask[r, c])
            p = np.column_stack((c, r)).astype(float)
            mean = p.mean(0)
            values, vectors = np.linalg.eigh((p - mean).T @ (p - mean) / len(p))
            along, across = np.sqrt(np.maximum(values[::-1], 0))
            d = vectors[:, 1] * (-1 if vectors[1, 1] < 0 else 1)
            line_valid, line = False, np.zeros((0, 2))
            if along > LINE_RATIO * across and cls in (RoadClass.SOLID, RoadClass.STOP):
                line_valid, line = self.skeleton(p, mean, d, along, r.max() + 1, cls)
            found.append({"cls": cls, "p": p, "mean": mean, "d": d, "along": along, "across": across, "out": bool(edge[r, c].any()), "valid": line_valid, "line": line, "box": (r.min(), c.min(), r.max() - r.min() + 1, c.max() - c.min() + 1)})
        at = [f["mean"] for f in found if f["cls"] == RoadClass.DASHED]
        to = [f["d"] for f in found if f["cls"] == RoadClass.DASHED]
        for f in found:
            if f["cls"] == RoadClass.SOLID and f["valid"]:
                at += list(f["line"][:-1])
                to += list(np.diff(f["line"], axis=0))
        out = []
        for f in found:
            corners, sigma = np.zeros((0, 2)), []
            if f["cls"] in (RoadClass.DASHED, RoadClass.GUIDE):
                if not at:
                    continue  # nothing tells the direction
                near = int(np.argmin(np.linalg.norm(np.array(at) - f["mean"], axis=1)))
                corners, sigma = self.box(f["p"], f["mean"], to[near], f["out"])
            out.append((frame_id, len(out), int(f["cls"]), len(f["p"]), *map(int, f["box"]), *f["mean"].tolist(), *f["d"].tolist(), float(f["along"]), float(f["across"]), f["out"], f["valid"], _points(f["line"]), _points(corners), sigma))
        return out


def extract(frames: DataFrame, cfg: PipelineConfig, cam: CameraConfig) -> DataFrame:
    """Instances in pixels of label rasters (frame_id, height, width, data)."""
    names = [c.split()[0] for c in INSTANCES.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Extractor(cfg, cam)
        for b in batches:
            rows = [r for f in b.itertuples(index=False) for r in e.instances(f.frame_id, np.frombuffer(f.data, np.uint8).reshape(f.height, f.width))]
            yield pd.DataFrame(rows, columns=names)

    return frames.select("frame_id", "height", "width", "data").mapInPandas(work, INSTANCES)


def _body(u: Column, v: Column, cam: CameraConfig, level: list[float]) -> Column:
    m = camera.ipm_to_metric(u, v, linear.literal(level), cam.h, cam.height, cam.width, cam.resolution)
    x, y, z = (a + b for a, b in zip(linear.apply(linear.literal(cam.rotation), m), linear.literal(cam.translation)))
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def to_body(instances: DataFrame, cfg: PipelineConfig, cam: CameraConfig) -> DataFrame:
    """Adds metres in the body frame: ``mean``, ``box``, ``line_m``, sides ``h`` and ``w``, ``percept_distance``, ``valid_add_to_map``.

    The map from pixels is affine, so the mean of the points is the point of the mean.
    """
    ca, sa, ct, st = np.cos(cam.alpha), np.sin(cam.alpha), np.cos(cam.theta), np.sin(cam.theta)
    level = [ca, -sa * ct, sa * st, sa, ca * ct, -ca * st, 0.0, st, ct]
    move = lambda c: F.transform(c, lambda p: _body(p.u, p.v, cam, level))
    df = instances.withColumn("mean", _body(F.col("mean_u"), F.col("mean_v"), cam, level)).withColumn("box", move(F.col("corners"))).withColumn("line_m", move(F.col("line")))

    def side(i: int, j: int) -> Column:
        a, b = F.try_element_at("box", F.lit(i + 1)), F.try_element_at("box", F.lit(j + 1))
        return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"))

    df = df.withColumn("h", side(1, 2)).withColumn("w", side(0, 1)).withColumn("percept_distance", F.col("mean.y"))
    return df.withColumn("valid_add_to_map", F.coalesce(markings.valid_for_map(F.col("road_class"), F.col("h"), F.col("percept_distance"), F.col("line_valid"), cfg), F.lit(False)))


def to_world(instances: DataFrame, poses: DataFrame, frame: str = "frame_id") -> DataFrame:
    """``mean``, ``box`` and ``line_m`` moved by the frame's pose (frame, struct pose with r and t)."""
    j = instances.join(poses.select(frame, "pose"), frame)
    r, t = linear.mat(F.col("pose.r")), [F.col("pose.t")[i] for i in range(3)]

    def move(p: Column) -> Column:
        v = linear.apply(r, (p["x"], p["y"], p["z"]))
        return F.struct(*[(a + b).alias(c) for a, b, c in zip(v, t, "xyz")])

    return j.withColumn("mean", move(F.col("mean"))).withColumn("box", F.transform("box", move)).withColumn("line_m", F.transform("line_m", move)).drop("pose")
