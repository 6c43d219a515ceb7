"""Localisation against a map: match, solve, match again, in windows that slide along each trajectory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard
from . import joins, kernels
from .grouped import Group, by_group

#: Poses solved together, and how many of them the next window takes up again.
WINDOW, OVERLAP = 100, 20
POSES = "traj_id long, frame_id long, t double, r array<double>, p array<double>"


def matches(points: DataFrame, poses: DataFrame, lines: DataFrame, max_distance: float) -> DataFrame:
    """Body points (traj_id, frame_id, pid, road_class, x, y, z) with the nearest segment of the map lines of their class.

    Map lines are segments (road_class, seg, ax, ay, az, bx, by, bz).  Cells are as
    wide as the distance allowed and a segment is filed at the middle of each
    piece of it that is no longer than that, so segments may have any length.
    """
    r = lambda i: F.col("r")[i]
    w = points.join(poses.select("traj_id", "frame_id", "r", "p"), ["traj_id", "frame_id"])
    for k, c in enumerate("xyz"):
        w = w.withColumn(f"w{c}", r(3 * k) * F.col("x") + r(3 * k + 1) * F.col("y") + r(3 * k + 2) * F.col("z") + F.col("p")[k])
    q = w.select("traj_id", "frame_id", "pid", "road_class", F.col("wx").alias("x"), F.col("wy").alias("y"), "wz")
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    pieces = F.greatest(F.lit(1), F.ceil(length / max_distance))
    filed = lines.withColumn("b_n", pieces).withColumn("b_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_n").cast("long") - 1)))
    at = lambda c: (F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (F.col("b_i") + 0.5) / F.col("b_n")).alias(f"b_{c}")
    mid = filed.select("road_class", F.struct("ax", "ay", "az", "bx", "by", "bz").alias("b_s"), F.col("seg").alias("b_seg"), at("x"), at("y"))
    pairs = joins.grid_pairs(q, mid, ["road_class"], 2 * max_distance)
    s = lambda c: F.col(f"b_s.{c}")
    ux, uy = s("bx") - s("ax"), s("by") - s("ay")
    n = F.nullif(F.sqrt(ux * ux + uy * uy), F.lit(0.0))
    across = F.abs(ux * (F.col("y") - s("ay")) - uy * (F.col("x") - s("ax"))) / n
    along = (ux * (F.col("x") - s("ax")) + uy * (F.col("y") - s("ay"))) / n
    near = pairs.withColumn("d", across).filter((F.col("d") <= max_distance) & (along >= -0.1) & (along <= n + 0.1))
    return near.groupBy("traj_id", "frame_id", "pid").agg(F.min_by("b_s", F.struct("d", "b_seg")).alias("s"))


def localize(poses: DataFrame, points: DataFrame, lines: DataFrame, rounds: int = 3, max_distance: float = 1.0, prior: bool = True, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Poses (traj_id, frame_id, t, r, p) refined against the map.

    Odometry between consecutive frames comes from the poses as given; the
    first pose of a trajectory has a prior.  ``points`` carry ``sigma``.
    Trajectories are apart; each is solved in one task, ``window`` poses at a
    time: the next window takes up the last ``overlap`` of them where the one
    before left them, its first pose as a prior, so memory and time grow with
    the length alone.  Each round matches anew with what the last one found.
    """
    first = poses.select("traj_id", "frame_id", "t", F.col("r").alias("r0"), F.col("p").alias("p0"))
    now = cut(poses.select("traj_id", "frame_id", "t", "r", "p"), "poses")

    def solve(g: Group) -> Group:
        n = len(g["t"])
        r0, r = ([np.array(v, float).reshape(3, 3) for v in g[c]] for c in ("r0", "r"))
        p0, p = ([np.array(v, float) for v in g[c]] for c in ("p0", "p"))
        at = 0
        while True:
            end = min(n, at + window)
            w = kernels.Window(r[at:end], p[at:end])
            if at:
                w.priors = [(0, r[at], p[at])]
            elif prior:
                w.priors = [(0, r0[0], p0[0])]
            w.odometry = [(i - at, i + 1 - at, r0[i].T @ r0[i + 1], r0[i].T @ (p0[i + 1] - p0[i])) for i in range(at, end - 1)]
            for i in range(at, end):
                for m in g["m"][i] if g["m"][i] is not None else ():
                    m = m.asDict() if hasattr(m, "asDict") else m
                    s = m["s"].asDict() if hasattr(m["s"], "asDict") else m["s"]
                    w.lines.append((i - at, np.array([m["x"], m["y"], m["z"]]), np.array([s["ax"], s["ay"], s["az"]]), np.array([s["bx"], s["by"], s["bz"]]), float(m["sigma"])))
            if w.lines:
                kernels.solve_window(w)
                r[at:end], p[at:end] = w.r, w.t
            if end == n:
                break
            at = end - overlap
        return {"traj_id": g["traj_id"], "frame_id": g["frame_id"], "t": g["t"], "r": [a.ravel().tolist() for a in r], "p": [a.tolist() for a in p]}

    for _ in range(rounds):
        hits = matches(points, now, lines, max_distance).join(points, ["traj_id", "frame_id", "pid"])
        per = hits.groupBy("traj_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("pid", "x", "y", "z", "sigma", "s"))).alias("m"))
        rows = now.join(first.drop("t"), ["traj_id", "frame_id"]).join(per, ["traj_id", "frame_id"], "left")
        new = cut(by_group(rows, ["traj_id"], ["t", "frame_id"], solve, POSES), "poses")
        discard(now)
        now = new
    return now
