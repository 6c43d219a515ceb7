"""Windows over frames: smoothing, resets, thinning, keyframes.

Plain windows where Spark has them; folds over a trajectory's array where each
step depends on what the last one decided.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import Group, by_group


def trailing_mean(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], n: int) -> DataFrame:
    """Adds ``mean_<c>`` over the last ``n`` rows, the current one included, and ``diff_<c>``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    for c in columns:
        df = df.withColumn(f"mean_{c}", F.avg(c).over(w)).withColumn(f"diff_{c}", F.col(c) - F.col(f"mean_{c}"))
    return df


class SlopeState:
    """Attitude history that starts anew when the mean pitch jumps.

    One call of ``step`` per frame; used by the batch fold and the stream alike.
    """

    def __init__(self, window: int, threshold: float, history: list | None = None, last: float = 0.0):
        self.window, self.threshold, self.history, self.last = window, threshold, history or [], last

    def step(self, pitch: float, roll: float) -> tuple[float, float, bool, int]:
        """(pitch and roll less their mean, whether a jump was found, frames held) after taking one frame, in degrees."""
        self.history = [*self.history, (pitch, roll)][-self.window :]
        n = len(self.history)
        # Added up in turn: the built-in sum makes up for rounding, and means that lie on the threshold would differ.
        mean = [functools.reduce(operator.add, (h[i] for h in self.history)) / n for i in (0, 1)]
        jump = abs(mean[0] - self.last) > self.threshold / self.window and n > 5
        if jump:
            self.history, self.last = [(pitch, roll)], pitch
        else:
            self.last = mean[0]
        return pitch - mean[0], roll - mean[1], jump, len(self.history)


SLOPE = "seq_id long, pose_id long, diff_pitch double, diff_roll double, jump boolean, held int"


def slope_reset(poses: DataFrame, window: int = 20, threshold: float = 1.0) -> DataFrame:
    """Per sequence, in the order of ``t_us``: smoothed attitude and the frames at which the history starts anew."""
    def fold(g: Group) -> Group:
        state = SlopeState(window, threshold)
        rows = [state.step(p, r) for p, r in zip(g["pitch_deg"].tolist(), g["roll_deg"].tolist())]
        return {"seq_id": g["seq_id"], "pose_id": g["pose_id"]} | {c: [r[i] for r in rows] for i, c in enumerate(("diff_pitch", "diff_roll", "jump", "held"))}

    return by_group(poses.select("seq_id", "pose_id", "t_us", "pitch_deg", "roll_deg"), ["seq_id"], ["t_us", "pose_id"], fold, SLOPE)


def ignored_frames(poses: DataFrame, jumps: DataFrame, back: int = 20, ahead: float = 13.5, right: float = 5.0) -> DataFrame:
    """Frames up to ``back`` before a jump, if the vehicle has moved less than ``ahead`` forward and ``right`` to the right (signed) since.

    ``seq_id, frame, distance``: distance is the forward move; of several jumps the oldest's is kept, as a frame is entered once.
    """
    w = Window.partitionBy("seq_id").orderBy("t_us", "pose_id")
    n = poses.withColumn("__n", F.row_number().over(w))
    at = n.join(jumps.select("seq_id", "pose_id"), ["seq_id", "pose_id"]).select("seq_id", F.col("__n").alias("__j"), F.col("x").alias("jx"), F.col("y").alias("jy"), F.explode(F.sequence(F.col("__n") - back, F.col("__n") - 1)).alias("__n"))
    both = n.join(at, ["seq_id", "__n"])
    c, s = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg"))
    dx, dy = F.col("jx") - F.col("x"), F.col("jy") - F.col("y")
    both = both.withColumn("__right", c * dx + s * dy).withColumn("distance", c * dy - s * dx)
    kept = both.filter((F.col("distance") < ahead) & (F.col("__right") < right))
    return kept.groupBy("seq_id", F.col("pose_id").alias("frame")).agg(F.min_by("distance", "__j").alias("distance"))


def relative_motion(poses: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the move (right, ahead, up, turn in degrees) since the previous pose, in that pose's frame; null at the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = {c: F.lag(c).over(w) for c in ("x", "y", "z", "yaw_deg")}
    df = poses
    for c, v in prev.items():
        df = df.withColumn(f"__{c}", v)
    cos, sin = F.cos(F.radians("__yaw_deg")), F.sin(F.radians("__yaw_deg"))
    dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    df = df.withColumn("right", cos * dx + sin * dy).withColumn("ahead", cos * dy - sin * dx).withColumn("up", F.col("z") - F.col("__z"))
    return df.withColumn("turn", F.pmod(F.col("yaw_deg") - F.col("__yaw_deg") + 180, F.lit(360.0)) - 180).drop(*[f"__{c}" for c in prev])


def every_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The rows 1, k+1, 2k+1, ... of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") % k == (1 % k)).drop("__n")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def thin(points: Column, interval: float) -> Column:
    """Of an array of structs with x and y those at least ``interval`` from the last one kept; the first counts from the origin."""
    def step(acc: Column, p: Column) -> Column:
        far = (p.x - acc.x) * (p.x - acc.x) + (p.y - acc.y) * (p.y - acc.y) >= interval * interval
        kept = F.when(far, F.concat(acc.kept, F.array(p))).otherwise(acc.kept)
        return F.struct(F.when(far, p.x).otherwise(acc.x).alias("x"), F.when(far, p.y).otherwise(acc.y).alias("y"), kept.alias("kept"))

    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.slice(points, 1, 0).alias("kept"))
    return F.aggregate(points, zero, step, lambda acc: acc.kept)


def keyframes(poses: DataFrame, keys: Sequence[str], order: str, distance: float, every: int = 5, newest_too: bool = True) -> DataFrame:
    """Keyframes of each group with their ordinal and whether they are matched.

    A frame is a keyframe if it is at least ``distance`` from the last
    keyframe; every ``every``-th is matched, and the newest frame is forced.
    """
    def fold(g: Group) -> Group:
        x, y = g["x"], g["y"]
        kept, last = [], None
        for i in range(len(x)):
            if last is None or np.hypot(x[i] - x[last], y[i] - y[last]) >= distance:
                kept.append(i)
                last = i
        out = {c: g[c][kept] for c in (*keys, "pose_id")}
        return out | {"ordinal": list(range(len(kept))), "matched": [i % every == 0 or newest_too and j == len(x) - 1 for i, j in enumerate(kept)]}

    schema = ", ".join([*[f"{k} long" for k in keys], "pose_id long", "ordinal long", "matched boolean"])
    return by_group(poses.select(*keys, "pose_id", order, "x", "y"), keys, [order, "pose_id"], fold, schema)


def curvature(df: DataFrame, line: str, order: str) -> DataFrame:
    """Adds the second differences (ddx, ddy) along each line; null at its ends."""
    w = Window.partitionBy(line).orderBy(order)
    second = lambda c: F.lag(c).over(w) - 2 * F.col(c) + F.lead(c).over(w)
    return df.withColumn("ddx", second("x")).withColumn("ddy", second("y"))
