"""The frame loop as streams: pose pairing, attitude state, keyframe window, periodic merges.

State is kept per vehicle (``seq_id``); frames of a micro-batch are taken in
the order of their time.  A frame that comes after a later one of its vehicle
has been taken is late and dropped, as the loop has no way back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import SlopeState


def pair_poses(stamps: DataFrame, poses: DataFrame, tolerance: str = "1 millisecond", delay: str = "10 seconds") -> DataFrame:
    """Stamps (stamp_ts, ...) with the poses (pose_ts, ...) within ``tolerance``; what has none in time is dropped.

    Of several poses within the tolerance all come out; at camera rates there is one.
    """
    s, p = stamps.withWatermark("stamp_ts", delay), poses.withWatermark("pose_ts", delay)
    near = F.expr(f"pose_ts >= stamp_ts - interval {tolerance} and pose_ts <= stamp_ts + interval {tolerance}")
    return s.join(p, near)


ATTITUDE = "seq_id long, pose_id long, diff_pitch double, diff_roll double, jump boolean, held int"


def attitude(poses: DataFrame, window: int = 20, threshold: float = 1.0) -> DataFrame:
    """The slope-reset window as a stream: rows (seq_id, pose_id, t_us, pitch_deg, roll_deg), one out for each in time."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            history, last, seen = state.get
            s = SlopeState(window, threshold, [tuple(x) for x in json.loads(history)], last)
        else:
            s, seen = SlopeState(window, threshold), -1
        rows = pd.concat(list(batches)).sort_values(["t_us", "pose_id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.t_us < seen:
                continue
            seen = r.t_us
            out.append((key[0], r.pose_id, *s.step(r.pitch_deg, r.roll_deg)))
        state.update((json.dumps(s.history), float(s.last), int(seen)))
        yield pd.DataFrame(out, columns=["seq_id", "pose_id", "diff_pitch", "diff_roll", "jump", "held"])

    return poses.groupBy("seq_id").applyInPandasWithState(step, ATTITUDE, "history string, last double, seen long", "append", GroupStateTimeout.NoTimeout)


WINDOW = "seq_id long, pose_id long, keyframe boolean, held int, evicted long"


def keyframe_window(poses: DataFrame, distance: float = 1.0, cap: int = 100) -> DataFrame:
    """The localisation window: a frame enters if it moved far enough from the last keyframe, else it replaces the frame before it.

    ``held`` is the window's size after the frame, ``evicted`` the oldest that fell out (null if none).
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], -1)
        out = []
        for r in pd.concat(list(batches)).sort_values(["t_us", "pose_id"]).itertuples(index=False):
            if r.t_us < seen:
                continue
            seen = r.t_us
            last = next((f for f in reversed(held) if f[3]), None)
            key_frame = last is None or ((r.x - last[1]) ** 2 + (r.y - last[2]) ** 2) ** 0.5 >= distance
            if held and not held[-1][3]:
                held.pop()  # a frame that was no keyframe only stood in for the newest
            held.append([int(r.pose_id), float(r.x), float(r.y), bool(key_frame)])
            gone = held.pop(0)[0] if len(held) > cap else None
            out.append((key[0], int(r.pose_id), key_frame, len(held), gone))
        state.update((json.dumps(held), int(seen)))
        df = pd.DataFrame(out, columns=["seq_id", "pose_id", "keyframe", "held", "evicted"])
        df["evicted"] = df["evicted"].astype("Int64")
        yield df

    return poses.groupBy("seq_id").applyInPandasWithState(step, WINDOW, "window string, seen long", "append", GroupStateTimeout.NoTimeout)


def spatial_watermark(instances: DataFrame, vehicle: DataFrame, behind: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(finalised, still active) instances: those further than ``behind`` behind their vehicle (seq_id, vx, vy, c, s) are done."""
    j = instances.join(vehicle, "seq_id")
    ahead = F.col("c") * (F.col("y") - F.col("vy")) - F.col("s") * (F.col("x") - F.col("vx"))
    j = j.withColumn("__done", ahead < -behind).drop("vx", "vy", "c", "s")
    return j.filter("__done").drop("__done"), j.filter("not __done").drop("__done")


def merge_every(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run ``merge(batch, epoch)`` on each micro-batch; a batch is the frames since the last merge."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
