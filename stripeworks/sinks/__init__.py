"""Text sinks; binary maps and calibrations are written by their readers' modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, linear, rotation


def pose_lines(poses: DataFrame, ref: tuple[float, float, float]) -> DataFrame:
    """Result lines ``t X Y Z qw qx qy qz``: ECEF to the millimetre, attitude in the local frame at the new position.

    ``poses`` has t and the struct ``pose`` in the frame at ``ref``.
    """
    here = linear.literal(ref)
    r0 = F.array(*geodesy.enu_rotation_at(tuple(here)))

    def ecef(m: Column, pose: Column) -> Column:
        local = tuple(pose["t"][i] for i in range(3))
        return F.array(*[a + b for a, b in zip(linear.apply(linear.transpose(linear.mat(m)), local), here)])

    def attitude(m: Column, x: Column, pose: Column) -> Column:
        at = tuple(x[i] for i in range(3))
        turn = linear.let(F.array(*geodesy.enu_rotation(geodesy.geodetic_latitude(*at), F.atan2(at[1], at[0]))), lambda r1: F.array(*linear.mul(linear.mat(r1), linear.transpose(linear.mat(m)))))
        local = linear.let(turn, lambda k: F.array(*linear.mul(linear.mat(k), linear.mat(pose["r"]))))
        return linear.let(local, lambda r: F.array(*rotation.matrix_to_quaternion(linear.mat(r))))

    form = "%.3f %.3f %.3f %.3f %.10f %.10f %.10f %.10f"
    line = lambda pose, x, q: F.format_string(form, F.col("t"), *[x[i] for i in range(3)], *[q[i] for i in range(4)])
    value = linear.let(r0, lambda m: linear.let(F.col("pose"), lambda pose: linear.let(ecef(m, pose), lambda x: linear.let(attitude(m, x, pose), lambda q: line(pose, x, q)))))
    return poses.select("t", value.alias("value"))


def write_poses(poses: DataFrame, ref: tuple[float, float, float], path: str) -> None:
    """Part files in the order of time, ranges apart."""
    pose_lines(poses, ref).repartitionByRange("t").sortWithinPartitions("t").select("value").write.text(path)


def write_stamps(stamps: DataFrame, path: str) -> None:
    lines = stamps.select("t", F.format_string("%.6f %s", F.col("t"), F.col("image")).alias("value"))
    lines.repartitionByRange("t").sortWithinPartitions("t").select("value").write.text(path)
