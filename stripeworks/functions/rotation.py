"""Attitudes, quaternions and rotation vectors; att = (pitch, roll, yaw) in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import Mat, Vec


def euler_to_matrix(pitch: Column, roll: Column, yaw: Column) -> Mat:
    si, ci, sj, cj, sk, ck = F.sin(pitch), F.cos(pitch), F.sin(roll), F.cos(roll), F.sin(yaw), F.cos(yaw)
    return [
        cj * ck - si * sj * sk, -ci * sk, sj * ck + si * cj * sk,
        cj * sk + si * sj * ck, ci * ck, sj * sk - si * cj * ck,
        -ci * sj, si, ci * cj,
    ]


def matrix_to_euler(r: Mat) -> Vec:
    return F.asin(F.greatest(F.least(r[7], F.lit(1.0)), F.lit(-1.0))), F.atan2(-r[6], r[8]), F.atan2(-r[1], r[4])


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Mat:
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quaternion(m: Mat) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z), by the largest of trace and diagonal; unit length, sign as the branch gives it."""
    trace = m[0] + m[4] + m[8]
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    s0, s1 = 2 * root(trace + 1), 2 * root(1 + m[0] - m[4] - m[8])
    s2, s3 = 2 * root(1 + m[4] - m[0] - m[8]), 2 * root(1 + m[8] - m[0] - m[4])
    cases = [
        (s0 / 4, (m[7] - m[5]) / s0, (m[2] - m[6]) / s0, (m[3] - m[1]) / s0),
        ((m[7] - m[5]) / s1, s1 / 4, (m[1] + m[3]) / s1, (m[2] + m[6]) / s1),
        ((m[2] - m[6]) / s2, (m[1] + m[3]) / s2, s2 / 4, (m[5] + m[7]) / s2),
        ((m[3] - m[1]) / s3, (m[2] + m[6]) / s3, (m[5] + m[7]) / s3, s3 / 4),
    ]
    first, second = (m[0] >= m[4]) & (m[0] >= m[8]), m[4] >= m[8]
    return tuple(F.when(trace > 0, cases[0][i]).when(first, cases[1][i]).when(second, cases[2][i]).otherwise(cases[3][i]) for i in range(4))


def skew(v: Vec) -> Mat:
    o = F.lit(0.0)
    return [o, -v[2], v[1], v[2], o, -v[0], -v[1], v[0], o]


def rotvec_to_matrix(v: Vec) -> Mat:
    """Rodrigues' formula; series near zero."""
    n2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    n = F.sqrt(n2)
    small = n2 < 1e-8
    a = F.when(small, 1 - n2 / 6).otherwise(F.sin(n) / n)
    b = F.when(small, F.lit(0.5) - n2 / 24).otherwise((1 - F.cos(n)) / n2)
    x, y, z = v
    return [
        1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
        b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
        b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y),
    ]


def matrix_to_rotvec(m: Mat) -> Vec:
    """Through the quaternion, w made non-negative."""
    w, x, y, z = matrix_to_quaternion(m)
    sign = F.when(w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    w, x, y, z = w * sign, x * sign, y * sign, z * sign
    n = F.sqrt(x * x + y * y + z * z)
    k = F.when(n < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(n, w) / n)
    return x * k, y * k, z * k


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> Vec:
    return matrix_to_euler(quaternion_to_matrix(w, x, y, z))
