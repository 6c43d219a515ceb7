"""Small vector and matrix algebra as Columns; matrices are arrays of nine doubles, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = list[Column]


def mat(c: Column) -> Mat:
    return [c[i] for i in range(9)]


def as_array(m: Mat | Vec) -> Column:
    return F.array(*m)


def mul(a: Mat, b: Mat) -> Mat:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(a: Mat) -> Mat:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply(a: Mat, v: Vec) -> Vec:
    return tuple(a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def rotate_cov(r: Mat, cov: Mat) -> Mat:
    """R C R^T."""
    return mul(mul(r, cov), transpose(r))


def literal(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named; folding projections can't copy it."""
    return F.transform(F.array(value), body)[0]
