"""Aggregates: moments, axes, extents, fits, medians, representatives, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.markings import upper_median


def component_stats(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, bounding box, centroid and population covariance of the member pixels (row, col).

    Pixels are whole numbers, so the moments are exact sums and one division: no order of rows changes a bit of them.
    """
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    n = F.count(F.lit(1))
    exact = lambda a, b: (n * F.sum(a * b) - F.sum(a) * F.sum(b)).cast("double") / (n * n)
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("row").alias("top"),
        F.min("col").alias("left"),
        (F.max("row") - F.min("row") + 1).alias("height"),
        (F.max("col") - F.min("col") + 1).alias("width"),
        F.avg("row").alias("mean_row"),
        F.avg("col").alias("mean_col"),
        exact(r, r).alias("var_row"),
        exact(c, c).alias("var_col"),
        exact(r, c).alias("cov"),
    )


def majority_class(pixels: DataFrame, keys: Sequence[str], column: str = "road_class") -> DataFrame:
    """The most frequent class of each component; of equal ones the smallest."""
    n = pixels.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by(column, F.struct("n", (-F.col(column)).alias("c"))).alias(column), F.max("n").alias("votes"), F.sum("n").alias("pixels"))


def principal_axes(var_u: Column, var_v: Column, cov: Column) -> tuple[Column, Column, Column, Column]:
    """Standard deviations along and across the main direction of a 2 x 2 covariance, and that direction with v not negative."""
    mid, half = (var_u + var_v) / 2, F.sqrt(F.pow((var_u - var_v) / 2, 2.0) + cov * cov)
    angle = F.atan2(2 * cov, var_u - var_v) / 2
    sign = F.when(F.sin(angle) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.sqrt(mid + half), F.sqrt(F.greatest(mid - half, F.lit(0.0))), F.cos(angle) * sign, F.sin(angle) * sign


def cubic_moments(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """The sums behind the fit x = k0 + k1 y + k2 y^2 + k3 y^3."""
    sums = [F.sum(F.pow(F.col(y), float(i))).alias(f"s{i}") for i in range(7)] + [F.sum(F.col(x) * F.pow(F.col(y), float(i))).alias(f"b{i}") for i in range(4)]
    return points.groupBy(*keys).agg(*sums, F.sum(F.col(x) * F.col(x)).alias("xx"))


def fit_cubic(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficients ``k`` and root mean square ``rms`` from ``cubic_moments``; only the sums reach Python.

    A degenerate system (fewer than four distinct y) takes the least-norm solution.
    """
    def solve(batches):
        import pandas as pd

        for b in batches:
            s = b[[f"s{i}" for i in range(7)]].to_numpy()
            rhs = b[[f"b{i}" for i in range(4)]].to_numpy()
            a = np.stack([s[:, i : i + 4] for i in range(4)], axis=1)
            k = np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), rhs)
            sse = b["xx"].to_numpy() - 2 * (k * rhs).sum(1) + np.einsum("ni,nij,nj->n", k, a, k)
            out = b[list(keys)].copy()
            out["k"] = list(k)
            out["rms"] = np.sqrt(np.maximum(sse, 0) / s[:, 0])
            yield pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    return moments.mapInPandas(solve, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "k array<double>", "rms double"]))


def support_points(points: DataFrame, keys: Sequence[str], along: Column, across: Column, tie: str) -> DataFrame:
    """Ids of the extreme points along and across a direction; ties by the smaller id."""
    low = lambda v: F.min_by(tie, F.struct(v.alias("v"), F.col(tie).alias("t")))
    return points.groupBy(*keys).agg(low(along).alias("back"), low(-along).alias("front"), low(across).alias("left"), low(-across).alias("right"))


def upper_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Element n/2 of the sorted values of each cluster; clusters are sightings of one marking, so small."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[upper_median(F.collect_list(c)).alias(f"median_{c}") for c in columns])


def best_member(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """The member seen from nearest among those not shorter than the median by more than 0.1; ties by id."""
    med = df.groupBy(*keys).agg(upper_median(F.collect_list("h")).alias("median_h"))
    own = df.join(med, list(keys)).filter(F.col("h") >= F.col("median_h") - 0.1)
    return own.groupBy(*keys).agg(F.min_by(id_col, F.struct("percept_distance", id_col)).alias(id_col), F.first("median_h").alias("median_h"))


def enu_errors(truth: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """East, north and up errors of result positions, in the frame at the result; times that only one side has are left out.

    Latitude in stages, so that the expressions stay small.
    """
    both = truth.join(result, key)
    lat = geodesy.geodetic_latitude(F.col("X1"), F.col("Y1"), F.col("Z1"))
    both = both.withColumn("__lat", lat).withColumn("__lon", F.atan2(F.col("Y1"), F.col("X1")))
    r = geodesy.enu_rotation(F.col("__lat"), F.col("__lon"))
    d = [F.col(f"{c}1") - F.col(f"{c}0") for c in "XYZ"]
    east, north, up = (r[3 * i] * d[0] + r[3 * i + 1] * d[1] + r[3 * i + 2] * d[2] for i in range(3))
    return both.select(key, east.alias("east"), north.alias("north"), up.alias("up"))


def accuracy(errors: DataFrame) -> DataFrame:
    """Root mean square errors and the shares of frames within 1 m and 0.5 m, in percent."""
    h2 = F.col("east") * F.col("east") + F.col("north") * F.col("north")
    share = lambda limit: F.avg(F.when(F.sqrt(h2) < limit, 100.0).otherwise(0.0))
    return errors.agg(F.sqrt(F.avg(h2)).alias("rmse_h"), F.sqrt(F.avg(F.col("up") * F.col("up"))).alias("rmse_v"), share(1.0).alias("avail_1m"), share(0.5).alias("avail_05m"))


def circle_fit(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Centre by modified least squares, from nine moment sums in closed form, and the points' mean distance from it; null if the points are in line.

    Points are taken relative to their mean, so that the sums don't cancel far from the origin.
    """
    mean = points.groupBy(*keys).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    points = points.select(*keys, x, y).join(mean, list(keys)).withColumn(x, F.col(x) - F.col("__mx")).withColumn(y, F.col(y) - F.col("__my"))
    p = lambda i, j: F.sum(F.pow(F.col(x), float(i)) * F.pow(F.col(y), float(j)))
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *[p(i, j).alias(f"m{i}{j}") for i, j in ((1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))])
    c = F.col
    a = c("n") * c("m20") - c("m10") * c("m10")
    b = c("n") * c("m11") - c("m10") * c("m01")
    d = c("n") * c("m02") - c("m01") * c("m01")
    e = (c("n") * (c("m30") + c("m12")) - c("m10") * (c("m20") + c("m02"))) / 2
    f = (c("n") * (c("m21") + c("m03")) - c("m01") * (c("m20") + c("m02"))) / 2
    det = a * d - b * b
    fit = s.withColumn("cx", F.when(F.abs(det) > 1e-12, (d * e - b * f) / det)).withColumn("cy", F.when(F.abs(det) > 1e-12, (a * f - b * e) / det))
    far = points.join(fit.select(*keys, "cx", "cy"), list(keys))
    away = F.avg(F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")))
    return far.groupBy(*keys).agg((F.first("__mx") + F.first("cx")).alias("cx"), (F.first("__my") + F.first("cy")).alias("cy"), away.alias("radius"))


def rigid_alignment(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that take (x1, y1, z1) onto (x0, y0, z0), from cross-moment sums."""
    axes = "xyz"
    row = pairs.agg(
        *[F.avg(f"{a}{i}").alias(f"{a}{i}") for a in axes for i in (0, 1)], *[F.covar_pop(f"{a}1", f"{b}0").alias(f"c{a}{b}") for a in axes for b in axes]
    ).first()
    h = np.array([[row[f"c{a}{b}"] for b in axes] for a in axes])
    u, _, vt = np.linalg.svd(h)
    r = vt.T @ u.T
    m0, m1 = (np.array([row[f"{a}{i}"] for a in axes]) for i in (0, 1))
    return r, m0 - r @ m1


def reprojection_error(df: DataFrame, view: str, distance: Column) -> DataFrame:
    """Mean reprojection error of each view."""
    return df.groupBy(view).agg(F.avg(distance).alias("error"), F.count(F.lit(1)).alias("n"))
