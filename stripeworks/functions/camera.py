"""Camera models and the camera-ground geometry as Columns.

A model is a plain dictionary of parameters; ``project`` and ``lift`` dispatch
on its ``model_type``.  Iterations are folds, so expressions stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import Mat, Vec, apply, literal, mul, transpose

Point2 = tuple[Column, Column]


def _fold(start: Point2, step: Callable[[Column, Column], Point2], n: int) -> Point2:
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(n)), pair(start), lambda s, _: pair(step(s.x, s.y)))
    return done.x, done.y


# --- distortion -----------------------------------------------------------------------------------


def radial_tangential(x: Column, y: Column, p: dict) -> Point2:
    """What distortion adds to a point of the normalised plane."""
    r2 = x * x + y * y
    radial = p["k1"] * r2 + p["k2"] * r2 * r2
    return x * radial + 2 * p["p1"] * x * y + p["p2"] * (r2 + 2 * x * x), y * radial + 2 * p["p2"] * x * y + p["p1"] * (r2 + 2 * y * y)


def _undistort(x: Column, y: Column, p: dict, steps: int = 8) -> Point2:
    def step(a: Column, b: Column) -> Point2:
        dx, dy = radial_tangential(a, b, p)
        return x - dx, y - dy

    return _fold((x, y), step, steps)


def rational(x: Column, y: Column, p: dict) -> tuple[Column, Column, Column]:
    """The radial factor and the tangential terms of the model with six coefficients."""
    r2 = x * x + y * y
    factor = (1 + r2 * (p["k1"] + r2 * (p["k2"] + r2 * p["k3"]))) / (1 + r2 * (p["k4"] + r2 * (p["k5"] + r2 * p["k6"])))
    return factor, 2 * p["p1"] * x * y + p["p2"] * (r2 + 2 * x * x), p["p1"] * (r2 + 2 * y * y) + 2 * p["p2"] * x * y


# --- pinhole --------------------------------------------------------------------------------------


def _pinhole_project(v: Vec, p: dict) -> Point2:
    x, y = v[0] / v[2], v[1] / v[2]
    dx, dy = radial_tangential(x, y, p)
    return p["fx"] * (x + dx) + p["cx"], p["fy"] * (y + dy) + p["cy"]


def _pinhole_lift(u: Column, v: Column, p: dict) -> Vec:
    x, y = _undistort((u - p["cx"]) / p["fx"], (v - p["cy"]) / p["fy"], p)
    return x, y, F.lit(1.0)


def _full_project(v: Vec, p: dict) -> Point2:
    x, y = v[0] / v[2], v[1] / v[2]
    k, tx, ty = rational(x, y, p)
    return p["fx"] * (x * k + tx) + p["cx"], p["fy"] * (y * k + ty) + p["cy"]


def _full_lift(u: Column, v: Column, p: dict) -> Vec:
    xd, yd = (u - p["cx"]) / p["fx"], (v - p["cy"]) / p["fy"]

    def step(a: Column, b: Column) -> Point2:
        k, tx, ty = rational(a, b, p)
        return (xd - tx) / k, (yd - ty) / k

    x, y = _fold((xd, yd), step, 9)
    return x, y, F.lit(1.0)


# --- catadioptric, with mirror parameter xi -------------------------------------------------------


def _mei_project(v: Vec, p: dict) -> Point2:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    z = v[2] / n + p["xi"]
    x, y = v[0] / n / z, v[1] / n / z
    dx, dy = radial_tangential(x, y, p)
    return p["gamma1"] * (x + dx) + p["u0"], p["gamma2"] * (y + dy) + p["v0"]


def _mei_lift(u: Column, v: Column, p: dict) -> Vec:
    x, y = _undistort((u - p["u0"]) / p["gamma1"], (v - p["v0"]) / p["gamma2"], p)
    r2 = x * x + y * y
    k = (p["xi"] + F.sqrt(1 + (1 - p["xi"] ** 2) * r2)) / (1 + r2)
    return k * x, k * y, k - p["xi"]


# --- equidistant ----------------------------------------------------------------------------------


def _theta_poly(t: Column, p: dict) -> Column:
    s = t * t
    return t * (1 + s * (p["k2"] + s * (p["k3"] + s * (p["k4"] + s * p["k5"]))))


def _equidistant_project(v: Vec, p: dict) -> Point2:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1])
    r = _theta_poly(F.atan2(n, v[2]), p)
    safe = F.when(n > 0, n).otherwise(F.lit(1.0))
    return p["mu"] * r * v[0] / safe + p["u0"], p["mv"] * r * v[1] / safe + p["v0"]


def _equidistant_lift(u: Column, v: Column, p: dict) -> Vec:
    """Newton's method from the undistorted angle, twelve steps."""
    x, y = (u - p["u0"]) / p["mu"], (v - p["v0"]) / p["mv"]
    r = F.sqrt(x * x + y * y)

    def step(t: Column, _: Column) -> Column:
        s = t * t
        slope = 1 + s * (3 * p["k2"] + s * (5 * p["k3"] + s * (7 * p["k4"] + s * 9 * p["k5"])))
        return t - (_theta_poly(t, p) - r) / slope

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(12)), r, step)
    safe = F.when(r > 0, r).otherwise(F.lit(1.0))
    return F.sin(theta) * x / safe, F.sin(theta) * y / safe, F.cos(theta)


# --- omnidirectional polynomial -------------------------------------------------------------------


def _horner(coefficients: list[float], x: Column) -> Column:
    """Constant first."""
    return F.aggregate(F.array(*literal(reversed(coefficients))), F.lit(0.0), lambda a, c: a * x + c)


def _scaramuzza_project(v: Vec, p: dict) -> Point2:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1])
    safe = F.when(n > 0, n).otherwise(F.lit(1.0))
    rho = _horner(p["inv_poly"], F.atan2(-v[2], n))
    x, y = v[0] / safe * rho, v[1] / safe * rho
    return x * p["ac"] + y * p["ad"] + p["cx"], x * p["ae"] + y + p["cy"]


def _scaramuzza_lift(u: Column, v: Column, p: dict) -> Vec:
    a, b = u - p["cx"], v - p["cy"]
    det = p["ac"] - p["ad"] * p["ae"]
    x, y = (a - p["ad"] * b) / det, (p["ac"] * b - p["ae"] * a) / det
    r = F.sqrt(x * x + y * y)
    return x, y, -_horner(p["poly"], r)


MODELS = {
    "pinhole": (_pinhole_project, _pinhole_lift),
    "pinhole_full": (_full_project, _full_lift),
    "mei": (_mei_project, _mei_lift),
    "kannala_brandt": (_equidistant_project, _equidistant_lift),
    "scaramuzza": (_scaramuzza_project, _scaramuzza_lift),
}


def _model(p: dict):
    kind = str(p.get("model_type", "pinhole")).lower()
    if kind not in MODELS:
        raise ValueError(f"no camera model {kind!r}: {', '.join(MODELS)}")
    return MODELS[kind]


def project(v: Vec, p: dict) -> Point2:
    """A point in the camera frame to pixels."""
    return _model(p)[0](v, p)


def lift(u: Column, v: Column, p: dict) -> Vec:
    """A pixel to a ray in the camera frame, of no particular length."""
    return _model(p)[1](u, v, p)


def virtual_pinhole(spark, p: dict) -> dict:
    """Pinhole intrinsics that span the view of any model: through the rays of two opposite image corners."""
    w, h = p["image_width"], p["image_height"]
    rays = [lift(F.lit(float(u)), F.lit(float(v)), p) for u, v in ((0, 0), (w - 1, h - 1))]
    (x0, y0), (x1, y1) = [(r[0] / r[2], r[1] / r[2]) for r in rays]
    r = spark.range(1).select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).first()
    fx, fy = (w - 1) / (r.x1 - r.x0), (h - 1) / (r.y1 - r.y0)
    return {"fx": fx, "fy": fy, "cx": -fx * r.x0, "cy": -fy * r.y0}


def reprojection_distance(v: Vec, u: Column, w: Column, p: dict) -> Column:
    a, b = project(v, p)
    return F.sqrt((a - u) * (a - u) + (b - w) * (b - w))


# --- camera over ground ---------------------------------------------------------------------------


def ground_rotation(alpha: Column, theta: Column) -> Mat:
    """Rz(alpha) Rx(theta): level frame to camera."""
    o, i = F.lit(0.0), F.lit(1.0)
    ca, sa, ct, st = F.cos(alpha), F.sin(alpha), F.cos(theta), F.sin(theta)
    return mul([ca, -sa, o, sa, ca, o, o, o, i], [i, o, o, o, ct, -st, o, st, ct])


def ground_normal(r: Mat) -> Vec:
    return -r[1], -r[4], -r[7]


def rotation_from_normal(n: Vec) -> Mat:
    """The least rotation that takes the ground's normal ``n``, of any length, to (0, -1, 0); straight down it is half a turn about x."""
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    x, y, z = (v / size for v in n)
    k = 1 / F.nullif(1 - y, F.lit(0.0))
    turn = [1 - x * x * k, x, -x * z * k, -x, -y, -z, -x * z * k, z, 1 - z * z * k]
    half = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)
    return [F.coalesce(v, F.when(n[1] > 0, F.lit(h))) for v, h in zip(turn, half)]


def ground_angles(r: Mat) -> Point2:
    """(alpha, theta) of a rotation."""
    return F.atan2(r[3], r[0]), F.atan2(r[7], r[8])


def ipm_to_metric(u: Column, v: Column, r: Mat, d: float, height: int, width: int, resolution: float) -> Vec:
    """A pixel of the bird's-eye raster to the camera frame."""
    return apply(r, ((u - width // 2) * resolution, F.lit(float(d)), (height - v - 1) * resolution))


def metric_to_ipm(p: Vec, r: Mat, height: int, width: int, resolution: float) -> Point2:
    q = apply(transpose(r), p)
    return q[0] / resolution + width // 2, height - 1 - q[2] / resolution


def ipm_to_perspective(u: Column, v: Column, r: Mat, d: float, height: int, width: int, resolution: float, k: dict) -> Point2:
    x, y, z = ipm_to_metric(u, v, r, d, height, width, resolution)
    return x / z * k["fx"] + k["cx"], y / z * k["fy"] + k["cy"]


def perspective_to_ground(u: Column, v: Column, r: Mat, d: float, k: dict) -> Vec:
    """Where the ray of a pixel meets the ground, in the level frame."""
    x, y, z = apply(transpose(r), ((u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"], F.lit(1.0)))
    return x * d / y, F.lit(float(d)), z * d / y


def perspective_to_metric(u: Column, v: Column, r: Mat, d: float, k: dict) -> Vec:
    return apply(r, perspective_to_ground(u, v, r, d, k))


def perspective_to_ipm(u: Column, v: Column, r: Mat, d: float, height: int, width: int, resolution: float, k: dict) -> Point2:
    x, _, z = perspective_to_ground(u, v, r, d, k)
    return x / resolution + width // 2, -z / resolution + height - 1


#: Fixed values of the error model: pixel and pitch noise, height noise in metres.
PIXEL_VAR, PITCH_SIGMA, HEIGHT_SIGMA = 4.0, 0.3 / 57.3, 0.05


def pixel_variances(u, v, d: float, height: int, width: int, resolution: float, fx: float, fy: float):
    """(xx, xy, yy) of a raster pixel in square metres, from pixel, pitch and height noise; for Columns and arrays alike."""
    xi = (u * resolution - width * resolution / 2) / d
    yi = (v * resolution - (height - 1) * resolution) / d
    k = d / resolution
    # with y = -1 / yi the derivatives have no pole left, not even on the row below the camera
    a, b, c = -k * yi / fx, k * xi * yi / fy, k * yi * yi / fy
    p0, p1 = -k * xi * yi, k * (1 + yi * yi)
    h0, h1 = xi / resolution, yi / resolution
    vp, vh, s = PITCH_SIGMA**2, HEIGHT_SIGMA**2, resolution * resolution
    xx = (PIXEL_VAR * (a * a + b * b) + vp * p0 * p0 + vh * h0 * h0) * s
    xy = (PIXEL_VAR * b * c + vp * p0 * p1 + vh * h0 * h1) * s
    yy = (PIXEL_VAR * c * c + vp * p1 * p1 + vh * h1 * h1) * s
    return xx, xy, yy


def pixel_uncertainty(u: Column, v: Column, d: float, height: int, width: int, resolution: float, fx: float, fy: float) -> Mat:
    """Covariance of a raster pixel, the height's sigma being half that ahead."""
    xx, xy, yy = pixel_variances(u, v, d, height, width, resolution, fx, fy)
    o = F.lit(0.0)
    return [xx, xy, o, xy, yy, o, o, o, yy / 4]
