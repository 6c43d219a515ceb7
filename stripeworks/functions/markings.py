"""Scalar functions of markings and text lines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RoadClass


def gray_to_class(gray: Column) -> Column:
    """Label image value to class: unknown positive labels are solid lines."""
    return (
        F.when(gray == 2, RoadClass.DASHED.value)
        .when(gray == 3, RoadClass.GUIDE.value)
        .when(gray == 4, RoadClass.ZEBRA.value)
        .when(gray == 5, RoadClass.STOP.value)
        .when(gray > 0, RoadClass.SOLID.value)
        .otherwise(RoadClass.EMPTY.value)
        .cast("int")
    )


def class_name(c: Column) -> Column:
    out = F.lit("unknown")
    for k in RoadClass:
        out = F.when(c == k.value, F.lit(k.name.lower())).otherwise(out)
    return out


def label_colour(label: Column) -> Column:
    """Blue, green, red of the labels 1 to 5."""
    table = {1: (0, 0, 255), 2: (0, 255, 0), 3: (255, 0, 0), 4: (0, 255, 255), 5: (255, 0, 255)}
    out = F.array(*[F.lit(0)] * 3)
    for k, v in table.items():
        out = F.when(label == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def valid_for_map(road_class: Column, h: Column, distance: Column, line_valid: Column, cfg) -> Column:
    """Whether an instance may enter the map; zebra crossings never do, as they are never valid lines."""
    dashed = (h > cfg.dashed_min_height) & (h < cfg.dashed_max_height) & (distance < cfg.dashed_max_distance)
    guide = (h > 0) & (h < cfg.guide_max_height) & (distance < cfg.guide_max_distance)
    return F.when(road_class == RoadClass.DASHED.value, dashed).when(road_class == RoadClass.GUIDE.value, guide).otherwise(line_valid)


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values, counted from 0."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def dewrap(angle: Column, first: Column) -> Column:
    """The angle's difference from ``first``, within half a turn."""
    return F.pmod(angle - first + 3 * math.pi, F.lit(2 * math.pi)) - math.pi


def point_line_distance(px, py, ax, ay, bx, by) -> Column:
    """Signed by the side: positive to the right of a -> b."""
    return ((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def file_stem(name: Column) -> Column:
    """The name before its first dot."""
    return F.substring_index(name, ".", 1)


def hhmmss_to_seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    return parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")


def nearly(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 2.220446049250313e-16


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def normalise_angle(x: Column) -> Column:
    """Into (-pi, pi]."""
    return math.pi - F.pmod(math.pi - x, F.lit(2 * math.pi))


def sinc(x: Column) -> Column:
    return F.coalesce(F.sin(x) / F.nullif(x, F.lit(0.0)), F.lit(1.0))


def circle_intersections(x0, y0, r0, x1, y1, r1) -> Column:
    """Array of the points (x, y) where two circles meet: none, one or two."""
    d = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    d = F.nullif(d, F.lit(0.0))
    a = (r0 * r0 - r1 * r1 + d * d) / (2 * d)
    h2 = r0 * r0 - a * a
    h = F.sqrt(F.greatest(h2, F.lit(0.0)))
    mx, my = x0 + a * (x1 - x0) / d, y0 + a * (y1 - y0) / d
    ox, oy = h * (y1 - y0) / d, h * (x1 - x0) / d
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    one, two = F.array(point(mx, my)), F.array(point(mx + ox, my - oy), point(mx - ox, my + oy))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(d.isNull() | (h2 < 0), none).when(h2 == 0, one).otherwise(two)


def raster_line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Array of the grid cells (x, y) of a line, one per step of its longer axis; the shorter one is rounded, halves towards the start."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    n = F.greatest(dx, dy)

    def at(a: Column, b: Column, d: Column, i: Column) -> Column:
        moved = F.floor((2 * i * d + n - 1) / F.nullif(2 * n, F.lit(0)))
        return (a + F.signum((b - a).cast("double")) * F.coalesce(moved, F.lit(0))).cast("int")

    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(at(x0, x1, dx, i).alias("x"), at(y0, y1, dy, i).alias("y")))


def raster_circle(cx: Column, cy: Column, radius: Column) -> Column:
    """Array of the distinct grid cells (x, y) of a disc of whole radius, row by row between the ends of its rim.

    The rim is the midpoint circle's: an octant runs from the top until its
    two coordinates meet, and its decision value says when to step down.
    """
    start = F.struct(F.lit(0).alias("x"), radius.alias("y"), (1 - radius).alias("f"), F.array(F.struct(F.lit(0).alias("v"), radius.alias("w")), F.struct(radius.alias("v"), F.lit(0).alias("w"))).alias("spans"))

    def step(s: Column, _: Column) -> Column:
        down = s["f"] >= 0
        x, y = s["x"] + 1, F.when(down, s["y"] - 1).otherwise(s["y"])
        f = s["f"] + F.when(down, -2 * y).otherwise(0) + 2 * x + 1
        spans = F.concat(s["spans"], F.array(F.struct(y.alias("v"), x.alias("w")), F.struct(x.alias("v"), y.alias("w"))))
        return F.when(s["x"] < s["y"], F.struct(x.alias("x"), y.alias("y"), f.alias("f"), spans.alias("spans"))).otherwise(s)

    # The column through the centre is part of the disc at every height.
    spans = F.concat(F.aggregate(F.sequence(F.lit(0), radius), start, step)["spans"], F.transform(F.sequence(F.lit(0), radius), lambda v: F.struct(v.alias("v"), F.lit(0).alias("w"))))
    row = lambda s, side: F.transform(F.sequence(-s["w"], s["w"]), lambda i: F.struct((cx + i).cast("int").alias("x"), (cy + side * s["v"]).cast("int").alias("y")))
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.concat(row(s, 1), row(s, -1)))))


def ramp_colour(i: Column, name: str = "jet") -> Column:
    """Red, green, blue (0 to 1) of step 0..127 of a ramp: ``jet`` from blue to red, ``autumn`` from red to yellow."""
    if name == "autumn":
        return F.array(F.lit(1.0), i / 127, F.lit(0.0))
    if name != "jet":
        raise ValueError(f"no ramp {name!r}: jet, autumn")
    v = (i + 1) / 32
    tent = lambda middle: clamp(1.5 - F.abs(v - middle), 0.0, 1.0)
    return F.array(tent(3.0), tent(2.0), tent(1.0))


def depth_colour(depth: Column, low: float, high: float) -> Column:
    """Blue, green, red (0 to 255) of a depth, red being near; zero is no depth and black."""
    i = 127 - (clamp((depth - low) / (high - low), 0.0, 1.0) * 127).cast("int")
    rgb = ramp_colour(i)
    seen = F.array(*[F.floor(rgb[k] * 255).cast("int") for k in (2, 1, 0)])
    return F.when(depth == 0, F.array(*[F.lit(0)] * 3)).otherwise(seen)


def error_colour(error: Column) -> Column:
    """Red, green, blue of a vertex by its horizontal sigma: green to yellow up to half a metre, then yellow to red; not clamped.

    The upper branch counts from one metre, as stored drawings have it, so it starts beyond yellow.
    """
    far, near = (error - 1) / 0.5, (error - 0.1) / 0.4
    return F.when(error > 0.5, F.array(F.lit(1.0), 1 - far, F.lit(0.0))).otherwise(F.array(near, F.lit(1.0), F.lit(0.0)))


def clock_difference(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6
