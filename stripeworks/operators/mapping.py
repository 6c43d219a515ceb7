"""The map: append, filter, cluster, merge, link, register, clean, match."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markings
from ..schema import RoadClass
from ..storage import cut, discard
from . import joins, kernels
from .components import components
from .grouped import Group, by_group

_BOXES = [RoadClass.DASHED.value, RoadClass.GUIDE.value]
_LINES = [RoadClass.SOLID.value, RoadClass.STOP.value]


def to_world(instances: DataFrame, poses: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Adds world coordinates (wx, wy) of the body-frame point (x, y): poses have frame, px, py and heading (c, s)."""
    j = instances.join(poses, frame)
    return j.withColumn("wx", F.col("px") + F.col("c") * F.col("x") - F.col("s") * F.col("y")).withColumn("wy", F.col("py") + F.col("s") * F.col("x") + F.col("c") * F.col("y"))


def drop_ignored(instances: DataFrame, ignored: DataFrame, frame: str = "frame_id", slack: float = 0.5) -> DataFrame:
    """Boxes and stop lines seen in an ignored frame from further than its distance plus ``slack`` go; solid lines stay."""
    j = instances.join(ignored.select(frame, F.col("distance").alias("__limit")), frame, "left")
    gone = F.col("__limit").isNotNull() & (F.col("percept_distance") > F.col("__limit") + slack) & F.col("road_class").isin(RoadClass.DASHED.value, RoadClass.GUIDE.value, RoadClass.STOP.value)
    return j.filter(~gone).drop("__limit")


def unfreeze(instances: DataFrame) -> DataFrame:
    return instances.withColumn("frozen", F.lit(False)).withColumn("merged", F.lit(False))


def clean_lines(lines: DataFrame, vertices: DataFrame, min_vertices: int = 5, min_length: float = 5.0) -> DataFrame:
    """Lines without a NaN vertex, with enough vertices, and long enough from end to end."""
    bad = F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()
    end = lambda pick, c: pick(c, "vtx")
    s = vertices.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(bad.cast("int")).alias("bad"), end(F.min_by, "x").alias("x0"), end(F.min_by, "y").alias("y0"), end(F.max_by, "x").alias("x1"), end(F.max_by, "y").alias("y1")
    )
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    kept = s.filter((F.col("bad") == 0) & (F.col("n") >= min_vertices) & (length >= min_length))
    return lines.join(kept.select("line_id", F.col("n").alias("vertices"), length.alias("length")), "line_id")


def clean_boxes(boxes: DataFrame, least: float = 0.01) -> DataFrame:
    """Boxes with finite centres and sides of at least ``least``."""
    ok = ~(F.isnan("x") | F.isnan("y")) & F.col("x").isNotNull() & F.col("y").isNotNull()
    return boxes.filter(ok & (F.col("h") >= least) & (F.col("w") >= least))


def clusters(nodes: DataFrame, pairs: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Every node with the smallest node it is linked to, directly or not (itself if with none)."""
    found = components(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")), cut, discard).select(F.col("node").alias(node), "component")
    return nodes.join(found, node, "left").withColumn("cluster", F.coalesce("component", node)).drop("component")


def box_clusters(boxes: DataFrame, size: float = 20.0) -> DataFrame:
    """Adds ``cluster`` to boxes: components of overlap within a class; frozen boxes alone.  ``size`` is that of the grid, not of the boxes."""
    return clusters(boxes, joins.rectangle_pairs(boxes, ["road_class"], size), "id", "id", "b_id")


def line_clusters(vertices: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``line_id, cluster``."""
    return clusters(vertices.select("line_id").distinct(), joins.polyline_pairs(vertices, on), "line_id", "line_id", "b_line_id")


MERGED_BOX = "cluster long, n int, best_id long, road_class int, percept_distance double, x double, y double, h double, w double, heading double, sigma array<double>, corners array<double>"


def merge_box_clusters(boxes: DataFrame, mode: int = 0) -> DataFrame:
    """One box per cluster from its sightings (x, y, h, w, yaw_deg, sigma0..3, road_class, percept_distance), the one with the smallest id first.

    Class and distance are those of the best member: seen from nearest among
    the ones not shorter than the upper median by more than 0.1.  Merged guide
    boxes of under 2 square metres, or shorter than 0.5 m, are dropped.
    A cluster is the sightings of one marking, a handful of rows.
    """
    def one(g: Group) -> Group | None:
        tall = g["h"] >= np.sort(g["h"])[len(g["h"]) // 2] - 0.1
        best = int(np.argmin(np.where(tall, g["percept_distance"], np.inf)))
        yaw = np.radians(g["yaw_deg"])
        along, across = np.column_stack((np.cos(yaw), np.sin(yaw))), np.column_stack((np.sin(yaw), -np.cos(yaw)))
        mean = np.column_stack((g["x"], g["y"]))
        h, w = g["h"][:, None] / 2, g["w"][:, None] / 2
        box = np.stack([mean - along * h - across * w, mean - along * h + across * w, mean + along * h + across * w, mean + along * h - across * w], axis=1)
        corners, sigma, heading = kernels.merge_boxes(mean, box, np.column_stack([g[f"sigma{i}"] for i in range(4)]), yaw, mode)
        x, y = corners.mean(0).tolist()
        h, w = float(np.linalg.norm(corners[2] - corners[1])), float(np.linalg.norm(corners[1] - corners[0]))
        if g["road_class"][best] == RoadClass.GUIDE.value and (h * w < 2.0 or h < 0.5):
            return None
        return {"cluster": int(g["cluster"][0]), "n": len(yaw), "best_id": int(g["id"][best]), "road_class": int(g["road_class"][best]), "percept_distance": float(g["percept_distance"][best]), "x": x, "y": y, "h": h, "w": w, "heading": heading, "sigma": [sigma.tolist()], "corners": [corners.ravel().tolist()]}

    cols = ["cluster", "id", "road_class", "percept_distance", "x", "y", "h", "w", "yaw_deg", *[f"sigma{i}" for i in range(4)]]
    return by_group(boxes.select(*cols), ["cluster"], ["id"], one, MERGED_BOX)


def merge_boxes(boxes: DataFrame, mode: int, vehicle: tuple[float, float, float] | None, active: float = 3.0) -> DataFrame:
    """The boxes of a map after merging: ``id`` is the cluster, ``state`` says what became of it.

    ``vehicle`` is (x, y, yaw in degrees), or None for the last merge.  Still
    active clusters pass unchanged (their members as they are); in mode 0
    singletons that are neither frozen nor merged are dropped once past; the
    rest is merged.
    """
    b = box_clusters(boxes)
    first = b.groupBy("cluster").agg(F.min_by(F.struct("x", "y", "frozen", "merged"), "id").alias("f"), F.count(F.lit(1)).alias("n"))
    lone = (F.col("n") == 1) & ~F.col("f.frozen")
    if vehicle is None:
        passes = lone
    else:
        vx, vy, yaw = vehicle
        c, s = float(np.cos(np.radians(yaw))), float(np.sin(np.radians(yaw)))
        ahead = (F.col("f.y") - vy) * c - (F.col("f.x") - vx) * s
        passes = (ahead > -active) if mode == 0 else F.lit(False)
    gone = lone & ~F.col("f.merged") if mode == 0 else F.lit(False)
    fate = F.when(passes, "passed").when(gone, "dropped").otherwise("merged")
    b = b.join(first.select("cluster", fate.alias("state")), "cluster")
    kept = b.filter("state = 'passed'").select("cluster", F.lit(1).alias("n"), F.col("id").alias("best_id"), "road_class", F.col("percept_distance").cast("double").alias("percept_distance"), "x", "y", "h", "w", F.radians("yaw_deg").alias("heading"), F.array("sigma0", "sigma1", "sigma2", "sigma3").alias("sigma"), "state")
    done = merge_box_clusters(b.filter("state = 'merged'"), mode).drop("corners").withColumn("state", F.lit("merged"))
    return kept.unionByName(done)


MERGED_LINE = "cluster long, n_lines int, vtx int, x double, y double, z double, variance double"


def merge_line_clusters(vertices: DataFrame, road_class: int = RoadClass.SOLID.value, forward_deg: float = 0.0) -> DataFrame:
    """One polyline per cluster from vertices (cluster, line_id, vtx, x, y, z, sigma); a line alone stays as it is."""
    smooth = 0.04 if road_class == RoadClass.SOLID.value else 0.0001
    forward = np.array([np.cos(np.radians(forward_deg)), np.sin(np.radians(forward_deg))])

    def one(g: Group) -> Group | None:
        n = len(np.unique(g["line_id"]))
        pts, sig = np.column_stack((g["x"], g["y"], g["z"])), g["sigma"]
        line, var = (pts, np.column_stack((sig**2, sig**2))) if n == 1 else kernels.fuse_lines(pts, sig, forward, smooth)
        if not len(line):
            return None
        return {"cluster": int(g["cluster"][0]), "n_lines": n, "vtx": list(range(len(line))), "x": line[:, 0], "y": line[:, 1], "z": line[:, 2], "variance": var[:, 0]}

    rows = vertices.select("cluster", "line_id", "vtx", "x", "y", "z", "sigma")
    return by_group(rows, ["cluster"], ["line_id", "vtx"], one, MERGED_LINE)


def freeze_flags(instances: DataFrame, vehicle: tuple[float, float, float] | None, distance: float = 10.0, longest: int = 50) -> DataFrame:
    """Sets ``frozen``: instances further than ``distance`` behind the vehicle, and lines of over ``longest`` vertices.

    Rows have x, y (a line's last vertex, a box's centre), vertices, road_class, frozen.  Without a vehicle, or with one
    at the origin as at the last merge, all lines freeze and boxes are judged from the origin.
    """
    vx, vy, yaw = vehicle or (0.0, 0.0, 0.0)
    c, s = float(np.cos(np.radians(yaw))), float(np.sin(np.radians(yaw)))
    behind = (F.col("y") - vy) * c - (F.col("x") - vx) * s < -distance
    long_line = F.col("road_class").isin(_LINES) & ((F.col("vertices") > longest) | F.lit(vx == 0 and vy == 0))
    return instances.withColumn("frozen", F.col("frozen") | (F.col("road_class").isin(_LINES + _BOXES) & (behind | long_line)))


def geo_register(points: DataFrame, links: DataFrame, old: DataFrame, new: DataFrame, point_id: str, frame: str = "frame_id") -> DataFrame:
    """Points moved from the old to the new trajectory: the mean over the linked frames of where each would put them.

    Frames without both poses are left out; a point without any is null and
    falls to cleaning.  Old and new poses have frame, px, py and heading (c, s).
    """
    n = new.select(frame, *[F.col(c).alias(f"n{c}") for c in ("px", "py", "c", "s")])
    j = links.join(points.select(point_id, "x", "y"), point_id).join(old, frame).join(n, frame)
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    bx, by = F.col("c") * dx + F.col("s") * dy, F.col("c") * dy - F.col("s") * dx
    j = j.withColumn("rx", F.col("npx") + F.col("nc") * bx - F.col("ns") * by).withColumn("ry", F.col("npy") + F.col("ns") * bx + F.col("nc") * by)
    mean = j.groupBy(point_id).agg(F.avg("rx").alias("rx"), F.avg("ry").alias("ry"), F.count(F.lit(1)).alias("links"))
    return points.join(mean, point_id, "left")


def match(queries: DataFrame, targets: DataFrame, radius: float = 20.0, strict: float | None = None, min_height: float = 1.5) -> DataFrame:
    """Instances of a frame with the nearest of the map within ``radius``, by class; ties by id.

    The search is in space, from height 0; the distance that comes out, and
    the one ``strict`` limits, is from the instance's own ``z``.
    Boxes must agree in length and width within 2 m, and under ``strict`` lie
    within that distance of a map box of at least ``min_height``.  The tests
    come after the choice of the nearest, as they do for a single neighbour.
    """
    q = queries.select("qid", "road_class", "x", "y", F.col("z").alias("qz"), F.col("h").alias("qh"), F.col("w").alias("qw"))
    t = targets.select("id", "road_class", "x", "y", "z", "h", "w")
    flat = (F.col("x") - F.col("b_x")) * (F.col("x") - F.col("b_x")) + (F.col("y") - F.col("b_y")) * (F.col("y") - F.col("b_y"))
    best = joins.radius_nearest(q, t, ["road_class"], "qid", "id", radius, flat + F.col("b_z") * F.col("b_z"))
    true2 = F.col("d2") - F.col("b_z") * F.col("b_z") + (F.col("b_z") - F.col("qz")) * (F.col("b_z") - F.col("qz"))
    best = best.withColumn("d2", F.greatest(true2, F.lit(0.0)))
    box = F.col("road_class").isin(_BOXES)
    ok = (F.abs(F.col("b_h") - F.col("qh")) <= 2.0) & (F.abs(F.col("b_w") - F.col("qw")) <= 2.0)
    if strict is not None:
        ok = ok & (F.col("d2") <= strict * strict) & (F.col("b_h") >= min_height)
    return best.filter(~box | ok).select("qid", "road_class", F.col("b_id").alias("id"), F.sqrt("d2").alias("distance"))


def sufficient(matches: DataFrame, frame: Column, least_lines: int = 2) -> DataFrame:
    """Matches of frames that have any matched box or stop line, or more than ``least_lines`` solid ones."""
    n = lambda c: F.sum((F.col("road_class") == c).cast("int"))
    counts = matches.groupBy(frame.alias("frame_id")).agg(n(RoadClass.DASHED.value).alias("d"), n(RoadClass.GUIDE.value).alias("g"), n(RoadClass.STOP.value).alias("st"), n(RoadClass.SOLID.value).alias("so"))
    good = counts.filter(f"not (d = 0 and g = 0 and st = 0 and so <= {least_lines})")
    return matches.withColumn("frame_id", frame).join(good.select("frame_id"), "frame_id", "left_semi")


def merge_maps(ours: DataFrame, theirs: DataFrame, shift: tuple[Column, Column] | None = None) -> DataFrame:
    """Theirs appended to ours with ids above ours, moved by ``shift``."""
    offset = ours.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("__o"))
    moved = theirs.join(F.broadcast(offset), F.lit(True))  # one row
    moved = moved.withColumn("id", F.col("id") + F.col("__o")).drop("__o")
    if shift is not None:
        moved = moved.withColumn("x", F.col("x") + shift[0]).withColumn("y", F.col("y") + shift[1])
    return ours.unionByName(moved)


def primitives(boxes: DataFrame) -> DataFrame:
    """What a viewer draws: four edges a box, coloured by sqrt of its variance on a ramp from green to red."""
    c, s = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg"))
    corner = lambda a, b: F.struct((F.col("x") + a * c * F.col("h") / 2 + b * s * F.col("w") / 2).alias("x"), (F.col("y") + a * s * F.col("h") / 2 - b * c * F.col("w") / 2).alias("y"))
    ring = F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))
    red = F.least(F.greatest(F.col("sigma0"), F.lit(0.0)), F.lit(1.0))
    edges = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("edge"), ring[i].alias("a"), ring[i + 1].alias("b")))
    e = boxes.withColumn("__r", red).withColumn("__e", F.explode(edges))
    return e.select("id", "road_class", F.col("__e.edge").alias("edge"), F.col("__e.a.x").alias("x0"), F.col("__e.a.y").alias("y0"), F.col("__e.b.x").alias("x1"), F.col("__e.b.y").alias("y1"), F.col("__r").alias("red"), (1 - F.col("__r")).alias("green"))


#: The colours of boxes, and the vehicle's height, length and width.
DASHED_COLOUR, OTHER_COLOUR, VEHICLE = (160 / 255, 160 / 255, 0.0), (0.0, 0.0, 160 / 255), (1.753, 1.849, 4.690)


def drawing(instances: DataFrame) -> DataFrame:
    """The stored map as polylines: ``id, road_class, points, colours`` (red, green, blue of each point).

    Only what may enter the map is drawn.  Lines are coloured by the sigma
    of each vertex, stop lines red; the rest by its four corners.  A line of
    another class, or of fewer than two points, has nothing to draw.
    """
    rgb = lambda c: F.array(*[F.lit(v) for v in c])
    solid, dashed = F.col("road_class") == RoadClass.SOLID.value, F.col("road_class") == RoadClass.DASHED.value
    by_vertex = F.transform("line_cov", lambda c: markings.error_colour(F.sqrt(c[0] + c[4])))
    line = F.when(solid, by_vertex).when(F.col("road_class") == RoadClass.STOP.value, F.transform("line", lambda _: rgb((1.0, 0.0, 0.0))))
    box = F.transform("box", lambda _: F.when(dashed, rgb(DASHED_COLOUR)).otherwise(rgb(OTHER_COLOUR)))
    out = instances.filter("valid_add_to_map").select(
        "id", "road_class", F.when(F.col("line_valid"), F.col("line")).otherwise(F.col("box")).alias("points"), F.when(F.col("line_valid"), line).otherwise(box).alias("colours")
    )
    return out.filter("colours is not null and size(points) >= 2")


def vehicles(poses: DataFrame) -> DataFrame:
    """Each pose as a black box of the vehicle's size: ``traj_id, t, centre, r, height, length, width, colour``."""
    return poses.select("traj_id", "t", F.col("pose.t").alias("centre"), F.col("pose.r").alias("r"), *_solid(VEHICLE, (0.0, 0.0, 0.0)))


def markers(points: DataFrame, keys: Sequence[str], colour: tuple[float, float, float], size: float = 0.3) -> DataFrame:
    """Points (x, y, z) as upright cubes."""
    level = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    return points.select(*keys, F.array("x", "y", "z").alias("centre"), level.alias("r"), *_solid((size,) * 3, colour))


def _solid(size: tuple, colour: tuple) -> list[Column]:
    return [*[F.lit(v).alias(n) for v, n in zip(size, ("height", "length", "width"))], F.array(*[F.lit(v) for v in colour]).alias("colour")]
