"""The mapping run of a drive: frames are appended, merged every so often, then registered, cleaned and merged for good.

A map is two tables.  Boxes: ``id, road_class, x, y, z, h, w, yaw_deg,
sigma0..3, percept_distance, frozen, merged, links``.  Line vertices:
``line_id, road_class, vtx, x, y, z, sigma, frozen, links``.  ``links`` are
the frames that had the point in view, at most ``RECENT`` + 1 of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera
from ..schema import CameraConfig, PipelineConfig, RoadClass
from ..storage import cut, discard
from . import joins, mapping
from .windows import every_k

RECENT = 200
SIGMAS = [f"sigma{i}" for i in range(4)]
BOX = ["id", "road_class", "x", "y", "z", "h", "w", "yaw_deg", *SIGMAS, "percept_distance"]
VERTEX = ["line_id", "road_class", "vtx", "x", "y", "z", "sigma"]
Map = tuple[DataFrame, DataFrame]
Vehicle = tuple[float, float, float] | None


def boxes_of(world: DataFrame) -> DataFrame:
    """Box rows of extracted instances in world coordinates that are valid for the map; ``id`` numbers frame and instance."""
    p = lambda i, c: F.col("box")[i][c]
    mid = lambda c: ((p(0, c) + p(1, c) + p(2, c) + p(3, c)) / 4).alias(c)
    yaw = F.degrees(F.atan2(p(2, "y") - p(1, "y"), p(2, "x") - p(1, "x"))).alias("yaw_deg")
    ok = world.filter(F.col("valid_add_to_map") & F.col("road_class").isin(RoadClass.DASHED.value, RoadClass.GUIDE.value))
    return ok.select("frame_id", _number().alias("id"), "road_class", mid("x"), mid("y"), mid("z"), "h", "w", yaw, *[F.col("edge_sigma")[i].alias(s) for i, s in enumerate(SIGMAS)], "percept_distance")


def vertices_of(world: DataFrame, cam: CameraConfig) -> DataFrame:
    """Vertex rows of the lines; a vertex's sigma is the root of the mean variance of its pixel in the plane."""
    ok = world.filter(F.col("valid_add_to_map") & F.col("road_class").isin(RoadClass.SOLID.value, RoadClass.STOP.value))
    v = ok.select("frame_id", _number().alias("line_id"), "road_class", F.posexplode(F.arrays_zip("line", "line_m")).alias("vtx", "p"))
    xx, _, yy = camera.pixel_variances(F.col("p.line.u"), F.col("p.line.v"), cam.h, cam.height, cam.width, cam.resolution, cam.intrinsics["fx"], cam.intrinsics["fy"])
    return v.select("frame_id", "line_id", "road_class", "vtx", *[F.col(f"p.line_m.{c}").alias(c) for c in "xyz"], F.sqrt((xx + yy) / 2).alias("sigma"))


def _number():
    return F.col("frame_id") * 4096 + F.col("k")


def _fresh(rows: DataFrame, boxes: bool) -> DataFrame:
    new = rows.select(*(BOX if boxes else VERTEX)).withColumn("frozen", F.lit(False))
    if boxes:
        new = new.withColumn("merged", F.lit(False))
    return new.withColumn("links", F.array().cast("array<long>"))


def merge_boxes(boxes: DataFrame, mode: int, vehicle: Vehicle, active: float) -> DataFrame:
    """``mapping.merge_boxes`` on map rows; a merged box has what else its best member has."""
    out = mapping.merge_boxes(boxes, mode, vehicle, active)
    rows = out.select(F.col("best_id").alias("id"), "road_class", "x", "y", "h", "w", F.degrees("heading").alias("yaw_deg"), *[F.col("sigma")[i].alias(s) for i, s in enumerate(SIGMAS)], "percept_distance", (F.col("state") == "merged").alias("now"))
    rest = boxes.select("id", "z", "frozen", F.col("merged").alias("before"), "links")
    return rows.join(rest, "id").withColumn("merged", F.col("now") | F.col("before")).select(*BOX, "frozen", "merged", "links")


def merge_lines(vertices: DataFrame, forward_deg: float) -> DataFrame:
    """Lines of a class that run along each other made one; frozen ones and lines alone stay as they are."""
    pairs = joins.polyline_pairs(vertices.filter(~F.col("frozen")), ["road_class"])
    found = cut(mapping.clusters(vertices.select("line_id").distinct(), pairs, "line_id", "line_id", "b_line_id"), "line-clusters")
    v = vertices.join(found, "line_id")
    made = []
    for c in (RoadClass.SOLID.value, RoadClass.STOP.value):
        one = mapping.merge_line_clusters(v.filter(F.col("road_class") == c), c, forward_deg)
        made.append(one.withColumn("road_class", F.lit(c)))
    out = made[0].unionByName(made[1]).select(F.col("cluster").alias("line_id"), "n_lines", "road_class", "vtx", "x", "y", "z", F.sqrt("variance").alias("sigma"))
    alone = vertices.select("line_id", "vtx", F.lit(1).alias("n_lines"), "frozen", "links")
    out = out.join(alone, ["line_id", "vtx", "n_lines"], "left")
    return out.select(*VERTEX, F.coalesce("frozen", F.lit(False)).alias("frozen"), F.coalesce("links", F.array().cast("array<long>")).alias("links"))


def relink(m: Map, frames: DataFrame) -> Map:
    """``links`` of what is not frozen: the latest of ``frames`` (frame_id, fx, fy, c, s) that have it in view."""
    boxes, vertices = m
    box, vtx = F.struct("id", F.lit(-1).alias("vtx")), F.struct(F.col("line_id").alias("id"), "vtx")
    points = boxes.filter(~F.col("frozen")).select(box.alias("pid"), "x", "y").unionByName(vertices.filter(~F.col("frozen")).select(vtx.alias("pid"), "x", "y"))
    seen = joins.region_links(points, frames, "pid", "frame_id", RECENT).groupBy("pid").agg(F.array_sort(F.collect_list("frame_id")).alias("now"))
    seen = cut(seen, "map-links")

    def renew(rows: DataFrame, pid) -> DataFrame:
        j = rows.withColumn("pid", pid).join(seen, "pid", "left")
        return j.withColumn("links", F.when(F.col("frozen"), F.col("links")).otherwise(F.coalesce("now", F.array().cast("array<long>")))).drop("pid", "now")

    return renew(boxes, box), renew(vertices, vtx)


def freeze(m: Map, vehicle: Vehicle, cfg: PipelineConfig) -> Map:
    boxes, vertices = m
    b = mapping.freeze_flags(boxes.withColumn("vertices", F.lit(0)), vehicle, cfg.freeze_line_distance, cfg.freeze_line_length).drop("vertices")
    ends = vertices.groupBy("line_id", "road_class").agg(F.max_by("x", "vtx").alias("x"), F.max_by("y", "vtx").alias("y"), F.count(F.lit(1)).alias("vertices"), F.bool_or("frozen").alias("frozen"))
    flags = mapping.freeze_flags(ends, vehicle, cfg.freeze_line_distance, cfg.freeze_line_length).select("line_id", "frozen")
    return b, vertices.drop("frozen").join(flags, "line_id")


def register(m: Map, old: DataFrame, new: DataFrame) -> Map:
    """What is frozen moved to the ``new`` trajectory by its links; the rest stays where it is.

    A box is moved by its middle and by the point a metre ahead of it, so its
    sides keep their length; what no linked frame places has no position.
    """
    boxes, vertices = m

    def moved(points: DataFrame) -> DataFrame:
        p = cut(points, "map-points")
        return mapping.geo_register(p.select("pid", "x", "y"), p.select("pid", F.explode("links").alias("frame_id")), old, new, "pid").select("pid", "rx", "ry")

    frozen = boxes.filter("frozen")
    tip = F.radians("yaw_deg")
    at = [F.struct("id", F.lit(k).alias("k")).alias("pid") for k in (0, 1)]
    two = frozen.select(at[0], "x", "y", "links").unionByName(frozen.select(at[1], (F.col("x") + F.cos(tip)).alias("x"), (F.col("y") + F.sin(tip)).alias("y"), "links"))
    pick = lambda c, k: F.max(F.when(F.col("pid.k") == k, F.col(c))).alias(f"{c}{k}")
    pos = moved(two).groupBy("pid.id").agg(*[pick(c, k) for c in ("rx", "ry") for k in (0, 1)])
    b = frozen.join(pos, "id").withColumn("x", F.col("rx0")).withColumn("y", F.col("ry0")).withColumn("yaw_deg", F.degrees(F.atan2(F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0"))))
    pid = F.struct("line_id", "vtx")
    held = vertices.filter("frozen").withColumn("pid", pid)
    v = held.join(moved(held), "pid").withColumn("x", F.col("rx")).withColumn("y", F.col("ry"))
    return boxes.filter(~F.col("frozen")).unionByName(b.select(boxes.columns)), vertices.filter(~F.col("frozen")).unionByName(v.select(vertices.columns))


def clean(m: Map) -> Map:
    boxes, vertices = m
    kept = mapping.clean_lines(vertices.select("line_id").distinct(), vertices).select("line_id")
    return mapping.clean_boxes(boxes), vertices.join(kept, "line_id", "left_semi")


def build(boxes: DataFrame, vertices: DataFrame, poses: DataFrame, truth: DataFrame | None = None, cfg: PipelineConfig | None = None) -> Map:
    """The map of one drive from its sightings in odometry coordinates.

    ``boxes`` and ``vertices`` are map rows with ``frame_id`` (``boxes_of``,
    ``vertices_of``); poses have ``frame_id, px, py, c, s``.  At frames 1,
    1 + step, ... the map is merged with what was seen since, linked and
    frozen; then it is registered to ``truth`` (the poses themselves if None),
    cleaned, unfrozen and merged once more.  No sightings give an empty map.

    The merges depend on each other and follow in turn, each over the map so
    far; one row a merge comes to the driver.  Drives are built apart.
    """
    cfg = cfg or PipelineConfig()
    old = cut(poses.select("frame_id", "px", "py", "c", "s"), "map-poses")
    stops = every_k(old.withColumn("one", F.lit(0)), ["one"], ["frame_id"], cfg.mapping_step).orderBy("frame_id").select("frame_id", "px", "py", F.degrees(F.atan2("s", "c")).alias("yaw")).collect()
    frames = old.withColumnRenamed("px", "fx").withColumnRenamed("py", "fy")
    state: Map = (_fresh(boxes.limit(0), True), _fresh(vertices.limit(0), False))
    last = None
    for stop in [*stops, None]:
        upto = F.lit(True) if stop is None else F.col("frame_id") <= stop.frame_id
        if last is not None:
            upto = upto & (F.col("frame_id") > last)
        b, v = state[0].unionByName(_fresh(boxes.filter(upto), True)), state[1].unionByName(_fresh(vertices.filter(upto), False))
        if stop is None:
            state = (b, v)
            break
        last = stop.frame_id
        vehicle = (stop.px, stop.py, stop.yaw) if stop.px or stop.py else None
        grown = _kept((b, v))
        met = _kept((merge_boxes(grown[0], 0, vehicle, cfg.active_distance), merge_lines(grown[1], stop.yaw + 90)))
        new = _kept(freeze(relink(met, frames.filter(F.col("frame_id") <= last)), vehicle, cfg))
        for t in (*state, *grown, *met):
            discard(t)
        state = new
    b, v = _kept(clean(register(state, old, old if truth is None else truth)))
    return merge_boxes(mapping.unfreeze(b), 1, None, cfg.active_distance), merge_lines(v.withColumn("frozen", F.lit(False)), 90.0)


def _kept(m: Map) -> Map:
    return cut(m[0], "map-boxes"), cut(m[1], "map-lines")
