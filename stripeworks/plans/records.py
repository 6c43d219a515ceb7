"""Queries over the stored formats, drawing and small helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import sinks
from ..functions import camera, geodesy, linear, markings, rotation
from ..operators import aggregates, mapping
from ..schema import RoadClass
from ..sources import binary_map, images, text
from . import d6, query, r6
from .fixtures import PINHOLE, frame, sql, to_duck
from .poses import ERRORS, GT, MATRIX, POSE, QUAT, RAD, RES, _quaternion

#: The origin of the local frame, near the fixtures' positions.
REF = (-2267800.0, 5009300.0, 3221000.0)


def _east_north_up() -> list[float]:
    x, y, z = REF
    p = math.hypot(x, y)
    lat, lon = math.atan2(z, p * (1 - geodesy.E2)), math.atan2(y, x)
    for _ in range(6):
        s = math.sin(lat)
        lat = math.atan2(z + geodesy.E2 * (geodesy.A / math.sqrt(1 - geodesy.E2 * s * s)) * s, p)
    sa, ca, so, co = math.sin(lat), math.cos(lat), math.sin(lon), math.cos(lon)
    return [-so, co, 0.0, -sa * co, -sa * so, ca, ca * co, ca * so, sa]


R0 = _east_north_up()


def _product(a: list[str], b: list[str]) -> list[str]:
    """The product of two matrices of SQL expressions."""
    return [" + ".join(f"({a[3 * i + k]})*({b[3 * k + j]})" for k in range(3)) for i in range(3) for j in range(3)]


def _named(exprs: list[str], name: str) -> str:
    return ", ".join(f"{e} as {name}{i}" for i, e in enumerate(exprs))


# --- text formats ---------------------------------------------------------------------------------

#: What the lines hold, by the formats' names of columns; a time comes twice, and the later line wins.
FIELDS = {
    "t": "cast(pose_id div 2 as double)", "week": "2200", "x": "-2267800.0D + x", "y": "5009300.0D + y", "z": "3221000.0D + z",
    "vx": "(pose_id % 17) / 4.0D", "vy": "(pose_id % 19) / 4.0D", "vz": "(pose_id % 23) / 4.0D", "pitch": "pitch_deg", "roll": "roll_deg", "yaw": "yaw_deg",
    "nsat": "8 + pose_id % 13", "amb": "if(pose_id % 7 = 0, 'Float', 'Fixed')", "meas": "'LC'", "qw": "w", "qx": "qx", "qy": "qy", "qz": "qz",
}


def _file(df, names: tuple):
    """Lines of a format over ``df``, every 50th followed by a comment's mark in front, as in files with notes."""
    body = F.concat_ws(",", *[F.expr(FIELDS.get(n, "0") if n else "0").cast("string") for n in names])
    return df.select(F.when(F.col("pose_id") % 50 == 49, F.concat(F.lit("# "), body)).otherwise(body).alias("value"), F.col("pose_id").alias("line_no"))


_LAST = f"select * from (select *, pose_id // 2 as t from ({MATRIX}) where pose_id % 50 <> 49) qualify row_number() over (partition by t order by pose_id desc) = 1"
_AT = ", ".join(d6(f"({R0[3 * i]!r})*dx + ({R0[3 * i + 1]!r})*dy + ({R0[3 * i + 2]!r})*dz", "e" if i == 0 else "nu"[i - 1]) for i in range(3))
_SPEED = ", ".join(d6(f"({R0[3 * i]!r})*vx + ({R0[3 * i + 1]!r})*vy + ({R0[3 * i + 2]!r})*vz", f"v{i}") for i in range(3))
_MOVED = to_duck(f"select *, (-2267800.0D + x) - (-2267800.0D) as dx, (5009300.0D + y) - 5009300.0D as dy, (3221000.0D + z) - 3221000.0D as dz, {FIELDS['vx']} as vx, {FIELDS['vy']} as vy, {FIELDS['vz']} as vz")
_TIMES = "t::double as t"
_TURNED = MATRIX.replace(f"yaw_deg * {RAD!r} as w", f"yaw_deg * {-RAD!r} as w")


def _solution_sql(turned: bool, attitude: bool, speed: bool, valid: str) -> str:
    source = _LAST.replace(MATRIX, _TURNED) if turned else _LAST
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    m = ", ".join(d6(f"m{i}", f"m{i}") if attitude else f"{v!r}::DOUBLE as m{i}" for i, v in enumerate(unit))
    return f"select {_TIMES}, {_AT}, {m}{', ' + _SPEED if speed else ''}, {valid} as valid from ({_MOVED} from ({source}))"


def _flat(poses, speed: bool):
    p = [F.col("pose.t")[i] for i in range(3)]
    v = [r6(F.col("pose.v")[i]).alias(f"v{i}") for i in range(3)] if speed else []
    return poses.select("t", *[r6(c).alias(n) for c, n in zip(p, "enu")], *[r6(F.col("pose.r")[i]).alias(f"m{i}") for i in range(9)], *v, F.col("pose.valid").alias("valid"))


_GOOD = "(pose_id % 7 <> 0 and 8 + pose_id % 13 >= 12)"


@query(_solution_sql(False, True, True, "true"))
def vio_file(spark, sf_dir):
    return _flat(text.vio(_file(frame(spark, sf_dir, "pose"), text.VIO), REF), True)


@query(_solution_sql(True, True, True, _GOOD))
def fused_file(spark, sf_dir):
    return _flat(text.fused(_file(frame(spark, sf_dir, "pose"), text.FUSED), REF), True)


@query(_solution_sql(False, False, True, _GOOD))
def gnss_file(spark, sf_dir):
    return _flat(text.gnss(_file(frame(spark, sf_dir, "pose"), text.GNSS), REF), True)


@query(_solution_sql(True, True, False, "true"))
def inertial_file(spark, sf_dir):
    return _flat(text.inertial(_file(frame(spark, sf_dir, "pose"), text.INERTIAL), REF), False)


def _quaternion_file(spark, sf_dir):
    pose = frame(spark, sf_dir, "pose").select("pose_id", *"xyz")
    q = _quaternion(pose).select(F.col("pose_id"), "w", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    return _file(pose.join(q, "pose_id"), text.POSES)


_Q = ["1-2*(qy*qy+qz*qz)", "2*(qx*qy-w*qz)", "2*(qx*qz+w*qy)", "2*(qx*qy+w*qz)", "1-2*(qx*qx+qz*qz)", "2*(qy*qz-w*qx)", "2*(qx*qz-w*qy)", "2*(qy*qz+w*qx)", "1-2*(qx*qx+qy*qy)"]
_QUATERNIONS = f"""select * from (select p.pose_id, p.pose_id // 2 as t, p.x, p.y, p.z, q.w, q.x as qx, q.y as qy, q.z as qz from ({POSE}) p join ({QUAT}) q using (pose_id)
where p.pose_id % 50 <> 49) qualify row_number() over (partition by t order by pose_id desc) = 1"""


@query(
    f"select {_TIMES}, {', '.join(d6(f'{o!r} + {c}', n) for o, c, n in zip(REF, 'xyz', 'enu'))}, {', '.join(d6(e, f'm{i}') for i, e in enumerate(_Q))}, true as valid from ({_QUATERNIONS})"
)
def local_file(spark, sf_dir):
    return _flat(text.local_trajectory_from(_quaternion_file(spark, sf_dir)), False)


def _global_sql() -> str:
    from .poses import latitude_sql

    at = latitude_sql(f"select *, {REF[0]!r} + x as gx, {REF[1]!r} + y as gy, {REF[2]!r} + z as gz from ({_QUATERNIONS})", "gx", "gy", "gz")
    sines = f"select *, gx - ({REF[0]!r}) as dx, gy - {REF[1]!r} as dy, gz - {REF[2]!r} as dz, sin(lat) as sa, cos(lat) as ca, sin(lon) as so, cos(lon) as co from (select *, atan2(gy, gx) as lon from ({at}))"
    down = ["-so", "-sa*co", "ca*co", "co", "-sa*so", "ca*so", "0.0::DOUBLE", "ca", "sa"]
    turn = f"select *, {_named(_product([repr(v) for v in R0], down), 'k')}, {_named(_Q, 'q')} from ({sines})"
    m = _product([f"k{i}" for i in range(9)], [f"q{i}" for i in range(9)])
    return f"select {_TIMES}, {_AT}, {', '.join(d6(e, f'm{i}') for i, e in enumerate(m))}, true as valid from ({turn})"


@query(_global_sql())
def global_file(spark, sf_dir):
    poses, _ = text.global_trajectory_from(_quaternion_file(spark, sf_dir), ref=REF)
    return _flat(poses, False)


@query(f"select t::double as t, {REF[0]!r} + x as x, {REF[1]!r} + y as y, w as qw from ({_QUATERNIONS.replace('// 2', '// 1')}) where pose_id < (select (max(pose_id) // 20) * 10 from ({POSE})) and t >= 100")
def result_file(spark, sf_dir):
    """A result file with notes, up to the blank line in its middle, from a start time on."""
    lines = _quaternion_file(spark, sf_dir)
    stop = lines.agg((F.expr("max(line_no) div 20") * 10).alias("__at"))
    lines = lines.join(F.broadcast(stop), F.lit(True)).select(F.when(F.col("line_no") == F.col("__at"), "").otherwise(F.col("value")).alias("value"), "line_no")  # one row
    # Here each line has a time of its own: its number.
    lines = lines.withColumn("value", F.regexp_replace("value", "^[^,#]+", F.col("line_no").cast("double").cast("string")))
    return text.result_poses(lines, start=100.0).select("t", "x", "y", "qw")


_BACK = [f"round({REF[i]!r} + (({R0[i]!r})*x + ({R0[3 + i]!r})*y + ({R0[6 + i]!r})*z), 3) + 0.0::DOUBLE as {'xyz'[i]}" for i in range(3)]


@query(f"select pose_id::double as t, {', '.join(_BACK)} from ({POSE})")
def pose_lines(spark, sf_dir):
    """Local poses as result lines, and the lines read again."""
    p = frame(spark, sf_dir, "pose")
    m = rotation.euler_to_matrix(*[F.col(c) * RAD for c in ("pitch_deg", "roll_deg", "yaw_deg")])
    poses = p.select(F.col("pose_id").cast("double").alias("t"), F.struct(F.array(*m).alias("r"), F.array("x", "y", "z").alias("t")).alias("pose"))
    lines = sinks.pose_lines(poses, REF).select("value", F.lit(0).alias("line_no"))
    return text.columns(lines, text.POSES).select("t", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


@query("select 'img_' || event_id || '.jpg' as image, 'img_' || vec_id || '.mask.png' as mask, 8 as mask_height from events join embeddings on event_id = vec_id")
def masked_frames(spark, sf_dir):
    """Camera images with the masks of the same stem."""
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("img_"), "event_id", F.lit(".jpg")).alias("image"))
    names = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("img_"), "vec_id", F.lit(".mask.png")).alias("name"))
    masks = names.select("name", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.lit(b"").alias("data"))
    return images.with_masks(frames, masks).select("image", F.concat(F.substring_index("image", ".", 1), F.lit(".mask.png")).alias("mask"), "mask_height")


# --- the binary map -------------------------------------------------------------------------------


def _instances(spark, sf_dir):
    """Boxes and lines as stored instances: two corners' worth of shape a box, the eight vertices a line."""
    point = lambda x, y, z: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    b = frame(spark, sf_dir, "inst")
    here = point(F.col("x"), F.col("y"), F.col("z"))
    corner = lambda i, j: point(F.col("x") + i * F.col("h") / 2, F.col("y") + j * F.col("w") / 2, F.col("z"))
    cov = F.array(*[F.lit(v) for v in (0.5, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0, 0.0, 0.125)])
    boxes = b.select(
        "id", "frame_id", "road_class", F.lit(False).alias("line_valid"), "frozen", "merged", (F.col("id") % 5 != 0).alias("valid_add_to_map"), here.alias("mean"),
        F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("box"), F.array(*[F.col(f"sigma{j}") for j in range(4)]).alias("box_sigma"),
        F.array().cast("array<struct<x:double,y:double,z:double>>").alias("line"), cov.alias("mean_cov"), F.array().cast("array<array<double>>").alias("line_cov"), "percept_distance",
    )
    v = frame(spark, sf_dir, "line_vtx").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("vtx", "x", "y", "z", "sigma"))).alias("v"))
    o = F.lit(0.0)
    spread = lambda s: F.array(8 * s["sigma"] * s["sigma"], o, o, o, 8 * s["sigma"] * s["sigma"], o, o, o, o)
    lines = v.select(
        F.col("line_id").alias("id"), F.expr("line_id div 4").alias("frame_id"), F.when(F.col("line_id") % 3 == 0, RoadClass.STOP.value).otherwise(RoadClass.SOLID.value).alias("road_class"),
        F.lit(True).alias("line_valid"), F.lit(False).alias("frozen"), F.lit(False).alias("merged"), (F.col("line_id") % 7 != 0).alias("valid_add_to_map"), point(F.col("v")[0]["x"], F.col("v")[0]["y"], F.col("v")[0]["z"]).alias("mean"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda _: point(o, o, o)).alias("box"), F.array(o, o, o, o).alias("box_sigma"),
        F.transform("v", lambda s: point(s["x"], s["y"], s["z"])).alias("line"), cov.alias("mean_cov"), F.transform("v", spread).alias("line_cov"), F.lit(0.0).alias("percept_distance"),
    )
    return boxes, lines


INST, VTX = sql("inst"), sql("line_vtx")
_SINGLE = lambda e, n: d6(f"({e})::float::double", n)


@query(
    f"""select frame_id::varchar as tile, id, road_class, frozen, merged, id % 5 <> 0 as valid, {_SINGLE('x', 'x')}, {_SINGLE('y', 'y')}, {_SINGLE('x + h/2', 'corner_x')}, {_SINGLE('y + w/2', 'corner_y')},
{_SINGLE('sigma3', 'sigma')}, percept_distance from ({INST})"""
)
def map_boxes_file(spark, sf_dir):
    """Boxes packed into one binary map a frame, and read again: positions in single precision."""
    boxes, _ = _instances(spark, sf_dir)
    back = binary_map.instances_of(binary_map.tiles(boxes, "frame_id", REF))
    return back.select(
        F.col("path").alias("tile"), "id", "road_class", "frozen", "merged", F.col("valid_add_to_map").alias("valid"), r6("mean.x").alias("x"), r6("mean.y").alias("y"),
        r6(F.col("box")[2]["x"]).alias("corner_x"), r6(F.col("box")[2]["y"]).alias("corner_y"), r6(F.col("box_sigma")[3]).alias("sigma"), "percept_distance",
    )


@query(
    f"select line_id as id, (row_number() over (partition by line_id order by vtx) - 1)::int as vtx, {_SINGLE('x', 'x')}, {_SINGLE('z', 'z')}, {_SINGLE('8*sigma*sigma', 'variance')} from ({VTX})"
)
def map_lines_file(spark, sf_dir):
    _, lines = _instances(spark, sf_dir)
    back = binary_map.instances_of(binary_map.tiles(lines, "frame_id", REF))
    return back.select("id", F.posexplode("line").alias("vtx", "p"), "line_cov").select("id", "vtx", r6("p.x").alias("x"), r6("p.z").alias("z"), r6(F.col("line_cov")[F.col("vtx")][4]).alias("variance"))


# --- drawing --------------------------------------------------------------------------------------

_ERROR = "(4 * sigma)"
_STOPS = f"select line_id as id, line_id % 3 = 0 as stop, row_number() over (partition by line_id order by vtx) - 1 as pt, count(*) over (partition by line_id) as n, x, y, {_ERROR} as err from ({VTX}) where line_id % 7 <> 0"


@query(
    f"""select id, pt::int as pt, {d6('x', 'x')}, {d6('y', 'y')}, {d6('case when stop or err > 0.5 then 1.0 else (err - 0.1) / 0.4 end', 'red')},
{d6('case when stop then 0.0 when err > 0.5 then 1 - (err - 1) / 0.5 else 1.0 end', 'green')} from ({_STOPS}) where n >= 2"""
)
def drawn_lines(spark, sf_dir):
    _, lines = _instances(spark, sf_dir)
    d = mapping.drawing(lines).select("id", F.posexplode("points").alias("pt", "p"), "colours")
    return d.select("id", "pt", r6("p.x").alias("x"), r6("p.y").alias("y"), *[r6(F.col("colours")[F.col("pt")][i]).alias(n) for i, n in enumerate(("red", "green"))])


@query(
    f"""select id, pt::int as pt, {d6('x + i * h / 2', 'x')}, {d6('y + j * w / 2', 'y')}, {d6('case when road_class = 1 then 160 / 255.0::DOUBLE else 0 end', 'red')}, {d6('case when road_class = 1 then 0 else 160 / 255.0::DOUBLE end', 'blue')}
from (select *, unnest([0, 1, 2, 3]) as pt, unnest([-1, 1, 1, -1]) as i, unnest([-1, -1, 1, 1]) as j from ({INST})) where id % 5 <> 0"""
)
def drawn_boxes(spark, sf_dir):
    boxes, _ = _instances(spark, sf_dir)
    d = mapping.drawing(boxes).select("id", F.posexplode("points").alias("pt", "p"), "colours")
    return d.select("id", "pt", r6("p.x").alias("x"), r6("p.y").alias("y"), r6(F.col("colours")[F.col("pt")][0]).alias("red"), r6(F.col("colours")[F.col("pt")][2]).alias("blue"))


@query(
    f"""select 'drive' as kind, pose_id as id, x, y, {d6('m0', 'm0')}, 1.753::DOUBLE as height, 0.0::DOUBLE as red from ({MATRIX})
union all select 'marker', id, x, y, 1.0, 0.3, 0.25 from ({INST}) where merged"""
)
def drawn_solids(spark, sf_dir):
    """Vehicles along the drive, and markers at merged instances."""
    p = frame(spark, sf_dir, "pose")
    m = rotation.euler_to_matrix(*[F.col(c) * RAD for c in ("pitch_deg", "roll_deg", "yaw_deg")])
    poses = p.select(F.lit("drive").alias("traj_id"), F.col("pose_id").alias("t"), F.struct(F.array(*m).alias("r"), F.array("x", "y", "z").alias("t")).alias("pose"))
    cubes = mapping.markers(frame(spark, sf_dir, "inst").filter("merged"), ["id"], (0.25, 0.5, 0.0))
    common = lambda d, kind, key: d.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y"), r6(F.col("r")[0]).alias("m0"), "height", F.col("colour")[0].alias("red"))
    return common(mapping.vehicles(poses), "drive", "t").unionByName(common(cubes, "marker", "id"))


# --- helpers --------------------------------------------------------------------------------------


@query(
    """select event_id, case event_id % 8 when 0 then 'empty' when 2 then 'dashed' when 3 then 'guide' when 4 then 'zebra' when 5 then 'stop' else 'solid' end as name,
case event_id % 8 when 3 then 255 when 4 then 0 when 5 then 255 else 0 end::int as blue, case event_id % 8 when 2 then 255 when 4 then 255 else 0 end::int as green, case event_id % 8 when 1 then 255 when 4 then 255 when 5 then 255 else 0 end::int as red from events"""
)
def label_values(spark, sf_dir):
    """Labels 0 to 7 by name and colour; 6 and 7 have no colour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 8).alias("gray"))
    c = markings.label_colour(F.col("gray"))
    return e.select("event_id", markings.class_name(markings.gray_to_class(F.col("gray"))).alias("name"), *[c[i].alias(n) for i, n in enumerate(("blue", "green", "red"))])


_STEP = "select event_id, depth, 127 - trunc(least(greatest((depth - 5.0) / 45.0, 0.0), 1.0) * 127)::int as i from (select event_id, (event_id % 1000) / 16.0::DOUBLE as depth from events)"
_TENT = "case when depth = 0 then 0 else floor(greatest(least(1.5 - abs((i + 1) / 32.0::DOUBLE - {0}), 1.0), 0.0) * 255) end::int as {1}"


@query(f"select event_id, {', '.join(_TENT.format(k, n) for k, n in ((1, 'blue'), (2, 'green'), (3, 'red')))} from ({_STEP})")
def depth_colours(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((F.col("event_id") % 1000) / 16.0).alias("depth"))
    c = markings.depth_colour(F.col("depth"), 5.0, 50.0)
    return e.select("event_id", *[c[i].alias(n) for i, n in enumerate(("blue", "green", "red"))])


@query(
    f"select pose_id, {d6('degrees(asin(2*(y*z+w*x)))', 'pitch')}, {d6('abs(degrees(atan2(-2*(x*z-w*y), 1-2*(x*x+y*y))))', 'roll_abs')}, {d6('abs(degrees(atan2(-2*(x*y-w*z), 1-2*(x*x+z*z))))', 'yaw_abs')} from ({QUAT})"
)
def quaternion_to_euler(spark, sf_dir):
    """Half turns have two signs, so sizes are compared."""
    p, r, y = rotation.quaternion_to_euler(*[F.col(c) for c in "wxyz"])
    return _quaternion(frame(spark, sf_dir, "pose")).select("pose_id", r6(F.degrees(p)).alias("pitch"), r6(F.abs(F.degrees(r))).alias("roll_abs"), r6(F.abs(F.degrees(y))).alias("yaw_abs"))


@query(
    f"""select t, {d6('-sin(lat)*cos(lon)*dx - sin(lat)*sin(lon)*dy + cos(lat)*dz', 'north')}, {d6('-sin(lon)*dx + cos(lon)*dy', 'east')},
{d6('cos(lat)*cos(lon)*dx + cos(lat)*sin(lon)*dy + sin(lat)*dz', 'up')} from ({ERRORS})"""
)
def xyz_to_neu(spark, sf_dir):
    d = frame(spark, sf_dir, "gt").join(frame(spark, sf_dir, "res"), "t")
    here, there = ([F.col(f"{a}{i}") for a in "XYZ"] for i in (0, 1))
    d = d.withColumn("r", F.array(*geodesy.enu_rotation_at(tuple(there))))
    neu = geodesy.xyz_to_neu(tuple(there), tuple(here), linear.mat(F.col("r")))
    return d.select("t", *[r6(c).alias(n) for c, n in zip(neu, ("north", "east", "up"))])


_TIME = "lpad((event_id % 24)::varchar, 2, '0') || ':' || lpad((event_id % 60)::varchar, 2, '0') || ':' || lpad((event_id % 59)::varchar, 2, '0') || '.25'"


@query(
    f"""select event_id, (event_id % 24) * 3600.0::DOUBLE + (event_id % 60) * 60 + (event_id % 59) + 0.25 as seconds, {d6("(epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1e6", 'since')},
{d6('(ax*(ey - 1) - (ay - 1)*ex) / sqrt(ex*ex + (ey - 1)*(ey - 1))', 'side')}, event_id % 3 = 0 as same
from (select *, (event_id % 13)::double as ax, (event_id % 7)::double as ay, (1 + event_id % 5)::double as ex, (event_id % 11)::double as ey from events)"""
)
def small_helpers(spark, sf_dir):
    """Clock texts, differences of time, the side of a line on which a point lies, equal numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(24), two(60), F.concat(two(59), F.lit(".25")))
    n = lambda k: (F.col("event_id") % k).cast("double")
    side = markings.point_line_distance(n(13), n(7), F.lit(0.0), F.lit(1.0), n(5) + 1, n(11))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    since = markings.clock_difference(F.col("ts").cast("timestamp"), start)
    return e.select("event_id", markings.hhmmss_to_seconds(clock).alias("seconds"), r6(since).alias("since"), r6(side).alias("side"), markings.nearly(n(3) + 0.1, F.lit(0.1)).alias("same"))


_TILT = f"select pose_id, pitch_deg * {RAD!r} as th, roll_deg * {RAD!r} as al from ({POSE})"
_N = "select *, -(-sin(al)*cos(th)) as nx, -(cos(al)*cos(th)) as ny, -sin(th) as nz from ({})"


@query(
    f"""select pose_id, {d6('nx', 'nx')}, {d6('ny', 'ny')}, {d6('nz', 'nz')}, {d6('degrees(al)', 'alpha')}, {d6('degrees(th)', 'theta')},
{d6('degrees(atan2(-nx, 1 - nx*nx/(1 - ny)))', 'least_alpha')}, {d6('degrees(atan2(nz, 1 - nz*nz/(1 - ny)))', 'least_theta')} from ({_N.format(_TILT)})"""
)
def ground_geometry(spark, sf_dir):
    """The camera over ground: its rotation's normal and angles, and those of the least rotation with that normal."""
    p = frame(spark, sf_dir, "pose").select("pose_id", (F.col("roll_deg") * RAD).alias("al"), (F.col("pitch_deg") * RAD).alias("th"))
    p = p.withColumn("r", F.array(*camera.ground_rotation(F.col("al"), F.col("th"))))
    normal = camera.ground_normal(linear.mat(F.col("r")))
    alpha, theta = camera.ground_angles(linear.mat(F.col("r")))
    a, t = camera.ground_angles(camera.rotation_from_normal(tuple(2 * v for v in normal)))
    out = zip((*normal, *[F.degrees(v) for v in (alpha, theta, a, t)]), ("nx", "ny", "nz", "alpha", "theta", "least_alpha", "least_theta"))
    return p.select("pose_id", *[r6(c).alias(n) for c, n in out])


_K1, _K2, _P1, _P2 = (PINHOLE[k] for k in ("k1", "k2", "p1", "p2"))
_SEEN = "select event_id, event_id // 25 as view, (event_id % 11 - 5) / 10.0::DOUBLE as x, (event_id % 9 - 4) / 10.0::DOUBLE as y from events"
_BENT = f"""select *, x*({_K1}*(x*x+y*y) + {_K2}*(x*x+y*y)*(x*x+y*y)) + 2*({_P1})*x*y + ({_P2})*((x*x+y*y) + 2*x*x) as ex,
y*({_K1}*(x*x+y*y) + {_K2}*(x*x+y*y)*(x*x+y*y)) + 2*({_P2})*x*y + ({_P1})*((x*x+y*y) + 2*y*y) as ey from ({_SEEN})"""


@query(f"select view, {d6(f'avg(sqrt({PINHOLE['fx'] ** 2!r}*ex*ex + {PINHOLE['fy'] ** 2!r}*ey*ey))', 'error')}, count(*) as n from ({_BENT}) group by 1")
def reprojection_by_view(spark, sf_dir):
    """How far the distorted projection of points lies from the ideal one, by view."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id div 25").alias("view"), ((F.col("event_id") % 11 - 5) / 10.0).alias("x"), ((F.col("event_id") % 9 - 4) / 10.0).alias("y"))
    off = camera.reprojection_distance((F.col("x") * 3, F.col("y") * 3, F.lit(3.0)), F.col("x") * PINHOLE["fx"] + PINHOLE["cx"], F.col("y") * PINHOLE["fy"] + PINHOLE["cy"], PINHOLE)
    return aggregates.reprojection_error(e, "view", off).select("view", r6("error").alias("error"), "n")
