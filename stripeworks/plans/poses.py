"""Queries over poses, stamps and geodesy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy, linear, markings, rotation
from ..operators import aggregates, joins, windows
from ..sources import text
from . import d6, query, r6
from .fixtures import frame, sql

POSE, GT, RES = sql("pose"), sql("gt"), sql("res")
RAD = math.pi / 180


def latitude_sql(source: str, x: str = "x", y: str = "y", z: str = "z", steps: int = 6) -> str:
    """``source`` with ``lat``, by the same fixed steps."""
    e2, a = geodesy.E2, geodesy.A
    q = f"select *, atan2({z}, sqrt({x}*{x}+{y}*{y}) * {1 - e2!r}) as lat from ({source})"
    for _ in range(steps):
        q = f"select * exclude (lat), atan2({z} + {e2!r} * ({a!r} / sqrt(1 - {e2!r} * sin(lat) * sin(lat))) * sin(lat), sqrt({x}*{x}+{y}*{y})) as lat from ({q})"
    return q


ERRORS = f"""select t, X1 - X0 as dx, Y1 - Y0 as dy, Z1 - Z0 as dz, lat, atan2(Y1, X1) as lon
from ({latitude_sql(f'select * from ({GT}) join ({RES}) using (t)', 'X1', 'Y1', 'Z1')})"""
ENU = f"""select t, -sin(lon)*dx + cos(lon)*dy as e, -sin(lat)*cos(lon)*dx - sin(lat)*sin(lon)*dy + cos(lat)*dz as n,
cos(lat)*cos(lon)*dx + cos(lat)*sin(lon)*dy + sin(lat)*dz as u from ({ERRORS})"""


@query(
    f"""select {d6('sqrt(avg(e*e+n*n))', 'rmse_h')}, {d6('sqrt(avg(u*u))', 'rmse_v')},
{d6('avg(case when sqrt(e*e+n*n) < 1.0 then 100.0 else 0.0 end)', 'avail_1m')}, {d6('avg(case when sqrt(e*e+n*n) < 0.5 then 100.0 else 0.0 end)', 'avail_05m')} from ({ENU})"""
)
def eval_accuracy(spark, sf_dir):
    errors = aggregates.enu_errors(frame(spark, sf_dir, "gt"), frame(spark, sf_dir, "res"), "t")
    return aggregates.accuracy(errors).select(*[r6(c).alias(c) for c in ("rmse_h", "rmse_v", "avail_1m", "avail_05m")])


@query(f"select t, {d6('e', 'east')}, {d6('n', 'north')}, {d6('u', 'up')} from ({ENU})")
def eval_error_series(spark, sf_dir):
    errors = aggregates.enu_errors(frame(spark, sf_dir, "gt"), frame(spark, sf_dir, "res"), "t")
    return errors.select("t", *[r6(c).alias(c) for c in ("east", "north", "up")])


@query("select (event_id // 2)::double as t, max_by('img_' || event_id || '.png', event_id) as image, max_by('img_' || event_id, event_id) as stem from events where event_id <> 5 group by 1")
def stamp_parse(spark, sf_dir):
    """Stamp lines with a comment, blanks and repeated times; the last of a time wins."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat_ws(",", (F.expr("event_id div 2")).cast("string"), F.concat(F.lit("img_"), "event_id", F.lit(".png")))
    lines = events.select(F.when(F.col("event_id") == 5, F.lit("# note")).otherwise(line).alias("value"), F.col("event_id").alias("line_no"))
    stamps = text.stamps_from(lines)
    return stamps.select("t", "image", markings.file_stem(F.col("image")).alias("stem"))


EULER = "pitch_deg * {0} as p, roll_deg * {0} as r, yaw_deg * {0} as w".format(repr(RAD))
MATRIX_SQL = """select *, cos(r)*cos(w) - sin(p)*sin(r)*sin(w) as m0, -cos(p)*sin(w) as m1, sin(r)*cos(w) + sin(p)*cos(r)*sin(w) as m2,
cos(r)*sin(w) + sin(p)*sin(r)*cos(w) as m3, cos(p)*cos(w) as m4, sin(r)*sin(w) - sin(p)*cos(r)*cos(w) as m5,
-cos(p)*sin(r) as m6, sin(p) as m7, cos(p)*cos(r) as m8 from ({})"""
MATRIX = MATRIX_SQL.format(f"select *, {EULER} from ({POSE})")


def _matrix(df):
    m = rotation.euler_to_matrix(*[F.col(c) * RAD for c in ("pitch_deg", "roll_deg", "yaw_deg")])
    return df.select("pose_id", *[v.alias(f"m{i}") for i, v in enumerate(m)])


@query(f"select pose_id, {', '.join(d6(f'm{i}', f'm{i}') for i in range(9))} from ({MATRIX})")
def pose_euler_to_matrix(spark, sf_dir):
    m = _matrix(frame(spark, sf_dir, "pose"))
    return m.select("pose_id", *[r6(f"m{i}").alias(f"m{i}") for i in range(9)])


@query(f"select pose_id, {d6('degrees(asin(m7))', 'pitch')}, {d6('degrees(atan2(-m6, m8))', 'roll')}, {d6('abs(degrees(atan2(-m1, m4)))', 'yaw_abs')} from ({MATRIX})")
def matrix_to_euler(spark, sf_dir):
    """The yaw of a half turn has two signs, so its size is compared."""
    m = _matrix(frame(spark, sf_dir, "pose"))
    p, r, y = rotation.matrix_to_euler([F.col(f"m{i}") for i in range(9)])
    return m.select("pose_id", r6(F.degrees(p)).alias("pitch"), r6(F.degrees(r)).alias("roll"), r6(F.abs(F.degrees(y))).alias("yaw_abs"))


QUAT = f"""select pose_id, w/n as w, x/n as x, y/n as y, z/n as z from (select *, sqrt(w*w+x*x+y*y+z*z) as n from (
select pose_id, 1.0::DOUBLE + (pose_id % 7) as w, (pose_id % 5)::double - 2 as x, (pose_id % 11)::double / 4 as y, (pose_id % 3)::double - 1 as z from ({POSE})))"""


def _quaternion(df):
    q = df.select("pose_id", (F.lit(1.0) + F.col("pose_id") % 7).alias("w"), ((F.col("pose_id") % 5).cast("double") - 2).alias("x"), ((F.col("pose_id") % 11).cast("double") / 4).alias("y"), ((F.col("pose_id") % 3).cast("double") - 1).alias("z"))
    n = F.sqrt(F.expr("w*w+x*x+y*y+z*z"))
    return q.withColumn("n", n).select("pose_id", *[(F.col(c) / F.col("n")).alias(c) for c in "wxyz"])


@query(
    f"""select pose_id, {d6('1-2*(y*y+z*z)', 'm0')}, {d6('2*(x*y-w*z)', 'm1')}, {d6('2*(x*z+w*y)', 'm2')}, {d6('2*(x*y+w*z)', 'm3')}, {d6('1-2*(x*x+z*z)', 'm4')},
{d6('2*(y*z-w*x)', 'm5')}, {d6('2*(x*z-w*y)', 'm6')}, {d6('2*(y*z+w*x)', 'm7')}, {d6('1-2*(x*x+y*y)', 'm8')} from ({QUAT})"""
)
def quat_to_matrix(spark, sf_dir):
    q = _quaternion(frame(spark, sf_dir, "pose"))
    m = rotation.quaternion_to_matrix(*[F.col(c) for c in "wxyz"])
    return q.select("pose_id", *[r6(v).alias(f"m{i}") for i, v in enumerate(m)])


@query(f"select pose_id, {d6('w', 'w')}, {d6('x', 'x')}, {d6('y', 'y')}, {d6('z', 'z')} from ({QUAT})")
def matrix_to_quat(spark, sf_dir):
    """There and back: w is positive in the fixture, so the sign is its own."""
    q = _quaternion(frame(spark, sf_dir, "pose"))
    m = q.select("pose_id", *[v.alias(f"m{i}") for i, v in enumerate(rotation.quaternion_to_matrix(*[F.col(c) for c in "wxyz"]))])
    back = m.select("pose_id", F.struct(*[v.alias(c) for c, v in zip("wxyz", rotation.matrix_to_quaternion([F.col(f"m{i}") for i in range(9)]))]).alias("q"))
    sign = F.when(F.col("q.w") < 0, -1.0).otherwise(1.0)
    return back.select("pose_id", *[r6(F.col(f"q.{c}") * sign).alias(c) for c in "wxyz"])


REF = (-2267800.0, 5009300.0, 3221000.0)
REF2 = (-2267700.0, 5009400.0, 3220900.0)


def _rne(xyz):
    """The local frame of a literal point, as numbers; the same formula as the Columns'."""
    x, y, z = xyz
    lat = math.atan2(z, math.hypot(x, y) * (1 - geodesy.E2))
    for _ in range(6):
        lat = math.atan2(z + geodesy.E2 * (geodesy.A / math.sqrt(1 - geodesy.E2 * math.sin(lat) ** 2)) * math.sin(lat), math.hypot(x, y))
    lon = math.atan2(y, x)
    sa, ca, so, co = math.sin(lat), math.cos(lat), math.sin(lon), math.cos(lon)
    return [-so, co, 0.0, -sa * co, -sa * so, ca, ca * co, ca * so, sa]


def _apply_sql(m, v):
    return [f"({m[3 * i]!r} * ({v[0]}) + {m[3 * i + 1]!r} * ({v[1]}) + {m[3 * i + 2]!r} * ({v[2]}))" for i in range(3)]


_R0, _R1 = _rne(REF), _rne(REF2)
_ENU0 = _apply_sql(_R0, [f"X0 - ({REF[0]!r})", f"Y0 - ({REF[1]!r})", f"Z0 - ({REF[2]!r})"])


@query(f"select t, {', '.join(d6(e, n) for e, n in zip(_ENU0, ('e', 'n', 'u')))} from ({GT})")
def pose_ecef_to_enu(spark, sf_dir):
    g = frame(spark, sf_dir, "gt")
    enu = geodesy.xyz_to_enu((F.col("X0"), F.col("Y0"), F.col("Z0")), linear.literal(REF), linear.literal(_R0))
    return g.select("t", *[r6(v).alias(c) for v, c in zip(enu, "enu")])


_R0T = [_R0[3 * j + i] for i in range(3) for j in range(3)]
_BACK = [f"{e} + ({REF[i] - REF2[i]!r})" for i, e in enumerate(_apply_sql(_R0T, ["e", "n", "u"]))]


@query(f"select t, {', '.join(d6(e, n) for e, n in zip(_apply_sql(_R1, _BACK), ('e', 'n', 'u')))} from (select t, {', '.join(f'{e} as {n}' for e, n in zip(_ENU0, ('e', 'n', 'u')))} from ({GT}))")
def pose_rereference(spark, sf_dir):
    """Local positions about one origin, taken to another."""
    enu = geodesy.xyz_to_enu((F.col("X0"), F.col("Y0"), F.col("Z0")), linear.literal(REF), linear.literal(_R0))
    g = frame(spark, sf_dir, "gt").select("t", *[v.alias(c) for v, c in zip(enu, "enu")])
    there = geodesy.rereference((F.col("e"), F.col("n"), F.col("u")), REF, linear.literal(_R0), REF2, linear.literal(_R1))
    return g.select("t", *[r6(v).alias(c) for v, c in zip(there, "enu")])


_LAT = latitude_sql(f"select t, X0 as x, Y0 as y, Z0 as z from ({GT})")
_ELL = f"""select *, case when atan2(y, x) < 0 then atan2(y, x) + {2 * math.pi!r} else atan2(y, x) end as lon,
sqrt(x*x+y*y)*cos(lat) + z*sin(lat) - {geodesy.A!r} * sqrt(1 - {geodesy.E2!r} * sin(lat) * sin(lat)) as h from ({_LAT})"""


@query(
    f"""select t, {d6('degrees(lat)', 'lat')}, {d6('degrees(lon)', 'lon')}, {d6('h', 'h')},
{d6(f'({geodesy.A!r} / sqrt(1 - {geodesy.E2!r} * sin(lat) * sin(lat)) + h) * cos(lat) * cos(lon) - x', 'dx')} from ({_ELL})"""
)
def ellipsoid_roundtrip(spark, sf_dir):
    g = frame(spark, sf_dir, "gt")
    lat, lon, h = geodesy.xyz_to_ell(F.col("X0"), F.col("Y0"), F.col("Z0"))
    e = g.select("t", "X0", lat.alias("lat"), lon.alias("lon"), h.alias("h"))
    x, _, _ = geodesy.ell_to_xyz(F.col("lat"), F.col("lon"), F.col("h"))
    return e.select("t", r6(F.degrees("lat")).alias("lat"), r6(F.degrees("lon")).alias("lon"), r6("h").alias("h"), r6(x - F.col("X0")).alias("dx"))


_M, _EP2, _K0 = geodesy._M, geodesy._EP2, geodesy._K0
_UTM0 = f"select pose_id, ((pose_id * 37) % 1600)::double / 10 - 80 as lat_deg, ((pose_id * 7919) % 3600)::double / 10 - 180 as lon_deg from ({POSE})"
_UTM1 = f"""select *, case when lat_deg >= 56 and lat_deg < 64 and lon_deg >= 3 and lon_deg < 12 then 32
when lat_deg >= 72 and lat_deg < 84 and lon_deg >= 0 and lon_deg < 9 then 31 when lat_deg >= 72 and lat_deg < 84 and lon_deg >= 9 and lon_deg < 21 then 33
when lat_deg >= 72 and lat_deg < 84 and lon_deg >= 21 and lon_deg < 33 then 35 when lat_deg >= 72 and lat_deg < 84 and lon_deg >= 33 and lon_deg < 42 then 37
else floor((lon_deg + 180) / 6)::int + 1 end as zone from ({_UTM0})"""
_UTM2 = f"select *, radians(lat_deg) as lat, radians(lon_deg - ((zone - 1) * 6 - 177)) as lon from ({_UTM1})"
_UTM3 = f"""select *, {geodesy.A!r} / sqrt(1 - {geodesy.E2!r} * sin(lat) * sin(lat)) as nn, {_EP2!r} * cos(lat) * cos(lat) as k, cos(lat) * lon as a, tan(lat) * tan(lat) as tt,
{geodesy.A!r} * ({_M[0]!r} * lat - {_M[1]!r} * sin(2*lat) + {_M[2]!r} * sin(4*lat) - {_M[3]!r} * sin(6*lat)) as m from ({_UTM2})"""
_EAST = f"{_K0!r} * nn * (a + (1 - tt + k) * a**3 / 6 + (5 - 18*tt + tt*tt + 72*k - 58*{_EP2!r}) * a**5 / 120) + 500000"
_NORTH = f"""({_K0!r} * (m + nn * tan(lat) * (a*a/2 + (5 - tt + 9*k + 4*k*k) * a**4 / 24 + (61 - 58*tt + tt*tt + 600*k - 330*{_EP2!r}) * a**6 / 720)))
+ case when lat_deg < 0 then 10000000 else 0 end"""


@query(f"select pose_id, zone::int as zone, round({_EAST}, 3) as east, round({_NORTH}, 3) as north from ({_UTM3})")
def utm_forward(spark, sf_dir):
    p = frame(spark, sf_dir, "pose").selectExpr("pose_id", "cast((pose_id * 37) % 1600 as double) / 10 - 80 as lat_deg", "cast((pose_id * 7919) % 3600 as double) / 10 - 180 as lon_deg")
    e, n, z = geodesy.utm_forward(F.col("lat_deg"), F.col("lon_deg"))
    return p.select("pose_id", z.cast("int").alias("zone"), F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(
    f"""select stamp_id, t_us, pose_us, pose_id from ({sql('stamp')}) a asof join ({sql('stream_pose')}) b on a.t_us <= b.pose_us where pose_us - t_us <= 600000000"""
)
def asof_pose(spark, sf_dir):
    stamps, poses = frame(spark, sf_dir, "stamp"), frame(spark, sf_dir, "stream_pose")
    return joins.asof_join(stamps, poses, "t_us", "pose_us", ["pose_id"], 600_000_000)


_TRAIL = "over (partition by seq_id order by t_us rows between 14 preceding and current row)"


@query(f"select seq_id, pose_id, {d6(f'avg(pitch_deg) {_TRAIL}', 'mean_pitch')}, {d6(f'avg(roll_deg) {_TRAIL}', 'mean_roll')}, {d6(f'pitch_deg - avg(pitch_deg) {_TRAIL}', 'diff_pitch')} from ({POSE})")
def attitude_smooth(spark, sf_dir):
    w = windows.trailing_mean(frame(spark, sf_dir, "pose"), ["seq_id"], "t_us", ["pitch_deg", "roll_deg"], 15)
    return w.select("seq_id", "pose_id", r6("mean_pitch_deg").alias("mean_pitch"), r6("mean_roll_deg").alias("mean_roll"), r6("diff_pitch_deg").alias("diff_pitch"))


# Frame by frame: ``ph`` and ``rh`` are the attitudes held, ``last`` the mean to compare with.
SLOPE = f"""p as (select *, row_number() over (partition by seq_id order by t_us, pose_id) as rn from ({POSE})),
k as (select distinct seq_id, 0::bigint as pose_id, 0::bigint as rn, []::double[] as ph, []::double[] as rh, 0.0::double as last, 0.0::double as dp, 0.0::double as dr, false as jump from p
      union all
      select seq_id, pose_id, rn, case when j then [pitch] else ph end, case when j then [roll] else rh end, case when j then pitch else mp end, pitch - mp, roll - mr, j
      from (select *, abs(mp - last) > 0.15::double and len(ph) > 5 as j from (select *, list_sum(ph) / len(ph) as mp, list_sum(rh) / len(rh) as mr from (
        select k.seq_id, p.pose_id, p.rn, p.pitch_deg as pitch, p.roll_deg as roll, k.last, list_append(k.ph, p.pitch_deg)[-20:] as ph, list_append(k.rh, p.roll_deg)[-20:] as rh
        from k join p on p.seq_id = k.seq_id and p.rn = k.rn + 1))))"""
SLOPE_ROWS = f"with recursive {SLOPE} select seq_id, pose_id, {d6('dp', 'diff_pitch')}, {d6('dr', 'diff_roll')}, jump, len(ph)::int as held from k where rn > 0"


@query(SLOPE_ROWS)
def slope_reset(spark, sf_dir):
    out = windows.slope_reset(frame(spark, sf_dir, "pose"), 20, 3.0)
    return out.select("seq_id", "pose_id", r6("diff_pitch").alias("diff_pitch"), r6("diff_roll").alias("diff_roll"), "jump", "held")


@query(
    f"""with recursive {SLOPE}, found as (select p.seq_id, p.rn as j, p.x as jx, p.y as jy from k join p using (seq_id, rn) where k.jump),
m as (select p.seq_id, p.pose_id, found.j, cos(radians(yaw_deg)) as c, sin(radians(yaw_deg)) as s, jx - x as dx, jy - y as dy from found join p on p.seq_id = found.seq_id and p.rn between found.j - 20 and found.j - 1)
select seq_id, pose_id as frame, {d6('arg_min(c*dy - s*dx, j)', 'distance')} from m where c*dy - s*dx < 13.5 and c*dx + s*dy < 5 group by 1, 2"""
)
def slope_ignored_frames(spark, sf_dir):
    poses = frame(spark, sf_dir, "pose")
    jumps = windows.slope_reset(poses, 20, 3.0).filter("jump")
    out = windows.ignored_frames(poses, jumps)
    return out.select("seq_id", "frame", r6("distance").alias("distance"))


_LAG = "lag({}) over (partition by seq_id order by t_us, pose_id)"
_MOVE = f"""select *, x - {_LAG.format('x')} as dx, y - {_LAG.format('y')} as dy, z - {_LAG.format('z')} as dz, {_LAG.format('yaw_deg')} as py from ({POSE})"""


@query(
    f"""select seq_id, pose_id, {d6('cos(radians(py))*dx + sin(radians(py))*dy', 'right')}, {d6('cos(radians(py))*dy - sin(radians(py))*dx', 'ahead')}, {d6('dz', 'up')},
{d6('((yaw_deg - py + 180) % 360 + 360) % 360 - 180', 'turn')} from ({_MOVE})"""
)
def relative_motion(spark, sf_dir):
    out = windows.relative_motion(frame(spark, sf_dir, "pose"), ["seq_id"], ["t_us", "pose_id"])
    return out.select("seq_id", "pose_id", *[r6(c).alias(c) for c in ("right", "ahead", "up", "turn")])


def _numbered(order: str) -> str:
    return f"select *, row_number() over (partition by seq_id order by {order}) as rn from ({POSE})"


@query(f"select seq_id, pose_id from ({_numbered('t_us, pose_id')}) where rn % 10 = 1")
def frame_every_k(spark, sf_dir):
    return windows.every_k(frame(spark, sf_dir, "pose"), ["seq_id"], ["t_us", "pose_id"], 10).select("seq_id", "pose_id")


@query(f"select pose_id, t_us from ({POSE}) where pose_id >= (select max(event_id) from events) - 200")
def recent_frames(spark, sf_dir):
    p = frame(spark, sf_dir, "pose")
    last = p.agg(F.max("pose_id").alias("m"))
    return p.join(F.broadcast(last), F.col("pose_id") >= F.col("m") - 200).select("pose_id", "t_us")  # one row


@query(f"select seq_id, pose_id from ({_numbered('t_us desc, pose_id desc')}) where rn <= 5")
def window_cap(spark, sf_dir):
    order = [F.col("t_us").desc(), F.col("pose_id").desc()]
    return windows.newest(frame(spark, sf_dir, "pose"), ["seq_id"], order, 5).select("seq_id", "pose_id")


_KEYED = f"select seq_id, pose_id, x, y, row_number() over (partition by seq_id order by t_us, pose_id) as rn, count(*) over (partition by seq_id) as n from ({POSE})"


@query(
    f"""with recursive p as ({_KEYED}),
k as (select seq_id, pose_id, rn, n, x, y, true as kept, 0::bigint as ordinal from p where rn = 1
      union all
      select p.seq_id, p.pose_id, p.rn, p.n, case when far then p.x else k.x end, case when far then p.y else k.y end, far, k.ordinal + far::int
      from k join (select * from p) p on p.seq_id = k.seq_id and p.rn = k.rn + 1, lateral (select (p.x-k.x)*(p.x-k.x)+(p.y-k.y)*(p.y-k.y) >= 10000.0 as far))
select seq_id, pose_id, ordinal, (ordinal % 5 = 0 or rn = n) as matched from k where kept"""
)
def keyframes(spark, sf_dir):
    return windows.keyframes(frame(spark, sf_dir, "pose"), ["seq_id"], "t_us", 100.0)


_THIN = f"select line_id, vtx, x - first(x) over w as x, y - first(y) over w as y from ({sql('line_vtx')}) window w as (partition by line_id order by vtx)"


@query(
    f"""with recursive p as ({_THIN}),
k as (select line_id, vtx, case when x*x+y*y >= 9 then x else 0 end as x, case when x*x+y*y >= 9 then y else 0 end as y, x*x+y*y >= 9 as kept from p where vtx = 0
      union all
      select p.line_id, p.vtx, case when far then p.x else k.x end, case when far then p.y else k.y end, far
      from k join p on p.line_id = k.line_id and p.vtx = k.vtx + 1, lateral (select (p.x-k.x)*(p.x-k.x)+(p.y-k.y)*(p.y-k.y) >= 9.0 as far))
select line_id, vtx from k where kept"""
)
def sample_thin(spark, sf_dir):
    from pyspark.sql.window import Window

    v = frame(spark, sf_dir, "line_vtx")
    w = Window.partitionBy("line_id").orderBy("vtx")
    v = v.select("line_id", "vtx", (F.col("x") - F.first("x").over(w)).alias("x"), (F.col("y") - F.first("y").over(w)).alias("y"))
    lines = v.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("vtx", "x", "y"))).alias("p"))
    return lines.select("line_id", F.explode(windows.thin(F.col("p"), 3.0)).alias("p")).select("line_id", "p.vtx")



@query(f"""select g, {d6('avg(x0)', 'mx')}, {d6('avg(y0)', 'my')}, count(*) as n from (select t % 37 as g, X0 as x0, Y0 as y0 from ({GT})) group by g""")
def position_means(spark, sf_dir):
    g = frame(spark, sf_dir, "gt").withColumn("g", F.col("t") % 37)
    return g.groupBy("g").agg(r6(F.avg("X0")).alias("mx"), r6(F.avg("Y0")).alias("my"), F.count(F.lit(1)).alias("n"))


@query(
    f"""select pose_id, {d6('a', 'angle')}, {d6('case when a = 0 then 1 else sin(a)/a end', 'sinc')}, {d6('least(greatest(x, -100.0), 100.0)', 'clamped')},
{d6(f'{math.pi!r} - ((({math.pi!r} - 3*a) % {2 * math.pi!r}) + {2 * math.pi!r}) % {2 * math.pi!r}', 'wrapped')} from (select *, yaw_deg * {RAD!r} + 0.001 as a from ({POSE}))"""
)
def scalar_helpers(spark, sf_dir):
    p = frame(spark, sf_dir, "pose").withColumn("a", F.col("yaw_deg") * RAD + 0.001)
    return p.select(
        "pose_id", r6("a").alias("angle"), r6(markings.sinc(F.col("a"))).alias("sinc"), r6(markings.clamp(F.col("x"), -100.0, 100.0)).alias("clamped"), r6(markings.normalise_angle(3 * F.col("a"))).alias("wrapped")
    )


_RV = f"select pose_id, pitch_deg / 5 as a, roll_deg / 5 as b, ((pose_id * 7) % 13 - 6)::double / 10 as c from ({POSE})"
_RVN = f"select *, sqrt(a*a+b*b+c*c) as n from ({_RV})"
_RVS = f"select *, case when n*n < 1e-8 then 1 - n*n/6 else sin(n)/n end as s, case when n*n < 1e-8 then 0.5 - n*n/24 else (1-cos(n))/(n*n) end as k from ({_RVN})"


@query(f"select pose_id, {d6('1-k*(b*b+c*c)', 'm0')}, {d6('k*a*b-s*c', 'm1')}, {d6('k*a*c+s*b', 'm2')}, {d6('k*a*b+s*c', 'm3')}, {d6('1-k*(a*a+c*c)', 'm4')}, {d6('a', 'va')}, {d6('b', 'vb')}, {d6('c', 'vc')} from ({_RVS})")
def rotation_vectors(spark, sf_dir):
    """To the matrix and back; all turns are under half a circle."""
    v = frame(spark, sf_dir, "pose").selectExpr("pose_id", "pitch_deg / 5 as a", "roll_deg / 5 as b", "cast((pose_id * 7) % 13 - 6 as double) / 10 as c")
    m = v.select("pose_id", *[x.alias(f"m{i}") for i, x in enumerate(rotation.rotvec_to_matrix((F.col("a"), F.col("b"), F.col("c"))))])
    back = rotation.matrix_to_rotvec([F.col(f"m{i}") for i in range(9)])
    return m.select("pose_id", *[r6(f"m{i}").alias(f"m{i}") for i in range(5)], *[r6(x).alias(c) for x, c in zip(back, ("va", "vb", "vc"))])
