"""Queries over rasters, components and cameras."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera, linear, markings
from ..operators import aggregates, extract, raster
from ..schema import CameraConfig, PipelineConfig
from . import d6, query, r6
from .fixtures import ALPHA_DEG, HEIGHT_M, PINHOLE, RASTER, THETA_DEG, frame, mask, mask_sql, sql

MASK = mask_sql()
LABELLED = f"""with recursive m as materialized (select frame_id, row, col, gray, gray = 5 as apart from ({MASK}) where gray > 0),
reach as (select frame_id, row as r0, col as c0, row, col, apart from m
  union select reach.frame_id, r0, c0, m.row, m.col, m.apart from reach join m
  on m.frame_id = reach.frame_id and m.apart = reach.apart and abs(m.row - reach.row) + abs(m.col - reach.col) = 1),
lab as (select frame_id, r0 as row, c0 as col, min(row * 65536 + col)::bigint as component from reach group by all),
px as (select m.frame_id, m.row, m.col, m.gray, lab.component from m join lab using (frame_id, row, col))"""
CLASS_SQL = "(case gray when 2 then 1 when 3 then 2 when 4 then 3 when 5 then 4 else case when gray > 0 then 0 else -1 end end)::int"


def _exact(a: str, b: str) -> str:
    """A population covariance from whole numbers."""
    return f"((count(*)*sum({a}*{b}) - sum({a})*sum({b}))::double / (count(*)*count(*)))"


def _components(spark, sf_dir):
    return raster.components(mask(spark, sf_dir).filter("gray > 0"))


@query(f"{LABELLED} select * from px")
def mask_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(
    f"""{LABELLED} select frame_id, component, count(*) as area, min(row) as top, min(col) as left_col, max(row) - min(row) + 1 as height, max(col) - min(col) + 1 as width,
{d6('avg(row)', 'mean_row')}, {d6('avg(col)', 'mean_col')} from px group by 1, 2 having count(*) >= 3"""
)
def component_stats(spark, sf_dir):
    s = aggregates.component_stats(_components(spark, sf_dir), ["frame_id", "component"]).filter("area >= 3")
    return s.select("frame_id", "component", "area", "top", F.col("left").alias("left_col"), "height", "width", r6("mean_row").alias("mean_row"), r6("mean_col").alias("mean_col"))


@query(
    f"""{LABELLED}, n as (select frame_id, component, {CLASS_SQL} as road_class, count(*) as n from px group by all)
select frame_id, component, arg_max(road_class, n * 100 - road_class) as road_class, max(n) as votes, sum(n)::bigint as pixels from n group by 1, 2"""
)
def component_majority(spark, sf_dir):
    px = _components(spark, sf_dir).withColumn("road_class", markings.gray_to_class(F.col("gray")))
    return aggregates.majority_class(px, ["frame_id", "component"])


@query(f"{LABELLED} select frame_id, component, {d6(_exact('row', 'row'), 'var_row')}, {d6(_exact('col', 'col'), 'var_col')}, {d6(_exact('row', 'col'), 'cov')} from px group by 1, 2")
def component_moments(spark, sf_dir):
    s = aggregates.component_stats(_components(spark, sf_dir), ["frame_id", "component"])
    return s.select("frame_id", "component", r6("var_row").alias("var_row"), r6("var_col").alias("var_col"), r6("cov").alias("cov"))


@query(
    f"""{LABELLED}, s as (select frame_id, component, round({_exact('row', 'row')}, 9) as vr, round({_exact('col', 'col')}, 9) as vc, round({_exact('row', 'col')}, 9) as c from px group by 1, 2 having count(*) >= 4),
a as (select *, (vr + vc) / 2 as mid, sqrt(((vc - vr) / 2) * ((vc - vr) / 2) + c * c) as half, atan2(2 * c, vc - vr) / 2 as ang from s)
select frame_id, component, round(sqrt(mid + half), 5) + 0.0::DOUBLE as major, round(sqrt(greatest(mid - half, 0.0)), 5) + 0.0::DOUBLE as minor,
round(cos(ang) * case when sin(ang) < 0 then -1 else 1 end, 5) + 0.0::DOUBLE as du, round(sin(ang) * case when sin(ang) < 0 then -1 else 1 end, 5) + 0.0::DOUBLE as dv from a"""
)
def component_axes(spark, sf_dir):
    """Moments to nine places first, so that equal variances are equal in both engines."""
    s = aggregates.component_stats(_components(spark, sf_dir), ["frame_id", "component"]).filter("area >= 4")
    s = s.select("frame_id", "component", *[F.round(c, 9).alias(c) for c in ("var_row", "var_col", "cov")])
    major, minor, du, dv = aggregates.principal_axes(F.col("var_col"), F.col("var_row"), F.col("cov"))
    r5 = lambda c: F.round(c, 5) + 0.0
    return s.select("frame_id", "component", r5(major).alias("major"), r5(minor).alias("minor"), r5(du).alias("du"), r5(dv).alias("dv"))


_VTX = f"select line_id, vtx, sigma, x - (line_id % 2) * 4 as u, y from ({sql('line_vtx')})"
_LOCAL = f"select v.line_id, v.vtx, v.u - f.u as p, v.y - f.y as q from ({_VTX}) v join (select line_id, u, y from ({_VTX}) where vtx = 0) f using (line_id)"


def _local(spark, sf_dir):
    v = frame(spark, sf_dir, "line_vtx").selectExpr("line_id", "vtx", "x - (line_id % 2) * 4 as u", "y")
    f = v.filter("vtx = 0").select("line_id", F.col("u").alias("u0"), F.col("y").alias("y0"))
    return v.join(f, "line_id").selectExpr("line_id", "vtx", "u - u0 as p", "y - y0 as q")


@query(f"select line_id, {', '.join(d6(f'sum(p**{i})', f's{i}') for i in range(5))}, {', '.join(d6(f'sum(q*p**{i})', f'b{i}') for i in range(4))} from ({_LOCAL}) group by 1")
def curve_moments(spark, sf_dir):
    m = aggregates.cubic_moments(_local(spark, sf_dir), ["line_id"], "q", "p")
    return m.select("line_id", *[r6(f"s{i}").alias(f"s{i}") for i in range(5)], *[r6(f"b{i}").alias(f"b{i}") for i in range(4)])


@query()
def curve_fit_cubic(spark, sf_dir):
    m = aggregates.cubic_moments(_local(spark, sf_dir), ["line_id"], "q", "p")
    fit = aggregates.fit_cubic(m, ["line_id"])
    return fit.select("line_id", *[F.round(F.col("k")[i], 4).alias(f"k{i}") for i in range(4)], F.round("rms", 4).alias("rms"), (F.col("rms") < 5).alias("accepted"))


_SUP = f"{LABELLED}, p as (select *, frame_id * 64 + row * 8 + col as id, row * 0.6 + col * 0.8 as al, col * 0.6 - row * 0.8 as ac from px)"


@query(
    f"""{_SUP} select frame_id, component, arg_min(id, round(al, 6) * 1e9 + id) as back, arg_min(id, -round(al, 6) * 1e9 + id) as front,
arg_min(id, round(ac, 6) * 1e9 + id) as left_id, arg_min(id, -round(ac, 6) * 1e9 + id) as right_id from p group by 1, 2"""
)
def support_points(spark, sf_dir):
    px = _components(spark, sf_dir).withColumn("id", F.col("frame_id") * 64 + F.col("row") * 8 + F.col("col"))
    along, across = F.round(F.col("row") * 0.6 + F.col("col") * 0.8, 6), F.round(F.col("col") * 0.6 - F.col("row") * 0.8, 6)
    s = aggregates.support_points(px, ["frame_id", "component"], along, across, "id")
    return s.select("frame_id", "component", "back", "front", F.col("left").alias("left_id"), F.col("right").alias("right_id"))


_UV = f"select distinct (row * 97 + col * 13) % 780 as v, (row * 31 + col * 47) % 400 as u from ({MASK})"


def _uv(spark, sf_dir):
    return mask(spark, sf_dir).selectExpr("(row * 97 + col * 13) % 780 as v", "(row * 31 + col * 47) % 400 as u").distinct()


_D, _RES, _H, _W, _FX, _FY = HEIGHT_M, RASTER["resolution"], RASTER["height"], RASTER["width"], PINHOLE["fx"], PINHOLE["fy"]
_UNC = f"select *, (u*{_RES} - {_W * _RES / 2}) / {_D} as xi, (v*{_RES} - {(_H - 1) * _RES}) / {_D} as yi from (select u::double as u, v::double as v from ({_UV}))"
_UNC2 = f"select *, -1/yi as y, -xi/yi as x, {_D / _RES!r} as k from ({_UNC})"
_UNC3 = f"""select *, k/y/{_FX} as a, -k*x/(y*y)/{_FY} as b, k/(y*y)/{_FY} as c, k*x/(y*y) as p0, k*(1+y*y)/(y*y) as p1, xi/{_RES} as h0, yi/{_RES} as h1 from ({_UNC2})"""
_VP, _VH, _S2 = camera.PITCH_SIGMA**2, camera.HEIGHT_SIGMA**2, _RES * _RES


@query(
    f"""select u::int as u, v::int as v, {d6(f'(4*(a*a+b*b)+{_VP!r}*p0*p0+{_VH!r}*h0*h0)*{_S2!r}', 'xx')}, {d6(f'(4*b*c+{_VP!r}*p0*p1+{_VH!r}*h0*h1)*{_S2!r}', 'xy')},
{d6(f'(4*c*c+{_VP!r}*p1*p1+{_VH!r}*h1*h1)*{_S2!r}', 'yy')} from ({_UNC3})"""
)
def pixel_uncertainty(spark, sf_dir):
    m = camera.pixel_uncertainty(F.col("u").cast("double"), F.col("v").cast("double"), _D, _H, _W, _RES, _FX, _FY)
    return _uv(spark, sf_dir).select("u", "v", r6(m[0]).alias("xx"), r6(m[1]).alias("xy"), r6(m[4]).alias("yy"))


def _ground():
    ca, sa, ct, st = (f(math.radians(x)) for x in (ALPHA_DEG, THETA_DEG) for f in (math.cos, math.sin))
    return [ca, -sa * ct, sa * st, sa, ca * ct, -ca * st, 0.0, st, ct]


_R = _ground()


def _lin(m, v):
    return [f"({m[3 * i]!r}*({v[0]}) + {m[3 * i + 1]!r}*({v[1]}) + {m[3 * i + 2]!r}*({v[2]}))" for i in range(3)]


_RT = [_R[3 * j + i] for i in range(3) for j in range(3)]
_LEVEL = (f"(u - {_W // 2}) * {_RES}", repr(_D), f"({_H} - v - 1) * {_RES}")
_METRIC = f"select u, v, {', '.join(f'{e} as {n}' for e, n in zip(_lin(_R, _LEVEL), 'xyz'))} from ({_UV})"


def _metric(spark, sf_dir):
    m = camera.ipm_to_metric(F.col("u"), F.col("v"), linear.literal(_R), _D, _H, _W, _RES)
    return _uv(spark, sf_dir).select("u", "v", *[x.alias(c) for x, c in zip(m, "xyz")])


@query(f"select u, v, {d6('x', 'x')}, {d6('y', 'y')}, {d6('z', 'z')} from ({_METRIC})")
def ipm_to_metric(spark, sf_dir):
    return _metric(spark, sf_dir).select("u", "v", *[r6(c).alias(c) for c in "xyz"])


@query(f"select u, v, {d6('u', 'u2')}, {d6('v', 'v2')} from ({_UV})")
def metric_to_ipm(spark, sf_dir):
    """There and back again."""
    m = _metric(spark, sf_dir)
    u, v = camera.metric_to_ipm((F.col("x"), F.col("y"), F.col("z")), linear.literal(_R), _H, _W, _RES)
    return m.select("u", "v", r6(u).alias("u2"), r6(v).alias("v2"))


_CX, _CY = PINHOLE["cx"], PINHOLE["cy"]


@query(f"select u, v, {d6(f'x / z * {_FX} + {_CX}', 'pu')}, {d6(f'y / z * {_FY} + {_CY}', 'pv')} from ({_METRIC}) where z > 1")
def ipm_to_perspective(spark, sf_dir):
    m = _metric(spark, sf_dir).filter("z > 1").select("u", "v")
    pu, pv = camera.ipm_to_perspective(F.col("u"), F.col("v"), linear.literal(_R), _D, _H, _W, _RES, PINHOLE)
    return m.select("u", "v", r6(pu).alias("pu"), r6(pv).alias("pv"))


_PIX = f"select distinct (row * 97 + col * 131) % 1024 as u, 450 + (row * 31 + col * 47) % 300 as v from ({MASK})"
_RAY = f"select u, v, {', '.join(f'{e} as {n}' for e, n in zip(_lin(_RT, (f'(u - {_CX}) / {_FX}', f'(v - {_CY}) / {_FY}', '1.0')), ('a', 'b', 'c')))} from ({_PIX})"


def _pix(spark, sf_dir):
    return mask(spark, sf_dir).selectExpr("(row * 97 + col * 131) % 1024 as u", "450 + (row * 31 + col * 47) % 300 as v").distinct()


@query(f"select u, v, {d6(f'a*{_D}/b/{_RES} + {_W // 2}', 'iu')}, {d6(f'-c*{_D}/b/{_RES} + {_H} - 1', 'iv')} from ({_RAY})")
def perspective_to_ipm(spark, sf_dir):
    u, v = camera.perspective_to_ipm(F.col("u"), F.col("v"), linear.literal(_R), _D, _H, _W, _RES, PINHOLE)
    return _pix(spark, sf_dir).select("u", "v", r6(u).alias("iu"), r6(v).alias("iv"))


@query(f"select u, v, {', '.join(d6(e, n) for e, n in zip(_lin(_R, (f'a*{_D}/b', repr(_D), f'c*{_D}/b')), 'xyz'))} from ({_RAY})")
def perspective_to_metric(spark, sf_dir):
    p = camera.perspective_to_metric(F.col("u"), F.col("v"), linear.literal(_R), _D, PINHOLE)
    return _pix(spark, sf_dir).select("u", "v", *[r6(x).alias(c) for x, c in zip(p, "xyz")])


_K1, _K2, _P1, _P2 = (PINHOLE[k] for k in ("k1", "k2", "p1", "p2"))
_DX = f"(x*({_K1}*(x*x+y*y)+{_K2}*(x*x+y*y)*(x*x+y*y)) + 2*({_P1})*x*y + ({_P2})*((x*x+y*y)+2*x*x))"
_DY = f"(y*({_K1}*(x*x+y*y)+{_K2}*(x*x+y*y)*(x*x+y*y)) + 2*({_P2})*x*y + ({_P1})*((x*x+y*y)+2*y*y))"
_POINTS = f"select u, v, ((u - 512)::double / 700) as x, ((v - 600)::double / 500) as y from ({_PIX})"


@query(f"select u, v, {d6(f'{_FX} * (x + {_DX}) + {_CX}', 'pu')}, {d6(f'{_FY} * (y + {_DY}) + {_CY}', 'pv')} from ({_POINTS})")
def pinhole_project(spark, sf_dir):
    p = _pix(spark, sf_dir).select("u", "v", ((F.col("u") - 512) / 700.0).alias("x"), ((F.col("v") - 600) / 500.0).alias("y"))
    pu, pv = camera.project((F.col("x") * 2, F.col("y") * 2, F.lit(2.0)), PINHOLE)
    return p.select("u", "v", r6(pu).alias("pu"), r6(pv).alias("pv"))


def _lift_sql() -> str:
    q = f"select u, v, (u - {_CX}) / {_FX} as x0, (v - {_CY}) / {_FY} as y0, (u - {_CX}) / {_FX} as x, (v - {_CY}) / {_FY} as y from ({_PIX})"
    for _ in range(8):
        q = f"select u, v, x0, y0, x0 - {_DX} as x, y0 - {_DY} as y from ({q})"
    return q


@query(f"select u, v, {d6('x', 'x')}, {d6('y', 'y')} from ({_lift_sql()})")
def pinhole_lift(spark, sf_dir):
    x, y, _ = camera.lift(F.col("u"), F.col("v"), PINHOLE)
    return _pix(spark, sf_dir).select("u", "v", r6(x).alias("x"), r6(y).alias("y"))


#: Made-up calibrations of the other models.
FULL = {**PINHOLE, "model_type": "pinhole_full", "k3": 0.01, "k4": 0.02, "k5": -0.01, "k6": 0.005}
MEI = {"model_type": "mei", "xi": 0.9, "k1": -0.05, "k2": 0.01, "p1": 0.0005, "p2": -0.0004, "gamma1": 900.0, "gamma2": 890.0, "u0": 510.0, "v0": 380.0}
KB = {"model_type": "kannala_brandt", "k2": -0.02, "k3": 0.004, "k4": -0.001, "k5": 0.0002, "mu": 500.0, "mv": 495.0, "u0": 510.0, "v0": 380.0}
OCAM = {"model_type": "scaramuzza", "poly": [-250.0, 0.0, 1.2e-3, -4e-7, 1e-9], "inv_poly": [380.0, 240.0, 15.0, 20.0, 8.0], "ac": 0.999, "ad": 0.001, "ae": -0.001, "cx": 510.0, "cy": 380.0}

_R2 = "(x*x+y*y)"
_RATIO = f"((1+{_R2}*({_K1}+{_R2}*({_K2}+{_R2}*0.01)))/(1+{_R2}*(0.02+{_R2}*(-0.01+{_R2}*0.005))))"
_TX, _TY = f"(2*({_P1})*x*y + ({_P2})*({_R2}+2*x*x))", f"(2*({_P2})*x*y + ({_P1})*({_R2}+2*y*y))"
_MEI = f"select u, v, x / (1 + 0.9 * sqrt({_R2} + 1)) as x, y / (1 + 0.9 * sqrt({_R2} + 1)) as y from ({_POINTS})"
_MDX = f"(x*(-0.05*{_R2}+0.01*{_R2}*{_R2}) + 2*0.0005*x*y - 0.0004*({_R2}+2*x*x))"
_MDY = f"(y*(-0.05*{_R2}+0.01*{_R2}*{_R2}) - 2*0.0004*x*y + 0.0005*({_R2}+2*y*y))"
_THETA = "(th*(1+th*th*(-0.02+th*th*(0.004+th*th*(-0.001+th*th*0.0002)))))"
_POLY = "(380.0+ang*(240.0+ang*(15.0+ang*(20.0+ang*8.0))))"


@query(
    f"""select a.u, a.v, {d6(f'{_FX}*(a.fx)+{_CX}', 'full_u')}, {d6('900.0*(m.x+m.dx)+510.0', 'mei_u')}, {d6('890.0*(m.y+m.dy)+380.0', 'mei_v')},
{d6('500.0*k.r*k.x/k.n+510.0', 'kb_u')}, {d6('495.0*k.r*k.y/k.n+380.0', 'kb_v')}, {d6('o.x/o.n*o.rho*0.999+o.y/o.n*o.rho*0.001+510.0', 'ocam_u')}
from (select u, v, x*{_RATIO}+{_TX} as fx from ({_POINTS})) a join (select *, {_MDX} as dx, {_MDY} as dy from ({_MEI})) m using (u, v)
join (select *, {_THETA} as r from (select *, sqrt({_R2}) as n, atan2(sqrt({_R2}), 1.0) as th from ({_POINTS}) where {_R2} > 0)) k using (u, v)
join (select *, {_POLY} as rho from (select *, sqrt({_R2}) as n, atan2(-1.0, sqrt({_R2})) as ang from ({_POINTS}) where {_R2} > 0)) o using (u, v)"""
)
def other_cameras_project(spark, sf_dir):
    p = _pix(spark, sf_dir).select("u", "v", ((F.col("u") - 512) / 700.0).alias("x"), ((F.col("v") - 600) / 500.0).alias("y")).filter("x * x + y * y > 0")
    v = (F.col("x"), F.col("y"), F.lit(1.0))
    full, mei, kb, ocam = (camera.project(v, m) for m in (FULL, MEI, KB, OCAM))
    return p.select("u", "v", *[r6(c).alias(n) for c, n in ((full[0], "full_u"), (mei[0], "mei_u"), (mei[1], "mei_v"), (kb[0], "kb_u"), (kb[1], "kb_v"), (ocam[0], "ocam_u"))])


@query(f"select u, v, {d6('x', 'full_x')}, {d6('y', 'full_y')}, {d6('x', 'mei_x')}, {d6('y', 'mei_y')}, {d6('x', 'kb_x')}, {d6('y', 'kb_y')} from (select u, v, ((u - 512)::double / 1400) as x, ((v - 600)::double / 1000) as y from ({_PIX}))")
def camera_roundtrip(spark, sf_dir):
    """Projected and lifted again, for the models that invert exactly."""
    p = _pix(spark, sf_dir).select("u", "v", ((F.col("u") - 512) / 1400.0).alias("x"), ((F.col("v") - 600) / 1000.0).alias("y"))
    v = (F.col("x"), F.col("y"), F.lit(1.0))
    out = []
    for name, m in (("full", FULL), ("mei", MEI), ("kb", KB)):
        a, b = camera.project(v, m)
        p = p.withColumn(f"{name}_u", a).withColumn(f"{name}_v", b)
        ray = camera.lift(F.col(f"{name}_u"), F.col(f"{name}_v"), {**m, "steps": 20})
        p = p.withColumn(f"{name}_r", F.array(*ray))
        out += [r6(F.col(f"{name}_r")[0] / F.col(f"{name}_r")[2]).alias(f"{name}_x"), r6(F.col(f"{name}_r")[1] / F.col(f"{name}_r")[2]).alias(f"{name}_y")]
    return p.select("u", "v", *out)


@query(f"select gray, {CLASS_SQL} as road_class, count(*) as n from ({MASK}) group by all")
def class_histogram(spark, sf_dir):
    return mask(spark, sf_dir).groupBy("gray", markings.gray_to_class(F.col("gray")).alias("road_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with m as (select * from ({MASK})), d as (select frame_id, row - 1 as row, col, gray as g from m)
select m.frame_id, bool_or(m.row = 7 or m.col = 0 or m.col = 7 or coalesce(d.g, 1) = 0) as out_range, count(*) as pixels
from m left join d on m.frame_id = d.frame_id and m.row = d.row and m.col = d.col where m.gray > 0 group by 1"""
)
def out_of_range(spark, sf_dir):
    """Frames in which a foreground pixel lies on the left, right or bottom border, or above a black one."""
    m = mask(spark, sf_dir)
    from pyspark.sql.window import Window

    below = F.lead("gray").over(Window.partitionBy("frame_id", "col").orderBy("row"))
    edge = (F.col("row") == 7) | F.col("col").isin(0, 7) | (F.coalesce(F.col("below"), F.lit(1)) == 0)
    return m.withColumn("below", below).filter("gray > 0").groupBy("frame_id").agg(F.bool_or(edge).alias("out_range"), F.count(F.lit(1)).alias("pixels"))


def _rasters(spark, sf_dir):
    """The label images as one binary row a frame."""
    px = F.array_sort(F.collect_list(F.struct("row", "col", "gray")))
    whole = mask(spark, sf_dir).groupBy("frame_id").agg(px.alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x.gray), 2, "0")), ""))
    return whole.select("frame_id", F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data"))


@query()
def instance_extraction(spark, sf_dir):
    """Frames to instances in metres, with thresholds for images this small."""
    cfg = PipelineConfig(min_patch_size=4)
    cam = CameraConfig(height=8, width=8, resolution=0.5, h=HEIGHT_M, intrinsics=PINHOLE)
    body = extract.to_body(extract.extract(_rasters(spark, sf_dir), cfg, cam), cfg, cam)
    return body.select("frame_id", "k", "road_class", "pixels", "out_range", "line_valid", "valid_add_to_map", F.size("line").alias("n_line"), F.size("corners").alias("n_corners"), F.round("percept_distance", 4).alias("percept_distance"))


@query(f"select frame_id, count(*) as n from ({MASK}) where gray > 0 group by 1")
def raster_pixels(spark, sf_dir):
    """Binary rasters and back to rows."""
    return raster.pixels_of(_rasters(spark, sf_dir)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
