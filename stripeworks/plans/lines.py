"""Queries over polylines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markings
from ..operators import aggregates, joins, mapping, windows
from . import d6, query, r6
from .fixtures import frame, sql

VTX = sql("line_vtx")
_DIR = f"""select *, sqrt(dx*dx+dy*dy) as n from (select *, coalesce(x - lag(x) over w, lead(x) over w - x) as dx, coalesce(y - lag(y) over w, lead(y) over w - y) as dy
from ({VTX}) window w as (partition by line_id order by vtx))"""
_UNIT = f"select line_id, vtx, x, y, dx/n as ux, dy/n as uy, floor(x)::bigint as cx, floor(y)::bigint as cy from ({_DIR})"
_NEAR = """select a.line_id, b.line_id as b_line_id, a.x - b.x as dx, a.y - b.y as dy, a.ux, a.uy, b.ux as b_ux, b.uy as b_uy,
row_number() over (partition by a.line_id, b.line_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), a.vtx, b.vtx) as rn
from (select *, unnest([cx-1, cx, cx+1]) as kx from u) a join u b on b.cx = a.kx and b.cy between a.cy - 1 and a.cy + 1 and a.line_id < b.line_id"""
PAIRS = f"""u as materialized ({_UNIT}), near as ({_NEAR}),
best as (select *, sqrt(dx*dx+dy*dy) as distance, abs(dy*ux - dx*uy) as a1, abs(dy*b_ux - dx*b_uy) as a2, abs(ux*b_ux+uy*b_uy) as c from near where rn = 1),
pairs as (select line_id, b_line_id, distance from best where ((a1 < 1.0 and a2 < 0.4) or (a1 < 0.4 and a2 < 1.0)) and distance < 1.0 and c > 0.984807753012208)"""


@query(f"with {PAIRS} select line_id, b_line_id, {d6('distance', 'distance')} from pairs")
def line_pair_proximity(spark, sf_dir):
    p = joins.polyline_pairs(frame(spark, sf_dir, "line_vtx"))
    return p.select("line_id", "b_line_id", r6("distance").alias("distance"))


@query(
    f"""with recursive {PAIRS}, e as (select line_id as a, b_line_id as b from pairs union all select b_line_id, line_id from pairs),
r as (select distinct line_id as n, line_id as m from u union select r.n, e.b from r join e on e.a = r.m)
select n as line_id, min(m) as cluster from r group by 1"""
)
def line_clusters(spark, sf_dir):
    return mapping.line_clusters(frame(spark, sf_dir, "line_vtx")).select("line_id", "cluster")


@query()
def line_merge(spark, sf_dir):
    v = frame(spark, sf_dir, "line_vtx").withColumn("z", F.lit(0.0))
    v = v.join(mapping.line_clusters(v), "line_id")
    out = mapping.merge_line_clusters(v)
    return out.select("cluster", "n_lines", "vtx", *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "variance")])


_LINE_STATS = f"""select line_id, count(*) as vertices, sqrt((arg_max(x,vtx)-arg_min(x,vtx))**2 + (arg_max(y,vtx)-arg_min(y,vtx))**2) as length from ({VTX}) group by 1"""


@query(f"select line_id, vertices, {d6('length', 'length')} from ({_LINE_STATS}) where vertices >= 5 and length >= 7.0")
def clean_lines(spark, sf_dir):
    v = frame(spark, sf_dir, "line_vtx")
    return mapping.clean_lines(v.select("line_id").distinct(), v, 5, 7.0).select("line_id", "vertices", r6("length").alias("length"))


_PT = f"select line_id * 10 + vtx as pid, line_id // 2 as lane, x + 0.25 as x, y + 0.1 as y, z from ({VTX}) where line_id % 2 = 0"
_LN = f"select line_id // 2 as lane, line_id, vtx, x, y, z, count(*) over (partition by line_id) as n from ({VTX}) where line_id % 2 = 1"
_SEG = f"""select p.pid, l.line_id, p.x, p.y, p.z, l.vtx, l.n, row_number() over (partition by p.pid, l.line_id order by (p.x-l.x)*(p.x-l.x)+(p.y-l.y)*(p.y-l.y)+(p.z-l.z)*(p.z-l.z), l.vtx) as rn
from ({_PT}) p join ({_LN}) l using (lane)"""


@query(
    f"""with s as (select pid, line_id, min(vtx) as segment, any_value(x) as x, any_value(y) as y, any_value(z) as z, any_value(n) as n, count(*) as c from ({_SEG}) where rn <= 2 group by 1, 2),
k as (select * from s where c = 2 and segment <> 0 and segment <= n - 3)
select pid, k.line_id, segment, {d6('sqrt(((b.y-a.y)*(k.z-a.z) - (b.z-a.z)*(k.y-a.y))**2 + ((b.z-a.z)*(k.x-a.x) - (b.x-a.x)*(k.z-a.z))**2 + ((b.x-a.x)*(k.y-a.y) - (b.y-a.y)*(k.x-a.x))**2) / sqrt((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2)', 'distance')}
from k join ({VTX}) a on a.line_id = k.line_id and a.vtx = segment join ({VTX}) b on b.line_id = k.line_id and b.vtx = segment + 1"""
)
def line_match(spark, sf_dir):
    v = frame(spark, sf_dir, "line_vtx")
    pts = v.filter("line_id % 2 = 0").selectExpr("line_id * 10 + vtx as pid", "line_id div 2 as lane", "x + 0.25D as x", "y + 0.1D as y", "z")
    own = v.filter("line_id % 2 = 1").selectExpr("line_id div 2 as lane", "line_id", "vtx", "x", "y", "z", "count(*) over (partition by line_id) as n")
    m = joins.segment_match(pts, own, ["lane"], "pid", "line_id")
    return m.select("pid", "line_id", "segment", r6("distance").alias("distance"))


@query(f"""select line_id, vtx, {d6('lag(x) over w - 2*x + lead(x) over w', 'ddx')}, {d6('lag(y) over w - 2*y + lead(y) over w', 'ddy')} from ({VTX}) window w as (partition by line_id order by vtx)""")
def line_curvature(spark, sf_dir):
    v = windows.curvature(frame(spark, sf_dir, "line_vtx"), "line_id", "vtx")
    return v.select("line_id", "vtx", r6("ddx").alias("ddx"), r6("ddy").alias("ddy"))


@query(
    f"""select line_id, {d6('min(a)', 'low')}, {d6('max(a)', 'high')}, {d6('min(b)', 'left_off')}, {d6('max(b)', 'right_off')} from (
select v.line_id, (v.x-f.x)*0.8 + (v.y-f.y)*0.6 as a, (v.y-f.y)*0.8 - (v.x-f.x)*0.6 as b from ({VTX}) v join ({VTX}) f on f.line_id = v.line_id and f.vtx = 0) group by 1"""
)
def rotated_extents(spark, sf_dir):
    v = frame(spark, sf_dir, "line_vtx")
    f = v.filter("vtx = 0").select("line_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    r = v.join(f, "line_id").selectExpr("line_id", "(x-fx)*0.8D + (y-fy)*0.6D as a", "(y-fy)*0.8D - (x-fx)*0.6D as b")
    return r.groupBy("line_id").agg(r6(F.min("a")).alias("low"), r6(F.max("a")).alias("high"), r6(F.min("b")).alias("left_off"), r6(F.max("b")).alias("right_off"))



_ARC = f"""select line_id, cos(vtx * 0.3) * (5 + line_id % 7) + line_id % 11 + ((line_id * 7 + vtx * 3) % 5) / 50.0::DOUBLE as x,
sin(vtx * 0.3) * (5 + line_id % 7) - line_id % 13 + ((line_id * 3 + vtx * 7) % 4) / 50.0::DOUBLE as y from ({VTX})"""


@query(
    f"""with p as ({_ARC}), s as (select line_id, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as xx, sum(x*y) as xy, sum(y*y) as yy, sum(x*x*x+x*y*y) as qx, sum(x*x*y+y*y*y) as qy from p group by 1),
e as (select line_id, n*xx-sx*sx as a, n*xy-sx*sy as b, n*yy-sy*sy as c, (n*qx-sx*(xx+yy))/2 as d, (n*qy-sy*(xx+yy))/2 as e from s),
f as (select line_id, (d*c-b*e)/(a*c-b*b) as cx, (a*e-b*d)/(a*c-b*b) as cy from e)
select line_id, round(any_value(cx), 4) + 0.0 as cx, round(any_value(cy), 4) + 0.0 as cy, round(avg(sqrt((x-cx)**2 + (y-cy)**2)), 4) as radius from p join f using (line_id) group by 1"""
)
def circle_fit(spark, sf_dir):
    """Circles through noisy arcs."""
    arc = ["line_id", "cos(vtx * 0.3D) * (5 + line_id % 7) + line_id % 11 + ((line_id * 7 + vtx * 3) % 5) / 50.0D as x", "sin(vtx * 0.3D) * (5 + line_id % 7) - line_id % 13 + ((line_id * 3 + vtx * 7) % 4) / 50.0D as y"]
    c = aggregates.circle_fit(frame(spark, sf_dir, "line_vtx").selectExpr(*arc), ["line_id"])
    return c.select("line_id", (F.round("cx", 4) + 0.0).alias("cx"), (F.round("cy", 4) + 0.0).alias("cy"), F.round("radius", 4).alias("radius"))


_SEGS = f"select line_id, (line_id % 7)::int as x0, (line_id % 5)::int as y0, (line_id % 11)::int as x1, (line_id % 13)::int as y1 from (select distinct line_id from ({VTX}))"


@query(
    f"""with recursive s as ({_SEGS}), walk as (select line_id, x0 as x, y0 as y, x1, y1, abs(x1-x0) as dx, abs(y1-y0) as dy, abs(x1-x0) - abs(y1-y0) as err from s
union all select line_id, x + case when 2*err > -dy then sign(x1-x) else 0 end, y + case when 2*err < dx then sign(y1-y) else 0 end, x1, y1, dx, dy,
err - case when 2*err > -dy then dy else 0 end + case when 2*err < dx then dx else 0 end from walk where x <> x1 or y <> y1)
select line_id, x::int as x, y::int as y from walk"""
)
def raster_lines(spark, sf_dir):
    s = frame(spark, sf_dir, "line_vtx").select("line_id").distinct().selectExpr("line_id", "cast(line_id % 7 as int) as x0", "cast(line_id % 5 as int) as y0", "cast(line_id % 11 as int) as x1", "cast(line_id % 13 as int) as y1")
    cells = s.select("line_id", F.explode(markings.raster_line(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).alias("c"))
    return cells.select("line_id", "c.x", "c.y")


_CC = f"select line_id, (line_id % 7)::double as x1, (line_id % 5)::double as y1, 3.0::DOUBLE + line_id % 3 as r1 from (select distinct line_id from ({VTX}))"


@query(
    f"""select line_id, case when d = 0 or h2 < 0 then 0 when h2 = 0 then 1 else 2 end as n, {d6('case when d > 0 and h2 > 0 then a*x1/d + sqrt(h2)*y1/d end', 'px')} from (
select *, 16 - a*a as h2 from (select *, (16 - r1*r1 + d*d) / (2*d) as a from (select *, sqrt(x1*x1+y1*y1) as d from ({_CC}))))"""
)
def circle_crossings(spark, sf_dir):
    s = frame(spark, sf_dir, "line_vtx").select("line_id").distinct().selectExpr("line_id", "cast(line_id % 7 as double) as x1", "cast(line_id % 5 as double) as y1", "3.0D + line_id % 3 as r1")
    s = s.withColumn("p", markings.circle_intersections(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.col("x1"), F.col("y1"), F.col("r1")))
    return s.select("line_id", F.size("p").alias("n"), r6(F.when(F.size("p") == 2, F.try_element_at("p", F.lit(1))["x"])).alias("px"))


@query(
    f"""with recursive c as (select line_id, (line_id % 7)::int as cx, (line_id % 5)::int as cy, (1 + line_id % 6)::int as r from (select distinct line_id from ({VTX}))),
walk as (select distinct r, 0 as x, r as y, 1 - r as f, 1 as gx, -2 * r as gy from c
union all select r, x + 1, y - (f >= 0)::int, f + case when f >= 0 then gy + 2 else 0 end + gx + 2, gx + 2, gy + 2 * (f >= 0)::int from walk where x < y),
spans as (select r, y as v, x as w from walk union select r, x, y from walk union select r, unnest(range(0, r + 1))::int, 0 from (select distinct r from c)),
cells as (select r, v, unnest(range(-w, w + 1))::int as i from spans)
select distinct line_id, (cx + i)::int as x, (cy + k * v)::int as y from c join cells using (r), (select unnest([-1, 1]) as k)"""
)
def raster_circles(spark, sf_dir):
    s = frame(spark, sf_dir, "line_vtx").select("line_id").distinct().selectExpr("line_id", "cast(line_id % 7 as int) as cx", "cast(line_id % 5 as int) as cy", "cast(1 + line_id % 6 as int) as r")
    return s.select("line_id", F.explode(markings.raster_circle(F.col("cx"), F.col("cy"), F.col("r"))).alias("c")).select("line_id", "c.x", "c.y")
