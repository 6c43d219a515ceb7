"""Queries over marking instances and maps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import markings
from ..operators import aggregates, joins, kernels, localize, mapper, mapping
from ..operators.grouped import Group, by_group
from ..schema import PipelineConfig
from . import d6, query, r6
from .fixtures import frame, sql

INST, POSE = sql("inst"), sql("pose")
SIZE = 10.0  # no two boxes of the fixture overlap from further apart: their diagonals are under 7 m
CFG = PipelineConfig()


@query(
    f"""select id, road_class, (case when road_class = 1 then h > 1.0 and h < 10.0 and percept_distance < 12.0 when road_class = 2 then h > 0 and h < 1000.0 and percept_distance < 20.0
else not frozen end) as valid, {d6('h * w', 'area')} from ({INST})"""
)
def instance_validity(spark, sf_dir):
    i = frame(spark, sf_dir, "inst")
    ok = markings.valid_for_map(F.col("road_class"), F.col("h"), F.col("percept_distance"), ~F.col("frozen"), CFG)
    return i.select("id", "road_class", ok.alias("valid"), r6(F.col("h") * F.col("w")).alias("area"))


FRAMES = f"select pose_id as frame_id, x as px, y as py, cos(radians(yaw_deg)) as c, sin(radians(yaw_deg)) as s from ({POSE})"


def _frames(spark, sf_dir):
    p = frame(spark, sf_dir, "pose")
    return p.select(F.col("pose_id").alias("frame_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.cos(F.radians("yaw_deg")).alias("c"), F.sin(F.radians("yaw_deg")).alias("s"))


@query(f"select id, {d6('px + c*x - s*y', 'wx')}, {d6('py + s*x + c*y', 'wy')} from ({INST}) join ({FRAMES}) using (frame_id)")
def instances_to_world(spark, sf_dir):
    w = mapping.to_world(frame(spark, sf_dir, "inst"), _frames(spark, sf_dir))
    return w.select("id", r6("wx").alias("wx"), r6("wy").alias("wy"))


_IGN = "select event_id as frame_id, (event_id % 17)::double as distance from events where event_id % 7 = 0"


@query(f"select id, road_class, frame_id from ({INST}) left join ({_IGN}) using (frame_id) where not (distance is not null and percept_distance > distance + 0.5 and road_class in (1, 2, 4))")
def ignore_filter(spark, sf_dir):
    ignored = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 7 = 0").selectExpr("event_id as frame_id", "cast(event_id % 17 as double) as distance")
    return mapping.drop_ignored(frame(spark, sf_dir, "inst"), ignored).select("id", "road_class", "frame_id")


_OVER = f"""box as materialized (select id, road_class, x, y, h, w, cos(radians(yaw_deg)) as c, sin(radians(yaw_deg)) as s, floor(x/{SIZE})::bigint as cx, floor(y/{SIZE})::bigint as cy from ({INST}) where not frozen),
near as (select a.id, b.id as b_id, a.road_class, b.x-a.x as dx, b.y-a.y as dy, a.h as ah, a.w as aw, b.h as bh, b.w as bw, a.c as ac, a.s as sa, b.c as bc, b.s as sb
from (select *, unnest([cx-1, cx, cx+1]) as kx from box) a join box b on a.road_class = b.road_class and b.cx = a.kx and b.cy between a.cy-1 and a.cy+1 and a.id < b.id),
pairs as (select road_class, id, b_id from (select *, abs(ac*bc+sa*sb) as cc, abs(ac*sb-sa*bc) as ss from near)
where abs(dx*ac+dy*sa) <= (ah+bh*cc+bw*ss)/2 and abs(dy*ac-dx*sa) <= (aw+bh*ss+bw*cc)/2 and abs(dx*bc+dy*sb) <= (bh+ah*cc+aw*ss)/2 and abs(dy*bc-dx*sb) <= (bw+ah*ss+aw*cc)/2)"""


@query(f"with {_OVER} select * from pairs")
def rect_overlap_pairs(spark, sf_dir):
    return joins.rectangle_pairs(frame(spark, sf_dir, "inst"), ["road_class"], SIZE)


_CLUSTERS = f"""{_OVER}, e as (select id as a, b_id as b from pairs union all select b_id, id from pairs),
r as (select id as n, id as m from ({INST}) union select r.n, e.b from r join e on e.a = r.m), cl as (select n as id, min(m) as cluster from r group by 1)"""


@query(f"with recursive {_CLUSTERS} select * from cl")
def box_clusters(spark, sf_dir):
    return mapping.box_clusters(frame(spark, sf_dir, "inst"), SIZE).select("id", "cluster")


@query(f"select cid, count(*) as n, {d6('list_sort(list(h))[len(list(h)) // 2 + 1]', 'median_h')}, {d6('list_sort(list(yaw_deg))[len(list(yaw_deg)) // 2 + 1]', 'median_yaw')} from ({INST}) group by 1")
def cluster_upper_median(spark, sf_dir):
    m = aggregates.upper_medians(frame(spark, sf_dir, "inst"), ["cid"], ["h", "yaw_deg"])
    return m.select("cid", "n", r6("median_h").alias("median_h"), r6("median_yaw_deg").alias("median_yaw"))


@query(
    f"""with i as ({INST}), m as (select cid, list_sort(list(h))[len(list(h)) // 2 + 1] as mh from i group by 1)
select cid, arg_min(id, percept_distance * 1e9 + id) as id, {d6('any_value(mh)', 'median_h')} from i join m using (cid) where h >= mh - 0.1 group by 1"""
)
def cluster_best_member(spark, sf_dir):
    b = aggregates.best_member(frame(spark, sf_dir, "inst"), ["cid"])
    return b.select("cid", "id", r6("median_h").alias("median_h"))


@query(
    f"""select id, {d6(f'((radians(yaw_deg) - f + 3*{math.pi!r}) % {2 * math.pi!r}) - {math.pi!r}', 'turned')} from (
select *, first(radians(yaw_deg)) over (partition by cid order by id) as f from ({INST}))"""
)
def angle_dewrap(spark, sf_dir):
    from pyspark.sql.window import Window

    i = frame(spark, sf_dir, "inst").withColumn("a", F.radians("yaw_deg"))
    f = F.first("a").over(Window.partitionBy("cid").orderBy("id"))
    return i.withColumn("f", f).select("id", r6(markings.dewrap(F.col("a"), F.col("f"))).alias("turned"))


@query()
def box_merge(spark, sf_dir):
    b = mapping.merge_boxes(frame(spark, sf_dir, "inst").filter("road_class in (1, 2)"), 1, None)
    return b.select("cluster", "n", "state", *[F.round(c, 4).alias(c) for c in ("x", "y", "h", "w", "heading")])


@query()
def box_merge_online(spark, sf_dir):
    """The merge that runs while driving: what lies ahead passes, lone sightings behind go."""
    b = mapping.merge_boxes(frame(spark, sf_dir, "inst").filter("road_class in (1, 2)"), 0, (2000.0, 2000.0, 30.0))
    return b.select("cluster", "n", "state", *[F.round(c, 4).alias(c) for c in ("x", "y", "h", "w", "heading")])


@query(f"select id from ({INST}) where h >= 1.55 and w >= 0.25")
def clean_boxes(spark, sf_dir):
    i = frame(spark, sf_dir, "inst")
    return mapping.clean_boxes(i.withColumn("h", F.col("h") - 1.5).withColumn("w", F.col("w") - 0.2), 0.05).select("id")


@query(f"select id, false as frozen, false as merged from ({INST})")
def unfreeze(spark, sf_dir):
    return mapping.unfreeze(frame(spark, sf_dir, "inst")).select("id", "frozen", "merged")


_SITES = f"select id, ((id * 7919) % 4000) / 10.0::DOUBLE - 200 + (id % 9) as x, ((id * 104729) % 4000) / 10.0::DOUBLE - 200 + (id % 5) as y from ({INST})"
_RECENT = f"select frame_id, px, py, c, s from ({FRAMES}) where frame_id >= (select max(frame_id) from ({FRAMES})) - 200"
_LINKS = f"""links as materialized (select i.id, f.frame_id from ({_SITES}) i join ({_RECENT}) f
on abs(c*(x-px) + s*(y-py)) < 10 and c*(y-py) - s*(x-px) > 2 and c*(y-py) - s*(x-px) < 20)"""


def _sites(spark, sf_dir):
    i = frame(spark, sf_dir, "inst")
    return i.selectExpr("id", "((id * 7919) % 4000) / 10.0D - 200 + (id % 9) as x", "((id * 104729) % 4000) / 10.0D - 200 + (id % 5) as y")


def _links(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumnRenamed("px", "fx").withColumnRenamed("py", "fy")
    return joins.region_links(_sites(spark, sf_dir), f, "id", "frame_id")


@query(f"with {_LINKS} select * from links")
def linked_frames(spark, sf_dir):
    return _links(spark, sf_dir)


@query(
    f"""select id, frozen or ((y - 2000) * cos(radians(30)) - (x - 2000) * sin(radians(30)) < -10 and road_class in (0, 1, 2, 4)) or (road_class in (0, 4) and id % 60 > 50) as frozen from ({INST})"""
)
def freeze_flags(spark, sf_dir):
    i = frame(spark, sf_dir, "inst").withColumn("vertices", F.col("id") % 60)
    return mapping.freeze_flags(i, (2000.0, 2000.0, 30.0)).select("id", "frozen")


_NEW = f"select frame_id, px + 100 as npx, py - 50 as npy, c*0.8 - s*0.6 as nc, s*0.8 + c*0.6 as ns from ({FRAMES}) where frame_id % 10 <> 3"


@query(
    f"""with {_LINKS}, j as (select i.id, npx + nc*(c*(x-px)+s*(y-py)) - ns*(c*(y-py)-s*(x-px)) as rx, npy + ns*(c*(x-px)+s*(y-py)) + nc*(c*(y-py)-s*(x-px)) as ry
from links join ({_SITES}) i using (id) join ({FRAMES}) f using (frame_id) join ({_NEW}) n using (frame_id)), m as (select id, avg(rx) as rx, avg(ry) as ry, count(*) as links from j group by 1)
select i.id, {d6('rx', 'rx')}, {d6('ry', 'ry')}, links from ({_SITES}) i left join m using (id)"""
)
def geo_register(spark, sf_dir):
    old = _frames(spark, sf_dir)
    new = old.filter("frame_id % 10 <> 3").selectExpr("frame_id", "px + 100 as px", "py - 50 as py", "c*0.8D - s*0.6D as c", "s*0.8D + c*0.6D as s")
    g = mapping.geo_register(_sites(spark, sf_dir), _links(spark, sf_dir), old, new, "id")
    return g.select("id", r6("rx").alias("rx"), r6("ry").alias("ry"), "links")


_MAP = f"select id, road_class, x, y, z, h, w, floor(x/20)::bigint as cx, floor(y/20)::bigint as cy from ({INST})"
_QRY = f"select id as qid, frame_id, road_class, x + (id % 23) / 10.0::DOUBLE as x, y - (id % 19) / 10.0::DOUBLE as y, z / 2 as qz, h as qh, w as qw from ({INST})"
_MATCH = f"""q as materialized (select *, floor(x/20)::bigint as cx, floor(y/20)::bigint as cy from ({_QRY})), t as materialized ({_MAP}),
cand as (select q.qid, q.frame_id, q.road_class, q.qh, q.qw, t.id, t.h, t.w, (q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+t.z*t.z as d0, (q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(t.z-q.qz)*(t.z-q.qz) as d2
from (select *, unnest([cx-1, cx, cx+1]) as kx from q) q join t on t.road_class = q.road_class and t.cx = q.kx and t.cy between q.cy-1 and q.cy+1),
best as (select * from (select *, row_number() over (partition by qid order by d0, id) as rn from cand where d0 <= 400) where rn = 1)"""
_OK = "(road_class not in (1, 2) or (abs(h-qh) <= 2.0 and abs(w-qw) <= 2.0 {}))"


def _match(spark, sf_dir, strict=None):
    i = frame(spark, sf_dir, "inst")
    q = i.selectExpr("id as qid", "road_class", "x + (id % 23) / 10.0D as x", "y - (id % 19) / 10.0D as y", "z / 2 as z", "h", "w")
    return mapping.match(q, i, 20.0, strict)


@query(f"with {_MATCH} select qid, road_class, id, {d6('sqrt(d2)', 'distance')} from best where {_OK.format('')}")
def map_match_loose(spark, sf_dir):
    m = _match(spark, sf_dir)
    return m.select("qid", "road_class", "id", r6("distance").alias("distance"))


@query(f"with {_MATCH} select qid, road_class, id, {d6('sqrt(d2)', 'distance')} from best where {_OK.format('and d2 <= 1.0 and h >= 1.5')}")
def map_match_strict(spark, sf_dir):
    m = _match(spark, sf_dir, 1.0)
    return m.select("qid", "road_class", "id", r6("distance").alias("distance"))


@query(
    f"""with {_MATCH}, k as (select qid, road_class, id, qid // 20 as frame_id from best where {_OK.format('and d2 <= 1.0 and h >= 1.5')}),
g as (select frame_id from k group by 1 having not (count(*) filter (road_class = 1) = 0 and count(*) filter (road_class = 2) = 0 and count(*) filter (road_class = 4) = 0 and count(*) filter (road_class = 0) <= 2))
select qid, id, frame_id from k semi join g using (frame_id)"""
)
def match_sufficiency(spark, sf_dir):
    return mapping.sufficient(_match(spark, sf_dir, 1.0), F.expr("qid div 20")).select("qid", "id", "frame_id")


@query(
    f"""with i as ({INST}), o as (select max(id) + 1 as o from i where id % 2 = 0)
select id, {d6('x', 'x')}, {d6('y', 'y')} from i where id % 2 = 0 union all select id + o, {d6('x + 100', 'x')}, {d6('y - 50', 'y')} from i, o where id % 2 = 1"""
)
def merge_maps(spark, sf_dir):
    i = frame(spark, sf_dir, "inst").select("id", "x", "y")
    m = mapping.merge_maps(i.filter("id % 2 = 0"), i.filter("id % 2 = 1"), (F.lit(100.0), F.lit(-50.0)))
    return m.select("id", r6("x").alias("x"), r6("y").alias("y"))


_PRIM = f"""select id, road_class, edge, sigma0, a[1] as a0, a[2] as a1, b[1] as b0, b[2] as b1, x, y, h, w, cos(radians(yaw_deg)) as c, sin(radians(yaw_deg)) as s from (
select *, unnest([0,1,2,3]) as edge, unnest([[-1,-1],[-1,1],[1,1],[1,-1]]) as a, unnest([[-1,1],[1,1],[1,-1],[-1,-1]]) as b from ({INST}))"""


@query(
    f"""select id, road_class, edge, {d6('x + a0*c*h/2 + a1*s*w/2', 'x0')}, {d6('y + a0*s*h/2 - a1*c*w/2', 'y0')}, {d6('x + b0*c*h/2 + b1*s*w/2', 'x1')}, {d6('y + b0*s*h/2 - b1*c*w/2', 'y1')},
{d6('least(greatest(sigma0, 0.0), 1.0)', 'red')} from ({_PRIM})"""
)
def roadmap_primitives(spark, sf_dir):
    p = mapping.primitives(frame(spark, sf_dir, "inst"))
    return p.select("id", "road_class", "edge", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1", "red")])


@query(
    f"""with d as (select id, frame_id, x, y, yaw_deg from ({INST}) where road_class = 1), b as (select id, frame_id, x, y from ({INST}) where road_class in (1, 2))
select b.id, arg_min(d.id, ((b.x-d.x)*(b.x-d.x)+(b.y-d.y)*(b.y-d.y)) * 1e6 + d.id * 1e-3) as direction_id from b join d using (frame_id) group by 1"""
)
def nearest_direction(spark, sf_dir):
    """Each box with the nearest entry of its frame's direction field."""
    i = frame(spark, sf_dir, "inst")
    field = i.filter("road_class = 1").select("frame_id", F.col("id").alias("d_id"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    b = i.filter("road_class in (1, 2)").join(field, "frame_id")
    d2 = (F.col("x") - F.col("dx")) * (F.col("x") - F.col("dx")) + (F.col("y") - F.col("dy")) * (F.col("y") - F.col("dy"))
    return b.groupBy("id").agg(F.min_by("d_id", F.struct(d2.alias("d2"), F.col("d_id").alias("i"))).alias("direction_id"))


_KNN = f"select id, cid, x, y, floor(x/10)::bigint as cx, floor(y/10)::bigint as cy, road_class from ({INST})"


@query(
    f"""with t as materialized ({_KNN}), p as (select a.id, b.id as b_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as d2 from (select *, unnest([cx-1, cx, cx+1]) as kx from t) a
join t b on a.road_class = b.road_class and b.cx = a.kx and b.cy between a.cy-1 and a.cy+1 and a.id <> b.id)
select id, b_id, rank::int as rank from (select *, row_number() over (partition by id order by round(d2, 9), b_id) as rank from p where d2 <= 100) where rank <= 3"""
)
def nearest_neighbours(spark, sf_dir):
    i = frame(spark, sf_dir, "inst")
    from pyspark.sql.window import Window

    k = joins.knn(i, ["road_class"], "id", 8, 10.0)
    w = Window.partitionBy("id").orderBy(F.round("d2", 9), "b_id")
    return k.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("id", "b_id", "rank")


@query()
def map_build(spark, sf_dir):
    """The whole mapping run over all sightings and lines, merged twice on the way: middles of boxes (vtx -1) and vertices of lines."""
    boxes = frame(spark, sf_dir, "inst").filter("road_class in (1, 2)").select("frame_id", *mapper.BOX)
    lines = frame(spark, sf_dir, "line_vtx").selectExpr("line_id div 20 as frame_id", "line_id", "0 as road_class", "vtx", "x", "y", "z", "sigma")
    old = _frames(spark, sf_dir)
    new = old.selectExpr("frame_id", "px + 100 as px", "py - 50 as py", "c*0.8D - s*0.6D as c", "s*0.8D + c*0.6D as s")
    b, v = mapper.build(boxes, lines, old, new, PipelineConfig(mapping_step=old.count() // 2 + 1))
    at = lambda c: F.round(c, 3).alias(c)
    return b.select("road_class", "id", F.lit(-1).alias("vtx"), at("x"), at("y")).unionByName(v.select("road_class", F.col("line_id").alias("id"), "vtx", at("x"), at("y")))


WINDOW_POSES = 8


@query()
def localize_window(spark, sf_dir):
    """Every pose of each sequence displaced, in consecutive windows: their odometry exact, and lines of the map to pull them back."""
    def window(g: Group) -> np.ndarray:
        true_r = [kernels.rotation_of(np.array([0, 0, np.radians(a)])) for a in g["yaw_deg"]]
        true_t = list(np.column_stack((g["x"], g["y"], g["z"])) / 10)
        off = np.array([0.3, -0.2, 0.05])
        w = kernels.Window([r @ kernels.rotation_of(np.array([0, 0, 0.01])) for r in true_r], [t + off for t in true_t])
        w.odometry = [(i, i + 1, true_r[i].T @ true_r[i + 1], true_r[i].T @ (true_t[i + 1] - true_t[i])) for i in range(len(true_t) - 1)]
        for i, (r, t) in enumerate(zip(true_r, true_t)):
            for p, along in (([3.0, 5, 0], [0, 1, 0]), ([-3.0, 8, 0], [0, 1, 0]), ([0, 10.0, 0], [1, 0, 0]), ([0, 4.0, 1.0], [1, 0, 0])):
                q = r @ np.array(p) + t
                w.lines.append((i, np.array(p), q, q + r @ np.array(along, float), 0.1))
        kernels.solve_window(w)
        return np.array([np.linalg.norm(a - b) for a, b in zip(w.t, true_t)])

    def solve(g: Group) -> Group:
        err = [window({k: v[at : at + WINDOW_POSES] for k, v in g.items()}) for at in range(0, len(g["pose_id"]), WINDOW_POSES)]
        return {"seq_id": g["seq_id"], "pose_id": g["pose_id"], "error": np.round(np.concatenate(err), 4)}

    return by_group(frame(spark, sf_dir, "pose"), ["seq_id"], ["t_us", "pose_id"], solve, "seq_id long, pose_id long, error double")


@query("select i // 30 as traj_id, i % 30 as frame_id, 0.0::DOUBLE as x, 0.0::DOUBLE as y_off from range((select count(*) // 1000 * 30 from events)) t(i)")
def localize_drive(spark, sf_dir):
    """One displaced drive for each thousand events: lanes and stop lines of a made-up map pull all frames back."""
    n = frame(spark, sf_dir, "pose").count() // 1000
    lanes = spark.range(130).selectExpr("0 as road_class", "id as seg", "cast(if(id < 65, -2, 2) as double) as ax", "cast(id % 65 - 5 as double) as ay", "0.0D as az").selectExpr("*", "ax as bx", "ay + 1 as by", "0.0D as bz")
    stops = spark.range(40).selectExpr("4 as road_class", "130 + id as seg", "cast(id % 4 - 2 as double) as ax", "cast(6 * (id div 4) as double) as ay", "0.0D as az").selectExpr("*", "ax + 1 as bx", "ay as by", "0.0D as bz")
    frames = spark.range(n * 30).selectExpr("id div 30 as traj_id", "id % 30 as frame_id", "cast(id % 30 as double) as t", "array(1.0D, 0.0D, 0.0D, 0.0D, 1.0D, 0.0D, 0.0D, 0.0D, 1.0D) as r", "array(0.2D, id % 30 - 0.15D, 0.0D) as p")
    sides = frames.selectExpr("traj_id", "frame_id", "explode(sequence(0, 5)) as k").selectExpr("traj_id", "frame_id", "cast(k as long) as pid", "0 as road_class", "cast(if(k % 2 = 0, -2, 2) as double) as x", "2.0D + k as y")
    ahead = frames.selectExpr("traj_id", "frame_id", "explode(sequence(0, 3)) as k").selectExpr("traj_id", "frame_id", "cast(10 + k as long) as pid", "4 as road_class", "k - 1.5D as x", "cast(6 * (frame_id div 6 + 1) - frame_id as double) as y")
    points = sides.unionByName(ahead).selectExpr("*", "0.0D as z", "0.1D as sigma")
    out = localize.localize(frames, points, lanes.unionByName(stops), prior=False)
    return out.selectExpr("traj_id", "frame_id", "round(p[0], 3) + 0.0D as x", "round(p[1] - frame_id, 3) + 0.0D as y_off")
