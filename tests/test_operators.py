"""Operators whose outcome SQL does not cover: folds, streams, merging, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from stripeworks.operators import aggregates, joins, mapping, raster, windows
from stripeworks.operators.components import components
from stripeworks.plans.fixtures import frame
from stripeworks.schema import CameraConfig
from stripeworks.storage import cut, discard


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 60)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]}[shape]
    rng.shuffle(edges)
    root = {x: x for p in edges for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), cut, discard).collect()}
    assert got == {x: find(x) for x in touched}


def test_slope_stream_is_the_batch(spark, sf_dir):
    q = e.queries()
    key = lambda df: sorted((r.seq_id, r.pose_id, round(r.diff_pitch, 6), r.jump, r.held) for r in df.collect())
    poses = frame(spark, sf_dir, "pose")
    batch = windows.slope_reset(poses, 20, 3.0)
    assert key(q["stream_attitude"](spark, sf_dir)) == key(batch)
    assert batch.filter("jump").count() > 0


def test_slope_state_resets():
    s = windows.SlopeState(20, 1.0)
    flags = [s.step(p, 0.0)[2] for p in [0.0] * 10 + [5.0] * 3]
    assert flags[:10] == [False] * 10 and flags[10] is True
    assert s.step(5.0, 0.0)[3] == 4


def test_keyframe_stream_window(spark, sf_dir):
    rows = e.queries()["stream_keyframes"](spark, sf_dir).collect()
    assert max(r.held for r in rows) <= 20
    first = {r.pose_id for r in rows if r.keyframe}
    batch = windows.keyframes(frame(spark, sf_dir, "pose"), ["seq_id"], "t_us", 100.0)
    assert first == {r.pose_id for r in batch.collect()}


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.5)], "id long, t double")
    right = spark.createDataFrame([(10.0, "a"), (9.9995, "b"), (20.0015, "c"), (30.5009, "d")], "pt double, v string")
    got = {r.id: (r.pt, r.v) for r in joins.asof_join(left, right, "t", "pt", ["v"], 0.001, 0.001).collect()}
    assert got == {1: (9.9995, "b"), 3: (30.5009, "d")}


def test_asof_against_brute_force(spark):
    rng = random.Random(8)
    a = [(i, rng.randint(0, 5000)) for i in range(300)]
    b = [(i, rng.randint(0, 5000)) for i in range(200)]
    left, right = spark.createDataFrame(a, "id long, t long"), spark.createDataFrame(b, "pid long, pt long")
    got = {r.id: (r.pt, r.pid) for r in joins.asof_join(left, right, "t", "pt", ["pid"], 30).collect()}
    want = {}
    for i, t in a:
        after = sorted((pt, p) for p, pt in b if pt >= t)
        if after and after[0][0] - t <= 30:
            want[i] = after[0]
    assert got == want


def test_frozen_boxes_stay_alone(spark):
    box = lambda i, x, frozen: (i, 1, x, 0.0, 4.0, 2.0, 0.0, frozen)
    df = spark.createDataFrame([box(1, 0.0, False), box(2, 1.0, True), box(3, 2.0, False), box(4, 50.0, False)], "id long, road_class int, x double, y double, h double, w double, yaw_deg double, frozen boolean")
    got = {r.id: r.cluster for r in mapping.box_clusters(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_merge_fates(spark, sf_dir):
    inst = frame(spark, sf_dir, "inst").filter("road_class in (1, 2)")
    last = mapping.merge_boxes(inst, 1, None).collect()
    assert {r.state for r in last} <= {"passed", "merged"} and all(r.n == 1 for r in last if r.state == "passed")
    online = mapping.merge_boxes(inst, 0, (2000.0, 2000.0, 30.0)).collect()
    assert all(r.n > 1 or r.state == "passed" or r.state == "merged" for r in online)


def test_registration_without_links_is_null_and_cleaned(spark):
    pts = spark.createDataFrame([(1, 0.0, 5.0, 2.0, 1.0), (2, 100.0, 100.0, 2.0, 1.0)], "id long, x double, y double, h double, w double")
    pose = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 0.0)], "frame_id long, px double, py double, c double, s double")
    links = spark.createDataFrame([(1, 7)], "id long, frame_id long")
    out = mapping.geo_register(pts, links, pose, pose.withColumn("px", F.lit(10.0)), "id")
    moved = out.select("id", F.col("rx").alias("x"), F.col("ry").alias("y"), "h", "w")
    assert [(r.id, r.x, r.y) for r in mapping.clean_boxes(moved).collect()] == [(1, 10.0, 5.0)]


def test_short_lines_are_cleaned(spark):
    v = spark.createDataFrame([(i, k, k * step, 0.0) for i, step in ((1, 2.0), (2, 0.8)) for k in range(6)] + [(3, k, float("nan") if k == 2 else k * 2.0, 0.0) for k in range(6)], "line_id long, vtx int, x double, y double")
    assert [r.line_id for r in mapping.clean_lines(v.select("line_id").distinct(), v).collect()] == [1]


def test_rigid_alignment(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.normal(size=(20, 3))
    t = 0.4
    r = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    q = p @ r.T + [1, 2, 3]
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(q, p)], "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got_r, got_t = aggregates.rigid_alignment(df)
    assert np.allclose(got_r, r) and np.allclose(got_t, [1, 2, 3])


def test_birds_eye(spark):
    p = {"fx": 100.0, "fy": 100.0, "cx": 50.0, "cy": 20.0, "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0, "image_width": 100, "image_height": 80}
    cam = CameraConfig(height=20, width=10, resolution=0.5, intrinsics=p)
    raw = bytearray(100 * 80)
    u, v = 6, 10
    x, z = (u - 5) * 0.5, (20 - v - 1) * 0.5
    raw[int(100 * 1.5 / z + 20 + 0.5) * 100 + int(100 * x / z + 50 + 0.5)] = 3
    df = spark.createDataFrame([(1, 80, 100, 1, bytes(raw), [float(v) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)], 1.5)], "frame_id long, height int, width int, channels int, data binary, r array<double>, d double")
    px = raster.pixels_of(raster.birds_eye(df, cam)).collect()
    assert (u, v) in {(r.col, r.row) for r in px} and {r.gray for r in px} == {3}
    assert raster.components(raster.pixels_of(raster.birds_eye(df, cam))).count() == len(px)


def test_import_without_the_corpus_package():
    import subprocess
    import sys
    import os

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['stripeworks.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'eval_accuracy' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 50


def test_groups_that_span_batches(spark):
    from stripeworks.operators.grouped import by_group

    df = spark.createDataFrame([(i % 7, i) for i in range(1000)], "k long, v long").withColumn("k", F.when(F.col("v") < 700, 3).otherwise(F.col("k")).cast("long"))
    want = {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = by_group(df, ["k"], ["v"], lambda g: {"k": int(g["k"][0]), "n": len(g["v"]), "s": int(g["v"].sum())}, "k long, n long, s long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {r.k: (r.n, r.s) for r in got} == want and len(got) == len(want)


def test_localize_window_solves_every_pose(spark, sf_dir):
    import __spark_entry__ as e

    got = e.queries()["localize_window"](spark, sf_dir).collect()
    ids = [r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    assert sorted(r.pose_id for r in got) == sorted(ids)
    assert max(r.error for r in got) < 0.01


def test_boxes_of_any_length_meet(spark):
    """Guide boxes far longer than the grid's cells overlap at their ends, once a pair."""
    rows = [(1, 2, 0.0, 0.0, 60.0, 1.0, 0.0), (2, 2, 45.0, 0.0, 60.0, 1.0, 0.0), (3, 2, 0.0, 500.0, 900.0, 1.0, 90.0), (4, 2, 0.0, 949.0, 3.0, 2.0, 0.0), (5, 2, 5.0, 600.0, 4.0, 1.0, 0.0), (6, 2, 20.0, 9.0, 4.0, 50.0, 10.0)]
    df = spark.createDataFrame([(*r, False) for r in rows], "id long, road_class int, x double, y double, h double, w double, yaw_deg double, frozen boolean")
    got = sorted((r.id, r.b_id) for r in joins.rectangle_pairs(df, ["road_class"], 20.0).collect())
    assert got == [(1, 2), (1, 6), (2, 6), (3, 4)]


def test_merged_boxes_name_their_best_member(spark):
    cols = "id long, road_class int, x double, y double, h double, w double, yaw_deg double, sigma0 double, sigma1 double, sigma2 double, sigma3 double, percept_distance double, frozen boolean, merged boolean"
    box = lambda i, cls, x, h, w, far: (i, cls, x, 0.0, h, w, 0.0, 0.1, 0.1, 0.1, 0.1, far, False, False)
    rows = [box(1, 1, 0.0, 4.0, 0.2, 9.0), box(2, 1, 0.1, 4.0, 0.2, 3.0), box(3, 1, 0.1, 2.0, 0.2, 1.0), box(4, 2, 50.0, 1.0, 0.5, 2.0), box(5, 2, 50.1, 1.0, 0.5, 2.0), box(6, 2, 90.0, 4.0, 2.0, 2.0), box(7, 2, 90.1, 4.0, 2.0, 5.0)]
    got = {r.cluster: r for r in mapping.merge_boxes(spark.createDataFrame(rows, cols), 1, None).collect()}
    assert set(got) == {1, 6}, "the small guide box is dropped"
    assert got[1].best_id == 2 and got[1].percept_distance == 3.0 and got[6].best_id == 6 and got[6].road_class == 2


def test_lines_freeze_without_a_vehicle(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 5.0, 3, False), (2, 1, 5.0, 5.0, 0, False), (3, 4, 5.0, 5.0, 3, False)], "id long, road_class int, x double, y double, vertices int, frozen boolean")
    for vehicle in (None, (0.0, 0.0, 30.0)):
        assert {r.id: r.frozen for r in mapping.freeze_flags(df, vehicle).collect()} == {1: True, 2: False, 3: True}
    assert not any(r.frozen for r in mapping.freeze_flags(df, (1.0, 1.0, 0.0)).collect())


def test_matching_is_in_space(spark):
    q = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 3.0, 0.2)], "qid long, road_class int, x double, y double, z double, h double, w double")
    t = spark.createDataFrame([(7, 1, 0.5, 0.0, 9.0, 3.0, 0.2), (8, 1, 3.0, 0.0, 2.0, 3.0, 0.2)], "id long, road_class int, x double, y double, z double, h double, w double")
    r = mapping.match(q, t).first()
    assert r.id == 8 and abs(r.distance - 3.0) < 1e-12, "the nearest from height 0, measured from the instance's own"
    assert mapping.match(q, t, strict=1.0).collect() == []


def test_ground_rotation_of_any_normal(spark):
    from stripeworks.functions import camera

    normals = [(0.0, -1.0, 0.0), (0.0, 2.0, 0.0), (0.1, -0.9, 0.3), (-3.0, 0.5, 0.2)]
    for n in normals:
        m = camera.rotation_from_normal(tuple(F.lit(v) for v in n))
        r = np.array(spark.range(1).select(F.array(*m).alias("m")).first().m).reshape(3, 3)
        np.testing.assert_allclose(r @ r.T, np.eye(3), atol=1e-12)
        np.testing.assert_allclose(np.linalg.det(r), 1.0)
        np.testing.assert_allclose(r @ n / np.linalg.norm(n), (0, -1, 0), atol=1e-12)


def test_ramps_and_depths(spark):
    from stripeworks.functions import markings

    rows = spark.range(128).select(markings.ramp_colour(F.col("id")).alias("jet"), markings.ramp_colour(F.col("id"), "autumn").alias("autumn")).collect()
    assert rows[0].jet == [0, 0, 0.53125] and rows[16].jet == [0, 0.03125, 1] and rows[80].jet == [1, 0.96875, 0] and rows[127].jet == [0.5, 0, 0]
    assert rows[0].autumn == [1, 0, 0] and rows[127].autumn == [1, 1, 0]
    d = spark.createDataFrame([(0.0,), (5.0,), (99.0,)], "d double").select(markings.depth_colour(F.col("d"), 5.0, 50.0).alias("c")).collect()
    assert [r.c for r in d] == [[0, 0, 0], [0, 0, 127], [135, 0, 0]]


def test_drawing_leaves_out_what_has_no_shape(spark):
    from stripeworks.operators import mapping
    from stripeworks.schema import INSTANCE

    p, cov = {"x": 1.0, "y": 2.0, "z": 0.0}, [0.02, 0.0, 0.0, 0.0, 0.14, 0.0, 0.0, 0.0, 0.0]
    row = lambda i, cls, line, n, ok=True: (i, cls, line, False, False, ok, p, [p] * 4, [0.1] * 4, [p] * n, cov, [cov] * n, 1.0)
    rows = [row(0, 0, True, 3), row(1, 0, True, 1), row(2, 4, True, 2), row(3, 3, True, 5), row(4, 1, False, 0), row(5, 2, False, 0), row(6, 1, False, 0, False)]
    out = {r.id: r for r in mapping.drawing(spark.createDataFrame(rows, INSTANCE)).collect()}
    assert sorted(out) == [0, 2, 4, 5]
    np.testing.assert_allclose(out[0].colours, [[0.75, 1.0, 0.0]] * 3)
    assert out[2].colours == [[1.0, 0.0, 0.0]] * 2 and len(out[4].points) == 4
    assert out[4].colours[0] == list(mapping.DASHED_COLOUR) and out[5].colours[0] == list(mapping.OTHER_COLOUR)
