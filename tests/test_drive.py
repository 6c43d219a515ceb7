"""From rasters to a map, and back onto it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripeworks.operators import extract, kernels, localize
from stripeworks.schema import CameraConfig, PipelineConfig, RoadClass

CAM = CameraConfig(height=200, width=100, resolution=0.1, h=1.5, intrinsics={"fx": 900.0, "fy": 900.0})
CFG = PipelineConfig(min_patch_size=20)


def scene():
    m = np.zeros((200, 100), np.uint8)
    m[60:195, 20:23] = 1  # a solid line
    m[100:140, 50:54] = 2  # a dash
    m[150:170, 70:90] = 3  # a guide marking
    m[180:184, 30:60] = 5  # a stop line
    m[10:12, 80:84] = 2  # too small
    return m


def test_instances_of_a_frame():
    found = {r[2]: r for r in extract.Extractor(CFG, CAM).instances(7, scene())}
    assert set(found) == {RoadClass.SOLID, RoadClass.DASHED, RoadClass.GUIDE, RoadClass.STOP}
    solid, dash = found[RoadClass.SOLID], found[RoadClass.DASHED]
    names = [c.split()[0] for c in extract.INSTANCES.split(", ")]
    solid, dash = dict(zip(names, solid)), dict(zip(names, dash))
    assert solid["line_valid"] and all(abs(p["u"] - 21) < 0.2 for p in solid["line"]) and solid["pixels"] == 135 * 3
    steps = np.diff([p["v"] for p in solid["line"]])
    assert np.allclose(np.abs(steps), 5.0, atol=1e-3), "half a metre apart"
    (c0, c1, c2, c3) = [(p["u"], p["v"]) for p in dash["corners"]]
    assert c0 == pytest.approx((50, 139)) and c1 == pytest.approx((53, 139)) and c2 == pytest.approx((53, 100)) and c3 == pytest.approx((50, 100))
    assert dash["edge_sigma"][2] > dash["edge_sigma"][0] > 0, "further away is less certain"


def test_boxes_need_a_direction():
    m = np.zeros((200, 100), np.uint8)
    m[150:170, 70:90] = 3
    assert extract.Extractor(CFG, CAM).instances(1, m) == []


def test_out_of_range_boxes_are_doubted():
    m = scene()
    m[100:140, 0:4] = 2
    found = extract.Extractor(CFG, CAM).instances(1, m)
    seen, cut = sorted((r for r in found if r[2] == RoadClass.DASHED), key=lambda r: r[14])
    assert cut[14] and not seen[14] and cut[18][0] > 50 * seen[18][0] and cut[18][2] < 50 * seen[18][2]
    black = np.zeros((200, 100), bool)
    black[171] = True
    guide = next(r for r in extract.Extractor(CFG, CAM).instances(1, scene(), black) if r[2] == RoadClass.GUIDE)
    assert not guide[14]
    black[170] = True
    assert next(r for r in extract.Extractor(CFG, CAM).instances(1, scene(), black) if r[2] == RoadClass.GUIDE)[14]


def test_extract_to_world(spark):
    df = spark.createDataFrame([(1, 200, 100, bytearray(scene().tobytes()))], "frame_id long, height int, width int, data binary")
    body = extract.to_body(extract.extract(df, CFG, CAM), CFG, CAM)
    dash = body.filter(F.col("road_class") == 1).first()
    assert dash.h == pytest.approx(3.9) and dash.w == pytest.approx(0.3) and dash.valid_add_to_map
    pose = spark.createDataFrame([(1, ([0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [10.0, 20.0, 0.0]))], "frame_id long, pose struct<r:array<double>,t:array<double>>")
    world = extract.to_world(body, pose).filter(F.col("road_class") == 1).first()
    assert world.mean.x == pytest.approx(10 - dash["mean"].y) and world.mean.y == pytest.approx(20 + dash["mean"].x)


def test_drive_is_put_back_on_the_map(spark):
    """Thirty frames past two lanes and stop lines, displaced by a decimetre or three: the poses come back."""
    rng = np.random.default_rng(3)
    lines, seg = [], 0
    for x in (-2.0, 2.0):
        for y in range(-5, 60):
            lines.append((0, seg, x, float(y), 0.0, x, float(y + 1), 0.0))
            seg += 1
    for y in range(0, 60, 6):
        for x in range(-2, 2):
            lines.append((4, seg, float(x), float(y), 0.0, float(x + 1), float(y), 0.0))
            seg += 1
    lines = spark.createDataFrame(lines, "road_class int, seg long, ax double, ay double, az double, bx double, by double, bz double")
    poses, points = [], []
    true = {}
    for traj in (1, 2):
        shift = np.array([0.2, -0.15, 0.0])
        for i in range(30):
            t = np.array([0.0, 1.0 * i, 0.0])
            true[traj, i] = t
            poses.append((traj, i, float(i), np.eye(3).ravel().tolist(), (t + shift).tolist()))
            for k in range(6):
                points.append((traj, i, k, 0, (-2.0, 2.0)[k % 2], 2.0 + k, 0.0, 0.1))
            stop, y = 6.0 * (i // 6 + 1), float(i)
            for k in range(4):
                points.append((traj, i, 10 + k, 4, -1.5 + k, stop - y, 0.0, 0.1))
            points.append((traj, i, 20, 4, 8.0, 40.0 + float(rng.random()), 5.0, 0.1))
    poses = spark.createDataFrame(poses, localize.POSES)
    points = spark.createDataFrame(points, "traj_id long, frame_id long, pid long, road_class int, x double, y double, z double, sigma double")
    out = localize.localize(poses, points, lines, prior=False).collect()
    assert len(out) == 60
    err = max(float(np.linalg.norm(np.array(r.p)[:2] - true[r.traj_id, r.frame_id][:2])) for r in out)
    assert err < 1e-4
    assert kernels.log_of(np.array(out[0].r).reshape(3, 3)) == pytest.approx([0, 0, 0], abs=1e-4)


def test_points_match_anywhere_on_a_long_segment(spark):
    lines = spark.createDataFrame([(0, 7, 0.0, 0.0, 0.0, 30.0, 40.0, 0.0)], "road_class int, seg long, ax double, ay double, az double, bx double, by double, bz double")
    poses = spark.createDataFrame([(1, 0, 0.0, np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0])], localize.POSES)
    on = [(1, 0, k, 0, 0.6 * k + 0.4, 0.8 * k - 0.3, 0.0) for k in range(1, 50)]
    off = [(1, 0, 100, 0, 0.6 * 60, 0.8 * 60, 0.0), (1, 0, 101, 0, 20.0, 20.0, 0.0)]
    points = spark.createDataFrame(on + off, "traj_id long, frame_id long, pid long, road_class int, x double, y double, z double")
    got = localize.matches(points, poses, lines, 1.0).collect()
    assert sorted(r.pid for r in got) == list(range(1, 50)) and {(r.s.ax, r.s.bx) for r in got} == {(0.0, 30.0)}


def test_windows_slide_over_a_long_drive(spark):
    """Far more poses than a window are pulled back, as by one window over all."""
    n = 70
    lanes = spark.range(2 * n + 40).selectExpr("0 as road_class", "id as seg", f"cast(if(id < {n + 20}, -2, 2) as double) as ax", f"cast(id % {n + 20} - 5 as double) as ay", "0.0D as az").selectExpr("*", "ax as bx", "ay + 1 as by", "0.0D as bz")
    frames = spark.range(n).selectExpr("0L as traj_id", "id as frame_id", "cast(id as double) as t", "array(1.0D, 0.0D, 0.0D, 0.0D, 1.0D, 0.0D, 0.0D, 0.0D, 1.0D) as r", "array(0.3D, cast(id as double), 0.0D) as p")
    points = frames.selectExpr("traj_id", "frame_id", "explode(sequence(0, 5)) as k").selectExpr("traj_id", "frame_id", "cast(k as long) as pid", "0 as road_class", "cast(if(k % 2 = 0, -2, 2) as double) as x", "2.0D + k as y", "0.0D as z", "0.1D as sigma")
    for window in (16, 1000):
        got = localize.localize(frames, points, lanes, prior=False, rounds=2, window=window, overlap=6).collect()
        assert len(got) == n and max(abs(r.p[0]) for r in got) < 1e-3 and max(abs(r.p[1] - r.frame_id) for r in got) < 0.05
