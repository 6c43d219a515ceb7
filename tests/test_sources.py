"""Readers and writers: round trips."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripeworks import sinks
from stripeworks.functions import camera
from stripeworks.schema import INSTANCE, PipelineConfig
from stripeworks.sources import binary_map, config, images, text


def _lines(spark, body):
    return spark.createDataFrame([(v, i) for i, v in enumerate(body.split("\n"))], "value string, line_no long")


def test_stamps(spark, tmp_path):
    p = tmp_path / "stamps.txt"
    p.write_text("# comment\n\n1.5,a.png\n2.5 b.png\n1.5,c.png\n")
    assert sorted(text.stamps(spark, str(p)).collect()) == [(1.5, "c.png"), (2.5, "b.png")]


def test_trajectories_and_results(spark, tmp_path):
    rows = ["100.0 -2267800 5009300 3221000 1 0 0 0", "101.0,-2267790,5009310,3221005,0.9,0.1,0.2,0.3", "# note", "101.0 -2267790 5009310 3221005 1 0 0 0"]
    traj, ref = text.global_trajectory_from(_lines(spark, "\n".join(rows)))
    got = {r.t: r.pose for r in traj.collect()}
    assert ref == (-2267800.0, 5009300.0, 3221000.0) and len(got) == 2
    assert np.allclose(got[100.0].t, 0, atol=1e-6) and np.allclose(got[100.0].r, np.eye(3).ravel(), atol=1e-9)
    assert np.linalg.norm(got[101.0].t) == pytest.approx(15.0)
    sinks.write_poses(traj, ref, str(tmp_path / "out"))
    back = text.result_poses(text.lines_of(spark, str(tmp_path / "out"))).orderBy("t").collect()
    assert [r.t for r in back] == [100.0, 101.0]
    assert (back[1].x, back[1].y, back[1].z) == (-2267790.0, 5009310.0, 3221005.0) and back[1].qw == pytest.approx(1.0)


def test_result_reader_stops_at_a_blank_line(spark):
    d = text.result_poses(_lines(spark, "% head\n1 0 0 0 1 0 0 0\n2 0 0 0 1 0 0 0\n\n3 0 0 0 1 0 0 0"), 1.5, 9.0)
    assert [r.t for r in d.collect()] == [2.0]


def test_other_trajectory_formats(spark):
    ref = (-2267800.0, 5009300.0, 3221000.0)
    pos = "-2267800 5009300 3221000"
    v = text.vio(_lines(spark, f"1 {pos} 1 2 3 10 20 30"), ref).first()
    assert v.pose.valid and v.pose.r[7] == pytest.approx(math.sin(math.radians(10))) and np.linalg.norm(v.pose.v) == pytest.approx(math.sqrt(14))
    f = text.fused(_lines(spark, f"1 {pos} 1 2 3 0 0 30 0 0 0 0 0 0 GPS 20 1 Fixed 3\n2 {pos} 1 2 3 0 0 30 0 0 0 0 0 0 GPS 20 1 Float 3\n3 {pos} 1 2 3 0 0 30 0 0 0 0 0 0 GPS 9 1 Fixed 3"), ref).orderBy("t").collect()
    assert [r.pose.valid for r in f] == [True, False, False]
    assert math.degrees(math.atan2(-f[0].pose.r[1], f[0].pose.r[4])) == pytest.approx(-30), "yaw runs the other way"
    g = text.gnss(_lines(spark, f"1 {pos} 1 2 3 1 1 1 1 1 1 15 1 1 Fixed 1 1 1"), ref).first()
    assert g.pose.valid and list(g.pose.r) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    i = text.inertial(_lines(spark, f"2000 1 {pos} " + "0 " * 19 + "30 10 20"), ref).first()
    assert i.t == 1.0 and i.pose.v is None and i.pose.r[7] == pytest.approx(math.sin(math.radians(10)))


def _instance(i, cls, n, m):
    p = lambda k: (float(k), float(k) + 0.5, 0.25)
    return (i, cls, True, False, bool(i % 2), True, p(i), [p(k) for k in range(4)], [0.5, 0.25, 0.125, 1.0], [p(k) for k in range(n)], [float(k) for k in range(9)], [[0.5] * 9] * m, 12.5)


def test_binary_map_round_trip(spark, tmp_path):
    rows = [_instance(3, 1, 0, 0), _instance(1, 0, 5, 5), _instance(2, 0, 3, 2)]
    df = spark.createDataFrame(rows, INSTANCE)
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    binary_map.write(df, str(a), (1.0, 2.0, 3.0), 7)
    back = binary_map.read(spark, str(a))
    assert {tuple(r.ref) for r in back.collect()} == {(1.0, 2.0, 3.0)}
    assert sorted(back.drop("path", "ref").collect()) == sorted(df.collect())
    binary_map.write(back.drop("path", "ref"), str(b), (1.0, 2.0, 3.0), 7)
    assert a.read_bytes() == b.read_bytes()
    head, per_class = 32, 12
    assert len(a.read_bytes()) == head + 2 * per_class + 3 * 160 + 12 * 8 + 36 * 7
    assert struct.calcsize("<qqi????3f12f4fQ9fQd") == 160


def test_binary_map_with_a_tail_is_refused(tmp_path):
    raw = binary_map._HEADER.pack(0, 0, 0, 0) + b"x"
    with pytest.raises(ValueError):
        list(binary_map.parse(raw))


PINHOLE = """%YAML:1.0
---
model_type: PINHOLE
camera_name: cam
image_width: 1024
image_height: 768
distortion_parameters:
   k1: -0.1
   k2: 0.05
   p1: -0.0005
   p2: -0.0002
projection_parameters:
   fx: 889.9
   fy: 882.4
   cx: 507.2
   cy: 384.8
Tic: !!opencv-matrix
   rows: 2
   cols: 2
   dt: d
   data: [1, 2,
      3, 4]
"""


def test_yaml():
    p = config.camera(PINHOLE)
    assert p["model_type"] == "pinhole" and p["fx"] == 889.9 and config.parse(PINHOLE)["Tic"] == [[1.0, 2.0], [3.0, 4.0]]
    assert config.camera(config.camera_yaml(p)) == p
    for kind, groups in config.GROUPS.items():
        q = {"model_type": kind, "camera_name": "c", "image_width": 4, "image_height": 3} | {n: 0.5 for names in groups.values() for n in names}
        if kind == "scaramuzza":
            q |= {"poly": [1.0] * config.POLY, "inv_poly": [2.0] * config.INV_POLY}
        assert config.camera(config.camera_yaml(q)) == q
    with pytest.raises(ValueError):
        config.camera("model_type: NONE\n")
    assert config.pipeline("pose_smooth_window: 15\n").pose_smooth_window == 15 and config.pipeline("") == PipelineConfig()


def _png(path, array):
    import zlib

    h, w = array.shape[:2]
    kind = 0 if array.ndim == 2 else 2
    raw = b"".join(b"\0" + array[r].astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_masks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "mask").mkdir()
    colour = np.zeros((3, 4, 3), np.uint8)
    colour[0, 0] = (10, 20, 30)
    _png(tmp_path / "raw/f1.png", colour)
    _png(tmp_path / "mask/f1.png", np.arange(8, dtype=np.uint8).reshape(2, 4))
    raw, mask = images.images(spark, str(tmp_path / "raw")), images.images(spark, str(tmp_path / "mask"))
    r, m = raw.first(), mask.first()
    assert r.channels == 3 and list(r.data[:3]) == [30, 20, 10], "blue, green, red"
    assert m.channels == 1 and list(m.data) == list(range(8))
    frames = spark.createDataFrame([(1.0, "f1.jpg"), (2.0, "f2.jpg")], "t double, image string")
    assert [r.t for r in images.with_masks(frames, mask).collect()] == [1.0]
    assert text.image_batches(spark, str(tmp_path / "raw")).first().batch == 0


def test_scaramuzza_lift_is_a_ray(spark):
    m = {"model_type": "scaramuzza", "poly": [-250.0, 0.0, 1.2e-3, 0.0, 0.0], "inv_poly": [1.0], "ac": 1.0, "ad": 0.0, "ae": 0.0, "cx": 500.0, "cy": 400.0}
    x, y, z = camera.lift(F.lit(530.0), F.lit(440.0), m)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z")).first()
    assert (r.x, r.y) == (30.0, 40.0) and r.z == pytest.approx(250 - 1.2e-3 * 2500)


def test_virtual_pinhole_of_a_pinhole_is_itself(spark):
    p = {"model_type": "pinhole", "image_width": 101, "image_height": 81, "fx": 100.0, "fy": 90.0, "cx": 49.0, "cy": 41.0, "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0}
    v = camera.virtual_pinhole(spark, p)
    assert all(v[k] == pytest.approx(p[k]) for k in ("fx", "fy", "cx", "cy"))


def test_images_are_numbered_in_the_order_of_their_names(spark, tmp_path):
    for i in range(23):
        folder = tmp_path / "many" / f"d{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i:03d}.png").write_bytes(b"x")
    got = {r.path: r.batch for r in text.image_batches(spark, str(tmp_path / "many"), 5).collect()}
    assert [got[p] for p in sorted(got)] == [i // 5 for i in range(23)]
    (tmp_path / "none").mkdir()
    assert text.image_batches(spark, str(tmp_path / "none")).count() == 0
