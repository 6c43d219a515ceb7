"""A drive past a dash, a ghost and a line, from sightings to the registered map."""

import numpy as np
import pytest

from stripeworks.operators import extract, mapper
from stripeworks.schema import CameraConfig, PipelineConfig

CFG = PipelineConfig(mapping_step=20, freeze_line_length=15)


def drive(spark):
    """21 frames a metre apart along y; the second merge is at the last of them."""
    rng = np.random.default_rng(1)
    boxes, vertices = [], []
    for f in range(21):
        y0 = 1.0 + f
        if 9.5 - y0 > 2:
            boxes.append((f, f * 4096, 1, 2.0 + rng.normal(0, 0.01), 9.5 + rng.normal(0, 0.01), 0.0, 3.0, 0.2, 90.0, 0.1, 0.1, 0.1, 0.1, 9.5 - y0))
        if f == 2:
            boxes.append((f, f * 4096 + 1, 1, -4.0, 10.0, 0.0, 3.0, 0.2, 90.0, 0.1, 0.1, 0.1, 0.1, 7.0))
        if f == 18:
            boxes.append((f, f * 4096 + 1, 1, 4.0, 30.0, 0.0, 3.0, 0.2, 90.0, 0.1, 0.1, 0.1, 0.1, 11.0))
        for k in range(21):
            vertices.append((f, f * 4096 + 9, 0, k, -2.0 + rng.normal(0, 0.01), y0 + 3 + k / 2, 0.0, 0.1))
    b = spark.createDataFrame(boxes, "frame_id long, id long, road_class int, x double, y double, z double, h double, w double, yaw_deg double, sigma0 double, sigma1 double, sigma2 double, sigma3 double, percept_distance double")
    v = spark.createDataFrame(vertices, "frame_id long, line_id long, road_class int, vtx int, x double, y double, z double, sigma double")
    poses = spark.range(21).selectExpr("id as frame_id", "0.0D as px", "1.0D + id as py", "1.0D as c", "0.0D as s")
    return b, v, poses


def test_map_of_a_drive(spark):
    b, v, poses = drive(spark)
    truth = poses.selectExpr("frame_id", "100 - py as px", "50.0D as py", "0.0D as c", "1.0D as s")  # turned left
    boxes, lines = mapper.build(b, v, poses, truth, CFG)
    boxes = {r.id: r for r in boxes.collect()}
    ahead = boxes.pop(18 * 4096 + 1)
    (dash,) = boxes.values()
    assert (dash.x, dash.y) == (pytest.approx(90.5, abs=0.1), pytest.approx(52, abs=0.1)), "the ghost is gone, the dash registered by its links"
    assert abs(dash.yaw_deg) == pytest.approx(180, abs=1) and dash.h == pytest.approx(3, abs=0.1) and dash.links == [0, 1, 2, 3, 4, 5, 6]
    assert not (dash.frozen or dash.merged), "unfrozen for the last merge, which lets single boxes pass"
    assert (ahead.x, ahead.y) == (4.0, 30.0), "what is not frozen is not registered"
    rows = lines.orderBy("vtx").collect()
    assert len({r.line_id for r in rows}) == 1 and all(abs(r.y - 48) < 0.1 for r in rows)
    assert min(r.x for r in rows) == pytest.approx(66, abs=0.2) and max(r.x for r in rows) == pytest.approx(96, abs=0.2)


def test_no_sightings_no_map(spark):
    b, v, poses = drive(spark)
    boxes, lines = mapper.build(b.limit(0), v.limit(0), poses.limit(1), cfg=CFG)
    assert boxes.count() == 0 and lines.count() == 0


def test_rows_of_extracted_instances(spark):
    """A raster with a dash and a solid line, seen from (10, 20): box and vertices lie where the pixels say."""
    cam = CameraConfig(height=200, width=100, resolution=0.1, h=1.5, intrinsics={"fx": 900.0, "fy": 900.0})
    cfg = PipelineConfig(min_patch_size=20)
    mask = np.zeros((200, 100), np.uint8)
    mask[60:195, 20:23], mask[100:140, 50:54] = 1, 2
    frames = spark.createDataFrame([(7, 200, 100, bytearray(mask.tobytes()))], "frame_id long, height int, width int, data binary")
    pose = spark.createDataFrame([(7, ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [10.0, 20.0, 0.0]))], "frame_id long, pose struct<r:array<double>,t:array<double>>")
    world = extract.to_world(extract.to_body(extract.extract(frames, cfg, cam), cfg, cam), pose)
    (box,) = mapper.boxes_of(world).collect()
    assert (box.x, box.y, box.h, box.w, box.yaw_deg) == tuple(pytest.approx(v, abs=1e-6) for v in (10.15, 27.95, 3.9, 0.3, 90.0)) and box.id // 4096 == 7
    assert box.sigma2 > box.sigma0 > 0, "the far edge is less certain"
    rows = mapper.vertices_of(world, cam).orderBy("vtx").collect()
    assert len({r.line_id for r in rows}) == 1 and [r.vtx for r in rows] == list(range(len(rows))) and len(rows) > 15
    assert all(r.x == pytest.approx(10 - 2.9, abs=0.05) for r in rows)
    near = min(rows, key=lambda r: r.y)
    assert all(r.sigma >= near.sigma > 0 for r in rows)
