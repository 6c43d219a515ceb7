"""Schemas, the class enumeration and the configuration of the road-marking model."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T


class RoadClass(IntEnum):
    """Fixed values of the stored maps."""

    EMPTY = -1
    SOLID = 0
    DASHED = 1
    GUIDE = 2
    ZEBRA = 3
    STOP = 4


BOXES = (RoadClass.DASHED, RoadClass.GUIDE)
LINES = (RoadClass.SOLID, RoadClass.STOP)

_D, _L, _I, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
POINT = T.StructType([T.StructField(c, _D) for c in "xyz"])
MATRIX = T.ArrayType(_D)

#: One pose of a trajectory: rotation row by row, position, velocity.
POSE = T.StructType([T.StructField("r", MATRIX), T.StructField("t", T.ArrayType(_D)), T.StructField("v", T.ArrayType(_D)), T.StructField("valid", _B)])
TRAJECTORY = T.StructType([T.StructField("traj_id", T.StringType()), T.StructField("t", _D), T.StructField("pose", POSE)])
STAMP = T.StructType([T.StructField("t", _D), T.StructField("image", T.StringType())])

#: A marking of the stored map.  ``box`` has the corners bottom left, bottom right, top right, top left.
INSTANCE = T.StructType(
    [
        T.StructField("id", _L),
        T.StructField("road_class", _I),
        T.StructField("line_valid", _B),
        T.StructField("frozen", _B),
        T.StructField("merged", _B),
        T.StructField("valid_add_to_map", _B),
        T.StructField("mean", POINT),
        T.StructField("box", T.ArrayType(POINT)),
        T.StructField("box_sigma", T.ArrayType(_D)),
        T.StructField("line", T.ArrayType(POINT)),
        T.StructField("mean_cov", MATRIX),
        T.StructField("line_cov", T.ArrayType(MATRIX)),
        T.StructField("percept_distance", _D),
    ]
)


@dataclass(frozen=True)
class CameraConfig:
    """Bird's-eye raster and mounting of the camera."""

    height: int = 800
    width: int = 400
    resolution: float = 0.05
    alpha: float = 0.0
    theta: float = 0.0
    h: float = 1.82
    rotation: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0)
    translation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    intrinsics: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineConfig:
    """Thresholds of extraction, mapping and localisation."""

    pose_tolerance: float = 0.001
    pose_smooth_window: int = 20
    large_slope_threshold: float = 1.0
    min_patch_size: int = 50
    dashed_min_height: float = 1.0
    dashed_max_height: float = 10.0
    dashed_max_distance: float = 12.0
    guide_max_height: float = 1000.0
    guide_max_distance: float = 20.0
    solid_max_distance: float = 15.0
    stop_max_distance: float = 12.0
    need_smooth: bool = True
    mapping_step: int = 10
    active_distance: float = 3.0
    freeze_line_distance: float = 10.0
    freeze_line_length: int = 50
    link_frames: int = 200
    window_size: int = 100
    keyframe_step: int = 5
    keyframe_distance: float = 1.0
    max_strict_match_dist: float = 1.0
    search_radius: float = 20.0
