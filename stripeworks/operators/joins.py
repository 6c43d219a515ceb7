"""Joins that stock SQL lacks: as-of, radius, nearest, rectangle, polyline, region.

All of them turn the predicate into equality on a cell of time or space, so
Spark shuffles and sorts by cell; nothing is compared across the whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], tolerance, slack=0, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Inner forward as-of join: each left row with the first right row at or after ``left_time - slack``.

    Kept if the times differ by at most ``tolerance`` (less than, if
    ``strict``).  ``values`` of the right side are added under their names,
    with ``right_time``.  Of right rows with equal time the smallest values
    win.  Time is dealt into cells as wide as the reach of a match; each right
    row visits the cells from which it can be seen, so no window is wider.
    """
    span = float(tolerance) + float(slack)
    cell = lambda t: F.floor(t / F.lit(span)).cast("long")
    r = right.select(*keys, F.col(right_time).alias("__t"), F.struct(F.col(right_time).alias("t"), *values).alias("__v"))
    r = r.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("__t") - F.lit(float(tolerance))), cell(F.col("__t") + F.lit(float(slack)))))))
    l = left.withColumn("__t", F.col(left_time) - F.lit(slack)).withColumn("__cell", cell(F.col(left_time)))
    both = l.withColumn("__side", F.lit(0)).unionByName(r.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__cell").orderBy(F.col("__t").desc(), F.col("__side").desc(), F.col("__v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__hit", F.last("__v", ignorenulls=True).over(w)).filter("__side = 0 and __hit is not null")
    gap = F.abs(F.col("__hit.t") - F.col(left_time))
    kept = found.filter(gap < tolerance if strict else gap <= tolerance)
    return kept.select(*left.columns, F.col("__hit.t").alias(right_time), *[F.col(f"__hit.{v}").alias(v) for v in values])


def near_cells(x: Column, y: Column, size: float) -> Column:
    """Array of the nine cells around a point."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def in_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))


def grid_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of rows within 3 x 3 cells; ``b``'s columns must be named apart (``b`` has x, y as ``b_x``, ``b_y``).

    Side ``a`` visits nine cells; ``b`` stays in its own, so a pair comes once.
    """
    visits = a.withColumn("__c", F.explode(near_cells(F.col(x), F.col(y), size))).withColumn("cx", F.col("__c.cx")).withColumn("cy", F.col("__c.cy")).drop("__c")
    return visits.join(in_cell(b, f"b_{x}", f"b_{y}", size), [*on, "cx", "cy"]).drop("cx", "cy")


def renamed(df: DataFrame, keep: Sequence[str], prefix: str = "b_") -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def radius_nearest(queries: DataFrame, targets: DataFrame, on: Sequence[str], query_id: str, target_id: str, radius: float, distance2: Column) -> DataFrame:
    """Each query with its nearest target within ``radius``; ties by target id.

    ``distance2`` is the squared distance in terms of both sides, ``targets`` under the prefix ``b_``.
    """
    pairs = grid_pairs(queries, renamed(targets, on), on, radius).withColumn("d2", distance2).filter(F.col("d2") <= radius * radius)
    best = F.min_by(F.struct("*"), F.struct("d2", f"b_{target_id}"))
    return pairs.groupBy(query_id).agg(best.alias("__m")).select("__m.*")


def knn(df: DataFrame, on: Sequence[str], id_col: str, k: int, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """The ``k`` nearest other rows within ``radius``: ``id, b_id, d2, rank``; ties by id."""
    pairs = grid_pairs(df.select(*on, id_col, x, y), renamed(df.select(*on, id_col, x, y), on), on, radius, x, y).filter(F.col(id_col) != F.col(f"b_{id_col}"))
    d2 = (F.col(x) - F.col(f"b_{x}")) * (F.col(x) - F.col(f"b_{x}")) + (F.col(y) - F.col(f"b_{y}")) * (F.col(y) - F.col(f"b_{y}"))
    w = Window.partitionBy(*on, id_col).orderBy("d2", f"b_{id_col}")
    near = pairs.withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*on, id_col, f"b_{id_col}", "d2", "rank")


def rectangles_overlap(ax, ay, ah, aw, ac, as_, bx, by, bh, bw, bc, bs) -> Column:
    """Separating-axis test of two rectangles by centre, length along and width across heading (cos, sin); touching counts."""
    dx, dy = bx - ax, by - ay
    cos, sin = F.abs(ac * bc + as_ * bs), F.abs(ac * bs - as_ * bc)
    along_a = F.abs(dx * ac + dy * as_) <= (ah + bh * cos + bw * sin) / 2
    across_a = F.abs(dy * ac - dx * as_) <= (aw + bh * sin + bw * cos) / 2
    along_b = F.abs(dx * bc + dy * bs) <= (bh + ah * cos + aw * sin) / 2
    across_b = F.abs(dy * bc - dx * bs) <= (bw + ah * sin + aw * cos) / 2
    return along_a & across_a & along_b & across_b


def rectangle_pairs(boxes: DataFrame, on: Sequence[str], size: float, id_col: str = "id", heading: str = "yaw_deg", frozen: str | None = "frozen") -> DataFrame:
    """Pairs ``id < b_id`` of overlapping boxes (x, y, h, w, heading in degrees); frozen boxes stay alone.

    Boxes may be of any length: one over ``size`` is filed under the cell of each of its pieces that are no larger, and
    boxes overlap where pieces do, whose centres are then within a cell's width.
    """
    rows = boxes if frozen is None else boxes.filter(~F.col(frozen))
    rows = rows.select(*on, id_col, "x", "y", "h", "w", F.cos(F.radians(F.col(heading))).alias("c"), F.sin(F.radians(F.col(heading))).alias("s"))
    n, m = (F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int") for c in ("h", "w"))
    filed = rows.withColumn("__n", n).withColumn("__m", m).withColumn("__k", F.explode(F.expr("sequence(0, __n * __m - 1)")))
    along = ((F.col("__k") % F.col("__n") + 0.5) / F.col("__n") - 0.5) * F.col("h")
    across = (F.floor(F.col("__k") / F.col("__n")) + 0.5) / F.col("__m") * F.col("w") - F.col("w") / 2
    filed = filed.withColumn("gx", F.col("x") + along * F.col("c") + across * F.col("s")).withColumn("gy", F.col("y") + along * F.col("s") - across * F.col("c")).drop("__n", "__m", "__k")
    pairs = grid_pairs(filed, renamed(filed, on), on, size * 2**0.5, "gx", "gy").filter(F.col(id_col) < F.col(f"b_{id_col}"))
    return pairs.filter(rectangles_overlap(*[F.col(c) for c in ("x", "y", "h", "w", "c", "s", "b_x", "b_y", "b_h", "b_w", "b_c", "b_s")])).select(*on, id_col, f"b_{id_col}").distinct()


def polyline_directions(vertices: DataFrame, line: str = "line_id", order: str = "vtx") -> DataFrame:
    """Adds the unit direction (ux, uy) at each vertex: from its predecessor, at the first to its successor."""
    w = Window.partitionBy(line).orderBy(order)
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c))
    d = vertices.withColumn("__dx", step("x")).withColumn("__dy", step("y"))
    n = F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))
    return d.withColumn("ux", F.col("__dx") / n).withColumn("uy", F.col("__dy") / n).drop("__dx", "__dy")


def polyline_pairs(vertices: DataFrame, on: Sequence[str] = (), reach: float = 1.0, across1: float = 0.4, across2: float = 1.0, cos_theta: float = 0.984807753012208) -> DataFrame:
    """Pairs ``line_id < b_line_id`` of polylines that run along each other where they are closest.

    At the closest pair of vertices (ties by their order): nearer than
    ``reach``, the offset across one line under ``across1`` and across the
    other under ``across2``, headings within the angle.  Only vertices within
    ``reach`` of each other can decide that, so cells are as wide as that.
    """
    v = polyline_directions(vertices).select(*on, "line_id", "vtx", "x", "y", "ux", "uy")
    pairs = grid_pairs(v, renamed(v, on), on, reach).filter("line_id < b_line_id")
    dx, dy = F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")
    pairs = pairs.withColumn("d2", dx * dx + dy * dy).withColumn("dx", dx).withColumn("dy", dy)
    best = pairs.groupBy(*on, "line_id", "b_line_id").agg(F.min_by(F.struct("dx", "dy", "d2", "ux", "uy", "b_ux", "b_uy"), F.struct("d2", "vtx", "b_vtx")).alias("m"))
    m = lambda c: F.col(f"m.{c}")
    a = F.abs(m("dy") * m("ux") - m("dx") * m("uy"))
    b = F.abs(m("dy") * m("b_ux") - m("dx") * m("b_uy"))
    c = F.abs(m("ux") * m("b_ux") + m("uy") * m("b_uy"))
    near = ((a < across2) & (b < across1)) | ((a < across1) & (b < across2))
    return best.filter(near & (m("d2") < reach * reach) & (c > cos_theta)).select(*on, "line_id", "b_line_id", F.sqrt("m.d2").alias("distance"))


def region_links(points: DataFrame, frames: DataFrame, point_id: str, frame_id: str, recent: int | None = 200, half_width: float = 10.0, near: float = 2.0, far: float = 20.0) -> DataFrame:
    """``point_id, frame_id`` where the point (x, y) lies in the frame's view: |x| < half_width, near < y < far in the body frame.

    Frames have fx, fy and the heading's c, s (body y is forward: (-s, c)); of
    them only those within ``recent`` of the largest id count.  ``recent`` frames are few, but cells keep the join an equality.
    """
    if recent is not None:
        frames = frames.join(frames.agg((F.max(frame_id) - recent).alias("__from")), F.col(frame_id) >= F.col("__from")).drop("__from")
    size = (half_width**2 + far**2) ** 0.5
    b = frames.select(F.col(frame_id), F.col("fx").alias("b_x"), F.col("fy").alias("b_y"), "c", "s")
    pairs = grid_pairs(points.select(point_id, "x", "y"), b, [], size)
    dx, dy = F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")
    right, ahead = F.col("c") * dx + F.col("s") * dy, F.col("c") * dy - F.col("s") * dx
    return pairs.filter((F.abs(right) < half_width) & (ahead > near) & (ahead < far)).select(point_id, frame_id)


def segment_match(points: DataFrame, lines: DataFrame, on: Sequence[str], point_id: str, line: str, max_distance: float | None = None) -> DataFrame:
    """Each point with the segment of each line it is paired with: ``point_id, line, segment, distance``.

    The two nearest vertices decide; the smaller index is the segment, which
    is dropped at the line's ends (first, or beyond the third from last).
    ``lines`` has line, vtx, x, y, z, n (vertices); ``on`` pairs points and
    lines.  All distances are in space.
    """
    pairs = points.join(renamed(lines, [*on, line]), list(on))
    gap = lambda c: F.col(c) - F.col(f"b_{c}")
    d2 = gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z")
    w = Window.partitionBy(point_id, line).orderBy("d2", "b_vtx")
    two = pairs.withColumn("d2", d2).withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    seg = two.groupBy(point_id, line).agg(F.min("b_vtx").alias("segment"), *[F.first(c).alias(c) for c in "xyz"], F.first("b_n").alias("n"), F.count(F.lit(1)).alias("__two"))
    seg = seg.filter("__two = 2 and segment <> 0 and segment <= n - 3")
    order = Window.partitionBy(line).orderBy("vtx")
    ends = lines.select(F.col(line).alias("__l"), F.col("vtx").alias("__v"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[F.lead(c).over(order).alias(f"b{c}") for c in "xyz"])
    hit = seg.join(ends, (F.col(line) == F.col("__l")) & (F.col("segment") == F.col("__v")))
    ux, uy, uz = (F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    vx, vy, vz = (F.col(c) - F.col(f"a{c}") for c in "xyz")
    normal = (uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx)
    dist = F.sqrt(sum(c * c for c in normal[1:]) + normal[0] * normal[0]) / F.sqrt(ux * ux + uy * uy + uz * uz)
    out = hit.withColumn("distance", dist)
    return (out if max_distance is None else out.filter(F.col("distance") <= max_distance)).select(point_id, line, "segment", "distance")
