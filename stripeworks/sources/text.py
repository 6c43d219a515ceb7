"""Trajectory, stamp and result files of text, read line by line and in parallel.

Lines are split once; what is not data is filtered before anything is parsed.
Where the order of lines decides (the first is the origin, the last of a time
wins), it is the position in its file, kept as ``line_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, linear, rotation
from ..storage import cut

#: Columns of the formats by position; a number stands for so many ignored.
VIO = ("t", "x", "y", "z", "vx", "vy", "vz", "pitch", "roll", "yaw")
FUSED = (*VIO, "gx", "gy", "gz", "ax", "ay", "az", "meas", "nsat", "pdop", "amb", "ratio")
GNSS = ("t", "x", "y", "z", "vx", "vy", "vz", "xrms", "yrms", "zrms", "vxrms", "vyrms", "vzrms", "nsat", "pdop", "sigma0", "amb", "ratio", "bl", "qual")
INERTIAL = ("week", "t", "x", "y", "z", *[None] * 19, "yaw", "pitch", "roll")
POSES = ("t", "x", "y", "z", "qw", "qx", "qy", "qz")
_TEXT = {"meas", "amb"}


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``line_no``: rising within a file, as partitions follow its bytes."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))


def _data(lines: DataFrame, comment: str = "#") -> DataFrame:
    body = F.trim(F.regexp_replace("value", "[,\\s]+", " "))
    keep = (body != "") & ~F.substring(body, 1, 1).isin(*comment)
    return lines.select(F.split(body, " ").alias("p"), F.col("value").alias("raw"), "line_no").filter(keep)


def columns(lines: DataFrame, names: tuple, comment: str = "#") -> DataFrame:
    """Named columns of the data lines; what a line lacks or does not parse is null."""
    d = _data(lines, comment)
    cols = [(F.try_element_at("p", F.lit(i + 1)) if n in _TEXT else F.try_element_at("p", F.lit(i + 1)).try_cast("double")).alias(n) for i, n in enumerate(names) if n]
    return d.select(*cols, "raw", "line_no")


def stamps_from(lines: DataFrame) -> DataFrame:
    """``t, image`` from lines of both, comma or space between; of equal times the last line wins."""
    d = _data(lines).select(F.col("p")[0].try_cast("double").alias("t"), F.try_element_at("p", F.lit(2)).alias("image"), "line_no").filter("t is not null")
    return d.groupBy("t").agg(F.max_by("image", "line_no").alias("image"))


def stamps(spark: SparkSession, path: str) -> DataFrame:
    return stamps_from(lines_of(spark, path))


def _last_of_time(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in ("t", "line_no", "raw")]
    return df.filter("t is not null").groupBy("t").agg(F.max_by(F.struct(*names), "line_no").alias("r")).select("t", "r.*")


def _pose(m, t, v=None, valid: Column | None = None) -> Column:
    velocity = F.array(*v) if v else F.lit(None).cast("array<double>")
    return F.struct(F.array(*m).alias("r"), F.array(*t).alias("t"), velocity.alias("v"), (F.lit(True) if valid is None else valid).alias("valid"))


def local_trajectory_from(lines: DataFrame, traj_id: str = "local") -> DataFrame:
    """``t x y z qw qx qy qz`` in a local frame, as poses."""
    d = _last_of_time(columns(lines, POSES))
    m = rotation.quaternion_to_matrix(*[F.col(f"q{c}") for c in "wxyz"])
    return d.select(F.lit(traj_id).alias("traj_id"), "t", _pose(m, [F.col(c) for c in "xyz"]).alias("pose"))


def origin_of(lines: DataFrame) -> tuple[float, float, float]:
    """The position of the first data line."""
    r = columns(lines, POSES).filter("t is not null").agg(F.min_by(F.struct("x", "y", "z"), "line_no").alias("o")).first()
    if r.o is None:
        raise ValueError("no data line: the trajectory has no origin")
    return r.o.x, r.o.y, r.o.z


def global_trajectory_from(lines: DataFrame, traj_id: str = "global", ref: tuple[float, float, float] | None = None) -> tuple[DataFrame, tuple[float, float, float]]:
    """The same columns in ECEF, as poses in the east-north-up frame at the first position; and that position."""
    ref = ref or origin_of(lines)
    d = _last_of_time(columns(lines, POSES))
    here = linear.literal(ref)
    d = d.withColumn("__lat", geodesy.geodetic_latitude(F.col("x"), F.col("y"), F.col("z"))).withColumn("__lon", F.atan2("y", "x"))
    r0 = geodesy.enu_rotation_at(tuple(here))
    d = d.withColumn("__r0", F.array(*r0)).withColumn("__r1", F.array(*geodesy.enu_rotation(F.col("__lat"), F.col("__lon"))))
    d = d.withColumn("__q", F.array(*rotation.quaternion_to_matrix(*[F.col(f"q{c}") for c in "wxyz"])))
    m0, m1, q = linear.mat(F.col("__r0")), linear.mat(F.col("__r1")), linear.mat(F.col("__q"))
    t = linear.apply(m0, linear.sub((F.col("x"), F.col("y"), F.col("z")), here))
    m = linear.mul(linear.mul(m0, linear.transpose(m1)), q)
    return d.select(F.lit(traj_id).alias("traj_id"), "t", _pose(m, t).alias("pose")), ref


def _solution(lines: DataFrame, names: tuple, ref: tuple[float, float, float], attitude: bool, negate_yaw: bool, checked: bool) -> DataFrame:
    d = columns(lines, names)
    r = linear.literal(ref)
    rot = geodesy.enu_rotation_at(tuple(r))
    valid = ~(F.col("raw").contains("Float") | (F.col("nsat") < 12)) if checked else F.lit(True)
    d = d.withColumn("valid", valid).filter("t is not null")
    pick = [c for c in d.columns if c not in ("t", "line_no", "raw")]
    d = d.groupBy("t").agg(F.max_by(F.struct(*pick), "line_no").alias("s")).select("t", "s.*").withColumn("__rot", F.array(*rot))
    t = linear.apply(linear.mat(F.col("__rot")), linear.sub((F.col("x"), F.col("y"), F.col("z")), r))
    v = linear.apply(linear.mat(F.col("__rot")), (F.col("vx"), F.col("vy"), F.col("vz"))) if "vx" in names else None
    yaw = F.radians("yaw") * (-1 if negate_yaw else 1) if attitude else None
    m = rotation.euler_to_matrix(F.radians("pitch"), F.radians("roll"), yaw) if attitude else linear.literal([1, 0, 0, 0, 1, 0, 0, 0, 1])
    return d.select("t", _pose(m, t, v, F.col("valid")).alias("pose"))


def vio(lines: DataFrame, ref) -> DataFrame:
    return _solution(lines, VIO, ref, True, False, False)


def fused(lines: DataFrame, ref) -> DataFrame:
    """Yaw runs the other way; "Float" in the line or fewer than 12 satellites make a pose invalid."""
    return _solution(lines, FUSED, ref, True, True, True)


def gnss(lines: DataFrame, ref) -> DataFrame:
    """No attitude: the identity."""
    return _solution(lines, GNSS, ref, False, False, True)


def inertial(lines: DataFrame, ref) -> DataFrame:
    """Yaw runs the other way; velocity is null."""
    return _solution(lines, INERTIAL, ref, True, True, False)


def result_poses(lines: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """``t x y z qw qx qy qz`` of a result file: up to its first blank line, ``%`` and ``#`` being comments."""
    blank = lines.filter(F.trim("value") == "").agg(F.min("line_no").alias("__stop"))
    upto = lines.join(F.broadcast(blank), F.col("line_no") < F.coalesce("__stop", F.lit(2**62))).drop("__stop")  # one row
    d = columns(upto, POSES, "%#").filter("t is not null").drop("raw", "line_no")
    if start is not None:
        d = d.filter(F.col("t") >= start)
    return d if end is None else d.filter(F.col("t") <= end)


def image_batches(spark: SparkSession, path: str, size: int = 10) -> DataFrame:
    """The images below ``path``, by name, numbered in batches: ``path, batch``.

    The listing is numbered by ranges of names, each for itself and shifted
    by the counts before it; of it only one count a range comes to the driver.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.repartitionByRange(parts, "path").sortWithinPartitions("path")
    placed = cut(ranged.withColumn("at", F.monotonically_increasing_id()), "images")
    part, within = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    number = F.array(*[F.lit(n).cast("long") for n in before])[part] + within
    return placed.select("path", F.floor(number / int(size)).alias("batch"))
