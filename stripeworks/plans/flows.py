"""Queries that run a stream to its end over the fixtures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..storage import cut, shared_dir
from . import query, r6
from .fixtures import frame, sql
from .poses import SLOPE_ROWS


def _drained(spark: SparkSession, source: DataFrame, flow) -> DataFrame:
    """What ``flow`` makes of ``source`` as a stream, written to the shared folder and read back.

    The rows are written in four files by time, one after another, and a
    micro-batch takes one file: state is carried over.
    """
    stored = cut(source, "stream-source")
    edges = stored.approxQuantile("t_us", [0.25, 0.5, 0.75], 0.01) or [0.0] * 3
    folder = f"{shared_dir(spark)}/cuts/stream-in-{uuid.uuid4().hex}"
    part = sum(((F.col("t_us") > e).cast("int") for e in edges), F.lit(0))
    for k in range(len(edges) + 1):
        stored.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = f"{shared_dir(spark)}/cuts/stream-out-{uuid.uuid4().hex}"
    result = flow(stream)
    q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(result.schema).parquet(out)


@query(SLOPE_ROWS)
def stream_attitude(spark, sf_dir):
    """The stream says what the batch does."""
    poses = frame(spark, sf_dir, "pose").select("seq_id", "pose_id", "t_us", "pitch_deg", "roll_deg")
    out = _drained(spark, poses, lambda s: streaming.attitude(s, 20, 3.0))
    return out.select("seq_id", "pose_id", r6("diff_pitch").alias("diff_pitch"), r6("diff_roll").alias("diff_roll"), "jump", "held")


# Frame by frame: ``ids`` is the window, ``kx`` and ``ky`` are where the last keyframe was.
@query(
    f"""with recursive p as (select *, row_number() over (partition by seq_id order by t_us, pose_id) as rn from ({sql('pose')})),
k as (select seq_id, pose_id, rn, x as kx, y as ky, [pose_id] as ids, true as keyframe, null::bigint as evicted from p where rn = 1
      union all
      select seq_id, pose_id, rn, case when far then x else kx end, case when far then y else ky end, case when len(ids) > 20 then ids[2:] else ids end, far, case when len(ids) > 20 then ids[1] end
      from (select k.seq_id, p.pose_id, p.rn, p.x, p.y, k.kx, k.ky, sqrt((p.x-k.kx)**2 + (p.y-k.ky)**2) >= 100.0 as far, list_append(case when k.keyframe then k.ids else k.ids[:-2] end, p.pose_id) as ids
        from k join p on p.seq_id = k.seq_id and p.rn = k.rn + 1))
select seq_id, pose_id, keyframe, len(ids)::int as held, evicted from k"""
)
def stream_keyframes(spark, sf_dir):
    poses = frame(spark, sf_dir, "pose").select("seq_id", "pose_id", "t_us", "x", "y")
    return _drained(spark, poses, lambda s: streaming.keyframe_window(s, 100.0, 20))
