"""The stream operators that also take batches, and the merge trigger."""

from pyspark.sql import functions as F

from stripeworks import streaming


def test_poses_are_paired_within_the_tolerance(spark):
    ts = lambda *ms: [(i, f"2024-01-01 00:00:00.{m:04d}") for i, m in enumerate(ms)]
    s = spark.createDataFrame(ts(10, 1000, 5000), "stamp int, at string").select("stamp", F.to_timestamp("at").alias("stamp_ts"))
    p = spark.createDataFrame(ts(15, 995, 5100), "pose int, at string").select("pose", F.to_timestamp("at").alias("pose_ts"))
    assert sorted((r.stamp, r.pose) for r in streaming.pair_poses(s, p).collect()) == [(0, 0), (1, 1)]


def test_spatial_watermark(spark):
    inst = spark.createDataFrame([(1, 10, 0.0, -5.0), (1, 11, 0.0, -2.0), (1, 12, 0.0, 9.0), (2, 20, -5.0, 0.0)], "seq_id long, id long, x double, y double")
    vehicle = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0)], "seq_id long, vx double, vy double, c double, s double")
    done, active = streaming.spatial_watermark(inst, vehicle)
    assert [r.id for r in done.collect()] == [10]
    assert sorted(r.id for r in active.collect()) == [11, 12, 20]


def test_merges_run_on_every_batch(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = streaming.merge_every(stream, lambda df, epoch: seen.append((epoch, df.count())), str(tmp_path / "checkpoint"))
    q.awaitTermination()
    assert q.exception() is None and [e for e, _ in seen] == [0, 1, 2, 3] and sum(n for _, n in seen) == 100
