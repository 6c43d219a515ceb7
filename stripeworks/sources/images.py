"""Camera images and label masks as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, path: str) -> DataFrame:
    """``name, height, width, channels, data`` of the images below ``path``: blue, green, red, or one channel."""
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    i = F.col("image")
    return df.select(F.element_at(F.split(i["origin"], "/"), -1).alias("name"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def with_masks(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames (image) with the mask of the same stem, whatever its extension; frames without one go."""
    stem = lambda c: F.substring_index(F.element_at(F.split(c, "/"), -1), ".", 1)
    m = masks.select(stem(F.col("name")).alias("__stem"), *[F.col(c).alias(f"mask_{c}") for c in ("height", "width", "channels", "data")])
    return frames.withColumn("__stem", stem(F.col("image"))).join(m, "__stem").drop("__stem")
