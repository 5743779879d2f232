"""Screens over streams. The reference has none; these carry its "seen before" rule
and its counts over to input that does not end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.storage import fresh_path


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key, as long as repeats come within ``delay``: state is
    a key for that long, not for ever."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, by: list[str], time: str, width: str, delay: str) -> DataFrame:
    """Rows of each window and group; a window is final once the watermark passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drained(spark: SparkSession, stream: DataFrame, kind: str) -> DataFrame:
    """What a stream gives when it takes all that is there and ends, read back from
    the shared folder; its progress lies there too, so that it could go on."""
    out = fresh_path(spark, kind)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, kind + "-progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
