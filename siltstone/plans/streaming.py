"""Streams over the events table, drained. Beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.base import query, t
from siltstone.sources.storage import fresh_path
from siltstone.streaming import screen


def _events(spark, d):
    """The events as a stream of files, with microseconds and a zone."""
    source = fresh_path(spark, "events")
    t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(source)
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(source)


@query("SELECT DISTINCT user_id, event_type FROM events")
def st1_first_seen(spark, d):
    seen = screen.first_seen(_events(spark, d), ["user_id", "event_type"], "ts", "400 days")
    return screen.drained(spark, seen, "seen").select("user_id", "event_type")
