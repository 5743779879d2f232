"""Streams in several batches: late repeats, and windows that close."""

from datetime import datetime, timedelta

from siltstone.streaming import screen

START = datetime(2024, 1, 1)


def _stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(START + timedelta(minutes=m), key) for m, key in rows], "ts timestamp, key string").coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema("ts timestamp, key string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_first_seen(spark, tmp_path):
    s = _stream(spark, str(tmp_path / "in"), [[(0, "a"), (1, "b"), (2, "a")], [(3, "a"), (4, "c")], [(200, "d")], [(201, "a")]])
    got = sorted(r["key"] for r in screen.drained(spark, screen.first_seen(s, ["key"], "ts", "30 minutes"), "seen").collect())
    assert got in (["a", "a", "b", "c", "d"], ["a", "b", "c", "d"])  # the last may come before the state is dropped


def test_windows_close(spark, tmp_path):
    s = _stream(spark, str(tmp_path / "in"), [[(0, "a"), (5, "a"), (6, "b")], [(65, "a")], [(300, "a")], [(301, "b")]])
    got = sorted((r["start"], r["key"], r["n"]) for r in screen.drained(spark, screen.windowed_counts(s, ["key"], "ts", "1 hour", "10 minutes"), "windows").collect())
    hour = timedelta(hours=1)
    assert got[:2] == [(START, "a", 2), (START, "b", 1)] and (START + hour, "a", 1) in got
