"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, ranked there, and all
sources are merged by fractional rank (2 * rank + 1) / (2 * rows of the source).
Cutting that order into equal runs gives shards whose row counts differ by at
most one and whose mixture is the corpus's, to within a row of each source.

Ranks are whole and never taken in one task: the hash's leading hex digits (or
the leading part of the fractional rank) deal a source to buckets, a window
ranks each bucket, and running totals of the bucket counts are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import shared_dir, table

BUCKETS = 4096  # of the hash in a source, and of the fractional rank


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's place from 0 in its group, ordered by bucket,
    then ``order``; and ``name``_n: the group's rows."""
    key = [*group, bucket]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    lead = Window.partitionBy(*(group or [F.lit(1)]))
    starts = sizes.select(*key, (F.sum("_n").over(lead.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"), F.sum("_n").over(lead).alias(f"{name}_n"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    return local.join(starts, key).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local")


def interleave(docs: DataFrame, shards: int, seed: str = "interleave", source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, rank, position, shard, slot.

    Sizes are UTF-8 bytes of the text plus 1. A null source is a source of its
    own; a null text has size 1 and crc32 0; null and repeated ids are ordered
    by their text's crc32 and size, wholly equal rows are interchangeable.
    Other columns are ignored, so names in them cannot clash; a very long text is
    a row as any; an empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
    ).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256))
    # narrow rows, read twice below: written once so the text is scanned once
    rows = rows.withColumn("_b", F.substring("_h", 1, 3)).checkpoint()
    order = ["_h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    ranked = _ranked(rows, ["source"], "_b", order, "rank").withColumn("_f", (2 * F.col("rank") + 1) / (2 * F.col("rank_n")))
    ranked = ranked.withColumn("_b", F.floor(F.col("_f") * BUCKETS)).checkpoint()
    merged = _ranked(ranked, [], "_b", ["_f", "source", "rank"], "position")
    n, p = F.col("position_n"), F.col("position")
    cut = merged.withColumn("shard", F.expr(f"position * {shards} div position_n").cast("int"))
    return cut.select("doc_id", "size", "text_crc32", "source", "rank", p, "shard", (p - F.expr(f"(shard * position_n + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
