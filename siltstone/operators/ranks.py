"""Places in an order, without all rows of a group in one task.

A window over a group puts the group into one task. Here rows are range-sorted over
the cluster by (group, order), numbered within their partition, and moved by the
counts of the partitions before: one sort, one pass of counts, and what is collected
is a row for each partition and group that begins or ends in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.storage import written


def ordinal(rows: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place from 0 in its group by ``order`` (columns by
    name, or expressions). Equal rows get places in any order among themselves.

    The sorted rows are written once, as a range sort draws its bounds anew each
    time it is run. Windows see a partition's rows of one group; a group larger than
    a partition spreads over several, whose counts are added up."""
    keys = [F.col(g) for g in group]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_ = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    placed = written(sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranks")
    sizes = placed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__count"), F.min("__row").alias("__first"))
    over = Window.partitionBy(*(group or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(*[F.col(g).alias(f"__group{k}") for k, g in enumerate(group)], F.col("__part").alias("__at"), "__first", (F.sum("__count").over(over) - F.col("__count")).alias("__before"))
    same = (F.col("__part") == F.col("__at"))
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__group{k}"))
    # within a partition rows of a group lie together, so the running id counts them
    return placed.join(starts, same).withColumn(name, F.col("__row") - F.col("__first") + F.col("__before")).drop("__part", "__row", "__at", "__first", "__before", *[f"__group{k}" for k in range(len(group))])
