"""Seeded orders, partitions, quotas and stratified samples.

A seeded order is SHA-256 of seed, ':' and key, ties by key: it is the same for
any partitioning and can be repeated in SQL. Places in an order come from
``ranks.ordinal``, so a stratum with a third of all rows is in no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import seeded_rank
from siltstone.operators.ranks import ordinal


def lowest(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The k rows of lowest seeded rank (a top-k, never a full sort)."""
    return rows.withColumn("_r", seeded_rank(seed, F.col(key))).orderBy("_r", key).limit(k).drop("_r")


def partition(rows: DataFrame, key: str, seed: str, k: int, sealed: str = "sealed", rest: str = "development") -> DataFrame:
    """Adds ``partition``: the k lowest ranks are sealed. The k-th rank is found
    by a top-k, and rows are compared with it, so nothing is ranked globally."""
    ranked = rows.withColumn("_r", F.struct(seeded_rank(seed, F.col(key)).alias("r"), F.col(key).alias("k")))
    edge = ranked.select("_r").orderBy("_r").limit(k).agg(F.max("_r").alias("_e"))
    return ranked.crossJoin(F.broadcast(edge)).withColumn("partition", F.when(F.col("_r") <= F.col("_e"), sealed).otherwise(rest)).drop("_r", "_e")  # one row


def largest_remainder(weights: DataFrame, total: int, weight: str = "weight", key: str = "stratum") -> DataFrame:
    """Adds ``quota``: whole shares of ``total`` in proportion to integer
    weights; what flooring leaves goes to the largest remainders, ties by key.
    The frame holds one row a stratum."""
    whole = weights.agg(F.sum(weight).alias("_w"))
    r = weights.crossJoin(F.broadcast(whole)).withColumn("_q", F.expr(f"{weight} * {total} div _w")).withColumn("_m", F.expr(f"{weight} * {total} % _w"))
    left = r.agg((F.lit(total) - F.sum("_q")).alias("_left"))
    place = F.row_number().over(Window.orderBy(F.col("_m").desc(), key))
    return r.withColumn("_p", place).crossJoin(F.broadcast(left)).withColumn("quota", (F.col("_q") + F.when(F.col("_p") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_w", "_q", "_m", "_p", "_left")


def per_stratum(rows: DataFrame, key: str, seed: str, stratum: list[str], quota: Column) -> DataFrame:
    """Rows whose seeded place in their stratum is at most ``quota``."""
    w = Window.partitionBy(*stratum).orderBy(seeded_rank(seed, F.col(key)), key)
    return rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= quota).drop("_p")


def _placed(rows: DataFrame, key: str, seed: str, stratum: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's seeded place from 0 in its stratum."""
    return ordinal(rows.withColumn("_r", seeded_rank(seed, F.col(key))), stratum, ["_r", key], name).drop("_r")


def stratified_split(rows: DataFrame, key: str, seed: str, stratum: str, held: int) -> DataFrame:
    """Adds ``split``: ``held`` rows for validation, by largest remainder over
    the strata (ties by the hash of the stratum) and seeded rank within them."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("weight")).withColumn("_t", F.sha2(F.col(stratum).cast("string"), 256))
    quota = largest_remainder(sizes, held, key="_t").select(stratum, "quota")
    return _placed(rows, key, seed, [stratum], "_p").join(F.broadcast(quota), stratum).withColumn("split", F.when(F.col("_p") < F.col("quota"), "validation").otherwise("train")).drop("_p", "quota")


def round_robin(rows: DataFrame, key: str, seed: str, stratum: str) -> DataFrame:
    """Adds ``turn`` (place in the stratum, from 1) and ``stratum_rank``: ordered
    by them, each stratum gives one row a round."""
    return _placed(rows, key, seed, [stratum], "turn").withColumn("turn", F.col("turn") + 1).withColumn("stratum_rank", seeded_rank(seed, F.col(stratum)))


def roles(ordered: DataFrame, even: str = "first", odd: str = "second") -> DataFrame:
    """Adds ``role``, alternating over the round-robin order of ``round_robin``."""
    return ordinal(ordered, [], ["turn", "stratum_rank"], "_p").withColumn("role", F.when(F.col("_p") % 2 == 0, even).otherwise(odd)).drop("_p")


def spread_labels(counts: DataFrame, seed: str, label: str = "label", n: str = "n") -> DataFrame:
    """(label, copy, rank): counts expanded, with a seeded rank to order by."""
    many = counts.filter(F.col(n) > 0).select(label, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("copy"))
    return many.withColumn("rank", F.sha2(F.concat_ws(":", F.lit(seed), F.col(label).cast("string"), F.col("copy").cast("string")), 256))


def every_kth(rows: DataFrame, stratum: list[str], order: list[str], quota: int) -> DataFrame:
    """``quota`` rows of each stratum at equal steps of its order, from the first
    on; all rows of a stratum that has fewer."""
    sizes = rows.groupBy(*stratum).agg(F.greatest(F.expr(f"count(1) div {quota}"), F.lit(1)).alias("_step"))
    placed = ordinal(rows, stratum, order, "_p").join(F.broadcast(sizes), stratum)
    return placed.filter((F.col("_p") % F.col("_step") == 0) & (F.expr("_p div _step") < quota)).drop("_p", "_step")


def proportional_slots(quotas: DataFrame, family: str = "family", quota: str = "quota", order: str = "family_order") -> DataFrame:
    """(family, k, position): slots of all families interleaved so that each is
    used in proportion: by (k - 1) / quota, then family order."""
    slots = quotas.select(family, order, F.explode(F.sequence(F.lit(1), F.col(quota).cast("int"))).alias("k"), F.col(quota).alias("_q")).withColumn("_u", (F.col("k") - 1) / F.col("_q"))
    return ordinal(slots, [], ["_u", order], "position").select(family, "k", (F.col("position") + 1).cast("int").alias("position"))


def disjoint_and_whole(a: DataFrame, b: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: overlap, missing and foreign ids, and whether a and b part ``whole``."""
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    j = side(whole, "w").join(side(a, "a"), key, "full_outer").join(side(b, "b"), key, "full_outer")
    out = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), F.count_if(F.col("w").isNotNull() & F.col("a").isNull() & F.col("b").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("foreign"))
    return out.withColumn("is_partition", (F.col("overlap") == 0) & (F.col("missing") == 0) & (F.col("foreign") == 0))
