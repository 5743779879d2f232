"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering in which that speaker is
the assistant, every other speaker is a named user and the system's turns stay
the system's; the mask marks what the assistant says, with its end marker.

A conversation of more than PART turns comes in parts of consecutive turns, a
row each, whose offsets run through the whole rendering: a conversation with a
third of all turns is then rendered by many tasks. Turns are numbered without a
window over a whole conversation's texts: each is numbered among those of its
turn number and hash prefix, and the numbers of rows before these are running
totals of counts. Starts of parts are running totals of lengths, so only a row
of two numbers for each part meets in a window, and texts are joined to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table, written

PART = 256
END = "<|end|>\n"
LAST = 2**62  # the place of null turns
SPAN = 4096  # turn numbers whose counts are totalled together


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``n``, a turn's place in its conversation from 0: by turn number, then
    hash of role and text. Counts are totalled by hash prefix, by turn number and
    by SPAN of turn numbers, one level at a time."""
    levels = ["conv_id", "_far", "turn", "_near"]
    local = F.row_number().over(Window.partitionBy(*levels).orderBy("_h", "role", "text")) - 1
    sizes = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes
    for k in (3, 2, 1):
        own = levels[:k + 1]
        here = sizes.groupBy(*own).agg(F.sum("_n").alias("_n")) if k < 3 else sizes
        before = F.sum("_n").over(Window.partitionBy(*own[:-1]).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        here = here.select(*[F.col(c).alias(f"b{c}") for c in own], before.alias(f"_s{k}"))
        same = [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in own]
        starts = starts.join(here, same).drop(*[f"b{c}" for c in own])
    starts = starts.select(*[F.col(c).alias(f"b{c}") for c in levels], (F.col("_s1") + F.col("_s2") + F.col("_s3")).alias("_s"))
    return rows.withColumn("_l", local).join(starts, [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in levels]).select("conv_id", "role", "text", (F.col("_s") + F.col("_l")).alias("n"))


def rotate(turns: DataFrame, part: int = PART, context: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, start, text, mask.

    ``start`` is the offset, in code points of the whole rendering, of this
    part; ``mask`` holds the [start, end) spans of the whole rendering to train
    on. A null role speaks as 'unknown', a null text says nothing, null turns
    come last; equal turn numbers are ordered by the SHA-256 of role, ':' and
    text, and repeated rows are all rendered. A very long text is one turn of its
    part. A conversation in which only the system speaks has no participant and
    so no rendering. Other columns are ignored, so none clash. No turns: no rows.
    """
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.sha2(F.concat_ws(":", "role", "text"), 256))
    rows = rows.withColumn("_far", F.floor(F.col("turn") / SPAN)).withColumn("_near", F.substring("_h", 1, 3))
    placed = _numbered(rows).withColumn("part", F.expr(f"n div {part}"))
    # read by lengths and by texts
    parts = written(placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("_t")), "turns")
    people = parts.select("conv_id", F.explode("_t").alias("t")).select("conv_id", F.col("t.role").alias("perspective")).filter(F.col("perspective") != context).distinct()
    head = lambda role: F.when(role == F.col("perspective"), F.lit("<|assistant|>\n")).when(role == context, F.lit(f"<|{context}|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    # lengths of parts: of a role's turns, but for their heads
    said = parts.select("conv_id", "part", F.explode("_t").alias("t")).groupBy("conv_id", "part", F.col("t.role").alias("role")).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.length("t.text") + len(END)).alias("_b"))
    # null-safe: a null conv_id is a conversation of its own
    whose = said.alias("a").join(people.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.conv_id", "part", "perspective", (F.col("_b") + F.col("_c") * F.length(head(F.col("role")))).alias("_z"))
    sums = whose.groupBy("conv_id", "part", "perspective").agg(F.sum("_z").alias("_z"))
    run = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(F.col("conv_id").alias("_i"), F.col("part").alias("_p"), "perspective", (F.sum("_z").over(run) - F.col("_z")).alias("start"))
    each = parts.join(starts, F.col("conv_id").eqNullSafe(F.col("_i")) & (F.col("part") == F.col("_p")))
    each = each.withColumn("_s", F.transform("_t", lambda t: F.struct(head(t["role"]).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("perspective")).alias("own"))))
    ends = F.aggregate("_s", F.array().cast("array<bigint>"), lambda acc, s: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.col("start")) + F.length(s["head"]) + F.length(s["body"])).cast("bigint"))))
    mask = F.transform(F.filter(F.arrays_zip(ends.alias("e"), F.col("_s").alias("s")), lambda z: z["s"]["own"]), lambda z: F.struct((z["e"] - F.length(z["s"]["body"])).alias("start"), z["e"].alias("end")))
    return each.select("conv_id", "perspective", F.col("part").cast("int").alias("part"), F.size("_s").alias("n_turns"), "start", F.array_join(F.transform("_s", lambda s: F.concat(s["head"], s["body"])), "").alias("text"), mask.alias("mask"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "start", "text", spans.alias("mask"))


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(role || ':' || text)) - 1 AS n
  FROM (SELECT conv_id, coalesce(turn, {LAST}) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
said AS (
  SELECT conv_id, perspective, n // {PART} AS part, n, role,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || role || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM t JOIN who USING (conv_id)
), ended AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM said
)
SELECT conv_id, perspective, part::INTEGER AS part, count(*)::INTEGER AS n_turns, min(e - length(head) - length(body))::BIGINT AS start,
  string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg((e - length(body))::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY e) FILTER (role = perspective), '') AS mask
FROM ended GROUP BY conv_id, perspective, part
"""
