"""Mixing sources to target weights by iterative proportional fitting.

The corpus's token table over source x language x topic is raked until its
three marginals meet their targets; a document's expected number of copies is
its cell's raked weight over its cell's tokens, scaled; copies are drawn by a
seeded hash of the id, so a run can be repeated and no shuffle of documents is
needed. The cells are few (the product of three value counts) and are raked on
the driver up to ``max_cells``; beyond it the same steps run as DataFrames, with
the same results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import shared_dir, table

AXES = ("source", "lang", "topic")
#: Tempering exponents of the tokens of each source, language and topic.
TEMPER = {"source": 0.7, "lang": 0.6, "topic": 0.8}
ROUNDS = 60
#: Tokens expected out for one token in, at most, before cells are set to one copy.
GROWTH = 2.0
SEED = "mix"
#: Cells (about 100 bytes each) up to which the table is broadcast; beyond, cells
#: are repeated SALTS times, so that a cell's documents are dealt to many tasks.
BROADCAST_CELLS = 20_000
SALTS = 32
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    parts = F.size(F.split(text, SPLIT))
    edge = F.when(F.rlike(text, F.lit("^[ \\t\\n\\x0B\\f\\r]")), 1).otherwise(0) + F.when(F.rlike(text, F.lit("[ \\t\\n\\x0B\\f\\r]\\z")), 1).otherwise(0)
    return F.when(F.rlike(text, F.lit("[^ \\t\\n\\x0B\\f\\r]")), parts - edge).otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """The kind of a text, where no better topic is known, by its characters:
    figures (over a tenth digits), marked (over an eighth ASCII punctuation),
    listed (a line break for less than 80 characters), else short (under 600
    characters) or prose. Pass ``topic`` to ``mix`` for a topic of another sort."""
    n = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (F.when(count("[0-9]") * 10 > n, "figures").when(count("[!-/:-@\\[-`{-~]") * 8 > n, "marked").when(count("\n") * 80 > n, "listed")
            .when(n >= 600, "prose").otherwise("short"))


def tempered(totals: dict, exponent: float) -> dict:
    powered = {k: float(v) ** exponent if v > 0 else 0.0 for k, v in totals.items()}
    whole = sum(powered[k] for k in sorted(powered)) or 1.0
    return {k: v / whole for k, v in powered.items()}


def rake(keys: list[np.ndarray], weights: np.ndarray, shares: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """IPF. keys: for each axis the index of each cell's value; shares: for each
    axis the target share of each value. Values without weight stay at none."""
    w = weights / weights.sum()
    for _ in range(rounds):
        for key, share in zip(keys, shares):
            now = np.bincount(key, w, len(share))
            w = w * np.divide(share, now, out=np.zeros_like(now), where=now > 0)[key]
    return w


def _rake_frames(cells: DataFrame, targets: DataFrame, rounds: int) -> DataFrame:
    """The same over DataFrames. targets: axis, value, share."""
    whole = cells.agg(F.sum("tokens").alias("_t"))
    w = cells.crossJoin(F.broadcast(whole)).withColumn("weight", F.col("tokens") / F.col("_t")).drop("_t")  # one row
    for _ in range(rounds):
        for axis in AXES:
            share = targets.filter(F.col("axis") == axis).select(F.col("value").alias(axis), "share")
            now = w.groupBy(axis).agg(F.sum("weight").alias("_now")).join(share, axis, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            w = w.join(now, axis).withColumn("weight", F.when(F.col("_now") > 0, F.col("weight") * F.col("share") / F.col("_now")).otherwise(0.0)).drop("_now", "share").checkpoint()  # read twice in the next step
    return w


def calibrated(docs: DataFrame, targets: dict | None = None, temper: dict = TEMPER, budget: float | None = None, rounds: int = ROUNDS, max_cells: int = 200_000, whole: bool = False) -> DataFrame:
    """source, lang, topic, cell_tokens, probability (expected copies of each
    document of the cell) from a frame of AXES and ``tokens``. ``targets`` maps
    an axis to {value: share}; other axes are tempered by ``temper``. Without a
    ``budget`` of tokens the scale is the largest at which no document is
    expected more than once. With ``whole`` every document is expected at least
    once: the scale is the least that gives all cells of positive weight this,
    up to GROWTH times the input's tokens; cells still under one copy, as under
    targets that no weights meet, are set to one, and so are cells without
    words. Shares of values without tokens are dropped and the rest of the axis
    scaled up; an axis of which no target value has tokens is left as it is.
    Without any tokens all are 0 (1 with ``whole``)."""
    spark = docs.sparkSession
    shared_dir(spark)
    cells = docs.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")).checkpoint()
    schema = "source string, lang string, topic string, cell_tokens long, probability double"
    if cells.count() <= max_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        tokens = np.array([r[3] for r in rows], float)
        if not tokens.sum():
            return spark.createDataFrame([(*r, 1.0 if whole else 0.0) for r in rows], schema)
        keys, shares = [], []
        for i, axis in enumerate(AXES):
            values = sorted({r[i] for r in rows})
            index = {v: k for k, v in enumerate(values)}
            key = np.array([index[r[i]] for r in rows])
            total = dict(zip(values, np.bincount(key, tokens)))
            goal = (targets or {}).get(axis) or tempered(total, temper[axis])
            share = np.array([goal.get(v, 0.0) if total[v] else 0.0 for v in values])
            if not share.sum():
                share = np.array([total[v] for v in values])
            keys.append(key)
            shares.append(share / share.sum())
        w = rake(keys, tokens, shares, rounds)
        ratio = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
        if whole:
            copies = np.maximum(ratio * min(1 / ratio[ratio > 0].min(), GROWTH * tokens.sum()), 1.0)
        else:
            copies = ratio * (budget if budget is not None else 1 / ratio.max())
        return spark.createDataFrame([(*r, float(p)) for r, p in zip(rows, copies)], schema)
    if not cells.agg(F.sum("tokens")).first()[0]:
        return cells.select(*AXES, F.col("tokens").alias("cell_tokens"), F.lit(1.0 if whole else 0.0).alias("probability"))
    goals = []
    for axis in AXES:
        total = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0")
        if (targets or {}).get(axis):
            wanted = spark.createDataFrame([(k, float(v)) for k, v in targets[axis].items()], "value string, p double")
            power = total.join(wanted, "value", "left").select("value", "t", F.coalesce("p", F.lit(0.0)).alias("p"))
        else:
            power = total.withColumn("p", F.pow(F.col("t"), F.lit(temper[axis])))
        whole_axis = F.broadcast(power.agg(F.sum("p").alias("_p"), F.sum("t").alias("_t")))  # one row
        share = F.when(F.col("_p") > 0, F.col("p") / F.col("_p")).otherwise(F.col("t") / F.col("_t"))
        goals.append(power.crossJoin(whole_axis).select(F.lit(axis).alias("axis"), "value", share.alias("share")))
    raked = _rake_frames(cells, goals[0].unionByName(goals[1]).unionByName(goals[2]).checkpoint(), rounds).withColumn("_r", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)).checkpoint()
    if whole:
        least, tokens = raked.agg(F.min(F.when(F.col("_r") > 0, F.col("_r"))), F.sum("tokens")).first()
        copies = F.greatest(F.coalesce("_r", F.lit(0.0)) * F.lit(float(min(1 / least, GROWTH * tokens)) if least else 1.0), F.lit(1.0))
        return raked.select(*AXES, F.col("tokens").alias("cell_tokens"), copies.alias("probability"))
    scale = F.lit(float(budget)) if budget is not None else F.lit(1.0) / F.lit(raked.agg(F.max("_r")).first()[0])
    return raked.select(*AXES, F.col("tokens").alias("cell_tokens"), (F.col("_r") * scale).alias("probability"))


def _drawn(docs: DataFrame, topic: Column | None = None, seed: str = SEED, **params) -> DataFrame:
    """row (all columns of ``docs``), mix_tokens, mix_topic, probability, copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    axes = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), (topic_of(text) if topic is None else topic).alias("topic"))
    narrow = docs.select(axes.alias("cell"), word_count(text).alias("tokens")).select("cell.*", "tokens")
    cells = calibrated(narrow, **params).select(F.struct(*AXES).alias("cell"), "probability")
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(text).alias("mix_tokens"), axes.alias("cell"), draw.alias("draw"))
    if cells.count() <= BROADCAST_CELLS:
        # few enough to send to every executor instead of shuffling the texts
        joined = keyed.join(F.broadcast(cells), "cell", "left")
    else:
        salted = keyed.withColumn("salt", F.floor(F.col("draw") * 2**20 % SALTS).cast("int"))
        joined = salted.join(cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "salt"], "left")
    whole = F.floor(F.col("probability"))
    copies = (whole + F.when(F.col("draw") < F.col("probability") - whole, 1).otherwise(0)).cast("int")
    return joined.select("row", "mix_tokens", F.col("cell.topic").alias("mix_topic"), "probability", copies.alias("copies"))


def mix(docs: DataFrame, topic: Column | None = None, seed: str = SEED, **params) -> DataFrame:
    """Adds mix_tokens, mix_topic, probability and copies to ``docs``.

    Columns of ``docs`` with these names are replaced; others pass. Null sources
    and languages are the value ''; a null text has no words. Documents without
    words get their cell's probability; cells without any word get 0. An empty
    table gives no rows. Rows that repeat an id get the same draw. A very long
    text counts by all its words.
    """
    names = [c for c in docs.columns if c not in ("mix_tokens", "mix_topic", "probability", "copies")]
    return _drawn(docs, topic, seed, **params).select(*[F.col("row").getField(c).alias(c) for c in names], "mix_tokens", "mix_topic", "probability", "copies")


def sampled(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` as drawn, with all its columns as they are; several
    copies are rows."""
    out = _drawn(docs, **params).filter(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "copies")


def _step(axis: str, inner: str) -> str:
    return f"SELECT k, source, lang, topic, tokens, w * g_{axis} / sum(w) OVER (PARTITION BY {axis}) AS w, g_source, g_lang, g_topic FROM ({inner})"


OP3_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN len(regexp_extract_all(t, '[0-9]')) * 10 > length(t) THEN 'figures' WHEN len(regexp_extract_all(t, '[!-/:-@\\[-`{{-~]')) * 8 > length(t) THEN 'marked'
         WHEN len(regexp_extract_all(t, '\n')) * 80 > length(t) THEN 'listed' WHEN length(t) >= 600 THEN 'prose' ELSE 'short' END AS topic,
    len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM words GROUP BY ALL),
gs AS (SELECT source, pow(sum(tokens), {TEMPER['source']}) AS g FROM cells GROUP BY ALL),
gl AS (SELECT lang, pow(sum(tokens), {TEMPER['lang']}) AS g FROM cells GROUP BY ALL),
gt AS (SELECT topic, pow(sum(tokens), {TEMPER['topic']}) AS g FROM cells GROUP BY ALL),
goals AS (
  SELECT 0 AS k, c.source, c.lang, c.topic, c.tokens, c.tokens / (SELECT sum(tokens) FROM cells) AS w,
    gs.g / (SELECT sum(g) FROM gs) AS g_source, gl.g / (SELECT sum(g) FROM gl) AS g_lang, gt.g / (SELECT sum(g) FROM gt) AS g_topic
  FROM cells c JOIN gs USING (source) JOIN gl USING (lang) JOIN gt USING (topic)
), ipf AS (
  SELECT * FROM goals
  UNION ALL
  {_step('topic', _step('lang', _step('source', f'SELECT k + 1 AS k, source, lang, topic, tokens, w, g_source, g_lang, g_topic FROM ipf WHERE k < {ROUNDS}')))}
), raked AS (SELECT source, lang, topic, w / tokens AS r FROM ipf WHERE k = {ROUNDS}),
drawn AS (
  SELECT doc_id, source, lang, topic, tokens, r / (SELECT max(r) FROM raked) AS p,
    ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT / {float(16**13)} AS u
  FROM words JOIN raked USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS n_tokens, round(p, 6) AS probability,
  (floor(p) + CASE WHEN u < p - floor(p) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM drawn
"""
