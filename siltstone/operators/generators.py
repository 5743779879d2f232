"""Generators of problems whose answers two ways of computing agree on.

A plan (one row a variant) becomes problems by column expressions. Draws are taken
from SHA-256 of seed, variant and the draw's name, so any partitioning, and SQL,
gives the same problems. Every generator is verified by a second method that does
not share its arithmetic: inversion, cross products, or search of the whole domain.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPDATES = {"easy": 2, "medium": 3, "hard": 4}
RATE_MODES = ["rate_total", "ratio_scale", "percentage", "weighted_average", "combined_rate"]
DISCRETE_MODES = ["two_type_allocation", "complete_packages", "equal_distribution", "dual_capacity"]
DOMAIN = {"easy": 20, "medium": 40, "hard": 80}


def plan(spark: SparkSession, n: int) -> DataFrame:
    """(variant, difficulty): difficulties in turn."""
    return spark.range(n).select(F.col("id").alias("variant"), F.element_at(F.array(*map(F.lit, UPDATES)), (F.col("id") % 3 + 1).cast("int")).alias("difficulty"))


def draw(seed: str, name: str, low: int, high: int) -> Column:
    """An integer from low to high of the row's variant."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("variant").cast("string"), F.lit(name)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1) + low


def bookkeeping(rows: DataFrame, seed: str = "bookkeeping") -> DataFrame:
    """Adds start, steps (signed changes), groups, answer, ledger_answer, question and
    valid. Two to four changes by difficulty, gains and losses by the bits of the
    variant; a loss takes no more than half of what is there, so the count stays
    positive; every fifth variant ends in an exact division into groups. The answer
    is replayed step by step; the ledger's is the start and the sum of all changes."""
    n = F.element_at(F.create_map(*[x for k, v in UPDATES.items() for x in (F.lit(k), F.lit(v))]), F.col("difficulty"))
    base = rows.withColumn("start", draw(seed, "start", 20, 90)).withColumn("_d", F.array(*[draw(seed, f"step{k}", 1, 40) for k in range(4)]))
    state = F.struct(F.col("start").alias("now"), F.array().cast("array<bigint>").alias("steps"))
    bit = lambda k: F.col("variant").bitwiseAND(F.pow(F.lit(2.0), k).cast("long")) > 0

    def step(s: Column, k: Column) -> Column:
        size = F.element_at(F.col("_d"), (k + 1).cast("int"))
        change = F.when(bit(k), -F.least(size, F.floor(s["now"] / 2))).otherwise(size)
        return F.struct((s["now"] + change).alias("now"), F.concat(s["steps"], F.array(change)).alias("steps"))

    run = base.withColumn("_s", F.aggregate(F.sequence(F.lit(0), n - 1), state, step)).withColumn("_g", draw(seed, "groups", 2, 5))
    end, grouped = F.col("_s.now"), F.col("variant") % 5 == 4
    # the last change makes the end divisible
    fix = F.when(grouped, F.pmod(-end, F.col("_g"))).otherwise(0)
    out = run.withColumn("steps", F.when(fix > 0, F.concat("_s.steps", F.array(fix))).otherwise(F.col("_s.steps"))).withColumn("groups", F.when(grouped, F.col("_g")).otherwise(1))
    replayed = F.aggregate("steps", F.col("start"), lambda a, x: a + x)
    ledger = F.col("start") + F.aggregate(F.filter("steps", lambda x: x > 0), F.lit(0).cast("long"), lambda a, x: a + x) - F.aggregate(F.filter("steps", lambda x: x < 0), F.lit(0).cast("long"), lambda a, x: a - x)
    said = F.array_join(F.transform("steps", lambda x: F.when(x > 0, F.concat(x.cast("string"), F.lit(" come in."))).otherwise(F.concat((-x).cast("string"), F.lit(" go out.")))), " ")
    asked = F.when(grouped, F.concat(F.lit(" They are shared by "), F.col("groups").cast("string"), F.lit(" groups. How many has each?"))).otherwise(F.lit(" How many are there?"))
    lows = F.aggregate("steps", F.struct(F.col("start").alias("now"), F.col("start").alias("low")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.least(s["low"], s["now"] + x).alias("low")))
    out = out.withColumns({"answer": (replayed / F.col("groups")).cast("long"), "ledger_answer": (ledger / F.col("groups")).cast("long")})
    return out.select(*rows.columns, "start", "steps", "groups", "answer", "ledger_answer", F.concat(F.lit("There are "), F.col("start").cast("string"), F.lit(" boxes. "), said, asked).alias("question"), ((F.col("answer") == F.col("ledger_answer")) & (lows["low"] > 0) & (F.col("answer") * F.col("groups") == replayed)).alias("valid"))


def rates(rows: DataFrame, seed: str = "rates") -> DataFrame:
    """Adds mode (by variant), a, b, c, answer and valid: the answer by the mode's
    equation, checked by its inverse or cross product."""
    mode = F.element_at(F.array(*map(F.lit, RATE_MODES)), (F.col("variant") % 5 + 1).cast("int"))
    base = rows.withColumns({"mode": mode, "_a": draw(seed, "a", 2, 30), "_b": draw(seed, "b", 2, 12), "_c": draw(seed, "c", 1, 9)})
    a, b, c, m = F.col("_a"), F.col("_b"), F.col("_c"), F.col("mode")
    first = F.when(m == "percentage", a * 100).when(m == "ratio_scale", a * b).otherwise(a)
    second = F.when(m == "percentage", b * 5).otherwise(b)
    named = base.withColumns({"a": first, "b": second, "c": c}).drop("_a", "_b", "_c")
    x, y, z = F.col("a"), F.col("b"), F.col("c")
    whole = lambda v: v.cast("long")
    answer = (F.when(m == "rate_total", x * y).when(m == "ratio_scale", whole(x / y) * z).when(m == "percentage", whole(x * y / 100)).when(m == "weighted_average", x * z + y * z).otherwise((x + y) * z))
    named = named.withColumn("answer", answer)
    r = F.col("answer")
    valid = (F.when(m == "rate_total", (r % x == 0) & (r / x == y)).when(m == "ratio_scale", r * y == x * z).when(m == "percentage", r * 100 == x * y).when(m == "weighted_average", (r - y * z) == x * z).otherwise(r / z - y == x))
    return named.withColumn("valid", valid)


def discrete(rows: DataFrame, seed: str = "discrete") -> DataFrame:
    """Adds mode, total, size, extra, answer and solutions: the constructed answer,
    and how many values of the whole finite domain solve the problem (one)."""
    mode = F.element_at(F.array(*map(F.lit, DISCRETE_MODES)), (F.col("variant") % 4 + 1).cast("int"))
    domain = F.element_at(F.create_map(*[x for k, v in DOMAIN.items() for x in (F.lit(k), F.lit(v))]), F.col("difficulty"))
    base = rows.withColumns({"mode": mode, "_x": draw(seed, "x", 1, 19), "size": draw(seed, "size", 2, 9), "extra": draw(seed, "extra", 1, 8), "_dom": domain})
    x, s, e, m = F.col("_x"), F.col("size"), F.col("extra"), F.col("mode")
    total = F.when(m == "two_type_allocation", x * s + (30 - x) * (s + e)).when(m == "complete_packages", x * s + F.pmod(e, s)).when(m == "equal_distribution", x * s).otherwise(x * s)
    named = base.withColumn("total", total)
    t = F.col("total")
    # built: solved for the unknown
    built = F.when(m == "two_type_allocation", ((s + e) * 30 - t) / e).when(m == "complete_packages", F.floor(t / s)).when(m == "equal_distribution", t / s).otherwise(F.least(F.floor(t / s), F.floor((t + s * e) / s)))
    fits = lambda k: (F.when(m == "two_type_allocation", k * s + (30 - k) * (s + e) == t).when(m == "complete_packages", (k * s <= t) & ((k + 1) * s > t)).when(m == "equal_distribution", k * s == t).otherwise((k * s <= t) & ((k + 1) * s > t)))
    found = F.filter(F.sequence(F.lit(0), F.col("_dom")), fits)
    return named.select(*rows.columns, "mode", "total", "size", "extra", built.cast("long").alias("answer"), F.size(found).alias("solutions"), F.element_at(found, 1).cast("long").alias("searched"))


def rendered(problems: DataFrame, bank: DataFrame, mode: str, key: str, seed: str) -> DataFrame:
    """Problems with one template each of those that suit their mode, by seeded rank.
    bank: mode, template_id, template (with <NAME> of the problem's columns)."""
    j = problems.join(F.broadcast(bank), mode)  # a bank is a few hundred templates
    rank = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "template_id"), 256)
    picked = j.groupBy(key).agg(F.min_by(F.struct("template_id", "template"), rank).alias("_t"))
    out = problems.join(picked, key).select(*problems.columns, "_t.template_id", F.col("_t.template").alias("question"))
    for c in problems.columns:
        out = out.withColumn("question", F.replace("question", F.lit(f"<{c.upper()}>"), F.col(c).cast("string")))
    return out


def template_bank(spark: SparkSession, frames: dict[str, list[str]], openings: list[str]) -> DataFrame:
    """mode, template_id, template: every frame of a mode with every opening."""
    rows = [(mode, f"{mode}:{k}:{j}", o + f) for mode, texts in frames.items() for k, f in enumerate(texts) for j, o in enumerate(openings)]
    return spark.createDataFrame(rows, "mode string, template_id string, template string")


def realization_request(question: Column) -> Column:
    """struct(template, values): the question with its numbers as placeholders in
    order, and what they stand for, so that who words it sees no value."""
    number = r"(?<![A-Za-z_<])\d+"
    values = F.regexp_extract_all(question, F.lit(f"({number})"), F.lit(1))
    template = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), question, lambda text, k: F.regexp_replace(text, F.lit(r"^([^0-9]*(?:<[A-Z_0-9]+>[^0-9]*)*?)(\d+)"), F.concat(F.lit("$1<QUANTITY_"), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(">"))))
    return F.struct(template.alias("template"), values.alias("values"))


def retention_items(spark: SparkSession, n: int) -> DataFrame:
    """(id, section, prompt, expected): arithmetic, format and instruction items
    from index formulas."""
    i = F.col("id")
    a, b = i % 83 + 11, i % 37 + 3
    section = F.element_at(F.array(F.lit("arithmetic"), F.lit("format"), F.lit("instruction")), (i % 3 + 1).cast("int"))
    s = lambda x: x.cast("string")
    prompt = F.when(section == "arithmetic", F.concat(F.lit("What is "), s(a), F.lit(" plus "), s(b), F.lit("?"))).when(section == "format", F.concat(F.lit("Write the number "), s(a), F.lit(" in square brackets."))).otherwise(F.concat(F.lit("Repeat the word item"), s(b), F.lit(" and nothing else.")))
    expected = F.when(section == "arithmetic", s(a + b)).when(section == "format", F.concat(F.lit("["), s(a), F.lit("]"))).otherwise(F.concat(F.lit("item"), s(b)))
    return spark.range(n).select(F.col("id"), section.alias("section"), prompt.alias("prompt"), expected.alias("expected"))


def generated(rows: DataFrame, prompt: str, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Adds ``response`` by a backend that ``make`` starts once for each task and
    that answers whole batches."""
    @F.pandas_udf("string")
    def run(batches: "pd.Series") -> "pd.Series":  # one call a batch
        backend = _started(make)
        return pd.Series(backend([t or "" for t in batches]))

    return rows.withColumn("response", run(F.col(prompt)))


_backends: dict = {}


def _started(make: Callable):
    """This worker's backend; started at its first batch."""
    if make not in _backends:
        _backends[make] = make()
    return _backends[make]


def answered(rows: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """A backend that is a table: (key, response) joined to the rows."""
    return rows.join(responses.select(key, "response"), key, "left")
