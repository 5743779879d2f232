"""Gates over summaries that are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import gates as G
from siltstone.plans.base import query, t

_ITEMS = """i AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'format' ELSE 'instruction' END AS section, o_orderpriority AS family, o_orderkey % 20 <> 0 AS correct, o_orderkey % 7 <> 0 AS base, o_orderkey % 101 = 0 AS echo, o_orderkey % 100003 = 99999 AS asks, false AS failed FROM orders)"""


def _items(spark, d):
    k = F.col("o_orderkey")
    section = F.when(F.col("o_custkey") % 3 == 0, "arithmetic").when(F.col("o_custkey") % 3 == 1, "format").otherwise("instruction")
    return t(spark, d, "orders").select(k.alias("id"), section.alias("section"), F.col("o_orderpriority").alias("family"), (k % 20 != 0).alias("correct"), (k % 7 != 0).alias("base"), (k % 101 == 0).alias("echo"), (k % 100003 == 99999).alias("asks"), F.lit(False).alias("failed"))


_RATE = "count(*) FILTER (section = '{s}' AND {c}) / count(*) FILTER (section = '{s}')"
_D1 = {
    "arithmetic_retention": f"{_RATE.format(s='arithmetic', c='correct')} + 1e-12 >= {_RATE.format(s='arithmetic', c='base')} - 0.1", "format_following": f"{_RATE.format(s='format', c='correct')} + 1e-12 >= 0.9",
    "instruction_following": f"{_RATE.format(s='instruction', c='correct')} + 1e-12 >= 0.9", "extractability": "count(*) FILTER (id % 9 <> 0) / count(*) + 1e-12 >= 0.9", "prompt_echo": "count(*) FILTER (echo) / count(*) <= 0.05 + 1e-12",
    "question_generation": "count(*) FILTER (asks) = 0", "backend_failures": "count(*) FILTER (failed) = 0", "finite_training_losses": "true", "finite_validation_loss": "false", "token_count_matches_schedule": "sum(id) = sum(id)"}


def _verdict(checks: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in sorted(checks.items())) + ") AS failed_checks, " + " AND ".join(f"({c})" for c in checks.values()) + " AS passed"


@query(f"WITH {_ITEMS} SELECT {', '.join(f'{c} AS {n}' for n, c in _D1.items())}, {_verdict(_D1)} FROM i")
def d1_absolute_retention(spark, d):
    """All ten checks; the validation loss is not a number, so one fails."""
    rate = lambda s, c: F.count_if((F.col("section") == s) & F.col(c)) / F.count_if(F.col("section") == s)
    n = F.count(F.lit(1))
    one = _items(spark, d).agg(rate("arithmetic", "base").alias("b"), rate("arithmetic", "correct").alias("a"), rate("format", "correct").alias("f"), rate("instruction", "correct").alias("i"), (F.count_if(F.col("id") % 9 != 0) / n).alias("x"), (F.count_if("echo") / n).alias("e"), F.count_if("asks").alias("q"), F.count_if("failed").alias("z"))
    c = F.col
    return one.select(*G.absolute_retention(c("b"), c("a"), c("f"), c("i"), c("x"), c("e"), c("q"), c("z"), F.lit(True), F.lit(float("nan")), F.lit(True)))


_D2 = {"overall": "c / n >= 0.9 - 1e-12", "sections": "s", "wilson": "(c / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((c / n * (1 - c / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n) >= 0.85", "prompt_echo": "e / n <= 0.02", "question_generation": "q = 0", "backend_failures": "f = 0", "family_failures": "w <= 3"}


@query(f"""WITH {_ITEMS}, b AS (SELECT * FROM i WHERE base), k AS (SELECT section, family, count(*) FILTER (NOT correct) AS w FROM b GROUP BY ALL), p AS (SELECT avg(correct::INT) AS r FROM b GROUP BY section),
z AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (correct) AS c, count(*) FILTER (echo) AS e, count(*) FILTER (asks) AS q, count(*) FILTER (failed) AS f, (SELECT max(w) FROM k) AS w, (SELECT min(r) >= 0.9 - 1e-12 FROM p) AS s FROM b)
SELECT {', '.join(f'{c} AS "{n}"' for n, c in _D2.items())}, {_verdict(_D2)} FROM z""")
def d2_preservation(spark, d):
    return G.preservation(_items(spark, d).filter("base"), "section", "correct", "family", "echo", "asks", "failed")


@query(f"""WITH {_ITEMS} SELECT section, count(*) AS total, count(*) FILTER (correct) AS preserved, round(avg(correct::INT), 8) AS rate, (SELECT max(w) FROM (SELECT count(*) FILTER (NOT correct) AS w FROM i j WHERE base AND j.section = i.section GROUP BY family)) AS worst_family FROM i WHERE base GROUP BY section""")
def a13_section_preservation(spark, d):
    by = _items(spark, d).filter("base").groupBy("section", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    return by.groupBy("section").agg(F.sum("n").alias("total"), F.sum("c").alias("preserved"), F.round(F.sum("c") / F.sum("n"), 8).alias("rate"), F.max(F.col("n") - F.col("c")).alias("worst_family"))


@query(f"""WITH {_ITEMS} SELECT bool_and(true) AS references_self_score, count(*) FILTER (base AND section = 'arithmetic') >= 100 AS arithmetic_has_100, count(*) FILTER (base AND section = 'format') >= 1000000000 AS format_has_1000000000,
 concat_ws(',', CASE WHEN count(*) FILTER (base AND section = 'arithmetic') < 100 THEN 'arithmetic_has_100' END, 'format_has_1000000000') AS failed_checks, false AS passed FROM i""")
def d3_usable_instrument(spark, d):
    return G.usable_instrument(_items(spark, d).withColumn("self", F.lit(True)), "section", "self", "base", {"arithmetic": 100, "format": 1_000_000_000})


@query(f"WITH {_ITEMS} SELECT id, section, count(*) OVER (PARTITION BY section) AS section_items FROM i WHERE base")
def d4_base_correct_subset(spark, d):
    return G.base_correct_subset(_items(spark, d), "id", "section", "base")


@query("""WITH r AS (SELECT l_orderkey % 2 AS arm, count(*) > 0 AS recipe, sum(l_quantity) AS tokens, bool_and(l_tax < 1) AS finite, bool_and(l_discount < 0) AS reload FROM lineitem GROUP BY 1), a AS (SELECT * FROM r WHERE arm = 0), b AS (SELECT * FROM r WHERE arm = 1)
SELECT a.recipe = b.recipe AS metadata_parity, abs(a.tokens - b.tokens) <= 0.005 * greatest(a.tokens, b.tokens) + 1e-12 AS token_parity, a.finite AND b.finite AS losses_finite, a.reload AND b.reload AS offline_reload,
 concat_ws(',', CASE WHEN NOT (a.finite AND b.finite) THEN 'losses_finite' END, CASE WHEN a.recipe <> b.recipe THEN 'metadata_parity' END, CASE WHEN NOT (a.reload AND b.reload) THEN 'offline_reload' END, CASE WHEN abs(a.tokens - b.tokens) > 0.005 * greatest(a.tokens, b.tokens) + 1e-12 THEN 'token_parity' END) AS failed_checks,
 a.recipe = b.recipe AND abs(a.tokens - b.tokens) <= 0.005 * greatest(a.tokens, b.tokens) + 1e-12 AND a.finite AND b.finite AND a.reload AND b.reload AS passed FROM a, b""")
def d5_run_parity(spark, d):
    """Two runs' rows: metadata, tokens, and flags that both have to have."""
    runs = t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 2).alias("arm")).agg((F.count(F.lit(1)) > 0).alias("recipe"), F.sum("l_quantity").alias("tokens"), F.bool_and(F.col("l_tax") < 1).alias("finite"), F.bool_and(F.col("l_discount") < 0).alias("reload"))
    return G.run_parity(runs, "arm", 0, 1, ["recipe"], "tokens", {"losses_finite": "finite", "offline_reload": "reload"})


@query("""WITH c AS (SELECT c_custkey % 2 AS arm, c_acctbal AS v, c_mktsegment AS seg, (c_nationkey % 2)::VARCHAR AS src FROM customer),
s AS (SELECT abs(avg(v) FILTER (arm = 0) - avg(v) FILTER (arm = 1)) / sqrt((var_samp(v) FILTER (arm = 0) + var_samp(v) FILTER (arm = 1)) / 2) AS smd FROM c),
l AS (SELECT 'seg' AS field, seg AS level, arm FROM c UNION ALL SELECT 'src', src, arm FROM c),
g AS (SELECT field, level, count(*) FILTER (arm = 0) AS a, count(*) FILTER (arm = 1) AS b FROM l GROUP BY ALL),
z AS (SELECT max(abs(a / (SELECT count(*) FROM c WHERE arm = 0) - b / (SELECT count(*) FROM c WHERE arm = 1))) AS gap, bool_and(field <> 'src' OR a = b) AS mix FROM g)
SELECT round(smd, 8) AS largest_smd, round(gap, 8) AS largest_gap, smd <= 0.1 AS numerical, gap <= 0.05 AS categorical, mix AS source_mix, concat_ws(',', CASE WHEN gap > 0.05 THEN 'categorical' END, CASE WHEN smd > 0.1 THEN 'numerical' END, CASE WHEN NOT mix THEN 'source_mix' END) AS failed_checks, smd <= 0.1 AND gap <= 0.05 AND mix AS passed FROM s, z""")
def d6_balance_gate(spark, d):
    c = t(spark, d, "customer").select((F.col("c_custkey") % 2).alias("arm"), "c_acctbal", F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 2).cast("string").alias("src"))
    return G.balance_gate(c, "arm", 0, 1, ["c_acctbal"], ["seg", "src"], "src")


_D7 = {"development_retention": "true", "holdout_retention": "c > 0", "candidate_least": "c >= 522", "candidate_over_base": "c > 500", "candidate_over_start": "c > n", "extractability": "x / n >= 0.9138", "zero_backend_failures": "true", "untargeted_decline": "true", "offline_reload": "true", "base_unchanged": "true", "identities": "n = n"}


@query(f"WITH z AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 20 <> 0) AS c, count(*) FILTER (o_orderkey % 50 <> 0) AS x FROM orders) SELECT {', '.join(f'{c} AS {n}' for n, c in _D7.items())}, {_verdict(_D7)} FROM z")
def d7_promotion(spark, d):
    """Eleven conditions; the candidate cannot have more right than there are."""
    k = F.col("o_orderkey")
    one = t(spark, d, "orders").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(k % 20 != 0).alias("c"), F.count_if(k % 50 != 0).alias("x"))
    true, c = F.lit(True), F.col("c")
    out = G.promotion(true, c > 0, c, F.col("x") / F.col("n"), F.lit(0), true, true, true, true, least=522, base=500, start=F.col("n"), extractable=0.9138)
    return one.select(*out)


@query("""SELECT p_brand, concat_ws(',', CASE WHEN count(*) <> 40 THEN 'attempt_count' END, CASE WHEN count(*) FILTER (p_size > 25) * 4 < count(*) * 3 THEN 'acceptance_rate_below_75_percent' END, CASE WHEN min(p_size) < 2 THEN 'false_labels_present' END) AS reasons FROM part GROUP BY 1""")
def d8_readiness(spark, d):
    g = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("a"), F.min("p_size").alias("m"))
    return g.select("p_brand", G.readiness({"attempt_count": F.col("n") != 40, "acceptance_rate_below_75_percent": F.col("a") * 4 < F.col("n") * 3, "false_labels_present": F.col("m") < 2}).alias("reasons"))


@query("""WITH g AS (SELECT l_suppkey % 10 AS arm, l_orderkey AS g, l_linestatus AS f, var_pop(l_discount) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT arm, count(*) AS groups, count(*) FILTER (v > 0) AS informative, count(DISTINCT CASE WHEN v > 0 THEN f END) AS families FROM g GROUP BY arm)
SELECT arm, groups, informative, informative >= 20 AS enough_groups, families >= 2 AS enough_families, concat_ws(',', CASE WHEN families < 2 THEN 'enough_families' END, CASE WHEN informative < 20 THEN 'enough_groups' END) AS failed_checks, informative >= 20 AND families >= 2 AS passed FROM s""")
def a19_viability(spark, d):
    """Whether an arm has enough groups, of enough families, whose rewards differ."""
    g = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("arm"), "l_orderkey", F.col("l_linestatus").alias("f")).agg((F.max("l_discount") > F.min("l_discount")).alias("v"))
    s = g.groupBy("arm").agg(F.count(F.lit(1)).alias("groups"), F.count_if("v").alias("informative"), F.count_distinct(F.when(F.col("v"), F.col("f"))).alias("families"))
    return s.select("arm", "groups", "informative", *G.checks_row({"enough_groups": F.col("informative") >= 20, "enough_families": F.col("families") >= 2}))


@query("""SELECT count(*) FILTER (k >= 30) AS signals, count(*) FILTER (k >= 30) >= 10 AS enough, CASE WHEN count(*) FILTER (k >= 30) >= 10 THEN '' ELSE 'enough' END AS failed_checks, count(*) FILTER (k >= 30) >= 10 AS passed FROM (SELECT p_brand, count(*) AS k FROM part GROUP BY 1)""")
def d9_signal_gate(spark, d):
    n = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") >= 30).alias("signals"))
    return n.select("signals", *G.checks_row({"enough": F.col("signals") >= 10}))


@query("""SELECT p_brand, arg_max(p_size, p_size) FILTER (p_retailprice < 1500) AS first_passing FROM part GROUP BY p_brand""")
def w16_first_passing(spark, d):
    """The first passing scale in descending order, of each arm."""
    return G.first_passing(t(spark, d, "part"), "p_brand", -F.col("p_size"), "p_size", F.col("p_retailprice") < 1500).withColumnRenamed("p_size", "first_passing")


@query("""SELECT coalesce(min(p_size), 0)::INTEGER AS p_size FROM (SELECT p_size, count(DISTINCT p_brand) AS k FROM part WHERE p_retailprice < 1500 GROUP BY 1) WHERE k = (SELECT count(DISTINCT p_brand) FROM part)""")
def w16_common_passing(spark, d):
    """0: no size passes in all."""
    return G.common_passing(t(spark, d, "part"), "p_brand", "p_size", F.col("p_retailprice") < 1500).select(F.coalesce("p_size", F.lit(0)).alias("p_size"))
