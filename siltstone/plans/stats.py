"""Statistics and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import gates as G
from siltstone.operators import stats as S
from siltstone.plans.base import query, t

_RECORDS = """r AS (SELECT o_orderkey AS id, o_orderpriority AS section, o_orderkey % 3 <> 0 AS correct, o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0 AS extractable,
  o_orderkey % 4 <> 0 AS exact_format, o_orderkey % 11 = 0 AS truncated, o_orderkey % 17 = 0 AS failed, CASE WHEN o_orderkey % 15 = 0 THEN 'no_terminal_answer' WHEN o_orderkey % 15 = 5 THEN 'conflicting_answers' END AS category, o_custkey AS input_tokens, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 500 END AS output_tokens FROM orders)"""


def _records(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("section"), (k % 3 != 0).alias("correct"), ((k % 5 != 0) | (k % 3 != 0)).alias("extractable"), (k % 4 != 0).alias("exact_format"), (k % 11 == 0).alias("truncated"), (k % 17 == 0).alias("failed"), F.when(k % 15 == 0, "no_terminal_answer").when(k % 15 == 5, "conflicting_answers").alias("category"), F.col("o_custkey").alias("input_tokens"), F.when(k % 13 != 0, k % 500).alias("output_tokens"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


@query(f"""WITH {_RECORDS} SELECT section, count(*) AS examples, count(*) FILTER (correct) AS correct, count(*) FILTER (extractable) AS extractable, count(*) FILTER (exact_format) AS exact_format, count(*) FILTER (truncated) AS truncated,
  round(count(*) FILTER (correct) / count(*), 8) AS accuracy, round(count(*) FILTER (extractable) / count(*), 8) AS extraction_rate, round(count(*) FILTER (correct) / count(*) FILTER (extractable), 8) AS accuracy_extractable,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(output_tokens), 8) AS mean_output_tokens FROM r GROUP BY section""")
def a1_evaluation_summary(spark, d):
    return _rounded(S.evaluation_summary(_records(spark, d), "section"), "accuracy", "extraction_rate", "accuracy_extractable", "mean_output_tokens")


@query(f"""WITH {_RECORDS} SELECT count(*) AS examples, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (NOT correct AND extractable) AS wrong_extractable, count(*) FILTER (NOT extractable) AS not_extractable,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (failed) AS generation_failures, count(*) FILTER (NOT exact_format) AS inexact_format FROM r""")
def a3_failure_counts(spark, d):
    return S.failure_counts(_records(spark, d))


@query(f"WITH {_RECORDS} SELECT category, count(*) AS n FROM r WHERE category IS NOT NULL GROUP BY category")
def a3_failure_categories(spark, d):
    return S.margins(_records(spark, d).filter("category is not null"), [["category"]])


_CENSUS = "c AS (SELECT p_brand, p_size::VARCHAR AS p_size, p_type, p_size % 4 AS depth, CASE WHEN p_retailprice < 1000 THEN 'low' ELSE 'high' END AS magnitude, p_size % 3 AS operations, split_part(p_type, ' ', 1) AS grade, p_name FROM part)"


@query(f"""WITH {_CENSUS} SELECT p_brand, p_size, p_type, depth::VARCHAR AS depth, magnitude, operations::VARCHAR AS operations, grade, count(*) AS n, count(DISTINCT p_name) AS names FROM c GROUP BY GROUPING SETS ((p_brand), (p_size), (p_type), (depth), (magnitude), (operations), (grade), ())""")
def a4_capacity_census(spark, d):
    """Seven histograms and the whole, each with its distinct names."""
    p = t(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("p_size"), "p_type", (F.col("p_size") % 4).cast("string").alias("depth"), F.when(F.col("p_retailprice") < 1000, "low").otherwise("high").alias("magnitude"), (F.col("p_size") % 3).cast("string").alias("operations"), F.substring_index("p_type", " ", 1).alias("grade"), "p_name")
    return S.margins(p, [["p_brand"], ["p_size"], ["p_type"], ["depth"], ["magnitude"], ["operations"], ["grade"], []], distinct={"names": "p_name"})


@query("""SELECT c_mktsegment, n, greatest(320 - n, 0) AS deficit, n >= 320 AS enough FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def a5_quota_deficit(spark, d):
    c = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.select("c_mktsegment", "n", F.greatest(320 - F.col("n"), F.lit(0)).alias("deficit"), (F.col("n") >= 320).alias("enough"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def a6_margins(spark, d):
    return S.margins(t(spark, d, "documents"), [["lang"], ["source"], ["lang", "source"], []]).select("lang", "source", "n")


@query("""SELECT source, count(*) AS attempted, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality <> 1) AS rejected, round(count(*) FILTER (quality = 1) / count(*), 8) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def a7_approval(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n, a = F.count(F.lit(1)), F.count_if(F.col("quality") == 1)
    return j.groupBy("source").agg(n.alias("attempted"), a.alias("approved"), (n - a).alias("rejected"), F.round(S.rate(a, n), 8).alias("rate"))


_POINTS = ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99))


@query(f"""SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, round(var_pop(n_chars), 2) AS population_variance, round(var_samp(n_chars), 2) AS sample_variance, {_POINTS} FROM documents GROUP BY lang""")
def a8_distribution(spark, d):
    out = S.distribution(t(spark, d, "documents"), "n_chars", "lang")
    return out.withColumns({"mean": F.round("mean", 6), "population_variance": F.round("population_variance", 2), "sample_variance": F.round("sample_variance", 2)} | {f"p{p}": F.round(f"p{p}", 6) for p in (25, 50, 75, 90, 95, 99)})


@query("""WITH a AS (SELECT c_mktsegment, c_custkey % 2 AS arm, c_acctbal AS v FROM customer),
s AS (SELECT c_mktsegment, abs(avg(v) FILTER (arm = 0) - avg(v) FILTER (arm = 1)) AS g, (var_samp(v) FILTER (arm = 0) + var_samp(v) FILTER (arm = 1)) / 2 AS p FROM a GROUP BY 1)
SELECT c_mktsegment, round(g / sqrt(p), 6) AS smd FROM s""")
def a10_smd(spark, d):
    c = t(spark, d, "customer").withColumn("arm", F.col("c_custkey") % 2)
    return _rounded(S.standardized_difference(c, "c_acctbal", "arm", 0, 1, "c_mktsegment").withColumn("smd", F.round("smd", 6)))


@query("""SELECT c_mktsegment AS level, round(abs(count(*) FILTER (c_custkey % 2 = 0) / (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) - count(*) FILTER (c_custkey % 2 = 1) / (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1)), 8) AS difference FROM customer GROUP BY 1""")
def a11_balance(spark, d):
    return _rounded(S.categorical_balance(t(spark, d, "customer").withColumn("arm", F.col("c_custkey") % 2), "c_mktsegment", "arm", 0, 1), "difference")


@query(f"""WITH {_RECORDS}, s AS (SELECT section, count(*) FILTER (correct) AS h, count(*)::DOUBLE AS n FROM r GROUP BY 1)
SELECT section, h AS hits, n::BIGINT AS total, round((h / n + {S.Z * S.Z} / (2 * n) - {S.Z} * sqrt((h / n * (1 - h / n) + {S.Z * S.Z} / (4 * n)) / n)) / (1 + {S.Z * S.Z} / n), 8) AS wilson_low FROM s""")
def a12_wilson(spark, d):
    s = _records(spark, d).groupBy("section").agg(F.count_if("correct").alias("hits"), F.count(F.lit(1)).alias("total"))
    return s.withColumn("wilson_low", F.round(S.wilson_lower(F.col("hits"), F.col("total")), 8))


_PAIRED = "SELECT o_orderkey AS id, o_orderpriority AS category, o_orderkey % 2 = 0 AS base, o_orderkey % 3 = 0 AS generic, o_orderkey % 5 < 2 AS targeted FROM orders"


def _paired(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("category"), (k % 2 == 0).alias("base"), (k % 3 == 0).alias("generic"), (k % 5 < 2).alias("targeted"))


@query(f"SELECT base, generic, targeted, count(*) AS n FROM ({_PAIRED}) GROUP BY ALL")
def a14_transitions(spark, d):
    return S.transitions(_paired(spark, d), "base", "generic", "targeted")


@query(f"""SELECT category, count(*) AS n, round(avg(base::INT), 8) AS base_accuracy, round(avg(generic::INT), 8) AS generic_accuracy, round(avg(targeted::INT), 8) AS targeted_accuracy,
 round(avg(targeted::INT) - avg(generic::INT), 8) AS delta, avg(targeted::INT) - avg(generic::INT) >= -0.02 - 1e-12 AS within_limit FROM ({_PAIRED}) GROUP BY category""")
def a15_category_effects(spark, d):
    return _rounded(S.category_effects(_paired(spark, d), "category", "base", "generic", "targeted"), "base_accuracy", "generic_accuracy", "targeted_accuracy", "delta")


@query()
def a16_bootstrap(spark, d):
    """Paired differences of two arms over the orders; the tests hold the draws
    against the generator's."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select(k.alias("id"), ((k % 5 < 2).cast("int") - (k % 3 == 0).cast("int")).alias("difference"))
    return S.paired_bootstrap(o, "difference", 20260720, 10_000)


_REWARDS = "SELECT l_orderkey AS g, l_linenumber AS i, CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END + CASE WHEN l_tax > 0.04 THEN 0.1 ELSE 0.0 END AS reward, l_returnflag || l_linestatus AS completion FROM lineitem"


def _rewards(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), (F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0) + F.when(F.col("l_tax") > 0.04, 0.1).otherwise(0.0)).alias("reward"), F.concat("l_returnflag", "l_linestatus").alias("completion"))


@query(f"""SELECT g, count(*) AS n, round(avg(reward), 8) AS mean, round(var_pop(reward), 8) AS variance, count(DISTINCT reward) AS ranks, count(DISTINCT completion) AS completions,
 CASE WHEN count(*) < 2 THEN 'invalid_or_ambiguous' WHEN count(DISTINCT reward) > 1 THEN NULL WHEN min(base) <> max(base) OR min(extra) <> max(extra) THEN 'invalid_or_ambiguous' WHEN count(DISTINCT completion) = 1 THEN 'output_identical' WHEN min(base) = 1 THEN 'all_correct_saturated' WHEN max(base) = 0 THEN 'all_incorrect_saturated' ELSE 'output_diverse_reward_indistinguishable' END AS outcome
 FROM (SELECT *, CASE WHEN reward >= 1 THEN 1 ELSE 0 END AS base, round(reward - CASE WHEN reward >= 1 THEN 1 ELSE 0 END, 4) AS extra FROM ({_REWARDS})) GROUP BY g""")
def a18_zero_variance(spark, d):
    """Groups of one completion are invalid; rewards have two components."""
    base = F.when(F.col("reward") >= 1, 1).otherwise(0)
    r = _rewards(spark, d).withColumns({"base": base, "extra": F.round(F.col("reward") - base, 4), "right": F.col("reward") >= 1})
    g = S.reward_groups(r, "g", "reward", "completion", ["base", "extra"], "right").withColumn("variance", F.when(F.col("ranks") == 1, 0.0).otherwise(F.col("variance")))
    g = g.withColumn("finite", F.col("finite") & (F.col("n") > 1))
    return _rounded(S.zero_variance_class(g), "mean", "variance").select("g", "n", "mean", "variance", "ranks", "completions", "outcome")


@query(f"SELECT g, i, round(reward - avg(reward) OVER (PARTITION BY g), 8) + 0.0 AS advantage FROM ({_REWARDS})")
def a17_advantages(spark, d):
    return S.advantages(_rewards(spark, d), "g", "reward").select("g", "i", (F.round("advantage", 8) + 0.0).alias("advantage"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS x, l_linenumber % 2 AS arm FROM lineitem),
k AS (SELECT k FROM s GROUP BY k HAVING count(DISTINCT arm) = 2),
x AS (SELECT k, x, count(*) AS c FROM s JOIN k USING (k) GROUP BY ALL)
SELECT count(*) FILTER (c = 2) AS shared, count(*) AS either, round(count(*) FILTER (c = 2) / count(*), 8) AS rate FROM x""")
def a20_overlap_rate(spark, d):
    li = t(spark, d, "lineitem")
    return _rounded(S.overlap_rate(li.filter("l_linenumber % 2 = 0"), li.filter("l_linenumber % 2 = 1"), "l_suppkey", "l_partkey"), "rate")


@query("""WITH h AS (SELECT sha256(text) AS h, row_number() OVER (ORDER BY doc_id, sha256(text)) - 1 AS n FROM documents),
g AS (SELECT n // 4096 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM h GROUP BY 1), k AS (SELECT n // 4096 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM g GROUP BY 1)
SELECT CASE WHEN (SELECT count(*) FROM g) = 1 THEN (SELECT h FROM g) ELSE (SELECT h FROM k) END AS digest""")
def a26_content_digest(spark, d):
    return S.tree_digest(t(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT l_orderkey, l_linenumber, round((exp(l_tax - l_discount) - 1) - (l_tax - l_discount), 10) AS kl FROM lineitem")
def a27_token_kl(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.token_kl(F.col("l_discount"), F.col("l_tax")), 10).alias("kl"))


@query("""SELECT round(sqrt(sum(l_tax * l_tax)), 6) AS norm_x, round(sqrt(sum(l_discount * l_discount)), 6) AS norm_y, round(sum(l_tax * l_discount) / (sqrt(sum(l_tax * l_tax)) * sqrt(sum(l_discount * l_discount))), 8) AS cosine, max(abs(l_tax)) AS max_x, max(abs(l_discount)) AS max_y FROM lineitem""")
def a28_norms(spark, d):
    out = S.norms(t(spark, d, "lineitem"), "l_tax", "l_discount")
    return out.withColumns({"norm_x": F.round("norm_x", 6), "norm_y": F.round("norm_y", 6), "cosine": F.round("cosine", 8)})


@query("""WITH z AS (SELECT sum(CASE WHEN l_linestatus = 'F' THEN -least(r * a, least(greatest(r, 0.8), 1.2) * a) ELSE 0.0 END) / 1000.0 AS p, 0.04 * sum(CASE WHEN l_linestatus = 'F' THEN (exp(a) - 1) - a ELSE 0.0 END) / 1000.0 AS k FROM (SELECT l_linestatus, 0.5 + l_tax * 10 AS r, l_discount - 0.05 AS a FROM lineitem))
SELECT round(p, 4) AS policy, round(k, 6) AS kl, round(p + k, 4) AS objective FROM z""")
def a29_objective(spark, d):
    a = F.col("l_discount") - 0.05
    li = t(spark, d, "lineitem").select((F.col("l_linestatus") == "F").alias("m"), (0.5 + F.col("l_tax") * 10).alias("r"), a.alias("a"), S.token_kl(F.lit(0.0), a).alias("k"))
    out = S.clipped_objective(li, "r", "a", "m", 0.2, 1000.0, "k", 0.04)
    return out.select(F.round("policy", 4).alias("policy"), F.round("kl", 6).alias("kl"), F.round("objective", 4).alias("objective"))


@query("""SELECT l_orderkey, min(l_linenumber) AS first_line, arg_min(l_linenumber, (l_quantity, l_extendedprice, l_linenumber)) AS chosen FROM lineitem WHERE l_discount >= 0.02 GROUP BY l_orderkey""")
def w3_best_of_n(spark, d):
    """The eligible line of least (quantity, price, number) of each order."""
    li = t(spark, d, "lineitem").filter("l_discount >= 0.02")
    return li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.min_by("l_linenumber", F.struct("l_quantity", "l_extendedprice", "l_linenumber")).alias("chosen"))


@query("""SELECT p_brand, count(*) AS total, count(*) FILTER (p_size > 25) AS accepted, count(*) FILTER (p_size > 25) * 2 >= count(*) AS covered FROM part GROUP BY p_brand""")
def a23_coverage(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") > 25).alias("accepted")).withColumn("covered", F.col("accepted") * 2 >= F.col("total"))


@query(f"""WITH {_RECORDS}, s AS (SELECT section, count(*) AS n, count(*) FILTER (correct) AS c, avg(correct::INT) AS a FROM r GROUP BY 1)
SELECT count(*)::INTEGER AS sections, bool_and(a >= 0.6 - 1e-12) AS sections_pass, sum(c) / sum(n) >= 0.65 - 1e-12 AS overall_pass, bool_and(a >= 0.6 - 1e-12) AND sum(c) / sum(n) >= 0.65 - 1e-12 AS passed FROM s""")
def d1_retention_gate(spark, d):
    return G.retention_gate(_records(spark, d), "section", "correct", least_section=0.6, least_overall=0.65)


@query("""SELECT a.n AS first_n, b.n AS second_n, abs(a.s - b.s) <= 0.005 * greatest(a.s, b.s) AS tokens_match, a.n = b.n AS counts_match FROM
 (SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_orderkey % 2 = 0) a, (SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_orderkey % 2 = 1) b""")
def d5_parity_gate(spark, d):
    return G.parity_gate(t(spark, d, "lineitem").withColumn("arm", F.col("l_orderkey") % 2), "arm", 0, 1, "l_quantity", 0.005)


@query("""SELECT p_brand, max(p_size) FILTER (p_retailprice < 1500) AS latest_passing, min(p_size) FILTER (p_retailprice < 1500) AS first_passing FROM part GROUP BY p_brand""")
def w15_passing(spark, d):
    """The latest and the first passing checkpoint of each arm."""
    return G.passing(t(spark, d, "part"), "p_brand", "p_size", F.col("p_retailprice") < 1500)
