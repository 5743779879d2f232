"""Extraction, verification, rewards and classes over responses that are built
from the orders and lineitem tables by key, so that SQL can state what is due."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import exact as E
from siltstone.functions import responses as R
from siltstone.functions import text as X
from siltstone.operators import stats as S
from siltstone.operators.scoring import strict_answer
from siltstone.plans.base import query, sql_tokens, t

_SAID = r"""s AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_custkey AS n, o_orderkey % 8 = 7 AS cut, CASE o_orderkey % 8
  WHEN 0 THEN 'So the total is ' || o_custkey || ' apples.' WHEN 1 THEN 'We get' || chr(10) || '\boxed{' || o_custkey || '}' WHEN 2 THEN 'Final answer: ' || o_custkey || '/7'
  WHEN 3 THEN 'The answer is ' || o_custkey || '. The answer is ' || (o_custkey + 1) || '.' WHEN 4 THEN 'Final answer: 12,3' WHEN 5 THEN 'no number here' WHEN 6 THEN ' ' ELSE 'Final answer: ' || o_custkey END AS said FROM orders),
x AS (SELECT *, CASE WHEN k IN (0, 1) THEN n::VARCHAR WHEN k = 2 THEN CASE WHEN n % 7 = 0 THEN (n // 7)::VARCHAR ELSE n || '/7' END END AS value,
  CASE k WHEN 3 THEN 'conflicting_answers' WHEN 4 THEN 'malformed_terminal_answer' WHEN 5 THEN 'no_terminal_answer' WHEN 6 THEN 'empty_response' WHEN 7 THEN 'generation_truncated' END AS category FROM s)"""


def _said(spark, d):
    k, n, c = F.col("o_orderkey") % 8, F.col("o_custkey"), F.col("o_custkey").cast("string")
    text = (F.when(k == 0, F.concat(F.lit("So the total is "), c, F.lit(" apples."))).when(k == 1, F.concat(F.lit("We get\n\\boxed{"), c, F.lit("}"))).when(k == 2, F.concat(F.lit("Final answer: "), c, F.lit("/7")))
            .when(k == 3, F.concat(F.lit("The answer is "), c, F.lit(". The answer is "), (n + 1).cast("string"), F.lit("."))).when(k == 4, "Final answer: 12,3").when(k == 5, "no number here").when(k == 6, " ").otherwise(F.concat(F.lit("Final answer: "), c)))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"), (k == 7).alias("cut"), text.alias("said"))


@query(f"WITH {_SAID} SELECT id, value, category FROM x")
def x3_canonical_number(spark, d):
    return _said(spark, d).select("id", A.canonical_answer(F.col("said"), F.col("cut")).alias("f")).select("id", "f.*")


@query(f"WITH {_SAID} SELECT id, value AS predicted, n::VARCHAR AS expected, coalesce(value = n::VARCHAR, false) AS correct, category FROM x")
def x4_canonical_score(spark, d):
    s = _said(spark, d).select("id", F.col("n").cast("string").alias("n"), A.canonical_answer(F.col("said"), F.col("cut")).alias("f"))
    return s.select("id", A.canonical_score(F.col("f"), F.col("n")).alias("s")).select("id", "s.*")


@query(f"""WITH {_SAID} SELECT count(*) AS examples, count(*) FILTER (k = 7 OR (k = 2 AND false)) AS exact_format, count(*) FILTER (value IS NOT NULL) AS extractable, count(*) FILTER (value = n::VARCHAR) AS correct,
  count(*) FILTER (value IS NULL) AS rejected, count(*) FILTER (category = 'conflicting_answers') AS conflicting, count(*) FILTER (category = 'generation_truncated') AS truncated FROM x""")
def a2_rescore_summary(spark, d):
    """Strict and canonical scores of stored responses, summed."""
    s = _said(spark, d).select("n", strict_answer(F.col("said")).alias("strict"), A.canonical_answer(F.col("said"), F.col("cut")).alias("f"))
    return S.rescore_summary(s.select(F.col("strict.error").isNull().alias("exact"), F.col("f.value").alias("value"), F.col("n").cast("string").alias("expected"), F.col("f.category").alias("category")))


_TERMS = "i AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_linenumber % 4 AS k FROM lineitem)"


def _terms(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"), (F.col("l_partkey") + F.col("l_suppkey")).alias("sum"), (F.col("l_linenumber") % 4).alias("k"))


@query(f"""WITH {_TERMS} SELECT o, l, CASE WHEN k IN (0, 1) THEN ((p + s) * l)::VARCHAR END AS value, CASE WHEN k IN (0, 1) THEN 2 ELSE 0 END::INTEGER AS n_operations, CASE WHEN k IN (0, 1) THEN 2 ELSE 0 END::INTEGER AS depth,
  CASE k WHEN 2 THEN 'formula_division_by_zero' WHEN 3 THEN 'formula_equality_disagreement' END AS error FROM i""")
def x5_formula(spark, d):
    i = _terms(spark, d)
    left, value = F.concat(F.lit("("), F.col("p"), F.lit(" + "), F.col("s"), F.lit(") * "), F.col("l").cast("string")), (F.col("sum") * F.col("l")).cast("string")
    text = F.when(F.col("k") < 2, F.concat(left, F.lit(" = "), value)).when(F.col("k") == 2, F.concat(F.col("p"), F.lit("/0 = 1"))).otherwise(F.concat(F.col("p"), F.lit(" = "), F.col("p"), F.lit(" + 1")))
    return i.select("o", "l", E.formula(text).alias("f")).select("o", "l", "f.value", F.coalesce("f.count", F.lit(0)).alias("n_operations"), F.coalesce("f.depth", F.lit(0)).alias("depth"), "f.error")


@query(f"""WITH {_TERMS} SELECT o, l, CASE WHEN k IN (0, 1) THEN ((p + s) * 100)::VARCHAR WHEN k = 2 THEN gcd(p, s)::VARCHAR END AS value, CASE WHEN k IN (0, 1) THEN 'add,multiply' WHEN k = 2 THEN 'gcd' END AS operations,
  CASE WHEN k = 3 THEN 'mathqa_unknown_constant' END AS error FROM i""")
def x6_program(spark, d):
    i = _terms(spark, d)
    pair = F.concat(F.col("p"), F.lit(", "), F.col("s"))
    text = F.when(F.col("k") < 2, F.concat(F.lit("multiply(add("), pair, F.lit("), const_100)"))).when(F.col("k") == 2, F.concat(F.lit("gcd("), pair, F.lit(")"))).otherwise("add(const_7, 1)")
    return i.select("o", "l", E.program(text).alias("f")).select("o", "l", "f.value", F.array_join("f.operations", ",").alias("operations"), "f.error").withColumn("operations", F.when(F.col("error").isNull(), F.col("operations")))


@query(f"""WITH {_TERMS} SELECT o, l, CASE k WHEN 0 THEN p::VARCHAR WHEN 1 THEN p::VARCHAR WHEN 2 THEN (2 * p + 1)::VARCHAR || '/2' END AS value, CASE k WHEN 0 THEN 'apples' WHEN 1 THEN '$' WHEN 2 THEN 'cups' END AS unit,
  CASE k WHEN 2 THEN 'terminating_decimal' WHEN 3 THEN NULL ELSE 'integer' END AS answer_type, CASE k WHEN 3 THEN 'answer_requires_single_number' END AS error FROM i""")
def x7_answer(spark, d):
    i, p, k = _terms(spark, d), F.col("p"), F.col("k")
    text = F.when(k == 0, F.concat(p, F.lit(" apples"))).when(k == 1, F.concat(F.lit("$"), p)).when(k == 2, F.concat(p, F.lit(" 1/2 cups"))).otherwise(F.concat(p, F.lit(" or 3")))
    return i.select("o", "l", E.answer(text).alias("f")).select("o", "l", "f.*")


@query(f"""WITH {_TERMS} SELECT o, l, label, CASE label WHEN 'a' THEN p::VARCHAR WHEN 'b' THEN (s * 1000000)::VARCHAR WHEN 'c' THEN CASE WHEN p % 3 = 0 THEN (p // 3)::VARCHAR ELSE p || '/3' END WHEN 'd' THEN l::VARCHAR END AS value
FROM i, unnest(['a', 'b', 'c', 'd', 'e']) AS u(label) WHERE k <> 3""")
def x8_options(spark, d):
    """One row an option; a list without exactly a to e gives none."""
    i = _terms(spark, d)
    text = F.when(F.col("k") == 3, "a ) 1 , b ) 2").otherwise(F.concat(F.lit("a ) "), F.col("p"), F.lit(" , b ) "), F.col("s"), F.lit(" million , c ) "), F.col("p"), F.lit("/3 , d ) "), F.col("l").cast("string"), F.lit(" , e ) none of these")))
    return i.select("o", "l", F.explode(E.options(text)).alias("x")).select("o", "l", "x.label", "x.value")


_FORMULA_ROWS = """CASE k WHEN 0 THEN 'verified_supported' WHEN 1 THEN 'verified_unsupported' ELSE 'rejected' END AS status, CASE k WHEN 2 THEN 'formula_answer_disagreement' WHEN 3 THEN 'unit_incompatible' END AS reason,
  CASE k WHEN 0 THEN 'rate_ratio_percentage_or_average' WHEN 1 THEN 'unsupported' END AS family, CASE WHEN k < 2 THEN (p + s)::VARCHAR END AS answer"""


@query(f"WITH {_TERMS} SELECT o, l, {_FORMULA_ROWS} FROM i")
def x10_formula_rows(spark, d):
    """Rows of formula, answer, question and type: evidence or a reason."""
    i, k, total = _terms(spark, d), F.col("k"), F.col("sum").cast("string")
    formula = F.concat(F.col("p"), F.lit(" + "), F.col("s"), F.lit(" = "), total)
    said = F.when(k == 2, F.concat((F.col("sum") + 1).cast("string"), F.lit(" apples"))).when(k == 3, F.concat(total, F.lit(" pears"))).otherwise(F.concat(total, F.lit(" apples")))
    v = i.select("o", "l", E.verified_formula(formula, said, F.lit("How many apples are there?"), F.when(k == 0, "Ratio").otherwise("Other")).alias("v"))
    return v.select("o", "l", "v.status", "v.reason", "v.family", "v.answer")


@query(f"""WITH {_TERMS} SELECT o, l, CASE WHEN k < 2 THEN 'verified_supported' ELSE 'rejected' END AS status, CASE k WHEN 2 THEN 'mathqa_invalid_correct_option' WHEN 3 THEN 'mathqa_program_option_disagreement' END AS reason,
  CASE k WHEN 0 THEN 'rate_ratio_percentage_or_average' WHEN 1 THEN 'multi_step_bookkeeping_or_omission' END AS family, CASE WHEN k < 2 THEN (p + s)::VARCHAR END AS answer FROM i""")
def x10_program_rows(spark, d):
    """The same of programs with options, as x9 classifies them."""
    i, k, total = _terms(spark, d), F.col("k"), F.col("sum").cast("string")
    options = F.concat(F.lit("a ) -1 , b ) "), total, F.lit(" , c ) "), (F.col("sum") + 1).cast("string"), F.lit(" , d ) x , e ) none"))
    program = F.concat(F.lit("add("), F.col("p"), F.lit(", "), F.col("s"), F.lit(")"))
    v = i.select("o", "l", E.verified_program(F.lit("Add the numbers."), options, F.when(k == 2, "f").when(k == 3, "c").otherwise("b"), program, F.when(k == 0, "gain").otherwise("general")).alias("v"))
    return v.select("o", "l", "v.status", "v.reason", "v.family", "v.answer")


@query("SELECT p_partkey, CASE WHEN t IN ('ECONOMY', 'LARGE') THEN 'rate_ratio_percentage_or_average' WHEN t = 'MEDIUM' OR op IN ('gcd', 'max') THEN 'constraint_distribution_or_discrete_reasoning' ELSE 'multi_step_bookkeeping_or_omission' END AS family FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS t, CASE p_size % 4 WHEN 0 THEN 'gcd' WHEN 1 THEN 'max' ELSE 'add' END AS op FROM part)")
def x9_families(spark, d):
    """The family of a category and its operations, in column expressions."""
    kind = F.substring_index("p_type", " ", 1)
    category = F.when(kind.isin("ECONOMY", "LARGE"), "gain").when(kind == "MEDIUM", "geometry").otherwise("general")
    op = F.when(F.col("p_size") % 4 == 0, "gcd").when(F.col("p_size") % 4 == 1, "max").otherwise("add")
    return t(spark, d, "part").select("p_partkey", E.family_of(category, F.array(op)).alias("family"))


_DONE = r"""q AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_custkey AS n, o_custkey % 300 AS n_tokens, o_orderkey % 8 = 7 AS cut FROM orders),
f AS (SELECT *, k IN (0, 2, 3, 7) AS correct, k IN (0, 1, 2, 3, 7) AS extractable, k = 3 AS echo, k IN (4, 6) AS asks, k IN (0, 3, 7) AS exact, k = 5 AS conflict FROM q)"""


def _done(spark, d):
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    prompt, final = F.concat(F.lit("Count the "), c, F.lit(" items in the long list of the store.")), F.concat(F.lit("Final answer: "), c)
    more = (F.col("o_custkey") + 1).cast("string")
    said = (F.when(k == 0, F.concat(F.lit("We add.\n"), final)).when(k == 1, F.concat(F.lit("Final answer: "), more)).when(k == 2, F.concat(F.lit("The answer is "), c, F.lit("."))).when(k == 3, F.concat(prompt, F.lit("\n"), final))
            .when(k == 4, F.concat(final, F.lit("\nProblem: next"))).when(k == 5, F.concat(F.lit("The answer is "), c, F.lit(". The answer is "), more, F.lit("."))).when(k == 6, "I do not know?").otherwise(final))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), k.alias("k"), c.alias("expected"), prompt.alias("prompt"), said.alias("said"), (F.col("o_custkey") % 300).alias("n_tokens"), (k == 7).alias("cut"))


def _scored(spark, d):
    return _done(spark, d).withColumn("f", R.item_score(F.lit("numeric_terminal"), F.col("prompt"), F.col("expected"), F.col("said")))


@query(f"WITH {_DONE} SELECT id, correct, extractable, NOT extractable AS malformed, echo AS prompt_echo, asks AS question_generation, exact AS exact_format FROM f")
def x13_item_score(spark, d):
    return _scored(spark, d).select("id", "f.correct", "f.extractable", "f.malformed", "f.prompt_echo", "f.question_generation", "f.exact_format")


@query("""SELECT p_partkey, p_size % 3 IN (0, 1) AS correct, p_size % 3 < 2 AS extractable FROM part""")
def x13_json_items(spark, d):
    """JSON items are equal whatever the order of keys."""
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"b": [1], "a": '), size, F.lit("}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(' {"a":'), size, F.lit(',"b":[1]} '))).otherwise("{")
    f = t(spark, d, "part").select("p_partkey", R.item_score(F.lit("json_exact"), F.lit("p"), F.concat(F.lit('{"a": '), size, F.lit(', "b": [1]}')), said).alias("f"))
    return f.select("p_partkey", "f.correct", "f.extractable")


@query(f"WITH {_DONE} SELECT id, k IN (0, 3, 7) AS states_answer, k IN (0, 1, 3, 7) AS states_number FROM f")
def x12_final_line(spark, d):
    return _done(spark, d).select("id", R.states_answer(F.col("said"), F.col("expected")).alias("states_answer"), R.states_number(F.col("said")).alias("states_number"))


@query(f"WITH {_DONE} SELECT id, CASE k WHEN 0 THEN 1.15 WHEN 1 THEN 0.1 WHEN 2 THEN 1.1 WHEN 3 THEN 0.9 WHEN 7 THEN 1.05 ELSE -0.25 END::DOUBLE AS total FROM f")
def x14_reward(spark, d):
    s = _scored(spark, d)
    return s.select("id", R.task_reward(F.col("f"), R.states_answer(F.col("said"), F.col("expected")), F.col("cut"), joint=True)["total"].alias("total"))


@query(f"""WITH {_DONE}, r AS (SELECT *, id % 16 = 0 AS failed, CASE k WHEN 0 THEN 1.15 WHEN 1 THEN 0.15 WHEN 2 THEN 1.1 WHEN 3 THEN 0.9 WHEN 4 THEN -0.75 WHEN 5 THEN -0.5 WHEN 6 THEN -0.75 ELSE 1.05 END AS v,
  CASE k WHEN 0 THEN 1.2 WHEN 1 THEN 0.1 WHEN 2 THEN 1.1 WHEN 3 THEN 0.9 WHEN 4 THEN -0.75 WHEN 5 THEN -0.5 WHEN 6 THEN -0.75 ELSE 1.1 END AS w FROM f)
SELECT id, round(CASE WHEN failed THEN 0.05 - 1.5 ELSE v END, 10)::DOUBLE AS task_total, round(CASE WHEN failed THEN -1.5 ELSE w END, 10)::DOUBLE AS replay_total FROM r""")
def x15_reward(spark, d):
    """Both kinds of the second version; every sixteenth run failed."""
    s, failed = _scored(spark, d), F.col("id") % 16 == 0
    task = R.task_reward(F.col("f"), R.states_number(F.col("said")), F.col("cut"), failed)
    return s.select("id", task["total"].alias("task_total"), R.replay_reward(F.col("f"), F.col("cut"), failed)["total"].alias("replay_total"))


@query(f"WITH {_DONE} SELECT id, false AS disagreement, k = 0 AND n_tokens BETWEEN 1 AND 256 AS eligible FROM f")
def x16_candidates(spark, d):
    s = _scored(spark, d)
    return s.select("id", R.candidate(F.col("f"), F.col("expected"), A.canonical_answer(F.col("said")), F.col("n_tokens"), F.col("cut"), F.lit(False)).alias("c")).select("id", "c.*")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'same_verifier_id' WHEN 1 THEN 'same_method_family' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'verifier_disagreement' END END AS reason FROM orders")
def x11_combined(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    reason = R.combined_evidence((F.lit("one"), F.when(k == 0, "one").otherwise("two")), (F.lit("replay"), F.when(k == 1, "replay").otherwise("inverse")), (c, F.when((k == 2) & (F.col("o_custkey") % 2 == 0), F.lit("x")).otherwise(c)))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("reason"))


_COLLAPSE = f"""WITH {_DONE} SELECT id, CASE k WHEN 0 THEN 'terminal_answer_contract_present' WHEN 1 THEN 'near_empty_or_premature_eos' WHEN 2 THEN 'answer_in_unsupported_form' WHEN 3 THEN 'prompt_or_question_echo' WHEN 4 THEN 'ambiguous_or_malformed_answer'
  WHEN 5 THEN 'ambiguous_or_malformed_answer' WHEN 6 THEN 'unrelated_or_unclassifiable_prose' ELSE 'token_limit_truncation' END AS category,
  CASE k WHEN 0 THEN 'other_lexical' WHEN 2 THEN 'reasoning_connective' WHEN 3 THEN 'other_lexical' WHEN 5 THEN 'reasoning_connective' WHEN 6 THEN 'other_lexical' ELSE 'final_answer' END AS first_pattern FROM f"""


def _collapse(spark, d):
    s = _done(spark, d).withColumn("a", A.canonical_answer(F.col("said"), F.col("cut")))
    s = s.withColumns({"r": X.tokens(F.col("said"), mask=True), "q": X.tokens(F.col("prompt"), mask=True)})
    strict = strict_answer(F.col("said"))["error"].isNull()
    return s.select("id", R.collapse_class(F.col("said"), F.col("r"), F.col("q"), F.col("cut"), strict, F.col("a.value").isNotNull(), F.col("a.category")).alias("category"), R.first_pattern(F.col("r")).alias("first_pattern"))


@query(_COLLAPSE)
def x17_collapse(spark, d):
    return _collapse(spark, d)


@query(f"SELECT category, first_pattern, count(*) AS n FROM ({_COLLAPSE}) GROUP BY GROUPING SETS ((category), (first_pattern))")
def a22_collapse_counts(spark, d):
    return S.margins(_collapse(spark, d), [["category"], ["first_pattern"]])


@query(f"""WITH {_DONE} SELECT id, CASE k WHEN 0 THEN 'concise_natural_reasoning' WHEN 2 THEN 'concise_natural_reasoning,malformed_final_line' WHEN 3 THEN 'concise_natural_reasoning,question_restatement,answer_before_final_line'
  WHEN 4 THEN 'concise_natural_reasoning,answer_before_final_line,malformed_final_line' WHEN 5 THEN 'concise_natural_reasoning,malformed_final_line' WHEN 6 THEN 'concise_natural_reasoning,malformed_final_line' ELSE 'concise_natural_reasoning' END AS styles FROM f""")
def x18_styles(spark, d):
    s = _done(spark, d)
    return s.select("id", F.array_join(R.target_styles(F.col("said"), F.col("prompt"), F.col("expected"), F.lit(20)), ",").alias("styles"))


@query(f"""WITH {_DONE} SELECT id, k IN (0, 3, 4, 7) AS one_clear_answer, k IN (0, 3, 7) AS ends_exactly, false AS other_terminal, k IN (3, 4) AS answer_before_end, false AS several_markers, false AS program_trace, k = 6 AS worksheet FROM f""")
def x19_format(spark, d):
    return _done(spark, d).select("id", R.format_flags(F.col("said"), F.col("expected")).alias("f")).select("id", "f.*")


@query(f"""WITH {_DONE} SELECT id, CASE WHEN k % 3 = 0 THEN 'exact_text_equality' WHEN extractable THEN 'numeric_terminal_expected_answer_equality' ELSE 'numeric_terminal_extraction_required' END AS rule,
  CASE WHEN k % 3 = 0 THEN 'exact_format_mismatch' WHEN extractable THEN 'wrong_extractable_numeric_answer' ELSE 'malformed_nonextractable_numeric_answer' END AS family FROM f WHERE NOT correct""")
def x28_failure_rule(spark, d):
    s = _scored(spark, d).filter(~F.col("f.correct"))
    return s.select("id", R.failure_rule(F.when(F.col("k") % 3 == 0, "format").otherwise("arithmetic"), F.col("f.extractable")).alias("r")).select("id", "r.*")


@query(f"""SELECT conv_id, sum(n + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::INTEGER AS n_tokens, sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END)::INTEGER AS loss_tokens
FROM (SELECT conv_id, role, len({sql_tokens('text')}) AS n FROM conversations) GROUP BY conv_id""")
def x26_loss_mask(spark, d):
    """Tokens and trained tokens of conversations, by words as tokens."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(X.tokens(F.col("text")), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(50_000)).cast("int")).alias("ids"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids"))).alias("m"))
    out = turns.select("conv_id", R.loss_mask(F.col("m"), 2).alias("x"))
    return out.select("conv_id", F.size("x.input_ids").alias("n_tokens"), F.size(F.filter("x.labels", lambda v: v != -100)).alias("loss_tokens"))


@query(f"""WITH {_DONE} SELECT k AS kind, count(*) AS completions, round(sum(CASE k WHEN 0 THEN 1.15 WHEN 1 THEN 0.1 WHEN 2 THEN 1.1 WHEN 3 THEN 0.9 WHEN 7 THEN 1.05 ELSE -0.25 END), 6)::DOUBLE AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (asks OR echo) AS penalised FROM f GROUP BY k""")
def a21_reward_summary(spark, d):
    """Component totals of the rewards by kind of source."""
    s = _scored(spark, d).select("k", "f", R.task_reward(F.col("f"), R.states_answer(F.col("said"), F.col("expected")), F.col("cut"), joint=True).alias("r"))
    return S.reward_summary(s.select(F.col("k").alias("kind"), F.col("r.total").alias("total"), F.col("f.correct").alias("correct"), (F.col("f.question_generation") | F.col("f.prompt_echo")).alias("penalised")), "kind")


@query(r"""SELECT conv_id, turn, contains(regexp_replace(regexp_replace(text, '```[\s\S]*?```|`[^`\n]*`', '', 'g'), '(?:=|≈|≃|≅|→|->)\s*\?', '', 'g'), '?') OR regexp_matches(text, '(?i)(?:^|\n)\s*(?:question|problem)\s*:') AS asks FROM conversations WHERE role = 'assistant'""")
def p16_question_generation(spark, d):
    """Against an empty prompt, so that no quotation is the prompt's."""
    c = t(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", R.question_generation(F.lit(""), F.col("text"))["decision"].alias("asks"))


@query("""SELECT DISTINCT w AS token, CASE WHEN w IN ('feet') THEN 'foot' WHEN w = 'inches' THEN 'inch' WHEN w = 'pennies' THEN 'penny' WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
  WHEN ends_with(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS stem
FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part)""")
def p17_unit_stems(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("([a-z]+)"), F.lit(1)))
    return t(spark, d, "part").select(words.alias("token")).distinct().select("token", E.stemmed_unit(F.col("token")).alias("stem"))


@query("""SELECT DISTINCT l_linenumber AS n, CASE l_linenumber WHEN 3 THEN 'fraction' WHEN 6 THEN 'fraction' WHEN 7 THEN 'fraction' WHEN 1 THEN 'integer' ELSE 'terminating_decimal' END AS answer_type FROM lineitem""")
def p18_answer_types(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return li.select("n", E.answer(F.concat(F.lit("1/"), F.col("n").cast("string")))["answer_type"].alias("answer_type"))
