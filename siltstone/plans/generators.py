"""Generated problems and the checks of their wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions import exact as E
from siltstone.functions import surface as U
from siltstone.operators import generators as G
from siltstone.operators.scoring import strict_answer
from siltstone.plans.base import query, sql_tokens, t


def _plan(spark, d):
    """A variant for each part."""
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k.alias("variant"), F.element_at(F.array(*map(F.lit, G.UPDATES)), (k % 3 + 1).cast("int")).alias("difficulty"))


_DRAW = "(('0x' || substr(sha256('{s}:' || variant::VARCHAR || ':{n}'), 1, 8))::BIGINT % ({b} - {a} + 1) + {a})"


def _draw(s, n, a, b):
    return _DRAW.format(s=s, n=n, a=a, b=b)


@query("SELECT p_partkey AS variant, true AS valid, (p_partkey % 5 = 4) AS grouped FROM part")
def g1_bookkeeping(spark, d):
    out = G.bookkeeping(_plan(spark, d))
    return out.select("variant", "valid", (F.col("groups") > 1).alias("grouped"))


@query(f"""WITH v AS (SELECT p_partkey AS variant FROM part), w AS (SELECT variant, variant % 5 AS m, {_draw('rates', 'a', 2, 30)} AS a, {_draw('rates', 'b', 2, 12)} AS b, {_draw('rates', 'c', 1, 9)} AS c FROM v)
SELECT variant, (CASE m WHEN 0 THEN a * b WHEN 1 THEN a * c WHEN 2 THEN a * b * 5 WHEN 3 THEN a * c + b * c ELSE (a + b) * c END)::BIGINT AS answer, true AS valid FROM w""")
def g2_rates(spark, d):
    return G.rates(_plan(spark, d)).select("variant", "answer", "valid")


@query(f"""WITH v AS (SELECT p_partkey AS variant FROM part) SELECT variant, ({_draw('discrete', 'x', 1, 19)})::BIGINT AS answer, 1 AS solutions, true AS agree FROM v""")
def g3_discrete(spark, d):
    """The answer that was built is the only one in the domain."""
    out = G.discrete(_plan(spark, d))
    return out.select("variant", "answer", "solutions", (F.col("answer") == F.col("searched")).alias("agree"))


_FRAMES = {"rate_total": ["<A> a day for <B> days: how many?", "How many are <B> times <A>?"], "ratio_scale": ["At <B> to <A>, how many for <C>?"], "percentage": ["What is <B> percent of <A>?"], "weighted_average": ["<C> of <A> and <C> of <B>: how many?"], "combined_rate": ["<A> and <B> a day, <C> days: how many?"]}


@query("SELECT p_partkey AS variant, true AS filled, true AS suits FROM part")
def g4_templates(spark, d):
    """Each problem in a template of its mode, nothing left to fill."""
    p = G.rates(_plan(spark, d)).drop("valid")
    out = G.rendered(p, G.template_bank(spark, _FRAMES, ["", "Think. "]), "mode", "variant", "bank")
    return out.select("variant", (~F.rlike("question", F.lit(U.PLACEHOLDER))).alias("filled"), F.startswith("template_id", F.col("mode")).alias("suits"))


@query("""SELECT l_orderkey, l_linenumber, 'Take <QUANTITY_B> of <QUANTITY_C> now?' AS template, l_partkey::VARCHAR || ',' || l_suppkey::VARCHAR AS "values" FROM lineitem""")
def g5_request(spark, d):
    q = F.concat(F.lit("Take "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"), F.lit(" now?"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.realization_request(q).alias("r")).select("l_orderkey", "l_linenumber", "r.template", F.array_join("r.values", ",").alias("values"))


@query("""SELECT id, section, CASE section WHEN 'arithmetic' THEN (id % 83 + 11 + id % 37 + 3)::VARCHAR WHEN 'format' THEN '[' || (id % 83 + 11) || ']' ELSE 'item' || (id % 37 + 3) END AS expected
FROM (SELECT range AS id, CASE range % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'format' ELSE 'instruction' END AS section FROM range(450))""")
def g6_retention_items(spark, d):
    return G.retention_items(spark, 450).select("id", "section", "expected")


@query("SELECT item_id, 'echo: ' || text AS response FROM benchmark")
def g7_backend(spark, d):
    """A backend that is a table of responses."""
    b = t(spark, d, "benchmark")
    return G.answered(b.select("item_id"), b.select("item_id", F.concat(F.lit("echo: "), "text").alias("response")), "item_id")


@query("""SELECT event_id, sha256('{"a":' || (event_id % 7) || ',"b":["x",' || event_id || ']}') AS digest, event_id % 2 = 0 AS equal FROM events""")
def g10_json(spark, d):
    """Canonical digests and deep equality, whatever the order of keys."""
    i = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"b": ["x", '), i, F.lit('], "a": '), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"a":'), (F.col("event_id") % 7).cast("string"), F.lit(',"b":["x",'), F.when(F.col("event_id") % 2 == 0, i).otherwise(F.lit("null")), F.lit("]}"))
    return t(spark, d, "events").select("event_id", E.canonical_hash(one).alias("digest"), E.json_equal(one, two).alias("equal"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'approve' ELSE 'reject' END AS recommendation, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'repeated wording' WHEN 2 THEN 'grammar' ELSE 'missing information,internal terminology' END AS defects FROM part""")
def x25_language_audit(spark, d):
    k = F.col("p_size") % 4
    good = "A shop has seven red boxes and sells three of the boxes, so how many boxes are left?"
    q = F.when(k == 0, good).when(k == 1, good.replace("the boxes", "the the boxes")).when(k == 2, good.replace("three", "the 2th")).otherwise("What is frame_id of it?")
    return t(spark, d, "part").select("p_partkey", U.language_audit(q).alias("a")).select("p_partkey", "a.recommendation", F.array_join("a.defects", ",").alias("defects"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'malformed_punctuation,conclusion_inconsistent' WHEN 2 THEN 'duplicated_clause,repeated_adjacent_phrase' ELSE 'grammar_or_sentence_incomplete,sentence_capitalization_failure,empty_clause,output_contract_failure' END AS reasons FROM part""")
def x20_render_reasons(spark, d):
    k = F.col("p_size") % 4
    asked = F.when(k == 3, "so it ends").otherwise("How many are left?")
    q = F.when(k == 0, "A shop sells boxes. How many are left?").when(k == 1, "A shop sells boxes .. How many?").when(k == 2, "A shop sells. A shop sells. How many are left?").otherwise("so it ends")
    parts = F.when(k == 3, F.array(F.lit(" "))).when(k == 2, F.array(F.lit("A shop sells."), F.lit("a  shop sells."))).otherwise(F.array(F.lit("A shop sells boxes."), F.lit("How many are left?")))
    words = F.regexp_extract_all(F.lower(q), F.lit("([a-z0-9]+)"), F.lit(1))
    p = t(spark, d, "part").withColumn("w", words)
    return p.select("p_partkey", F.array_join(U.render_reasons(q, asked, parts, k != 3, F.col("w")), ",").alias("reasons"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'placeholder_occurrence_mismatch,invented_numeric_literal' WHEN 2 THEN 'placeholder_set_mismatch,template_placeholder_set_mismatch,placeholder_occurrence_mismatch' ELSE 'calculation_content_forbidden,unlicensed_pronoun' END AS reasons,
 CASE p_size % 4 WHEN 2 THEN NULL WHEN 1 THEN 'Ann has ' || p_size || ' and ' || p_size || ' of 3. How many?' WHEN 3 THEN 'Ann has ' || p_size || ' so it equals how many?' ELSE 'Ann has ' || p_size || ' boxes. How many?' END AS filled FROM part""")
def x22_templates(spark, d):
    """Templates validated, then filled."""
    k = F.col("p_size") % 4
    text = F.when(k == 0, "<NAME> has <QUANTITY_A> boxes. How many?").when(k == 1, "<NAME> has <QUANTITY_A> and <QUANTITY_A> of 3. How many?").when(k == 2, "<NAME> has <OTHER> boxes. How many?").otherwise("<NAME> has <QUANTITY_A> so it equals how many?")
    inventory = F.when(k == 2, F.array(F.lit("<NAME>"), F.lit("<OTHER>"))).otherwise(F.array(F.lit("<NAME>"), F.lit("<QUANTITY_A>")))
    slot = lambda n: F.struct(F.lit(n).alias("token"), F.lit(1).alias("times"))
    values = F.array(F.struct(F.lit("<NAME>").alias("token"), F.lit("Ann").alias("surface")), F.struct(F.lit("<QUANTITY_A>").alias("token"), F.col("p_size").cast("string").alias("surface")))
    return t(spark, d, "part").select("p_partkey", F.array_join(U.template_reasons(text, inventory, F.array(slot("<NAME>"), slot("<QUANTITY_A>"))), ",").alias("reasons"), U.filled_template(text, values).alias("filled"))


@query("""SELECT l_orderkey AS plan, concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'incompatible_object_or_unit_combination' END, CASE WHEN count(*) > count(DISTINCT l_linenumber) THEN 'duplicate_quantity_symbol' END, CASE WHEN bool_or(l_linenumber = 7) THEN 'operation_references_missing_quantity' END, CASE WHEN bool_or(l_linenumber <> 7 AND l_quantity < 3) THEN 'unsupported_object_verb' END,
 CASE WHEN bool_or(l_linenumber <> 7 AND l_tax > 0.07) THEN 'transfer_endpoint_is_missing' END, CASE WHEN bool_or(l_linenumber NOT IN (3, 7) AND l_tax <= 0.07 AND l_discount > 0.09) THEN 'transfer_endpoints_are_identical' END) AS reasons
FROM (SELECT * FROM lineitem WHERE l_linenumber <> 3) GROUP BY 1""")
def x21_ledgers(spark, d):
    """Lines of an order as operations on its typed quantities; the seventh names a
    quantity that is not there."""
    li = t(spark, d, "lineitem").filter("l_linenumber <> 3").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("string").alias("symbol"), "l_returnflag", "l_quantity", "l_tax", "l_discount", "l_linenumber")
    quantities = li.select("plan", F.when(F.col("l_linenumber") == 7, "other").otherwise(F.col("symbol")).alias("symbol"), F.col("l_returnflag").alias("kind"), F.lit(True).alias("transferable"), F.array(F.lit("move")).alias("verbs"))
    operations = li.select("plan", "symbol", F.when(F.col("l_quantity") < 3, "eat").otherwise("move").alias("verb"), F.lit(True).alias("transfer"), F.when(F.col("l_tax") <= 0.07, "a").alias("origin"), F.when(F.col("l_discount") > 0.09, "a").otherwise("b").alias("destination"))
    return U.ledger_reasons(operations, quantities, "plan").withColumn("reasons", F.array_join("reasons", ","))


@query(r"""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'literal_final_answer_line' WHEN 1 THEN 'direct_conclusion_statement' ELSE 'standalone_decorated_value' END AS rule, o_custkey::VARCHAR AS raw,
 CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'canonical_only,loose_conclusion_rule,negative_intent_without_negative_value' ELSE 'canonical_only' END AS suspicions FROM orders""")
def x24_extraction_trace(spark, d):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Final answer: "), c)).when(k == 1, F.concat(F.lit("So the loss is "), c)).otherwise(F.concat(F.lit("We get\n**"), c, F.lit("**")))
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), said.alias("said"), c.alias("value")).withColumn("trace", U.extraction_trace(F.col("said"), F.col("value")))
    return s.select("id", "trace.rule", "trace.raw", F.array_join(U.suspicions(F.col("trace"), F.col("value"), strict_answer(F.col("said"))["error"].isNull(), F.lit(20)), ",").alias("suspicions"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN '1 box' ELSE p_size || ' boxes' END AS noun, CASE WHEN regexp_matches(p_name, '(?i)^[aeiou]') THEN 'an' ELSE 'a' END AS article, CASE WHEN p_size = 1 THEN 'has' ELSE 'have' END AS verb,
 p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM part""")
def p26_morphology(spark, d):
    n, s = F.col("p_size"), F.col("p_size").cast("string")
    return t(spark, d, "part").select("p_partkey", F.concat(s, F.lit(" "), U.noun_form(F.lit("box"), F.lit("boxes"), F.lit(False), n)).alias("noun"), U.indefinite_article(F.col("p_name")).alias("article"),
                                      U.verb_form(F.lit("have"), F.lit("has"), F.lit("had"), F.lit("had"), n, F.lit("present")).alias("verb"), U.ordinal_numeral(n).alias("place"))


@query(f"SELECT item_id, len({sql_tokens('text')})::INTEGER AS words FROM benchmark")
def p20_token_length(spark, d):
    from siltstone.functions.text import tokens

    return t(spark, d, "benchmark").select("item_id", F.size(tokens(F.col("text"))).alias("words"))
