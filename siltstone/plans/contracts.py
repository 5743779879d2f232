"""Joins with contracts, proofs and policies over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import contracts as C
from siltstone.operators import sampling as S
from siltstone.plans.base import query, t


def _arm(spark, d, column, name):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(column).alias(name))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS left_correct, o_orderkey % 3 = 0 AS right_correct FROM orders")
def j1_equal_key_join(spark, d):
    return C.aligned_join({"left": _arm(spark, d, "o_orderkey % 2 = 0", "correct"), "right": _arm(spark, d, "o_orderkey % 3 = 0", "correct")}, "id")


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS base_correct, o_orderkey % 3 = 0 AS generic_correct, o_orderkey % 5 < 2 AS targeted_correct FROM orders")
def j2_three_way_join(spark, d):
    return C.aligned_join({n: _arm(spark, d, e, "correct") for n, e in (("base", "o_orderkey % 2 = 0"), ("generic", "o_orderkey % 3 = 0"), ("targeted", "o_orderkey % 5 < 2"))}, "id")


@query("""SELECT c_custkey::VARCHAR AS key, 'missing in orders' AS fault FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey::VARCHAR, 'repeated in orders' FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'missing in customers' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def j1_key_faults(spark, d):
    return C.key_faults({"customers": t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "orders": t(spark, d, "orders").select(F.col("o_custkey").alias("k"))}, "k")


@query("SELECT p_partkey, p_brand, b AS prefix FROM part JOIN (SELECT DISTINCT left(p_brand, 7) AS b FROM part WHERE p_size > 40) ON starts_with(p_brand, b)")
def j11_prefix_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    prefixes = p.filter("p_size > 40").select(F.substring("p_brand", 1, 7).alias("prefix")).distinct()
    return C.prefix_join(prefixes, "prefix", p.drop("p_size"), "p_brand")


@query("""SELECT a.c_custkey AS "left", b.c_custkey AS "right", a.c_mktsegment = b.c_mktsegment AS same_c_mktsegment, a.c_custkey % 5 = b.c_custkey % 5 AS same_rest
FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey % 7 = 1 AND b.c_custkey % 7 = 2""")
def j13_equality_flags(spark, d):
    """Failures of two arms (two sevenths of the customers), in blocks of a nation."""
    c = t(spark, d, "customer").withColumn("rest", F.col("c_custkey") % 5)
    return C.equality_flags(c.filter("c_custkey % 7 = 1"), c.filter("c_custkey % 7 = 2"), ["c_nationkey"], ["c_mktsegment", "rest"], "c_custkey")


@query("""SELECT a.l_orderkey AS position, a.l_suppkey AS prompt, a.l_quantity AS left_q, b.l_quantity AS right_q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1""")
def j14_positional_join(spark, d):
    side = lambda k: t(spark, d, "lineitem").filter(f"l_linenumber % 2 = {k}").select(F.col("l_orderkey").alias("position"), F.col("l_suppkey").alias("prompt"), F.col("l_quantity").alias("q"))
    return C.positional_join(side(0), side(1), "position", "prompt")


@query("""SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'status' END, CASE WHEN o_orderkey % 4 = 0 THEN 'price' END) AS changed FROM orders""")
def j16_changed_fields(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    after = o.select("id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 4 == 0, -1.0).otherwise(F.col("price")).alias("price"))
    return C.changed_fields(o, after, "id", ["status", "price"]).withColumn("changed", F.array_join("changed", ","))


_MANIFEST = "m AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('manifest:' || doc_id::VARCHAR)) AS position FROM documents WHERE doc_id % 4 <> 0)"


def _manifest(spark, d):
    m = t(spark, d, "documents").filter("doc_id % 4 <> 0").select("doc_id")
    # the rank's hash is unique, so places need no tie
    from siltstone.operators.ranks import ordinal

    return ordinal(m.withColumn("_h", S.seeded_rank("manifest", F.col("doc_id"))), [], ["_h"], "position").select("doc_id", (F.col("position") + 1).alias("position"))


@query(f"WITH {_MANIFEST} SELECT doc_id, lang, position FROM documents JOIN m USING (doc_id)")
def j17_manifest_join(spark, d):
    return C.listed(t(spark, d, "documents").select("doc_id", "lang"), _manifest(spark, d), "doc_id")


@query(f"WITH {_MANIFEST} SELECT doc_id, position FROM m WHERE position <= 50")
def l6_limit_prefix(spark, d):
    """The first 50 entries of a manifest: the limit is the feature."""
    return C.first_listed(_manifest(spark, d), 50)


@query("SELECT doc_id FROM documents ORDER BY sha256('replay:' || doc_id::VARCHAR), doc_id LIMIT 80")
def l4_replay_sample(spark, d):
    return S.lowest(t(spark, d, "documents").select("doc_id"), "doc_id", "replay", 80)


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) = count(*) AS doc_id_unique, count(DISTINCT source) = count(*) AS source_unique FROM documents")
def f9_uniqueness(spark, d):
    return C.uniqueness(t(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0")
def f1_base_failures(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    return C.failures(o, F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 11 == 0, "timeout"))


@query("SELECT doc_id, quality FROM labels WHERE quality = 1")
def f8_accepted(spark, d):
    return t(spark, d, "labels").filter("quality = 1").select("doc_id", "quality")


_PAIR = "p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS j, 0.7 + l_tax * 3 AS s, l_quantity = 1 AS e, l_quantity = 2 AS n, l_quantity = 3 AS st, l_linenumber % 2 = 0 AS fr, l_linenumber % 3 = 0 AS sg FROM lineitem)"


def _pairs(spark, d):
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 5).alias("j"), (0.7 + F.col("l_tax") * 3).alias("s"), (q == 1).alias("e"), (q == 2).alias("n"), (q == 3).alias("st"), (k % 2 == 0).alias("fr"), (k % 3 == 0).alias("sg"))


@query(f"""WITH {_PAIR} SELECT l_orderkey, l_linenumber, CASE WHEN e THEN 'exact_normalized_text' WHEN n THEN 'numeric_template_copy' WHEN st THEN 'latent_structure_copy' WHEN j >= 0.45 THEN 'token_ngram_overlap' WHEN s >= 0.82 THEN 'semantic_similarity' WHEN s >= 0.75 THEN 'semantic_similarity_band' ELSE 'all_checks_passed' END AS legacy,
 CASE WHEN e THEN 'exact_normalized_text' WHEN n THEN 'numeric_template_copy' WHEN st THEN 'latent_structure_copy' WHEN j >= 0.45 THEN 'token_ngram_overlap' WHEN s >= 0.82 AND (j >= 0.22 OR sg) THEN 'supported_semantic_duplicate' WHEN s >= 0.75 AND (j >= 0.12 OR sg OR (fr AND s >= 0.8)) THEN 'supported_semantic_review' ELSE 'all_checks_passed' END AS gated FROM p""")
def f6_diversity_policy(spark, d):
    evidence = [F.col(c) for c in ("j", "s", "e", "n", "st", "fr", "sg")]
    legacy = {"ngram_reject": 0.45, "reject": 0.82, "review": 0.75}
    gated = legacy | {"evidence": {"reject_ngram": 0.22, "review_ngram": 0.12, "frame_review": 0.8}}
    return _pairs(spark, d).select("l_orderkey", "l_linenumber", C.pair_policy(*evidence, legacy)["reason"].alias("legacy"), C.pair_policy(*evidence, gated)["reason"].alias("gated"))


_USE = "u AS (SELECT p_partkey, p_size % 10 = 0 AS e, p_size % 10 = 1 AS l, p_size % 10 = 2 AS n, p_size AS pu, p_size % 7 AS nu, p_size % 3 = 0 AS cp, p_size % 2 = 0 AS sp FROM part)"


@query(f"""WITH {_USE} SELECT p_partkey, CASE WHEN e THEN 'exact_complete_candidate' WHEN l THEN 'latent_program_copy' WHEN n THEN 'legacy_number_neutral_one_use' WHEN pu > 40 THEN 'sentence_plan_cap_exceeded' WHEN nu > 5 THEN 'number_neutral_cap_exceeded'
 WHEN cp AND NOT sp THEN 'cross_plan_close_paraphrase' ELSE 'bounded_distinct_example' END AS reason FROM u""")
def f7_reuse_policy(spark, d):
    k = F.col("p_size")
    out = C.reuse_policy(k % 10 == 0, k % 10 == 1, k % 10 == 2, k, F.lit(40), k % 7, F.lit(5), k % 3 == 0, k % 2 == 0, one_use=True)
    return t(spark, d, "part").select("p_partkey", out["reason"].alias("reason"))


@query(f"""WITH {_USE}, x AS (SELECT *, NOT (e OR l OR n OR cp) AS due, NOT (e OR l OR n OR pu > 40 OR nu > 5 OR (cp AND NOT sp)) AS strict, NOT (e OR l OR (cp AND NOT sp)) AS lax FROM u)
SELECT 'strict' AS policy, count(*) FILTER (strict = due) AS exact, count(*) FILTER (strict AND NOT due) AS escapes, count(*) FILTER (due AND NOT strict) AS false_rejections FROM x
UNION ALL SELECT 'lax', count(*) FILTER (lax = due), count(*) FILTER (lax AND NOT due), count(*) FILTER (due AND NOT lax) FROM x""")
def a25_policy_calibration(spark, d):
    """Fixtures by policies: agreements, escapes and false rejections."""
    k = F.col("p_size")
    signs = [k % 10 == 0, k % 10 == 1, k % 10 == 2, k, F.lit(40), k % 7, F.lit(5), k % 3 == 0, k % 2 == 0]
    passes = lambda **how: C.reuse_policy(*signs, **how)["outcome"] == "pass"
    due = ~((k % 10).isin(0, 1, 2) | (k % 3 == 0))
    return C.calibration(t(spark, d, "part").select(due.alias("due"), passes(one_use=True).alias("strict"), passes(capped=False).alias("lax")), "due", ["strict", "lax"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'invalid_or_ambiguous' WHEN v > 0 AND g = 0 THEN 'unexpected_zero_gradient' WHEN v = 0 AND g = 0 AND x = 0 THEN 'expected_zero_advantage_noop' WHEN v > 0 AND r = 0 AND x = 0 THEN 'expected_zero_lr_warmup_noop'
 WHEN r > 0 AND g > 0 AND x = 0 THEN 'unexpected_positive_lr_no_update' WHEN r > 0 AND g > 0 AND x > 0 THEN 'nonzero_policy_update' ELSE 'invalid_or_ambiguous' END AS outcome
FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS v, CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END AS g, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS r, CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS x FROM lineitem)""")
def f10_update_outcome(spark, d):
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    v, g, r, x = on(F.col("l_discount") > 0.05), on(F.col("l_tax") > 0.02), on(F.col("l_quantity") > 10), on(F.col("l_tax") > 0.05)
    out = C.update_outcome(v, F.array(v, -v), F.array(r), F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(g), g.cast("int"), x, x.cast("int"), F.lit(True))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", out.alias("outcome"))


@query("""WITH g AS (SELECT o_custkey % 50 AS g, o_custkey % 50 % 3 <> 0 AS approved FROM orders GROUP BY ALL)
SELECT o_orderpriority AS priority, count(*) AS attempted, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected FROM orders JOIN g ON g.g = o_custkey % 50 GROUP BY 1""")
def a32_group_decisions(spark, d):
    """A decision for each group, fanned out to its members, then counted."""
    o = t(spark, d, "orders").select("o_orderpriority", (F.col("o_custkey") % 50).alias("g"))
    decisions = o.select("g").distinct().withColumn("approved", F.col("g") % 3 != 0)
    j = o.join(decisions, "g")
    return j.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected"))


@query("""SELECT source, count(*) AS reviewed, count(*) FILTER (quality = 1) AS approved, bool_and(l.doc_id IS NOT NULL) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source""")
def j15_review_join(spark, d):
    """Decisions joined to what was reviewed, both sides with the same ids."""
    reviewed = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    j = C.aligned_join({"doc": reviewed, "review": t(spark, d, "labels").select("doc_id", "quality")}, "doc_id")
    return j.groupBy(F.col("doc_source").alias("source")).agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("review_quality") == 1).alias("approved"), F.bool_and(F.col("review_quality").isNotNull()).alias("complete"))


@query("""SELECT 3 * count(*) FILTER (k IN (0, 1)) AS strict_or_canonical, count(*) FILTER (k = 2) AS false_acceptances, count(*) FILTER (k = 3) AS ambiguous, round(count(*) FILTER (k IN (0, 1)) / count(*), 8) AS lower_accuracy, round(count(*) FILTER (k IN (0, 1, 3)) / count(*), 8) AS upper_accuracy,
 CASE WHEN count(*) FILTER (k IN (2, 3)) = 0 THEN 'trusted' WHEN count(*) FILTER (k = 3) = 0 THEN 'usable_with_adjustment' ELSE 'reconsider' END AS decision FROM (SELECT o_orderkey % 4 AS k FROM orders)""")
def a24_audit_bounds(spark, d):
    k = F.col("o_orderkey") % 4
    one = C.audit_bounds(t(spark, d, "orders").select(k.isin(0, 1).alias("intended"), (k == 2).alias("false"), (k == 3).alias("ambiguous")))
    return one.select((F.col("intended") * 3).alias("strict_or_canonical"), "false_acceptances", "ambiguous", F.round("lower_accuracy", 8).alias("lower_accuracy"), F.round("upper_accuracy", 8).alias("upper_accuracy"), "decision")


@query("""WITH s AS (SELECT o_custkey % 3 AS arm, o_orderpriority AS suite, year(o_orderdate) AS step, avg(o_totalprice) AS m FROM orders GROUP BY ALL),
e AS (SELECT arm, suite, arg_min(m, step) AS a, arg_max(m, step) AS z FROM s GROUP BY ALL), g AS (SELECT suite, step, max(m) - min(m) AS gap FROM s GROUP BY ALL)
SELECT e.suite, count(*) FILTER (z > a) AS risen, count(*) FILTER (z < a) AS fallen, round(max((SELECT max(gap) FROM g WHERE g.suite = e.suite)), 4) AS largest_gap FROM e GROUP BY e.suite""")
def a30_trajectories(spark, d):
    """First against last step of each arm, and the largest gap between arms."""
    o = t(spark, d, "orders").groupBy((F.col("o_custkey") % 3).alias("arm"), F.col("o_orderpriority").alias("suite"), F.year("o_orderdate").alias("step")).agg(F.avg("o_totalprice").alias("m"))
    return C.trajectories(o, "arm", "suite", "step", "m").withColumn("largest_gap", F.round("largest_gap", 4))


@query("""SELECT p_brand AS skill, count(*) AS occurrences, sum(l_quantity)::BIGINT AS tokens FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1""")
def a31_exposure(spark, d):
    """Occurrences and tokens of each skill in the replayed part of a schedule."""
    s = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    j = s.join(t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("skill")), "p_partkey")
    return j.groupBy("skill").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("l_quantity").cast("long").alias("tokens"))


@query("""WITH s AS (SELECT o_custkey % 2 AS arm, o_orderdate::DATE AS step, sum(o_orderkey % 97)::BIGINT AS tokens FROM orders GROUP BY ALL),
w AS (SELECT arm, step, sum(tokens) OVER (PARTITION BY arm ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS four, count(*) OVER (PARTITION BY arm ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM s)
SELECT min(abs(a.four - b.four))::BIGINT AS gap FROM w a JOIN w b ON a.arm = 0 AND b.arm = 1 AND a.n = 4 AND b.n = 4""")
def w10_closest_windows(spark, d):
    """The closest four-step token sums of two arms: sums are sorted together, so
    the closest pair is neighbours, without a join of all pairs."""
    s = t(spark, d, "orders").groupBy((F.col("o_custkey") % 2).alias("arm"), F.to_date("o_orderdate").alias("step")).agg(F.sum(F.col("o_orderkey") % 97).alias("tokens"))
    w = Window.partitionBy("arm").orderBy("step").rowsBetween(0, 3)
    four = s.select("arm", F.sum("tokens").over(w).alias("four"), F.count(F.lit(1)).over(w).alias("n")).filter("n = 4").select("arm", "four").distinct()
    return C.closest_across(four, "arm", "four")
