"""Samples, partitions, quotas and set proofs over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import sampling as S
from siltstone.plans.base import query, t

_RANK = "sha256('{}:' || {}::VARCHAR)"


def _rank(seed, key):
    return _RANK.format(seed, key)


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_rank('holdout', 'doc_id')}, doc_id) <= 100 THEN 'sealed' ELSE 'development' END AS partition FROM documents""")
def l1_partition(spark, d):
    return S.partition(t(spark, d, "documents").select("doc_id"), "doc_id", "holdout", 100)


@query(f"""SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' ORDER BY {_rank('failures', 'o_orderkey')}, o_orderkey LIMIT 100""")
def l2_failure_sample(spark, d):
    """A seeded sample of 100 wrong but extractable answers."""
    return S.lowest(t(spark, d, "orders").filter("o_orderkey % 7 <> 0 and o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", "failures", 100)


@query(f"""SELECT doc_id, sha256('subset:' || doc_id::VARCHAR || ':' || source) AS h FROM documents ORDER BY h, doc_id LIMIT 200""")
def l3_composite_top_k(spark, d):
    h = F.sha2(F.concat_ws(":", F.lit("subset"), F.col("doc_id").cast("string"), "source"), 256)
    return t(spark, d, "documents").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(200)


@query(f"""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_rank('section', 'doc_id')}, doc_id) AS p FROM documents) WHERE p <= 3""")
def l5_section_quota(spark, d):
    return S.per_stratum(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "section", ["lang", "source"], F.lit(3))


_QUOTA = """q AS (SELECT {k} AS stratum, count(*) AS w FROM {t} GROUP BY 1),
f AS (SELECT stratum, w * {n} // (SELECT sum(w) FROM q)::BIGINT AS q, w * {n} % (SELECT sum(w) FROM q)::BIGINT AS m FROM q),
z AS (SELECT stratum, (q + CASE WHEN row_number() OVER (ORDER BY m DESC, stratum) <= {n} - (SELECT sum(q) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f)"""


@query("WITH " + _QUOTA.format(k="c_mktsegment || ':' || c_nationkey::VARCHAR", t="customer", n=500) + " SELECT stratum, quota FROM z")
def w6_largest_remainder(spark, d):
    c = t(spark, d, "customer").groupBy(F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("stratum")).agg(F.count(F.lit(1)).alias("weight"))
    return S.largest_remainder(c, 500).select("stratum", "quota")


@query("WITH " + _QUOTA.format(k="lang || ':' || source", t="documents", n=100).replace("m DESC, stratum", "m DESC, sha256(stratum)") + f"""
SELECT doc_id, lang || ':' || source AS stratum, CASE WHEN row_number() OVER (PARTITION BY lang || ':' || source ORDER BY {_rank('split', 'doc_id')}, doc_id) <= quota THEN 'validation' ELSE 'train' END AS split
FROM documents JOIN z ON z.stratum = lang || ':' || source""")
def w7_stratified_split(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.concat_ws(":", "lang", "source").alias("stratum"))
    return S.stratified_split(docs, "doc_id", "split", "stratum", 100)


_ROBIN = f"""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_rank('robin', 'o_orderkey')}, o_orderkey) AS turn,
  {_rank('robin', 'o_orderpriority')} AS stratum_rank FROM orders"""


@query(_ROBIN)
def w4_round_robin(spark, d):
    return S.round_robin(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "robin", "o_orderpriority")


@query(f"SELECT o_orderkey, CASE WHEN (row_number() OVER (ORDER BY turn, stratum_rank) - 1) % 2 = 0 THEN 'first' ELSE 'second' END AS role FROM ({_ROBIN})")
def w5_roles(spark, d):
    """Roles alternate over the round-robin order."""
    return S.roles(w4_round_robin(spark, d)).select("o_orderkey", "role")


@query("""SELECT lang AS label, copy::INTEGER AS copy, sha256('spread:' || lang || ':' || copy::VARCHAR) AS rank FROM (SELECT lang, unnest(range(1, count(*) + 1)) AS copy FROM documents GROUP BY lang)""")
def w8_spread_labels(spark, d):
    c = t(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return S.spread_labels(c, "spread")


@query("""SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, greatest(count(*) OVER (PARTITION BY p_brand) // 4, 1) AS step FROM part) WHERE p % step = 0 AND p // step < 4""")
def w9_systematic(spark, d):
    """Four parts of each brand at equal steps."""
    return S.every_kth(t(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], 4)


@query("""WITH q AS (SELECT o_orderpriority AS family, count(*) // 100 + 1 AS quota, row_number() OVER (ORDER BY o_orderpriority) AS o FROM orders GROUP BY 1),
s AS (SELECT family, quota, o, unnest(range(1, quota + 1)) AS k FROM q)
SELECT family, k::INTEGER AS k, row_number() OVER (ORDER BY (k - 1) / quota, o)::INTEGER AS position FROM s""")
def w14_proportional_slots(spark, d):
    q = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg((F.expr("count(1) div 100") + 1).alias("quota"))
    return S.proportional_slots(q.withColumn("family_order", F.row_number().over(Window.orderBy("family"))))


@query("""SELECT c_custkey AS id, 'a' AS pool FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 3 <> 0""")
def u1_union_pools(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.filter("id % 3 = 0").withColumn("pool", F.lit("a")).unionByName(c.filter("id % 3 <> 0").withColumn("pool", F.lit("b")))


@query("""SELECT lang, count(*) FILTER (doc_id % 2 = 0) > 0 AND count(*) FILTER (doc_id % 2 = 1) > 0 AS in_both FROM documents GROUP BY lang""")
def u2_intersection(spark, d):
    docs = t(spark, d, "documents")
    both = docs.filter("doc_id % 2 = 0").select("lang").intersect(docs.filter("doc_id % 2 = 1").select("lang")).withColumn("in_both", F.lit(True))
    return docs.select("lang").distinct().join(both, "lang", "left").select("lang", F.coalesce("in_both", F.lit(False)).alias("in_both"))


@query(f"""SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM documents ORDER BY {_rank('holdout', 'doc_id')}, doc_id LIMIT 100)""")
def u3_complement(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    return docs.exceptAll(S.lowest(docs, "doc_id", "holdout", 100))


@query(f"""WITH s AS (SELECT doc_id FROM documents ORDER BY {_rank('holdout', 'doc_id')}, doc_id LIMIT 100), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)),
x AS (SELECT (SELECT count(*) FROM s JOIN r USING (doc_id)) AS overlap, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) AND doc_id NOT IN (SELECT doc_id FROM r)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM s UNION SELECT doc_id FROM r) WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS "foreign")
SELECT overlap, missing, "foreign", overlap = 0 AND missing = 0 AND "foreign" = 0 AS is_partition FROM x""")
def u4_partition_proof(spark, d):
    p = l1_partition(spark, d)
    return S.disjoint_and_whole(p.filter("partition = 'sealed'"), p.filter("partition = 'development'"), t(spark, d, "documents"), "doc_id")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'first_only' WHEN a.k IS NULL THEN 'second_only' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def u5_only_in_one(spark, d):
    o = t(spark, d, "orders")
    a, b = (o.filter(f"o_orderkey % 2 = {k}").select("o_custkey").distinct().withColumn(n, F.lit(1)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "o_custkey", "full_outer").select(F.col("o_custkey").alias("custkey"), F.when(F.col("b").isNull(), "first_only").when(F.col("a").isNull(), "second_only").otherwise("shared").alias("side"))


@query("""SELECT arm, step, id, row_number() OVER (PARTITION BY arm, id ORDER BY step)::INTEGER AS nth, tokens,
  sum(tokens) OVER (PARTITION BY arm ORDER BY step)::BIGINT AS prefix_tokens, sum(tokens) OVER (PARTITION BY arm ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)::BIGINT AS next_four
FROM (SELECT o_custkey AS arm, o_orderkey AS step, o_orderpriority AS id, o_orderkey % 97 AS tokens FROM orders)""")
def w11_schedule_totals(spark, d):
    """Occurrence numbers, running totals and four-step sums of each arm's
    schedule."""
    s = t(spark, d, "orders").select(F.col("o_custkey").alias("arm"), F.col("o_orderkey").alias("step"), F.col("o_orderpriority").alias("id"), (F.col("o_orderkey") % 97).alias("tokens"))
    w = Window.partitionBy("arm").orderBy("step")
    return s.select("arm", "step", "id", F.row_number().over(Window.partitionBy("arm", "id").orderBy("step")).alias("nth"), "tokens", F.sum("tokens").over(w).alias("prefix_tokens"), F.sum("tokens").over(w.rowsBetween(0, 3)).alias("next_four"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 50 <> 0) AS overlap, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0) AS missing, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 = 0) AS "foreign", false AS is_partition""")
def u4_no_partition(spark, d):
    """Two sides that overlap, miss rows, and hold some that the whole does not."""
    o = t(spark, d, "orders").select("o_orderkey")
    a, b = o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 2 = 0 and o_orderkey % 50 <> 0")
    return S.disjoint_and_whole(a, b, o.filter("o_orderkey % 50 <> 0"), "o_orderkey")
