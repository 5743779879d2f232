"""Strict scoring of responses built from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.scoring import strict_score
from siltstone.plans.base import query, t


@query(r"""WITH r AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS reference, CASE o_orderkey % 8
  WHEN 0 THEN 'We add.' || chr(10) || 'Final answer: ' || o_custkey::VARCHAR
  WHEN 1 THEN 'Final answer: \boxed{' || o_custkey::VARCHAR || '.00}' || chr(10) || '  '
  WHEN 2 THEN 'Final answer: 1,' || lpad((o_custkey % 1000)::VARCHAR, 3, '0')
  WHEN 3 THEN 'Final answer: 1' || chr(10) || 'Final answer: ' || o_custkey::VARCHAR
  WHEN 4 THEN 'Final answer: ' || o_custkey::VARCHAR || chr(10) || 'so there'
  WHEN 5 THEN 'Final answer: ' || o_custkey::VARCHAR || '.5'
  WHEN 6 THEN ' ' ELSE 'Final answer:  +00' || o_custkey::VARCHAR END AS response FROM orders),
l AS (SELECT *, list_filter(list_transform(string_split(response, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM r),
m AS (SELECT *, len(list_filter(ls, lambda x: starts_with(x, 'Final answer:'))) AS n, ls[-1] AS z FROM l),
v AS (SELECT *, regexp_extract(z, '^Final answer:\s*(?:\\boxed\{\s*)?([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.0+)?)\s*\}?$', 1) AS num FROM m),
e AS (SELECT *, CASE WHEN len(ls) = 0 THEN 'empty' WHEN n <> 1 THEN 'marker_count' WHEN NOT starts_with(z, 'Final answer:') THEN 'not_last' WHEN num = '' THEN 'format' END AS error FROM v),
p AS (SELECT *, CASE WHEN error IS NULL THEN split_part(replace(num, ',', ''), '.', 1)::BIGINT::VARCHAR END AS predicted FROM e)
SELECT id, predicted, reference AS expected, coalesce(predicted = reference, false) AS correct, error FROM p""")
def x2_strict_score(spark, d):
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    said = (F.when(k == 0, F.concat(F.lit("We add.\nFinal answer: "), c)).when(k == 1, F.concat(F.lit("Final answer: \\boxed{"), c, F.lit(".00}\n  ")))
            .when(k == 2, F.concat(F.lit("Final answer: 1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))).when(k == 3, F.concat(F.lit("Final answer: 1\nFinal answer: "), c))
            .when(k == 4, F.concat(F.lit("Final answer: "), c, F.lit("\nso there"))).when(k == 5, F.concat(F.lit("Final answer: "), c, F.lit(".5"))).when(k == 6, " ").otherwise(F.concat(F.lit("Final answer:  +00"), c)))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), strict_score(said, c).alias("s")).select("id", "s.*")
