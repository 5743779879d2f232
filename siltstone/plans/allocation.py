"""Matching, packing, quotas and flows over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import allocation as A
from siltstone.plans.base import query, t

_COST = """CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 80 ELSE 0 END + abs(a.c_custkey % 97 - b.c_custkey % 97) * 2"""
_TIE = "('0x' || substr(sha256(a.c_custkey::VARCHAR || ':' || b.c_custkey::VARCHAR), 1, 4))::BIGINT"

#: Lots that a nation's customers are dealt to.
LOTS = 64


def _arms(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 97).alias("n"))
    return c.filter("c_custkey % 7 = 1").alias("a"), c.filter("c_custkey % 7 = 2").alias("b")


def _costs(spark, d):
    a, b = _arms(spark, d)
    # few nations: their lefts are dealt to lots, or a few tasks would make all pairs
    lot = F.pmod(F.xxhash64("c_custkey"), F.lit(LOTS)).cast("int")
    a = a.withColumn("lot", lot).repartition(4 * LOTS, "c_nationkey", "lot").alias("a")
    b = b.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))).repartition(4 * LOTS, "c_nationkey", "lot").alias("b")
    j = a.join(b.hint("merge"), (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.lot") == F.col("b.lot")))
    cost = A.matching_cost("a", "b", "c_custkey", {"c_mktsegment": 80}, {"n": 2})
    return j.select(F.col("a.c_nationkey").alias("nation"), F.col("a.c_custkey").alias("left"), F.col("b.c_custkey").alias("right"), cost.alias("cost"))


@query(f"""SELECT a.c_nationkey AS nation, a.c_custkey AS "left", b.c_custkey AS "right", (({_COST}) * 100000 + {_TIE})::BIGINT AS cost FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey % 7 = 1 AND b.c_custkey % 7 = 2""")
def c1_matching_cost(spark, d):
    return _costs(spark, d)


def _squares(spark, d, run, schema):
    """``run`` (nation, lefts, rights, costs) on as many lefts as rights of each
    nation, the first by key. A nation's customers move, not its pairs; each has a
    partition of its own, as it is work for minutes however few its bytes."""
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_mktsegment", (F.col("c_custkey") % 97).alias("n"), (F.col("c_custkey") % 7).alias("arm"))

    def group(pdf):
        import pandas as pd

        pdf = pdf.sort_values("c_custkey")
        arms = [pdf[pdf["arm"] == k] for k in (1, 2)]
        n = min(map(len, arms))
        left, right = (x.head(n).reset_index(drop=True) for x in arms)
        return run(pdf["nation"].iloc[0], left, right, A.cost_matrix(left, right, "c_custkey", {"c_mktsegment": 80}, {"n": 2})) if n else pd.DataFrame({k.split()[0]: [] for k in schema.split(", ")})

    return c.filter("arm in (1, 2) and c_nationkey is not null").repartition(256, "nation").groupBy("nation").applyInPandas(group, schema)


@query()
def c3_exact_matches(spark, d):
    """The tests hold the solver against all permutations."""
    def run(nation, left, right, costs):
        import pandas as pd

        to = A.assignment(costs)
        return pd.DataFrame({"nation": nation, "left": left["c_custkey"], "right": right["c_custkey"].to_numpy()[to], "cost": costs[np.arange(len(to)), to]})

    return _squares(spark, d, run, "nation int, left long, right long, cost long")


@query(f"""WITH m AS (SELECT c_custkey AS k, c_nationkey AS st, c_acctbal AS v, c_custkey % 3 AS arm FROM customer),
s AS (SELECT arm, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM m GROUP BY arm),
p AS (SELECT x.k AS "out", y.k AS "in", a.n, a.s - x.v + y.v AS s, a.q - x.v * x.v + y.v * y.v AS q, o.n AS m, o.s AS t, o.q AS r FROM m x JOIN m y ON x.arm = 0 AND y.arm = 2 AND x.st = y.st, (SELECT * FROM s WHERE arm = 0) a, (SELECT * FROM s WHERE arm = 1) o),
g AS (SELECT "out", "in", round(abs(s / n - t / m) / sqrt(((q - s * s / n) / (n - 1) + (r - t * t / m) / (m - 1)) / 2), 12) AS worst FROM p)
SELECT "out", "in", round(worst, 6) AS worst FROM g ORDER BY g.worst, "out", "in" LIMIT 1""")
def c5_best_swap(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal", (F.col("c_custkey") % 3).alias("arm"))
    arm = lambda n: c.filter(F.col("arm") == n)
    return A.best_swap(arm(0), arm(1), arm(2), "k", ["c_nationkey"], ["c_acctbal"]).select("out", "in", F.round("worst", 6).alias("worst"))


@query()
def c2_regret_selection(spark, d):
    """Targets of a nation choose among its pool under family quotas."""
    def run(nation, left, right, costs):
        import pandas as pd

        family = right["c_mktsegment"].to_numpy()
        names, counts = np.unique(family, return_counts=True)
        rank = lambda keys: [str(k).zfill(20) for k in keys]
        keys, choices = left["c_custkey"], right["c_custkey"]
        got = A.regret_selection(costs, family, dict(zip(names.tolist(), counts.tolist())), list(keys), rank(choices), rank(keys))
        return pd.DataFrame({"nation": nation, "turn": range(len(got)), "target": [keys[i] for i, _ in got], "choice": [choices[j] for _, j in got]})

    return _squares(spark, d, run, "nation int, turn int, target long, choice long")


@query("SELECT 100 AS size WHERE (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) >= 100 UNION ALL SELECT 0 WHERE (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) < 100")
def c4_largest_feasible(spark, d):
    """The largest size of which every segment has enough: 10,000,000 to 100."""
    least = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    size = A.largest_feasible([10_000_000, 5_000_000, 100], lambda n: least is not None and least >= n)
    return spark.createDataFrame([(size or 0,)], "size int")


def _entries(spark, d):
    """Vetted entries of an arm: the parts of a brand, by size as tokens."""
    return t(spark, d, "part").select(F.col("p_brand").alias("arm"), F.col("p_partkey").alias("record"), F.col("p_size").alias("tokens"))


@query("SELECT p_brand AS arm, 1000 AS tokens FROM part GROUP BY p_brand HAVING min(p_size) = 1")
def c6_exact_fill(spark, d):
    """Arms that reach 1,000 tokens exactly (with a part of size 1 all do)."""
    e = _entries(spark, d)
    ones = e.groupBy("arm").agg(F.min("tokens").alias("_m")).filter("_m = 1").select("arm")
    got = A.filled(e.join(ones, "arm"), "arm", "record", "tokens", 1000).join(e, ["arm", "record"])
    return got.groupBy("arm").agg(F.sum(F.col("copies") * F.col("tokens")).cast("int").alias("tokens"))


@query("SELECT p_brand AS arm, sum(p_size)::BIGINT AS tokens, count(*) AS entries, true AS balanced FROM part GROUP BY 1")
def c7_bins(spark, d):
    """16 bins of each arm; balanced: no bin is over the mean by a whole entry."""
    b = A.packed(_entries(spark, d), "arm", "record", "tokens", 16).groupBy("arm", "bin").agg(F.sum("tokens").alias("s"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("m"))
    return b.groupBy("arm").agg(F.sum("s").alias("tokens"), F.sum("n").alias("entries"), (F.max("s") <= F.sum("s") / 16 + F.max("m")).alias("balanced"))


@query("""WITH e AS (SELECT p_brand AS arm, p_size AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part), c AS (SELECT arm, r, sum(tokens) OVER (PARTITION BY arm ORDER BY r) AS cum FROM e),
n AS (SELECT arm, count(*) AS n, sum(tokens) AS whole FROM e GROUP BY arm), g AS (SELECT n.arm, k, (k // n) * whole + coalesce((SELECT cum FROM c WHERE c.arm = n.arm AND c.r = k % n), 0) AS tokens FROM n, (SELECT unnest(range(450, 1801)) AS k))
SELECT arm, arg_min(k, (abs(tokens - 20000), k))::INTEGER AS k, arg_min(tokens, (abs(tokens - 20000), k))::BIGINT AS tokens, min(abs(tokens - 20000))::BIGINT AS gap FROM g GROUP BY arm""")
def c8_occurrence_search(spark, d):
    """For each brand the number of occurrences, of 450 to 1800, whose tokens are
    closest to the budget when each part is used evenly and the cheapest more often."""
    e = _entries(spark, d)
    n = e.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("whole"), F.array_sort(F.collect_list("tokens")).alias("_t"))
    many = n.withColumn("k", F.explode(F.sequence(F.lit(450), F.lit(1800))))
    left = F.expr("k % n").cast("int")
    tokens = F.expr("k div n") * F.col("whole") + F.aggregate(F.slice("_t", F.lit(1), left), F.lit(0).cast("long"), lambda a, x: a + x)
    gap = F.abs(tokens - 20_000)
    return many.select("arm", "k", tokens.alias("tokens"), gap.alias("gap")).groupBy("arm").agg(F.min(F.struct("gap", "k", "tokens")).alias("b")).select("arm", "b.k", "b.tokens", "b.gap")


@query()
def c9_paired_subsets(spark, d):
    """Five of the 40 seeded parts of each of two brands whose token totals are
    closest (the prompts of an arm's family are few)."""
    rows = _entries(spark, d)
    ends = rows.agg(F.min("arm").alias("a"), F.max("arm").alias("z")).first()
    pick = lambda arm: [r[0] for r in rows.filter(F.col("arm") == arm).orderBy(F.sha2(F.concat_ws(":", F.lit("subset"), F.col("record").cast("string")), 256), "record").limit(40).select("tokens").collect()]
    one, two = (list(A.subset_totals(pick(a), 5)) for a in (ends["a"], ends["z"]))
    return spark.createDataFrame([A.closest_totals(one, two)] if one and two else [], "first int, second int")


@query("""WITH e AS (SELECT p_brand AS arm, p_partkey AS record, p_size AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
SELECT arm, (n % 4)::INTEGER AS segment, record, tokens, row_number() OVER (PARTITION BY arm, n % 4 ORDER BY record)::INTEGER AS position FROM e""")
def c10_schedule(spark, d):
    """Baseline segments of a schedule: every entry once, dealt to four segments."""
    from siltstone.operators.ranks import ordinal

    e = ordinal(_entries(spark, d), ["arm"], ["record"], "n")
    e = e.withColumn("segment", (F.col("n") % 4).cast("int"))
    return e.select("arm", "segment", "record", "tokens", (F.expr("n div 4") + 1).cast("int").alias("position"))


def _local(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) // 2 AS total, count(*) AS m, min(n) AS least FROM c)
SELECT lang, (CASE WHEN least * m >= total THEN total // m + CASE WHEN row_number() OVER (ORDER BY lang) <= total % m THEN 1 ELSE 0 END ELSE NULL END)::BIGINT AS share FROM c, t WHERE least * m >= total""")
def c11_water_fill(spark, d):
    """Half of all documents as evenly over the languages as they allow. SQL states
    the case in which no language is short; where one is, it gives no rows."""
    counts = {r["lang"]: r["n"] for r in t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    total, short = sum(counts.values()) // 2, min(counts.values(), default=0) * len(counts)
    got = A.water_fill(total, counts) if counts and short >= total else {}
    return _local(spark, list(got.items()), "lang string, share long")


@query()
def c12_bounded_split(spark, d):
    """Half of 60 attempts over languages, in proportion and within bounds."""
    n = {r["lang"]: r["n"] % 13 + 8 for r in t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    got = A.bounded_split(n, dict.fromkeys(n, 1), n, sum(n.values()) // 2) if n else {}
    return _local(spark, list(got.items()), "lang string, share int")


@query()
def c13_balanced_matrix(spark, d):
    """Languages by thirds, both margins kept, as near to proportion as integers are."""
    n = {r["lang"]: r["n"] % 13 + 8 for r in t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    thirds = A.balanced_counts(sum(n.values()), ["easy", "medium", "hard"])
    x = A.balanced_matrix(n, thirds) if n else np.zeros((0, 3), int)
    return _local(spark, [(a, b, int(x[i, j])) for i, a in enumerate(n) for j, b in enumerate(thirds)], "lang string, level string, n int")


@query("SELECT least(count(*) FILTER (c_custkey % 3 = 0), count(*) FILTER (c_custkey % 3 <> 0)) AS flow FROM customer")
def c14_maximum_flow(spark, d):
    """Customers of one kind served by those of another through the segments, each
    of which lets all pass: the flow is the smaller side."""
    kinds = t(spark, d, "customer").groupBy("c_mktsegment", (F.col("c_custkey") % 3 == 0).alias("from")).agg(F.count(F.lit(1)).alias("n")).collect()
    caps: dict = {}
    for segment, source, n in kinds:
        edge = ("source", segment) if source else ("hub", "sink")
        caps[edge] = caps.get(edge, 0) + n
        caps[segment, "hub"] = 1 << 60
    return _local(spark, [(A.maximum_flow(caps, "source", "sink"),)], "flow long")


@query("SELECT p_brand, n AS quota, i AS inventory, (n * 5 + i * 4 - 1) // (i * 4) AS plan, (n + i - 1) // i + 2 AS neutral, (n * 15 + 99) // 100 AS share FROM (SELECT p_brand, count(*) AS n, count(DISTINCT p_size) AS i FROM part GROUP BY 1)")
def c16_caps(spark, d):
    n = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("quota"), F.count_distinct("p_size").alias("inventory"))
    return n.withColumn("c", A.reuse_caps(F.col("quota"), F.col("inventory"))).select("p_brand", "quota", "inventory", "c.plan", "c.neutral", "c.share")


@query("SELECT p_brand, least(count(DISTINCT p_size) * count(DISTINCT p_type), count(DISTINCT p_name || p_type)) AS capacity FROM part GROUP BY 1")
def c17_capacity(spark, d):
    """Identities that a brand can reach: no more than forms times plans, and no
    more than are distinct."""
    n = t(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("a"), F.count_distinct("p_type").alias("b"), F.count_distinct(F.concat("p_name", "p_type")).alias("c"))
    return n.select("p_brand", F.least(F.col("a") * F.col("b"), F.col("c")).alias("capacity"))


@query("""SELECT c_mktsegment, slot::INTEGER AS slot, sha256('plan:' || c_mktsegment || ':' || slot::VARCHAR) AS rank FROM (SELECT c_mktsegment, unnest(range(1, count(*) // 10 + 2)) AS slot FROM customer GROUP BY 1)""")
def c18_attempt_plan(spark, d):
    n = t(spark, d, "customer").groupBy("c_mktsegment").agg((F.expr("count(1) div 10") + 1).alias("n"))
    return A.slots(n, "n", "plan", "c_mktsegment")


@query()
def w13_capped_fill(spark, d):
    """Cells of 30 a brand, and no type of parts more than 4 times in one."""
    p = t(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("cell"), F.lit(30).alias("target"), "p_type")
    return A.capped_fill(p, ["p_brand"], "p_partkey", "p_partkey", "cell", "target", {"p_type": 4})
