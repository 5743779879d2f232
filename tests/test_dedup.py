"""Similarity joins, greedy dedup and the seeded sample against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from siltstone.operators import dedup as D
from siltstone.operators import sampling as S
from siltstone.operators import stats


def test_similar_pairs(spark):
    random.seed(2)
    sets = {i: {str(random.randint(0, 30)) for _ in range(random.randint(0, 12))} for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, grams array<string>")
    for threshold in (0.2, 0.35, 0.85):
        got = {(r[0], r[1]) for r in D.similar_pairs(df, df, threshold, ordered=True).collect()}
        assert got == {(a, b) for a in sets for b in sets if b < a and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    other = df.filter("id < 20")
    got = {(r[0], r[1]) for r in D.similar_pairs(other, df.filter("id >= 20"), 0.3).collect()}
    assert got == {(a, b) for a in range(20) for b in range(20, 60) if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}


def test_greedy_two_keys(spark):
    random.seed(1)
    rows = [(i, random.randint(0, 9), random.randint(0, 9)) for i in range(40)]
    seen_a, seen_b, want = set(), set(), {}
    for i, a, b in sorted(rows, key=lambda r: (hashlib.sha256(f"s:{r[0]}".encode()).hexdigest(), r[0])):
        want[i] = a not in seen_a and b not in seen_b
        if want[i]:
            seen_a.add(a)
            seen_b.add(b)
    df = spark.createDataFrame(rows, "id long, a int, b int")
    assert {r[0]: r[1] for r in D.greedy_two_keys(df, "id", S.seeded_rank("s", F.col("id")), "a", "b").collect()} == want


def test_largest_remainder_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "stratum string, weight long")
    assert {r["stratum"]: r["quota"] for r in S.largest_remainder(df, 2).collect()} == {"a": 1, "b": 1, "c": 0}


def test_zero_cases(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0), (1, 2.0)], "arm int, v double")
    assert stats.standardized_difference(df, "v", "arm", 0, 1).first()[0] == float("inf")
    assert df.select(stats.wilson_lower(F.lit(0), F.lit(0))).first()[0] == 0.0
    assert df.limit(0).agg(stats.rate(F.count_if(F.lit(True)), F.count(F.lit(1)))).first()[0] is None


def test_bootstrap_against_the_reference_rule(spark):
    from siltstone.plans import registry

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["a16_bootstrap"](spark, sf).first()
    keys = [r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").orderBy("o_orderkey").collect()]
    values = [int(k % 5 < 2) - int(k % 3 == 0) for k in keys]
    rng, n = random.Random(20260720), len(values)
    few = 60  # of the generator's order; the query's 10,000 take the same steps
    got = stats.paired_bootstrap(spark.createDataFrame([(k, v) for k, v in zip(keys, values)], "id long, difference int"), "difference", 20260720, few).first()
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(few))

    def point(p):
        at = p * (len(means) - 1)
        low = int(at)
        return means[low] * (1.0 - (at - low)) + means[low + 1] * (at - low)

    assert (got["n"], got["low"], got["high"]) == (n, point(0.025), point(0.975))
    # a count of 1,000 draws, more than a block holds for all replicates
    many = spark.range(1000).select("id", (F.col("id") % 3 - 1).cast("int").alias("d"))
    rng = random.Random(5)
    few = sorted(sum(rng.randrange(1000) % 3 - 1 for _ in range(1000)) / 1000 for _ in range(3001))
    out = stats.paired_bootstrap(many, "d", 5, 3001).first()
    assert (out["low"], out["high"]) == (few[75], few[2925])


def test_containment_of_short_texts(spark, tmp_path):
    from siltstone.plans import registry

    docs = [(1, "One two three, four."), (2, "so one two"), (3, None), (4, "a zq7000 b zq9 c")]
    items = [(i, f"zq{i}") for i in range(12_000)] + [(20_000, "two three, fo"), (20_001, "e t"), (20_002, "a zq7000 b"), (20_003, None), (20_004, "b zq9 c d")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["j5_containment"](spark, str(tmp_path)).collect())
    assert got == sorted((d, i) for d, x in docs for i, b in items if x and b and b in x)


def test_holders_in_blocks(spark):
    docs = [(i, f"text {i} of many") for i in range(40)] + [(50, None), (51, "")]
    items = [(i, f"{i} of") for i in range(0, 40, 7)] + [(90, ""), (91, None), (92, "nowhere"), (93, "xt 1")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i) for d, x in docs for i, y in items if x is not None and y is not None and y in x)
    for size in (64, 1 << 20):
        assert sorted(map(tuple, D.holders(a, b, size).collect())) == want


def test_nearest_in_blocks(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)] + [(70, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    want = {i: min((-sum(x * y for x, y in zip(v, w)), j) for j, w in rows if w and j != i) for i, v in rows if v and i % 5 == 0}
    for block in (7, 8192):
        got = {r["id"]: (-r["similarity"], r["partner"]) for r in D.nearest(df.filter("id % 5 = 0"), df, block).collect()}
        assert got == want


def test_sequential_screen(spark):
    links = [(2, 1), (3, 2), (4, 3), (5, 1), (6, 5), (6, 4)]
    got = {r[0]: r[1] for r in D.sequential_screen(spark.range(1, 8).select("id"), spark.createDataFrame(links, "left long, right long")).collect()}
    accepted = []
    for i in range(1, 8):
        if not any((i, j) in links for j in accepted):
            accepted.append(i)
    assert {i for i, ok in got.items() if ok} == set(accepted) and len(got) == 7


def test_bootstrap_by_counts(spark):
    many = spark.range(3000).select("id", (F.col("id") % 3 - 1).cast("int").alias("d"))
    one, two = (stats.paired_bootstrap(many, "d", 5, 4000, ordered=o).first() for o in (True, False))
    assert one["mean"] == two["mean"] == 0 and abs(one["low"] - two["low"]) < 0.004 and abs(one["high"] - two["high"]) < 0.004
    assert stats.paired_bootstrap(many.limit(0), "d", 5, 10).count() == 0


def test_bootstrap_of_many_items_keeps_the_generators_order(spark):
    """More items than were once refused, and replicates over several blocks."""
    n = 2_100_000
    many = spark.range(n).select("id", (F.col("id") % 3 - 1).cast("int").alias("d"))
    got = stats.paired_bootstrap(many, "d", 5, 2).first()
    rng = random.Random(5)
    low, high = sorted(sum(rng.randrange(n) % 3 - 1 for _ in range(n)) / n for _ in range(2))
    assert got["n"] == n and (got["low"], got["high"]) == (stats.linear_percentile([low, high], 0.025), stats.linear_percentile([low, high], 0.975))
