import random

from pyspark.sql import functions as F

from siltstone.operators import stats
from siltstone.operators.ranks import ordinal


def test_ordinal(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(6)
    for group in (["g"], []):
        seen = {}
        for r in ordinal(df, group, ["o", "i"], "n").collect():
            seen.setdefault(r["g"] if group else 0, []).append(((r["o"] is not None, r["o"] or 0, r["i"]), r["n"]))
        for got in seen.values():
            assert [n for _, n in sorted(got)] == list(range(len(got)))
    assert ordinal(df.limit(0), ["g"], ["o"], "n").count() == 0


def test_tree_digest(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(stats, "FAN", 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(i % 9 or None, f"t{i}") for i in range(40)]
    got = stats.tree_digest(spark.createDataFrame(rows, "o int, v string").repartition(5), "o", F.col("v")).first()[0]
    level = [h for _, _, h in sorted((o is not None, o or 0, sha(v)) for o, v in rows)]
    while len(level) > 1:
        level = [sha("".join(level[k:k + 3])) for k in range(0, len(level), 3)]
    assert got == level[0]
    assert stats.tree_digest(spark.createDataFrame([], "o int, v string"), "o", F.col("v")).first()[0] == sha("")
