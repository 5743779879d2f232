import random

from siltstone.llm import minmax as M
from siltstone.llm.components import components


def _set(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = {i: _set(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rows():
    random.seed(7)
    base = [f"w{random.randint(0, 500)}" for _ in range(60)]
    out = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "two words"), (5, "two words two")]
    for i in range(10, 90):  # graded edits: chains of links
        w = list(base)
        for _ in range(random.randint(0, 12)):
            w[random.randrange(60)] = f"x{random.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    return out + [(100 + i, "exact copy of a text with words") for i in range(30)]


def test_components_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(4)
    for k in (2, 5):
        got = {r[0]: (r[1], r[2]) for r in M.near_components(df, words=k).select("doc_id", "n_shingles", "component_id").collect()}
        assert got == brute(rows(), k)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "GRID", 8)
    monkeypatch.setattr(M, "STAR", 5)
    monkeypatch.setattr(M, "BYTES", 2000)
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in M.near_components(df, words=2).collect()} == {i: c for i, (_, c) in brute(rows(), 2).items()}


def test_one_of_each(spark):
    data = [(i, t, i, "x") for i, t in rows()] + [(None, "exact copy of a text with words", 1, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, _ref long, _comp string")
    kept = M.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(rows(), 5).values()})
    assert M.near_components(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    data = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:40_001])), (4, "x " * 200_000), (5, "X\nx x"), (6, None), (7, " ".join(words))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_components(df, words=2).collect()}
    assert got == {1: (59_999, 1), 2: (49_999, 1), 3: (40_000, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (59_999, 1)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)]
    out = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)}


def test_components_of_long_shuffled_paths(spark):
    """More nodes in any order than a fixed number of rounds reaches."""
    order = random.Random(3).sample(range(1500), 1500)
    links = list(zip(order, order[1:])) + [(2000, 2001)]
    out = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1500)} | {2000: 2000, 2001: 2000}


def test_steps_leave_no_shuffle_files(spark, tmp_path):
    """With many steps and partitions they would add up on disk."""
    from siltstone.llm.common import checkpointed, shared_dir

    shared_dir(spark)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = (lambda: tracker.shuffleStatuses().size()), spark.conf.get(key)
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    gc_free = held()
    out = checkpointed(links.groupBy("a").count())
    assert held() <= gc_free and out.count() == 300 and spark.conf.get(key) == before
    gc_free = held()
    found = components(links)
    # but for the counts that end a round
    assert held() <= gc_free + 8
    assert {r[1] for r in found.collect()} == {0}
