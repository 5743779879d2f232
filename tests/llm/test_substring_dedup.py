import hashlib
import random
import re
from collections import Counter

import pytest

from siltstone.llm import substring_dedup as S

WORD = re.compile("[^ \t\n\v\f\r]+")


def brute(rows, span):
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[i:i + span]) for w in words.values() for i in range(len(w) - span + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i:i + span])] > 1:
                gone[i:i + span] = [True] * span
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def rows():
    random.seed(5)
    passage = " ".join(f"w{i}" for i in range(60))
    out = [(0, None), (1, ""), (2, "a " * 40), (3, " ".join(random.choice("ab") for _ in range(300))), (4, "x" * 5000), (5, "\t a\n" * 36), (6, "é中 " * 50)]
    out += [(10, "pre " + passage + " post"), (11, passage + "\n"), (12, " ".join(passage.split()[5:41])), (13, " ".join(passage.split()[5:38])), (14, " ".join(passage.split()[:30] + passage.split()[:40]))]
    return out + [(20 + k, "same text of some length " * 9) for k in range(5)]


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    for span in (3, 10, 35):
        assert {r[0]: (r[1], r[2], r[3]) for r in S.digests(df, span).collect()} == brute(rows(), span)


def test_many_blocks(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(S.blocks_of, "__defaults__", (200,))
    assert {r[0]: (r[1], r[2], r[3]) for r in S.digests(df, 10).collect()} == brute(rows(), 10)


def test_text_columns_and_clashes(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows()], "doc_id long, text string, removed_words string, block long")
    out = {r["doc_id"]: r for r in S.dedup(df).collect()}
    want = brute(rows(), 35)
    for i, t in rows():
        assert out[i]["removed_words"] == want[i][1] and out[i]["block"] == i
        assert hashlib.sha256(" ".join(WORD.findall(out[i]["text"] or "")).encode()).hexdigest() == want[i][2]
        if not want[i][1]:
            assert out[i]["text"] == t


def test_empty_table(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _words_of_blocks(df):
    rows = df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return {r["block"]: [w for t in S.Block(r["rows"], 35).table.column("text").to_pylist() for w in WORD.findall(t or "")] for r in S.blocks_of(rows).collect()}


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_factors_lie_where_they_say(spark, monkeypatch, size):
    df = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(S.blocks_of, "__defaults__", (size,))
    text, found = {i: WORD.findall(t or "") for i, t in rows()}, S.spans(df).collect()
    blocks = _words_of_blocks(df)
    assert found and all(r["n_words"] >= 35 for r in found)
    for r in found:
        own = text[r["doc_id"]][r["first_word"]:r["first_word"] + r["n_words"]]
        assert own == blocks[r["ref_block"]][r["ref_word"]:r["ref_word"] + r["n_words"]]


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_factors_are_greedy(spark, monkeypatch, size):
    """A reference is followed past places where the index names another."""
    w = [f"w{i}" for i in range(100)]
    data = [(0, " ".join(w[:40])), (1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[20:80] + w[10:70]))]
    monkeypatch.setattr(S.blocks_of, "__defaults__", (size,))
    found = {}
    for r in S.spans(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect():
        found.setdefault(r["doc_id"], []).append((r["first_word"], r["n_words"]))
    assert found[2] == [(0, 100)] and found[0] == [(0, 40)]
    assert sorted(found[3]) == [(0, 60), (60, 60)]


def test_factors_of_a_long_run_of_changes(spark, monkeypatch):
    """More changes of group than a request names: another factor, no less removed."""
    monkeypatch.setattr(S, "LOOKAHEAD", 2)
    monkeypatch.setattr(S.blocks_of, "__defaults__", (100,))
    df = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(1)
    assert {r[0]: (r[1], r[2], r[3]) for r in S.digests(df, 10).collect()} == brute(rows(), 10)


def test_a_very_long_text(spark):
    data = [(0, " ".join(f"w{i % 5000}" for i in range(200_000))), (1, "a " * 100_000), (2, "b")]
    got = {r[0]: r for r in S.digests(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [(got[i]["n_words"], got[i]["n_removed"]) for i in range(3)] == [(200_000, 200_000), (100_000, 100_000), (1, 0)]
