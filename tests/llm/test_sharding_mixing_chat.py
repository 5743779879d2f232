import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import chat, mixing, sharding


def test_shards(spark):
    rows = [(i, "t" * (i % 50), f"s{i % 3 if i % 2 else 0}") for i in range(1003)] + [(None, None, None), (5, "t" * 5, "s2"), (5, "t" * 5, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sharding.interleave(df, 8).collect()
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    whole = Counter(r["source"] for r in out)
    for s in sizes:
        for name, n in Counter(r["source"] for r in out if r["shard"] == s).items():
            assert abs(n - whole[name] * sizes[s] / len(out)) <= 2
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(df.repartition(7), 8).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out}
    assert sharding.interleave(df.limit(0), 8).count() == 0
    assert sharding.interleave(df.limit(3), 8).count() == 3


def _plain_shards(rows, shards, seed="interleave"):
    """The same rule in plain Python: one list, sorted."""
    kept = []
    for i, t, source in rows:
        data = (t or "").encode()
        h = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
        kept.append((("=" + source) if source is not None else "", h, -2**63 if i is None else i, zlib.crc32(data), len(data) + 1, i))
    n, merged = Counter(k[0] for k in kept), []
    seen = Counter()
    for k in sorted(kept, key=lambda k: k[:5]):
        merged.append(((2 * seen[k[0]] + 1) / (2 * n[k[0]]), k[0], seen[k[0]], k))
        seen[k[0]] += 1
    out, slots = [], Counter()
    for place, (_, _, _, k) in enumerate(sorted(merged, key=lambda m: m[:3])):
        shard = place * shards // len(merged)
        out.append((k[5], k[4], k[3], "rows", shard, slots[shard], None))
        slots[shard] += 1
    return out


def test_shards_against_plain_python(spark, tmp_path):
    """The query, row by row, on the tables and on odd rows."""
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        if folder == str(tmp_path):
            rows = [(i, "é" * (i % 9), [None, "", "a", "b"][i % 4]) for i in range(90)] + [(None, None, "a"), (None, "x", "a"), (5, "y", "a"), (5, "y", "a"), (91, "l" * 400_000, "b")]
            spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as shard", "text as rank", "source as _h").write.parquet(f"{folder}/documents.parquet")
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
        got = sharding.op10_interleave(spark, folder).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(_plain_shards(rows, 8), key=repr)


def test_rake():
    keys = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.zeros(4, int)]
    w = mixing.rake(keys, np.array([10.0, 20, 30, 40]), [np.array([0.7, 0.3]), np.array([0.2, 0.8]), np.ones(1)])
    assert np.allclose(np.bincount(keys[0], w), [0.7, 0.3]) and np.allclose(np.bincount(keys[1], w), [0.2, 0.8])


def test_mix(spark):
    rows = [(i, "word " * (i % 40), "en" if i % 3 else "de", f"s{i % 4}") for i in range(2000)] + [(None, None, None, None), (3, "", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, targets={"lang": {"en": 0.5, "de": 0.5}})
    got = out.toPandas()
    assert len(got) == len(rows) and got.copies.max() <= 1 and (got.probability <= 1 + 1e-9).all()
    expected = got.assign(w=got.probability * got.mix_tokens).groupby("lang").w.sum()
    assert abs(expected["en"] / expected.sum() - 0.5) < 1e-6
    frames = mixing.calibrated(out.selectExpr("coalesce(source, '') source", "coalesce(lang, '') lang", "mix_topic topic", "mix_tokens tokens"), targets={"lang": {"en": 0.5, "de": 0.5}}, rounds=2, max_cells=0).toPandas()
    driver = mixing.calibrated(out.selectExpr("coalesce(source, '') source", "coalesce(lang, '') lang", "mix_topic topic", "mix_tokens tokens"), targets={"lang": {"en": 0.5, "de": 0.5}}, rounds=2).toPandas()
    both = frames.merge(driver, on=["source", "lang", "topic"])
    assert len(both) == len(driver) and np.allclose(both.probability_x, both.probability_y)
    assert mixing.sampled(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_driver_and_frames_agree(spark):
    """Below and above the number of cells raked on the driver."""
    import pytest

    cells = spark.createDataFrame([("a", "en", "short", 10), ("b", "en", "prose", 30), ("b", "de", "prose", 0)], "source string, lang string, topic string, tokens long")
    none = cells.withColumn("tokens", F.lit(0).cast("long"))
    for frame, params in ((cells, {"targets": {"topic": {"short": 0.5, "gone": 0.5}}, "budget": 40.0}), (cells, {"targets": {"lang": {"fr": 1.0}}}), (cells, {}), (cells, {"whole": True}), (none, {}), (none, {"whole": True})):
        one, two = ({tuple(r[:3]): r["probability"] for r in mixing.calibrated(frame, rounds=3, max_cells=m, **params).collect()} for m in (0, 1000))
        assert one == pytest.approx(two), params


def test_mixing_by_salted_join(spark, monkeypatch):
    """More cells than are broadcast; names that the operator uses inside."""
    rows = [(i, "word " * (1 + i % 40), "en" if i % 3 else "de", f"s{i % 4}", i, "x", 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell long, row string, probability double")
    few = sorted(map(tuple, mixing.sampled(df).collect()))
    whole = sorted(tuple(r) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(tuple, mixing.sampled(df).collect())) == few and sorted(tuple(r) for r in mixing.mix(df).collect()) == whole
    assert mixing.sampled(df).columns == df.columns and set(few) <= set(rows) and few
    long = spark.createDataFrame([(1, "w " * 300_000, "en", "a"), (2, "w", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["mix_tokens"] for r in mixing.mix(long).collect()} == {1: 300_000, 2: 1}


def test_kinds(spark):
    texts = {"": "short", "a b": "short", "x 1234": "figures", "a, b! c? d;": "marked", "a\nb": "listed", "word " * 200: "prose"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", mixing.topic_of(F.col("t"))).collect()} == texts


def test_mixing_stage_keeps_every_document(spark):
    import corpus_pipeline

    rows = [(i, "some words " * (5 + i % 9), "en" if i % 5 else "de", f"s{i % 3}") for i in range(600)]
    rows += [(900, "Licensed under one rare term", "es", "s18"), (901, "", "en", "s1"), (902, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in corpus_pipeline._mixed(spark, df, "").collect()} == {r[0] for r in rows}
    cells = df.selectExpr("coalesce(source, '') source", "coalesce(lang, '') lang", "'x' topic", "length(text) tokens").fillna(0)
    both = [mixing.calibrated(cells, rounds=2, whole=True, max_cells=m).toPandas() for m in (0, 1000)]
    both = both[0].merge(both[1], on=["source", "lang", "topic"])
    assert len(both) and np.allclose(both.probability_x, both.probability_y) and both.probability_x.min() == 1


def test_word_count(spark):
    texts = ["", " ", "a", " a b ", "\ta\n\nb\x0bc", "é\xa0b", None, "x " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    import re

    want = [len(re.findall("[^ \t\n\v\f\r]+", t or "")) for t in texts]
    assert [r[0] for r in df.orderBy("i").select(mixing.word_count(F.col("t"))).collect()] == want


def _render(turns, who):
    text, spans = "", []
    for _, role, said in turns:
        head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        text += head
        if role == who:
            spans.append((len(text), len(text) + len(said) + len(chat.END)))
        text += said + chat.END
    return text, spans


def test_rotation(spark):
    rows = [(1, k, ["user", "assistant", "ann"][k % 3], f"é turn {k}") for k in range(30)] + [(2, 0, "system", "only")]
    rows += [(None, 0, "a", "x"), (None, 1, "b", None), (3, 5, None, "who"), (3, None, "user", "last"), (3, 5, "user", "tie"), (3, 5, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part in (4, 256):
        out = chat.rotate(df, part).collect()
        assert {r["perspective"] for r in out if r["conv_id"] == 1} == {"user", "assistant", "ann"} and not [r for r in out if r["conv_id"] == 2]
        for conv, who in {(r["conv_id"], r["perspective"]) for r in out}:
            parts = sorted((r for r in out if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["part"])
            turns = [(t, r, x) for t, _, r, x in sorted(((2**62 if t is None else t, hashlib.sha256(f"{r or 'unknown'}:{x or ''}".encode()).hexdigest(), r or "unknown", x or "") for c, t, r, x in rows if c == conv))]
            text, spans = _render(turns, who)
            assert "".join(p["text"] for p in parts) == text
            assert [tuple(m) for p in parts for m in p["mask"]] == spans
            assert [p["start"] for p in parts] == [sum(len(q["text"]) for q in parts[:k]) for k in range(len(parts))]
            assert all(p["n_turns"] == part for p in parts[:-1])
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_of_odd_tables(spark):
    """Names used inside, a very long text, and many turns of one number."""
    rows = [(1, None, "u" if k % 2 else "v", f"text {k}", "x", k) for k in range(700)] + [(2, 0, "u", "l" * 300_000, "y", 1), (2, 1, "w", "s", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string, part long")
    out = chat.rotate(df).collect()
    assert sorted(r["n_turns"] for r in out if r["conv_id"] == 1) == [188, 188, 256, 256, 256, 256]
    one = "".join(r["text"] for r in sorted((r for r in out if r["conv_id"] == 1 and r["perspective"] == "u"), key=lambda r: r["part"]))
    assert one.count(chat.END) == 700 and one.count("<|assistant|>") == 350
    assert {len(r["text"]) for r in out if r["conv_id"] == 2} == {300_000 + 1 + 14 + 2 * len(chat.END) + len("<|user name=w|>\n"), 300_000 + 1 + 14 + 2 * len(chat.END) + len("<|user name=u|>\n")}
