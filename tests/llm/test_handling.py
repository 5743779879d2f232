"""Odd rows through every operator and stage: nulls in any column, empty and very
long texts, ties and repeated rows, empty tables, and columns that carry the names
which the operators use inside."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from siltstone.llm import byte_bpe, fingerprints, minmax, mixing, progressive_jpeg, sharding, simple8b, substring_dedup, toxicity
from siltstone.llm.common import fresh_path

LONG = " ".join(f"word{i % 7000}" for i in range(60_000))
ROWS = [(1, "a small text", "en", "s", 12), (1, "a small text", "en", "s", 12), (2, None, None, None, None), (None, "no id here", "de", "t", 10), (3, "", "en", "s", 0), (4, LONG, "fr", "t", len(LONG)), (5, "é中 \t\x0b x", None, "s", 7), (1, "another of id one", "en", None, 17)]
BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["block", "rows", "_ref", "_comp", "ids", "row", "cell", "salt", "copies", "probability", "toxicity", "fingerprint", "bucket", "ord", "shard", "rank", "_n", "_h", "_b", "removed_words", "part", "e", "draw"]


def frame(spark, rows=ROWS):
    wide = [(*r, *[f"{c}{k}" for c in CLASH]) for k, r in enumerate(rows)]
    return spark.createDataFrame(wide, BASE + "".join(f", {c} string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    frame(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 1, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    frame(spark).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


QUERIES = {"op1": substring_dedup.op1_relative_lz, "op2": byte_bpe.op2_rank_queue, "op3": mixing.op3_rake, "op5": simple8b.op5_simple8b, "op6": toxicity.op6_grammar, "op7": progressive_jpeg.op7_progressive, "op8": fingerprints.op8_one_permutation, "op9": minmax.op9_min_max, "op10": sharding.op10_interleave}


@pytest.mark.parametrize("name", QUERIES)
def test_queries_on_odd_rows(spark, odd, none, name):
    out = QUERIES[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert QUERIES[name](spark, none).count() == 0
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "op1":
        long = by[4][0]
        assert long["n_words"] == 60_000 and long["n_removed"] == 60_000 and by[2][0]["n_words"] == 0 and by[2][0]["kept_sha256"] == _sha("")
    if name == "op2":
        coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
        for k, text in ((2, ""), (3, ""), (4, LONG), (5, ROWS[6][1])):
            ids = coder.encode_ordinary(text)
            assert by[k][0]["n_tokens"] == len(ids) and by[k][0]["ids_sha256"] == _sha(" ".join(map(str, ids))) and by[k][0]["decoded_sha256"] == _sha(text)
    if name == "op3":
        assert by[4][0]["n_tokens"] == 60_000 and by[2][0]["n_tokens"] == 0
    if name == "op5":
        assert by[2][0]["n_tokens"] == 1 and by[None][0]["start"] == 0 and by[4][0]["n_tokens"] > 60_000
    if name == "op6":
        assert all(0 <= r["score"] <= 1 for r in out) and by[2][0]["score"] == by[3][0]["score"]
    if name == "op7":
        assert by[2][0]["payload_bytes"] == 192 and by[4][0]["n_bytes"] == len(LONG) and by[1][0]["payload_bytes"] == 192
        assert by[4][0]["payload_sha256"] == _sha(LONG.ljust(-(-len(LONG) // 192) * 192))
    if name == "op8":
        assert by[2][0]["fingerprint"] == by[3][0]["fingerprint"] == "" and by[4][0]["n_chars"] == len(LONG)
    if name == "op9":
        assert by[4][0]["n_shingles"] == 7000 and by[2][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2


@pytest.mark.parametrize("step", range(5))
def test_stages_on_odd_rows(spark, odd, none, step):
    name, stage = corpus_pipeline.STAGES[step]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = stage(spark, docs, odd)
    got = out.collect()
    kept = {r["doc_id"] for r in got}
    if step < 4:
        assert out.columns == docs.columns
        # extra columns stay with their rows
        own = {r["block"]: r["rows"] for r in docs.collect()}
        assert all(own[r["block"]] == r["rows"] for r in got)
    else:
        assert out.columns == [*[c for c in docs.columns if c != "ids"], "ids"]
    assert {2, 3, 5, None} <= kept and (step == 2 or 4 in kept)
    empty = spark.read.parquet(f"{none}/documents.parquet")
    assert stage(spark, empty, none).count() == 0


def test_files_round_trip_of_odd_rows(spark, odd):
    folder = fresh_path(spark, "odd")
    files = simple8b.write(spark.read.parquet(f"{odd}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), None)
    out = simple8b.read(spark, folder, files).collect()
    assert len(out) == len(ROWS) and sum(r["n_tokens"] for r in out) == sum(f[2] for f in files)


def test_fingerprint_keeps_columns(spark):
    out = fingerprints.fingerprint(frame(spark))
    assert set(out.columns) == set(frame(spark).columns) and out.filter("fingerprint = ''").count() == 2
