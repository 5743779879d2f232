import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return B.Encoder(B.Vocabulary(ranks), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library(both):
    ours, theirs = both
    random.seed(3)
    texts = ["", "a" * 3000, " " * 300 + "x", "aaa bbb\n\n  cc", "日本語🎉", "<|endoftext|>x", "it's we'LL 12 ½", "".join(random.choice("abcdehtinors") for _ in range(20000))]
    texts += ["".join(random.choice("abcde \n'éß中09.,!#") for _ in range(random.randint(1, 60))) for _ in range(500)]
    got = ours.encode(texts)
    assert got == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.vocabulary.decode(g) for g in got] == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    ours, theirs = both
    assert ours.encode([text]) == [theirs.encode_ordinary(text)]


def test_lesser_rank_after_a_merge():
    """'ab' merges late, but 'abc' has a lesser rank than its own parts."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 310, b"cd": 305, b"abcd": 320}
    ours, theirs = B.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "abab", "abcabcd", "aabcbcd", "bcdabcd"):
        assert ours.encode_all([text.encode()]) == [theirs.encode_ordinary(text)]


def test_queue_order():
    q, rng = B.RankQueue(), random.Random(1)
    items = [(rng.randrange(64**3), i) for i in range(2000)]
    for rank, i in items:
        q.push(rank, i)
    out = []
    while (got := q.pop())[0] >= 0:
        out += [(got[0], i) for i in got[1]]
    assert out == sorted(items)


def test_frames(spark):
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, "hello world", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.encode(df, PATH, P.PATTERN)
    assert sorted(map(len, (r["ids"] for r in out.collect()))) == [0, 0, 0, 2]
    back = {r["text"]: bytes(r["decoded"]) for r in B.decode(out, PATH).collect()}
    assert back == {None: b"", "": b"", "hello world": b"hello world"}
    digest = B.encode(df, PATH, P.PATTERN, digests=True).filter("text = 'hello world'").first()
    assert digest["n_tokens"] == 2 and digest["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert B.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_worker_gives_back_what_it_holds(spark):
    """The pipeline's other stages run in the workers that encoded before."""
    import pyarrow as pa

    from siltstone.llm import common, minmax

    coder = B.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    coder.encode(["some words to hold"])
    assert B.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN) is coder
    batch = pa.RecordBatch.from_pydict({"text": ["a b"]})
    assert list(common.tidy_batches(lambda batches: batches)([batch])) == [batch] and not B._encoders
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in minmax.one_of_each(docs).collect()) == [1, 3]
    small = B.Vocabulary({bytes([i]): i for i in range(256)})
    old, B.PAIRS = B.PAIRS, 10
    try:
        assert [small.merged(a, 1) for a in range(50)] == [-1] * 50 and len(small._pairs) <= 10
    finally:
        B.PAIRS = old


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60))
def test_narrow_texts_are_split_alike(text):
    import regex

    assert B.splitter(P.PATTERN)(text) == regex.compile(P.PATTERN).findall(text)


def test_every_narrow_character():
    import regex

    split, whole = B.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    for c in map(chr, range(0x260)):
        for text in (c, f"a{c}1", f" {c}{c}", f"{c} {c} ", f"'{c}", f"x\n{c}\n"):
            assert split(text) == whole(text)
    assert B.splitter(r"\d+")("a12 3") == ["12", "3"]
    assert B.splitter(r"\S+")("a\x1cb \xa0c") == regex.compile(r"\S+").findall("a\x1cb \xa0c")


def test_a_first_fill_of_the_queue():
    import numpy as np

    q = B.RankQueue()
    q.fill(np.array([7, -1, 5, 7, 90_000, 5], np.int32))
    assert [q.pop() for _ in range(4)] == [(5, [2, 5]), (7, [0, 3]), (90_000, [4]), (-1, [])]
