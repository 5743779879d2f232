import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import simple8b as S
from siltstone.llm.common import fresh_path

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Forgets what it has seen again and again.
SMALL = S.WordTokenizer(PATH, memory=3000)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400))
def test_round_trip(values):
    ids = np.array(values, np.uint64)
    words, offsets = S.pack(ids)
    assert (S.unpack(words, offsets, len(ids)) == ids).all()


def test_blocks_and_escapes():
    rng = np.random.default_rng(1)
    for n in (4095, 4096, 4097, 20000):
        for top in (1, 2, 300, 50000, 2**63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            ids[50:200] = 0
            words, offsets = S.pack(ids)
            assert (S.unpack(words, offsets, n) == ids).all() and len(offsets) == -(-n // S.BLOCK)
    ids = np.array([2**64 - 1, 2**60, 2**60 - 1, 0, 5, 2**62] * 1000, np.uint64)
    assert (S.unpack(*S.pack(ids), len(ids)) == ids).all()


def _plain(values):
    """Words of one block: at each place the fullest selector that its ids fit."""
    words, at = [], 0
    while at < len(values):
        for s, (n, bits) in enumerate(S.SELECTORS, 1):
            own = values[at:at + n]
            if all(v < 1 << bits for v in own):
                words.append(s << 60 | sum(v << k * bits for k, v in enumerate(own)))
                break
        else:
            n = 1
            words += [0, values[at]]
        at += n
    return words


def test_words_as_in_plain_python():
    rng = np.random.default_rng(2)
    for n in (1, 119, 120, 121, 4000, S.BLOCK + 61, 2 * S.BLOCK):
        for most in (1, 16, 64):
            ids = rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False) >> rng.integers(64 - most, 64, n).astype(np.uint64)
            ids[n // 3:n // 2] = 0
            blocks = [_plain(ids[k:k + S.BLOCK].tolist()) for k in range(0, n, S.BLOCK)]
            words, offsets = S.pack(ids)
            assert words.tolist() == sum(blocks, []) and np.diff(np.append(offsets, len(words))).tolist() == [len(b) for b in blocks]


def test_same_as_library():
    texts = ["", "a\tb\r\nc", "<|endoftext|> x<|startoftext|>y", "é ́a", "ΑΣ ΣΑΣ", "a\xa0b c\x1cd", "İ don't I'LL 12 345 ½", "日本語 テスト", None, "x" * 3000]
    ids, sizes = S.WordTokenizer(PATH).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAhHsStT'.,<=|>!09 \t\n\x0b\x1c\x85\xa0éÉıİΣς\u0301\u0331\u0338日½²—\u0958"), max_size=25), max_size=6), st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "don't", "I'LL", "x.y"]), max_size=3))
def test_pieces_as_the_library(texts, more):
    texts = texts + ["".join(texts[:2]).join(more), *more]
    ids, sizes = SMALL.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_few_pieces_reach_the_library():
    """Words that differ by case or by signs around them are encoded once."""
    coder, seen = S.WordTokenizer(PATH), []
    library = coder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **how)

    coder.tokenizer = Counted()
    texts = [a + w + b for w in ("loose", "étain", "stone") for a in ("", "(") for b in ("", ".", "$$$", ",###")] + ["Loose Stone", "LOOSE."]
    ids, _ = coder.encode(pa.array(texts))
    assert ids.tolist() == [i for e in LIBRARY.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert len(seen) < 12 and coder.encode(pa.array(texts))[0].tolist() == ids.tolist() and len(seen) < 12


def test_files(spark):
    rows = [(5, "five"), (None, "none"), (1, None), (3, ""), (3, "three a"), (3, "three b"), (-7, "minus " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = fresh_path(spark, "test")
    files = S.write(df, folder, PATH, end_id=1)
    out = S.read(spark, folder, files).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, text) in zip(out, order):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        at += len(ids)
    crc = {r["start"]: r["ids_crc32"] for r in S.read(spark, folder, files, digest=True).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out}
    assert S.read(spark, folder, S.write(df.limit(0), folder + "x", PATH, 1)).count() == 0
