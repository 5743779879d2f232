"""Text forms against plain Python, on rows that separate their definitions."""

import random
import re

from pyspark.sql import functions as F

from siltstone.functions import text as X

TEXTS = ["", "One two", "é12 and 12", "1,234.5 or 3/4 and -7", "１２ full width", "Straße ẞ", "a b c d e", "a a b", "x y x y", "He said 'no' to 3.5", None]


def _words(t, mask=False):
    import unicodedata

    low = unicodedata.normalize("NFKC", t).lower()
    if mask:
        low = re.sub(X.NUMBER, " <num> ", low, flags=re.ASCII)
    return re.findall("[a-z0-9]+|<num>", low)


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    w = df.select("i", X.tokens(F.col("t")).alias("w"), X.tokens(F.col("t"), mask=True).alias("m"))
    rows = w.select("i", "w", "m", X.ngrams(F.col("w"), 5).alias("g"), X.windows(F.col("w"), 3).alias("v"), X.selection_ngrams(F.col("w")).alias("s")).collect()
    for r in rows:
        t = TEXTS[r["i"]]
        if t is None:
            assert r["w"] is None
            continue
        words = _words(t)
        assert r["w"] == words and r["m"] == _words(t, True)
        grams = {" ".join(words[k:k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())
        assert set(r["g"]) == grams
        assert set(r["v"]) == {" ".join(words[k:k + 3]) for k in range(len(words) - 2)}
        assert set(r["s"]) == (grams or {""})


def _repeats(w):
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return any(a == b for a, b in zip(w, w[1:])) or len(w) >= 9 and any(tri.count(x) >= 3 for x in tri)


def _phrase(w):
    return any(w[i:i + k] == w[i + k:i + 2 * k] for k in range(2, 6) for i in range(len(w) - 2 * k + 1))


def test_repetition(spark):
    random.seed(4)
    lists = [[random.choice("abc") for _ in range(random.randint(0, 14))] for _ in range(200)] + [list("abcdefgh")]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    for r in df.select("i", X.repeats(F.col("w")).alias("a"), X.repeated_phrase(F.col("w")).alias("b")).collect():
        assert r["a"] == _repeats(lists[r["i"]]) and r["b"] == _phrase(lists[r["i"]])


def test_folding(spark):
    df = spark.createDataFrame([("Straße  ẞ\t x",)], "t string")
    assert df.select(X.folded_form(F.col("t"))).first()[0] == "strasse ss x"
    assert df.select(X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 1.0


def test_departures_found_before(spark):
    """Rows on which earlier forms of these functions were wrong."""
    one = spark.createDataFrame([(list("abababa"), list("abcde"), list("abcdefghi"), "https://a.com/p/123/x/", "`q` it's 'a\nb' 5% v2.5 -3")], "r array<string>, s array<string>, q array<string>, u string, t string")
    none = F.array().cast("array<string>")
    got = one.select(X.repeats(F.col("r")), X.prefix_echo(F.col("s"), F.col("q")), X.word_overlap(none, none), X.url_fingerprint(F.col("u")), X.signature_form(F.col("t"))).first()
    assert tuple(got)[:4] == (False, False, 0.0, "a com p <num> x")
    assert got[4] == "<quoted> it<quoted>a b' <number> v2.5 <number>"


def test_casefold_by_batches(spark):
    df = spark.createDataFrame([("ABC",), (None,), ("ẞ É",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.casefold(F.col("t"))).collect()] == ["abc", None, "ss é"]


def test_blank_questions_are_errors(spark):
    import pytest

    df = spark.createDataFrame([(" \n",)], "t string")
    with pytest.raises(Exception, match="hold text"):
        df.select(X.messages(F.col("t"), "s")).collect()
