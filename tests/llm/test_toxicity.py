import random

from siltstone.llm import toxicity as X


def test_grammar_paths():
    m = X.Model({"idiot": 4.0, "vequ*": 3.0})
    plain = m.matches("the idiot went home")[0]
    assert plain == 4.0
    assert m.matches("you are an idiot")[0] > plain > m.matches("he is not an idiot. ok")[0]
    assert m.matches("x said 'idiot' there")[0] < plain
    assert m.matches("vequabc here")[0] == 3.0 and m.matches("avequabc")[0] == 0.0
    assert m.matches("someone will kill time")[0] < m.matches("i will find you and kill")[0]
    assert m.matches("")[0] == 0.0 and m.matches("nothing here")[0] == 0.0


def test_composition_equals_cascade():
    import itertools

    parts = (X._negation(), X._reported(), X._target())
    for word in itertools.product("ihtnrqo", repeat=4):
        states, weight = [0, 0, 0], 1.0
        for s in word:
            for k, p in enumerate(parts):
                states[k], s, w = p.step(states[k], s)
                weight *= w
        state, total = 0, 1.0
        for s in word:
            state, _, w = X.GRAMMAR.step(state, s)
            total *= w
        assert abs(total - weight) < 1e-12


def test_learns_and_holds_out(spark):
    # texts differ, as near copies would be collapsed before words are counted
    rng, docs, labels = random.Random(2), [], []
    for i in range(600):
        bad = i % 6 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(12)]
        docs.append((i, " ".join(words) + (" zorgle you zorgle" if bad else " dolor sit")))
        labels.append((i, int(bad)))
    docs += [(9000, None), (9001, ""), (None, "zorgle")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = X.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r["toxicity"] for r in X.score(d, m).collect()}
    assert all((out[i] >= X.THRESHOLD) == bool(b) for i, b in labels)
    assert out[9000] == out[9001] < 0.5 < out[None]
    empty = X.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= empty.probability(0) < 0.5


def test_held_out_accuracy(spark):
    """Some labelled rows hold no word that others share, so not all are found."""
    sf = "/root/testdata/sf0.1"
    lang = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "lang")
    out = X.op6_grammar(spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").join(lang, "doc_id").filter("held_out").toPandas()
    found = out[out.toxic == 1].groupby("lang").predicted.mean()
    assert out[out.toxic == 1].predicted.mean() >= 0.9
    assert found["en"] >= 0.88 and found["de"] >= 0.85 and found["fr"] >= 0.85 and found["es"] >= 0.75, found
    assert out[out.toxic == 0].predicted.mean() < 0.005


def test_likelihood_ratio_and_bounds():
    assert abs(X.likelihood_ratio(7, 1, 0.116) - 24.3) < 0.5 and X.likelihood_ratio(1, 9, 0.1) < 1e-9
    counts = [("rare", 3, 0), ("good", 9, 0), ("mixed", 9, 9)]
    assert set(X.choose_terms(counts, 100, 900, 15.0)) == {"good"}
    assert X.choose_terms(counts, 0, 900) == {}
