"""The pipeline's stages against plain Python on a small fixture."""

import hashlib
import random
import re
import string
from collections import Counter

import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from siltstone.llm import toxicity

CLEAN = 40


def _fixture(spark, folder):
    random.seed(11)
    text = lambda n: " ".join(f"w{random.randint(0, 4000)}" for _ in range(n))
    passage = text(60)
    docs = [(i, text(120)) for i in range(CLEAN)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(110 + i, docs[i][1] + " more") for i in range(5)]
    docs += [(120, text(80) + " " + passage + " " + text(40)), (121, passage + " " + text(90))]
    docs += [(130 + i, text(50) + " you idiot moron scum " + text(50)) for i in range(3)] + [(140, None), (141, "")]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(CLEAN)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return passage, {i: t for i, t in docs}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    passage, texts = _fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [set(v) for v in kept.values()]
    # the built-in words reject at their prior weight only with labels' help;
    # a clean document is never rejected
    assert set(range(CLEAN)) <= ids[0]
    # one of each group of copies, by five words
    assert not ids[1] & {100 + i for i in range(5)} and not ids[1] & {110 + i for i in range(5)}
    assert set(range(CLEAN)) <= ids[1]
    after = kept["substring dedup"]
    assert passage not in after[120] and passage not in after[121]
    assert all(after[i] == texts[i] for i in range(CLEAN))
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert all(len(r["ids"]) for r in docs.collect() if r["text"])


WORD = re.compile("[^ \t\n\v\f\r]+")


def _labelled_fixture(spark, folder):
    """Clean, toxic, copied and passage-sharing documents, some labelled."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randint(0, 6000)}" for _ in range(n))
    passage = text(60)
    docs = [(i, text(rng.randint(90, 200))) for i in range(120)]
    docs += [(200 + i, text(60) + " you zorgle zorgle moron " + text(60)) for i in range(60)]
    docs += [(300 + i, docs[i][1]) for i in range(12)] + [(320 + i, docs[i][1] + " tail") for i in range(12)]
    docs += [(340 + i, text(50) + " " + passage + " " + text(50)) for i in range(6)]
    docs += [(400, None), (401, ""), (402, "short 12345 67890")]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 1) for i in range(50)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {200 + i for i in range(60)}


def _near_kept(rows):
    """The least id of every group of documents linked by five-word shingles."""
    sets = {}
    for i, t in rows.items():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return {i for i in sets if label[i] == i}


def _without_repeats(rows, span=35):
    words = {i: WORD.findall(t or "") for i, t in rows.items()}
    seen = Counter(tuple(w[k:k + span]) for w in words.values() for k in range(len(w) - span + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - span + 1) if seen[tuple(w[k:k + span])] > 1 for j in range(k, k + span)}
        if len(gone) < len(w) or not w:
            out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def _kind(t):
    n = len(t)
    if sum(c in "0123456789" for c in t) * 10 > n:
        return "figures"
    if sum(c in string.punctuation for c in t) * 8 > n:
        return "marked"
    return "listed" if t.count("\n") * 80 > n else "prose" if n >= 600 else "short"


def _copies(rows):
    """Copies of each document by raking in plain Python."""
    cell = {i: (s or "", lang or "", _kind(t or "")) for i, (t, lang, s) in rows.items()}
    size = {i: len(WORD.findall(t or "")) for i, (t, _, _) in rows.items()}
    tokens = Counter()
    for i in rows:
        tokens[cell[i]] += size[i]
    whole = sum(tokens.values())
    weight = {c: n / whole for c, n in tokens.items()}
    goals = []
    for k, axis in enumerate(("source", "lang", "topic")):
        total = Counter()
        for c, n in tokens.items():
            total[c[k]] += n
        power = {v: n ** corpus_pipeline.TEMPER[axis] if n else 0.0 for v, n in total.items()}
        goals.append({v: p / sum(power.values()) for v, p in power.items()})
    for _ in range(60):
        for k, goal in enumerate(goals):
            now = Counter()
            for c, w in weight.items():
                now[c[k]] += w
            weight = {c: w * goal[c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / n if n else 0.0 for c, n in tokens.items()}
    scale = min(1 / min(r for r in ratio.values() if r > 0), 2.0 * whole)
    out = {}
    for i in rows:
        p = max(1.0, ratio[cell[i]] * scale)
        draw = int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:13], 16) / 16**13
        out[i] = int(p) + (draw < p - int(p))
    return out


def test_stages_against_plain_python(spark, tmp_path):
    """Each stage on what its predecessor wrote, row by row."""
    folder = str(tmp_path)
    toxic = _labelled_fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        before = {r["doc_id"]: r["text"] for r in rows}
        stage(spark, docs, folder).write.parquet(f"{folder}/s{k}")
        docs = spark.read.parquet(f"{folder}/s{k}")
        after = docs.collect()
        now = {r["doc_id"]: r["text"] for r in after}
        if k == 0:
            model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(now) == {i for i, t in before.items() if model.probability(model.matches(t or "")[0]) < toxicity.THRESHOLD} == set(before) - toxic
        elif k == 1:
            assert set(now) == _near_kept(before) and len(before) - len(now) == 24
        elif k == 2:
            want = _without_repeats(before)
            assert {i: WORD.findall(t or "") for i, t in now.items()} == want and any(len(WORD.findall(before[i] or "")) > len(w) for i, w in want.items())
            assert all(now[i] == before[i] for i in now if len(want[i]) == len(WORD.findall(before[i] or "")))
        elif k == 3:
            want = _copies({r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in rows})
            assert Counter(r["doc_id"] for r in after) == want and max(want.values()) > 1
        else:
            coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert len(after) == len(rows) and all(r["ids"] == coder.encode_ordinary(r["text"] or "") for r in after)
    assert {r["doc_id"] for r in after} >= set(range(120)) | {400, 401, 402}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[-1] == "ids" and out.count() > 0 and toxicity.THRESHOLD == 0.7
