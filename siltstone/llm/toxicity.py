"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, quote,
other) through a lexicon; small transducers over these symbols -- scope of
negation, reported speech, target -- are composed into one table, which is run
over each clause that holds an insult or a threat. A clause's score is the
term's learned weight times the path's factors, so "you are a fool" counts more
than "fool", and "not a fool" or "they said 'fool'" less.

Insult terms (whole words and word beginnings) and their weights are learned
from labelled documents: log odds of document frequencies, kept where a
likelihood-ratio test and precision allow. How strong the test has to be is chosen
from LADDER on training folds: each fold is scored by the terms of the others, the
bound with the fewest wrong decisions is taken (of equals the strictest), and the
calibration is fitted on these scores, not on those of the rows that chose the
terms. Training uses at most ``bound`` labelled rows, chosen by a hash of the id;
terms are counted by the executors, and the sample's bound bounds them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Texts, Words, shared_dir, shingle_hashes, table, tidy_batches

#: Bound of the labelled rows used in training.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Likelihood ratios a term may need, strictest first, and what it needs of toxic
#: documents and of its documents' toxic share.
LADDER = (30.0, 20.0, 15.0, 12.0)
MIN_DOCS, MIN_PRECISION = 4, 0.8
FOLDS = 3
STEMS = range(3, 9)

#: Words that the grammar knows without labels, and the weight of insults and
#: threats among them.
PRIOR = 2.0
INSULTS = "idiot moron imbecile fool scum loser bastard dumbass vermin Idiot Trottel Abschaum connard abruti ordure idiota imbécil basura".lower().split()
THREATS = "kill hurt destroy murder beat stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he she they them him her we everyone people du ihr euch sie er wir tu vous toi ils elle nous tú usted ustedes ellos ella él".split()
NEGATIONS = "not never isn't aren't wasn't don't nicht kein keine nie jamais ni nunca tampoco".split()
REPORTS = "said says say called calls wrote writes quoted claimed sagte sagt nannte schrieb dit disait écrit dijo dice llamó escribió".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;:\n]+")
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Transducer:
    """States from 0; arcs[(state, symbol)] = (next state, symbol out, factor).
    Symbols without an arc pass unchanged and lead to ``rest[state]``."""

    arcs: dict
    rest: dict = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that feeds what ``first`` puts out to ``second``."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for s in symbols:
            a, mid, w = first.step(pair[0], s)
            b, out, v = second.step(pair[1], mid)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], s] = (number[a, b], out, w * v)
    return Transducer(arcs)


SYMBOLS = "ihtnrqo"  # insult, threat, target, negation, report, quote, other


def _negation(scope: int = 3, factor: float = 0.4) -> Transducer:
    arcs = {}
    for left in range(scope + 1):
        arcs[left, "n"] = (scope, "n", 1.0)
        for s in "ih":
            arcs[left, s] = (max(left - 1, 0), s, factor if left else 1.0)
    return Transducer(arcs, {k: k - 1 for k in range(1, scope + 1)})


def _reported(factor: float = 0.5) -> Transducer:
    """State 1: after a verb of saying; 2: within quotes that follow one."""
    arcs = {(0, "r"): (1, "r", 1.0), (1, "q"): (2, "q", 1.0), (2, "q"): (1, "q", 1.0)}
    arcs |= {(state, s): (state, s, factor) for state in (1, 2) for s in "ih"}
    return Transducer(arcs)


def _target(insult: float = 1.5, lone_threat: float = 0.2) -> Transducer:
    """State 1: a target came before; the threat of no one hardly counts."""
    arcs = {(0, "t"): (1, "t", 1.0), (1, "i"): (1, "i", insult), (0, "h"): (0, "h", lone_threat)}
    return Transducer(arcs)


GRAMMAR = compose(compose(_negation(), _reported(), SYMBOLS), _target(), SYMBOLS)


class Model:
    """Terms with weights (word beginnings end in '*') and the calibration."""

    def __init__(self, terms: dict[str, float], slope: float = 1.0, offset: float = -3.0):
        self.terms = terms | {w: PRIOR for w in INSULTS if w not in terms}
        self.slope, self.offset = slope, offset
        self._ready = False

    def __getstate__(self):
        return {"terms": self.terms, "slope": self.slope, "offset": self.offset, "_ready": False}

    def _prepare(self) -> None:
        import ahocorasick

        self.words = {w: (("i", v) if w not in THREATS else ("h", v)) for w, v in self.terms.items() if not w.endswith("*")}
        self.words |= {w: ("h", PRIOR) for w in THREATS if w not in self.words}
        self.starts = {w[:-1]: v for w, v in self.terms.items() if w.endswith("*")}
        for names, symbol in ((TARGETS, "t"), (NEGATIONS, "n"), (REPORTS, "r")):
            for w in names:
                self.words.setdefault(w, (symbol, 0.0))
        keys = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in [w for w, (s, _) in self.words.items() if s in "ih"] + list(self.starts):
            keys.add_word(w)
        keys.make_automaton()
        self.keys, self._ready = keys, True

    def symbol(self, word: str) -> tuple[str, float, str]:
        found = self.words.get(word)
        if found:
            return (*found, word)
        for n in STEMS:
            if n <= len(word) and (v := self.starts.get(word[:n])) is not None:
                return "i", v, word[:n] + "*"
        return ("q" if not LETTER.match(word) else "o"), 0.0, word

    def _holds(self, low: str) -> bool:
        """Whether any term begins at the beginning of a word."""
        for end, n in self.keys.iter(low):
            at = end - n + 1
            if not at or not LETTER.match(low[at - 1]):
                return True
        return False

    def matches(self, text: str) -> tuple[float, int, str]:
        """Evidence, matched clauses, and the clause of most weight."""
        if not self._ready:
            self._prepare()
        low = text.lower()
        if not low or not self._holds(low):
            return 0.0, 0, ""
        best: dict[str, float] = {}
        clauses, top, worst = 0, 0.0, ""
        for clause in CLAUSE.split(low):
            if not self._holds(clause):
                continue
            state, here = 0, 0.0
            for word in WORD.findall(clause):
                s, weight, term = self.symbol(word)
                state, _, factor = GRAMMAR.step(state, s)
                if weight:
                    value = weight * factor
                    here += value
                    best[term] = max(best.get(term, 0.0), value)
            clauses += here > 0
            if here > top:
                top, worst = here, clause
        return math.fsum(best[t] for t in sorted(best)), clauses, worst

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.offset))))


def _features(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        if LETTER.match(w):
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if n <= len(w))
    return out


def likelihood_ratio(t: int, c: int, share: float) -> float:
    """G2 of a term in t toxic and c clean documents, where ``share`` are toxic."""
    part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
    return 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float = 0.0) -> dict[str, float]:
    """Weights of the terms kept among (term, toxic documents, clean documents):
    those of MIN_DOCS, MIN_PRECISION and the ``least`` likelihood ratio;
    beginnings give way to an extension with nearly as many documents, and what
    a kept beginning covers is dropped. None without toxic or clean documents."""
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    counts = [(f, t, c) for f, t, c in counts if t >= MIN_DOCS and t >= MIN_PRECISION * (t + c) and likelihood_ratio(t, c, share) >= least]
    kept = {f: (t, c) for f, t, c in counts}
    longest: Counter = Counter()
    for f, (t, _) in kept.items():
        bare = f.rstrip("*")
        for n in STEMS:
            if n < len(bare) or n == len(bare) and not f.endswith("*"):
                longest[bare[:n] + "*"] = max(longest[bare[:n] + "*"], t)
    kept = {f: x for f, x in kept.items() if not (f.endswith("*") and longest[f] >= 0.9 * x[0])}
    whole = {f: x for f, x in kept.items() if not any(bare[:n] + "*" in kept for bare in [f.rstrip("*")] for n in STEMS if n < len(bare) or n == len(bare) and not f.endswith("*"))}
    return {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, (t, c) in sorted(whole.items())}


def fit_line(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton's method; the slope
    is not negative."""
    x = np.stack([evidence, np.ones_like(evidence)], 1)
    w = np.array([0.1, -2.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - label)) + ridge * (w - [0.3, 0])
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def is_held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _with_least(batches):
    """Adds each text's least shingle hash, which near copies mostly share: a
    passage that was copied often shall not teach its words as often."""
    for batch in batches:
        texts = Texts.of(batch.column(0))
        least = np.zeros(len(texts), np.uint64)
        for a, b in texts.slices():
            hashes, doc = shingle_hashes(Words(texts.part(a, b)), 5)
            if len(doc):
                begin = np.flatnonzero(np.diff(doc, prepend=-1))
                least[a + doc[begin]] = np.minimum.reduceat(hashes, begin)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least.view(np.int64))], ["text", "toxic", "least"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents that are not held out. Repeated labels of
    an id count as toxic if any is; null ids, labels and texts teach nothing.
    Without any toxic or clean row the built-in terms stand."""
    shared_dir(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = min(1.0, bound / max(1, known.count()))
    if rate < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id").dropna().select("text", "toxic")
    sample = sample.mapInArrow(tidy_batches(_with_least), "text string, toxic int, least long").dropDuplicates(["least", "toxic"]).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")).checkpoint()

    width = 2 * FOLDS
    each = [f"n{k}" for k in range(width)]  # toxic and clean documents by fold

    def count(batches):
        seen: dict[str, list[int]] = {"": [0] * width}
        for batch in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                at = 2 * fold + (not label)
                for f in {"", *_features(text)}:
                    seen.setdefault(f, [0] * width)[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(width))], ["term", *each])

    cores = sample.sparkSession.sparkContext.defaultParallelism
    counts = sample.repartition(cores).mapInArrow(tidy_batches(count), "term string, " + ", ".join(f"{n} long" for n in each)).groupBy("term").agg(*[F.sum(n).alias(n) for n in each]).checkpoint()
    whole = counts.filter(F.col("term") == "").first()
    toxic = [whole[2 * k + 1] for k in range(FOLDS)] if whole else [0]
    clean = [whole[2 * k + 2] for k in range(FOLDS)] if whole else [0]
    if not sum(toxic) or not sum(clean):
        return Model({})
    # what passes in any fold's rest or in all passes here
    t, c = (sum(F.col(each[2 * k + i]) for k in range(FOLDS)) for i in (0, 1))
    rests = [(t, c)] + [(t - F.col(each[2 * k]), c - F.col(each[2 * k + 1])) for k in range(FOLDS)]
    passing = F.lit(False)
    for x, y in rests:
        passing = passing | ((x >= MIN_DOCS) & (x >= MIN_PRECISION * (x + y)))
    strong = [tuple(r) for r in counts.filter((F.col("term") != "") & passing).collect()]

    def view(fold: int | None) -> tuple[list[tuple[str, int, int]], int, int]:
        """Counts of all folds but one, and the documents counted."""
        used = [k for k in range(FOLDS) if k != fold]
        return [(r[0], sum(r[2 * k + 1] for k in used), sum(r[2 * k + 2] for k in used)) for r in strong], sum(toxic[k] for k in used), sum(clean[k] for k in used)

    views = [view(k) for k in range(FOLDS)]
    models = [[Model(choose_terms(*v, g)) for v in views] for g in LADDER]

    def weigh(batches):
        for batch in batches:
            rows = [(g, round(models[g][fold].matches(text)[0], 2), label) for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)) for g in range(len(LADDER))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())], ["g", "e", "toxic"])

    seen = sorted(tuple(r) for r in sample.repartition(cores).mapInArrow(tidy_batches(weigh), "g int, e double, toxic int").groupBy("g", "e", "toxic").count().collect())
    best = None
    for g, bound_ in enumerate(LADDER):
        rows = np.array([r[1:] for r in seen if r[0] == g], float)
        slope, offset = fit_line(rows[:, 0], rows[:, 1], rows[:, 2])
        says = 1 / (1 + np.exp(-(slope * rows[:, 0] + offset))) >= THRESHOLD
        wrong = float(rows[says != (rows[:, 1] > 0), 2].sum())
        if best is None or wrong < best[0]:
            best = wrong, bound_, slope, offset
    return Model(choose_terms(*view(None), best[1]), best[2], best[3])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds toxicity (0 to 1), toxic_evidence, toxic_clauses and toxic_clause
    (the clause of most weight, lower-cased) to ``docs``, replacing columns so
    named. Only the text is read; null and empty texts hold no clause and get
    the probability of no evidence; equal texts get equal scores."""
    added = {"toxicity", "toxic_evidence", "toxic_clauses", "toxic_clause"}
    base = docs.select(*[c for c in docs.columns if c not in added])
    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_evidence", T.DoubleType()), T.StructField("toxic_clauses", T.IntegerType()), T.StructField("toxic_clause", T.StringType())])
    at = base.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [model.matches(t or "") for t in batch.column(at).to_pylist()]
            more = [pa.array([model.probability(f[0]) for f in found], pa.float64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "toxicity", "toxic_evidence", "toxic_clauses", "toxic_clause"])

    return base.mapInArrow(tidy_batches(run), schema)


def op6_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_clauses")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject, learned from the labels of
    ``documents`` and applied to ``docs``.

    Null and empty texts hold no clause and stay; equal texts and repeated rows
    share their fate; a very long text is read whole, clause by clause; columns of
    ``docs`` named as those of ``score`` pass unchanged; no rows give none."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept(docs, model)


def _kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` under the threshold, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [model.probability(model.matches(t or "")[0]) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy_batches(run), docs.schema)
