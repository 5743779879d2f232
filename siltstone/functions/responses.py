"""Scoring, rewards and classes of model responses.

What needs positions or exact values in a text (question generation, retention
items) is one Arrow function a batch; contracts, rewards and classes are column
expressions over its flags, so a reward is a sum of terms in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import re
from fractions import Fraction
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.answers import terminal_number
from siltstone.functions.exact import canonical_digest
from siltstone.functions.text import prefix_echo, repeats, restates, word_overlap
from siltstone.functions.types import struct_of
from siltstone.operators.scoring import LINES, MARKER

# Spans in which a question mark is data, and headers of questions.
CODE = r"```[\s\S]*?```|`[^`\n]*`"
QUOTE = "\"[^\"\\n]*\"|“[^”\\n]*”|‘[^’\\n]*’"
UNKNOWN = r"(?:=|≈|≃|≅|→|->)\s*(\?)"
HEADER = r"(?:^|\n)\s*(?:question|problem)\s*:"
ECHO_LEAST = 24
# Weights of the rewards, and the most tokens of a candidate.
CORRECT, EXTRACTED, EXACT, INSTRUCTED = 1.0, 0.10, 0.05, 0.05
CUT, ECHOED, ASKED, CONFLICTING, MALFORMED, FAILED = -0.10, -0.25, -0.25, -0.25, -0.50, -1.0
CANDIDATE_TOKENS = 256
# What the classes of outputs look for.
QUESTION_PHRASES = ["how many", "how much", "what is", "what was", "find the", "calculate the"]
REASONING = ["because", "calculate", "first", "multiply", "divide", "subtract", "add", "remaining", "therefore", "total", "so", "then"]
ROLES = ["system", "user", "assistant", "solve"]
TRACE_STARTS = ["add", "convert", "divide", "multiply", "represent", "subtract", "treat"]
RAW_NUMBER = r"(?<![A-Za-z_])[-+]?\d+(?:[.,/]\d+)*"
INTERNAL = r"(?i)\b(?:typed ledger|update \d+|program step|state node|ledger operation|semantic frame|template id|generator|operation node|internal node)\b"
PROCEDURAL = r"(?i)^(?:add|subtract|multiply|divide|partition|represent|treat|update|the typed|the exact|exact equality|the resource difference|the remaining|combine)"
EQUATION = r"(?:\d+(?:\.\d+)?\s*){1,3}[+\-*/×÷]\s*\d+(?:\.\d+)?\s*="
FINAL_LINE = r"(?i)^Final answer:\s*[-+]?\d+(?:/\d+|\.\d+)?$"
OTHER_TERMINAL = r"(?i)^(?:answer|result|therefore|thus|total)\s*(?::|is\b)"
TRACE_LINE = r"(?i)^(?:the typed ledger|use exact integer|treat all|exact equal distribution|amber parts permit|divide|represent|multiply|the exact weighted|add the two)\b"
WORKSHEET = ["write a question", "create a problem", "worksheet"]

_code, _quote, _unknown = map(re.compile, (CODE, QUOTE, UNKNOWN))
_header = re.compile(HEADER, re.IGNORECASE)


def _folded(text: str) -> str:
    return " ".join(text.casefold().split())


def question_rule(prompt: str, response: str) -> str | None:
    """The rule by which a response puts a question of its own, or None."""
    code = [m.span() for m in _code.finditer(response)]
    quotes = [m.span() for m in _quote.finditer(response)]
    try:
        json.loads(response.strip())
        marks = set()
    except ValueError:
        marks = {m.start() for m in re.finditer(r"\?", response)}
    if marks:
        asked = _folded(prompt)
        given = [(a, b) for a, b in quotes if b - a > 2 and _folded(response[a + 1:b - 1]) in asked]
        marks -= {i for a, b in code + given for i in range(a, b)} | {m.start(1) for m in _unknown.finditer(response)}
    if marks:
        return "unprotected_question_mark"
    if any(not any(a <= m.start() < b for a, b in code + quotes) for m in _header.finditer(response)):
        return "unprotected_question_or_problem_header"
    return None


def _exact(text: str) -> Fraction | None:
    try:
        return Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


def score_item(kind: str, prompt: str, expected: str, response: str) -> dict:
    """Flags of a response to an item of kind numeric_terminal, json_exact or
    exact_text."""
    bare, said, extractable = response.strip(), None, False
    correct, category = False, None
    if kind == "numeric_terminal":
        value, category = terminal_number(response)
        due = _exact(expected)
        extractable, correct = value is not None and due is not None, value is not None and value == due
        said = None if value is None else str(value)
        exact = re.search(rf"(?:^|\n)Final answer:\s*{re.escape(expected)}\s*$", response, re.IGNORECASE) is not None
    elif kind == "json_exact":
        try:
            found, due = json.loads(bare), json.loads(expected)
            extractable, correct, said = True, isinstance(found, dict) and found == due, canonical_digest(found)
        except ValueError:
            pass
        exact = correct
    else:
        extractable, correct = bool(bare), bare == expected
        said, exact = bare if len(bare) <= 160 else None, correct
    asked = _folded(prompt)
    return {"correct": correct, "extractable": extractable, "malformed": not extractable, "prompt_echo": len(asked) >= ECHO_LEAST and asked in _folded(response),
            "question_generation": question_rule(prompt, response) is not None, "exact_format": exact, "conflicting": (category if kind == "numeric_terminal" else terminal_number(response)[1]) == "conflicting_answers",
            "extracted_hash": None if said is None else hashlib.sha256(said.encode()).hexdigest()}


ITEM = "correct boolean, extractable boolean, malformed boolean, prompt_echo boolean, question_generation boolean, exact_format boolean, conflicting boolean, extracted_hash string"


@F.pandas_udf(struct_of(ITEM))
def item_score(kind: pd.Series, prompt: pd.Series, expected: pd.Series, response: pd.Series) -> pd.DataFrame:
    """Columns: the flags of ``score_item``; nulls count as empty texts."""
    rows = [score_item(*["" if v is None else v for v in row]) for row in zip(kind, prompt, expected, response)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM.split(", ")])


@F.pandas_udf(struct_of("decision boolean, rule string"))
def question_generation(prompt: pd.Series, response: pd.Series) -> pd.DataFrame:
    rules = [question_rule(p or "", r or "") for p, r in zip(prompt, response)]
    return pd.DataFrame({"decision": [r is not None for r in rules], "rule": pd.Series(rules, dtype=object)})


def lines_of(text: Column) -> Column:
    """The lines of a text without the white space around it; none if empty."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, LINES))


def _marked_last(text: Column) -> tuple[Column, Column]:
    """(the last line, whether it alone begins with the marker)."""
    lines = lines_of(text)
    last = F.try_element_at(lines, F.lit(-1))
    return last, F.coalesce((F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(MARKER)))) == 1) & F.startswith(last, F.lit(MARKER)), F.lit(False))


def states_answer(text: Column, answer: Column) -> Column:
    """The one marked line is the last and is exactly 'Final answer: ' and the answer."""
    last, alone = _marked_last(text)
    return F.coalesce(alone & (last == F.concat(F.lit(MARKER + " "), answer)), F.lit(False))


def states_number(text: Column) -> Column:
    """The one marked line is the last and holds an integer, decimal or fraction."""
    last, alone = _marked_last(text)
    return F.coalesce(alone & F.rlike(last, F.lit(r"^Final answer: [+-]?(?:\d+(?:\.\d+)?|\d+/0*[1-9]\d*)$")), F.lit(False))


def _pays(flag: Column, weight: float) -> Column:
    return F.when(flag, weight).otherwise(0.0)


def task_reward(found: Column, stated: Column, truncated: Column, failed: Column | None = None, joint: bool = False) -> Column:
    """struct of terms and total. ``found``: ``item_score`` of a numeric item;
    ``stated``: its final-line contract. ``joint``: the first version, in which echo
    and question share a penalty, conflicts have one, and nothing else is malformed."""
    if joint:
        terms = {"correctness": _pays(found["correct"], CORRECT), "extraction": _pays(found["extractable"], EXTRACTED), "contract": _pays(stated, EXACT), "truncation": _pays(truncated, CUT),
                 "echo_or_question": _pays(found["prompt_echo"] | found["question_generation"], ECHOED), "conflict": _pays(found["conflicting"], CONFLICTING)}
    else:
        failed = F.lit(False) if failed is None else failed
        ok = ~failed
        terms = {"correctness": _pays(found["correct"] & ok, CORRECT), "extraction": _pays(found["extractable"] & ok, EXTRACTED), "contract": _pays(stated, EXACT), "truncation": _pays(truncated, CUT), "echo": _pays(found["prompt_echo"], ECHOED),
                 "question": _pays(found["question_generation"], ASKED), "malformed": _pays(found["malformed"] | failed, MALFORMED), "failure": _pays(failed, FAILED)}
    return _with_total(terms)


def replay_reward(found: Column, truncated: Column, failed: Column | None = None, joint: bool = False) -> Column:
    """The same for a replay item, whose own scorer decides."""
    if joint:
        terms = {"correctness": _pays(found["correct"], CORRECT), "contract": _pays(found["exact_format"], EXACT), "truncation": _pays(truncated, CUT), "echo_or_question": _pays(found["prompt_echo"] | found["question_generation"], ECHOED), "conflict": _pays(found["conflicting"], CONFLICTING)}
        return _with_total(terms)
    failed = F.lit(False) if failed is None else failed
    ok = ~failed
    right, exact = found["correct"] & ok, found["exact_format"] & ok
    terms = {"correctness": _pays(right, CORRECT), "extraction": _pays(found["extractable"] & ok, EXTRACTED), "contract": _pays(exact, EXACT), "instruction": _pays(right & exact & ~found["prompt_echo"] & ~found["question_generation"], INSTRUCTED), "truncation": _pays(truncated, CUT),
             "echo": _pays(found["prompt_echo"], ECHOED), "question": _pays(found["question_generation"], ASKED), "malformed": _pays(found["malformed"] | failed, MALFORMED), "failure": _pays(failed, FAILED)}
    return _with_total(terms)


def _with_total(terms: dict[str, Column]) -> Column:
    total = sum(terms.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in terms.items()], (F.round(total, 10) + 0.0).alias("total"))


def candidate(found: Column, expected: Column, independent: Column, n_tokens: Column, truncated: Column, failed: Column) -> Column:
    """struct(disagreement, eligible): ``found`` and the ``independent`` canonical
    answer agree, and nothing speaks against the candidate."""
    extractable, right = independent["value"].isNotNull(), F.coalesce(independent["value"] == expected, F.lit(False))
    disagreement = (extractable != found["extractable"]) | (right != found["correct"])
    eligible = extractable & right & found["correct"] & found["exact_format"] & ~truncated & ~found["prompt_echo"] & ~found["question_generation"] & ~found["malformed"] & ~failed & ~disagreement & n_tokens.between(1, CANDIDATE_TOKENS)
    return F.struct(disagreement.alias("disagreement"), eligible.alias("eligible"))


def combined_evidence(verifier: tuple[Column, Column], method: tuple[Column, Column], value: tuple[Column, Column]) -> Column:
    """Why two verifications do not count as independent; null where they do."""
    return F.when(verifier[0] == verifier[1], "same_verifier_id").when(method[0] == method[1], "same_method_family").when(~value[0].eqNullSafe(value[1]), "verifier_disagreement")


def collapse_class(response: Column, r: Column, q: Column, truncated: Column, exact: Column, predicted: Column, failure: Column) -> Column:
    """The first of ten classes of an output that applies; ``r`` and ``q``: masked
    tokens of response and question."""
    first, said = F.try_element_at(r, F.lit(1)), F.array_join(r, " ")
    phrase = reduce(or_, [F.contains(said, F.lit(p)) for p in QUESTION_PHRASES])
    reasoned = F.arrays_overlap(r, F.array(*map(F.lit, REASONING))) & F.rlike(response, F.lit(RAW_NUMBER))
    finals = F.regexp_count(response, F.lit(r"(?im)^\s*Final answer\s*:"))
    rules = [
        (truncated, "token_limit_truncation"), (F.size(r) <= 3, "near_empty_or_premature_eos"), (prefix_echo(r, q) | (word_overlap(r, q) >= 0.72), "prompt_or_question_echo"),
        (first.isin(ROLES) | (phrase & F.contains(response, F.lit("?"))), "question_generation_or_transcript_continuation"), (repeats(r), "repetitive_output"), (exact & (finals == 1), "terminal_answer_contract_present"),
        (failure.isin("ambiguous_terminal_answer", "conflicting_answers", "malformed_terminal_answer"), "ambiguous_or_malformed_answer"), (predicted, "answer_in_unsupported_form"), ((failure == "no_terminal_answer") & reasoned, "reasoning_like_without_terminal_answer"),
    ]
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules], F.lit("unrelated_or_unclassifiable_prose"))


def first_pattern(r: Column) -> Column:
    """What a response of these masked tokens begins with."""
    first, pair = F.try_element_at(r, F.lit(1)), F.array_join(F.slice(r, 1, 2), " ")
    return (F.when(F.size(r) == 0, "empty").when(pair == "final answer", "final_answer")
            .when(pair.isin("to find", "we need", "the answer") | first.isin("first", "because", "since", "therefore"), "reasoning_connective")
            .when(pair.isin(QUESTION_PHRASES) | first.isin("how", "what", "which"), "question_phrase").when(first.isin(ROLES), "role_or_prompt_marker")
            .when(pair.isin("the exact", "the typed", "exact equal"), "synthetic_trace_metadata_phrase").when(first.isin(TRACE_STARTS), "synthetic_trace_operation")
            .when((first == "num") | F.rlike(first, F.lit(r"^\d+$")), "numeric").otherwise("other_lexical"))


def _solid(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINES), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def _mentions(answer: Column, before: str, after: str) -> Column:
    quoted = F.regexp_replace(answer, r"([\\.+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1")
    return F.concat(F.lit(before), quoted, F.lit(after))


def target_styles(completion: Column, question: Column, answer: Column, n_tokens: Column) -> Column:
    """All style labels of a target completion (array of string)."""
    lines = _solid(completion)
    reasoning = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    many = lambda pattern: F.size(F.filter(reasoning, lambda x: F.rlike(x, F.lit(pattern))))
    n, finals = F.size(reasoning), F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(FINAL_LINE))))
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    starts = F.filter(F.transform(reasoning, lambda x: F.array_join(F.slice(words(x), 1, 3), " ")), lambda x: x != "")
    style = (F.when((n > 0) & (many(PROCEDURAL) * 2 >= n), "procedural_or_program_trace_style").when((many(EQUATION) > 0) & (n <= 4) & (n_tokens <= 128), "concise_equation_based_reasoning")
             .when((n_tokens <= 64) & (n <= 4), "concise_natural_reasoning").otherwise("verbose_natural_reasoning"))
    before = F.exists(reasoning, lambda x: F.rlike(x, _mentions(answer, r"(?<!\d)", r"(?!\d)")))
    last = F.try_element_at(lines, F.lit(-1))
    more = [(many(INTERNAL) > 0, "internal_operation_terminology"), (restates(words(question), words(completion)), "question_restatement"), (F.size(starts) > F.size(F.array_distinct(starts)), "repeated_structural_phrase"),
            (finals > 1, "multiple_final_answer_lines"), (before, "answer_before_final_line"), ((finals != 1) | ~F.coalesce(F.rlike(last, F.lit(FINAL_LINE)), F.lit(False)), "malformed_final_line")]
    return F.array_compact(F.array(style, *[F.when(c, F.lit(label)) for c, label in more]))


def format_flags(completion: Column, answer: Column) -> Column:
    """struct of flags on how a completion ends."""
    lines = F.transform(lines_of(completion), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    finals = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^Final answer:\s*\S+\s*$")))
    others = F.filter(lines, lambda x: F.rlike(x, F.lit(OTHER_TERMINAL)))
    last = F.try_element_at(lines, F.lit(-1))
    said = F.regexp_extract(F.coalesce(F.try_element_at(finals, F.lit(1)), F.lit("")), r"^Final answer:\s*(\S+)\s*$", 1)
    body = F.array_join(F.slice(lines_of(completion), F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    low = F.lower(completion)
    return F.struct(((F.size(finals) == 1) & (said == answer)).alias("one_clear_answer"), F.coalesce(last == F.concat(F.lit("Final answer: "), answer), F.lit(False)).alias("ends_exactly"), (F.size(others) > 0).alias("other_terminal"),
                    F.rlike(body, _mentions(answer, r"(?<![\w.])", r"(?!\w)")).alias("answer_before_end"), (F.size(finals) + F.size(others) > 1).alias("several_markers"),
                    F.rlike(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.lit(TRACE_LINE)).alias("program_trace"), (F.contains(completion, F.lit("?")) | F.exists(F.array(*map(F.lit, WORKSHEET)), lambda p: F.contains(low, p))).alias("worksheet"))


def failure_rule(section: Column, extractable: Column) -> Column:
    """struct(rule, family) of a failed item."""
    pair = lambda rule, family: F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"))
    return (F.when(section == "format", pair("exact_text_equality", "exact_format_mismatch")).when(extractable, pair("numeric_terminal_expected_answer_equality", "wrong_extractable_numeric_answer"))
            .otherwise(pair("numeric_terminal_extraction_required", "malformed_nonextractable_numeric_answer")))


def loss_mask(turns: Column, end: int, trained: str = "assistant") -> Column:
    """struct(input_ids, labels) of an array of (role, ids) turns: a trained turn is
    followed by the ``end`` id, and only it and its end are labelled, all else is -100."""
    own = lambda m: m["role"] == trained
    with_end = lambda m: F.when(own(m), F.concat(m["ids"], F.array(F.lit(end).cast("int")))).otherwise(m["ids"])
    ids = F.flatten(F.transform(turns, with_end))
    labels = F.flatten(F.transform(turns, lambda m: F.when(own(m), with_end(m)).otherwise(F.transform(m["ids"], lambda _: F.lit(-100)))))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))
