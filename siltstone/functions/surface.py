"""Checks and forms of generated questions, as column expressions.

Reasons come as arrays in the order of the checks, each once, and null texts give
the reasons of an empty one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import answers as A
from siltstone.functions.text import repeated_phrase
from siltstone.functions.types import struct_of

# What the checks look for.
PLACEHOLDER = "<[A-Z][A-Z0-9_]*>"
NUMERAL = r"(?<![A-Za-z_])[-+]?\d+(?:[.,/]\d+)?"
PUNCTUATION = r"(?:\.\.|;;|,,|\s+[?.!,;])"
MARKUP = "(?i)```|<think>|</think>"
CALCULATION = r"(?i)(?:\b(?:therefore|thus|equals|answer\s+is|result\s+is)\b|=)"
PRONOUN = r"(?i)\b(?:he|she|it|they|them|their|theirs|his|hers|this|that|these|those)\b"
CLAUSE = "([^.?!]+[.?!])"
REQUEST = "(?i)^(?:what|how|which|calculate|compute|determine|find|report)"
REPEATED_WORD = r"(?i)\b([A-Za-z][A-Za-z'-]*)\s+\1\b"
INTERNAL_TOKEN = r"\b(?:[a-z]+_[a-z0-9_]+|[a-z]+-[a-z]+-v\d+)\b"
INTERNAL_MARKERS = ["<ENTITY_", "<QUANTITY_", "frame_id", "role_id"]
BAD_ORDINAL = r"(?i)\b(?:1th|2th|3th|11st|12nd|13rd)\b"
RULES = ["literal_final_answer_line", "standalone_decorated_value", "standalone_plain_value", "explicit_answer_cue", "named_result_statement", "direct_conclusion_statement", "conclusion_verb_prose", "conclusion_decorated_value", "conclusion_leading_value",
         "conclusion_terminal_prose", "embedded_final_answer_line", "latex_final_answer_line", "terminal_assignment", "terminal_equation"]
LOOSE_RULES = RULES[5:10]
NEGATIVE_INTENT = r"(?i)\b(deficit|loss|lost|negative|short(?:fall)?|under(?:\s+budget)?)\b"
LONG_OUTPUT, FEWEST_WORDS = 700, 12


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold (null: holds), in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))


def clauses(text: Column) -> Column:
    """The punctuated clauses of a text; none if something is outside of them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1)), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    spaced = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.regexp_replace(F.array_join(found, " "), r"(?U)\s+", " ") == spaced, found).otherwise(F.array().cast("array<string>"))


def _repeated_clause(found: Column) -> Column:
    low = F.transform(found, lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")))
    return F.size(low) != F.size(F.array_distinct(low))


def _uncapped(found: Column) -> Column:
    return F.exists(found, lambda c: F.rlike(c, F.lit(r"^(?U)\p{L}")) & ~F.rlike(c, F.lit(r"^(?U)\p{Lu}")))


def language_audit(question: Column) -> Column:
    """struct(recommendation, defects) from the wording alone."""
    q = F.coalesce(question, F.lit(""))
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    internal = F.rlike(q, F.lit(INTERNAL_TOKEN))
    for marker in INTERNAL_MARKERS:
        internal = internal | F.contains(q, F.lit(marker))
    found = F.array_distinct(F.array_compact(F.array(
        F.when(F.rlike(q, F.lit(REPEATED_WORD)), "repeated wording"), F.when(F.rlike(q, F.lit(BAD_ORDINAL)), "grammar"), F.when(~F.endswith(q, F.lit("?")) | (F.regexp_count(q, F.lit(r"\?")) != 1), "grammar"),
        F.when(words < FEWEST_WORDS, "missing information"), F.when(internal, "internal terminology"))))
    return F.struct(F.when(F.size(found) == 0, "approve").otherwise("reject").alias("recommendation"), found.alias("defects"))


def render_reasons(question: Column, conclusion: Column, parts: Column, completion_ok: Column, words: Column) -> Column:
    """Reasons against a rendered question of clauses ``parts``; ``words``: its
    lower-case words."""
    q, c = F.coalesce(question, F.lit("")), F.trim(F.coalesce(conclusion, F.lit("")))
    bare = F.regexp_replace(q, r"(?U)^\s+|\s+$", "")
    sentences = F.filter(F.split(bare, r"(?<=[.!?])\s+"), lambda s: s != "")
    return reasons({
        "grammar_or_sentence_incomplete": ~F.rlike(bare, F.lit(r"[?.]$")) | (~F.endswith(c, F.lit("?")) & ~F.rlike(c, F.lit(REQUEST))), "malformed_punctuation": F.rlike(q, F.lit(PUNCTUATION)), "sentence_capitalization_failure": _uncapped(sentences),
        "empty_clause": (F.size(parts) == 0) | F.exists(parts, lambda p: F.trim(p) == ""), "duplicated_clause": _repeated_clause(parts), "repeated_adjacent_phrase": repeated_phrase(words), "conclusion_inconsistent": (c == "") | ~F.contains(q, c), "output_contract_failure": ~completion_ok})


def template_reasons(template: Column, inventory: Column, required: Column) -> Column:
    """Reasons against a placeholder template. ``inventory``: the placeholders it
    claims; ``required``: array of (token, times)."""
    t = F.coalesce(template, F.lit(""))
    seen = F.regexp_extract_all(t, F.lit(f"({PLACEHOLDER})"), F.lit(1))
    due = F.array_sort(F.transform(required, lambda r: r["token"]))
    found = clauses(t)
    return reasons({
        "duplicated_placeholder_inventory": F.size(inventory) != F.size(F.array_distinct(inventory)), "placeholder_set_mismatch": F.array_sort(F.array_distinct(inventory)) != due, "template_placeholder_set_mismatch": F.array_sort(F.array_distinct(seen)) != due,
        "placeholder_occurrence_mismatch": F.exists(required, lambda r: F.size(F.filter(seen, lambda s: s == r["token"])) != r["times"]), "invented_numeric_literal": F.rlike(F.regexp_replace(t, PLACEHOLDER, ""), F.lit(NUMERAL)), "answer_content_forbidden": F.contains(F.lower(t), F.lit("final answer")),
        "calculation_content_forbidden": F.rlike(t, F.lit(CALCULATION)), "unlicensed_pronoun": F.rlike(t, F.lit(PRONOUN)), "malformed_question_template": (F.size(found) == 0) | ~F.rlike(t, F.lit(r"\?\s*$")), "conflicting_question_intent": F.regexp_count(t, F.lit(r"\?")) != 1,
        "malformed_punctuation": F.rlike(t, F.lit(PUNCTUATION)), "duplicated_clause": _repeated_clause(found)})


def filled_template(template: Column, values: Column) -> Column:
    """The template with each (token, surface) put in, longest token first; null
    where a surface is blank or holds a placeholder, or one is left over."""
    bad = F.exists(values, lambda v: (F.trim(v["surface"]) == "") | F.rlike(v["surface"], F.lit(PLACEHOLDER)))
    ordered = F.array_sort(values, lambda a, b: F.when(F.length(a["token"]) > F.length(b["token"]), -1).when(F.length(a["token"]) < F.length(b["token"]), 1).otherwise(0))
    whole = F.aggregate(ordered, template, lambda text, v: F.replace(text, v["token"], v["surface"]))
    return F.when(~bad & ~F.rlike(whole, F.lit(PLACEHOLDER)), whole)


def filled_reasons(question: Column) -> Column:
    """Reasons against a filled question."""
    q = F.coalesce(question, F.lit(""))
    found = clauses(q)
    return reasons({
        "unresolved_placeholder": F.rlike(q, F.lit(PLACEHOLDER)), "filled_question_not_single_question": ~F.rlike(q, F.lit(r"\?\s*$")) | (F.regexp_count(q, F.lit(r"\?")) != 1), "filled_question_malformed_punctuation": F.rlike(q, F.lit(PUNCTUATION)), "filled_question_forbidden_markup": F.rlike(q, F.lit(MARKUP)),
        "filled_question_calculation_content": F.rlike(q, F.lit(CALCULATION)), "filled_question_unlicensed_pronoun": F.rlike(q, F.lit(PRONOUN)), "filled_question_incomplete": F.size(found) == 0, "filled_question_capitalization": _uncapped(found), "filled_question_duplicated_clause": _repeated_clause(found)})


def ledger_reasons(operations: DataFrame, quantities: DataFrame, plan: str) -> DataFrame:
    """(plan, reasons) of typed ledgers. quantities: plan, symbol, kind, transferable,
    verbs; operations: plan, symbol, verb, transfer, origin, destination. Found by an
    outer join of operations to the symbols of their plan."""
    q = quantities.groupBy(plan, "symbol").agg(F.min("kind").alias("kind"), F.bool_and("transferable").alias("transferable"), F.min("verbs").alias("verbs"))
    own = quantities.groupBy(plan).agg((F.min("kind") != F.max("kind")).alias("_mixed"), (F.count("symbol") > F.count_distinct("symbol")).alias("_twice"))
    j = operations.join(q, [plan, "symbol"], "left")
    there, moves = F.col("kind").isNotNull(), F.col("transfer") & F.col("kind").isNotNull()
    ends = F.col("origin").isNotNull() & F.col("destination").isNotNull()
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    by = j.groupBy(plan).agg(any_(~there).alias("_a"), any_(there & ~F.array_contains("verbs", F.col("verb"))).alias("_b"), any_(moves & ~ends).alias("_c"), any_(moves & ends & ~F.col("transferable")).alias("_d"), any_(moves & ends & (F.col("origin") == F.col("destination"))).alias("_e"))
    whole = own.join(by, plan, "full_outer")
    names = {"incompatible_object_or_unit_combination": "_mixed", "duplicate_quantity_symbol": "_twice", "operation_references_missing_quantity": "_a", "unsupported_object_verb": "_b", "transfer_endpoint_is_missing": "_c", "object_is_not_transferable": "_d", "transfer_endpoints_are_identical": "_e"}
    return whole.select(plan, F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(n)) for n, c in names.items()])).alias("reasons"))


@F.pandas_udf(struct_of("rule string, start int, stop int, raw string, context string, values array<string>"))
def extraction_trace(response: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Columns: the first terminal grammar that reads the extracted value, the span
    it read, and all numbers in what it matched; nulls where none does."""
    out = []
    for text, due in zip(response, value):
        row = (None,) * 6
        bare = (text or "").strip()
        for name, pattern in zip(RULES, A._terminal):
            m = pattern.search(bare) if due is not None else None
            if m and A.canonical_text(A._read(m)) == due:
                group = next(k for k, v in m.groupdict().items() if v is not None)
                shift = text.find(bare)
                seen = dict.fromkeys(A.canonical_text(A.as_fraction(n.group())) for n in re.finditer(A.NUMBER_TOKEN, m.group()))
                row = (name, shift + m.start(group), shift + m.end(group), m.group(group), m.group().strip(), [v for v in seen if v is not None])
                break
        out.append(row)
    return pd.DataFrame(out, columns=["rule", "start", "stop", "raw", "context", "values"]).astype(object)


def suspicions(trace: Column, value: Column, strict: Column, n_tokens: Column) -> Column:
    """Why an accepted answer deserves a second look."""
    several = F.size(trace["values"]) > 1
    return F.array_compact(F.array(
        F.when(~strict, "canonical_only"), F.when(trace["rule"].isin(LOOSE_RULES), "loose_conclusion_rule"), F.when(several, "multiple_values_in_terminal_context"),
        F.when(several & F.contains(trace["context"], F.lit("%")) & F.contains(trace["context"], F.lit("$")), "percentage_currency_mixture"), F.when(~F.startswith(value, F.lit("-")) & F.rlike(trace["context"], F.lit(NEGATIVE_INTENT)), "negative_intent_without_negative_value"),
        F.when(n_tokens >= LONG_OUTPUT, "long_output_near_limit")))


def noun_form(singular: Column, plural: Column, mass: Column, quantity: Column) -> Column:
    return F.when(quantity < 0, F.raise_error(F.lit("a quantity cannot be negative"))).when(mass | (quantity == 1), singular).otherwise(plural)


def indefinite_article(singular: Column) -> Column:
    return F.when(F.rlike(singular, F.lit("(?i)^[aeiou]")), "an").otherwise("a")


def verb_form(base: Column, third: Column, past: Column, participle: Column, quantity: Column, tense: Column) -> Column:
    return F.when(tense == "present", F.when(quantity == 1, third).otherwise(base)).when(tense == "past", past).when(tense == "participle", participle).otherwise(F.raise_error(F.lit("no such tense")))


def ordinal_numeral(n: Column) -> Column:
    teens = (n % 100).between(11, 13)
    ending = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.when(n <= 0, F.raise_error(F.lit("ordinals are positive"))).otherwise(F.concat(n.cast("string"), ending))
