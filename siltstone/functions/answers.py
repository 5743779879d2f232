"""Canonical extraction of a response's one terminal number.

The number grammars need look-behind of Python's kind and exact fractions, so a
batch of responses goes through one Arrow function; scoring then compares
canonical strings in the JVM.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.types import struct_of

# The grammars of numbers, units, answers and cues, in the order in
# which they are tried, and the classes of failure.
GROUPED = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
VALUE = rf"[+-]?\s*\$?\s*(?:\\frac\{{\s*{GROUPED}\s*\}}\{{\s*{GROUPED}\s*\}}|{GROUPED}\s*/\s*{GROUPED}|{GROUPED}(?:\.\d+)?)"
DECORATED = rf"\$?\s*\\boxed\{{\s*(?P<boxed>{VALUE})\s*\}}\s*\$?|\*\*\s*(?P<bold>{VALUE})\s*\*\*|\\\(\s*(?P<latex>{VALUE})\s*\\\)"
MARKED = f"(?:{DECORATED})"
ANY = rf"(?:{DECORATED}|(?P<plain>{VALUE})(?![\d,/]|\.\d))"
UNIT_WORD = r"(?!(?:about|after|although|and|approximately|because|before|but|from|hence|if|or|since|so|therefore|thus|when|where|which)\b)[A-Za-z%°]+(?:-[A-Za-z%°]+)?"
UNIT = rf"(?:\s*%|\s+{UNIT_WORD}(?:\s+{UNIT_WORD}){{0,3}})?"
STOP = r"\s*[.!]?\s*$"
SO = r"\b(?:therefore|thus|hence|so|finally|consequently)[,:]?\s*"
VERB = (r"are|averages|bought|buys?|contains?|costs?|earned|earns?|equals|gave|gives?|has|have|had|is|lost|made|makes?|needs?|paid|pays?|"
        r"should\s+buy|spends?|spent|takes?|took|uses?|used|was|were|will\s+be|will\s+make|would\s+use")
FINAL = r"(?:^|\n)\s*(?:\*\*\s*)?Final answer\s*:\s*(?:\*\*\s*)?"
ANSWER_IS = r"\b(?:the\s+)?(?:final\s+)?answer\s*(?:is\s*:|is|equals|=|:)\s*"
NAMED = r"[A-Za-z][A-Za-z0-9_ ]{0,40}\s*=\s*"
TERMINAL = [
    rf"{FINAL}{ANY}{UNIT}{STOP}",
    rf"(?:^|\n)\s*(?:\\\[\s*)?{MARKED}(?:\s*\\\])?{STOP}",
    rf"^{ANY}{STOP}",
    rf"{ANSWER_IS}{ANY}{UNIT}{STOP}",
    rf"\bthe\s+(?:answer|result|total|distance|amount|cost|price|time|length|count|sum|difference|product|quotient|area|perimeter|volume|speed|rate|age|number|value)\s*(?:is|equals|=)\s*{ANY}{UNIT}{STOP}",
    rf"(?s:{SO}(?:.{{0,160}}?\b(?:is|are|equals|has|have|contains|costs?)\s*)?{ANY}{UNIT}{STOP})",
    rf"{SO}.{{0,180}}?\b(?:{VERB})\b[^\n0-9$+\-]{{0,100}}?{ANY}[^\n]{{0,160}}?{STOP}",
    rf"{SO}[^\n]{{0,240}}?{MARKED}[^\n]{{0,160}}?{STOP}",
    rf"{SO}{ANY}\s+{UNIT_WORD}(?:\s+{UNIT_WORD}){{0,5}}\s+(?:are|can\s+fit|do|does|is|will\s+fit|would\s+fit)\b[^\n]{{0,180}}?{STOP}",
    rf"{SO}[^\n0-9$+\-]{{1,240}}?{ANY}{UNIT}{STOP}",
    rf"{FINAL}[^\n0-9$+\-]{{0,100}}?\b(?:is|are|equals|=)\s*{ANY}{UNIT}{STOP}",
    rf"\\text\{{\s*Final answer:\s*\}}\s*{ANY}(?:\s*\\text\{{[^{{}}]{{1,60}}\}})?\s*\\\]\s*$",
    rf"(?:^|\n)\s*{NAMED}{ANY}{UNIT}{STOP}",
    rf"(?:^|\n)\s*(?:\\\[\s*)?(?:{NAMED})?(?:{VALUE}\s*[+\-*/]\s*)+{VALUE}\s*=\s*{ANY}{UNIT}(?:\s*\\\])?{STOP}",
]
STRONG = [
    rf"(?:\*\*\s*)?Final answer\s*:\s*(?:\*\*\s*)?{ANY}",
    rf"\\boxed\{{\s*(?P<boxed>{VALUE})\s*\}}",
    rf"\*\*\s*(?P<bold>{VALUE})\s*\*\*",
    rf"{ANSWER_IS}{ANY}",
]
NUMBER_TOKEN = rf"(?<![\d,]){VALUE}(?![\d,])"
COMMA_NUMBER = r"[+-]?\s*\$?\s*\d+(?:,\d+)+"
CUE = r"\b(answer|result|total|therefore|thus|hence|finally|consequently)\b|\\boxed|\*\*"
TWO_AT_END = rf"\b(?:answer|result|total|therefore|thus|hence|finally|consequently)\b[^\n]{{0,240}}?{VALUE}\s+(?:and|or)\s+{VALUE}[^\n]*$"
UNFINISHED = r"(?:[=:,+\-/]|(?<!\*)\*(?!\*)|\\boxed\{)\s*$"
TAIL = 300
TRUNCATED, EMPTY, CONFLICT, MALFORMED, AMBIGUOUS, NONE = "generation_truncated", "empty_response", "conflicting_answers", "malformed_terminal_answer", "ambiguous_terminal_answer", "no_terminal_answer"

_anycase = lambda pattern: re.compile(pattern, re.IGNORECASE)
_terminal, _strong = [*map(_anycase, TERMINAL)], [*map(_anycase, STRONG)]
_number, _comma, _cue, _two, _unfinished = map(_anycase, (NUMBER_TOKEN, COMMA_NUMBER, CUE, TWO_AT_END, UNFINISHED))
_groups = re.compile(r"\d{1,3}(?:,\d{3})+")
_ratio = re.compile(r"(?:\\frac\{(\d+)\}\{(\d+)\}|(\d+)/(\d+))")
_plain_value = re.compile(r"([+-]?)(.*)", re.DOTALL)


def as_fraction(said: str) -> Fraction | None:
    """The exact value of a number as the grammars write it; None if it is none."""
    sign, body = _plain_value.fullmatch(said.translate({32: None, 36: None, 44: None})).groups()
    try:
        if ratio := _ratio.fullmatch(body):
            above, below = [int(x) for x in ratio.groups() if x is not None]
            value = Fraction(above, below)
        else:
            value = Fraction(Decimal(body))
    except (InvalidOperation, ZeroDivisionError):
        return None
    return -value if sign == "-" else value


def _read(match: re.Match) -> Fraction | None:
    return as_fraction(next(v for v in match.groupdict().values() if v is not None))


def _bad_grouping(text: str) -> bool:
    said = (m.group().translate({32: None, 36: None}).lstrip("+-") for m in _comma.finditer(text))
    return any(_groups.fullmatch(x) is None for x in said)


def terminal_number(response: str, truncated: bool = False) -> tuple[Fraction | None, str | None]:
    """(value, None), or (None, class of failure). The first class that applies
    wins: truncated, empty, bad grouping or an unfinished end, two numbers at the
    end; then what all terminal grammars read has to be one value, and no strong
    grammar may read another anywhere."""
    if truncated:
        return None, TRUNCATED
    text = response.strip()
    if not text:
        return None, EMPTY
    tail = text[-TAIL:]
    cue = _cue.search(tail)
    if (cue and _bad_grouping(tail)) or _unfinished.search(text) or text.count("{") != text.count("}"):
        return None, MALFORMED
    if _two.search(tail):
        return None, CONFLICT
    readings = [_read(m) for m in (p.search(text) for p in _terminal) if m]
    values = {v for v in readings if v is not None}
    if len(values) > 1:
        return None, CONFLICT
    if not values:
        return None, MALFORMED if readings else AMBIGUOUS if cue and _number.search(tail) else NONE
    strong = {_read(m) for p in _strong for m in p.finditer(text)} - {None}
    return (None, CONFLICT) if strong - values else (values.pop(), None)


def canonical_text(value: Fraction | None) -> str | None:
    """'n' or 'n/d' in lowest terms."""
    return None if value is None else str(value)


@F.pandas_udf(struct_of("value string, category string"))
def _canonical(response: pd.Series, truncated: pd.Series) -> pd.DataFrame:
    found = [(None, None) if r is None else terminal_number(r, bool(t)) for r, t in zip(response, truncated)]
    return pd.DataFrame({"value": [canonical_text(v) for v, _ in found], "category": [c for _, c in found]}, dtype=object)


def canonical_answer(response: Column, truncated: Column | None = None) -> Column:
    """struct(value, category); both null for a null response."""
    return _canonical(response, F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False)))


def canonical_score(found: Column, expected: Column) -> Column:
    """struct(predicted, expected, correct, category) of a ``canonical_answer`` and
    the canonical string that is due."""
    return F.struct(found["value"].alias("predicted"), expected.alias("expected"), F.coalesce(found["value"] == expected, F.lit(False)).alias("correct"), found["category"].alias("category"))
