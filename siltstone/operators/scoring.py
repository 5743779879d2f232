"""Strict scoring of a response's final integer, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker, the number, and what separates lines.
MARKER = "Final answer:"
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.0+)?"
LINES = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def integer_form(number: Column) -> Column:
    """The integer as a canonical string: no sign for plus, no commas, zero
    decimals or leading zeros; of any length, so compared as text."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(number, ",", ""), r"\.0+$", ""), r"^\+", "")
    plain = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
    return F.when(plain == "-0", "0").otherwise(plain)


def strict_answer(response: Column) -> Column:
    """struct(predicted, error): the integer of the one marked line, which must
    be the last that isn't blank; else why there is none (empty, marker_count,
    not_last, format)."""
    lines = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), LINES), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    marked = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(MARKER))))
    last = F.try_element_at(lines, F.lit(-1))
    inner = F.regexp_extract(last, rf"^{MARKER}\s*(?:\\boxed\{{\s*({NUMBER})\s*\}}|({NUMBER}))$", 1)
    plain = F.regexp_extract(last, rf"^{MARKER}\s*(?:\\boxed\{{\s*({NUMBER})\s*\}}|({NUMBER}))$", 2)
    value = F.concat(inner, plain)
    error = (F.when(F.size(lines) == 0, "empty").when(marked != 1, "marker_count").when(~F.startswith(last, F.lit(MARKER)), "not_last").when(value == "", "format"))
    return F.struct(F.when(error.isNull(), integer_form(value)).alias("predicted"), error.alias("error"))


def strict_score(response: Column, reference: Column) -> Column:
    """struct(predicted, expected, correct, error); a reference that is no
    integer is expected as null and nothing is correct."""
    found = strict_answer(response)
    bare = F.regexp_replace(reference, r"(?U)^\s+|\s+$", "")
    expected = F.when(F.rlike(bare, F.lit(rf"^{NUMBER}$")), integer_form(bare))
    return F.struct(found["predicted"].alias("predicted"), expected.alias("expected"), F.coalesce(found["predicted"] == expected, F.lit(False)).alias("correct"), found["error"].alias("error"))
