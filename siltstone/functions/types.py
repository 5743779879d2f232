"""Spark types from short notes, without a session (executors import these modules)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_NAMES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def type_of(note: str) -> T.DataType:
    """'string', 'array<int>', 'struct<a:string,b:array<int>>' and so on."""
    note = note.strip()
    if note.startswith("array<"):
        return T.ArrayType(type_of(note[6:-1]))
    if note.startswith("struct<"):
        return T.StructType([T.StructField(n, type_of(t)) for n, t in (p.split(":", 1) for p in _parts(note[7:-1]))])
    return _NAMES[note]


def _parts(note: str) -> list[str]:
    """The parts between commas that are in no brackets."""
    out, depth = [""], 0
    for c in re.sub(r"\s*,\s*", ",", note):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def struct_of(note: str) -> T.StructType:
    """A schema 'name type, name type'."""
    return T.StructType([T.StructField(n, type_of(t)) for n, t in (p.strip().split(" ", 1) for p in _parts(note))])
