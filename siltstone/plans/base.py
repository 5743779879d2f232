"""Registering a query with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The words form in SQL; the mask without lookbehind, which RE2 lacks.
def sql_tokens(text: str, mask: bool = False) -> str:
    low = f"lower({text})"
    if mask:
        low = f"regexp_replace({low}, '(^|[^\\w])[+-]?(?:\\d+/\\d+|\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)', '\\1 <num> ', 'g')"
    return f"regexp_extract_all({low}, '[a-z0-9]+|<num>')"


def sql_words(text: str, mask: bool = False) -> str:
    return f"array_to_string({sql_tokens(text, mask)}, ' ')"


def sql_ngrams(words: str, size: int) -> str:
    return f"""CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {size} THEN [array_to_string({words}, ' ')]
      ELSE list_distinct(list_transform(range(1, len({words}) - {size} + 2), lambda i: array_to_string({words}[i : i + {size} - 1], ' '))) END"""


def sql_windows(words: str, size: int) -> str:
    return f"""CASE WHEN len({words}) < {size} THEN []
      ELSE list_distinct(list_transform(range(1, len({words}) - {size} + 2), lambda i: array_to_string({words}[i : i + {size} - 1], ' '))) END"""
