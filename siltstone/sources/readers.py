"""Readers with closed schemas.

Whatever breaks a promise of the input (a line that is no object, an unknown or
missing field, a value of another type, a repeated identifier) is an error that
names the place, found by the executors while they scan.
"""

from __future__ import annotations

import json
from dataclasses import fields as dataclass_fields
from dataclasses import is_dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.contracts import ContractBroken, uniqueness


def _plain(value: object, kind: T.DataType) -> bool:
    """Whether a JSON value is of the type; a boolean is no number."""
    if value is None:
        return True
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_plain(v, kind.elementType) for v in value)
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and set(value) == set(kind.names) and all(_plain(value[f.name], f.dataType) for f in kind.fields)
    return isinstance(value, dict) and all(_plain(v, kind.valueType) for v in value.values())


def jsonl(spark: SparkSession, path: str, schema: T.StructType, closed: bool = True) -> DataFrame:
    """One object a line; blank lines are passed over. A line that is no object,
    holds other fields (``closed``), or a value of another type is an error with its
    file and line. Files are split by Spark as text only where they are compressed
    in one piece; each is read by one task, line by line, without being held."""
    from pyspark.sql import functions as F

    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches):
        seen: dict[tuple, int] = {}
        for batch in batches:
            rows = []
            for text, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                seen[file, start] = number = seen.get((file, start), 0) + 1
                if not text.strip():
                    continue
                place = f"{file} line {number}" + (f" after byte {start}" if start else "")
                try:
                    value = json.loads(text)
                except ValueError as e:
                    raise ValueError(f"{place}: {e}") from None
                if not isinstance(value, dict):
                    raise ValueError(f"{place}: not an object")
                extra = set(value) ^ set(schema.names) if closed else set(schema.names) - set(value)
                if extra:
                    raise ValueError(f"{place}: unknown or missing {sorted(extra)}")
                wrong = [f.name for f in schema.fields if not _plain(value[f.name], f.dataType)]
                if wrong:
                    raise ValueError(f"{place}: wrong type of {wrong}")
                rows.append({n: value[n] for n in schema.names})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return lines.mapInArrow(run, schema)


def json_document(spark: SparkSession, path: str, schema: T.StructType, items: str | None = None) -> DataFrame:
    """A whole-file object or array; ``items`` names an array to have as rows."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df if items is None else df.select(F.explode(items).alias("_i")).select("_i.*")


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns only; one that is absent is an error before any scan."""
    df = spark.read.parquet(path)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ContractBroken(f"{path} has no {absent}")
    return df.select(*columns)


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Elements with their attributes (fields that begin with '_') and children."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


def by_row_index(table: DataFrame, manifest: DataFrame, index: str, expected: int | None = None) -> DataFrame:
    """The rows of a table that a manifest names by row index, with their position.
    ``expected``: the table's number of rows, else an error."""
    if expected is not None and (n := table.count()) != expected:
        raise ContractBroken(f"{n} rows instead of {expected}")
    return table.join(manifest.select(index, "position"), index)


def fixture(rows: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a fixture in a manifest's order; keys are unique and as listed."""
    marked = rows.withColumn("_key", F.to_json(F.struct(*key)))
    if not uniqueness(marked, "_key").first()["_key_unique"]:
        raise ContractBroken(f"repeated {key}")
    out = marked.drop("_key").join(manifest.select(*key, "position"), key)
    if out.count() != manifest.count():
        raise ContractBroken("the manifest lists rows that the fixture lacks")
    return out


def typed_config(cls: type, values: dict) -> object:
    """A frozen dataclass from a mapping (as YAML or JSON give it): unknown or
    missing keys and values of another type are errors; nested dataclasses too."""
    import typing

    hints = typing.get_type_hints(cls)
    names = {f.name for f in dataclass_fields(cls)}
    if set(values) != names:
        raise ContractBroken(f"{cls.__name__}: unknown or missing {sorted(set(values) ^ names)}")
    out = {}
    for name, value in values.items():
        kind = hints[name]
        if is_dataclass(kind):
            value = typed_config(kind, value)
        elif kind in (int, float, str, bool) and not (isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) or kind is float and isinstance(value, int) and not isinstance(value, bool)):
            raise ContractBroken(f"{cls.__name__}.{name}: {value!r} is no {kind.__name__}")
        out[name] = value
    return cls(**out)


def prompts(spark: SparkSession, corpora: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(corpus_id, prompt) of named corpora, each (kind, path, field): 'suite' is a
    document of items, 'records' are JSON lines, 'table' is Parquet."""
    out = None
    for name, (kind, path, field) in corpora.items():
        if kind == "suite":
            one = json_document(spark, path, T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField(field, T.StringType())])))]), "items").select(F.col(field))
        elif kind == "records":
            one = spark.read.schema(T.StructType([T.StructField(field, T.StringType())])).option("mode", "FAILFAST").json(path)
        elif kind == "table":
            one = parquet(spark, path, [field])
        else:
            raise ContractBroken(f"no kind of corpus {kind}")
        one = one.select(F.lit(name).alias("corpus_id"), F.col(field).alias("prompt"))
        out = one if out is None else out.unionByName(one)
    return out
