"""Writers that say what they wrote, and manifests that prove what they list.

A digest of a table is a tree of digests of fixed fan-out: its rows are ranked by
key within ranges, each range gives one digest, and these are digested again until
one is left, so no task holds more than FAN digests or one range's rows.
"""

from __future__ import annotations

import hashlib
import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.contracts import ContractBroken
from siltstone.operators.stats import tree_digest
from siltstone.sources.storage import exists


def row_json(df: DataFrame) -> DataFrame:
    """(key columns stay) one column ``line``: the row as JSON, its keys sorted."""
    return df.select("*", F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def jsonl(df: DataFrame, path: str, key: str, exclusive: bool = True) -> str:
    """Writes rows as sorted-key JSON lines in files ordered by ``key`` and gives
    the digest of the ordered lines; ``exclusive``: an existing path is an error."""
    if exclusive and exists(df.sparkSession, path):
        raise ContractBroken(f"{path} exists")
    lines = row_json(df).select(F.col(key).alias("_k"), "line")
    lines.repartitionByRange("_k").sortWithinPartitions("_k", "line").select("line").write.mode("errorifexists" if exclusive else "overwrite").text(path)
    return tree_digest(lines, "_k", F.col("line")).first()["digest"]


def new_or_identical(df: DataFrame, path: str, key: str) -> str:
    """Writes as ``jsonl``; what exists has to hold the same rows."""
    if not exists(df.sparkSession, path):
        return jsonl(df, path, key)
    lines = row_json(df).select(F.col(key).alias("_k"), "line")
    there = df.sparkSession.read.text(path).select(F.col("value").alias("line"))
    if lines.select("line").exceptAll(there).limit(1).count() or there.exceptAll(lines.select("line")).limit(1).count():
        raise ContractBroken(f"{path} holds other rows")
    return tree_digest(lines, "_k", F.col("line")).first()["digest"]


def manifest(rows: DataFrame, key: str, position: str, **header: str) -> DataFrame:
    """One row: the header's fields, the number of entries and the digest of the
    ordered ids with the header."""
    fields = sorted(header)
    digest = tree_digest(rows.select(position, F.col(key).cast("string").alias("_v")), position, F.col("_v"))
    said = F.concat_ws("\n", *[F.lit(f"{k}={header[k]}") for k in fields], "digest", "entries")
    one = digest.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).cast("string").alias("entries"))))  # one row each
    return one.select(*[F.lit(header[k]).alias(k) for k in fields], F.col("entries").cast("long").alias("entries"), F.sha2(said, 256).alias("manifest_sha256"))


def require_manifest(rows: DataFrame, key: str, position: str, expected: str, **header: str) -> None:
    """Raises unless the rows are those of the manifest with this digest."""
    found = manifest(rows, key, position, **header).first()["manifest_sha256"]
    if found != expected:
        raise ContractBroken(f"manifest digest {found} instead of {expected}")


def guarded(rows: DataFrame, partition: str, sealed: str = "sealed", allow_sealed: bool = False) -> DataFrame:
    """Rows of the open partitions; with ``allow_sealed`` all of them. To ask for
    the sealed ones alone without leave is an error."""
    if allow_sealed:
        return rows
    only = rows.filter(~F.col(partition).eqNullSafe(sealed))
    if rows.limit(1).count() and not only.limit(1).count():
        raise ContractBroken(f"partition {sealed} needs leave")
    return only


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a path, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest of the names under a path, in order, and their contents."""
    found = file_digests(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "sha256")
    return tree_digest(found, "name", F.concat_ws(":", "name", "sha256")).first()["digest"]


def label_blind(df: DataFrame, hidden: list[str]) -> DataFrame:
    """The rows without what would tell an auditor the label."""
    return df.select(*[c for c in df.columns if c not in hidden])


def review_markdown(rows: list[dict], title: str) -> str:
    """A packet for human review; ``rows`` are few (a packet that people read)."""
    body = [f"## {k + 1}. {r['id']}\n\n> " + str(r["text"]).replace("\n", "\n> ") + "\n\n- [ ] approve\n- [ ] reject\n" for k, r in enumerate(rows)]
    whole = "\n".join(body)
    return f"# {title}\n\nPacket {hashlib.sha256(whole.encode()).hexdigest()}, {len(rows)} items\n\n{whole}"


def review_html(rows: list[dict], title: str) -> str:
    """The same as one static page, everything escaped."""
    body = "".join(f"<section id='{html.escape(str(r['id']), quote=True)}'><h2>{html.escape(str(r['id']))}</h2><pre>{html.escape(str(r['text']))}</pre></section>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{hashlib.sha256(body.encode()).hexdigest()}</p>{body}"
