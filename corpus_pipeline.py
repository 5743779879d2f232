"""The corpus pipeline: toxicity, near-dedup, substring dedup, mixing, BPE.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a frame. All but the last return the columns of ``docs``; each works on
everything its predecessor kept, and what it decides takes effect in its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import byte_bpe, minmax, mixing, substring_dedup, toxicity
from siltstone.llm.common import drop_path, fresh_path

#: Milder than op3's, so that few documents are repeated; none is dropped.
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.95}


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rare cells as several equal rows.

    Null sources and languages are a value of their own; null and empty texts
    have no words and stay once; rows that repeat an id get the same draw; an
    empty table gives no rows; a very long text counts by its words."""
    return mixing.sampled(docs, temper=TEMPER, whole=True)


STAGES = [
    ("toxicity", toxicity.stage),
    ("min-max near-dedup", minmax.stage),
    ("substring dedup", substring_dedup.stage),
    ("mixing", _mixed),
    ("byte-level BPE", byte_bpe.stage),
]

#: Finite-state scoring and tokenisation are not SQL; the tests hold the stages
#: against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet in the
    shared folder and read again as the next stage's input, whose own input is
    then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
