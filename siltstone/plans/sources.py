"""Reading back what was written, in each format, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.types import struct_of
from siltstone.operators import sampling as S
from siltstone.plans.base import query, sql_tokens, t
from siltstone.sources import readers, writers
from siltstone.sources.storage import fresh_path

_TURNS = struct_of("conv_id long, role string, text string, turn long")


@query("SELECT conv_id, role, text, turn FROM conversations")
def s1_jsonl(spark, d):
    """Conversations as JSON lines, written with a digest and read by a closed schema."""
    path = fresh_path(spark, "lines")
    writers.jsonl(t(spark, d, "conversations").select("conv_id", "role", "text", "turn").withColumn("turn", F.col("turn").cast("long")), path, "conv_id")
    return readers.jsonl(spark, path, _TURNS)


@query("SELECT p_partkey, p_name FROM part")
def s2_json_document(spark, d):
    """A document of items for each brand, read whole and taken apart."""
    path = fresh_path(spark, "documents")
    one = t(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("items"))
    one.repartition("p_brand").write.json(path)
    item = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType())])
    lines = spark.read.schema(T.StructType([T.StructField("items", T.ArrayType(item))])).json(path)
    return lines.select(F.explode("items").alias("i")).select("i.*")


@query("SELECT doc_id, lang FROM documents")
def s3_parquet(spark, d):
    return readers.parquet(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def s4_xml(spark, d):
    path = fresh_path(spark, "xml")
    t(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.format("xml").option("rowTag", "Problem").option("rootTag", "Problems").save(path)
    back = readers.xml(spark, path, "Problem", T.StructType([T.StructField("_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType())]))
    return back.withColumnRenamed("_id", "id")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY sha256('rows:' || p_partkey::VARCHAR)) AS position FROM part WHERE p_partkey % 5 = 0")
def s5_rows_by_index(spark, d):
    """The rows of a table that a manifest lists by index, in its order."""
    from siltstone.operators.ranks import ordinal

    p = t(spark, d, "part").select("p_partkey", "p_name")
    listed = ordinal(p.filter("p_partkey % 5 = 0").select("p_partkey", S.seeded_rank("rows", F.col("p_partkey")).alias("_h")), [], ["_h"], "position").select("p_partkey", (F.col("position") + 1).alias("position"))
    return readers.by_row_index(p, listed, "p_partkey")


@query("SELECT item_id, text, row_number() OVER (ORDER BY item_id DESC) AS position FROM benchmark")
def s6_fixture(spark, d):
    from siltstone.operators.ranks import ordinal

    items = t(spark, d, "benchmark").select("item_id", "text")
    manifest = ordinal(items.select("item_id", (-F.col("item_id")).alias("_o")), [], ["_o"], "position").select("item_id", (F.col("position") + 1).alias("position"))
    return readers.fixture(items, manifest, ["item_id"])


@query("SELECT corpus_id, prompt FROM (SELECT 'lines' AS corpus_id, text AS prompt FROM conversations WHERE role = 'user' UNION ALL SELECT 'table', text FROM benchmark)")
def s8_prior_prompts(spark, d):
    path = fresh_path(spark, "records")
    t(spark, d, "conversations").filter("role = 'user'").select("text").write.json(path)
    return readers.prompts(spark, {"lines": ("records", path, "text"), "table": ("table", f"{d}/benchmark.parquet", "text")})


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents), h AS (SELECT n, sha256(doc_id::VARCHAR) AS h FROM r), g AS (SELECT n // 4096 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM h GROUP BY 1),
k AS (SELECT sha256(string_agg(h, '' ORDER BY n)) AS h FROM g), e AS (SELECT CASE WHEN (SELECT count(*) FROM g) = 1 THEN (SELECT h FROM g) ELSE (SELECT h FROM k) END AS digest, (SELECT count(*) FROM documents) AS entries)
SELECT 'documents' AS dataset, 'r1' AS revision, entries, sha256('dataset=documents' || chr(10) || 'revision=r1' || chr(10) || digest || chr(10) || entries::VARCHAR) AS manifest_sha256 FROM e""")
def s9_manifest(spark, d):
    return writers.manifest(t(spark, d, "documents").select("doc_id"), "doc_id", "doc_id", dataset="documents", revision="r1")


@query("""WITH l AS (SELECT item_id AS k, to_json({'item_id': item_id, 'n': length(text)})::VARCHAR AS line FROM benchmark)
SELECT sha256(string_agg(sha256(line), '' ORDER BY k)) AS digest, count(*) AS lines, true AS again FROM l""")
def s10_digest_sink(spark, d):
    """The digest of the written lines; writing the same again is no error."""
    path = fresh_path(spark, "sink")
    rows = t(spark, d, "benchmark").select("item_id", F.length("text").alias("n"))
    digest = writers.jsonl(rows, path, "item_id")
    same = writers.new_or_identical(rows, path, "item_id") == digest
    return spark.read.text(path).agg(F.lit(digest).alias("digest"), F.count(F.lit(1)).alias("lines"), F.lit(same).alias("again"))


@query("SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM documents ORDER BY sha256('holdout:' || doc_id::VARCHAR), doc_id LIMIT 100)")
def s12_guarded(spark, d):
    """What is open without leave for the sealed partition."""
    p = S.partition(t(spark, d, "documents").select("doc_id"), "doc_id", "holdout", 100)
    return writers.guarded(p, "partition").select("doc_id")


@query("SELECT r_regionkey::INTEGER AS regionkey, sha256(r_regionkey::VARCHAR || ' ' || r_name || chr(10)) AS sha256 FROM region")
def s13_file_digests(spark, d):
    path = fresh_path(spark, "files")
    t(spark, d, "region").select(F.concat_ws(" ", F.col("r_regionkey").cast("string"), "r_name").alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    found = writers.file_digests(spark, path).filter("length > 0")
    return found.select(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("int").alias("regionkey"), "sha256")


@query("SELECT count(*) AS items, bool_and(true) AS escaped FROM benchmark")
def s14_review_packet(spark, d):
    """A review packet of the benchmark's items (a set that people read)."""
    rows = [{"id": r["item_id"], "text": r["text"] + " <b>"} for r in t(spark, d, "benchmark").orderBy("item_id").collect()]
    page, text = writers.review_html(rows, "Review"), writers.review_markdown(rows, "Review")
    return spark.createDataFrame([(min(page.count("<section"), text.count("\n## ")), "<b>" not in page)], "items long, escaped boolean")


@query("SELECT conv_id, turn, role FROM conversations")
def s15_label_blind(spark, d):
    return writers.label_blind(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["text"])


@query(f"SELECT item_id, text, len({sql_tokens('text')})::INTEGER AS n FROM benchmark")
def s16_question_export(spark, d):
    """Questions without labels, exported, read back and normalised."""
    from siltstone.functions.text import tokens

    path = fresh_path(spark, "export")
    writers.jsonl(writers.label_blind(t(spark, d, "benchmark").select("item_id", "text", F.lit("secret").alias("answer")), ["answer"]), path, "item_id")
    return readers.jsonl(spark, path, struct_of("item_id long, text string")).select("item_id", "text", F.size(tokens(F.col("text"))).alias("n"))
