"""MinHash near-dedup by min-max hashing.

Under each of PERMUTATIONS hash functions a document keeps the least and the
greatest value of its shingles: two unbiased samples for one evaluation. Bands of
ROWS of these values (minimum and maximum of ROWS / 2 functions) put documents
into buckets; two documents with Jaccard similarity s meet in one of BANDS with
probability about 1 - (1 - s ** ROWS) ** BANDS: all but one in a million at 0.8.
Of small sets minimum and maximum are not independent: two sets of four and five
shingles that share four agree in both with 0.6, not 0.64, and all but 14 in a
million meet.

Documents with equal shingle sets are one class, found by a 128-bit hash of the
set. Class representatives of a bucket are first linked to its least member: a
star, not all pairs; the text of a lead that many members ask for goes to several
tasks, STAR members a task. Every candidate is confirmed on full sets. Where a bucket
still holds several components, signatures are compared across them in blocks
of at most GRID members; a document of the smaller component that may reach the
threshold (five standard deviations below it) with a member of the larger is then
compared exactly with all of that component's members, block by block (of at most
GRID texts, and about BYTES of text) through an index of their shingles, and one
link is kept. No link between components is
lost, and no table of pairs is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import components as C
from siltstone.llm.common import Texts, Words, checkpointed, mix64, partitions, seeds, shared_dir, shingle_hashes, table, tidy_batches, tidy_group, written

ROWS, BANDS = 6, 46
PERMUTATIONS = ROWS * BANDS // 2
GRID, STAR = 1024, 1024
BYTES = 8 << 20
_ADDED = [T.StructField("_ref", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_sig", T.BinaryType())]


def sets_of(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, by document, then hash.

    Texts are hashed in slices: the work arrays take some thirty bytes for a byte
    of text, what is kept of it about three."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in texts.slices(1 << 20):
        hashes, doc = shingle_hashes(Words(texts.part(a, b), lower=True), words)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        found.append((hashes[keep], doc[keep] + a))
    hashes, doc = map(np.concatenate, zip(*found))
    return hashes, doc


def signatures(hashes: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """(documents, PERMUTATIONS, 2): least and greatest values; 0 for no set."""
    out = np.zeros((count, PERMUTATIONS, 2), np.uint64)
    if len(doc):
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        has = doc[begin]
        with np.errstate(over="ignore"):
            for p, m in enumerate(seeds(PERMUTATIONS, 5) | np.uint64(1)):
                value = hashes * m
                value ^= value >> np.uint64(32)
                out[has, p, 0] = np.minimum.reduceat(value, begin)
                out[has, p, 1] = np.maximum.reduceat(value, begin)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for j in range(ROWS):
        key = mix64(key ^ rows[:, :, j])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with a row number, bytes, set size, set hash, band keys and the low
    byte of every signature value."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *_ADDED])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = Texts.of(batch.column(at))
            for a, b in texts.slices(1 << 20):
                n = b - a
                hashes, doc = sets_of(texts.part(a, b), words)
                size = np.bincount(doc, minlength=n)
                sig = signatures(hashes, doc, n)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix64(hashes), mix64(hashes ^ np.uint64(0xABCDEF))], 1)], 1)
                    ends = np.cumsum(size)
                    one, two = total[:, ends] - total[:, ends - size]
                keys, low = _bands(sig), (mix64(sig) & np.uint64(255)).astype(np.uint8).reshape(n, -1)
                none = size == 0
                offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(a, n).columns, pa.array(number + np.arange(n)), pa.array(np.diff(texts.offsets[a:b + 1])), pa.array(size.astype(np.int64)),
                    pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~none].reshape(-1))),
                    pa.array([None if z else s.tobytes() for z, s in zip(none, low)], pa.binary()),
                ], schema=pa.schema([*batch.schema, ("_ref", pa.int64()), ("_b", pa.int64()), ("_n", pa.int64()), ("_h1", pa.int64()), ("_h2", pa.int64()), ("_keys", pa.list_(pa.int64())), ("_sig", pa.binary())]))
                number += n

    return docs.mapInArrow(tidy_batches(run), schema)


def _squeezed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ref, packed): the compressed texts of the wanted row numbers."""
    def run(batches):
        for batch in batches:
            packed = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["ref", "packed"])

    return checkpointed(rows.select("_ref", "text").join(wanted.select(F.col("ref").alias("_ref")).distinct(), "_ref", "left_semi").mapInArrow(tidy_batches(run), "ref long, packed binary"))


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def confirmed(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose full sets reach the similarity; equal
    (a, lot) are compared in one place, so that a hot ``a`` is dealt by ``lot``."""
    texts = _squeezed(rows, pairs.select(F.col("a").alias("ref")).unionAll(pairs.select(F.col("b").alias("ref"))))
    leads = pairs.select("a", "lot").distinct().join(texts.select(F.col("ref").alias("a"), F.col("packed").alias("left")), "a")
    full = pairs.join(leads, ["a", "lot"]).join(texts.select(F.col("ref").alias("b"), F.col("packed").alias("right")), "b").select("a", "b", "left", "right")

    def check(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                own = batch.slice(k, 64)
                n = own.num_rows
                both = [sets_of(Texts.of_list([_plain(x) for x in own.column(c).to_pylist()]), words) for c in (2, 3)]
                size = sum(np.bincount(d, minlength=n) for _, d in both)
                h, d = (np.concatenate(x) for x in zip(*both))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                same = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=n)
                ok = 100 * same >= percent * (size - same)
                yield own.select(["a", "b"]).filter(pa.array(ok))

    return full.mapInArrow(tidy_batches(check), "a long, b long")


def _indexed(words: int, percent: int):
    """Compares the asking documents of a task exactly with a block of members:
    for each, its link of most shared shingles, if any reaches the similarity."""
    def run(group: pa.Table) -> pa.Table:
        refs = group.column("ref").to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        hashes, doc = sets_of(Texts.of_list([_plain(x) for x in group.column("packed").to_pylist()]), words)
        size = np.bincount(doc, minlength=len(refs))
        ends = np.cumsum(size)
        member = ~asks[doc]
        order = np.argsort(hashes[member], kind="stable")
        index, owner = hashes[member][order], doc[member][order]
        a_out, b_out = [], []
        for i in np.flatnonzero(asks):
            own = hashes[ends[i] - size[i]:ends[i]]
            lo, hi = np.searchsorted(index, own), np.searchsorted(index, own, "right")
            n = hi - lo
            if not n.sum():
                continue
            hits = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            same = np.bincount(hits, minlength=len(refs))
            good = np.flatnonzero((same > 0) & (100 * same >= percent * (size + size[i] - same)))
            if len(good):
                j = good[np.argmax(same[good])]
                a_out.append(min(refs[i], refs[j]))
                b_out.append(max(refs[i], refs[j]))
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _across(percent: int):
    """Compares the signatures of a bucket's block across components."""
    values = 2 * PERMUTATIONS
    s = percent / 100
    least = s - 5 * (s * (1 - s) / values) ** 0.5
    needed = values * (least + (1 - least) / 256)

    def run(group: pa.Table) -> pa.Table:
        refs, comps = group.column("ref").to_numpy(), group.column("comp").to_numpy()
        side, mass = group.column("side").to_numpy(), group.column("mass").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(refs), values)
        _, which, counts = np.unique(comps, return_inverse=True, return_counts=True)
        minor = which != counts.argmax()
        asking, asked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(minor):
            other = comps != comps[i]
            if side[i] >= 0:
                other &= side != side[i]
            j = np.flatnonzero(other)
            j = j[(sig[j] == sig[i]).sum(1) >= needed] if len(j) else j
            # the document of the lighter component asks the heavier one
            asks = (mass[i] < mass[j]) | ((mass[i] == mass[j]) & (comps[i] > comps[j]))
            asking += [np.where(asks, refs[i], refs[j])]
            asked += [np.where(asks, comps[j], comps[i])]
        found = np.unique(np.stack([np.concatenate(asking), np.concatenate(asked)], 1), axis=0)
        return pa.table({"ref": found[:, 0], "comp": found[:, 1]})

    return run


def labelled(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with doc_id and text) as written with row numbers _ref; and
    (_ref, doc_id, _n, _comp): set sizes, and components as the least row number."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = written(signed(docs, words), "minmax")
    classes = checkpointed(rows.filter("_n > 0").groupBy("_h1", "_h2", "_n").agg(F.min("_ref").alias("_rep")))
    reps = classes.select(F.col("_rep").alias("_ref"))
    entries = rows.select("_ref", "_keys").join(reps, "_ref", "left_semi").select(F.explode("_keys").alias("key"), F.col("_ref").alias("ref"))
    shared = entries.groupBy("key").agg(F.min("ref").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    bucketed = checkpointed(entries.join(shared, "key"))
    star = bucketed.filter("ref <> lead").groupBy(F.col("lead").alias("a"), F.col("ref").alias("b")).agg(F.max("size").alias("size"))
    star = checkpointed(star.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / STAR)).alias("lot")))
    first = checkpointed(confirmed(star, rows, words, percent))
    linked = C.stars(first)
    # buckets that still hold several components
    member = bucketed.select("ref").distinct().join(C.labels(linked).withColumnRenamed("node", "ref"), "ref", "left").select("ref", F.coalesce("label", "ref").alias("comp"))
    member = member.join(rows.select(F.col("_ref").alias("ref"), F.col("_b").alias("bytes")), "ref")
    # blocks that a component's texts make
    blocks = lambda n, b: F.greatest(F.ceil(n / GRID), F.ceil(b / BYTES), F.lit(1)).cast("int")
    mass = member.groupBy("comp").agg(F.count(F.lit(1)).alias("mass"), F.sum("bytes").alias("_b")).select("comp", "mass", blocks(F.col("mass"), F.col("_b")).alias("lots"))
    member = checkpointed(member.join(mass, "comp"))
    placed = checkpointed(bucketed.select("key", "ref", "size").join(member, "ref"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select("key")
    open_ = placed.filter("size > 2").join(mixed, "key").join(rows.select(F.col("_ref").alias("ref"), F.col("_sig").alias("sig")), "ref")
    # a large bucket is compared block against block; a block with itself has
    # one side, two blocks have their own
    cells = F.ceil(F.col("size") / GRID).cast("int")
    own = F.pmod(F.xxhash64("ref"), cells).cast("int")
    grid = open_.select("key", "ref", "comp", "mass", "sig", own.alias("own"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"))
    grid = grid.select("key", "ref", "comp", "mass", "sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    ask = checkpointed(grid.groupBy("key", "lo", "hi").applyInArrow(tidy_group(_across(percent)), "ref long, comp long").distinct())
    asks = ask.join(member.select("ref", "bytes"), "ref").groupBy("comp").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    asked = checkpointed(asks.join(mass, "comp").select("comp", "lots", blocks(F.col("_n"), F.col("_b")).alias("ask_lots")))
    texts = _squeezed(rows, ask.select("ref").unionAll(member.join(asked.select("comp"), "comp", "left_semi").select("ref")))
    spread = lambda side, mine, theirs: side.select("comp", "ref", F.pmod(F.xxhash64("ref"), F.col(mine)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("theirs"))
    askers = spread(ask.join(asked, "comp"), "ask_lots", "lots").select("comp", "ref", F.col("theirs").alias("block"), F.col("mine").alias("lot"), F.lit(True).alias("asks"))
    members = spread(member.select("ref", "comp").join(asked, "comp"), "lots", "ask_lots").select("comp", "ref", F.col("mine").alias("block"), F.col("theirs").alias("lot"), F.lit(False).alias("asks"))
    second = checkpointed(askers.unionAll(members).join(texts, "ref").groupBy("comp", "block", "lot").applyInArrow(tidy_group(_indexed(words, percent)), "a long, b long").distinct())
    # the links so far are kept as stars, which take few rounds
    final = C.components(linked.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(second))
    comp = classes.join(final.select(F.col("node").alias("_rep"), F.col("label").alias("_comp")), "_rep", "left").select("_h1", "_h2", "_n", F.coalesce("_comp", "_rep").alias("_comp"))
    # without texts, so a class of very many equal documents moves few bytes
    narrow = rows.select("_ref", "doc_id", "_n", "_h1", "_h2").join(comp, ["_h1", "_h2", "_n"], "left").select("_ref", "doc_id", "_n", F.coalesce("_comp", "_ref").alias("_comp"))
    return rows.drop("_b", "_n", "_keys", "_sig", "_h1", "_h2"), narrow


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    A document's set is its distinct ``words``-word shingles after lower-casing
    A-Z; fewer words make one shingle; without words, or null, the set is empty
    and the document links with nothing. component_id is the least doc_id of the
    component; null ids are never the least unless all are null. Rows that repeat
    an id are all kept if the id is the component's. Other columns are ignored;
    an empty table gives no rows; a very long text is compared whole."""
    _, rows = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, percent)
    least = rows.groupBy("_comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "_comp").select("doc_id", F.col("_n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that of the
    least doc_id, of equal ids the one read first; null ids come last. Null and
    wordless texts are like no other and stay; columns may have any names; an
    empty table gives no rows; a very long text is compared whole."""
    clash = {c: f"_{'own' * (1 + max(map(len, docs.columns)))}_{k}" for k, c in enumerate(docs.columns) if c in {"_ref", "_b", "_n", "_h1", "_h2", "_keys", "_sig", "_comp"}}
    rows, found = labelled(docs.withColumnsRenamed(clash), words, percent)
    least = found.groupBy("_comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_ref").alias("r"))).alias("_m")).select(F.col("_m.r").alias("_ref"))
    return rows.join(least, "_ref", "left_semi").select(*[clash.get(c, c) for c in docs.columns]).toDF(*docs.columns)


def op9_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8); nulls,
    ties, empty tables, clashing columns and very long texts as ``one_of_each``."""
    return one_of_each(docs)


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
