"""Helpers shared by the training-data operators: shared storage, Arrow text
access, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word definition ``[^\x20\x09-\x0D]+``, as bytes.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)
_caches: list[dict] = []
_swept = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that
    is unset and the session runs on one machine (tests), a fresh local one that
    is then set. On a cluster without one it raises: other machines would not see
    a local folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends: a
    lazy result may be read until then."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what was written at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, kind: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the
    lineage so that later reads survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed; the shuffle files that this took are removed at once,
    where Spark would keep them until the driver happens to collect its garbage:
    with many steps they add up on disk. What is read later is the checkpoint."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        # a frame keeps the setting that it was made under
        return df.select("*").checkpoint()
    finally:
        conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cache() -> dict:
    """A dict for what a worker keeps between tasks of one operator, emptied when
    it takes up another's."""
    _caches.append({})
    return _caches[-1]


def let_go(keep: dict | None = None, pause: float = 0.0) -> None:
    """Gives back what this worker holds without need: the caches but for ``keep``,
    and free memory that the allocators hold, for that at most once in ``pause``
    seconds. Workers are used again by the stages that follow, and what one left
    would stand beside what the next one needs."""
    global _swept
    for held in _caches:
        if held is not keep:
            held.clear()
    if time.monotonic() - _swept >= pause:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _swept = time.monotonic()


def tidy_batches(work):
    """``work`` over Arrow batches, with ``let_go`` before and after it."""
    def run(batches):
        let_go()
        yield from work(batches)
        let_go()

    return run


def tidy_group(work):
    """``work`` on one group, with ``let_go`` after it."""
    def run(group):
        out = work(group)
        let_go(pause=1.0)
        return out

    return run


def tidy_pair(work):
    """``work`` on the two groups of a cogroup, with ``let_go`` after it."""
    def run(left, right):
        out = work(left, right)
        let_go(pause=1.0)
        return out

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 32))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
    return _powers


class Texts:
    """UTF-8 texts as one byte array with document offsets (null: empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offs, data = column.buffers()
        kind = np.int64 if wide else np.int32
        offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[offsets[0]:offsets[-1]], offsets - offsets[0])

    @classmethod
    def of_list(cls, texts: list[bytes]) -> "Texts":
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        return cls(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def slices(self, most: int = 2 << 20):
        """Consecutive (first, last) document ranges of about ``most`` bytes."""
        first, n = 0, len(self)
        while first < n:
            last = int(np.searchsorted(self.offsets, self.offsets[first] + most, "right")) - 1
            last = min(n, max(last, first + 1))
            yield first, last
            first = last

    def part(self, first: int, last: int) -> "Texts":
        offs = self.offsets[first:last + 1]
        return Texts(self.data[offs[0]:offs[-1]], offs - offs[0])


class Words:
    """The words of some texts: byte spans, 64-bit hashes, and the index of each
    document's first word (``first`` has one entry more than documents)."""

    def __init__(self, texts: Texts, lower: bool = False):
        data, offs = texts.data, texts.offsets
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + np.uint8(32), data)
        solid = ~SEPARATORS[data]
        before = np.empty(len(solid), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        before[offs[:-1][offs[:-1] < len(solid)]] = False
        start = solid & ~before
        after = np.empty(len(solid), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        inner = offs[1:][offs[1:] > 0] - 1
        after[inner] = False
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.data = data
        lengths = self.ends - self.starts
        if not len(lengths):
            self.hashes = np.zeros(0, np.uint64)
            return
        compact = data[solid]
        begin = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=begin[1:])
        at = np.arange(len(compact)) - np.repeat(begin, lengths)
        powers = _power_table(int(lengths.max()))
        with np.errstate(over="ignore"):
            self.hashes = mix64(np.add.reduceat((compact.astype(np.uint64) + np.uint64(1)) * powers[at], begin))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_hashes(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each k-word shingle; a document of 1 to k-1 words has
    its whole sequence as one shingle when ``short``."""
    h, first, counts = words.hashes, words.first, words.counts
    mult = seeds(k, 77) | np.uint64(1)
    n = len(h)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if len(out) else 0):
            out += h[j:n - k + 1 + j] * mult[j]
        docs = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
        begin = np.repeat(first[:-1], np.maximum(counts - k + 1, 0))
        kept = np.maximum(counts - k + 1, 0)
        skip = np.zeros(len(kept), np.int64)
        np.cumsum(kept[:-1], out=skip[1:])
        where = begin + np.arange(len(begin)) - np.repeat(skip, kept)
        hashes = mix64(out[where]) if len(where) else np.zeros(0, np.uint64)
        if short:
            few = np.flatnonzero((counts > 0) & (counts < k))
            if len(few):
                more = np.zeros(len(few), np.uint64)
                for i, d in enumerate(few):
                    part = h[first[d]:first[d + 1]]
                    more[i] = np.add.reduce(part * mult[:len(part)]) + np.uint64(len(part))
                hashes = np.concatenate([hashes, mix64(more ^ np.uint64(0x5157))])
                docs = np.concatenate([docs, few])
                order = np.argsort(docs, kind="stable")
                hashes, docs = hashes[order], docs[order]
    return hashes, docs


def ordered_by_id(docs: DataFrame, parts: int, lookahead: bool) -> DataFrame:
    """(bucket, ord, doc_id, text, ahead): every row of ``docs`` dealt to
    ``parts`` ranges of doc_id of near equal rows and sorted within; null ids
    come first, equal ids are ordered by text. With ``lookahead`` the first rows
    of each range are also given, marked ``ahead``, to the range before it.

    Range bounds come from quantile sketches of doc_id over all rows; what
    reaches the driver is one bound and one smallest id per range."""
    from pyspark.ml.feature import Bucketizer

    low = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("ord", F.coalesce("doc_id", F.lit(low))).withColumn("_x", F.col("ord").cast("double"))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).stat.approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    if cuts:
        split = [-float("inf"), *cuts, float("inf")]
        keyed = Bucketizer(splits=split, inputCol="_x", outputCol="_b").transform(keyed).withColumn("bucket", F.col("_b").cast("int"))
    else:
        keyed = keyed.withColumn("bucket", F.lit(0))
    keyed = keyed.select("bucket", "ord", "doc_id", "text")
    if not lookahead:
        return _dealt(keyed.withColumn("ahead", F.lit(False)), parts)
    heads = sorted((r[0], r[1]) for r in keyed.groupBy("bucket").agg(F.min("ord")).collect())
    links = [(b, o, heads[i - 1][0]) for i, (b, o) in enumerate(heads) if i]
    if not links:
        return _dealt(keyed.withColumn("ahead", F.lit(False)), parts)
    small = docs.sparkSession.createDataFrame([(o, p) for _, o, p in links], "ord long, prev int")
    both = keyed.join(F.broadcast(small), "ord", "left").select(
        F.explode(F.when(F.col("prev").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")))).otherwise(
            F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.struct(F.col("prev").alias("bucket"), F.lit(True).alias("ahead"))))).alias("to"),
        "ord", "doc_id", "text")
    return _dealt(both.select("to.bucket", "ord", "doc_id", "text", "to.ahead"), parts)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.select("bucket", "ord", "doc_id", "text", "ahead").repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "ord", "text")
