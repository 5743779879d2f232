"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the hash's leading bits give its bin and
the rest its value, of which a bin keeps the least. Empty bins are filled by
optimal densification: bin i tries the bins h(i, 1), h(i, 2), ... of a 2-universal
hash and takes the first that is not empty, so every filled bin is an unbiased
sample with the least variance. A fingerprint is the low-order bits of all bins,
hashed with the bin's number and packed; the share of equal bins is corrected for chance agreement.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Texts, Words, mix64, ordered_by_id, partitions, shared_dir, shingle_hashes, table

BINS = 512  # a power of two
BITS = 4  # kept of each bin; divides 8
WORDS = 5


def bins_of(texts: Texts, bins: int = BINS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(values, full): the densified bins of each text, and whether the text has
    any shingle at all. Fewer than ``words`` words make one shingle."""
    n, shift = len(texts), np.uint64(64 - (bins.bit_length() - 1))
    values = np.full((n, bins), np.uint64(2**64 - 1))
    for a, b in texts.slices():
        hashes, doc = shingle_hashes(Words(texts.part(a, b)), words)
        np.minimum.at(values.reshape(-1), (doc + a) * bins + (hashes >> shift).astype(np.int64), hashes & np.uint64(2**55 - 1))
    empty = values == np.uint64(2**64 - 1)
    full = ~empty.all(1)
    row, place = np.nonzero(empty & full[:, None])
    original = ~empty
    attempt = np.uint64(1)
    while len(row):
        donor = (mix64(place.astype(np.uint64) * np.uint64(0x9E3779B1) + (attempt << np.uint64(32))) >> shift).astype(np.int64)
        hit = original[row, donor]
        values[row[hit], place[hit]] = values[row[hit], donor[hit]]
        row, place = row[~hit], place[~hit]
        attempt += np.uint64(1)
    return values, full


def pack(values: np.ndarray, full: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The low-order bits of each bin, packed; b'' for a text without words.

    The bits are taken after the bin's number is mixed in: bins that were filled
    with one value then agree by chance independently, as the correction of
    ``likeness`` supposes, however few shingles a text has."""
    with np.errstate(over="ignore"):
        own = mix64(np.arange(values.shape[1], dtype=np.uint64))
        low = (mix64(values ^ own) & np.uint64(2**bits - 1)).astype(np.uint8)
    each = 8 // bits
    packed = np.zeros((len(values), values.shape[1] // each), np.uint8)
    for k in range(each):
        packed |= low[:, k::each] << np.uint8(k * bits)
    return [p.tobytes() if f else b"" for p, f in zip(packed, full)]


def fingerprints(texts: Texts, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> list[bytes]:
    out = []
    for a, b in texts.slices(1 << 22):
        for c in range(a, b, 256):
            out += pack(*bins_of(texts.part(c, min(b, c + 256)), bins, words), bits)
    return out


def likeness(left: bytes, right: bytes, bits: int = BITS) -> float:
    """The bias-corrected share of equal bins, 0 to 1. Two texts without words
    are alike, one without and one with words are not."""
    if not left or not right:
        return float(left == right)
    differ = np.frombuffer(left, np.uint8) ^ np.frombuffer(right, np.uint8)
    each, mask = 8 // bits, np.uint8(2**bits - 1)
    equal = sum(int(((differ >> np.uint8(k * bits)) & mask == 0).sum()) for k in range(each)) / (len(differ) * each)
    chance = 2.0**-bits
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Adds ``fingerprint`` (hex) to ``docs``, replacing a column so named; a null
    or wordless text has ''. Equal word sequences, and repeated rows, have equal
    fingerprints; a very long text is read whole; other columns pass; no rows give
    none."""
    from pyspark.sql import types as T

    base = docs.select(*[c for c in docs.columns if c != "fingerprint"])
    at = base.columns.index(text)

    def run(batches):
        for batch in batches:
            marks = fingerprints(Texts.of(batch.column(at).cast(pa.string())), bins, bits, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.hex() for m in marks], pa.string())], [*batch.schema.names, "fingerprint"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("fingerprint", T.StringType())]))


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _spans(rows, most: int = 1 << 20):
    """Lists of (doc_id, text, next text) of about ``most`` characters from the
    rows (bucket, doc_id, text, ahead) of a sorted partition."""
    out, size, last, extra = [], 0, None, False
    for bucket, doc_id, text, ahead in rows:
        if last is not None and (bucket != last[0] or not extra):
            out.append((last[1], last[2], text if bucket == last[0] else None))
            size += len(last[2])
            last = None
        if ahead:
            extra = True  # only the first of what lies ahead is wanted
        else:
            last, extra = (bucket, doc_id, text), False
        if size > most:
            yield out
            out, size = [], 0
    if last is not None:
        out.append((last[1], last[2], None))
    if out:
        yield out


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter
    replaced by the beginning of the next document (see the query's contract).

    Documents are range-partitioned by id in one shuffle; each range also gets
    the first document of the next range, and the last of all the first of all.
    Null texts are empty; null ids come first; equal ids follow by text; a lone
    document is its own next. Other columns are ignored; no rows give none."""
    shared_dir(docs.sparkSession)
    parts = max(8, 2 * partitions(docs.sparkSession))
    least = docs.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    head = docs.filter(F.col("doc_id").isNull() if least[1] else F.col("doc_id") == least[0])
    first = head.select("text").orderBy("text").limit(1).collect() if least[1] is not None else []
    start = (first[0]["text"] or "") if first else ""
    rows = ordered_by_id(docs, parts, lookahead=True)

    def run(batches):
        def flat():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()], batch.column(4).to_pylist())

        for span in _spans(flat()):
            ids, texts, nexts = [s[0] for s in span], [s[1] for s in span], [start if s[2] is None else s[2] for s in span]
            edited = []
            for t, n in zip(texts, nexts):
                k = len(t) // 4
                edited.append((t[:len(t) - k] + n[:k]).encode("utf-8"))
            raw = [t.encode("utf-8") for t in texts]
            # a document's next is mostly the following one of the span
            marks = fingerprints(Texts.of_list([*raw, nexts[-1].encode("utf-8")]))
            other = fingerprints(Texts.of_list(edited))
            after = [marks[i + 1] if i + 1 < len(span) and nexts[i] is texts[i + 1] else None for i in range(len(span))]
            after[-1] = marks[-1]
            odd = [i for i, m in enumerate(after) if m is None]
            for i, m in zip(odd, fingerprints(Texts.of_list([nexts[i].encode("utf-8") for i in odd]))):
                after[i] = m
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([m.hex() for m in marks[:-1]]), pa.array([m.hex() for m in other]),
                pa.array([likeness(a, b) for a, b in zip(marks, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(marks, after)], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, NEIGHBOURS)


def op8_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
