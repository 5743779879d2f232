"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens lie in one linked list, whose ends are marked so no
pair spans two pre-tokens. Every mergeable pair is put, by the position of its
left part, into the bucket of its merge rank; a bitmap of three levels says
which buckets hold positions, so find-first-set gives the next rank in three
steps whatever the number of pairs. Positions of a bucket are taken from left to
right; an entry is stale, and skipped, if its pair changed since. All work is in
proportion to the bytes and merges, so a pre-token of millions of bytes costs no
more a byte than a short one.

Pre-tokens are encoded once for each worker while a bounded memory holds them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import cache, let_go, table

#: Bytes of pre-tokens and ids that a worker remembers, about.
MEMORY = 120 << 20
#: Pairs of ids whose rank a worker remembers, some hundred bytes each.
PAIRS = 300_000


class RankQueue:
    """Positions by rank; ranks below 64 ** 3."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.top, self.mid, self.low = 0, [0] * 64, [0] * 4096

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        else:
            bucket.append(position)

    def fill(self, ranks: np.ndarray) -> None:
        """Pushes every position whose rank is not negative; the queue is empty."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        for rank, part in zip(found.tolist(), np.split(at, first[1:])):
            self.push(rank, -1)
            self.buckets[rank][:] = part.tolist()

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions in ascending order; (-1, []) if none."""
        if not self.top:
            return -1, []
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) + (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = (b << 6) + (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Vocabulary:
    """Ranks of byte sequences, and the pairs of ids that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes}
        if max(ranks.values()) >= 64**3:
            raise ValueError("ranks of 262,144 and over don't fit the queue's three levels")
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        if min(self.single) < 0:
            raise ValueError("every byte needs a rank")
        self._pairs: dict[int, int] = {}
        # the rank of any two bytes, or -1
        self._bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self._single = np.array(self.single, np.int32)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, left: int, right: int) -> int:
        """The rank of two ids' joined bytes, or -1."""
        key = left << 18 | right
        rank = self._pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.bytes[left] + self.bytes[right], -1)
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = rank
        return rank

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; all share one list and one queue."""
        out: list[list[int] | None] = [None] * len(pieces)
        todo = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = [rank]
            elif piece:
                todo.append(k)
            else:
                out[k] = []
        if not todo:
            return out
        data = np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)
        ends = np.cumsum([len(pieces[k]) for k in todo], dtype=np.int64)
        starts = [0, *ends.tolist()][:-1]
        ids = self._single[data].tolist()
        links = np.arange(1, len(data) + 1)
        links[ends - 1] = -1
        following = links.tolist()
        links = np.arange(-1, len(data) - 1)
        links[starts] = -1
        previous = links.tolist()
        # the rank of each position's pair; an entry of another rank is stale
        ranks = np.full(len(data), -1, np.int32)
        ranks[:-1] = self._bytes[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        current = ranks.tolist()
        queue, merged, known = RankQueue(), self.merged, self._pairs.get
        queue.fill(ranks)
        push, bucket_of = queue.push, queue.buckets.get
        while True:
            target, positions = queue.pop()
            if target < 0:
                break
            for spot, i in enumerate(positions):
                if current[i] != target:
                    continue  # stale
                j = following[i]
                ids[i], ids[j] = target, -1
                current[j] = -1
                following[i] = k = following[j]
                least = target
                if k >= 0:
                    previous[k] = i
                    rank = known(target << 18 | ids[k])
                    if rank is None:
                        rank = merged(target, ids[k])
                    current[i] = rank
                    if rank >= 0:
                        if (bucket := bucket_of(rank)) is None:
                            push(rank, i)
                        else:
                            bucket.append(i)
                        if rank < least:
                            least = rank
                else:
                    current[i] = -1
                h = previous[i]
                if h >= 0:
                    rank = known(ids[h] << 18 | target)
                    if rank is None:
                        rank = merged(ids[h], target)
                    current[h] = rank
                    if rank >= 0:
                        if (bucket := bucket_of(rank)) is None:
                            push(rank, h)
                        else:
                            bucket.append(h)
                        if rank < least:
                            least = rank
                if least < target:
                    # a lesser rank came up: the rest of this bucket waits
                    for rest in positions[spot + 1:]:
                        push(target, rest)
                    break
        for k, start in zip(todo, starts):
            found, i = [], start
            while i >= 0:
                found.append(ids[i])
                i = following[i]
            out[k] = found
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


#: Code points below this are split by ``re`` with classes written out.
NARROW = 0x250


def splitter(pattern: str):
    """A function that gives the matches of ``pattern`` in a text as the regex
    library does. Texts of narrow characters are split by ``re``, which is quicker,
    with the classes for letters, numbers and whitespace listed from that library;
    where the pattern has other escapes, none are."""
    import regex

    whole = regex.compile(pattern).findall
    listed = {}
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        is_one = regex.compile(name).match
        runs: list[list[int]] = []
        for c in range(NARROW):
            if is_one(chr(c)):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        listed[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    out, inside = [], False
    for part in re.findall(r"\\p\{[^}]*\}|\\.|.", pattern, re.S):
        if part[0] == "\\":
            if part not in listed:
                return whole
            part = listed[part] if inside else f"[{listed[part]}]"
        elif part == "[":
            if inside:
                return whole
            inside = True
        elif part == "]":
            inside = False
        elif inside and part in "&|~-" or part == "." or part == "(" and inside:
            return whole
        out.append(part)
    quick = re.compile("".join(out)).findall
    wide = re.compile(f"[^\\x00-\\u{NARROW - 1:04x}]").search

    def split(text: str) -> list[str]:
        return whole(text) if not text.isascii() and wide(text) else quick(text)

    return split


class Seen(dict):
    """Numbers by pre-token, in the order in which they came up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Splits texts by a pattern and encodes the pre-tokens. Holds the ids of
    pre-tokens seen before up to ``memory`` bytes, then begins anew."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, memory: int = MEMORY):
        self.vocabulary, self.memory = vocabulary, memory
        self.split = splitter(pattern)
        self.seen, self.forms, self.held = Seen(), [], 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for group in _groups(texts):
            if self.held > self.memory:
                self.seen, self.forms, self.held = Seen(), [], 0
            seen, forms = self.seen, self.forms
            found = [list(map(seen.__getitem__, self.split(t))) for t in group]
            new = list(islice(reversed(seen), len(seen) - len(forms)))[::-1]
            for p, ids in zip(new, self.vocabulary.encode_all([p.encode("utf-8") for p in new])):
                forms.append(tuple(ids))
                self.held += 220 + len(p) + 8 * len(ids)
            out += [list(chain.from_iterable(map(forms.__getitem__, x))) for x in found]
        return out


def _groups(texts: list[str], most: int = 1 << 21):
    """Consecutive groups of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


_encoders: dict[tuple, Encoder] = cache()


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a rank file that is installed on every node."""
    let_go(_encoders)
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) to ``docs``, or with ``digests`` n_tokens,
    ids_sha256 and decoded_sha256 (of the bytes decoded again from the ids).
    Columns so named are replaced, others pass. A null or empty text has no ids;
    special tokens' strings are ordinary text; rows are independent, so order,
    repeats and an empty table need no care."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    base = docs.select(*[c for c in docs.columns if c not in {f.name for f in added}])
    at = base.columns.index("text")

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column(at)
            first = 0
            for group in _groups([t or "" for t in column.to_pylist()]):
                ids = coder.encode(group)
                if digests:
                    more = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(" ".join(map(coder.vocabulary.names.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(coder.vocabulary.decode(x)).hexdigest() for x in ids], pa.string())]
                else:
                    more = [pa.array(ids, pa.list_(pa.int32()))]
                own = batch.slice(first, len(group))
                first += len(group)
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*batch.schema.names, *[f.name for f in added]])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to rows with an array of ids (null: empty); an
    id that the vocabulary lacks is an error."""
    base = rows.select(*[c for c in rows.columns if c != "decoded"])
    at = base.columns.index(ids)

    def run(batches):
        words = Vocabulary.load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words.decode(x or ()) for x in batch.column(at).to_pylist()], pa.binary())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op2_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, in a column that replaces one named ids.

    Null and empty texts have no ids; repeated rows and very long texts are encoded
    like any; other columns pass; no rows give none."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
