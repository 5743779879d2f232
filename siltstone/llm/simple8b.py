"""Token-id files in Simple-8b word-aligned coding.

Each 64-bit word holds a 4-bit selector and as many ids as fit the selector's
width; a value of 60 bits or more is an escape word followed by the raw value.
Ids are coded in blocks of BLOCK, whose word offsets are kept, so that blocks can
be decoded apart and all words of a selector at once.

A file (little-endian): the magic, the counts of ids, documents, blocks and words
as 64-bit integers, the words, the blocks' offsets, then the documents' ids,
null flags and token counts. Documents are in ascending id order over the files
in order of their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Texts, fresh_path, ordered_by_id, partitions, table

MAGIC = b"S8BIDS01"
BLOCK = 4096
#: Ids after which a file is closed.
FILE_IDS = 8 << 20
#: Ids in a word and their width, by selector from 1; 0 is the escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([1, *[n for n, _ in SELECTORS]])
_WIDEST = 1 << 60


#: Zeros kept behind each block, so that a word's ids never reach the next one.
_GAP = SELECTORS[0][0]
_ROW = BLOCK + _GAP


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of unsigned ids."""
    words, sizes = [], []
    for at in range(0, len(ids), BLOCK * 512):
        w, s = _pack_blocks(ids[at:at + BLOCK * 512])
        words.append(w)
        sizes.append(s)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.concatenate(sizes)
    return np.concatenate(words), np.cumsum(size) - size


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if int(ids.max()) < 1 << 16:
        return _SHORT[ids.view(np.int64)]
    out = np.zeros(len(ids), np.uint8)
    for shift in (0, 16, 32, 48):
        part = (ids >> np.uint64(shift)).astype(np.uint16)
        out = np.where(part > 0, _SHORT[part] + np.uint8(shift), out)
    return out


def _selectors(flat: np.ndarray) -> np.ndarray:
    """The selector at each place: the first, from the fullest, that its ids fit;
    0 where none does."""
    wide = _widths(flat)
    pick = np.full(len(flat), len(SELECTORS) + 1, np.uint8)
    most, size = wide, 1  # the widest of the next ``size`` ids
    for n, bits in reversed(SELECTORS):
        while size < n:
            step = min(size, n - size)
            longer = most.copy()
            np.maximum(most[:-step], most[step:], out=longer[:-step])
            most, size = longer, size + step
        fits = most <= bits
        if not fits.any():
            break  # a fuller selector fits even less
        pick -= fits  # what fits a fuller selector fits all others
    pick[pick > len(SELECTORS)] = 0
    return pick


def _pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blocks = -(-len(ids) // BLOCK)
    rows = np.zeros((blocks, _ROW), np.uint64)
    whole = len(ids) // BLOCK
    rows[:whole, :BLOCK] = ids[:whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        rows[whole, :len(ids) - whole * BLOCK] = ids[whole * BLOCK:]
    flat = rows.ravel()
    pick = _selectors(flat)
    held = _COUNTS.astype(np.uint8)[pick]
    at = np.arange(blocks) * _ROW
    ends = at + BLOCK
    ends[-1] = at[-1] + len(ids) - BLOCK * (blocks - 1)
    chosen = np.zeros(len(flat), bool)
    while len(at):
        chosen[at] = True
        at = at + held[at]
        go = at < ends
        if not go.all():
            at, ends = at[go], ends[go]
    place = np.flatnonzero(chosen)
    pick = pick[place]
    length = 1 + (pick == 0)
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint64)
    escaped = np.flatnonzero(pick == 0)
    out[start[escaped] + 1] = flat[place[escaped]]
    for s in np.unique(pick[pick > 0]):
        n, bits = SELECTORS[s - 1]
        own = np.flatnonzero(pick == s)
        first = place[own]
        word = np.full(len(own), np.uint64(int(s)) << np.uint64(60))
        if bits:
            for k in range(n):
                word |= flat[first + k] << np.uint64(k * bits)
        out[start[own]] = word
    return out, np.bincount(place // _ROW, length, blocks).astype(np.int64)


def unpack(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of all blocks (their word offsets) again."""
    if not total:
        return np.zeros(0, np.uint64)
    select = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    while True:  # the word after an escape is a value, whatever its bits
        found = np.zeros(len(words), bool)
        escapes = np.flatnonzero((select == 0) & ~raw)
        if not len(escapes):
            break
        # of neighbouring would-be escapes every second is a value
        breaks = np.flatnonzero(np.diff(escapes, prepend=-2) != 1)
        rank = np.arange(len(escapes)) - np.repeat(breaks, np.diff(np.append(breaks, len(escapes))))
        found[escapes[rank % 2 == 0] + 1] = True
        if (found == raw).all():
            break
        raw = found
    count = np.where(raw, 0, _COUNTS[select])
    # a block's last word may hold fewer ids than its selector says
    before = np.cumsum(count) - count
    shift = np.arange(len(offsets)) * _ROW - before[offsets]
    base = before + np.repeat(shift, np.diff(np.append(offsets, len(words))))
    out = np.zeros(len(offsets) * _ROW, np.uint64)
    for s in np.unique(select[~raw]):
        own = np.flatnonzero((select == s) & ~raw)
        if s == 0:
            out[base[own]] = words[own + 1]
            continue
        n, bits = SELECTORS[s - 1]
        if not bits:
            continue
        mask, at, word = np.uint64((1 << bits) - 1), base[own], words[own]
        for k in range(n):
            out[at + k] = (word >> np.uint64(k * bits)) & mask
    return out.reshape(-1, _ROW)[:, :BLOCK].ravel()[:total]


def to_bytes(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(ids), len(keys), len(offsets), len(words)], "<i8")
    return b"".join([MAGIC, head.tobytes(), words.astype("<u8").tobytes(), offsets.astype("<i8").tobytes(), keys.tobytes(), null.tobytes(), np.array(counts, "<i8").tobytes()])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n, docs, blocks, nwords = np.frombuffer(data, "<i8", 4, 8).tolist()
    at = 40
    words = np.frombuffer(data, "<u8", nwords, at)
    at += 8 * nwords
    offsets = np.frombuffer(data, "<i8", blocks, at)
    at += 8 * blocks
    keys = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist())], counts, unpack(words, offsets, n)


#: The pattern, normaliser and added tokens that ``_begins`` is right for.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL, _ADDED = ["NFC", "Replace", "Lowercase"], ("<|startoftext|>", "<|endoftext|>")
_BLANK = " \t\n\v\f\r"
_SUFFIX = "</w>"
_OTHER, _LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE = range(6)
#: Kinds of bytes; control characters and bytes beyond ASCII are other.
_KIND = bytes(_SPACE if chr(c) in _BLANK else _OTHER if not 32 < c < 127 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if c == 39 else _SIGN for c in range(256))
_SMALL = bytes(32 if k == _SPACE else c + 32 if 65 <= c <= 90 else c for c, k in enumerate(_KIND))


def _begins(inner: bool) -> bytes:
    """By 8 * kind of a byte + kind of the next one: does a piece begin there?

    Before white space always. With ``inner`` also where two ASCII characters
    meet that no match of the pattern holds: after a letter or digit, and before
    one but for a letter after an apostrophe. ASCII characters neither compose
    with one another nor look behind, so the pieces' ids are the text's ids."""
    pairs = {(k, _SPACE) for k in range(_SPACE)}
    if inner:
        pairs |= {(_LETTER, k) for k in (_DIGIT, _SIGN, _QUOTE)} | {(_DIGIT, k) for k in (_LETTER, _SIGN, _QUOTE)} | {(_SIGN, _LETTER), (_SIGN, _DIGIT), (_QUOTE, _DIGIT)}
    return bytes((c >> 3, c & 7) in pairs for c in range(256))


_AT_SPACE, _INNER = _begins(False), _begins(True)


class WordTokenizer:
    """A tokenizers-library file applied to pieces of texts that its normaliser
    and pattern never join: what stands between ASCII white space and, in files of
    the pattern ``_SPLIT``, runs of ASCII letters, digits and signs in that. The
    ids of the pieces met before are remembered up to ``memory`` bytes."""

    def __init__(self, path: str, memory: int = 240 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers") or [{}]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        self.inner = [n["type"] for n in before.get("normalizers", [])] == _NORMAL and steps[0].get("pattern") == {"Regex": _SPLIT} and [t.get("type") for t in steps] == ["Split", "ByteLevel"] and all(t.content in _ADDED and not t.normalized for t in added)
        vocab = self.tokenizer.get_vocab()
        # ids that end a match of the pattern; every byte has one of its own
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(_SUFFIX)]] = True
        self.ended = self.inner and spec["model"].get("end_of_word_suffix") == _SUFFIX and sum(len(t) == 1 + len(_SUFFIX) and t.endswith(_SUFFIX) for t in vocab) >= 256
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.size, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def _pieces(self, texts: Texts) -> tuple[pa.Array, np.ndarray]:
        """(pieces, index of each document's first) in order. White space before a
        piece is part of it; A-Z are lower-cased but before bytes beyond ASCII,
        which might be marks that compose with them."""
        data, offs = texts.data, texts.offsets
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        pair = ((kind[:-1] << 3) | kind[1:]).tobytes()
        begin = np.ones(len(data), bool)
        begin[1:] = np.frombuffer(pair.translate(_INNER if self.inner else _AT_SPACE), bool)
        if self.inner:
            text = np.frombuffer(bytearray(raw.translate(_SMALL)), np.uint8)
            np.copyto(text[:-1], data[:-1], where=data[1:] > 127)
            if any(t in raw for t in self.added):
                # an added token is found before all else and as it is written
                plain = np.frombuffer(pair.translate(_AT_SPACE), bool)
                for d in range(len(texts)):
                    lo, hi = int(offs[d]), int(offs[d + 1])
                    if any(t in raw[lo:hi] for t in self.added):
                        text[lo:hi] = data[lo:hi]
                        begin[lo + 1:hi] = plain[lo:hi - 1]
        else:
            text = data
        begin[offs[:-1][offs[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        bounds = np.append(start, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(text)]), np.searchsorted(start, offs)

    def _encode(self, pieces: list[str]):
        """(pieces, their ids, ids of each) of new pieces, in groups. Words are
        encoded many in one text: as each makes one match or more, as many ends of
        matches as words mean one each."""
        bare = [p.strip(_BLANK) for p in pieces]
        word = [self.ended and b.isalpha() for b in bare]
        words = [p for p, w in zip(pieces, word) if w]
        bare = [b for b, w in zip(bare, word) if w]
        others = [p for p, w in zip(pieces, word) if not w]
        for k in range(0, len(words), 500):
            own = words[k:k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(bare[k:k + 500])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(own) and ends[-1] == len(ids) - 1:
                yield own, ids, np.diff(ends, prepend=-1)
            else:
                others += own
        for k in range(0, len(others), 5000):
            own = others[k:k + 5000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            yield own, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of a string array; null: empty."""
        pieces, first = self._pieces(Texts.of(texts))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if self.held > self.memory:
            self._forget()
        seen = self.seen
        codes = np.fromiter(map(seen.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, flat, size = distinct[missing].tolist(), [self.flat], [self.size]
            for own, ids, sizes in self._encode(new):
                seen.update(zip(own, range(len(seen), len(seen) + len(own))))
                flat.append(ids)
                size.append(sizes)
                self.held += 160 * len(own) + sum(map(len, own)) + 4 * len(ids)
            codes[missing] = [seen[p] for p in new]
            self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        begin = np.cumsum(self.size) - self.size
        size, begin = self.size[codes], begin[codes]
        code = coded.indices.to_numpy()
        length = size[code]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(begin[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[first])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _save(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file under a name of its own, then renames it: a task that
    runs again, or twice, leaves the same file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None) -> list[tuple[str, int, int]]:
    """Encodes every text (null: empty), appends ``end_id`` to each document and
    writes the files under ``folder``, a URI that all executors reach. Returns
    (file name, documents, ids) of each file in order: a few numbers a file, not
    a document. Null ids come first; equal ids follow by text. A very long text is
    encoded whole and may make a file larger than others. Extra columns are
    ignored; without documents there are no files."""
    rows = ordered_by_id(docs, max(8, 2 * partitions(docs.sparkSession)), lookahead=False)

    def run(batches):
        coder = tokenizer(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        keys, counts, parts, held, number, bucket = [], [], [], 0, 0, None
        made = []

        def close():
            nonlocal keys, counts, parts, held, number
            if keys:
                name = f"part-{bucket:06d}-{number:06d}.s8b"
                _save(folder, name, to_bytes(keys, counts, np.frombuffer(b"".join(parts), "<u4")))
                made.append((name, len(keys), held))
            keys, counts, parts, held, number = [], [], [], 0, number + 1

        for batch in batches:
            texts = Texts.of(batch.column(3))
            for first, last in texts.slices(8 << 20):
                own = batch.slice(first, last - first)
                flat, sizes = coder.encode(own.column(3))
                at = 0
                for b, i, n in zip(own.column(0).to_pylist(), own.column(2).to_pylist(), sizes.tolist()):
                    if b != bucket or held >= FILE_IDS:
                        close()
                        if b != bucket:
                            bucket, number = b, 0
                    raw = flat[at:at + n].tobytes() + end
                    at += n
                    keys.append(i)
                    counts.append(len(raw) // 4)
                    parts.append(raw)
                    held += len(raw) // 4
        close()
        yield pa.RecordBatch.from_pydict({"name": [m[0] for m in made], "docs": [m[1] for m in made], "ids": [m[2] for m in made]}, schema=pa.schema([("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return sorted(tuple(r) for r in rows.mapInArrow(run, "name string, docs long, ids long").collect())


READ = "doc_id long, start long, n_tokens long, ids array<int>"


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their crc32 with ``digest``) from the
    files that ``write`` returned."""
    begins, at = {}, 0
    for name, _, n in files:
        begins[name] = at
        at += n
    schema = READ.replace("ids array<int>", "ids_crc32 long") if digest else READ
    if not files:
        return spark.createDataFrame([], schema)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts, ids = from_bytes(data.as_buffer())
                ends = np.cumsum(counts)
                begin = begins[path.rsplit("/", 1)[-1]]
                flat = ids.astype("<u4")
                for k in range(0, len(keys), 1024):
                    span = slice(k, k + 1024)
                    lo, hi = ends[span] - counts[span], ends[span]
                    last = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], pa.int64()) if digest else pa.array([flat[a:b].astype(np.int32) for a, b in zip(lo.tolist(), hi.tolist())], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[span], pa.int64()), pa.array(lo + begin, pa.int64()), pa.array(counts[span], pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return stored.mapInArrow(run, schema)


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "simple8b")
    files = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, folder, files, digest=True)
