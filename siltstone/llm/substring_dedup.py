"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks of whole documents, written once as
Arrow batches. The index of all blocks maps every window of ``span`` words that
occurs at two or more places to its places, one a block; a window's reference is
the nearest place before it (for the first place the one after). Each document is
then factored greedily against the referenced blocks: a factor begins at the first
known window that no factor holds yet and runs on along its reference as long as
the referenced text goes on alike, whichever places the index would name for the
windows it passes. Where it ends, the windows that cross its end are looked up:
the first known one begins the next factor. So factors overlap at boundaries, each
is at least ``span`` words long, and together they cover every window that occurs
elsewhere; the words of factors are the duplicate spans.

How far a reference runs on is asked of the block that holds it: where the index
changes its reference inside a run of known windows, the block sends the
windows that follow (as runs of the index's numbers, LOOKAHEAD of them at most,
after which a new factor begins) and is told how many agree. A reference to
the block itself is followed on the spot.

Only windows that can repeat enter the index. Each has an anchor, the least hash
of its GRAM-word grams, which equal windows share; blocks first send their
distinct anchors (about one in fifteen words), learn which occur elsewhere, and
send the windows of these alone. A block sends any anchor or window once,
whatever its copies, and is asked by its neighbours in the order of blocks only,
so a passage that a third of all documents hold reaches a task only once a block.
Messages are packed arrays, in a few rows for each pair of block and index
partition; texts move to them by the block's number. Windows are compared by
64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Texts, Words, mix64, partitions, seeds, table, tidy_batches, tidy_group, tidy_pair, written

SPAN = 35
GRAM = 8
BLOCK_BYTES = 3 << 20
#: Changes of group in a run of windows over which one factor may reach.
LOOKAHEAD = 256


def _codec(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def blocks_of(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows): the rows of ``docs`` as compressed Arrow streams."""
    at = docs.columns.index("text")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, bulk = [], 0

        def flush():
            nonlocal held, bulk, number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for h in held:
                    out.write_batch(h)
            row = pa.RecordBatch.from_arrays([pa.array([(part << 33) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])
            held, bulk, number = [], 0, number + 1
            return row

        for batch in batches:
            for a, b in Texts.of(batch.column(at)).slices(size):
                own = batch.slice(a, b - a)
                held.append(own)
                bulk += len(Texts.of(own.column(at)).data)
                if bulk >= size:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(tidy_batches(run), "block long, rows binary")


class Block:
    """A block's rows, words and windows."""

    def __init__(self, rows: bytes, span: int):
        self.table = pa.ipc.open_stream(rows).read_all()
        texts = Texts.of(self.table.column("text"))
        # one more separator after each document
        data = np.insert(texts.data, texts.offsets[1:], 32)
        self.texts = Texts(data, texts.offsets + np.arange(len(texts.offsets)))
        self.words = w = Words(self.texts)
        self.span = span
        n = np.maximum(w.counts - span + 1, 0)
        skip = np.cumsum(n) - n
        #: word number at which each window starts
        self.starts = np.repeat(w.first[:-1], n) + np.arange(int(n.sum())) - np.repeat(skip, n)

    def _rolling(self, length: int, salt: int) -> np.ndarray:
        """A hash of the ``length`` words from each word on (across documents)."""
        h = self.words.hashes
        if len(h) < length:
            return np.zeros(0, np.uint64)
        base = seeds(1, salt)[0] | np.uint64(1)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h) - 1, base)]))
            back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h) - 1, inverse)]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
            return mix64((total[length:] - total[:-length]) * back[:len(h) - length + 1])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, hashes of all grams)."""
        gram = min(GRAM, self.span)
        g = self._rolling(gram, 11)
        least, have, want = g, 1, self.span - gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:len(least) - step], least[step:]) if len(least) > step else least[:0]
            have += step
        return (least[self.starts] if len(self.starts) else np.zeros(0, np.uint64)), g

    def windows(self) -> np.ndarray:
        w = self._rolling(self.span, 12)
        return w[self.starts] if len(self.starts) else np.zeros(0, np.uint64)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """values in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _local_repeats(anchors: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct anchors, sorted; which of them lie at several places here)."""
    distinct = np.unique(anchors)
    if not len(distinct):
        return distinct, np.zeros(0, bool)
    at = np.searchsorted(distinct, grams)
    at[at == len(distinct)] = 0
    hits = np.bincount(at[distinct[at] == grams], minlength=len(distinct))
    return distinct, hits > 1


def _deal(block: int, part: np.ndarray, parts: int, pack) -> pa.RecordBatch:
    """Rows (part, block, data) of what goes to each index partition."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    to = np.flatnonzero(np.diff(bounds))
    data = [pack(order[bounds[p]:bounds[p + 1]]) for p in to]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array(data, pa.binary())], ["part", "block", "data"])


_MESSAGE = "part int, block long, data binary"
_ANSWER = "block long, kind int, data binary"


def _answers(found: dict[int, bytes], kind: int = 0) -> pa.Table:
    return pa.table({"block": pa.array(list(found), pa.int64()), "kind": pa.array([kind] * len(found), pa.int32()), "data": pa.array(list(found.values()), pa.binary())})


def _breaks(*columns: np.ndarray, steady: tuple = ()) -> np.ndarray:
    """Where runs begin: ``steady`` columns change, or others do not go up by one."""
    cut = np.zeros(len(columns[0]), bool)
    cut[:1] = True
    for c in columns:
        cut[1:] |= np.diff(c) != 1
    for c in steady:
        cut[1:] |= np.diff(c) != 0
    return np.flatnonzero(cut)


def _pack_runs(at, group_block, group_at, ref_block, ref_at) -> bytes:
    """Runs of known windows: (first word, windows, group, reference), compressed.
    A window's group is named by its first place; no reference is block -1."""
    cut = _breaks(at, group_at, ref_at, steady=(group_block, ref_block))
    size = np.diff(np.append(cut, len(at)))
    return _codec(np.stack([at[cut], size, group_block[cut], group_at[cut], ref_block[cut], ref_at[cut]]).astype("<i8").tobytes())


def _unpack_runs(data: bytes) -> tuple[np.ndarray, ...]:
    at, size, gb, ga, rb, ra = np.frombuffer(_plain(data), "<i8").reshape(6, -1)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(at, size) + step, np.repeat(gb, size), np.repeat(ga, size) + step, np.repeat(rb, size), np.repeat(ra, size) + step


class Parse:
    """What the index knows of a block's windows, and the block's factors."""

    def __init__(self, block: Block, number: int, known: list[bytes]):
        self.block, self.number = block, number
        n = len(block.starts)
        #: of each window its group (block -1: not known) and its reference
        self.gb, self.ga, self.rb, self.ra = (np.full(n, -1, np.int64) for _ in range(4))
        self.here = np.zeros(0, np.int64)
        if not known:
            return
        at, gb, ga, rb, ra = map(np.concatenate, zip(*map(_unpack_runs, known)))
        window = block.windows()
        index = np.searchsorted(block.starts, at)
        order = np.argsort(window[index])
        value = window[index][order]
        here = np.flatnonzero(_in(window, value))
        pick = order[np.searchsorted(value, window[here])]
        self.here, self.gb[here], self.ga[here] = here, gb[pick], ga[pick]
        # places of the same window in this block: the one before is the reference
        by = here[np.lexsort((here, window[here]))]
        same = np.zeros(len(by), bool)
        same[1:] = window[by[1:]] == window[by[:-1]]
        self.rb[index], self.ra[index] = rb, ra
        later = by[same]
        self.rb[later], self.ra[later] = number, block.starts[by[np.flatnonzero(same) - 1]]
        alone = by[:-1][~same[:-1] & same[1:]]  # first of several here
        alone = alone[self.rb[alone] < 0]
        after = by[np.searchsorted(window[by], window[alone], "left") + 1] if len(alone) else alone
        self.rb[alone], self.ra[alone] = number, block.starts[after]
        # runs of known windows, and of consecutive references in them
        word = block.starts[here]
        self.runs = here[_breaks(here, word)]
        self.parts = here[_breaks(here, word, self.ra[here], steady=(self.rb[here],))]
        ends = self._ends(self.parts)
        self.run_end = self._ends(self.runs)[np.searchsorted(self.runs, self.parts, "right") - 1]
        #: how far the reference of each part runs on (window after the last)
        self.reach = ends.copy()
        self.open = ends < self.run_end
        for k in np.flatnonzero(self.open & (self.rb[self.parts] == number)):
            self.reach[k] += self.agreeing(int(self.ra[self.parts[k]] + ends[k] - self.parts[k]), self.gb[ends[k]:self.run_end[k]], self.ga[ends[k]:self.run_end[k]])

    def _ends(self, begin: np.ndarray) -> np.ndarray:
        """The window after each run of known windows that ``begin`` starts."""
        place = np.searchsorted(self.here, begin)
        return self.here[np.append(place[1:], len(self.here)) - 1] + 1

    def agreeing(self, word: int, gb: np.ndarray, ga: np.ndarray) -> int:
        """How many of the windows named follow each other here from ``word`` on."""
        starts = self.block.starts
        i = int(np.searchsorted(starts, word))
        done, step = 0, 64
        while done < len(gb):
            n = min(step, len(gb) - done, len(starts) - i - done)
            if n <= 0:
                break
            own = slice(i + done, i + done + n)
            good = (starts[own] == word + done + np.arange(n)) & (self.gb[own] == gb[done:done + n]) & (self.ga[own] == ga[done:done + n])
            if not good.all():
                return done + int(np.argmin(good))
            done, step = done + n, step * 2
        return done

    def requests(self) -> dict[int, bytes]:
        """For each other block: (part, word, runs, then the runs of windows
        that follow) of every part whose reference lies there."""
        out: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero(self.open & (self.rb[self.parts] != self.number)):
            begin, end = int(self.reach[k]), int(self.run_end[k])
            cut = _breaks(self.ga[begin:end], steady=(self.gb[begin:end],))
            size = np.diff(np.append(cut, end - begin))[:LOOKAHEAD]
            cut = cut[:LOOKAHEAD]
            runs = np.stack([size, self.gb[begin + cut], self.ga[begin + cut]], 1).ravel()
            word = self.ra[self.parts[k]] + begin - self.parts[k]
            out.setdefault(int(self.rb[self.parts[k]]), []).append(np.concatenate([[k, word, len(size)], runs]))
        head = np.array([self.number], np.int64)
        return {b: _codec(np.concatenate([head, *v]).astype("<i8").tobytes()) for b, v in out.items()}

    def reply(self, asked: bytes) -> tuple[int, bytes]:
        """(asking block, (part, windows that agree) of each of its requests)."""
        flat = np.frombuffer(_plain(asked), "<i8")
        i, out = 1, []
        while i < len(flat):
            k, word, n = flat[i:i + 3].tolist()
            size, gb, ga = flat[i + 3:i + 3 + 3 * n].reshape(n, 3).T
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out += [k, self.agreeing(word, np.repeat(gb, size), np.repeat(ga, size) + step)]
            i += 3 + 3 * n
        return int(flat[0]), np.array(out, "<i8").tobytes()

    def factors(self, replies: list[bytes]) -> np.ndarray:
        """Greedy factors: first word, words, reference block, reference word."""
        if not len(self.here):
            return np.zeros((0, 4), np.int64)
        for data in replies:
            part, more = np.frombuffer(data, "<i8").reshape(-1, 2).T
            self.reach[part] += more
        starts, found, i, last = self.block.starts, [], 0, len(self.here)
        while i < last:
            window = self.here[i]
            k = int(np.searchsorted(self.parts, window, "right")) - 1
            end = int(self.reach[k])
            found.append((starts[window], end - window + self.block.span - 1, self.rb[window], self.ra[window]))
            # the windows that cross this factor's end, then those beyond it
            i = int(np.searchsorted(self.here, end))
        return np.array(found, np.int64)


def parsed(docs: DataFrame, span: int, finish, schema) -> DataFrame:
    """``finish(block, block number, factors)`` of every block, as a table."""
    spark = docs.sparkSession
    stored = written(blocks_of(docs), "blocks", "uncompressed")
    count = stored.count()
    parts = max(partitions(spark), count // 8)

    def send_anchors(batches):
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                distinct, repeated = _local_repeats(*Block(rows, span).anchors())
                if len(distinct):
                    # what repeats here is known already, but others must hear of it
                    yield _deal(number, (distinct % np.uint64(parts)).astype(np.int64), parts, lambda i: distinct[i].astype("<u8").tobytes())

    def meet_anchors(messages: pa.Table) -> pa.Table:
        numbers = messages.column("block").to_pylist()
        arrays = [np.frombuffer(d, "<u8") for d in messages.column("data").to_pylist()]
        flat = np.concatenate(arrays)
        ordered = np.sort(flat)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        found = {}
        for number, own in zip(numbers, arrays):
            hit = own[_in(own, shared)]
            if len(hit):
                found[number] = hit.astype("<u8").tobytes()
        return _answers(found)

    shared = stored.mapInArrow(tidy_batches(send_anchors), _MESSAGE).groupBy("part").applyInArrow(tidy_group(meet_anchors), _ANSWER)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for number, rows in zip(left.column("block").to_pylist(), left.column("rows").to_pylist()):
            block = Block(rows, span)
            anchors, grams = block.anchors()
            distinct, repeated = _local_repeats(anchors, grams)
            known = np.unique(np.concatenate([distinct[repeated], *[np.frombuffer(d, "<u8") for d in right.column("data").to_pylist()]]))
            at = np.flatnonzero(_in(anchors, known))
            if not len(at):
                continue
            window = block.windows()[at]
            value, first, times = np.unique(window, return_index=True, return_counts=True)
            keep = np.sort(first)
            several = np.zeros(len(window), bool)
            several[first] = times > 1
            at, window, several, own = at[keep], window[keep], several[keep], anchors[at[keep]]

            def pack(i):
                place = np.diff(block.starts[at[i]], prepend=0) * 2 + several[i]
                return _codec(place.astype("<u4").tobytes()) + window[i].astype("<u8").tobytes()

            out.append(_deal(number, (own % np.uint64(parts)).astype(np.int64), parts, pack))
        return pa.Table.from_batches(out, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))

    def meet_windows(messages: pa.Table) -> pa.Table:
        hashes, places, several, source = [], [], [], []
        numbers = messages.column("block").to_pylist()
        for number, data in sorted(zip(numbers, messages.column("data").to_pylist())):
            size = int.from_bytes(data[:8], "little")
            n = size // 4
            hashes.append(np.frombuffer(data[-8 * n:], "<u8"))
            raw = np.frombuffer(_plain(data[:-8 * n]), "<u4")
            several.append((raw & 1).astype(bool))
            places.append(np.cumsum(raw >> 1))
            source.append(np.full(n, number))
        h, at, many, block = map(np.concatenate, (hashes, places, several, source))
        order = np.lexsort((at, block, h))
        h, at, many, block = h[order], at[order].astype(np.int64), many[order], block[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        begin = np.flatnonzero(new)
        size = np.repeat(np.diff(np.append(begin, len(h))), np.diff(np.append(begin, len(h))))
        first = np.repeat(begin, np.diff(np.append(begin, len(h))))
        # the place before; for the first the one after, if there is one
        place = np.arange(len(h))
        ref = np.minimum(np.where(new, place + 1, place - 1), len(h) - 1)
        rb = np.where(size > 1, block[ref], -1)
        ra = np.where(size > 1, at[ref], at)
        keep = np.flatnonzero((size > 1) | many)
        keep = keep[np.lexsort((at[keep], block[keep]))]
        own = block[keep]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        ends = np.append(cut[1:], len(own))
        pack = lambda i: _pack_runs(at[i], block[first[i]], at[first[i]], rb[i], ra[i])
        return _answers({int(own[a]): pack(keep[a:b]) for a, b in zip(cut, ends)})

    # read by three stages below
    known = written(stored.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(tidy_pair(send_windows), _MESSAGE).groupBy("part").applyInArrow(tidy_group(meet_windows), _ANSWER), "known")

    def each(left: pa.Table, right: pa.Table, kinds: tuple[int, ...]):
        """(number, rows, messages of each kind) of the block of a cogroup."""
        kind, data = right.column("kind").to_pylist(), right.column("data").to_pylist()
        own = [[d for k, d in zip(kind, data) if k == wanted] for wanted in kinds]
        for number, rows in zip(left.column("block").to_pylist(), left.column("rows").to_pylist()):
            yield number, rows, *own

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {}
        for number, rows, told in each(left, right, (0,)):
            if told:
                out |= Parse(Block(rows, span), number, told).requests()
        return _answers(out, 1)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {}
        for number, rows, told, asked in each(left, right, (0, 1)):
            if asked:
                parse = Parse(Block(rows, span), number, told)
                out |= dict(map(parse.reply, asked))
        return _answers(out, 2)

    def factor(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for number, rows, told, replies in each(left, right, (0, 2)):
            block = Block(rows, span)
            out.append(finish(block, number, Parse(block, number, told).factors(replies)))
        return pa.concat_tables(out)

    blocks = stored.groupBy("block")
    asked = blocks.cogroup(known.groupBy("block")).applyInArrow(tidy_pair(ask), _ANSWER)
    replies = blocks.cogroup(known.unionAll(asked).groupBy("block")).applyInArrow(tidy_pair(answer), _ANSWER)
    return blocks.cogroup(known.unionAll(replies).groupBy("block")).applyInArrow(tidy_pair(factor), schema)


def _removed(block: Block, found: np.ndarray) -> np.ndarray:
    """Which words some factor covers."""
    change = np.zeros(len(block.words.hashes) + 1, np.int64)
    np.add.at(change, found[:, 0], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _per_document(block: Block, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[block.words.first[1:]] - total[block.words.first[:-1]]


def _spread(block: Block, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the bytes of the given words, up to ``ends``."""
    change = np.zeros(len(block.texts.data) + 1, np.int8)
    change[block.words.starts[words]] += 1
    change[ends[words]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors.

    A null text has no words, so nothing to remove; a text of fewer than ``span``
    words loses nothing, whatever its length a longer one is read whole; of rows
    that repeat, and texts that occur twice, all windows go on every side. Other
    columns are ignored, so names in them cannot clash; no rows give none."""
    def finish(block, number, found):
        gone = _removed(block, found)
        kept = np.flatnonzero(~gone)
        # each kept word and the separator after it, which becomes a space
        w = block.words
        mask = np.zeros(len(block.texts.data), bool)
        mask[_spread(block, kept, w.ends)] = True
        data = block.texts.data.copy()
        data[w.ends[kept]] = 32
        mask[w.ends[kept]] = True
        whole = data[mask].tobytes()
        bound = np.concatenate([[0], np.cumsum(mask)])[block.texts.offsets].tolist()
        sums = [hashlib.sha256(whole[a:max(a, b - 1)]).hexdigest() for a, b in zip(bound, bound[1:])]
        doc_of = np.searchsorted(w.first, found[:, 0], "right") - 1
        return pa.table({"doc_id": block.table.column("doc_id"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(_per_document(block, gone), pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "n_factors": pa.array(np.bincount(doc_of, minlength=len(w.counts)), pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return parsed(rows, span, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long")


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` with every duplicate span cut from ``text``, and the
    added column removed_words (replacing one so named).

    A removed word goes with the separators after it; texts that lose nothing
    stay byte for byte as they are. Null texts stay null; texts of fewer than
    ``span`` words lose nothing; of texts that repeat wholly, or rows that repeat,
    all words of ``span``-word runs go. Other columns pass as they are; an empty
    table gives no rows."""
    names = [c for c in docs.columns if c != "removed_words"]
    at = names.index("text")

    def finish(block, number, found):
        gone = _removed(block, found)
        w = block.words
        after = np.append(w.starts[1:], len(block.texts.data))
        doc = np.searchsorted(w.first, np.arange(len(w.starts)), "right") - 1
        after = np.minimum(after, block.texts.offsets[1:][doc] - 1) if len(doc) else after[:0]
        cut = _spread(block, np.flatnonzero(gone), after) if gone.any() else np.zeros(len(block.texts.data), bool)
        lost = _per_document(block, gone)
        texts = block.table.column("text").to_pylist()
        offs = block.texts.offsets
        for i in np.flatnonzero(lost):
            a, b = offs[i], offs[i + 1] - 1
            texts[i] = block.texts.data[a:b][~cut[a:b]].tobytes().decode("utf-8")
        table = block.table.set_column(at, "text", pa.array(texts, pa.string()))
        return table.append_column("removed_words", pa.array(lost, pa.int64()))

    base = docs.select(*names)
    return parsed(base, span, finish, T.StructType([*base.schema.fields, T.StructField("removed_words", T.LongType())]))


def spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, first_word, n_words, ref_block, ref_word of every factor."""
    def finish(block, number, found):
        doc = np.searchsorted(block.words.first, found[:, 0], "right") - 1
        return pa.table({"doc_id": block.table.column("doc_id").take(pa.array(doc)), "first_word": pa.array(found[:, 0] - block.words.first[doc], pa.int64()), "n_words": pa.array(found[:, 1], pa.int64()), "ref_block": pa.array(found[:, 2], pa.int64()), "ref_word": pa.array(found[:, 3], pa.int64())})

    return parsed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), span, finish, "doc_id long, first_word long, n_words long, ref_block long, ref_word long")


def op1_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their duplicate spans; those of which nothing is left
    go, those without words from the start (null and empty texts) stay. Rows that
    repeat lose every window on every side; a very long text is parsed whole;
    n_chars is counted again where a text changed; other columns, of any name, pass;
    no rows give none."""
    out = dedup(docs)
    text = F.col("text")
    kept = out.filter((F.col("removed_words") == 0) | F.rlike(text, F.lit("[^ \\t\\n\\x0B\\f\\r]")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
