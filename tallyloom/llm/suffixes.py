"""Repeated-substring removal by suffix sorting (operator 8).

A byte goes if a string of `width` bytes (a window) that covers it also starts in a document with a smaller id. What
is sorted are the suffixes at all places whose window may repeat, to the depth of a window; equal windows are then
neighbours, and the least document of each run of equals says which of them go. Every removed byte comes from there.

Hashes only leave out what cannot repeat, and deal the rest. In every window the 8-byte gram of least hash is its
anchor, so equal windows have equal anchors at equal places. Windows in a row with one anchor, whose anchor stands in
one part of them, form a piece: all share a core of bytes, and windows that are equal have equal cores. A piece whose
core no other document has cannot repeat. The others travel as bytes to the task of their core, each once for a block
of text however often it occurs there. Pieces of a core with many different surroundings are halved and go by their
longer cores, down to single windows.

A task sorts its suffixes by multikey quicksort, a three-way partition on words of 8 bytes, all groups of a round at
once, to a shallow depth; blind tries order the groups whose common prefix is longer.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, give_back, map_arrow, partitions, slices, small_batches
from tallyloom.llm.neardup import BYTES, mix
from tallyloom.workers import ship

GRAM = 8
#: Bytes of text in a block, which a worker scans at a time (a longer text is cut into overlapping parts); what it
#: holds meanwhile is some hundred times as much.
SCAN_BYTES = 1 << 20
#: Bytes of text for each bucket of cores, of which there are as many as the corpus asks for.
BUCKET_BYTES = 16 << 20
#: Parts of a window in which an anchor may stand, each with a core of its own.
CLASSES = 2
#: Different pieces of one core beyond which they are halved, and windows that a task sorts at a time.
CROWD, SORT_WINDOWS = 50_000, 250_000
#: Words of 8 bytes that the multikey quicksort looks at.
SHALLOW = 4
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class Rolling:
    """Hashes of any substrings of a byte array from sums of powers."""

    size = 0

    def __init__(self, data: np.ndarray):
        if Rolling.size < len(data) + 1:
            Rolling.size = max(len(data) + 1, SCAN_BYTES + (1 << 18))
            powers = np.full(Rolling.size, MULTIPLIER)
            inverses = np.full(Rolling.size, INVERSE)
            powers[0] = inverses[0] = 1
            Rolling.powers, Rolling.inverses = np.cumprod(powers), np.cumprod(inverses)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * Rolling.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling.inverses[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return mix((self.sums[GRAM:] - self.sums[:-GRAM]) * Rolling.inverses[:n])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, end to end: each member's group, and its number there."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where, in rows sorted by these columns, a new group begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def anchors(rolling: Rolling, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows that lie in one text, and for each the gram of least hash, the first of equals."""
    n = int(ends[-1])
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.uint64((1 << 26) - 1)
    value = (rolling.grams() & ~place) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span = width - GRAM + 1
    least, have = value, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        rest = span - have
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - width + 1) : e] = False
    start = np.flatnonzero(inside)
    return start, (least[start] & place).astype(np.int64)


def blind_trie_order(rows: list[bytes]) -> list[int]:
    """Numbers of distinct strings of one length in order, by a trie that keeps branching positions alone.

    A string goes down by its bytes at those positions to some leaf; the first difference from that leaf tells where
    it branches off.
    """
    root: list = [None, 0]  # a leaf [None, row] or a branch [depth, {byte: node}]
    for k in range(1, len(rows)):
        s, node = rows[k], root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = rows[node[1]]
        depth = next(i for i in range(len(s)) if s[i] != other[i])
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, k]
        else:
            old = node[:]
            node[:] = [depth, {other[depth]: old, s[depth]: [None, k]}]
    out, stack = [], [root]
    while stack:
        depth, held = stack.pop()
        if depth is None:
            out.append(held)
        else:
            stack += [held[b] for b in sorted(held, reverse=True)]
    return out


class Words:
    """Big-endian words of 8 bytes of the suffixes of a byte string, cut off at width."""

    def __init__(self, data: np.ndarray, width: int):
        self.padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.at = np.ndarray((len(data),), ">u8", self.padded, strides=(1,))
        self.count, self.rest = -(-width // 8), width % 8

    def of(self, position: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Words by number; depth counts words. What lies beyond width is no part of the last."""
        word = self.at[position + 8 * depth].astype(np.uint64)
        if self.rest:
            word = np.where(np.asarray(depth) == self.count - 1, word >> np.uint64(8 * (8 - self.rest)), word)
        return word


def multikey_quicksort(words: Words, position: np.ndarray, first: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of suffixes by their first words within the groups that begin at first, and the ties left: starts, sizes.

    In every round each group splits by its pivot's word into less, equal and greater; the equal part goes on with the
    next word. Groups don't wait for one another: a round takes all that are open, at whatever depth each is.
    """
    order = np.arange(len(position))
    start, size = first, np.diff(np.append(first, len(position)))
    depth = np.zeros(len(start), np.int64)
    tied: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        done = depth >= shallow
        tied.append((start[done & (size > 1)], size[done & (size > 1)]))
        open_ = ~done & (size > 1)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            break
        group, place = spread(size)
        rows = order[start[group] + place]
        word = words.of(position[rows], depth[group])
        base = np.cumsum(size) - size
        pivot = word[base + size // 2][group]
        less, equal = word < pivot, word == pivot
        below, same = np.cumsum(less), np.cumsum(equal)
        n_less = np.add.reduceat(less.astype(np.int64), base)
        n_equal = np.add.reduceat(equal.astype(np.int64), base)
        below -= (below[base] - less[base])[group]
        same -= (same[base] - equal[base])[group]
        to = np.where(less, below - 1, np.where(equal, n_less[group] + same - 1, n_less[group] + n_equal[group] + place - below - same))
        order[start[group] + to] = rows
        start = np.concatenate((start, start + n_less, start + n_less + n_equal))
        size = np.concatenate((n_less, n_equal, size - n_less - n_equal))
        depth = np.concatenate((depth, depth + 1, depth))
    ties, sizes = (np.concatenate(c) for c in zip(*tied, strict=True))
    return order, ties, sizes


def deep_shallow(data: np.ndarray, position: np.ndarray, width: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at these positions, cut off at width, and where in it runs of equals begin.

    first: where groups of suffixes begin that are ordered for themselves (by default one).
    """
    n = len(position)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = Words(data, width)
    shallow = min(SHALLOW, words.count)
    order, start, size = multikey_quicksort(words, position, np.zeros(1, np.int64) if first is None else first, shallow)
    new = np.ones(n, bool)
    group, place = spread(size)
    rows = start[group] + place
    new[rows] = False
    new[start] = True
    if words.count > shallow and len(rows):
        differ = np.zeros(len(start), bool)  # ties that go on being equal need no trie
        for depth in range(shallow, words.count):
            word = words.of(position[order[rows]], depth)
            differ |= np.bincount(group, weights=word != word[np.cumsum(size) - size][group], minlength=len(start)) > 0
        view = np.lib.stride_tricks.sliding_window_view(data, width - 8 * shallow)
        for s, n_of in zip(start[differ].tolist(), size[differ].tolist(), strict=True):
            own = order[s : s + n_of]
            tails = [t.tobytes() for t in view[position[own] + 8 * shallow]]
            distinct = list(dict.fromkeys(tails))
            rank = {distinct[i]: r for r, i in enumerate(blind_trie_order(distinct))}
            ranks = np.array([rank[t] for t in tails])
            by = np.argsort(ranks, kind="stable")
            order[s : s + n_of] = own[by]
            new[s + 1 : s + n_of] = np.diff(ranks[by]) > 0
    return order, np.flatnonzero(new)


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return start[at], reach[np.concatenate((at[1:] - 1, [len(start) - 1]))]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; whole numbers in the fewest bytes that hold them."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1:
            kinds = ["u1", "<u2", "<u4", "<i8"] if a.dtype.kind == "i" else ["u1", "<u2", "<u4", "<u8"]
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            a = a.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))
        out += [a.dtype.str.encode().ljust(4), np.array([len(a)], "<u8").tobytes(), a.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 4, []
    for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
        kind, n = raw[at : at + 4].decode().strip(), int(np.frombuffer(raw, "<u8", 1, at + 4)[0])
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + out[-1].nbytes
    return out


class Block:
    """Texts, or parts of long ones, end to end; base is where a part starts in its text."""

    def __init__(self, doc: np.ndarray, tag: np.ndarray, base: np.ndarray, size: np.ndarray, data: np.ndarray):
        self.doc, self.tag, self.base, self.size, self.data = doc.astype(np.int64), tag.astype(np.int64), base.astype(np.int64), size.astype(np.int64), data
        self.ends = np.cumsum(self.size)
        self.first = self.ends - self.size

    @classmethod
    def all_of(cls, batch: pa.RecordBatch, width: int, most: int) -> Iterator[Block]:
        """Blocks of the rows (doc, text, tag) of a batch: parts of a text overlap, so that each window lies in one."""
        held, total = [], 0
        for doc, text, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for base in range(0, len(raw) - width + 1, most):
                held.append((doc, tag, base, raw[base : base + most + width - 1]))
                total += len(held[-1][3])
                if total >= most:
                    yield cls.of(held)
                    held, total = [], 0
        if held:
            yield cls.of(held)

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        doc, tag, base, raw = zip(*rows, strict=True)
        return cls(np.array(doc), np.array(tag), np.array(base), np.array(list(map(len, raw))), np.frombuffer(b"".join(raw), np.uint8))

    def blob(self) -> bytes:
        return packed(self.doc, self.tag, self.base, self.size, self.data)

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, "right")


class Pieces:
    """Runs of window starts, first to last, of one anchor, whose distance from a window's start is low to high."""

    def __init__(self, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.columns = [c.astype(np.int64) for c in (first, last, anchor, low, high)]
        self.first, self.last, self.anchor, self.low, self.high = self.columns

    @classmethod
    def all_of(cls, block: Block, rolling: Rolling, width: int) -> Pieces:
        start, anchor = anchors(rolling, block.ends, width)
        span = width - GRAM + 1
        part = np.minimum((anchor - start) * CLASSES // span, CLASSES - 1)
        at = heads(start - np.arange(len(start)), anchor, part)
        last = np.append(at[1:], len(start)) - 1 if len(at) else at
        c = part[at]
        return cls(start[at], start[last], anchor[at], -(-c * span // CLASSES), -(-(c + 1) * span // CLASSES) - 1)

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(*(c[which] for c in self.columns))

    def halves(self) -> Pieces:
        """The windows whose anchor stands near, and those whose anchor stands far."""
        middle = (self.low + self.high) // 2
        near = Pieces(np.maximum(self.first, self.anchor - middle), self.last, self.anchor, self.low, middle)
        far = Pieces(self.first, np.minimum(self.last, self.anchor - middle - 1), self.anchor, middle + 1, self.high)
        both = Pieces(*(np.concatenate(c) for c in zip(near.columns, far.columns, strict=True)))
        return both.take(np.flatnonzero(both.first <= both.last))

    def cores(self, rolling: Rolling, width: int) -> np.ndarray:
        """Hashes of what all windows of a piece's kind share."""
        return mix(rolling.of(self.anchor - self.low, self.anchor - self.high + width) + (self.low * 4099 + self.high).astype(np.uint64))


class Entries:
    """The cores of a block's pieces by bucket and hash, each once: entry says which one a piece has."""

    def __init__(self, block: Block, pieces: Pieces, rolling: Rolling, width: int, buckets: int):
        core = pieces.cores(rolling, width)
        place = ((core >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (core & np.uint64(0xFFFFFFFF))
        self.place, self.entry = np.unique(place, return_inverse=True)
        self.bucket = (self.place >> np.uint64(32)).astype(np.int64)
        self.whole = rolling.of(pieces.first, pieces.last + width)
        self.row = block.row(pieces.first)

    def blobs(self, block: Block) -> Iterator[tuple[int, bytes]]:
        """For each bucket the hashes, how many different pieces each has, and whether they lie in several documents."""
        order = np.lexsort((self.whole, self.entry))
        entry, doc = self.entry[order], block.doc[self.row[order]]
        at = heads(entry)
        pieces = np.bincount(entry[heads(entry, self.whole[order])], minlength=len(at))
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        cuts = heads(self.bucket)
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.bucket)], strict=True):
            key = self.place[s:e].astype("<u4")
            yield int(self.bucket[s]), packed(key, np.minimum(pieces[s:e], 65535), several[s:e].view(np.uint8))


ROWS = "block long, kind int, bucket int, blob binary, text binary"
TEXT, CORES, STATE, PIECES, FOUND = range(5)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    block, kind, bucket, blob = zip(*rows, strict=True)
    text = [b if k == TEXT else None for k, b in zip(kind, blob, strict=True)]
    rest = [None if k == TEXT else b for k, b in zip(kind, blob, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(rest, pa.binary()), pa.array(text, pa.binary())], ["block", "kind", "bucket", "blob", "text"])


def number() -> int:
    return uuid.uuid4().int >> 65


def scan(docs: DataFrame, width: int, buckets: int, most: int) -> DataFrame:
    """Blocks with their texts, and their cores by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most):
                for block in Block.all_of(part, width, most):
                    own, rolling = number(), Rolling(block.data)
                    entries = Entries(block, Pieces.all_of(block, rolling, width), rolling, width, buckets)
                    yield rows_of([(own, TEXT, -1, block.blob()), *((own, CORES, b, blob) for b, blob in entries.blobs(block))])
        give_back()

    return docs.where("doc is not null").where(F.octet_length("text") >= width).select("doc", "text", "tag").mapInArrow(run, ROWS)


def by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(bucket, blocks, blobs) for each bucket of rows (block, bucket, blob), which yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from work(now, *map(list, zip(*held, strict=True)))
                    held = []
                now = bucket
                held.append((block, blob))
        if held:
            yield from work(now, *map(list, zip(*held, strict=True)))
        held.clear()
        give_back()

    return rows.select("block", "bucket", "blob").repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(block, [(kind, bucket, blob)]) for each block, which yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and held:
                    yield from work(now, held)
                    held = []
                now = block
                held.append((kind, bucket, blob))
        if held:
            yield from work(now, held)
        held.clear()
        give_back()

    return rows.select("block", "kind", "bucket", F.coalesce("blob", "text").alias("blob")).repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def shared_cores(rows: DataFrame, crowd: int) -> DataFrame:
    """What each core's entry is: 0 of one document, 1 of several, 2 with more than crowd different pieces."""

    def work(bucket: int, blocks: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = list(map(unpacked, blobs))
        key, pieces, several = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key)
        at = heads(key[order])
        count = np.diff(np.append(at, len(key)))
        total = np.add.reduceat(pieces[order].astype(np.int64), at)
        both = (count > 1) | (np.maximum.reduceat(several[order], at) > 0)
        kind = np.empty(len(key), np.uint8)
        kind[order] = np.repeat(np.where(both, np.where(total > crowd, 2, 1), 0), count)
        ends = np.cumsum([len(p[0]) for p in parts])
        out = [(block, STATE + 10, bucket, packed(part)) for block, part in zip(blocks, np.split(kind, ends[:-1]), strict=True) if part.any()]
        if out:
            yield rows_of(out)

    return by_bucket(rows.where(F.col("kind") == CORES), work, ROWS)


def candidates(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """From blocks and what their cores are: the pieces that may repeat by bucket, where they stand, and halves of others.

    A piece goes out once for all its places in the block, with the least and the greatest document there.
    """

    def work(own: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        at = {k: blob for k, _, blob in held if k in (TEXT, STATE)}
        kinds = [(b, blob) for k, b, blob in held if k == STATE + 10]
        if not kinds or TEXT not in at:
            return
        block = Block(*unpacked(at[TEXT]))
        rolling = Rolling(block.data)
        pieces = Pieces(*unpacked(at[STATE])) if STATE in at else Pieces.all_of(block, rolling, width)
        entries = Entries(block, pieces, rolling, width, buckets)
        kind = np.zeros(len(entries.place), np.uint8)
        for b, blob in kinds:
            s = np.searchsorted(entries.bucket, b)
            part = unpacked(blob)[0]
            kind[s : s + len(part)] = part
        kind = kind[entries.entry]
        split = (kind == 2) & (pieces.low < pieces.high)
        out = []
        if split.any():
            finer = pieces.take(np.flatnonzero(split)).halves()
            out += [(own, STATE, -1, packed(*finer.columns)), *((own, CORES, b, blob) for b, blob in Entries(block, finer, rolling, width, buckets).blobs(block))]
        go = np.flatnonzero((kind > 0) & ~split)
        if len(go):
            load = number()
            whole, row, place = entries.whole[go], entries.row[go], entries.place[entries.entry[go]]
            order = np.lexsort((whole, place))
            new = heads(place[order], whole[order])
            doc = block.doc[row[order]]
            least, most = np.minimum.reduceat(doc, new), np.maximum.reduceat(doc, new)
            lead = go[order[new]]
            size = pieces.last[lead] - pieces.first[lead] + width
            group, offset = spread(size)
            data, ends = block.data[pieces.first[lead][group] + offset], np.cumsum(size)
            bucket, key = entries.bucket[entries.entry[lead]], (place[order[new]] & np.uint64(0xFFFFFFFF)).astype("<u4")
            cuts = heads(bucket)
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                out.append((load, PIECES, int(bucket[s]), packed(np.arange(s, e), key[s:e], size[s:e], least[s:e], most[s:e], data[ends[s] - size[s] : ends[e - 1]])))
            counts = np.diff(np.append(new, len(order)))
            out.append((load, FOUND, -1, packed(block.doc, block.tag, block.base, block.size, counts, pieces.first[go[order]])))
        if out:
            yield rows_of(out)

    return by_block(rows, work, ROWS)


def alike(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string of data the first string, among equal ones, of those that stand next to each other by hash.

    Strings are hashed some at a time; that strings of equal hash are equal is looked up in the bytes.
    """
    hashes, end = np.empty(len(begin), np.uint64), begin + size
    by = np.argsort(begin, kind="stable")
    cuts = np.unique(np.searchsorted(begin[by], np.arange(0, len(data), SCAN_BYTES)))
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
        own = by[s:e]
        if len(own):
            low, high = int(begin[own].min()), int(end[own].max())
            hashes[own] = Rolling(data[low:high]).of(begin[own] - low, end[own] - low)
    order = np.lexsort((hashes, size))
    at = heads(hashes[order], size[order])
    lead = np.empty(len(begin), np.int64)
    lead[order] = np.repeat(order[at], np.diff(np.append(at, len(order))))
    words = Words(data, 0)
    same = np.ones(len(begin), bool)
    for k in range(0, int(size.max()) - 7, 8):
        where = np.flatnonzero(size >= k + 8)
        same[where] &= words.at[begin[where] + k] == words.at[begin[lead[where]] + k]
    same &= words.at[end - 8] == words.at[end[lead] - 8]
    return np.where(same, lead, np.arange(len(begin)))


def sorted_windows(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Sorts the windows of all pieces; for each piece the runs of windows that a smaller document has, and the least such.

    Equal pieces, which come from different blocks, are sorted once, for the least of their documents.
    """

    def work(bucket: int, loads: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = list(map(unpacked, blobs))
        own, key, size, least, last, data = (np.concatenate(c) for c in zip(*parts, strict=True))
        load = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        size, least, last = size.astype(np.int64), least.astype(np.int64), last.astype(np.int64)
        begin = np.cumsum(size) - size
        lead = alike(data, begin, size)
        order = np.lexsort((lead, key))
        own, key, load, lead, least, last, begin, windows = own[order], key[order], load[order], lead[order], least[order], last[order], begin[order], size[order] - width + 1
        total = np.cumsum(windows)
        cuts, done = [0], 0
        for a in heads(key)[1:].tolist():  # whole cores, so many windows at a time
            if total[a - 1] - done >= most:
                cuts.append(a)
                done = int(total[a - 1])
        found = []
        for s, e in zip(cuts, [*cuts[1:], len(own)], strict=True):
            one = heads(key[s:e], lead[s:e])
            which = np.repeat(np.arange(len(one)), np.diff(np.append(one, e - s)))
            n = windows[s:e][one]
            piece, offset = spread(n)
            base = np.cumsum(n) - n
            by, runs_at = deep_shallow(data, begin[s:e][one][piece] + offset, width, base[heads(key[s:e][one])])
            own_least = np.minimum.reduceat(least[s:e], one)
            low = np.empty(len(by), np.int64)
            low[by] = np.repeat(np.minimum.reduceat(own_least[piece[by]], runs_at), np.diff(np.append(runs_at, len(by))))
            piece, offset = spread(windows[s:e])
            low = low[base[which][piece] + offset]
            hit = np.flatnonzero(low < last[s:e][piece])
            new = heads(piece[hit], low[hit], offset[hit] - np.arange(len(hit)))
            end = np.append(new[1:], len(hit)) - 1 if len(new) else new
            found.append((load[s:e][piece[hit[new]]], own[s:e][piece[hit[new]]], offset[hit[new]], offset[hit[end]], low[hit[new]]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        by = np.argsort(columns[0], kind="stable")
        columns = [c[by] for c in columns]
        at = heads(columns[0])
        if len(at):
            yield rows_of([(loads[int(columns[0][s])], FOUND + 1, bucket, packed(*(c[s:e] for c in columns[1:]))) for s, e in zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=True)])

    return by_bucket(rows.where(F.col("kind") == PIECES), work, ROWS)


SPANS = "doc long, tag long, found binary"


def spans(rows: DataFrame, width: int) -> DataFrame:
    """(doc, tag, found) of each text, or part of one: from the places of pieces and the runs found in them."""

    def work(load: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        where = next(blob for k, _, blob in held if k == FOUND)
        doc, tag, base, size, counts, first = unpacked(where)
        got = [unpacked(blob) for k, _, blob in held if k == FOUND + 1]
        if not got:
            return
        piece, lo, hi, low = (np.concatenate(c) for c in zip(*got, strict=True))
        doc, counts, size = doc.astype(np.int64), counts.astype(np.int64), size.astype(np.int64)
        run, k = spread(counts[piece])
        start = first[(np.cumsum(counts) - counts)[piece][run] + k].astype(np.int64)
        ends = np.cumsum(size)
        row = np.searchsorted(ends, start, "right")
        late = doc[row] > low[run]
        run, start, row = run[late], start[late], row[late]
        if not len(run):
            return
        begin = ends - size + np.arange(len(size))  # a place between every two texts keeps their runs apart
        shift = start + row
        s, e = runs(shift + lo[run], shift + hi[run] + width)
        row = np.searchsorted(begin, s, "right") - 1
        s, e = s - begin[row] + base[row], e - begin[row] + base[row]
        at = heads(row)
        rows = [(int(doc[row[a]]), int(tag[row[a]]), np.stack((s[a:b], e[a:b])).astype("<i8").tobytes()) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(row)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "tag", "found"])

    return by_block(rows, work, SPANS)


def find(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (doc, text, tag), and for each doc and tag a list found of blobs of byte spans that may go.

    Strings count as repeated if a document with a smaller id has them, whole or overlapping; equal ids are one
    document, so rows that repeat an id take nothing from each other. Ids are whole numbers, cast to long. Null and
    short texts have no spans; a row with a null id neither gives nor takes. Texts may be of any length. Only lists
    for one document are ever gathered in one place. A string that every block of text has costs the task of its core
    a piece for each block.
    """
    if width < 3 * GRAM:
        raise ValueError("width must be 24 bytes or more")
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    told = rows.agg(F.count("doc").alias("n"), F.count_distinct("doc").alias("d"), F.sum(F.octet_length("text")).alias("s")).first()
    # only where an id repeats do its rows need to be told apart by their texts
    rows = rows.withColumn("tag", F.xxhash64("text") if told.n != told.d else F.lit(0).cast("long"))
    buckets = max(partitions(spark), -(-(told.s or 0) // BUCKET_BYTES))
    scanned = scratch.save(scan(rows, width, buckets, SCAN_BYTES), "scan")
    text_rows = scanned.where(F.col("kind") == TEXT).select("block", "kind", "bucket", F.lit(None).cast("binary").alias("blob"), "text")  # reads no cores
    asked, pieces = scanned, []
    while True:
        step = len(pieces)
        kinds = scratch.save(shared_cores(asked, CROWD), f"kinds-{step}")
        state = asked.where(F.col("kind") == STATE)
        held = text_rows if not step else text_rows.join(state.select("block"), "block", "left_semi").select(*state.columns).unionByName(state)
        pieces.append(scratch.save(candidates(held.unionByName(kinds), width, buckets), f"pieces-{step}"))
        asked = pieces[-1]
        if asked.where(F.col("kind") == STATE).isEmpty():
            break
    scratch.drop("scan", *(f"kinds-{k}" for k in range(len(pieces))))
    scratch.tidy()
    every = pieces[0]
    for more in pieces[1:]:
        every = every.unionByName(more)
    found = scratch.save(sorted_windows(every, width, SORT_WINDOWS), "found")
    scratch.tidy()
    listed = spans(every.where(F.col("kind") == FOUND).unionByName(found), width).groupBy("doc", "tag").agg(F.collect_set("found").alias("found"))
    listed = scratch.save(listed, "spans")
    scratch.drop("found", *(f"pieces-{k}" for k in range(len(pieces))))
    scratch.tidy()
    return rows, listed


def spans_of(found: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """The runs that blobs of spans hold together."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate([np.frombuffer(f, "<i8").reshape(2, -1) for f in found], axis=1)
    return runs(both[0], both[1])


def digests(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    rows, listed = find(docs, width, doc_id, text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (t or "").encode()
                lo, hi = spans_of(found)
                kept = b"".join([raw[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True)])
                out.append((len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest()))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return work

    joined = rows.join(listed, ["doc", "tag"], "left").select("doc", "text", "found")
    return map_arrow(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "text")


def remove(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated runs cut out of text, at whole characters within each run; every row stays."""
    _, listed = find(docs, width, doc_id, text)
    rows = docs.withColumn("__doc", F.col(doc_id).cast("long"))
    ids = rows.agg(F.count("__doc").alias("n"), F.count_distinct("__doc").alias("d")).first()
    rows = rows.withColumn("__tag", F.xxhash64(text) if ids.n != ids.d else F.lit(0).cast("long"))
    joined = rows.join(listed.withColumnsRenamed({"doc": "__doc", "tag": "__tag", "found": "__found"}), ["__doc", "__tag"], "left").select(*docs.columns, "__found")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            out = []
            for t, found in zip(batch.column(text).to_pylist(), batch.column("__found").to_pylist(), strict=True):
                if not t or not found:
                    out.append(t)
                    continue
                raw = t.encode()
                lo, hi = spans_of(found)
                inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731  the middle of a character
                starts = [next(i for i in range(s, s + 4) if not inside(i)) for s in lo.tolist()]
                ends = [next(i for i in range(e, e - 4, -1) if not inside(i)) for e in hi.tolist()]
                out.append(b"".join([raw[s:e] for s, e in zip([0, *ends], [*starts, len(raw)], strict=True)]).decode())
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else batch.column(n) for n in names if n != "__found"], [n for n in names if n != "__found"])

        return work

    return map_arrow(joined, make, docs.schema, text)
