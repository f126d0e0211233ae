"""Language-model scores by online logistic context mixing (operator 13).

A text is its words, A-Z in lower case, and one end. Each word is a row of binary decisions: the path to it in a Huffman
tree of the frequent words, whose escape leads to the bits of a rare word's letters. For a decision several predictors
look up what the training documents, hashed by a context, did there: no context (exact counts), the word before, the two
before; one more counts what this text itself did so far. A logistic mixer adds their log-odds with weights picked by a
gate, that is by how much evidence the contexts have, and moves the weights after every few words along the error; a
table of the text's own corrections refines the result. Letters are mixed alike from contexts of 1, 2, 3 and 5 letters,
once for each distinct rare word of the corpus.

Every training document counts: its words in the exact counts, its decisions in the hashed tables, but for one in seven
also as the tuning rows that the start weights are fitted to, against tables without these. Counts are summed in tasks
before a shuffle; the tables have a fixed number of slots, the dictionary the words of a least share of all tokens, so
both are bounded whatever the corpus. Rare words meet their counts in a join. The mixer starts afresh with every text,
and after every SEGMENT words of it, so that a score depends on the text and the training documents alone.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, give_back, map_arrow, partitions, slices, small_batches
from tallyloom.workers import ship

#: A word is in the dictionary if it is one of so many tokens at least; so there are no more words in it than that.
SHARE = 1 << 15
#: A rare word is priced where it stands if it is one of so many tokens at least, of training documents or of all; the
#: others meet their prices in a join, in which no word is frequent, then.
PRICED = 1 << 18
#: Bytes of a word that has a row by itself; of a longer one its digest stands in tables.
LONG = 64
#: Words whose decisions a worker spreads at a time, few enough for a processor's cache.
SPREAD = 4096
#: Slots of a hashed table, as a power of 2: of words, of letters; and slots of a text's own tables.
WORD_BITS, LETTER_BITS, OWN_BITS = 20, 19, 11
#: Words after which the mixer starts afresh, words between two steps of it, and lanes (texts, segments) worked on together.
SEGMENT, CHUNK, LANES = 2048, 16, 192
#: Bytes of texts that are cut together and whose lanes are put together by their lengths.
TOGETHER = 2 << 20
#: Orders of the letters' contexts.
ORDERS = (1, 2, 3, 5)
#: Steps of Newton's method that fit the letters' weights, which stay as they are; the words' go on in every text, so one.
LETTER_ROUNDS = 2
#: Evidence that a slot without counts has for either side; what a step moves weights by; the least probability.
PRIOR, RATE, LEAST = 0.3, 0.01, 1 / 65536
#: Steps of log-odds in a table: two bytes reach 32 either way, beyond any count's; so a worker's tables stay in its cache.
UNIT = 1 / 1024
#: Cells of the correction table, and the share of an error by which one moves, as its inverse.
CELLS, TRUST = 24, 120.0
#: What a repeated word of a text leaves to new ones.
NEW = 0.97
#: The symbols before the words; the end's key, which no word can be.
ESCAPE, END, END_KEY = 0, 1, b" "
#: Rows of a table that travel together.
PIECE_BITS = 14
WORD_INPUTS, WORD_GATES = 4, 16
SCATTER = np.uint32(0x9E3779B1)
LETTER_GATES = 9


def tokens(data: bytes) -> list[bytes]:
    """The words of a text in UTF-8; bytes know ASCII's white space and letters alone."""
    return data.lower().split()


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG else END_KEY + hashlib.sha256(word).digest()


def pieces(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts and the number of each, all at once if they aren't more than TOGETHER; else one by one, long ones in parts."""
    if (pc.sum(pc.binary_length(column)).as_py() or 0) <= TOGETHER:
        yield column, np.arange(len(column))
        return
    for k in range(len(column)):
        for part in parts_of(column[k].as_py() or b""):
            yield pa.array([part], pa.binary()), np.array([k])


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts end to end, and the row of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, b"").view(pa.string())))
    words, row = lists.flatten(), np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy())
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty one
    return words.filter(full), row[full.to_numpy(zero_copy_only=False)]


def numbers(words: pa.Array) -> np.ndarray:
    """A number for each word that is none of a symbol: 31 bits by a table of places and bytes, and one above."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    out = np.zeros(len(words), np.uint32)
    for a in range(0, len(words), SPREAD):
        edges = ends[a : a + SPREAD + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8, edges[-1] - edges[0], edges[0])
        edges = edges - edges[0]
        at = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
        at &= LONG - 1
        at <<= 8
        at += data
        out[a : a + SPREAD] = np.add.reduceat(PLACED.take(at), edges[:-1], dtype=np.uint32)
    return out | np.uint32(1 << 31)


def keyed(words: pa.Array) -> pa.Array:
    """Keys of words, as bytes."""
    if (pc.max(pc.binary_length(words)).as_py() or 0) <= LONG:
        return words.view(pa.binary())
    return pa.array(map(key_of, words.view(pa.binary()).to_pylist()), pa.binary())


def bucket(n: np.ndarray) -> np.ndarray:
    """0 without evidence, then 1 to 2, 3 to 15, more."""
    return ((n > 0).astype(np.uint8) + (n > 2) + (n > 15)).astype(np.uint8)


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one.astype(np.float32) + np.float32(PRIOR)) / (zero.astype(np.float32) + np.float32(PRIOR)))


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2 ** bits; context: 32-bit; node: 32-bit, multiplied by SCATTER."""
    h = context ^ node
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


@dataclass
class Dictionary:
    """The frequent words and the Huffman tree of them, the end and the escape."""

    words: list[bytes]
    counts: np.ndarray  # of escape, end and words, in training tokens
    total: int
    distinct: int
    discount: float  # of each count of a word outside
    outside: tuple[int, int]  # tokens and words outside, in training tokens
    lengths: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    paths: np.ndarray = field(init=False)  # twice a node and the side taken there, from the root
    odds: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.counts)
        weight = np.concatenate([np.maximum(self.counts, 1), np.zeros(n - 1, np.int64)])
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        heap = [(int(w), i) for i, w in enumerate(weight[:n])]
        heapq.heapify(heap)
        zero, one = np.zeros(n - 1), np.zeros(n - 1)
        for at in range(n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[i, j]], side[j], zero[at], one[at], weight[n + at] = n + at, 1, a, b, a + b
            heapq.heappush(heap, (a + b, n + at))
        self.odds = np.log(one / zero).astype(np.float32)
        steps, now = [], np.arange(n)
        while (now != 2 * n - 2).any():
            on = now != 2 * n - 2
            steps.append((on, parent[now] - n, side[now]))
            now = np.where(on, parent[now], now)
        self.lengths = np.sum([on for on, _, _ in steps], axis=0).astype(np.int64)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        self.paths = np.zeros(self.lengths.sum(), np.uint32)
        for k, (on, node, bit) in enumerate(steps):  # from the leaves to the root
            at = (self.starts + self.lengths - 1 - k)[on]
            self.paths[at] = node[on] * 2 + bit[on]

    @cached_property
    def listed(self) -> pa.Array:
        """The words from symbol 2 on."""
        return pa.array(self.words, pa.binary()).view(pa.string())

    @cached_property
    def base(self) -> np.ndarray:
        """log10 of the base probability of each symbol but the escape."""
        return np.log10((self.counts + 1.0) / (self.total + self.distinct + 1))

    def base_of(self, count: int) -> float:
        return math.log10((count + 1) / (self.total + self.distinct + 1))

    def price(self, spelt: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bits of words after the escape: their counts less the discount, whose sum is left to the letters."""
        n, words = self.outside
        if not n:
            return spelt
        new, known = self.discount * words / n, np.maximum(count - self.discount, 0) / n
        with np.errstate(divide="ignore"):
            return np.where(count > 0, -np.log2(known + new * np.exp2(-spelt)), spelt - math.log2(new))


@dataclass
class Text:
    """A text as symbols, its end included, a number for each token as a context, and its words outside the dictionary."""

    symbols: np.ndarray
    contexts: np.ndarray
    others: Counter


def read_all(column: pa.Array, known: Dictionary) -> tuple[list[Text], pa.Array, np.ndarray]:
    """Texts, their words outside the dictionary end to end, and the text of each of these; others are left empty."""
    found, contexts, rows, others, owners = [], [], [], [], []
    for part, which in pieces(column):
        words, row = cut(part)
        symbol = pc.fill_null(pc.index_in(words, known.listed), -2).to_numpy() + 2
        rare = symbol == ESCAPE
        others.append(words.filter(pa.array(rare)))
        context = symbol.astype(np.uint32)
        context[rare] = numbers(others[-1])
        row = which.take(row)
        for held, x in ((found, symbol), (contexts, context), (rows, row), (owners, row[rare])):
            held.append(x)
    row = np.concatenate(rows)
    at = np.arange(len(row)) + row  # each text before has an end
    symbols, numbered = np.full(len(row) + len(column), END), np.full(len(row) + len(column), END, np.uint32)
    symbols[at], numbered[at] = np.concatenate(found), np.concatenate(contexts)
    edges = np.cumsum([0, *(np.bincount(row, minlength=len(column)) + 1)]).tolist()
    texts = [Text(symbols[a:b], numbered[a:b], Counter()) for a, b in zip(edges, edges[1:], strict=False)]
    return texts, pa.concat_arrays(others), np.concatenate(owners)


def read(data: bytes, known: Dictionary) -> Text:
    (text,), others, _ = read_all(pa.array([data], pa.binary()), known)
    text.others.update(others.view(pa.binary()).to_pylist())
    return text


def repeats(counts: Sequence[int]) -> float:
    """Bits that tell which of a text's rare words are new there and which one another repeats, by how often each stands.

    A word that stands c times among t so far comes next with (c - d) / (t + 1), a new one with what is left (Pitman and
    Yor's process); so the order of the words makes no difference.
    """
    t, n, d = sum(counts), len(counts), NEW
    if not t:
        return 0.0
    new = (n - 1) * math.log(d) + math.lgamma(n + 1 / d) - math.lgamma(1 + 1 / d)
    again = sum([math.lgamma(c - d) - math.lgamma(1 - d) for c in counts if c > 1])
    return (math.lgamma(t + 1) - new - again) / math.log(2)


def parts_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end


def hashes(texts: list[Text]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of all texts the hashes of one and of two words before it, a text's start counted as one."""
    one, two = [], []
    for t in texts:
        before = np.concatenate([[np.uint32(0xFFFFFFFF)] * 2, t.contexts[:-1]]).astype(np.uint32)
        one.append(before[1:])
        two.append(before[1:] * np.uint32(0x297A2D39) ^ before[:-1] * np.uint32(0x1B873593))
    return tuple(stirred(np.concatenate(c) + np.uint32(k)) for k, c in ((1, one), (2, two)))


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def spread(known: Dictionary, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the symbol, node and side of each decision, where each symbol's decisions start), in order."""
    n = known.lengths.take(symbols)
    first = np.cumsum(n)
    first -= n
    which = np.repeat(np.arange(len(n)), n)
    at = (known.starts.take(symbols) - first).take(which)
    at += np.arange(len(at))
    path = known.paths.take(at)
    side = path & np.uint32(1)
    path >>= np.uint32(1)
    return which, path, side, first


#: For each place in a word, up to LONG, and each byte there a number.
PLACED = stirred(np.arange(LONG << 8, dtype=np.uint32) * SCATTER + np.uint32(1))
#: For each byte its eight decisions from the top: the node, which is 1 and the bits before, times SCATTER; and the bit.
BYTE_NODES = np.array([[(256 | b) >> (8 - i) for i in range(8)] for b in range(256)], np.uint32) * SCATTER
BYTE_SIDES = np.array([[b >> (7 - i) & 1 for i in range(8)] for b in range(256)], np.uint32)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word, node, side, contexts): the number of the word of each byte of the words and of a blank after each; node and
    side of each of its eight decisions, a row for a byte; and the hash of every order's context of each byte.
    """
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - (np.cumsum(sizes) - sizes).take(word)
    h, contexts = np.zeros(len(data), np.uint32), []
    for k in range(1, max(ORDERS) + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k]
        before[place < k] = 0
        h = (h + before + np.uint32(1)) * np.uint32(0x01000193)
        if k in ORDERS:
            contexts.append(stirred(h + np.uint32(k))[:, None])
    return word, BYTE_NODES.take(data, axis=0), BYTE_SIDES.take(data, axis=0), contexts


@dataclass
class Tables:
    """Log-odds of every slot of each table in units of UNIT, as two bytes, whose last two bits tell the evidence."""

    slots: np.ndarray  # tables x slots

    @classmethod
    def of(cls, odds: np.ndarray, evidence: np.ndarray) -> Tables:
        slots = np.clip(np.rint(odds * np.float32(1 / UNIT)), -(1 << 15), (1 << 15) - 1).astype(np.int16)
        slots &= np.int16(-4)
        slots |= evidence.astype(np.int16)
        return cls(slots)

    def take(self, table: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.slots[table].take(at)
        odds = found.astype(np.float32)
        odds *= np.float32(UNIT)
        found &= np.int16(3)
        return odds, found


def gathered(rows: DataFrame, make: Callable, tables: int, bits: int, scratch: Scratch, name: str) -> tuple[Tables, Tables]:
    """Tables of all events, and of those that aren't for tuning.

    make() gives work(batch): an iterator of (tuning, slots, side), arrays of events, slots with a row for each table. A
    task counts its events in tables of its own; pieces of them are added up where they meet, each task its share.
    """
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    piece = min(bits, PIECE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, work, held = pa.Codec("zstd", 1), make(), np.zeros((tables, 2 << bits + 1), np.uint32)  # tuning, slot, side
        for batch in batches:
            for part in slices(batch, batch.schema.names[-1], TOGETHER):
                for tuning, slots, side in work(part):
                    rest = tuning.astype(np.int64)
                    rest <<= bits + 1
                    rest += side
                    for k, at in enumerate(slots):
                        at += at
                        at += rest
                        np.add.at(held[k], at, np.uint32(1))
        for k in range(tables):
            for tuning, whole in enumerate(held[k].reshape(2, -1, 2 << piece)):
                some = np.flatnonzero(whole.any(1))
                bodies = [zstd.compress(np.ascontiguousarray(whole[i].view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True) for i in some.tolist()]
                if bodies:
                    yield pa.RecordBatch.from_arrays([pa.array([k << 20 | i for i in some.tolist()], pa.int64()), pa.array([tuning] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], ["piece", "tuning", "body"])
        del work, held
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, held = pa.Codec("zstd"), dict[int, np.ndarray]()
        for batch in batches:
            for at, tuning, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(zstd.decompress(body, (8 << piece), asbytes=True), np.uint8).reshape(4, -1)
                held.setdefault(at, np.zeros((2, 2 << piece), np.uint64))[tuning] += np.ascontiguousarray(raw.T).view(np.uint32).ravel()
        for at, sums in held.items():
            out = []
            for both in (sums[0] + sums[1], sums[0]):
                zero, one = both.reshape(-1, 2).T.astype(np.float32)
                out += [log_odds(zero, one).astype(np.float16).tobytes(), bucket(zero + one).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([x], pa.binary()) for x in out)], ["piece", "odds", "evidence", "odds0", "evidence0"])
        give_back()

    ship(spark)
    small_batches(spark)
    made = rows.mapInArrow(count, "piece long, tuning int, body binary")
    summed = scratch.save(made.repartition(n, "piece").mapInArrow(add, "piece long, odds binary, evidence binary, odds0 binary, evidence0 binary"), name).toArrow()
    found = [(np.zeros((tables, 1 << bits), np.float32), np.zeros((tables, 1 << bits), np.uint8)) for _ in range(2)]
    for at, *bodies in zip(*(c.to_pylist() for c in summed.columns), strict=True):
        k, i = at >> 20, (at & 0xFFFFF) << piece
        for t, (odds, evidence) in zip(found, (bodies[:2], bodies[2:]), strict=True):
            t[0][k, i : i + (1 << piece)] = np.frombuffer(odds, np.float16)
            t[1][k, i : i + (1 << piece)] = np.frombuffer(evidence, np.uint8)
    return Tables.of(*found[0]), Tables.of(*found[1])


@dataclass
class Sums:
    """The gradient and the curvature of the loss by gate, for a step of Newton's method."""

    slope: np.ndarray
    curve: np.ndarray

    @classmethod
    def none(cls, gates: int, inputs: int) -> Sums:
        return cls(np.zeros((gates, inputs)), np.zeros((gates, inputs, inputs)))

    def add(self, x: Sequence[np.ndarray], gate: np.ndarray, side: np.ndarray, p: np.ndarray) -> None:
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        off, root = (side - p).take(order), np.sqrt(p * (1 - p)).take(order)
        x = np.stack([c.take(order) for c in x])
        wide = x * root
        ends = np.cumsum(np.bincount(gate, minlength=len(self.slope))).tolist()
        for g, (s, e) in enumerate(zip([0, *ends], ends, strict=False)):
            if s < e:
                self.slope[g] += x[:, s:e] @ off[s:e]
                self.curve[g] += wide[:, s:e] @ wide[:, s:e].T

    def step(self, weights: np.ndarray) -> np.ndarray:
        """The weights after a step, drawn a little to where they were; rounded, so that the order of sums is forgotten."""
        curve = self.curve + 10 * np.eye(weights.shape[1])
        return np.round(weights + np.linalg.solve(curve, self.slope[:, :, None])[:, :, 0], 3)


def squash(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    np.reciprocal(out, out=out)
    return np.clip(out, LEAST, 1 - LEAST, out=out)


@dataclass
class Letters:
    tables: Tables
    weights: np.ndarray

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(word of each byte, inputs, gate, side and probability of each decision)."""
        word, node, side, contexts = letters(words)
        found = [self.tables.take(k, slot(c, node, LETTER_BITS).ravel()) for k, c in enumerate(contexts)]
        gate = (np.minimum(found[1][1], 2) * np.int16(3) + np.minimum(found[3][1], 2)).astype(np.int64)
        dot = np.zeros(node.size, np.float32)
        for (x, _), w in zip(found, self.weights.T.astype(np.float32), strict=True):
            part = w.take(gate)
            part *= x
            dot += part
        return word, [x for x, _ in found], gate, side.ravel(), squash(dot)

    def bits(self, words: list[bytes]) -> np.ndarray:
        """What the letters of each word and the blank after it cost."""
        out = np.zeros(len(words))
        for some, at in parted(words):
            word, _, _, side, p = self.inputs(some)
            p += side.astype(np.float32)
            p -= 1
            np.abs(p, out=p)
            out[at[0] : at[-1] + 1] = np.bincount(word, np.log(p, out=p).reshape(-1, 8).sum(1))
        return out / -math.log(2)


def parted(words: list[bytes], size: int = 1 << 14) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words, and their numbers, so many bytes at a time; a longer word by itself."""
    some, at, n = [], [], 0
    for i, w in enumerate(words):
        if some and n + len(w) > size:
            yield some, at
            some, at, n = [], [], 0
        some.append(w)
        at.append(i)
        n += len(w) + 1
    if some:
        yield some, at


def mixed(known: Dictionary, tables: Tables, weights: np.ndarray, texts: list[Text], sums: Sums | None = None) -> np.ndarray:
    """Bits of each text's symbols. With sums, the weights stay and the loss's slopes are added there.

    Texts, or segments of long ones, are lanes; every lane takes CHUNK words at a time, for whose decisions its tables
    and weights are as they were before.
    """
    bits = np.zeros(len(texts))
    one, two = hashes(texts)
    symbols = np.concatenate([t.symbols for t in texts])
    at, lanes = 0, []
    for k, t in enumerate(texts):
        n = len(t.symbols)
        lanes += [(k, at + i, min(SEGMENT, n - i)) for i in range(0, n, SEGMENT)]
        at += n
    lanes.sort(key=lambda x: -x[2])  # lanes of like length end together, so that steps are wide
    for first in range(0, len(lanes), LANES):
        owner, starts, sizes = np.array(lanes[first : first + LANES]).T
        bits += np.bincount(owner, lane_bits(known, tables, weights, starts, sizes, symbols, one, two, sums), len(texts))
    return bits


def steps(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step the next CHUNK tokens of each lane that has some, end to end, and the lanes of these; lanes lie by
    falling sizes, so that those still at work come first.
    """
    for a in range(0, int(sizes[0]), CHUNK):
        n = np.minimum(sizes[: np.searchsorted(-sizes, -a)] - a, CHUNK)
        lane = np.repeat(np.arange(len(n)), n)
        yield np.arange(len(lane)) + np.repeat(starts[: len(n)] + a - np.cumsum(n) + n, n), lane


def lane_bits(known: Dictionary, tables: Tables, weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, one: np.ndarray, two: np.ndarray, sums: Sums | None) -> np.ndarray:
    """Bits of each lane, by falling sizes; a lane is so many tokens from its start, one and two hash every token's contexts."""
    counts = np.zeros(len(sizes) << OWN_BITS + 1, np.uint16)  # of two sides; a lane's few words can't fill them
    pairs = counts.view(np.uint32)
    w = [np.tile(weights[:, k].astype(np.float32), len(sizes)) for k in range(WORD_INPUTS)]
    cells = np.tile(squash((np.arange(CELLS) - CELLS // 2 + 0.5) / 1.5).astype(np.float32), len(sizes))
    out = np.zeros(len(sizes))
    for tok, lane_of in steps(starts, sizes):
        which, node, side, first = spread(known, symbols.take(tok))
        lane, y = lane_of.take(which), side.astype(np.float32)
        own = lane << OWN_BITS
        own += node & np.uint32((1 << OWN_BITS) - 1)  # frequent nodes have slots of their own
        pair = pairs.take(own)
        own += own
        own += side
        np.add.at(counts, own, np.uint16(1))
        x0, x3 = known.odds.take(node), log_odds(pair & np.uint32(0xFFFF), pair >> np.uint32(16))
        node *= SCATTER
        x1, gate = tables.take(0, slot(one.take(tok).take(which), node, WORD_BITS))
        x2, e2 = tables.take(1, slot(two.take(tok).take(which), node, WORD_BITS))
        gate <<= np.int16(2)
        gate |= e2
        row, inputs = lane * WORD_GATES, (x0, x1, x2, x3)
        row += gate
        dot = w[0].take(row)
        dot *= x0
        for k in range(1, WORD_INPUTS):
            part = w[k].take(row)
            part *= inputs[k]
            dot += part
        p = squash(dot)
        if sums is not None:
            sums.add(inputs, gate, y, p)
            continue
        dot *= np.float32(1.5)
        dot += np.float32(CELLS // 2)
        np.clip(dot, 0, CELLS - 1, out=dot)
        lane *= CELLS
        lane += dot.astype(np.int64)
        seen = cells.take(lane)
        y -= p
        p += seen
        p *= np.float32(0.5)
        p += side
        p -= 1
        np.abs(p, out=p)
        np.log(p, out=p)
        at = first.take(np.searchsorted(lane_of, np.arange(lane_of[-1] + 1)))
        out[: len(at)] += np.add.reduceat(p, at, dtype=np.float64)
        np.subtract(side, seen, out=seen, casting="unsafe")
        seen /= np.float32(TRUST)
        y *= np.float32(RATE)
        for k in range(WORD_INPUTS):
            np.add.at(w[k], row, y * inputs[k])
        np.add.at(cells, lane, seen)
        np.clip(cells, LEAST, 1 - LEAST, cells)
    return out / -math.log(2)


def start_weights(rows: DataFrame, make: Callable, weights: np.ndarray, rounds: int) -> np.ndarray:
    """Weights fitted to the tuning rows by Newton's method; make(weights) gives work(batch, sums)."""
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    for _ in range(rounds):
        work_of = make(weights)

        def run(batches: Iterator[pa.RecordBatch], work_of=work_of) -> Iterator[pa.RecordBatch]:
            work, sums = work_of(), Sums.none(*weights.shape)
            for batch in batches:
                for part in slices(batch, batch.schema.names[-1], TOGETHER):
                    work(part, sums)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums.slope.ravel(), sums.curve.ravel()]).tolist()])], ["sums"])
            give_back()

        size = weights.size
        each = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(size + size * weights.shape[1])
        flat[each.column("at").to_numpy()] = each.column("v").to_numpy()
        weights = Sums(flat[:size].reshape(weights.shape), flat[size:].reshape(*weights.shape, -1)).step(weights)
    return weights


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 7: 2 is held out, 3 tunes. A null id is neither."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7, F.lit(0)).cast("int")


def counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, c, m): keys of all words and the end, how often training documents have them and how often all do."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = batch.column(0).to_numpy() == 2
            ends = [int((~held).sum()), int(held.sum())]
            words, m, c = [pa.array([END_KEY] * 2, pa.binary())], [np.array(ends)], [np.array([ends[0], 0])]
            for part, which in pieces(batch.column(1).cast(pa.binary())):
                found, row = cut(part)
                out = held.take(which.take(row))
                for some in (~out, out):
                    seen = pc.value_counts(found.filter(pa.array(some)))
                    words.append(keyed(seen.field("values")))
                    m.append(seen.field("counts").to_numpy())
                    c.append(m[-1] * (some is not out))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(words), *(pa.array(np.concatenate(x), pa.int64()) for x in (c, m))], ["word", "c", "m"])

        return work

    each = map_arrow(docs, make, "word binary, c long, m long", "text", TOGETHER)
    return scratch.save(each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m")), "counts")


def least_count(total: int, share: int | None = None) -> int:
    return max(1, -(-total // (share or SHARE)))


def dictionary(counts: DataFrame) -> Dictionary:
    """What is frequent goes to the driver: SHARE words of training documents at most."""
    sums = counts.agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums.c or 0, sums.v or 0
    often = counts.where((F.col("c") >= least_count(total)) | (F.col("word") == F.lit(END_KEY))).toArrow()
    rows = sorted(zip(*(often.column(c).to_pylist() for c in ("word", "c")), strict=True), key=lambda r: (-r[1], r[0]))
    inside = [(w, c) for w, c in rows if not w.startswith(END_KEY)]
    end = next((c for w, c in rows if w == END_KEY), 0)
    rest = total - end - sum(c for _, c in inside)
    once = counts.where((F.col("c") < least_count(total)) & F.col("c").between(1, 2)).groupBy("c").count().toArrow().to_pylist()
    n1, n2 = (sum(r["count"] for r in once if r["c"] == c) for c in (1, 2))
    return Dictionary([w for w, _ in inside], np.array([rest, end, *(c for _, c in inside)], np.int64), total, distinct, max(0.1, n1 / max(1, n1 + 2 * n2)), (rest, distinct - len(inside) - (end > 0)))


@dataclass
class Words:
    tables: Tables
    weights: np.ndarray


def word_model(rows: DataFrame, known, scratch: Scratch) -> Words:
    """Tables and start weights from (fold, text) of the training documents; known: the dictionary, broadcast."""

    def texts_of(batch: pa.RecordBatch) -> list[Text]:
        return read_all(batch.column(1).cast(pa.binary()), known.value)[0]

    def events():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            texts = texts_of(batch)
            one, two = hashes(texts)
            tuning = np.repeat(batch.column(0).to_numpy() == 3, [len(t.symbols) for t in texts])
            symbols = np.concatenate([t.symbols for t in texts])
            for a in range(0, len(symbols), SPREAD):
                some = slice(a, a + SPREAD)
                which, node, side, _ = spread(known.value, symbols[some])
                node *= SCATTER
                yield tuning[some].take(which), [slot(h[some].take(which), node, WORD_BITS) for h in (one, two)], side

        return work

    whole, rest = gathered(rows, events, 2, WORD_BITS, scratch, "word-tables")
    held = rows.sparkSession.sparkContext.broadcast(rest)

    def make(weights: np.ndarray):
        return lambda: lambda batch, sums: mixed(known.value, held.value, weights, texts_of(batch), sums)

    weights = start_weights(rows.where("fold = 3"), make, np.tile([0.5, 0.4, 0.3, 0.3], (WORD_GATES, 1)), 1)
    held.unpersist()
    return Words(whole, weights)


def letter_model(rows: DataFrame, scratch: Scratch) -> Letters:
    """Tables and weights from (crc, word) of the training documents' rare words, each counted once."""

    def events():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            tunes = batch.column(0).to_numpy() % 7 == 3
            for words, at in parted(batch.column(1).to_pylist()):
                word, node, side, contexts = letters(words)
                yield np.repeat(tunes[at[0] :].take(word), 8), [slot(c, node, LETTER_BITS).ravel() for c in contexts], side.ravel()

        return work

    whole, rest = gathered(rows, events, len(ORDERS), LETTER_BITS, scratch, "letter-tables")
    held = rows.sparkSession.sparkContext.broadcast(rest)

    def make(weights: np.ndarray):
        def work(batch: pa.RecordBatch, sums: Sums) -> None:
            for words, _ in parted(batch.column(1).to_pylist()):
                _, x, gate, side, p = Letters(held.value, weights).inputs(words)
                sums.add(x, gate, side, p)

        return lambda: work

    weights = start_weights(rows.where("crc % 7 = 3"), make, np.full((LETTER_GATES, len(ORDERS)), 0.3), LETTER_ROUNDS)
    held.unpersist()
    return Letters(whole, weights)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    base_score adds the logarithms of add-one word frequencies; score is the mixer's log10 probability of the words and
    the end; bits_per_byte are its bits for each byte of the text (of an empty one, for one byte). A null text is an
    empty one, a row with a null id trains. Repeated rows train and score as often as they occur, with equal scores.
    Without training documents nothing is known and base_score is 0. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(fold(doc_id).alias("fold"), F.col(text).alias("text"))
    counts = counted(rows, scratch)
    known = spark.sparkContext.broadcast(dictionary(counts))
    digest = F.startswith("word", F.lit(END_KEY))
    rare = counts.where(~digest & (F.col("c") < least_count(known.value.total)))
    spelt = spark.sparkContext.broadcast(letter_model(rare.where("c > 0").select(F.crc32("word").alias("crc"), "word"), scratch))
    mixer = spark.sparkContext.broadcast(word_model(rows.where("fold <> 2"), known, scratch))

    def price():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = known.value.price(spelt.value.bits(batch.column(2).to_pylist()), batch.column(0).to_numpy())
            return pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), pa.array(bits)], ["word", "c", "m", "bits"])

        return work

    priced = scratch.save(map_arrow(rare.select("c", "m", "word"), price, "word binary, c long, m long, bits double", "word"), "priced")
    listed = priced.union(counts.where(digest & (F.col("word") != F.lit(END_KEY))).select("word", "c", "m", F.lit(0.0)))
    all_tokens = counts.agg(F.sum("m").alias("m")).first().m or 0
    often = listed.where((F.col("c") >= least_count(known.value.total, PRICED)) | (F.col("m") >= least_count(all_tokens, PRICED))).toArrow()
    near = spark.sparkContext.broadcast(({w: i for i, w in enumerate(often.column("word").to_pylist())}, *(np.append(often.column(k).to_numpy(), 0) for k in ("c", "bits"))))

    def make():
        d, costs = known.value, dict[bytes, float]()
        place, count, cost = near.value  # the last of the counts and costs is for words that aren't there
        base_of, known_of, near_base = d.base.copy(), (d.counts > 0).astype(np.int64), np.array([d.base_of(c) for c in count.tolist()])
        base_of[ESCAPE] = known_of[ESCAPE] = near_base[-1] = 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1).cast(pa.binary())
            texts, others, owner = read_all(column, d)
            bits = mixed(d, mixer.value.tables, mixer.value.weights, texts)
            symbols, sizes = np.concatenate([t.symbols for t in texts]), np.array([len(t.symbols) for t in texts])
            starts = np.cumsum(sizes) - sizes
            base, found = (np.add.reduceat(x.take(symbols), starts) for x in (base_of, known_of))
            coded = others.dictionary_encode()
            words = coded.dictionary
            pairs, times = np.unique(owner * len(words) + coded.indices.to_numpy(), return_counts=True)
            text, word = np.divmod(pairs, max(1, len(words)))
            edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            bits += [repeats(times[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)]
            spelt_out = np.zeros(len(words))  # a long word goes by its key, which has a count but no price
            long = np.flatnonzero(pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False))
            if len(long):
                names = words.take(pa.array(long)).view(pa.binary()).to_pylist()
                fresh = [w for w in names if w not in costs]
                costs.update(zip(fresh, d.price(spelt.value.bits(fresh), np.zeros(len(fresh))).tolist(), strict=True))
                spelt_out[long] = [costs[w] for w in names]
                if len(costs) > 100_000:
                    costs.clear()
            keys = keyed(words)
            at = np.fromiter(map(place.get, keys.to_pylist(), repeat(-1)), np.int64, len(keys))
            bits += np.bincount(text, (spelt_out + cost.take(at)).take(word), len(texts))
            at = at.take(word)
            base += np.bincount(text, near_base.take(at) * times, len(texts))
            found += np.bincount(text, (count.take(at) > 0) * times, len(texts)).astype(np.int64)
            rest = np.flatnonzero(at < 0)
            ends = np.searchsorted(rest, edges).astype(np.int32)
            left = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([keys.take(pa.array(word.take(rest))), pa.array(times.take(rest), pa.int64())], ["word", "n"]))
            columns = [pa.array(sizes, pa.int64()), pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(bits, pa.float64())]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns, left], ["doc_id", "n_tokens", "n_bytes", "n_known", "base", "bits", "others"])

        return work

    kinds = "n_tokens long, n_bytes long, n_known long, base double, bits double, others array<struct<word:binary,n:long>>"
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = map_arrow(ids, make, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, {kinds}", "text", TOGETHER)
    done = scratch.save(each.withColumn("rid", F.monotonically_increasing_id()), "done")
    asked = done.select("rid", F.explode("others").alias("o")).select("rid", F.col("o.word").alias("word"), F.col("o.n").alias("n"))
    met = asked.join(listed, "word")
    total = known.value.total + known.value.distinct + 1
    log = F.log10((F.col("c") + 1) / F.lit(float(total)))
    parts = met.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.col("n") * log).alias("b1"), F.sum("bits").alias("x1"))
    whole = done.drop("others").join(parts, "rid", "left")
    bits = F.col("bits") + F.coalesce("x1", F.lit(0.0))
    zero = F.lit(0).cast("long")
    return whole.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("n1", zero)).alias("n_known"), F.lit(known.value.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b1", F.lit(0.0))).alias("base_score"), (-F.round(bits, 6) * math.log10(2)).alias("score"), (bits / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
