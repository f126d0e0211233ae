"""Byte-pair encoding by speculation and verification.

A greedy longest match proposes the tokens of each distinct word. A proposal is the true encoding
exactly if every adjacent pair of tokens is compatible, that is if undoing the merges on both sides
of the pair never shows a merge across it that would have come first. The check runs on arrays of
all distinct pairs; only words with a pair that fails are merged exactly, also on arrays.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import regex

#: The pre-tokeniser patterns of the two vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of which a run may be cut in two by cutting at spaces; separators that str.split() alone takes.
LONG_SPACE = re.compile(r"\s\s\s|\s\s\Z").search
ODD_SPACE = re.compile("[\x1c-\x1f\x85]").search

MARKS = frozenset(".,!?;:")

NONE = np.int64(1) << 40
#: A byte that UTF-8 never has.
SEPARATOR = chr(255)
LONG_WORD = 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PairTable:
    """Open-addressing hash table from token pairs to merge ranks and merged tokens, read by arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(max(len(left), 1) * 5 + 8)))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        keys = (left.astype(np.int64) << 20) | right
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            taken = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[taken], taken, merged[taken]
            todo = np.setdiff1d(todo, taken)
            at[todo] = (at[todo] + (self.keys[at[todo]] != -1)) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot without the pair has rank NONE."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._slot(keys)
        seen = self.keys[at]
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[todo]]
            todo = todo[(seen != keys[todo]) & (seen != -1)]
        return at


class Bpe:
    """A vocabulary in the tokenizers library's JSON format: normaliser, pre-tokeniser, merges, decoder.

    content: the text of the JSON file. Vocabularies with NFC, white-space and lower-case normalisation and
    word ends, and byte-level ones without normalisation, are supported; others raise ValueError.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level BPE vocabulary")
        self.end = model.get("end_of_word_suffix") or ""
        self.folds = spec["normalizer"] is not None
        self.joined = spec["decoder"] is None
        self.words = regex.compile(WORD_PATTERN if self.folds else BYTE_PATTERN).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        back = {c: b for b, c in enumerate(byte_symbols())}

        def symbols(token: str) -> str:
            ends = bool(self.end) and token.endswith(self.end)
            codes = [back[c] for c in (token[: -len(self.end)] if ends else token)]
            if ends:
                codes[-1] += 256
            return "".join(map(chr, codes))

        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.raw = [b""] * self.size
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        made = np.array([vocab[x + y] for x, y in merges], np.int64)
        for k in range(len(merges) - 1, -1, -1):
            self.left[made[k]], self.right[made[k]], self.rank[made[k]] = a[k], b[k], k
        self.pairs = PairTable(a, b, made)
        self.base = np.zeros(600, np.int64)
        held = ahocorasick.Automaton()
        held.add_word(SEPARATOR, -1)
        for t, i in vocab.items():
            s = symbols(t)
            self.raw[i] = bytes(ord(c) & 255 for c in s)
            if len(s) == 1:
                self.base[ord(s)] = i
            elif self.rank[i] < 0:
                continue  # no merge makes it
            if s != SEPARATOR:
                held.add_word(s, i)
        held.make_automaton()
        self.trie = held

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: they stay apart when the text of both is encoded as one word."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NONE, np.int64)
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            bad = self.pairs.rank[self.pairs.find(x, y)] < limit[todo]
            good[todo[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            keep = ~bad & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[keep], x[keep], y[keep], rx[keep], ry[keep]
            first = rx > ry
            limit[todo] = np.where(first, rx, ry + 1)
            a[todo] = np.where(first, self.right[x], x)
            b[todo] = np.where(first, y, self.left[y])
        return good

    def merge_exactly(self, word: str) -> list[int]:
        """The lowest rank first, then the leftmost: a heap over a linked list."""
        ids = [int(self.base[ord(c)]) for c in word]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        known: dict[tuple[int, int], tuple[int, int]] = {}  # rank and product of the pairs met in this word

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] >= 0:
                pair = (ids[i], ids[nxt[i]])
                found = known.get(pair)
                if found is None:
                    slot = self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0]
                    found = known[pair] = (int(self.pairs.rank[slot]), int(self.pairs.merged[slot]))
                if found[0] < NONE:
                    heapq.heappush(heap, (found[0], i, *pair, found[1]))

        slots = self.pairs.find(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)) if n > 1 else []
        heap = [(int(self.pairs.rank[s]), i, ids[i], ids[i + 1], int(self.pairs.merged[s])) for i, s in enumerate(slots) if self.pairs.rank[s] < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], nxt[i] = made, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def merge_rows(self, words: list[str]) -> list[np.ndarray]:
        """merge_exactly for many short words of like length: one merge in each row at a time."""
        lens = np.array(list(map(len, words)))
        width = int(lens.max())
        rows = np.full((len(words), width + 1), -1, np.int64)
        rows[np.arange(width + 1)[None, :] < lens[:, None]] = self.base[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        live, columns = np.arange(len(words)), np.arange(width)
        while len(live):
            x = rows[live]
            slots = self.pairs.find(np.where(x[:, :-1] < 0, 0, x[:, :-1]).ravel(), np.where(x[:, 1:] < 0, 0, x[:, 1:]).ravel())
            ranks = np.where((x[:, 1:] < 0).ravel(), NONE, self.pairs.rank[slots]).reshape(len(live), width)
            at = ranks.argmin(1)
            each = np.arange(len(live))
            more = ranks[each, at] < NONE
            live, x, at, slots = live[more], x[more], at[more], slots.reshape(-1, width)[each, at][more]
            moved = np.take_along_axis(x, columns[None, :] + (columns[None, :] > at[:, None]), 1)
            moved[np.arange(len(live)), at] = self.pairs.merged[slots]
            rows[live, :width] = moved
            rows[live, width] = -1
        return [r[r >= 0] for r in rows]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, which the pre-tokeniser has cut, and where each word's begin (and the end)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        symbols = b"\xff".join(map(str.encode, words)).decode("latin-1").split(SEPARATOR)
        if self.end:
            symbols = [s[:-1] + chr(ord(s[-1]) + 256) for s in symbols]
        flat = np.fromiter(map(itemgetter(1), self.trie.iter_long(SEPARATOR.join(symbols) + SEPARATOR)), np.int64)
        inner = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        keys, where = np.unique((flat[inner] << 20) | flat[inner + 1], return_inverse=True)
        bad = inner[~self.compatible(keys >> 20, keys & ((1 << 20) - 1))[where]]
        ends = np.flatnonzero(flat < 0)
        wrong = np.unique(np.searchsorted(ends, bad))
        bounds = np.concatenate(([0], ends - np.arange(len(ends))))
        flat = flat[flat >= 0]
        if not len(wrong):
            return flat, bounds
        by_length: dict[int, list[int]] = {}
        exact: dict[int, np.ndarray] = {}
        for i in wrong.tolist():
            if len(symbols[i]) > LONG_WORD:
                exact[i] = np.array(self.merge_exactly(symbols[i]), np.int64)
            else:
                by_length.setdefault((len(symbols[i]) + 3) // 4, []).append(i)
        for chosen in by_length.values():
            exact |= zip(chosen, self.merge_rows([symbols[i] for i in chosen]), strict=True)
        sizes = np.diff(bounds)
        keep = np.ones(len(words), bool)
        keep[wrong] = False
        sizes[wrong] = [len(exact[i]) for i in wrong.tolist()]
        after = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(after[-1]), np.int64)
        out[np.repeat(keep, sizes)] = flat[np.repeat(keep, np.diff(bounds))]
        out[np.repeat(~keep, sizes)] = np.concatenate([exact[i] for i in wrong.tolist()])
        return out, after

    def cut(self, text: str) -> list[str | int]:
        """The text in parts that are encoded each for itself: keys of chunk(), and special tokens as their ids.

        Texts are mostly cut at single spaces, which the pre-tokeniser never looks across; runs of white space and
        separators that Python and the pre-tokeniser see differently go to the pre-tokeniser as a whole.
        """
        if self.specials and "<|" in text and self.specials.search(text):
            return [x for part in self.specials.split(text) for x in ([self.special[part]] if part in self.special else self.cut_plain(part))]
        return self.cut_plain(text)

    def cut_plain(self, text: str) -> list[str]:
        if not text:
            return []
        if self.folds:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            return text.split() if not ODD_SPACE(text) else self.words(text)
        if LONG_SPACE(text):
            return [" " + w for w in self.words(text)]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts if len(parts[0]) > 1 else parts[1:]

    def chunk(self, key: str) -> list[str]:
        """The words of a part. Of texts cut at spaces, a part has a space before it unless its key begins with one.

        Letters, and letters with a mark after them, are told without the pre-tokeniser.
        """
        if key[0:1] == " ":
            return self.words(key[1:])
        space = "" if self.folds else " "
        if key.isalpha():
            return [space + key]
        if key[-1:] in MARKS and key[:-1].isalpha():
            return [space + key[:-1], key[-1]]
        return self.words(space + key)

    def key(self, word: str) -> str:
        """The key of the part that is just this word."""
        return word if self.folds else word[1:] if word[0] == " " and len(word) > 1 and not word[1].isspace() else " " + word

    def encode(self, text: str) -> list[int]:
        return [i for k in self.cut(text) for i in ([k] if isinstance(k, int) else self.encode_words(self.chunk(k))[0].tolist())]

    def decode(self, ids) -> str:
        if self.joined:
            return " ".join(self.token[i] for i in ids)
        return b"".join(self.raw[i] or self.token[i].encode() for i in ids).decode(errors="replace")


class PartCache:
    """What is made of the ids of each part of a text, kept for the parts met lately, in two generations.

    make(ids, bounds): a list of values for the runs of ids between bounds. join(values): the value of runs in a row.
    """

    def __init__(self, bpe: Bpe, make, join, most: int = 400_000):
        self.bpe, self.make, self.join, self.most = bpe, make, join, most
        self.held: dict = {}
        self.old: dict = {}

    def take(self, docs: list[list[str | int]]) -> dict:
        """The cache, with an entry for each part of docs."""
        if len(self.held) > self.most:
            self.old, self.held = self.held, {}
        held, old, space = self.held, self.old, "" if self.bpe.folds else " "
        fresh = (set().union(*docs) if docs else set()).difference(held)
        if old:
            known = fresh.intersection(old)
            held.update(zip(known, map(old.__getitem__, known), strict=True))
            fresh -= known
        numbers = [k for k in fresh if k.__class__ is int]
        fresh.difference_update(numbers)
        new = {k: space + k for k in filter(str.isalpha, fresh)}
        many = {}
        for k in fresh.difference(new):
            if k[-1:] in MARKS and k[:-1].isalpha():
                keys, words = (k[:-1], k[-1] if self.bpe.folds else " " + k[-1]), (space + k[:-1], k[-1])
            else:
                words = self.bpe.chunk(k)
                keys = list(map(self.bpe.key, words))
                if len(words) == 1:
                    new[k] = words[0]
                    continue
            many[k] = keys
            for own, w in zip(keys, words, strict=True):
                if own not in held and own not in new:
                    if own in old:
                        held[own] = old[own]
                    else:
                        new[own] = w
        ids, bounds = self.bpe.encode_words(list(new.values()))
        ids, bounds = np.concatenate((ids, np.array(numbers, np.int64))), np.concatenate((bounds, bounds[-1] + 1 + np.arange(len(numbers))))
        held.update(zip([*new, *numbers], self.make(ids, bounds.tolist()), strict=True))
        held.update((k, self.join([held[w] for w in ws])) for k, ws in many.items())
        return held


BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
ODD = np.uint64(0xD6E8FEB86659FD93)


class PartTable:
    """Token ids of whole texts, by a table from the 64-bit hashes of their parts to runs of a pool of ids.

    A part is a space and what follows it up to the next, or what a text begins with. Parts are hashed, told apart and
    put together again on arrays; only parts that the table lacks are decoded and encoded. Parts of one hash are compared
    by their bytes; where these differ the texts are encoded without the table.
    """

    def __init__(self, bpe: Bpe, most: int = 1_000_000):
        self.bpe, self.most = bpe, most
        self.clear()

    def clear(self) -> None:
        self.pool = np.zeros(1 << 16, np.uint32)
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.used = self.used_bytes = 0
        # a large sorted table and a small one with what came lately: hashes, starts and lengths of ids and of bytes
        self.tables = [[np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))] for _ in range(2)]

    def find(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Starts (-1: not there) and lengths in the pool, and the same of the parts' bytes."""
        found = [np.full(len(hashes), -1), *(np.zeros(len(hashes), np.int64) for _ in range(3))]
        for keys, *columns in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                for out, column in zip(found, columns, strict=True):
                    out[hit] = column[at[hit]]
        return found

    def add(self, hashes: np.ndarray, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, lens: np.ndarray) -> None:
        """hashes ascend; the ids of each lie between two bounds, its bytes, so many, one after another in raw."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        while self.used_bytes + len(raw) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros(len(self.bytes), np.uint8)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.bytes[self.used_bytes : self.used_bytes + len(raw)] = raw
        fresh = [hashes, self.used + bounds[:-1], np.diff(bounds), self.used_bytes + np.cumsum(lens) - lens, lens]
        self.used += len(ids)
        self.used_bytes += len(raw)
        self.tables[1] = self.merged(self.tables[1], fresh)
        if len(self.tables[1][0]) > max(100_000, len(self.tables[0][0]) // 3):
            self.tables = [self.merged(*self.tables), self.merged([x[:0] for x in fresh], [x[:0] for x in fresh])]

    @staticmethod
    def merged(a: list, b: list) -> list:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        by = np.argsort(both[0], kind="stable")
        return [x[by] for x in both]

    def encode_parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(list(map(len, texts)))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = data == 32
        first[0] = True
        first[ends] = True
        edges = np.flatnonzero(first)
        edges = edges if edges[-1] == len(data) else np.append(edges, len(data))
        starts, lens = edges[:-1], np.diff(edges)
        powers = np.full(int(lens.max()), ODD)
        powers[0] = 1
        powers = np.cumprod(powers)
        place = np.arange(len(data)) - np.repeat(starts, lens)
        sums = np.add.reduceat(BYTE_VALUES[data] * powers[place], starts) + lens.astype(np.uint64)
        hashes = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        seen, index, which = np.unique(hashes ^ (hashes >> np.uint64(29)), return_index=True, return_inverse=True)
        lead = index[which]
        if not (lens == lens[lead]).all() or not (data == data[np.repeat(starts[lead], lens) + place]).all():
            return self.plain(texts)
        start, size, at, n = self.find(seen)
        hit = np.flatnonzero(start >= 0)
        own, _ = taken(data, starts[index[hit]], lens[index[hit]])
        if not (n[hit] == lens[index[hit]]).all() or not (own == taken(self.bytes, at[hit], n[hit])[0]).all():
            return self.plain(texts)
        lacking = np.flatnonzero(start < 0)
        if len(self.tables[0][0]) + len(self.tables[1][0]) + len(lacking) > self.most:
            self.clear()
            lacking = np.arange(len(seen))
        if len(lacking):
            raw = data.tobytes()
            words: list[str] = []
            counts = []
            for a, n in zip(starts[index[lacking]].tolist(), lens[index[lacking]].tolist(), strict=True):
                part = raw[a : a + n].decode()
                if part[1:].isalpha() and part[0] == " ":
                    words.append(part)
                    counts.append(1)
                else:
                    found = self.bpe.words(part)
                    words += found
                    counts.append(len(found))
            number: dict[str, int] = {}
            order = [number.setdefault(w, len(number)) for w in words]
            ids, bounds = self.bpe.encode_words(list(number))
            flat, sizes = taken(ids, bounds[:-1][order], np.diff(bounds)[order])
            after = np.concatenate(([0], np.cumsum(sizes)))
            self.add(seen[lacking], flat, after[np.concatenate(([0], np.cumsum(counts)))], taken(data, starts[index[lacking]], lens[index[lacking]])[0], lens[index[lacking]])
            start, size, _, _ = self.find(seen)
        flat, sizes = taken(self.pool, start[which], size[which])
        after = np.concatenate(([0], np.cumsum(sizes)))
        return flat, after[np.searchsorted(starts, np.concatenate(([0], ends)))]

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode_parts without the table."""
        rows = [np.array(self.bpe.encode(t.decode()) if t else [], np.uint32) for t in texts]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = [self.bpe.folds or "<|" in t or bool(LONG_SPACE(t)) for t in texts]
        flat, at = self.encode_parts([b"" if o else t.encode() for t, o in zip(texts, odd, strict=True)])
        return [np.array(self.bpe.encode(t), np.uint32) if o else flat[s:e] for t, o, s, e in zip(texts, odd, at.tolist(), at[1:].tolist(), strict=False)]


def taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values one after another, and their sizes."""
    total = int(size.sum())
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)], size


CACHES: dict = {}


def cache_of(content: str, kind: str, make, join, most: int = 400_000) -> PartCache:
    """The cache of a vocabulary and a kind of values in this worker, which later tasks use again."""
    key = (hash(content), kind)
    if key not in CACHES:
        CACHES[key] = PartCache(load(content), make, join, most)
    return CACHES[key]


def table_of(content: str) -> PartTable:
    """The table of a vocabulary in this worker, which later tasks use again."""
    key = (hash(content), "table")
    if key not in CACHES:
        CACHES[key] = PartTable(load(content))
    return CACHES[key]


@lru_cache(maxsize=4)
def load(content: str) -> Bpe:
    return Bpe(content)
