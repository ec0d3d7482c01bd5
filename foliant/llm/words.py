"""Words of many texts at once: where they begin, and which known word each of them is.

Texts are joined as UTF-8 and cut by the classes of their characters with array operations.
A word of up to 16 bytes is two numbers of eight bytes, padded with zeros, so that equal
numbers mean equal words: nothing rests on a hash alone. Known words stand in an
open-addressed table of these pairs; longer words are keys of a dict. What belongs to a word
(ids, say) lies in one flat array for all words and is gathered for whole batches.

A text with a character whose class is not sure, or with a NUL, is named, not cut: its
owner handles it alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Classes of bytes: between texts, letters, numbers, other characters, the space, other white space, not sure.
END, LETTER, NUMBER, OTHER, SPACE, BLANK, UNSURE = range(7)
#: Code points beyond have no entry in a table of classes.
LIMIT = 0x20000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: By number of bytes, which bits of eight bytes are theirs.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SHORT = 16


def class_table(of: Callable[[str], int]) -> np.ndarray:
    """The class of every code point; surrogates and those beyond LIMIT are not sure."""
    table = np.array([of(chr(c)) for c in range(LIMIT)] + [UNSURE], np.uint8)
    table[0xD800:0xE000] = UNSURE
    table[0] = END
    return table


class Batch:
    """Texts joined, each followed by a NUL."""

    def __init__(self, texts: Sequence[bytes], table: np.ndarray):
        self.raw = b"\0".join([*texts, bytes(2 * SHORT)])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        self.n = len(texts)
        #: Eight bytes from each place on, as one number.
        self.eights = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        self.cls = self._classes(table)

    def _classes(self, table: np.ndarray) -> np.ndarray:
        data = self.data
        narrow = np.append(table[:128], np.full(128, UNSURE, np.uint8))
        out = narrow[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = [data[lead + k].astype(np.int32) & 0x3F for k in range(4)]
            first = data[lead]
            wide, wider = first >= 0xE0, first >= 0xF0
            code = np.where(wider, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], np.where(wide, (b[0] & 15) << 12 | b[1] << 6 | b[2], (b[0] & 31) << 6 | b[1]))
            found = table[np.minimum(code, LIMIT)]
            out[lead] = out[lead + 1] = found
            out[lead[wide] + 2] = found[wide]
            out[lead[wider] + 3] = found[wider]
        return out

    def unsure(self) -> np.ndarray:
        """Whether each text holds a NUL or a character of class UNSURE."""
        flags = np.zeros(self.n, bool)
        at = np.flatnonzero(self.cls == UNSURE)
        if not self.n:
            return flags
        nul = np.flatnonzero(self.data[: self.ends[-1] + 1] == 0)
        if len(nul) > self.n:
            at = np.concatenate([at, np.setdiff1d(nul, self.ends, assume_unique=True)])
        flags[np.searchsorted(self.ends, at)] = True
        return flags

    def words(self, starts: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places and sizes of the words of the texts without a flag, and how many each text has.
        `starts`: whether a word begins at each byte."""
        at = np.flatnonzero(starts | (self.cls == END))
        if not len(at):
            return at, at, np.zeros(self.n, np.int64)
        first, size = at[:-1], np.diff(at)
        keep = self.cls[first] != END
        if flags.any():
            keep &= ~flags[np.minimum(np.searchsorted(self.ends, first), self.n - 1)]
        first, size = first[keep], size[keep]
        return first, size, np.diff(np.searchsorted(first, self.ends), prepend=0)


def class_runs(batch: Batch) -> np.ndarray:
    """Word starts where the class changes; spaces before a run belong to it."""
    cls = batch.cls
    out = np.empty(len(cls), bool)
    out[:1] = True
    np.logical_and(cls[1:] != cls[:-1], cls[:-1] != SPACE, out=out[1:])
    return out


def byte_bpe_runs(batch: Batch) -> np.ndarray:
    """Word starts by the split pattern of byte-level BPE: runs of a class with at most one space before, runs of white
    space without what belongs to the run after it, and contractions after an apostrophe."""
    cls, data = batch.cls, batch.data
    before, after = np.append(np.uint8(END), cls[:-1]), np.append(cls[1:], np.uint8(END))
    blank = cls >= SPACE
    ahead = blank & (after >= LETTER) & (after <= OTHER)
    out = np.where(blank, (before < SPACE) | ahead, (cls != before) & (before != SPACE))
    # White space of several bytes begins at its first.
    tail = np.flatnonzero(ahead & (data & 0xC0 == 0x80))
    if len(tail):
        out[tail] = False
        out[tail - 1 - (data[tail - 1] & 0xC0 == 0x80)] = True
    quote = np.flatnonzero((data == 0x27) & out & (cls != END))
    if len(quote):
        one, two = data[quote + 1], data[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long_ = np.isin(one.astype(np.uint16) << 8 | two, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
        quote, width = quote[short | long_], np.where(short, 2, 3)[short | long_]
        out[quote + 1] = False
        out[quote + width] |= cls[quote + width] == LETTER
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ... as one array."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Payload:
    """An array of some length for each word, in one flat array."""

    def __init__(self, dtype):
        self.flat, self.used = np.empty(1 << 12, dtype), 0
        self.starts, self.sizes, self.n = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(flat))
        self.starts, self.sizes = _room(self.starts, self.n + len(sizes)), _room(self.sizes, self.n + len(sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of some words, one after the other, and their sizes."""
        sizes = self.sizes[words]
        return self.flat[ragged(self.starts[words], sizes)], sizes

    def keep(self, words: np.ndarray) -> None:
        """From now on, only these words, in this order."""
        flat, sizes = self.take(words)
        self.used = self.n = 0
        self.append(flat, sizes)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.empty(max(n, len(array) + len(array) // 2), array.dtype)
    out[: len(array)] = array
    return out


class WordTable:
    """Numbers words from 0 on. It holds at most `most` words after `prune`, which keeps those used last."""

    def __init__(self, most: int):
        self.most, self.bits = most, 12
        self._clear()
        self.seen = np.zeros(1 << 10, np.int64)
        self.now = 0

    def _clear(self) -> None:
        self.k1, self.k2 = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.word = np.zeros(1 << self.bits, np.int32)
        self.long: dict[bytes, int] = {}
        self.size = 0

    @staticmethod
    def keys(batch: Batch, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k1 = batch.eights[first] & _MASK[np.minimum(size, 8)]
        k2 = np.zeros(len(first), np.uint64)
        more = np.flatnonzero(size > 8)
        k2[more] = batch.eights[first[more] + 8] & _MASK[np.minimum(size[more] - 8, 8)]
        return k1, k2

    def _home(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 ^ (k1 >> np.uint64(32))) * _M1 + k2 * _M2
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The number of each word; -1 for none."""
        at = self._home(k1, k2)
        held = self.k1[at]
        out = np.where((held == k1) & (self.k2[at] == k2), self.word[at], -1).astype(np.int64)
        left = np.flatnonzero((out < 0) & (held != 0))
        last = (1 << self.bits) - 1
        at = at[left]
        while len(left):
            at = (at + 1) & last
            held = self.k1[at]
            hit = (held == k1[left]) & (self.k2[at] == k2[left])
            out[left[hit]] = self.word[at[hit]]
            go = ~hit & (held != 0)
            left, at = left[go], at[go]
        return out

    def _put(self, k1: np.ndarray, k2: np.ndarray, words: np.ndarray) -> None:
        """Enters words that are not there and are all different."""
        at, last = self._home(k1, k2), (1 << self.bits) - 1
        left = np.arange(len(k1))
        while len(left):
            free = self.k1[at] == 0
            # Of several that want one place one gets it: the last one written.
            place, own = at[free], left[free]
            self.word[place] = words[own]
            won = self.word[place] == words[own]
            self.k1[place[won]], self.k2[place[won]] = k1[own[won]], k2[own[won]]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free)[won]] = False
            left, at = left[go], (at[go] + 1) & last

    def _grow(self, n: int) -> None:
        """Room for n more words; at most two thirds of the places are taken."""
        if 3 * (self.size + n) > 2 << self.bits:
            k1, k2, word = self.k1[self.k1 != 0], self.k2[self.k1 != 0], self.word[self.k1 != 0]
            self.bits = int(3 * (self.size + n) // 2).bit_length()
            self.k1, self.k2 = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
            self.word = np.zeros(1 << self.bits, np.int32)
            self._put(k1, k2, word)

    def find(self, batch: Batch, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word of a batch; -1 for none."""
        k1, k2 = self.keys(batch, first, size)
        out = self._find(k1, k2)
        far = np.flatnonzero(size > SHORT)
        if len(far):
            get, raw = self.long.get, batch.raw
            out[far] = [get(raw[a:b], -1) for a, b in zip(first[far].tolist(), (first[far] + size[far]).tolist())]
        return out

    def place(self, batch: Batch, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word of a batch, and the words that are new and got the next numbers, in their order."""
        out = self.find(batch, first, size)
        new: list[bytes] = []
        lost = np.flatnonzero(out < 0)
        if len(lost):
            raw = batch.raw
            short, far = lost[size[lost] <= SHORT], lost[size[lost] > SHORT]
            k1, k2 = self.keys(batch, first[short], size[short])
            order = np.lexsort((k2, k1))
            k1, k2, short = k1[order], k2[order], short[order]
            head = np.ones(len(short), bool)
            head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            out[short] = self.size + np.cumsum(head) - 1
            new = [raw[a:b] for a, b in zip(first[short[head]].tolist(), (first[short[head]] + size[short[head]]).tolist())]
            self._grow(len(new))
            self._put(k1[head], k2[head], out[short[head]])
            for k in far.tolist():
                word = raw[first[k] : first[k] + size[k]]
                number = self.long.get(word)
                if number is None:
                    number = self.long[word] = self.size + len(new)
                    new.append(word)
                out[k] = number
            self.size += len(new)
            self.seen = _room(self.seen, self.size)
        self.now += 1
        self.seen[out] = self.now
        return out, new

    def enter(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Gives words of at most 16 bytes, all new and different, the next numbers."""
        self._grow(len(k1))
        self._put(k1, k2, np.arange(self.size, self.size + len(k1)))
        self.size += len(k1)
        self.seen = _room(self.seen, self.size)

    def short_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two numbers of each word of at most 16 bytes, and its own."""
        used = self.k1 != 0
        return self.k1[used], self.k2[used], self.word[used].astype(np.int64)

    def prune(self) -> np.ndarray | None:
        """Beyond `most` words, keeps half as many, those used last, and returns their old numbers in the order of the new ones."""
        if self.size <= self.most:
            return None
        return self.keep(np.sort(np.argpartition(self.seen[: self.size], self.size - self.most // 2)[self.size - self.most // 2 :]))

    def keep(self, kept: np.ndarray) -> np.ndarray:
        """From now on, only these words, numbered in this order."""
        seen = self.seen[: self.size]
        number = np.full(self.size, -1, np.int64)
        number[kept] = np.arange(len(kept))
        used = np.flatnonzero(self.k1)
        used = used[number[self.word[used]] >= 0]
        k1, k2, words, long_ = self.k1[used], self.k2[used], number[self.word[used]], self.long
        self._clear()
        self._put(k1, k2, words)
        self.long = {w: int(number[k]) for w, k in long_.items() if number[k] >= 0}
        self.size = len(kept)
        self.seen[: len(kept)] = seen[kept]
        return kept
