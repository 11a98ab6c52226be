"""Vectorised text segmentation over blocks of documents.

A block of texts is turned into one array of code points; word boundaries,
word hashes and document offsets are computed with numpy over the whole
block, so no Python code runs per character or per word.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4
#: Characters held in one block; a longer single document makes a block of its own.
BLOCK_CHARS = 250_000
#: The White_Space property of Unicode, fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """One class code per code point, from the general categories."""
    cats = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out = np.full(len(cats), OTHER, np.uint8)
    out[cats == ord("L")] = LETTER
    out[cats == ord("N")] = NUMBER
    out[_WHITE] = SPACE
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(0x5EED).integers(0, 2**64, 1 << 16, dtype=np.uint64)


@functools.cache
def _places(n: int) -> np.ndarray:
    """Odd random multipliers of the first n places within a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """(first, last) index ranges whose total length stays near the limit."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the n + 1 offsets of the texts."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), off


def run_starts(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins; runs never span two texts."""
    new = np.empty(len(key), bool)
    if len(key):
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[off[:-1][off[:-1] < len(key)]] = True
    return new


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (ascending, apart): random letter values times random multipliers of their places in
    the span, summed. No power of one base is involved, so that no pattern of letters collides by its form."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.zeros(len(cp), np.int64)
    at[starts] = starts
    at = np.arange(len(cp)) - np.maximum.accumulate(at)
    val = _letters()[(cp ^ (cp >> 16)) & 0xFFFF]
    val += cp
    val *= _places(1 << max(16, int(at.max()).bit_length()))[at]
    run = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(val, out=run[1:])
    return mix(run[ends] - run[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _contractions(cp: np.ndarray, cls: np.ndarray, doc: np.ndarray, new: np.ndarray) -> None:
    """Joins the suffixes s t m d re ve ll to apostrophes that begin a token; changes `new` in place."""
    n = len(cp)
    at = np.flatnonzero((cp == 39) & new)
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & ~doc[at + 1]]
    if not len(at):
        return
    third = np.minimum(at + 2, n - 1)
    one, two = cp[at + 1], cp[third]
    same = (at + 2 < n) & (cls[third] == LETTER) & ~doc[third]
    k = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for pair in ("re", "ve", "ll"):
        k[same & (one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    at, k = at[k > 0], k[k > 0]
    new[at + 1] = False
    end = at + 1 + k
    new[end[end < n]] = True


def split_words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of letters, single numbers and other runs, with contractions; white space is dropped.

    cp: lower-cased code points. The rule of word-level BPE:
    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
    """
    cls = classes()[cp]
    doc = text_starts(len(cp), off)
    new = run_starts(cls, off)
    new |= cls == NUMBER
    _contractions(cp, cls, doc, new)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    keep = cls[starts] != SPACE
    return starts[keep], ends[keep]


def split_bytes_bpe(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the byte-level BPE rule, covering every character:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    cls = classes()[cp]
    doc = text_starts(n, off)
    new = run_starts(cls, off)
    # the last white-space character before a visible one: joins it when it is a blank, else stands alone
    nxt_visible = np.zeros(n, bool)
    if n > 1:
        nxt_visible[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~doc[1:]
    last = np.flatnonzero(nxt_visible)
    new[last] = True
    joined = last[cp[last] == 32]
    new[joined + 1] = False
    _contractions(cp, cls, doc, new)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def text_starts(n: int, off: np.ndarray) -> np.ndarray:
    doc = np.zeros(n, bool)
    doc[off[:-1][off[:-1] < n]] = True
    return doc


def plain_words(cp: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Spans of letters and digits."""
    word = np.isin(classes()[cp], (LETTER, NUMBER))
    new = run_starts(word, off)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    keep = word[starts] if len(starts) else np.empty(0, bool)
    return starts[keep], ends[keep]


def first_seen(codes: np.ndarray, n: int) -> np.ndarray:
    """The first index of each code 0..n-1."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def ragged(flat_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices flat_starts[i] + 0..lengths[i]-1 of all i in a row."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(flat_starts - (ends - lengths), lengths)


class HashIndex:
    """Unsigned 64-bit keys -> numbers, by open addressing; whole arrays are added and looked up at once."""

    def __init__(self, size: int = 1 << 12) -> None:
        self.key, self.val = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.n, self.shift = 0, np.uint64(64 - size.bit_length() + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        mask, slot = len(self.key) - 1, self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.val[slot], -1)
        on = np.flatnonzero((there != keys) & (there != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & mask
            there = self.key[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.val[slot[on[hit]]]
            on = on[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there."""
        if 4 * (self.n + len(keys)) > len(self.key):
            old, size = self.key != 0, len(self.key)
            while 4 * (self.n + len(keys)) > size:
                size *= 2
            grown = HashIndex(size)
            grown._put(self.key[old], self.val[old])
            self.key, self.val, self.shift = grown.key, grown.val, grown.shift
        self._put(keys, values)
        self.n += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys = np.where(keys == 0, np.uint64(1), keys)
        mask, slot, on = len(self.key) - 1, self._slot(keys), np.arange(len(keys))
        while len(on):
            free = on[self.key[slot[on]] == 0]
            self.key[slot[free]] = keys[free]
            done = self.key[slot[on]] == keys[on]
            self.val[slot[on[done]]] = values[on[done]]
            on = on[~done]
            slot[on] = (slot[on] + 1) & mask
