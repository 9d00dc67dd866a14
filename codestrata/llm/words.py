"""Words and word n-grams of a batch of texts as numpy arrays of 64-bit hashes.

A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
Two different words share a hash with a chance of about 2 to the power of -64.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG_WORD = 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x):
    """Bijective mixing of 64-bit words (the public SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``data``, eight bytes a step; very long ranges go through BLAKE2."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,)) if len(data) else np.zeros(0, np.uint64)
    length = end - start
    out = mix(length.astype(np.uint64) + _A)
    live = np.flatnonzero((length <= LONG_WORD) & (length > 0))
    at, left = start[live], length[live]
    while len(live):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        out[live] = mix((out[live] ^ lane) + _A)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


class Words:
    """Words of the texts of an Arrow large-string array without nulls.

    ``start``/``end``: byte range of each word in ``data``; ``first``: index of the first word of each text, with the
    number of all words as last element.
    """

    def __init__(self, array):
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        raw = array.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        self.data, self.offsets, self.n_texts = data, offsets - offsets[0], len(array)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.offsets] = True
        inside = ~blank
        opens = inside.copy()
        opens[1:] &= blank[:-1] | edge[1:-1]
        closes = inside
        closes[:-1] &= blank[1:] | edge[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def chars(self) -> np.ndarray:
        """Code points in each word: its bytes that don't continue a character."""
        leads = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=leads[1:])
        return leads[self.end] - leads[self.start]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``lower`` folds ASCII letters."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        return hash_ranges(data, self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``n``-grams within texts and the index of each one's first word."""
        return grams(hashes, self.first, n)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``Words.grams``, for any hashes whose groups begin at ``first``."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(last, dtype=bool)
    for k in range(1, n):  # an n-gram may not cross the start of a group
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < last)]] = False
    at = np.flatnonzero(inside)
    out = hashes[at]
    for k in range(1, n):
        out = mix(out * _A + hashes[at + k])
    return out, at
