"""Hashes of words and of word shingles for many texts at once, with NumPy on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Texts are worked on in groups of about so many bytes (a longer text is a group of its own).
GROUP_BYTES = 256 << 10
GROUP_TEXTS = 1 << 15
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES * 2)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def words_in(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and begin and end of each word; words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII."""
    low = _LOWER[buf]
    inside = _IN_WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    return low, np.flatnonzero(begins), np.flatnonzero(stops) + 1


class Hasher:
    """Hashes of any slices of ``low``, from sums over all of it."""

    def __init__(self, low: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(low))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of each word."""
    low, start, stop = words_in(buf, offsets)
    return np.searchsorted(offsets, start, side="right") - 1, Hasher(low).of(start, stop)


def shingle_counts(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and then id: text's number, id (48 bits), how often.

    A text with fewer words than ``size``, but any, is one shingle.
    """
    text, words = word_hashes(buf, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    first = np.cumsum(n) - n
    h = np.zeros(len(words), np.uint64)
    left = n[text] - (np.arange(len(words)) - first[text])  # words from here to the text's end
    ahead = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):  # words beyond the text's end count as 0, wherever the text stands
        h = h * _NEXT + np.where(left > k, ahead[k : k + len(h)], np.uint64(0))
    valid = (left >= size) | ((n[text] < size) & (left == n[text]))
    key = (text[valid].astype(np.uint64) << np.uint64(48)) | (mix(h[valid]) >> np.uint64(16))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, count = key[new], np.diff(np.append(new, len(key)))
    return (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << 48) - 1)).astype(np.int64), count


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column in groups of texts: first row, bytes and offsets. Nulls are empty."""
    data = pa.compute.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")
    if not len(data):
        return
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(data):
        hi = int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, side="right")) - 1
        hi = min(max(lo + 1, hi), lo + GROUP_TEXTS, len(data))
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
