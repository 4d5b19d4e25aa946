"""Words and their hashes for whole Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1_500_000
#: And rows, for very short texts.
SLICE_ROWS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE = np.uint64(1)
#: Masks of the first 0 to 8 bytes of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = int(_BASE)) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    return _powers(1 << max(6, int(n).bit_length()), base)[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, where each row's bytes start and end) of successive runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + most_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words (runs of other than ASCII white space) of a slice: start, end in bytes; first: number of the first word of each row, and at the end of all."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, word_byte: np.ndarray | None = None):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data] if word_byte is None else word_byte[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """Of each word, its row in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word, from its bytes alone."""
        if not len(self):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
        value = mix((eights[self.start].view(np.uint64).ravel() & _FIRST[np.minimum(size, 8)]) + np.uint64(seed * int(_BASE) % (1 << 64)))
        done, more = 8, np.flatnonzero(size > 8)
        while len(more):
            if done >= 64:  # the rest of very long words byte by byte
                rest = size[more] - done
                begin = np.cumsum(rest) - rest
                at = np.arange(int(rest.sum())) - np.repeat(begin, rest)
                letters = self.data[at + np.repeat(self.start[more] + done, rest)].astype(np.uint64) + _ONE
                value[more] = mix(value[more] * _BASE + np.add.reduceat(letters * powers(int(rest.max()))[at], begin))
                break
            value[more] = mix(value[more] * _BASE + (eights[self.start[more] + done].view(np.uint64).ravel() & _FIRST[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
        return mix(value + size.astype(np.uint64))

    def left(self) -> np.ndarray:
        """Of each word, how many words of its row start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))


def window_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of h[i:i+k] for each i; the last k - 1 values are void."""
    n, out, done, step, one = len(h), np.zeros(len(h), np.uint64), 0, 1, h.copy()
    while True:
        if k & step:  # out: hashes of `done` values; what `one` has of `step` values comes after them
            out = out * powers(step + 1, base)[step] + np.concatenate([one[done:], np.zeros(min(done, n), np.uint64)])
            done += step
        if done == k:
            return mix(out)
        one = one * powers(step + 1, base)[step] + np.concatenate([one[step:], np.zeros(min(step, n), np.uint64)])
        step *= 2


def strings(values: list | pa.Array) -> pa.Array:
    return pa.array(values, pa.string())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
