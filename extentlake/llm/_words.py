"""Vectorised words, shingles and rolling hashes over Arrow string batches (numpy, no Python loop over words).

A word's hash sums a mixed value of every byte and its place in the word, modulo 2^64; sums of mixed values have no
structure that a text could repeat. Windows of words are polynomials in these hashes modulo 2^64: prefix sums give the
hash of every window by one subtraction, which is Rabin and Karp's rolling hash in closed form. Windows of fewer than
1024 words that differ have equal hashes with a probability of about 2^-64, and 2^-45 for those that swap two words in
the one pattern (Thue and Morse's) on which powers of two lose digits.

Texts are worked on in parts of bounded size: many short texts together, a long one in several parts that overlap.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ._common import process_cache

U = np.uint64
#: Texts are worked on in parts of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_SALT, CHECK_SALT = 0x9E3779B97F4A7C15, 0xA24BAED4963EE407
#: Places in a word whose mixed values are looked up; those of later places are computed.
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least; kept for the process."""
    size = 1 << max(16, int(n - 1).bit_length())
    kept = process_cache()
    if (base, size) not in kept:
        with np.errstate(over="ignore"):
            up, down = (np.full(size, b % 2**64, U) for b in (base, pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            kept[base, size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return kept[base, size]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[starts[i]:ends[i]], the same wherever the values stand."""
    up, down = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def _byte_values(data: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Mixed values of bytes and their places in their words."""
    kept = process_cache()
    if ("bytes", salt) not in kept:
        with np.errstate(over="ignore"):
            kept["bytes", salt] = mix(np.arange(_PLACES << 8, dtype=U) + U(salt))
    at = (places << 8) | data
    table = kept["bytes", salt]
    out = table[np.minimum(at, len(table) - 1)]
    far = np.flatnonzero(at >= len(table))
    if len(far):
        out[far] = mix(at[far].astype(U) + U(salt))
    return out


def as_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type != pa.large_string():
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def string_slices(array: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most about ``limit`` bytes, one row at least."""
    limit = limit or SLICE_BYTES
    data, offsets = as_bytes(array)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words (runs of bytes other than 0x20 and 0x09 to 0x0D) of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~space[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words[bounds[i]:bounds[i + 1]] are those of text i.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def word_hashes(self, salt: int) -> np.ndarray:
        out, k = np.zeros(len(self.starts), U), 0
        with np.errstate(over="ignore"):
            while k < len(out):
                end = max(k + 1, int(np.searchsorted(self.ends, self.starts[k] + 2 * SLICE_BYTES, "right")))
                a, b = self.starts[k], self.ends[end - 1]
                if end == k + 1:
                    # One word, however long.
                    for c in range(a, b, SLICE_BYTES):
                        part = self.data[c : min(b, c + SLICE_BYTES)]
                        out[k] += _byte_values(part, np.arange(c - a, c - a + len(part)), salt).sum(dtype=U)
                else:
                    starts, ends = self.starts[k:end] - a, self.ends[k:end] - a
                    places = np.arange(b - a) - np.repeat(starts, np.diff(starts, append=b - a))
                    edges = np.stack([starts, ends], 1).ravel()[:-1]
                    out[k:end] = np.add.reduceat(_byte_values(self.data[a:b], places, salt), edges)[::2]
                k = end
            return mix(out + (self.ends - self.starts).astype(U) * U(salt))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.word_hashes(_SALT)

    @functools.cached_property
    def check_hashes(self) -> np.ndarray:
        """Hashes of the words that don't depend on ``hashes``."""
        return self.word_hashes(CHECK_SALT)

    @functools.cached_property
    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, width: int) -> np.ndarray:
        """Indices of the words where a window of ``width`` words of one text starts."""
        n = len(self.starts)
        at = np.arange(max(0, n - width + 1))
        return at[self.docs[at] == self.docs[at + width - 1]] if len(at) else at

    def window_hashes(self, starts: np.ndarray, width: int, base: int = _WORD_BASE, check: bool = False) -> np.ndarray:
        """Rolling (Rabin-Karp) hash of the ``width`` words from each start."""
        with np.errstate(over="ignore"):
            return mix(ranges_hash(self.check_hashes if check else self.hashes, starts, starts + width, base))

    def whole_hashes(self, texts: np.ndarray) -> np.ndarray:
        """Hash of all words of each of ``texts``."""
        with np.errstate(over="ignore"):
            return mix(ranges_hash(self.hashes, self.bounds[texts], self.bounds[texts + 1], _WORD_BASE) + self.counts[texts].astype(U))

    def joined(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words of ``keep`` (a mask), each with a space behind it, and where each text ends in that."""
        at = np.flatnonzero(keep)
        size = self.ends[at] - self.starts[at] + 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = np.append(self.data, np.uint8(32))[np.repeat(self.starts[at] - (ends - size), size) + np.arange(total)]
        out[ends - 1] = 32
        return out.tobytes(), np.concatenate([[0], ends])[np.searchsorted(at, self.bounds)]


class Part(NamedTuple):
    """Words of texts row to end - 1; of a long text a part: its first ``skip`` words are the last ones of the part before."""

    row: int
    end: int
    skip: int
    last: bool
    words: Words


def _cut(data: np.ndarray, at: int, space: np.ndarray) -> int:
    """The first place from ``at`` on that isn't inside a word."""
    while at < len(data):
        here = np.flatnonzero(space[data[at : at + 4096]])
        if len(here):
            return at + int(here[0])
        at += 4096
    return len(data)


def parts(array, overlap: int, lower: bool = False, space: np.ndarray = _SPACE) -> Iterator[Part]:
    """Words of consecutive texts. A text above SLICE_BYTES comes alone, in parts that begin with the last ``overlap`` words
    of the one before, so every window of overlap + 1 words lies in exactly one part."""
    for row, end, data, offsets in string_slices(array):
        if len(data) <= SLICE_BYTES:
            yield Part(row, end, 0, True, Words(data, offsets, lower, space))
            continue
        at, skip, size = 0, 0, SLICE_BYTES
        while True:
            stop = _cut(data, at + size, space)
            w = Words(data[at:stop], np.array([0, stop - at]), lower, space)
            if stop == len(data):
                yield Part(row, end, skip, True, w)
                break
            if len(w.starts) <= overlap:
                size *= 2
                continue
            yield Part(row, end, skip, False, w)
            at, skip, size = (at + int(w.starts[len(w.starts) - overlap]) if overlap else stop), overlap, SLICE_BYTES


def shingle_sets(array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds): distinct hashes of the k-word shingles (A-Z lower-cased), sorted within each text.

    A text of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    held: list[np.ndarray] = []
    for p in parts(array, k - 1, lower=True):
        w = p.words
        at = w.window_starts(k)
        h = w.window_hashes(at, k)
        if held or not p.last:
            held.append(h)
            if p.last:
                h = np.concatenate(held)
                held = []
                h.sort()
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
                yield p.row, p.end, h, np.array([0, len(h)])
            continue
        docs = w.docs[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            h, docs = np.concatenate([h, w.whole_hashes(short)]), np.concatenate([docs, short])
            order = np.argsort(docs, kind="stable")
            h, docs = h[order], docs[order]
        bounds = np.searchsorted(docs, np.arange(len(w.counts) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
        yield p.row, p.end, h[new], np.searchsorted(docs[new], np.arange(len(w.counts) + 1))
