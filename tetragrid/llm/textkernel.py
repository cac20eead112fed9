"""Vectorised word, shingle and digest kernels shared by the text operators.

Arrow string columns are read as one byte buffer; every step works on whole
slices of documents with numpy.  A word is a maximal run of characters other
than space, tab, newline, vertical tab, form feed and carriage return; all of
these are ASCII, so UTF-8 bytes split exactly as code points do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed))


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = _stream(256, 11)
_BYTE[_IS_SEP] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _stream(4096, 23) | np.uint64(1)
_SHINGLE = _stream(64, 37) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row stands alone."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


@dataclass
class Words:
    """The words of some documents: word i is data[start[i]:end[i]]; those of document d are first[d]..first[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A-Z count as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        table = _BYTE_LOWER if lower else _BYTE
        origin = np.zeros(len(self.data), np.int32 if len(self.data) < 1 << 31 else np.int64)
        origin[self.start[1:]] = np.diff(self.start)
        origin[: self.start[0]] = 0
        place = np.arange(len(self.data), dtype=origin.dtype) - np.cumsum(origin, dtype=origin.dtype) - self.start[0]
        np.maximum(place, 0, out=place)
        longest = int((self.end - self.start).max())
        factors = _PLACE if longest <= len(_PLACE) else _stream(longest, 23) | np.uint64(1)
        np.minimum(place, longest - 1, out=place)  # what stands after a word is a separator and counts 0
        values = table[self.data]
        values *= factors[place]
        sums = np.add.reduceat(values, self.start)
        return mix(sums + (self.end - self.start).astype(np.uint64) * _GOLDEN)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Splits the documents data[offsets[d]:offsets[d+1]] into words."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    offsets = offsets - base
    inside = ~_IS_SEP[part]
    before = np.empty(len(part), bool)
    if len(part):
        before[0] = False
        before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(part))]
    before[cuts] = False  # a word never reaches over two documents
    after = np.empty(len(part), bool)
    if len(part):
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(part, start, end, np.searchsorted(start, offsets), offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-word shingles and each document's range in them; a document of fewer words has one, of them all."""
    n = np.diff(first)
    full = np.maximum(n - k + 1, 0)
    count = np.where(n > 0, np.maximum(full, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    if len(hashes) >= k:
        wide = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            wide += hashes[j : len(hashes) - k + 1 + j] * _SHINGLE[j]
        long = np.flatnonzero(full)
        at = np.repeat(first[long] - bounds[long], count[long]) + np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in long]) if len(long) else np.zeros(0, np.int64)
        to = np.repeat(full > 0, count)
        out[to] = mix(wide[at])
    for d in np.flatnonzero((n > 0) & (full == 0)):
        own = hashes[first[d] : first[d + 1]]
        out[bounds[d] : bounds[d] + 1] = mix((own * _SHINGLE[: len(own)]).sum(keepdims=True) + np.full(1, len(own), np.uint64) * _GOLDEN)
    return out, bounds


def is_separator(data: np.ndarray) -> np.ndarray:
    return _IS_SEP[data]


_BYTE_ALL = _stream(256, 51)
_BYTE_ANY = _BYTE_ALL.copy()
_BYTE_ANY[10] = 0


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Start and end of every line of at least one byte, its newline counted; \n alone ends a line, and so does a document."""
    start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]).astype(np.int64))
    start = start[start < len(data)]
    return start, np.append(start[1:], len(data))


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, newline: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the consecutive segments data[start:end]; unless newline is set, one at the end is left out."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    place = np.arange(len(data)) - np.repeat(start, size)
    factors = _PLACE if size.max() <= len(_PLACE) else _stream(int(size.max()), 23) | np.uint64(1)
    sums = np.add.reduceat((_BYTE_ALL if newline else _BYTE_ANY)[data] * factors[place], start)
    if not newline:
        size = size - (data[end - 1] == 10)
    return mix(sums + size.astype(np.uint64) * _GOLDEN)
