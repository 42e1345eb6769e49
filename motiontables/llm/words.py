"""Words of whole Arrow batches as numpy arrays: where each begins and ends, and a 64-bit hash of each.

Texts are taken as UTF-8 bytes. A null text has no words. Batches are cut into slices of about a
quarter megabyte at document borders, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shared import mix64, stream

SLICE_BYTES = 256 << 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.ones(256, bool)  # ASCII letters, ASCII digits and every byte of a longer character
ALNUM[:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False
BYTE_VALUE = stream(11, 256)[LOWER]  # A-Z weigh as a-z
BASE = int(stream(12, 1)[0]) | 1

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64, for i < n at least."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[key] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any stretch of bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


@dataclass
class Slice:
    """Documents first..first+len(offsets)-2 of a batch; word i is data[start[i]:end[i]]."""

    first: int
    offsets: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray  # words of each document
    hashes: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Where the words of each document begin; one more entry for the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column, nulls as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    place = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return place, raw


def byte_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, offsets from 0, bytes) for runs of whole documents of about ``size`` bytes."""
    place, raw = bytes_of(column)
    at, n = 0, len(place) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(place, place[at] + size, "right")) - 1)
        yield at, place[at: to + 1] - place[at], raw[place[at]: place[to]]
        at = to


def word_spans(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the count per document of the words, runs of bytes for which ``inside`` holds."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    own = inside[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins = own.copy()
    begins[1:] &= ~own[:-1] | border[1:n]
    ends = own.copy()
    ends[:-1] &= ~own[1:] | border[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def slices(column: pa.Array, inside: np.ndarray = NOT_SPACE) -> Iterator[Slice]:
    for first, offsets, data in byte_slices(column):
        start, end, counts = word_spans(offsets, data, inside)
        with np.errstate(over="ignore"):
            hashes = mix64(span_hash(prefix_hash(data, BYTE_VALUE), start, end) + (end - start).astype(np.uint64))
        yield Slice(first, offsets, data, start, end, counts, hashes)


def hash_words(text: bytes, inside: np.ndarray = NOT_SPACE) -> np.ndarray:
    return next((s.hashes for s in slices(pa.array([text], pa.large_binary()), inside)), np.zeros(0, np.uint64))
