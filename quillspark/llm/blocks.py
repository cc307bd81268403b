"""Vectorised byte and word helpers for Arrow batches: offsets, word spans, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers for hashes modulo 2**64 (fixed values).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xD6E8FEB86659FD93)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 booleans that is true at ``members``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and where each begins (one more offset at the end); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words come before each text (one more at the end)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.take(is_word, data, out=inside[:-1])
    first = np.empty(len(data) + 1, dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data) + 1, dtype=bool)
    np.logical_not(inside[1:], out=last[:-1])
    last[-1] = True
    last[offsets[1:] - 1] = True  # -1 of an empty first text sets the spare place
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place."""
    h ^= h >> np.uint64(32)
    h *= MIXER
    h ^= h >> np.uint64(29)
    h *= MULTIPLIER
    h ^= h >> np.uint64(32)
    return h


#: The low bytes of a 64-bit integer, by their number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one integer; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; equal words have equal hashes, wherever they stand.

    Every 8 bytes are mixed with their place before they are added, so that no regular pattern cancels out.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    before = np.cumsum(counts) - counts
    inner = np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(before, counts)
    at = np.repeat(starts, counts) + 8 * inner
    chunk = eights(data)[at]
    chunk &= LOW_BYTES[np.minimum(np.repeat(ends, counts) - at, 8)]
    chunk += (inner + 1).astype(np.uint64) * MIXER
    return mix(np.add.reduceat(mix(chunk), before) + lengths.astype(np.uint64))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each range of ``data`` whether the bytes of ``other`` from ``at`` on are the same, 8 bytes at a time."""
    counts = (ends - starts + 7) >> 3
    if not int(counts.sum()):
        return np.ones(len(starts), dtype=bool)
    before = np.cumsum(counts) - counts
    step = 8 * (np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(before, counts))
    place = np.repeat(starts, counts) + step
    differ = eights(data)[place] ^ eights(other)[np.repeat(at, counts) + step]
    differ &= LOW_BYTES[np.minimum(np.repeat(ends, counts) - place, 8)]
    some = counts > 0
    out = np.ones(len(starts), dtype=bool)
    out[some] = np.bitwise_or.reduceat(differ, before[some]) == 0
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words, whichever text they stand in."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    h = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        h *= MULTIPLIER
        h += words[k : len(words) - size + 1 + k]
        h ^= h >> np.uint64(31)
    return mix(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the runs start, start + 1, ..., one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
