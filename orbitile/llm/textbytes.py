"""Vectorised work on many UTF-8 texts at once.

Arrow hands a batch of strings over as one byte buffer with offsets. Everything
here (word limits, hashes of spans, shingles, SimHash lanes) is numpy work on
such buffers, a few megabytes at a time, so memory stays bounded whatever the
number of rows in a batch.

Hashes of spans come from prefix sums of ``table[byte] * BASE**position`` modulo
2**64, shifted back by the inverse power, then mixed: equal byte strings get equal
hashes wherever they stand, and a span costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes a slice of a batch holds at most, except a single longer text.
SLICE_BYTES = 1 << 20
#: Texts a slice holds at most; shingle keys keep this many values in 12 bits.
SLICE_TEXTS = 4000


def _geometric(ratio: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(ratio, done, 1 << 64))
        done += take
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(12, int(n).bit_length())
        _powers, _inverses = _geometric(BASE, size), _geometric(_INVERSE, size)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93) & _MASK) if salt else h.copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


#: One random-looking 64-bit value for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64), 11)
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, one text at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + SLICE_TEXTS, n)
        yield i, j
        i = j


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) for slices of a string column."""
    body, offsets = buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True in ``inside``; a run also ends at each cut."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~edge[1:n]
    return first, np.flatnonzero(inside & ~after) + 1


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for uint64 ``values``, order counts."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


class Words:
    """Words of a slice: hashes in text order and the first word of each text."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None, fold: np.ndarray = LOWER):
        self.start, self.end = spans(~WHITESPACE[body] if inside is None else inside[body], offsets)
        self.hashes = span_hashes(BYTE_VALUES[fold][body], self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)


def grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of ``width`` words within a text."""
    h, n = words.hashes, len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : n + k] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & _MASK)
    at = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    return mix(out[at], width), words.text[at], at


def whole(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of the whole word sequence of texts with 1 to width-1 words."""
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short) == 0:
        return np.zeros(0, np.uint64), short
    return mix(span_hashes(words.hashes, words.first[short], words.first[short + 1]), width + 64), short


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as 52-bit hashes sorted by (text, hash).

    With fewer than ``width`` words the whole sequence is one shingle; without
    words there is none. Returns the hashes and the first of each text.
    """
    words = Words(body, offsets)
    h, text, _ = grams(words, width)
    h2, text2 = whole(words, width)
    shift = np.uint64(12)
    keys = np.concatenate([(text.astype(np.uint64) << np.uint64(52)) | (h >> shift), (text2.astype(np.uint64) << np.uint64(52)) | (h2 >> shift)])
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), first


def sums_between(values: np.ndarray, first: np.ndarray, how=np.add, empty=0) -> np.ndarray:
    """``how``.reduce of values[first[i]:first[i+1]]; ``empty`` for empty ranges."""
    out = np.full(len(first) - 1, empty, values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = how.reduceat(values, first[some])
    return out


LANE = np.uint64(0x0001000100010001)


def lane_sums(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each range, how many of its 64-bit features have bit b set: (ranges, 64).

    Four bits are counted at a time in 16-bit lanes of one word; a range of more
    than 65,000 features is counted in parts.
    """
    sizes = np.diff(first)
    if len(sizes) and sizes.max() > 65000:
        parts = [np.arange(a, b, 65000) for a, b in zip(first[:-1], first[1:], strict=True)]
        owner = np.repeat(np.arange(len(sizes)), [len(p) for p in parts])
        cut = np.concatenate([*parts, [first[-1]]]).astype(np.int64)
        out = np.zeros((len(sizes), 64), np.int64)
        np.add.at(out, owner, lane_sums(features, cut))
        return out
    out = np.zeros((len(sizes), 64), np.int64)
    for k in range(16):
        packed = sums_between((features >> np.uint64(k)) & LANE, first)
        for lane in range(4):
            out[:, k + 16 * lane] = (packed >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    return out


def bits_to_long(bits: np.ndarray) -> np.ndarray:
    """(n, 64) booleans to n uint64, bit b from column b."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def simhash(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each range of features; a tied bit is 0."""
    return bits_to_long(2 * lane_sums(features, first) > np.diff(first)[:, None])
