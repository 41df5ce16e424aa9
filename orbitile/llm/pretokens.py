"""Pre-tokens of the public byte-level tokenizers, found with numpy.

The split is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
and is tested against a regular-expression engine. Stated as rules on runs of
characters of one class (letters, numbers, white space, others):

* a run of letters, numbers or others is one pre-token, with the one U+0020 before it;
* of white space before other text, the last character stands apart: a U+0020 joins
  what follows, another is a pre-token; the characters before it are one pre-token;
* an apostrophe that starts a pre-token takes a following s, t, m, d, re, ve or ll.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from orbitile.llm.textbytes import span_hashes

#: Characters of the Unicode property White_Space (fixed values).
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    import regex

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    out[SPACES] = SPACE
    return out


class Pretokens:
    """Pre-tokens of a slice: code point spans, hashes, and the text of each."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        self.string = body.tobytes().decode("utf-8", "replace")
        p = np.frombuffer(self.string.encode("utf-32-le"), np.uint32)
        n = len(p)
        self.char_bytes = np.flatnonzero((body & 0xC0) != 0x80)
        self.text_at = np.searchsorted(self.char_bytes, offsets)
        opening = np.zeros(n + 1, bool)
        opening[self.text_at] = True
        c = classes()[p]
        change = np.ones(n, bool)
        change[1:] = (c[1:] != c[:-1]) | opening[1:n]
        start = change.copy()
        if n > 1:
            spaced = np.zeros(n, bool)
            spaced[1:] = (p[:-1] == 32) & ~opening[1:n]
            start[change & (c != SPACE) & spaced] = False
            last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~opening[1:n])
            start[last] = True
            self._contract(p, c, opening, start)
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], n)
        self.hashes = span_hashes(p.astype(np.uint64) + np.uint64(1), self.start, self.end) if n else np.zeros(0, np.uint64)
        self.text = np.searchsorted(self.text_at, self.start, side="right") - 1
        self.texts = len(offsets) - 1

    @staticmethod
    def _contract(p, c, opening, start):
        n = len(p)
        at = np.flatnonzero((p[:-1] == 39) & start[:-1] & (c[1:] == LETTER) & ~opening[1:n])
        if len(at) == 0:
            return
        one = p[at + 1]
        third = np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~opening[third], p[third], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((short, 1), (long & ~short, 2)):
            i = at[chosen]
            start[i + 1] = False
            j = i + 1 + size
            j = j[j < n]
            start[j[(c[j] == LETTER) & ~opening[j]]] = True

    def strings(self, which: np.ndarray) -> list[str]:
        s = self.string
        return [s[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class Memo:
    """Results of pre-tokens by hash, each a few integers, as sorted arrays.

    A worker keeps one between batches. It is emptied when it passes ``limit``
    entries, which costs time only.
    """

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Indices of ``keys`` (sorted, distinct) that are not held."""
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        if len(self.keys) == 0:
            return np.arange(len(keys))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[i] != keys)

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        at = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, sizes)

    def expand(self, keys: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All results of keys[inverse] end to end, and the size of each."""
        i = np.searchsorted(self.keys, keys)
        size, at = self.size[i][inverse].astype(np.int64), self.at[i][inverse]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(at - before, size)], size


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the first place of each, and the inverse."""
    return np.unique(hashes, return_index=True, return_inverse=True)
