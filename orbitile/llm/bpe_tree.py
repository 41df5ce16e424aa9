"""Byte-level BPE by tree reduction over the text, and decoding up the tree.

Encodings of adjacent texts form a monoid. A text is split into halves down to small
leaves; leaves are encoded by the ranks' base encoder; neighbours are joined by
encoding a window around their seam again. The window grows on both sides until it
begins and ends at a *hard boundary*: a place where a non-space character is followed
by white space. No match of the pre-token pattern crosses such a place, no match
before it looks beyond it in a way that changes it, and what follows depends only on
the text from there, so

    encode(a + b) = encode(a) + encode(b)   at a hard boundary,

and tokens outside the window are those of the whole text.

Cases: a null text is empty and has no tokens; a text without white space is one
window; equal texts get equal rows, repeated rows included; columns beyond doc_id and
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm.pretokens import SPACES

#: Characters of a leaf: most texts are many leaves long and go through joins.
LEAF_CHARS = 256
FIRST_WINDOW = 32
LEAF_IDS = 8192
_SPACE = frozenset(map(chr, SPACES))


class Codec:
    """A rank file with its pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {i: b for b, i in ranks.items()}.__getitem__
        self.decimal = {i: str(i) for i in ranks.values()}.__getitem__

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.base(text)
        middle = len(text) // 2
        a, b = text[:middle], text[middle:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def join(self, a: str, ids_a: list[int], b: str, ids_b: list[int]) -> list[int]:
        """Encoding of a + b from those of a and b."""
        if not a or not b or (a[-1] not in _SPACE and b[0] in _SPACE):
            return ids_a + ids_b
        cut_a, cut_b = last_boundary(a), first_boundary(b)
        before, after = self.encode_window(a[cut_a:]), self.encode_window(b[:cut_b])
        seam = self.encode_window(a[cut_a:] + b[:cut_b])
        return ids_a[: len(ids_a) - len(before)] + seam + ids_b[len(after) :]

    def encode_window(self, text: str) -> list[int]:
        return self.base(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def last_boundary(text: str) -> int:
    """The last hard boundary inside ``text``, or 0: windows grow to the left."""
    size = FIRST_WINDOW
    while True:
        low = max(0, len(text) - size)
        for i in range(len(text) - 1, max(low, 0), -1):
            if text[i] in _SPACE and text[i - 1] not in _SPACE:
                return i
        if low == 0:
            return 0
        size *= 2


def first_boundary(text: str) -> int:
    """The first hard boundary inside ``text``, or its end: windows grow to the right."""
    for i in range(1, len(text)):
        if text[i] in _SPACE and text[i - 1] not in _SPACE:
            return i
    return len(text)


@lru_cache(2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""

    def run(batches):
        codec = _codec(path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(codec.decimal, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
