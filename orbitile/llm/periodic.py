"""Detection of periodic runs of words with string synchronising sets.

A run is a stretch of words with smallest period q and length of at least
max(6, 4 * q) that cannot be extended with that period.

1. Words become 64-bit fingerprints; texts of a slice stand in one array, parted by
   values that occur once, so that no run reaches over two texts.
2. Periods below SMALL are read from the array and itself moved by q: where both agree on
   a long stretch there is a run.
3. Greater periods come scale by scale, T = 8, 16, ... A window of T words whose period is
   at most T / 4 lies in a highly periodic region; these regions are known, as runs of
   smaller periods have been found before. Positions i whose window, or that at i + T, has
   the least hash of all windows at i .. i + T outside such regions form the scale's
   synchronising set: whether i belongs to it depends on 2T words only, and every T
   positions outside the regions hold one. Two neighbours of the set with the same 2T words,
   T <= q < 2T apart, propose period q. A run of such a period has its first set position
   within T words and length for the next one, q further, so it is proposed; nothing smaller
   than its period can be proposed in between, as 2T + q words with two periods would have
   their divisor as period.
4. Proposals of one stretch are joined and extended to both sides, T words at a time.

Memory is a few arrays of a slice's words: 1 MB of texts, or one longer text; time is
proportional to the words, for each scale. All texts are independent, so nothing is
shuffled and a lost executor costs its own slices.

Cases: a null or empty text, or one without words, has no run and collapses to an empty
text; repeated rows come out as often as they went in; a null doc_id is kept; columns other
than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.textbytes import BYTE_VALUES, WHITESPACE, mix, span_hashes, spans, text_slices

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods below this one, a power of two, are found by moving the array.
SMALL = 8
_LAST = np.uint64((1 << 64) - 1)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of True."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, _LAST)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _extended(w: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of period q taken as far as they go to both sides."""
    start, end = start.copy(), end.copy()
    ahead = np.arange(step)
    for side in (0, 1):
        open_ = np.arange(len(start))
        while len(open_):
            # a few stretches at a time: their number times the step is bounded
            left = []
            for part in np.array_split(open_, max(1, len(open_) * step >> 20)):
                if side:
                    at = end[part][:, None] + ahead
                    good = (at < len(w)) & (w[np.minimum(at, len(w) - 1)] == w[np.minimum(at, len(w) - 1) - q[part][:, None]])
                else:
                    at = start[part][:, None] - 1 - ahead
                    good = (at >= 0) & (w[np.maximum(at, 0)] == w[np.minimum(np.maximum(at, 0) + q[part][:, None], len(w) - 1)])
                took = np.where(good.all(axis=1), step, np.argmin(good, axis=1))
                if side:
                    end[part] += took
                else:
                    start[part] -= took
                left.append(part[took == step])
            open_ = np.concatenate(left)
    return start, end


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def _primitive(w: np.ndarray, start: np.ndarray, q: np.ndarray) -> np.ndarray:
    """False where a divisor of q is a period as well."""
    out = np.ones(len(q), bool)
    for value in np.unique(q):
        rows, rest, r = np.flatnonzero(q == value), int(value), 2
        while rest > 1:
            if rest % r == 0:
                d = int(value) // r
                for i in rows:
                    out[i] &= not np.array_equal(w[start[i] : start[i] + value], w[start[i] + d : start[i] + d + value])
                while rest % r == 0:
                    rest //= r
            r = r + 1 if r * r <= rest else max(rest, r + 1)
    return out


def _regions(most: int, width: int, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``width`` words or more with a period of at most ``most``."""
    kept = [(q <= most) & (e - s >= width) for s, e, q in found]
    return tuple(np.concatenate([x[k][keep] for x, keep in zip(found, kept, strict=True)]) for k in (0, 1))


def runs(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``w``, ordered by start, then period; no text has more than ``longest`` words."""
    found, wide = [], []
    for q in range(1, min(SMALL, longest // LEAST_PERIODS + 1)):
        s, e = _stretches(w[:-q] == w[q:])
        e = e + q
        keep = e - s >= SMALL
        wide.append((s[keep], e[keep], np.full(keep.sum(), q)))
        keep = e - s >= max(LEAST_WORDS, LEAST_PERIODS * q)
        found.append((s[keep], e[keep], np.full(keep.sum(), q)))
    t, prints = SMALL, w
    for k in range(SMALL.bit_length() - 1):
        half = 1 << k
        prints = mix(prints[:-half] * np.uint64(0x9E3779B97F4A7C15) + prints[half:], 60 + k) if len(prints) > half else prints[:0]
    while LEAST_PERIODS * t <= longest and len(w) >= 2 * t:
        level = t.bit_length()
        hashes = mix(prints, 90)
        # what is found of these periods does not depend on words outside the window
        start, end = _regions(t // 4, t, wide)
        hashes[_covered(len(hashes), start, end - t + 1)] = _LAST
        least = _window_min(hashes, t + 1)
        n = len(least)
        at = np.flatnonzero(((least == hashes[:n]) | (least == hashes[t : t + n])) & (least != _LAST))
        prints = mix(prints[:-t] * np.uint64(0x9E3779B97F4A7C15) + prints[t:], 60 + level - 1)
        at = at[at < len(prints)]
        order = np.lexsort((at, prints[at]))
        i, context = at[order], prints[at[order]]
        gap = i[1:] - i[:-1]
        pairs = np.flatnonzero((context[1:] == context[:-1]) & (gap >= t) & (gap < 2 * t))
        i, q = i[pairs], gap[pairs]
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        if len(i):
            # proposals of one stretch overlap in a period or more
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] > i[:-1] + 2 * t)])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(i)]]) - 1
            s, e, q = i[head], i[tail] + q[tail] + 2 * t, q[head]
            s, e = _extended(w, s, e, q, t)
            once = np.unique(np.stack([s, e, q]), axis=1)
            s, e, q = once
            wide.append((s, e, q))  # all of them: what is too short for a run may be a region of a greater scale
            keep = e - s >= LEAST_PERIODS * q
            found.append((s[keep], e[keep], q[keep]))
        t *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    keep = _primitive(w, s, q)
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], (e - s)[order], q[order]


def _runs_of_slices(batches):
    for batch in batches:
        for i, j, body, offsets in text_slices(batch.column(1)):
            start, end = spans(~WHITESPACE[body], offsets)
            first = np.searchsorted(start, offsets)
            counts = np.diff(first)
            text = np.repeat(np.arange(j - i), counts)
            n = len(start)
            # words of text k stand at their number + k; a value that occurs once follows each text
            w = mix(np.arange(n + j - i, dtype=np.uint64), 7)
            w[np.arange(n) + text] = span_hashes(BYTE_VALUES[body], start, end)
            s, length, q = runs(w, int(counts.max(initial=0)))
            owner = np.searchsorted(first[1:] + np.arange(j - i), s, side="right")
            dropped = _covered(len(w), s + q, s + length)
            kept = ~dropped[np.arange(n) + text]
            cuts = np.searchsorted(owner, np.arange(j - i + 1))
            fields = [pa.array(x, pa.int64()) for x in (s - owner - first[:-1][owner], length, q)]
            found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), found, _joined_words(body, start[kept], end[kept], text[kept], j - i)], ["doc_id", "n_words", "runs", "collapsed"])


def _joined_words(body: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """Words of each of n texts joined by one space."""
    size = end - start + 1  # with the space before; a text's first has none
    heads = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    size[heads] -= 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    length = end - start
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at + ~heads, length) + inner] = body[np.repeat(start, length) + inner]
    sums = np.zeros(n + 1, np.int64)
    np.add.at(sums, text + 1, size)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.cumsum(sums).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every text.

    ``runs`` is ordered by start, then period; ``collapsed`` is the text without the words
    that a run holds after its first period, joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs_of_slices, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where one text in ten repeats a stretch of its words up to its end.

    With h = crc32(doc_id), g = h // 10: if h % 10 = 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)})
    n = F.size("words")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1))
    return rows.select("doc_id", F.when(F.col("words").isNotNull() & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _best(found: Column) -> Column:
    """The run of greatest length / period, the first of equals."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda x, y: F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x))


def run_digests(docs: DataFrame) -> DataFrame:
    """Count, strongest run and digests of the runs and the collapsed text of every document."""
    rows = periodic_runs(with_repeated_tails(docs)).withColumn("best", _best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
