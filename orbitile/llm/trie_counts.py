"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Scores are log-probabilities of a vocabulary's pieces, fitted by expectation maximisation
on all pre-tokens of all texts: their distinct ones are counted once, and each round sums
what blocks of them expect of each piece. A pre-token's count is the
number of pieces on its best-scoring segmentation into bytes of pieces (equal scores:
fewest pieces). The distinct pre-tokens of a slice are inserted in a trie level by
level: all pre-tokens with equal first d bytes are one node, and the forward scores of
a node are computed once, from those of its ancestors, for all nodes of a level
together. Terminal nodes store the counts. A worker remembers pre-tokens it has met. The
fit runs over such a trie as well: forward sums of a node are computed once, and what its
words pass through it flows back to its ancestors.

Cases: without a text to fit on, scores follow a Zipf law over the ranks, from which
the fit starts as well; a null or empty text has no tokens; pre-tokens beyond LONG bytes are fitted on
and segmented one by one, by the same recurrences; equal texts get equal rows, repeated rows
included; columns beyond doc_id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm.pretokens import Memo, Pretokens, distinct
from orbitile.llm.shared import materialize
from orbitile.llm.textbytes import BYTE_VALUES, mix, powers, span_hashes, text_slices

LONG = 96
#: How often the scores are fitted, and about how many bytes of pre-tokens share a trie then.
ROUNDS, BLOCK_BYTES = 4, 1 << 19
#: Scores are multiples of 1 / GRID, so that sums of them are exact in any order.
GRID = 1 << 24
#: Added to the expected count of each piece, so that none is impossible.
SMOOTHING = 0.01


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file, in order of rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sorted(ranks, key=ranks.__getitem__)


def zipf(n: int) -> np.ndarray:
    """Log-probabilities of n ranks under a Zipf law of exponent 1."""
    p = 1.0 / np.arange(1, n + 1)
    return np.log(p / p.sum())


class Pieces:
    """Pieces of a vocabulary, found by hash."""

    def __init__(self, pieces: list[bytes]):
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        h = span_hashes(BYTE_VALUES[flat], np.concatenate([[0], ends[:-1]]), ends)
        self.ranks = np.argsort(h)
        self.keys = h[self.ranks]
        self.lengths = sorted({len(p) for p in pieces})

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks of the pieces with these hashes, -1 for none."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.ranks[i], -1)


def expected_in_one(vocabulary: Pieces, word: bytes, scores: np.ndarray) -> np.ndarray:
    """How often each piece is expected in one word of any length, over all ways to cut it."""
    values, n = BYTE_VALUES[np.frombuffer(word, np.uint8)], len(word)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    found = []
    for k in vocabulary.lengths:
        at = np.arange(k, n + 1)
        rank = vocabulary.find(mix((total[at] - total[at - k]) * down[at - k] + np.uint64(k)))
        hit = np.flatnonzero(rank >= 0)
        found.append((hit + k, hit, rank[hit]))
    into, out_of, piece = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(into, kind="stable")
    into, out_of, piece = into[order], out_of[order].tolist(), piece[order]
    gain, cuts = scores[piece].tolist(), np.searchsorted(into, np.arange(n + 2)).tolist()
    forward, share, weight = [0.0], [0.0] * len(gain), [0.0] * (n + 1)
    for d in range(1, n + 1):
        way = [forward[out_of[i]] + gain[i] for i in range(cuts[d], cuts[d + 1])]
        top = max(way, default=-math.inf)
        forward.append(top)
        if top > -math.inf:
            way = [math.exp(w - top) for w in way]
            whole = sum(way)
            forward[d] += math.log(whole)
            share[cuts[d] : cuts[d + 1]] = [w / whole for w in way]
    weight[n] = float(forward[n] > -math.inf)
    for d in range(n, 0, -1):
        if weight[d]:
            for i in range(cuts[d], cuts[d + 1]):
                share[i] *= weight[d]
                weight[out_of[i]] += share[i]
        else:
            share[cuts[d] : cuts[d + 1]] = [0.0] * (cuts[d + 1] - cuts[d])
    return np.bincount(piece, share, len(scores))


def expected_counts(vocabulary: Pieces, words: list[bytes], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How often each piece is expected in distinct, non-empty words, over all ways to cut them.

    Words of up to LONG bytes with equal first d bytes share a node of level d. Edges are the
    pieces that lead to a node from its ancestors; forward sums run down the levels, the words'
    counts flow back up. Longer words are taken one by one.
    """
    out, short = np.zeros(len(scores)), [len(w) <= LONG for w in words]
    if not all(short):
        for w, n in zip(words, counts, strict=True):
            if len(w) > LONG:
                out += n * expected_in_one(vocabulary, w, scores)
        words, counts = [w for w, s in zip(words, short, strict=True) if s], counts[np.array(short)]
    if not words:
        return out
    body, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    order = np.argsort(-size, kind="stable")  # words that reach level d are a prefix
    start, size, counts = (np.cumsum(size) - size)[order], size[order], counts[order]
    values, depth = BYTE_VALUES[body], int(size[0])
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    alive = np.searchsorted(-size, -np.arange(depth + 1), side="right")
    base = np.concatenate([[0], np.cumsum(alive)])
    node = np.zeros(base[-1], np.int64)  # of each word, level by level
    bounds, shown = [0, 1], []
    for d in range(1, depth + 1):
        s = start[: alive[d]]
        _, first, inverse = np.unique((total[s + d] - total[s]) * down[s], return_index=True, return_inverse=True)
        node[base[d] : base[d + 1]] = bounds[-1] + inverse
        bounds.append(bounds[-1] + len(first))
        shown.append(first)
    word = np.concatenate(shown)  # one word of each node but the root
    level = np.repeat(np.arange(1, depth + 1), np.diff(bounds[1:]))
    found = []
    for k in vocabulary.lengths:
        if k > depth:
            break
        i = bounds[k] - 1
        at = start[word[i:]] + level[i:]
        rank = vocabulary.find(mix((total[at] - total[at - k]) * down[at - k] + np.uint64(k)))
        hit = np.flatnonzero(rank >= 0)
        found.append((hit + i + 1, node[base[level[hit + i] - k] + word[hit + i]], rank[hit]))
    if not found:
        return out
    into, out_of, piece = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(into, kind="stable")
    into, out_of, piece = into[order], out_of[order], piece[order]
    gain, cuts = scores[piece], np.searchsorted(into, bounds)
    forward, share = np.full(bounds[-1], -np.inf), np.zeros(len(into))
    forward[0] = 0.0
    levels = [slice(cuts[d], cuts[d + 1]) for d in range(1, depth + 1) if cuts[d] < cuts[d + 1]]
    for at in levels:
        way, heads = forward[out_of[at]] + gain[at], np.flatnonzero(np.diff(into[at], prepend=-1))
        top = np.maximum.reduceat(way, heads)
        top[top == -np.inf] = 0.0
        each = np.diff(heads, append=len(way))
        way = np.exp(way - np.repeat(top, each))
        whole = np.add.reduceat(way, heads)
        share[at] = way / np.repeat(np.where(whole > 0, whole, 1.0), each)
        forward[into[at][heads]] = top + np.log(whole, out=np.full(len(whole), -np.inf), where=whole > 0)
    ends = node[base[size] + np.arange(len(size))]
    weight = np.bincount(ends, np.where(forward[ends] > -np.inf, counts, 0.0), bounds[-1])
    for at in reversed(levels):
        share[at] *= weight[into[at]]
        np.add.at(weight, out_of[at], share[at])
    return out + np.bincount(piece, share, len(scores))


def rescored(expected: np.ndarray) -> np.ndarray:
    """Log-probabilities of pieces by their expected counts."""
    smooth = expected + SMOOTHING
    return np.round(np.log(smooth / smooth.sum()) * GRID) / GRID


def fit(pieces: list[bytes], words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces after some rounds of expectation maximisation on one block of words."""
    scores, vocabulary = zipf(len(pieces)), Pieces(pieces)
    for _ in range(rounds if words else 0):
        scores = rescored(expected_counts(vocabulary, words, counts, scores))
    return scores


def _words(batches):
    for batch in batches:
        for _, _, body, offsets in text_slices(batch.column(0)):
            pre = Pretokens(body, offsets)
            keys, place, inverse = distinct(pre.hashes)
            found = [w.encode() for w in pre.strings(place)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.bincount(inverse, minlength=len(keys)))], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct pre-tokens of all texts and how often they occur."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    return materialize(texts.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


@lru_cache(1)
def _vocabulary(path: str) -> Pieces:
    return Pieces(read_pieces(path))


def fitted_scores(docs: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Scores of the pieces of ``path``, in order of rank, fitted on all pre-tokens of ``docs``."""
    counted, scores = word_counts(docs), zipf(len(read_pieces(path)))
    if counted.isEmpty():
        return scores
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(scores)  # a float for each piece

        def run(batches, shared=shared):
            scores = shared.value
            expected, words, counts, held = np.zeros(len(scores)), [], [], 0
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words.append(word)
                    counts.append(n)
                    held += len(word)
                    if held >= BLOCK_BYTES:
                        expected += expected_counts(_vocabulary(path), words, np.array(counts, np.float64), scores)
                        words, counts, held = [], [], 0
            if words:
                expected += expected_counts(_vocabulary(path), words, np.array(counts, np.float64), scores)
            some = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(expected[some])], ["piece", "n"])

        summed = counted.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece at most
        expected = np.zeros(len(scores))
        expected[summed["piece"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float64)
        scores = rescored(expected)
    return scores


class Unigram:
    """Pieces with their scores, looked up by hash."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        pieces = read_pieces(path)
        scores = zipf(len(pieces)) if scores is None else scores
        self.score = dict(zip(pieces, scores.tolist(), strict=True))
        self.longest = max(map(len, pieces))
        self.pieces, self.values = Pieces(pieces), np.append(scores, -np.inf)
        self.memo = Memo()

    def lookup(self, h: np.ndarray) -> np.ndarray:
        return self.values[self.pieces.find(h)]  # -1: the last, no score

    def count_one(self, word: bytes) -> int:
        """The same recurrence for a single pre-token."""
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            top = (-np.inf, 0)
            for k in range(1, min(d, self.longest) + 1):
                s = self.score.get(word[d - k : d])
                if s is not None:
                    before = best[d - k]
                    now = (before[0] + s, before[1] + 1)
                    if now[0] > top[0] or (now[0] == top[0] and now[1] < top[1]):
                        top = now
            best.append(top)
        return best[-1][1]

    def count_all(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Counts of the distinct pre-tokens body[start:end], through their trie."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.count_one(body[start[i] : end[i]].tobytes())
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]  # words that reach level d are a prefix
        start, size = start[order], size[order]
        if len(order) == 0:
            return out
        values = BYTE_VALUES[body]
        up, down = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        depth = int(size[0])
        node = np.zeros((depth + 1, len(order)), np.int32)
        score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        alive = np.searchsorted(-size, -np.arange(depth + 1), side="right")
        for d in range(1, depth + 1):
            m = alive[d]
            s = start[:m]
            prefix = (total[s + d] - total[s]) * down[s]
            _, first, inverse = np.unique(prefix, return_index=True, return_inverse=True)
            node[d, :m] = inverse
            at = start[first]
            best, pieces = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
            for k in self.pieces.lengths:
                if k > d:
                    break
                h = mix((total[at + d] - total[at + d - k]) * down[at + d - k] + np.uint64(k))
                gain = self.lookup(h)
                some = np.flatnonzero(gain > -np.inf)
                if len(some) == 0:
                    continue
                before = node[d - k, first[some]]
                now, n = score[d - k][before] + gain[some], count[d - k][before] + 1
                better = (now > best[some]) | ((now == best[some]) & (n < pieces[some]))
                best[some[better]], pieces[some[better]] = now[better], n[better]
            score.append(best)
            count.append(pieces)
            done = np.flatnonzero(size[:m] == d)
            out[order[done]] = pieces[inverse[done]]
        return out


def count_slice(body: np.ndarray, offsets: np.ndarray, model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each text of a slice."""
    pre = Pretokens(body, offsets)
    keys, place, inverse = distinct(pre.hashes)
    absent = model.memo.missing(keys)
    if len(absent):
        at = np.append(pre.char_bytes, len(body))
        which = place[absent]
        found = model.count_all(body, at[pre.start[which]], at[pre.end[which]])
        model.memo.add(keys[absent], np.ones(len(found), np.int64), found)
    counts, _ = model.memo.expand(keys, inverse)
    return np.bincount(pre.text, minlength=pre.texts), np.bincount(pre.text, counts, pre.texts).astype(np.int64)


#: The model a worker has met last, by the name of its fit.
_models: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, path: str, scores: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every text, by scores fitted on ``docs`` or given."""
    fitted = fitted_scores(docs, path) if scores is None else scores
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fitted))  # a float for each piece

    def run(batches):
        name, fitted = shared.value
        if name not in _models:
            _models.clear()
            _models[name] = Unigram(path, fitted)
        for batch in batches:
            for i, j, body, offsets in text_slices(batch.column(1)):
                pretokens, tokens = count_slice(body, offsets, _models[name])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pretokens), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
