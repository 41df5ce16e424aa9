"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-grams (one and two words left
out), present or absent in the whole text. Training runs FTRL-proximal with
per-coordinate rates and L1 on TRAIN_ROWS labelled rows at most, chosen and ordered by
a hash of the id; their features are computed by all executors. L1 leaves few weights
that are not zero, and at most 2**BITS + 1 exist, so they are broadcast to score.

Cases: a null or word-free text scores by the bias alone; labels that are null are
not learned from; a doc_id with several labels counts as toxic if any says so;
without a usable label every score is 0; repeated rows score alike, each for itself;
columns beyond doc_id, text, toxic are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm.shared import held_fold, materialize
from orbitile.llm.textbytes import LOWER, Words, mix, sums_between, text_slices

BITS = 20
#: At most about this many labelled rows are learned from, chosen by a hash of the id.
TRAIN_ROWS = 16_000
#: Features in fewer of those rows are not learned.
MIN_ROWS = 3
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.3

#: Bytes of words: letters, and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, sorted, and the first of each text."""
    words = Words(body, offsets, LETTERS, LOWER)
    h, text = words.hashes, words.text
    keys = [(text, h)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            at = np.flatnonzero(text[:-gap] == text[gap:])
            keys.append((text[at], mix(h[at] + h[at + gap] * np.uint64(0x9E3779B97F4A7C15), 60 + gap)))
    key = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | (x >> np.uint64(64 - BITS)) for t, x in keys])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), first


def _sample_features(batches):
    for batch in batches:
        for i, j, body, offsets in text_slices(batch.column("text")):
            ids, first = features(body, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("toxic").slice(i, j - i), lists], ["doc_id", "toxic", "features"]
            )


class Ftrl:
    """FTRL-proximal on rows of present features; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1) if isinstance(at, np.ndarray) else L1
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, ids: np.ndarray, y: float) -> None:
        at = np.append(ids, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / ALPHA * w
        self.n[at] = after


def _train(batches):
    """FTRL over the bounded sample, a few epochs in hash order."""
    parts, sizes, y = [], [], []
    seen = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        lists = batch.column("features")
        parts.append(lists.flatten().to_numpy(zero_copy_only=False))
        sizes.append(np.diff(lists.offsets.to_numpy()))
        y.extend(batch.column("toxic").to_pylist())
        seen += np.bincount(parts[-1], minlength=1 << BITS).astype(np.int32)
    if not y:
        return
    often, rows = seen >= MIN_ROWS, []
    for i, size in enumerate(sizes):
        ends = np.concatenate([[0], np.cumsum(size)])
        rows += [part[often[part]] for part in (parts[i][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
        parts[i] = None  # only the kept features stay
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for ids, label in zip(rows, y, strict=True):
            model.learn(ids, float(label))
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["feature", "weight"])


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """At most ``train_rows`` labelled documents in hash order: doc_id, toxic, text."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(marks), "doc_id")  # train_rows bounds the small side


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights that are not zero; feature 2**BITS is the bias."""
    rows = training_rows(docs, labels, train_rows).mapInArrow(_sample_features, "doc_id long, toxic int, features array<int>")
    rows = materialize(rows.select("toxic", "features", F.xxhash64("doc_id", F.lit(7)).alias("order"), "doc_id"), "toxic-features")
    # train_rows bounds what meets in this one task, whatever the corpus holds
    ordered = rows.repartition(1).sortWithinPartitions("order", "doc_id").select("toxic", "features")
    found = ordered.mapInArrow(_train, "feature long, weight double").toPandas()  # at most 2**BITS + 1 rows
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def margins(dense: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-odds of each text of a slice."""
    ids, first = features(body, offsets)
    return sums_between(dense[ids].astype(np.float64), first) + float(dense[-1])  # each text by itself


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (doc_id, text) with score and predicted."""
    at, values = weights
    known = len(at) > 0
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), values.astype(np.float32)))

    def run(batches):
        at, values = shared.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[at] = values
        for batch in batches:
            for i, j, body, offsets in text_slices(batch.column("text")):
                margin = margins(dense, body, offsets)
                p = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) if known else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); ids of fold 2 of 4 are never learned from."""
    seen = labels.filter(held_fold(F.col("doc_id"), 4) != 2)
    scored = score(docs, train(docs, seen, train_rows))
    return scored.select("doc_id", (held_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    at, values = train(docs, labels.filter(held_fold(F.col("doc_id"), 4) != 2), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), values.astype(np.float32)))
    place = docs.columns.index("text")

    def run(batches):
        at, values = shared.value
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[at] = values
        for batch in batches:
            for i, j, body, offsets in text_slices(batch.column(place)):
                keep = margins(dense, body, offsets) < np.log(THRESHOLD / (1 - THRESHOLD)) if len(at) else np.ones(j - i, bool)
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
