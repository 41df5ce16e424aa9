"""Language identification by multinomial naive Bayes over hashed n-grams.

Texts are read as code points: letters are lower-cased, everything else becomes one
space, and 1- to 3-grams are hashed into 2**BITS columns. Training counts columns per
language over a bounded number of rows (about ROWS_PER_LANG each, chosen by a hash of
the id); class priors are the shares of all rows that may be learned from. Counts become
log-probabilities in the executors, a vector a language. LANG_BLOCK languages at a time
are broadcast as a matrix of bounded size, and each batch is scored sparsely in numpy;
more languages are further passes over the texts, which carry the best language so far,
so that any number of languages is learned and one matrix is held at a time.

The prediction is the language of the greatest log-likelihood of the whole text plus log
prior. The score is its posterior at a length of EVIDENCE n-grams at most.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text
when no language was learned; rows with null lang are not learned from; ties go to
the alphabetically first language; repeated rows are predicted alike; columns beyond
doc_id, text, lang are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm.shared import held_fold, materialize
from orbitile.llm.textbytes import text_slices

BITS = 16
SMOOTHING = 0.1
#: About how many rows of a language are learned from, at most.
ROWS_PER_LANG = 1500
#: Languages of a block: the matrix holds 2**BITS floats for each.
LANG_BLOCK = 128
#: Length at which the mean log-probabilities of longer texts are read for the score.
EVIDENCE = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of letters below 2**17 code points, 32 for all else; and is-letter above."""
    size = 0x110000
    lower = np.full(size, 32, np.uint32)
    for c in range(size):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, lower != 32


def gram_columns(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of all n-grams with the text of each, and letters in each text."""
    lower, _ = _tables()
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offsets]
    c = lower[points]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    letter = c != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    keep[np.minimum(at[:-1], len(c) - 1)] |= len(c) > 0
    letters = np.bincount(text[letter], minlength=len(offsets) - 1)
    c, text = c[keep].astype(np.uint32), text[keep]
    out, owner = [], []
    h = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        same = text[: len(h)] == text[n - 1 :]
        v = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        out.append((v >> np.uint32(32 - BITS))[same])
        owner.append(text[: len(h)][same])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), letters
    return np.concatenate(out), np.concatenate(owner), letters


def _counts(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, body, offsets in text_slices(batch.column("text")):
            if len(body) == 0:
                continue
            columns, owner, _ = gram_columns(body, offsets)
            names, index = np.unique(langs[i:j].astype(str), return_inverse=True)
            n = np.bincount(index[owner] * (1 << BITS) + columns, minlength=len(names) << BITS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at >> BITS].tolist(), pa.string()), pa.array((at & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n[at])], ["lang", "feature", "n"]
            )


#: Languages in order, their log-probabilities (2**BITS, languages), and log priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def learnable(docs: DataFrame) -> DataFrame:
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    return known.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def language_sizes(docs: DataFrame) -> dict[str, int]:
    """Rows that may be learned from, by language: one entry a language."""
    return {r["lang"]: r["n"] for r in learnable(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()}


def _log_probabilities(rows: pd.DataFrame) -> pd.DataFrame:
    """A language's smoothed log-probabilities as one vector, from its 2**BITS counts at most."""
    n = np.full(1 << BITS, SMOOTHING)
    n[rows["feature"].to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "logs": [np.log(n / n.sum()).astype("<f4").tobytes()]})


def train(docs: DataFrame, sizes: dict[str, int], names: list[str], rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """The model of some of the languages of ``sizes``."""
    priors = np.log(np.array([sizes[k] for k in names], np.float64) / sum(sizes.values()))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / sizes[k])))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = learnable(docs).filter(F.col("lang").isin(names))
    sample = known.filter(unit < share[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    vectors = {r["lang"]: np.frombuffer(r["logs"], "<f4") for r in counts.groupBy("lang").applyInPandas(_log_probabilities, "lang string, logs binary").collect()}
    flat = np.full(1 << BITS, -BITS * np.log(2.0), np.float32)  # a language without a letter in its rows
    return names, np.stack([vectors.get(k, flat) for k in names], axis=1), priors


_CARRIED = "doc_id long, text string, lang_pred string, best double, tempered double, total double"


def _pass(shared):
    """Adds a block of languages to what the blocks before have found for each text.

    ``best`` is the greatest log-likelihood plus log prior, ``tempered`` the same language's
    value at EVIDENCE n-grams, ``total`` the logarithm of the sum of all languages' values there.
    """

    def run(batches):
        names, matrix, priors = shared.value
        label = pa.array(names, pa.string())
        for batch in batches:
            before = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("best", "tempered", "total")]
            for i, j, body, offsets in text_slices(batch.column("text")):
                best, tempered, total = (x[i:j] for x in before)
                pred = batch.column("lang_pred").slice(i, j - i)
                if len(body):
                    columns, owner, letters = gram_columns(body, offsets)
                    size = np.maximum(np.bincount(owner, minlength=j - i), 1)
                    whole = np.stack([np.bincount(owner, matrix[columns, k], j - i) for k in range(len(names))], axis=1)
                    short = whole * (np.minimum(size, EVIDENCE) / size)[:, None] + priors
                    whole += priors
                    first, at = whole.argmax(axis=1), np.arange(j - i)
                    # of equal languages the alphabetically first stays: blocks come in order
                    better = (letters > 0) & (whole[at, first] > best)
                    pred = pc.if_else(pa.array(better), label.take(pa.array(first)), pred)
                    best, tempered = np.where(better, whole[at, first], best), np.where(better, short[at, first], tempered)
                    total = np.where(letters > 0, np.logaddexp(total, np.logaddexp.reduce(short, axis=1)), total)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i), pred, *map(pa.array, (best, tempered, total))], ["doc_id", "text", "lang_pred", "best", "tempered", "total"])

    return run


def predict(docs: DataFrame, models) -> DataFrame:
    """(doc_id, lang_pred, score) by the models of all blocks of languages, in alphabetical order."""
    low = F.lit(float("-inf"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"), low.alias("best"), F.lit(0.0).alias("tempered"), low.alias("total"))
    for n, model in enumerate(models):
        if n:
            rows = materialize(rows, "languages")  # one matrix at a time
        rows = rows.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(model)), _CARRIED)
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.least(F.exp(F.col("tempered") - F.col("total")), F.lit(1.0)))
    return rows.select("doc_id", "lang_pred", score.alias("score"))


def models(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, block: int = LANG_BLOCK):
    """Models of blocks of languages in alphabetical order, one after the other."""
    sizes = language_sizes(docs)
    names = sorted(sizes)
    for i in range(0, len(names), block):
        yield train(docs, sizes, names[i : i + block], rows_per_lang)


def language_id(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, block: int = LANG_BLOCK) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); ids of fold 1 of 3 are never learned from."""
    found = predict(docs, models(docs.filter(held_fold(F.col("doc_id"), 3) != 1), rows_per_lang, block))
    return found.select("doc_id", (held_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
