"""MinHash near-duplicate detection with b-bit signatures.

1. One Arrow pass turns each text into its set of distinct word shingles and keeps
   the set's size, a 128-bit digest of the set, MinHash band keys, and the low bits
   of the minima packed into longs. Documents with equal sets form one class.
2. Class representatives meet in band buckets. Bit counts on the packed signatures
   give an estimate of the similarity, corrected for chance collisions of the kept
   bits; pairs far below the threshold (five standard errors) are let go.
3. The others are confirmed on the full shingle sets, and connected components
   follow. What a bucket's pivot leaves in different components is compared inside
   tasks, block against block of the bucket, on signatures and then on full sets;
   only links come out of these tasks, not pairs.

Bands are many and short (32 of 4 minima): a pair at the threshold of 0.75 shares
no band with probability (1 - 0.75**4)**32, about 5e-6, and less above it.

Cases: a null or word-free text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; equal texts are one class; a row that
repeats both doc_id and text comes out as often as it went in (doc_id must name one
text); a row with a null doc_id links with nothing, has a null component_id and is kept;
columns other than doc_id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.linking import dealt_blocks, link_buckets
from orbitile.llm.shared import materialize, packed
from orbitile.llm.textbytes import mix, shingle_sets, sums_between, text_slices

WIDTH, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 4
#: Standard errors below the threshold at which an estimate lets a pair go.
ERRORS = 5
#: Shingles of a bucket that one task holds; larger buckets are cut into blocks.
BLOCK_SHINGLES = 300_000
_HASHES = BANDS * ROWS
_A = (mix(np.arange(1, _HASHES + 1, dtype=np.uint64), 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, _HASHES + 1, dtype=np.uint64), 22) >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, hashes) minima of the shingles of each text under each hash."""
    x = (shingles ^ (shingles >> np.uint64(20))).astype(np.uint32)
    out = np.zeros((len(first) - 1, _HASHES), np.uint32)
    for k in range(_HASHES):
        v = x * _A[k]
        v += _B[k]
        v ^= v >> np.uint32(15)
        out[:, k] = sums_between(v, first, np.minimum)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(low), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + low[:, r::ROWS].astype(np.uint64), 31 + r)
    return mix(keys + np.arange(BANDS, dtype=np.uint64), 41)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum, 64 // BITS of them in a long."""
    kept = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, 64 // BITS)
    return (kept << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel().view(np.int64)))


def _signatures(batches):
    for batch in batches:
        ids = batch.column(0)
        for i, j, body, offsets in text_slices(batch.column(1)):
            shingles, first = shingle_sets(body, offsets, WIDTH)
            low = minima(shingles, first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i),
                    pa.array(np.diff(first)),
                    pa.array(sums_between(mix(shingles, 51), first).view(np.int64)),
                    pa.array(sums_between(mix(shingles, 52), first).view(np.int64)),
                    _lists(band_keys(low)),
                    _lists(packed_bits(low)),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig array<long>")


def estimated_similarity(a: Column, b: Column) -> Column:
    """Collision-corrected Jaccard estimate from two packed signatures.

    A position of b bits agrees by chance with probability 2**-b, so agreement
    (P) estimates similarity as (P - 2**-b) / (1 - 2**-b).
    """
    ones = int.from_bytes(bytes([0x11] * 8), "big")

    def differing(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        for shift in (2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, d: s + d)
    chance = 2.0**-BITS
    return ((F.lit(1.0) - apart / F.lit(float(_HASHES))) - F.lit(chance)) / F.lit(1 - chance)


def screen(a: Column, b: Column) -> Column:
    p = PERCENT / 100
    agree = p + (1 - p) * 2.0**-BITS
    error = (agree * (1 - agree) / _HASHES) ** 0.5 / (1 - 2.0**-BITS)
    return estimated_similarity(a, b) >= F.lit(p - ERRORS * error)


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Positions at which one packed signature agrees with each row of others."""
    d = one[None, :] ^ two
    for shift in (2, 1):
        d = d | (d >> np.uint64(shift))
    return _HASHES - np.bitwise_count(d & np.uint64(int("1" * 16, 16))).sum(axis=1, dtype=np.int64)


def _least_agreeing() -> float:
    p = PERCENT / 100
    agree = p + (1 - p) * 2.0**-BITS
    return _HASHES * (agree - ERRORS * (agree * (1 - agree) / _HASHES) ** 0.5)


def _block_links(key, rows):
    """Links between different labels of one block, or of two blocks, of a bucket."""
    import pandas as pd

    _, low, high = key
    ids, label, block = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    sigs = np.stack([np.asarray(s, np.int64) for s in rows["sig"]]).view(np.uint64)
    keys = [np.asarray(k, np.int64) for k in rows["keys"]]
    width = max(map(len, keys))
    table = np.zeros((len(keys), width), np.int64)
    for i, k in enumerate(keys):
        table[i, : len(k)] = np.sort(k)
        table[i, len(k) :] = -i - 1  # fits no other row
    sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
    size = np.array([len(s) for s in sets])
    names, count = np.unique(label, return_counts=True)
    main = names[count.argmax()]
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    least, out = _least_agreeing(), []
    bucket = key[0]
    for i in np.flatnonzero(label != main):
        # each pair once: the label that is not the main one, or the smaller id, asks
        ask = (label != label[i]) & ((label == main) | (ids > ids[i]))
        if low != high:
            ask &= block != block[i]
        at = np.flatnonzero(ask)
        at = at[(100 * np.minimum(size[at], size[i]) >= PERCENT * np.maximum(size[at], size[i])) & (_agreeing(sigs[i], sigs[at]) >= least)]
        if len(at) == 0:
            continue
        # a pair that shares several buckets is compared in the first of them only
        shared = np.isin(table[at], keys[i])
        at = at[np.where(shared, table[at], np.iinfo(np.int64).max).min(axis=1) == bucket]
        if len(at) == 0:
            continue
        start, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        both = np.bincount(np.concatenate([owner[a:b] for a, b in zip(start, end, strict=True)]), minlength=len(sets))[at]
        good = at[(both > 0) & (100 * both >= PERCENT * (size[at] + size[i] - both))]
        out += [(min(ids[i], x), max(ids[i], x)) for x in ids[good]]
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")


def _shingle_rows(batches):
    for batch in batches:
        for i, j, body, offsets in text_slices(batch.column(1)):
            shingles, first = shingle_sets(body, offsets, WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "shingles"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document of ``docs``."""
    sets = materialize(signatures(docs), "sets")
    classes = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    classes = materialize(classes, "classes")
    reps = classes.select(F.col("id").alias("doc_id"), "set_a", "set_b").join(sets, ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("id"), "bands", "sig"), "representatives")
    keys = reps.select("id", F.explode("bands").alias("key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    held: list[DataFrame] = []

    def prepare(ids: DataFrame):
        """The shingle sets of the documents that share a key, once for each."""
        wanted = ids.withColumnRenamed("id", "doc_id")
        need = texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        held.append(materialize(need.mapInArrow(_shingle_rows, "id long, shingles array<long>"), "shingle-sets"))

        def verify(pairs: DataFrame) -> DataFrame:
            full = pairs.join(held[0].select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
            full = full.join(held[0].select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b")
            both = F.size(F.array_intersect("one", "two"))
            union = F.size("one") + F.size("two") - both
            return full.filter((both > 0) & (both * 100 >= union * PERCENT)).select("a", "b")

        return verify

    def remaining(left: DataFrame) -> DataFrame:
        own = materialize(left.groupBy("id").agg(F.collect_list("key").alias("keys")), "left-keys")  # at most BANDS keys
        full = held[0].join(own, "id")
        sized = left.join(full.select("id", F.size("shingles").alias("n")), "id")
        dealt = dealt_blocks(sized, F.col("n"), BLOCK_SHINGLES)
        whole = dealt.select("key", "low", "high", "block", "id", "label", "sig").join(full, "id")
        return whole.groupBy("key", "low", "high").applyInPandas(_block_links, "a long, b long").distinct()

    linked = link_buckets(keys, reps.select("id", "sig"), screen, prepare, None, remaining)
    named = classes.join(linked, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    named = materialize(named, "named")
    out = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").isNull() | (component == F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not kept; rows with a null doc_id stay."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = packed(docs)
    return rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]), "left_semi").select("row.*")
