"""Texts as lossless media columns, and features of the pixels read back.

The payload of a text is its UTF-8 bytes with bytes 0 up to a positive multiple of 64.
Each byte is a sample of the green channel, 64 to a row; payloads of more rows than an
image may have get wider rows, zeros filling the last. Images are written with a palette
of the bytes that occur, prefix codes and back-references for runs. The table of images is written to the
shared folder as Parquet and read back; features come from the decoded pixel arrays.

Cases: a null text is empty and stored as one row of zero pixels; equal texts get
equal values; repeated rows come out as often; columns beyond doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm import webp
from orbitile.llm.shared import fresh_path

BLOCK = 64


def payload(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % BLOCK if data else BLOCK)


def to_image(data: bytes) -> bytes:
    """A WebP file of a payload."""
    rows = -(-len(data) // BLOCK)
    wide = -(-rows // webp.MAX_SIDE)
    height = -(-rows // wide)
    full = np.zeros(height * wide * BLOCK, np.uint8)
    full[: len(data)] = np.frombuffer(data, np.uint8)
    return webp.encode_samples(full.reshape(height, wide * BLOCK))


def feature(samples: np.ndarray) -> str:
    """Difference hash of the image on an 8 x 9 grid, then the means of its four quarters of columns."""
    height, width = samples.shape
    gray = samples.astype(np.int64)
    rows = np.add.reduceat(gray, np.minimum(np.arange(8) * height // 8, height - 1), axis=0)
    cells = np.add.reduceat(rows, np.minimum(np.arange(9) * width // 9, width - 1), axis=1)
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    means = np.add.reduceat(gray.sum(axis=0), np.arange(4) * width // 4) // (height * (width // 4))
    return f"{bits}-{means[0]:02x}{means[1]:02x}{means[2]:02x}{means[3]:02x}"


def _images(batches):
    for batch in batches:
        n, sizes, media = [], [], []
        for value in batch.column(1):
            data = (value.as_py() or "").encode()
            whole = payload(data)
            n.append(len(data))
            sizes.append(len(whole))
            media.append(to_image(whole))
        for i in range(0, len(n), 256):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 256), pa.array(n[i : i + 256], pa.int64()), pa.array(sizes[i : i + 256], pa.int64()), pa.array(media[i : i + 256], pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "media"],
            )


def _features(batches):
    for batch in batches:
        out = []
        for doc_id, n, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            stored = media.as_py()
            samples = webp.decode(stored)[:, :, 2]
            data = samples.tobytes()[:size]
            out.append((doc_id, n, size, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def write_media(docs: DataFrame, path: str) -> DataFrame:
    """The table (doc_id, n_bytes, payload_bytes, media) of all texts, written and opened."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, media binary"
    rows.mapInArrow(_images, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def media_features(docs: DataFrame) -> DataFrame:
    """Features of every text's image, computed from the stored bytes."""
    stored = write_media(docs, fresh_path(docs.sparkSession, "media"))
    return stored.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
