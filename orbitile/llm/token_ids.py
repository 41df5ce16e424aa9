"""Token ids in length-delimited binary records with a separate offset index.

A record is framed as: payload length (u64), masked checksum of those eight bytes
(u32), payload, masked checksum of the payload (u32), all little-endian. The payload
is doc_id (i64), bytes per id (u32, 2 or 4, with a flag for a null doc_id), number of
ids (u32), then the ids. A mask
rotates a CRC-32 by 15 bits and adds a constant, so a checksum stored inside checked
data is not mistaken for one.

Documents are dealt by ranges of doc_id, each range is one shard file, written under
a passing name and renamed, so a task that runs again leaves the same file. The index
(a Parquet table: shard, offset, length, doc_id, ids before it in the shard, ids) lets
readers fetch records in any order. Files live in the shared folder and are reached
through its URI's file system.

Encoding runs the tokenizers library on distinct pre-tokens: the split into
pre-tokens is found in numpy for a whole slice, and each worker keeps the ids it has
met, so frequent words are encoded once.

Cases: a null text is empty and holds only the end id; rows are ordered by doc_id, null
ids first, then text, so repeated rows each get a record; very long texts are one record each;
columns beyond doc_id and text are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitile.llm.pretokens import Memo, Pretokens, distinct
from orbitile.llm.shared import fresh_path
from orbitile.llm.textbytes import text_slices

END_ID = 2
#: Added to rotated checksums (a fixed value of the record format).
MASK_DELTA = 0xA282EAD8
#: Set beside the bytes per id where a document has no id.
NO_ID = 0x80
#: Bytes of text that a shard holds, about; a corpus of more has more shards, not larger ones.
SHARD_BYTES = 256 << 20
INDEX_SCHEMA = "shard string, offset long, length long, doc_id long, before long, n_tokens long"
WORDS_A_CALL = 400


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError if a checksum differs."""
    (size,) = struct.unpack_from("<Q", record)
    if masked(record[:8]) != struct.unpack_from("<I", record, 8)[0] or len(record) != size + 16:
        raise ValueError("damaged record length")
    payload = record[12 : 12 + size]
    if masked(payload) != struct.unpack_from("<I", record, 12 + size)[0]:
        raise ValueError("damaged record")
    return payload


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or ids.max() < 65536 else 4
    flag = 0 if doc_id is not None else NO_ID
    return struct.pack("<qII", doc_id or 0, width | flag, len(ids)) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width, n = struct.unpack_from("<qII", payload)
    if width & NO_ID:
        doc_id, width = None, width & ~NO_ID
    return doc_id, np.frombuffer(payload, f"<u{width}", n, 16)


def byte_alphabet() -> dict[int, str]:
    """Byte value to the character that stands for it in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take, in
    order, the code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


@lru_cache(2)
def _encoder(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = pre_tokenizers.Split(" ", "removed")  # pre-tokens come split and mapped
    alphabet = byte_alphabet()
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for piece, i in tokenizer.get_vocab().items():
        size[i] = len(piece)
    return tokenizer, alphabet, size, Memo()


def _learn(words: list[str], keys: np.ndarray, path: str) -> None:
    tokenizer, alphabet, token_size, memo = _encoder(path)
    sizes, flat = [], []
    for i in range(0, len(words), WORDS_A_CALL):
        mapped = [w.encode().decode("latin-1").translate(alphabet) for w in words[i : i + WORDS_A_CALL]]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.searchsorted(np.cumsum(token_size[ids]), np.cumsum([len(m) for m in mapped])) + 1
        sizes.append(np.diff(ends, prepend=0))
        flat.append(ids)
    memo.add(keys, np.concatenate(sizes), np.concatenate(flat))


def encode_slice(body: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice end to end, and the first of each text."""
    pre = Pretokens(body, offsets)
    keys, place, inverse = distinct(pre.hashes)
    memo = _encoder(path)[3]
    absent = memo.missing(keys)
    if len(absent):
        _learn(pre.strings(place[absent]), keys[absent], path)
    ids, size = memo.expand(keys, inverse)
    n = np.bincount(pre.text, size, pre.texts).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(n)])


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, shards: int, end_id: int | None = END_ID) -> DataFrame:
    """Encode ``docs`` into shard files below ``folder``; returns the index table."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}.records"
        files.create_dir(base, recursive=True)
        passing = f"{base}/.{name}-{uuid.uuid4().hex}"
        offset = before = 0
        any_rows = False
        with files.open_output_stream(passing) as out:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for i, j, body, offsets in text_slices(batch.column(1)):
                    ids, first = encode_slice(body, offsets, tokenizer_path)
                    rows, block = [], []
                    for k in range(j - i):
                        own = ids[first[k] : first[k + 1]]
                        own = np.append(own, end_id) if end_id is not None else own
                        record = frame(serialize(doc_ids[i + k], own))
                        rows.append((name, offset, len(record), doc_ids[i + k], before, len(own)))
                        block.append(record)
                        offset += len(record)
                        before += len(own)
                    out.write(b"".join(block))
                    any_rows = True
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if any_rows:
            files.move(passing, f"{base}/{name}")
        else:
            files.delete_file(passing)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    index = f"{folder}/index"
    ordered.mapInArrow(run, INDEX_SCHEMA).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(index)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(shard, doc_id, before, n_tokens, ids_crc32) from the records themselves."""

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["shard"], files.open_input_file(f"{base}/{row['shard']}")
                if file.tell() != row["offset"]:
                    file.seek(row["offset"])
                doc_id, ids = deserialize(unframe(file.read(row["length"])))
                out.append((name, doc_id, row["before"], len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], ["shard", "doc_id", "before", "n_tokens", "ids_crc32"])
        if file is not None:
            file.close()

    return index.mapInArrow(run, "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer_path: str, shards: int | None = None) -> DataFrame:
    """Write all documents as records, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    if shards is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]  # one number
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    index = write_records(docs, tokenizer_path, folder, shards)
    # one row a shard, named in the order of their ranges: the window's single task holds as many rows as there are files
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    back = read_records(index, folder).join(F.broadcast(bases), "shard")
    return back.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
