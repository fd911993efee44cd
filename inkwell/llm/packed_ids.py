"""Token ids in patched frame-of-reference blocks.

A shard holds consecutive documents in ascending key order. Its ids, one after another, are cut into blocks of 128;
a block keeps its minimum, the differences' low bits packed at the width that a percentile of them needs, and the
high bits of the rest in an exception list (position, high part). An index has each block's byte position, so that
any document is read without the ones before it.

A shard's file, little-endian: magic ``PFB1``, u32 documents, u32 blocks, u64 ids; i64 keys; u32 lengths; u64 block
positions (one more than blocks); blocks: u32 minimum, u8 width, u8 exceptions, packed bits, u8 positions, u32 highs.
Spark writes one shard a row, in Parquet, as executors may share nothing but Spark's own store.

Null and empty texts have the end id only; rows without a key are left out; repeated rows follow one another, each with its
own ids; an empty table gives no shard and reads back as no rows; other columns of the table don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, chunks, table, texts
from inkwell.llm.tokenizers_ import word_encoder

BLOCK = 128
PERCENTILE = 0.9
#: Ids that a shard takes before the next one begins.
SHARD_IDS = 500_000
#: Shards whose starts are broadcast at most.
MOST_STARTS = 200_000
#: UTF-8 bytes that are encoded at a time; more let more words be told apart at once.
ENCODE_BYTES = 12_000_000


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _exceptions(start: np.ndarray, width: np.ndarray, n_over: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each exception's position and high part; block has the exceptions' block numbers, in order."""
    first = start + 6 + 16 * width.astype(np.int64)
    rank = np.arange(len(block)) - (np.cumsum(n_over) - n_over)[block]
    return first[block] + rank, (first[block] + n_over[block] + 4 * rank)[:, None] + np.arange(4)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ids (u32) and their byte positions. Blocks of one width are packed together."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, np.uint64)
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    bits = _widths(diff)
    width = np.partition(bits, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    size = 6 + 16 * width.astype(np.int64) + 5 * n_over
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    head = np.zeros((n, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = width, n_over
    out[at[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            plane = ((diff[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            out[(at[own] + 6)[:, None] + np.arange(16 * int(w))] = np.packbits(plane.reshape(len(own), -1), axis=1, bitorder="little")
    block, place = np.nonzero(over)
    spot, high = _exceptions(at[:-1], width, n_over, block)
    out[spot] = place
    out[high] = (diff[block, place] >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), at.astype(np.uint64)


def unpack(data: bytes, at: np.ndarray, n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last (excluded) of a packed run that holds n_ids."""
    at = at.astype(np.int64)
    last = len(at) - 1 if last is None else last
    raw, n = np.frombuffer(data, np.uint8), last - first
    if n <= 0:
        return np.zeros(0, np.uint32)
    start = at[first:last]
    low = raw[start[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, n_over = raw[start + 4], raw[start + 5]
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = raw[(start[own] + 6)[:, None] + np.arange(16 * int(w))]
            plane = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
            sum_ = np.zeros((len(own), BLOCK), np.uint32)
            for b in range(int(w)):
                sum_ |= plane[:, :, b].astype(np.uint32) << np.uint32(b)
            diff[own] = sum_
    block = np.repeat(np.arange(n), n_over)
    spot, high = _exceptions(start, width, n_over.astype(np.int64), block)
    diff[block, raw[spot]] |= raw[high].view("<u4").ravel() << width[block].astype(np.uint32)
    return (diff + low[:, None]).ravel()[: n_ids - first * BLOCK]


def write_shard(keys: list[int], ids: list[bytes]) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    body, at = pack(flat)
    return b"".join([b"PFB1", struct.pack("<IIQ", len(keys), len(at) - 1, len(flat)), np.array(keys, "<i8").tobytes(), np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids)).tobytes(), at.astype("<u8").tobytes(), body])


def open_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """keys, lengths, block positions, blocks."""
    if data[:4] != b"PFB1":
        raise ValueError("not a shard of packed ids")
    n, blocks, _ = struct.unpack_from("<IIQ", data, 4)
    at = 20
    keys = np.frombuffer(data, "<i8", n, at)
    lengths = np.frombuffer(data, "<u4", n, at + 8 * n)
    index = np.frombuffer(data, "<u8", blocks + 1, at + 12 * n)
    return keys, lengths, index, data[at + 12 * n + 8 * (blocks + 1) :]


def read_document(data: bytes, k: int) -> np.ndarray:
    """The ids of the shard's k-th document, from its own blocks only."""
    _, lengths, index, body = open_shard(data)
    start, n = int(lengths[:k].sum(dtype=np.int64)), int(lengths[k])
    first, last = start // BLOCK, -(-(start + n) // BLOCK)
    total = int(lengths.sum(dtype=np.int64))
    return unpack(body, index, total, first, last)[start - first * BLOCK :][:n]


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Encodes each text, appends end_id, and writes the shards to path in ascending key order.

    Rows are dealt by ranges of the key, so no task needs more than its own range; rows without a key are left out,
    null texts are empty, rows of one key follow one another in text order.
    """
    rows = texts(docs, F.col(key).cast("long").alias("row_key")).where("row_key is not null").repartitionByRange("row_key").sortWithinPartitions("row_key", "text")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, ids, size = word_encoder(tokenizer_path), [], [], 0
        number = TaskContext.get().partitionId() << 32  # range partitions are numbered in key order

        def shard() -> pa.RecordBatch:
            data = write_shard(keys, ids)
            return pa.RecordBatch.from_pydict({"shard_no": pa.array([number], pa.int64()), "first_key": pa.array([keys[0]], pa.int64()), "last_key": pa.array([keys[-1]], pa.int64()), "n_ids": pa.array([size // 4], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch, data in chunks(batches, limit=ENCODE_BYTES):
            for k, x in zip(batch.column("row_key").to_pylist(), encoder.encode(data), strict=True):
                keys.append(k)
                ids.append(x + end)
                size += len(x) + 4
                if size >= 4 * shard_ids:
                    yield shard()
                    keys, ids, size, number = [], [], 0, number + 1
        if keys:
            yield shard()

    rows.mapInArrow(encode, "shard_no long, first_key long, last_key long, n_ids long, data binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids as little-endian 32-bit integers), read from the shards at path.

    A shard's start is the sum of the ids of the shards before it: of the partitions before, one row each, and of those of its own partition. Starts
    are 16 bytes a shard and are broadcast up to MOST_STARTS shards; beyond, the shards are shuffled to them.
    """
    shards = spark.read.parquet(path)
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = shards.select("shard_no", F.shiftright("shard_no", 32).alias("part"), F.col("n_ids").alias("n"))
    before = small.groupBy("part").agg(F.sum("n").alias("n")).select("part", so_far(Window.orderBy("part")).alias("part_start"))
    starts = small.withColumn("inside", so_far(Window.partitionBy("part").orderBy("shard_no"))).join(before, "part").select("shard_no", (F.col("part_start") + F.col("inside")).alias("shard_start"))
    starts = F.broadcast(starts) if shards.count() <= MOST_STARTS else starts

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("data").to_pylist(), batch.column("shard_start").to_pylist(), strict=True):
                keys, lengths, index, body = open_shard(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                flat = unpack(body, index, int(ends[-1])).astype("<u4").tobytes()
                starts = ends - lengths
                yield pa.RecordBatch.from_pydict({key: pa.array(keys, pa.int64()), "start": pa.array(starts + base, pa.int64()), "ids": pa.array([flat[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return shards.join(starts, "shard_no").select("data", "shard_start").mapInArrow(decode, f"{key} long, start long, ids binary")


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'packed-ids').root}/shards"
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    back = read_ids(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
