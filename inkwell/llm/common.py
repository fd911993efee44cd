"""What the operators of this package share: the shared folder, word splitting and hashing, packing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a worker handles at a time.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another libc
        return None


def tidy() -> None:
    """Gives freed memory back to the system: Python workers stay when their task is over, and so would what they held."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


class Scratch:
    """Tables written under the shared folder; they cut lineage, survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of frames that are no longer referenced."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(key: str, n: int) -> Column:
    """crc32(key as text) mod n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text, null as empty; other columns of the table can't clash with later ones."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def as_bytes(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about limit bytes of text each, and that text."""
    for batch in batches:
        data = as_bytes(batch.column(column))
        start, size = 0, 0
        for i, x in enumerate(data):
            size += len(x)
            if size >= limit or i == len(data) - 1:
                yield batch.slice(start, i + 1 - start), data[start : i + 1]
                start, size = i + 1, 0
    tidy()


def chunk_bytes(buckets: int) -> int:
    """Text for one round of packets: more where there are many buckets, so that packets don't become tiny; bounded."""
    return min(8 * CHUNK_BYTES, max(CHUNK_BYTES, 2000 * buckets))


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: where they lie in one array of bytes, and each text's bounds among them."""

    def __init__(self, data: list[bytes]) -> None:
        self.raw = np.frombuffer(b"\n".join([b"", *data, b" " * 9]), np.uint8)
        white = WHITE[self.raw]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        self.at = np.searchsorted(self.start, np.cumsum([0, *(len(x) + 1 for x in data)]))

    def hashes(self) -> np.ndarray:
        """64 bits of every word, eight bytes at a time; words of up to eight bytes and equal length never collide."""
        wide = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        n = self.end - self.start
        h = mix((wide[self.start] & _FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * _ODD)
        on, k = np.flatnonzero(n > 8), 8
        while len(on):
            h[on] = mix(h[on] * _ODD + (wide[self.start[on] + k] & _FIRST[np.minimum(n[on] - k, 8)]))
            k += 8
            on = on[n[on] > k]
        return h

    def text(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The k-th text's words, or those that keep marks, joined by one space."""
        s, e = self.start[self.at[k] : self.at[k + 1]], self.end[self.at[k] : self.at[k + 1]]
        if keep is not None:
            s, e = s[keep], e[keep]
        raw = self.raw.data
        return b" ".join([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])


def hashed_words(data: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, each text's bounds among them); lower: A-Z lower-cased."""
    words = Words([x.lower() for x in data] if lower else data)
    return words.hashes(), words.at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def offsets(docs: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The n equal ranges of the hashes' upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split_by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, positions with key k, in order) for the keys that occur."""
    if n <= 1 << 16:
        key = key.astype(np.uint8 if n <= 256 else np.uint16)  # numpy sorts short numbers by radix
    order = np.argsort(key, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])
    for k in range(n):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]


def record_batch(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Rounds of large-star and small-star steps; each round's edges are a written table, and a hot node's
    neighbours are aggregated with partial minima, never gathered in a list.
    """
    spark = scratch.spark
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for k in range(1, 100):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = down.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        after = scratch.save(small.distinct(), f"{name}-{k}")
        total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = total(after) == total(now)
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
