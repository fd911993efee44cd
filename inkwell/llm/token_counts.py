"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content together with the digest of the tokenizer's file. Normalising
may change nothing that changes a count, so it only makes null the empty text. Stored counts are joined by key; of
the rest one text for each distinct key is encoded, and the new counts are appended to the cache, a Parquet table.

Null and empty texts count 0 tokens; repeated rows are encoded once and each get their count; an empty table gives an
empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, chunks, table, texts
from inkwell.llm.tokenizers_ import piece_counter

CACHE = "content_sha binary, tokenizer_sha string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row; the cache at cache_path gains the counts that it lacked.

    Text is shuffled once, after equal texts of a task have been merged; counts are joined by digest, a join whose
    hot keys adaptive execution splits.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    keyed = texts(docs, F.col(key).alias("row_key")).withColumn("content_sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = read_cache(spark, cache_path).where(F.col("tokenizer_sha") == version).select("content_sha")
    missing = keyed.groupBy("content_sha").agg(F.first("text").alias("text")).join(known, "content_sha", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch, data in chunks(batches):
            n = counter.counts([x.decode() for x in data])
            yield pa.RecordBatch.from_pydict({"content_sha": batch.column("content_sha"), "tokenizer_sha": pa.array([version] * len(n)), "n_tokens": pa.array(n, pa.int64())})

    missing.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_sha") == version).dropDuplicates(["content_sha"]).select("content_sha", "n_tokens")
    rows = keyed.select("row_key", "content_sha", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "content_sha").select(F.col("row_key").alias(key), "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str, max_tokens: int = 4096) -> DataFrame:
    """The query starts with an empty cache, so that every distinct text is encoded."""
    cache = Scratch(spark, "token-cache").root
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
