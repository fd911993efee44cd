"""What the two document classifiers share: a bounded labelled sample, its features, and scoring in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import as_bytes, chunks, remainder, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """(y, text) of at most ``most`` documents: those labelled rows outside the held-out quarter that a hash ranks first.

    The ranked keys are at most ``most`` rows, which bounds the broadcast. Rows without a label or key take no part,
    a key with two labels takes its larger one, a key with several rows the text that comes first.
    """
    chosen = labels.where(remainder(key, 4) != 2).where(F.col(label).isNotNull()).groupBy(F.col(key).alias("sample_key")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("sample_key"), "sample_key").limit(most)
    return texts(docs, F.col(key).alias("row_key")).join(F.broadcast(chosen), F.col("row_key") == F.col("sample_key")).groupBy("row_key").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def gather(sample: DataFrame, features: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sample's labels and its documents as (distinct features, counts), in key order; features are made on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches):
            rows = [np.unique(features(x), return_counts=True) for x in data]
            yield pa.RecordBatch.from_pydict({"row_key": batch.column("row_key").cast(pa.string()), "y": batch.column("y"), "f": pa.array([f.astype("<u4").tobytes() for f, _ in rows], pa.binary()), "n": pa.array([np.minimum(n, 65535).astype("<u2").tobytes() for _, n in rows], pa.binary())})

    got = sample.mapInArrow(run, "row_key string, y int, f binary, n binary").toArrow().sort_by("row_key")
    f, n = as_bytes(got["f"].combine_chunks()), as_bytes(got["n"].combine_chunks())
    return got["y"].to_numpy(), [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u2").astype(np.float32)) for a, b in zip(f, n, strict=True)]


def hashed(parts: list[bytes], n: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(p) % n for p in parts]


def score_rows(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], key: str) -> DataFrame:
    """(key, score) for each row of docs, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in chunks(batches):
            yield pa.RecordBatch.from_pydict({key: batch.column("row_key"), "score": pa.array(score(data), pa.float64())})

    return texts(docs, F.col(key).alias("row_key")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
