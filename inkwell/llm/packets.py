"""Numbers sent between tasks as packed arrays: one row holds those of one slice of documents for one bucket.

Rows of (kind, bucket, payload) are shuffled by bucket; buckets are equal ranges of a 64-bit hash, several to a shuffle
partition, so a bucket's share is the input's divided by their number. A payload holds arrays, each with its own length.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import tidy

SCHEMA = "kind int, bucket int, payload binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
_TYPES = "<i8", "<u8", "<u4", "<f8", "<u2", "|u1", "<i4", "<f4"


def dump(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind = a.dtype.str if a.dtype.str in _TYPES else "<i8"
        parts += [struct.pack("<BI", _TYPES.index(kind), len(a)), a.astype(kind, copy=False).tobytes()]
    return b"".join(parts)


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        k, n = struct.unpack_from("<BI", data, at)
        a = np.frombuffer(data, _TYPES[k], n, at + 5)
        out.append(a)
        at += 5 + a.nbytes
    return out


def join(payloads: list[bytes]) -> list[np.ndarray]:
    """The payloads' arrays, each put together."""
    return [np.concatenate(x) for x in zip(*map(load, payloads), strict=True)]


class Out:
    """Collects packets of one batch."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.bucket: list[int] = []
        self.payload: list[bytes] = []

    def add(self, kind: int, bucket: int, *arrays: np.ndarray) -> None:
        self.kind.append(kind)
        self.bucket.append(bucket)
        self.payload.append(dump(*arrays))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.kind, pa.int32()), pa.array(self.bucket, pa.int32()), pa.array(self.payload, pa.binary())], schema=_ARROW)


def by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for k, p in zip(table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True):
        out.setdefault(k, []).append(p)
    return out


def reduce_buckets(packets: DataFrame, f: Callable[[int, dict[int, list[bytes]]], pa.Table], schema: str) -> DataFrame:
    """f(bucket, payloads by kind) for every bucket; one shuffle."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return f(key[0].as_py(), by_kind(table))
        finally:
            tidy()

    return packets.groupBy("bucket").applyInArrow(run, schema)


def runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs of equal elements, and the runs' lengths."""
    if not len(doc):
        return doc, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[at], np.diff(np.append(at, len(doc)))


def as_table(rows: Iterator[pa.RecordBatch] | list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(rows))
