"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items.

Normalised text: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space. In UTF-8 the
ASCII bytes 0-9 and a-z and every byte of a longer sequence are word bytes, so one byte table normalises a text.
Each text is scanned once; a match's end gives its words, and with ``spans`` the words' offsets in the original.

Null and empty texts have no words and no hits; rows of the benchmark without words are no patterns; repeated rows
each get their result; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, chunks, table, texts

WINDOW = 10
#: Bytes of window text in one automaton. A larger benchmark is scanned for in several passes.
MAX_PATTERN_BYTES = 32_000_000

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int = WINDOW) -> list[str]:
    """The item's windows, each with a space before and after every word; latin-1 text of the UTF-8 bytes."""
    w = words(text)
    return [(b" " + b" ".join(w[i : i + size]) + b" ").decode("latin-1") for i in range(max(1, len(w) - size + 1))] if w else []


def patterns(benchmark: DataFrame, size: int = WINDOW, most: int = MAX_PATTERN_BYTES) -> Iterator[dict[str, list[str]]]:
    """window -> item ids (as text), in parts of bounded size; the benchmark is read a partition at a time."""
    part: dict[str, list[str]] = {}
    weight = 0
    for row in texts(benchmark, F.col("item_id").cast("string").alias("item")).where("item is not null").toLocalIterator():
        for w in windows(row["text"].encode(), size):
            own = part.setdefault(w, [])
            if not own or own[-1] != row["item"]:
                own.append(row["item"])
                weight += len(w) + 64
        if weight >= most:
            yield part
            part, weight = {}, 0
    if part or not weight:
        yield part


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """Built once in a worker for each broadcast."""
    key = shared.value["key"]  # its own for each broadcast, so a worker never takes an older one's
    if key not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for w, items in shared.value["patterns"].items():
            a.add_word(w, (w.count(" ") - 1, tuple(items)))
        if len(a):
            a.make_automaton()
        _built[key] = a
    return _built[key]


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the merged word ranges that are hit, and the items found."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], set()
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    found = list(a.iter(line))
    if not found:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])
    merged: list[tuple[int, int]] = []
    for s, e in sorted((int(e) - n, int(e)) for e, (_, (n, _)) in zip(last, found, strict=True)):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return len(w), merged, {i for _, (_, items) in found for i in items}


def char_spans(text: bytes, merged: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as byte offsets of the original text."""
    if not merged:
        return []
    inside = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [{"start": int(edge[2 * s]), "end": int(edge[2 * e - 1])} for s, e in merged]


_SPANS = "array<struct<start:long,end:long>>"


def _shared(spark: SparkSession, part: dict[str, list[str]]):
    return spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "patterns": part})


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared)
        for batch, data in chunks(batches):
            rows = [(n, r, sorted(i), char_spans(x, r)) for x in data for n, r, i in [scan(x, a)]]
            cols = {"row_key": batch.column("row_key"), "n_words": pa.array([x[0] for x in rows], pa.int64()), "ranges": pa.array([[{"s": s, "e": e} for s, e in x[1]] for x in rows], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), "items": pa.array([x[2] for x in rows], pa.list_(pa.string())), "spans": pa.array([x[3] for x in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            if "row_no" in batch.schema.names:
                cols["row_no"] = batch.column("row_no")
            yield pa.RecordBatch.from_pydict(cols)

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = WINDOW, most: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items, spans): one row per row of docs; spans are byte offsets in the text as it is.

    With a benchmark beyond ``most`` bytes each text is scanned once per part, part after part, so that driver and workers
    hold one part at a time; rows are numbered in a written table, and the parts' word ranges are merged by number.
    """
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType
    out = f"row_key {kind.simpleString()}, n_words long, ranges array<struct<s:long,e:long>>, items array<string>, spans {_SPANS}"
    source = texts(docs, F.col(key).alias("row_key"))
    parts = patterns(benchmark, size, most)
    first, second = next(parts), next(parts, None)
    if second is None:
        hits = source.mapInArrow(_scanner(_shared(spark, first)), out)
    else:
        scratch = Scratch(spark, "hits")
        source = scratch.save(source.withColumn("row_no", F.monotonically_increasing_id()), "rows")
        tables = []
        for k, part in enumerate(chain((first, second), parts)):
            shared = _shared(spark, part)
            tables.append(scratch.save(source.mapInArrow(_scanner(shared), f"{out}, row_no long"), f"part-{k}"))
            shared.destroy()
        hits = reduce(DataFrame.union, tables)
        hits = hits.groupBy("row_no").agg(F.first("row_key").alias("row_key"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    covered = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
    )["n"]
    return hits.select(F.col("row_key").alias(key), "n_words", covered.alias("n_hit"), "items", "spans")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
