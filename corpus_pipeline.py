"""A corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, and BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents, whatever others the table has beside doc_id and text. Rows without doc_id can't be compared with others and leave
at the second stage. Null texts have no words: they count as any other text in the first stage, and are kept by the others. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.bpe import round_trip
from inkwell.llm.common import Scratch, table
from inkwell.llm.decontaminate import find_hits
from inkwell.llm.jaccard import group_documents
from inkwell.llm.quality import score_quality
from inkwell.llm.substrings import remove_repeats

#: A document of a lower score is rejected, as op3_quality predicts low quality there.
QUALITY = 0.7


def _fresh(name: str, docs: DataFrame) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _by_row(docs: DataFrame) -> DataFrame:
    """(row, text): whole rows as a key, so that a decision about a text goes with its own row, whatever its doc_id."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score QUALITY or more stay. It is fitted on the labelled ones of docs; without labels every row scores 0.5 and goes."""
    return score_quality(docs, table(spark, sf_dir, "labels"), rows=_by_row(docs)).where(F.col("score") >= QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, in one row: of several, the one whose text comes first."""
    kept, nth = _fresh("kept", docs), _fresh("nth", docs)
    ids = group_documents(docs, Scratch(spark, "near")).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.join(ids, docs["doc_id"] == F.col(kept), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*("text", *(c for c in docs.columns if c not in ("doc_id", "text"))))
    return rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go; a document that loses words has the others joined by one space.

    n_chars, where there is one, follows the text. Rows without doc_id or text stay as they are.
    """
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    cut = remove_repeats(docs.where(known), Scratch(spark, "passages"), carry=[c for c in docs.columns if c != "text"])
    columns = {c: F.col(f"carried.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(columns[c].alias(c) for c in docs.columns)).unionByName(docs.where(~known))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window stay."""
    return find_hits(_by_row(docs), table(spark, sf_dir, "benchmark"), "row").where("n_hit = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("BPE encoding and decoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
