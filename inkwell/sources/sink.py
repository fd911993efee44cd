"""Writing a site: (path, content) rows as files, through Spark's data source API or straight to a folder that all executors see."""

from __future__ import annotations

import os
import shutil
import struct
import time
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def unsafe_paths(files: DataFrame) -> DataFrame:
    """Paths that are absolute, climb, have empty parts, or occur twice."""
    bad = files.where(F.col("path").rlike(r"^/|(^|/)\.\.?(/|$)|//|^$")).select("path", F.lit("unsafe").alias("why"))
    twice = files.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("why"))
    return bad.union(twice)


class SiteDataSource(DataSource):
    """``df.write.format("site").option("path", folder)``: one file a row."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SiteWriter(self.options["path"])


class SiteWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for row in iterator:
            target = Path(self.folder) / row["path"]
            if PurePosixPath(row["path"]).is_absolute() or ".." in PurePosixPath(row["path"]).parts:
                raise ValueError(f"unsafe path: {row['path']}")
            target.parent.mkdir(parents=True, exist_ok=True)
            new = target.with_name(f".{target.name}.{os.getpid()}")
            new.write_text(row["content"], encoding="utf-8")
            new.replace(target)  # a task that runs again leaves the same file
        return WriterCommitMessage()


def write_site(spark: SparkSession, files: DataFrame, folder: str, assets: dict[str, bytes] | None = None) -> None:
    """Checks all paths, then writes the files and static assets."""
    if found := unsafe_paths(files).take(5):
        raise ValueError(f"paths can't be written: {[tuple(r) for r in found]}")
    spark.dataSource.register(SiteDataSource)
    files.select("path", "content").write.format("site").mode("append").option("path", folder).save()
    for name, data in (assets or {}).items():
        target = Path(folder) / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


STYLE = b"body{max-width:40em;margin:auto;font-family:serif;line-height:1.6}pre{overflow:auto}nav a{margin-left:1em}\n"


def favicon(colour: tuple[int, int, int] = (32, 32, 48), size: int = 16) -> bytes:
    """A PNG of one colour."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + bytes(colour) * size) * size
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def copy_asset(source: str, folder: str, name: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, Path(folder) / name)


@contextmanager
def timer(tag: str):
    """Prints the tag and the milliseconds that the block took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        print(f"{tag:>7} {(time.perf_counter() - began) * 1000:>6.3f} ms")
