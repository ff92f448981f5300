"""Compressed files and archives as lines."""

from __future__ import annotations

import bz2
import gzip
import io
import sys
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.sources.lines import FILE_PATH, LINE_ORDER, read_lines

# Suffixes in the order in which they are tried, and the prefix of decoded names.
SUFFIXES = ("tar.gz", "gz", "zip", "bz2")
DECODED_PREFIX = "data-"

LINES = "path string, kind string, name string, member string, line_no bigint, line string"
#: Lines sent back to Spark at a time.
LINES_PER_BATCH = 5_000


def archive_kind(path: Column) -> Column:
    """Suffix class of a path, null when it is none of the known ones."""
    kind = F.lit(None).cast("string")
    for suffix in reversed(SUFFIXES):
        kind = F.when(F.endswith(path, F.lit(suffix)), F.lit(suffix)).otherwise(kind)
    return kind


def decoded_name(path: Column) -> Column:
    """`dir/a.gz` -> `dir/data-a`; the path itself for an unknown suffix."""
    kind = archive_kind(path)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(kind) - 1)
    return F.when(kind.isNotNull(), F.regexp_replace(stem, r"(?s)^(.*/)?([^/]*)$", "$1" + DECODED_PREFIX + "$2")).otherwise(path)


def _members(kind: str | None, content: bytes) -> Iterator[tuple[str | None, io.BufferedIOBase]]:
    """The decoded streams of one file; a stream is read before the next one is opened."""
    data = io.BytesIO(content)
    if kind == "tar.gz":
        with tarfile.open(fileobj=data, mode="r|gz") as archive:
            for entry in archive:
                if entry.isfile():
                    yield entry.name, archive.extractfile(entry)
    elif kind == "zip":
        with zipfile.ZipFile(data) as archive:
            for entry in archive.infolist():
                if not entry.is_dir():
                    yield entry.filename, archive.open(entry)
    elif kind == "gz":
        yield None, gzip.open(data)
    elif kind == "bz2":
        yield None, bz2.open(data)
    else:
        yield None, data


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "kind", "name", "member", "line_no", "line"]
    rows: list[tuple] = []
    for batch in batches:
        for path, kind, name, content in batch[["path", "kind", "name", "content"]].itertuples(index=False):
            kind = kind if isinstance(kind, str) else None
            for member, stream in _members(kind, content):
                for number, line in enumerate(stream):
                    text = line.rstrip(b"\n").decode("utf-8", errors="replace")
                    rows.append((path, kind, name, member, number, text))
                    if len(rows) >= LINES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def decode_archives(files: DataFrame) -> DataFrame:
    """(path, content) files -> one row per line with suffix class, decoded name and member.

    An archive cannot be split, so it is one row; files are spread over tasks by Spark. An unknown suffix keeps
    its content and name and has a null kind.
    """
    path = F.col("path")
    named = files.select(path, archive_kind(path).alias("kind"), decoded_name(path).alias("name"), "content")
    return named.mapInPandas(_decode, LINES)


def _read_by_codec(path: Column) -> Column:
    """Files that Spark's text source reads itself: plain, gz and bz2, of any size."""
    packed = F.endswith(path, F.lit("tar.gz")) | F.endswith(path, F.lit("zip"))
    other_gz = F.endswith(path, F.lit("gz")) & ~F.endswith(path, F.lit(".gz"))
    other_bz2 = F.endswith(path, F.lit("bz2")) & ~F.endswith(path, F.lit(".bz2"))
    return ~(packed | other_gz | other_bz2)


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Every file below a directory as lines (path, kind, name, member, block_start, row, line).

    Plain, gz and bz2 files go through Spark's codecs, which read them as streams and split the plain and bz2
    ones over tasks. Only zip and tar.gz archives are decoded as a whole, each in one task.
    """
    lines = read_lines(spark, directory, _read_by_codec)
    path = F.col("file")
    streamed = lines.select(
        path.alias("path"),
        archive_kind(path).alias("kind"),
        decoded_name(path).alias("name"),
        F.lit(None).cast("string").alias("member"),
        *LINE_ORDER,
        "line",
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    packed = decode_archives(files.filter(~_read_by_codec(F.col(FILE_PATH))).select("path", "content"))
    whole = packed.select("path", "kind", "name", "member", F.lit(0).cast("bigint").alias("block_start"),
                          F.col("line_no").alias("row"), "line")
    return streamed.unionByName(whole)


# Tasks get this module's functions with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
