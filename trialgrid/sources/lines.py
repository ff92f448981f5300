"""Text files as lines with their order in the file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that order the lines of one file.
LINE_ORDER = ("block_start", "row")


#: The path of the file a row comes from; a filter on it skips whole files.
FILE_PATH = "_metadata.file_path"


def read_lines(spark: SparkSession, path: str | Sequence[str], files: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, block_start, row, line). Large files are split over tasks and still keep their order.

    `block_start` is the offset of the split a line was read from; within a split `row` increases. `files` may
    choose files by a condition on their path. Compressed files are decoded by their suffix.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    text = reader.text(path if isinstance(path, str) else list(path))
    if files:
        text = text.filter(files(F.col(FILE_PATH)))
    return text.select(
        F.col(FILE_PATH).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
