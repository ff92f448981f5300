"""Columns over log lines, listings and size texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and formats of the logs that are read.
JOB_MARK = "Running job"
JOB_CLIENTS = ("mapred.JobClient", "mapreduce.Job")
JOB_PATTERN = r".*Running job: (.*)"
UNKNOWN_JOB = "unknown"
LISTING_MARKS = ("d", "-")
FILESYSTEM_WARNING = ("WARN fs.FileSystem",)
ANY_WARNING = ("WARN", "warning")
KB, MB, GB = 1024, 1048576, 1073741824
INTEGER = r"^\s*[+-]?\d+\s*$"


def job_id_of_line(line: Column) -> Column:
    """The job id a line announces, else null."""
    from_client = F.lit(False)
    for client in JOB_CLIENTS:
        from_client = from_client | F.contains(line, F.lit(client))
    announces = F.contains(line, F.lit(JOB_MARK + ": ")) & from_client
    return F.when(announces, F.regexp_extract(line, JOB_PATTERN, 1))


def is_listing_line(line: Column) -> Column:
    """Directory or plain file entry of a recursive listing."""
    return F.substring(line, 1, 1).isin(*LISTING_MARKS)


def has_no_marker(line: Column, markers: tuple[str, ...] = FILESYSTEM_WARNING) -> Column:
    """True when no marker occurs in the line."""
    clean = F.lit(True)
    for marker in markers:
        clean = clean & ~F.contains(line, F.lit(marker))
    return clean


def _as_integer(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(INTEGER)), F.btrim(text, F.lit(" \t\r\n")).try_cast("bigint"))


def size_before_tab(line: Column) -> Column:
    """The text before the last tab as an integer, else null."""
    head = F.when(F.contains(line, F.lit("\t")), F.regexp_extract(line, r"(?s)^(.*)\t", 1))
    return _as_integer(head)


def size_after_tab(line: Column) -> Column:
    """The old report form: the text after the last tab as an integer, else null."""
    return _as_integer(F.substring_index(line, "\t", -1))


def _tenths(size: Column, unit: int) -> Column:
    """`size / unit` with one decimal, ties to even, in integer arithmetic."""
    scaled = size * 10
    unit_col = F.lit(unit).cast("bigint")
    whole = F.call_function("div", scaled, unit_col)
    twice_rest = (scaled % unit_col) * 2
    round_up = (twice_rest > unit_col) | ((twice_rest == unit_col) & (whole % 2 == 1))
    tenths = whole + F.when(round_up, F.lit(1)).otherwise(F.lit(0))
    ten = F.lit(10).cast("bigint")
    return F.concat(F.call_function("div", tenths, ten).cast("string"), F.lit("."), (tenths % ten).cast("string"))


def human_size(size: Column) -> Column:
    """` (1.2 KB)` and so on; empty up to 1024 bytes and at exactly one MB or one GB."""
    size = size.cast("bigint")
    text = lambda unit, name: F.concat(F.lit(" ("), _tenths(size, unit), F.lit(f" {name})"))
    return (
        F.when((size > KB) & (size < MB), text(KB, "KB"))
        .when((size > MB) & (size < GB), text(MB, "MB"))
        .when(size > GB, text(GB, "GB"))
        .otherwise(F.lit(""))
    )


def to_megabytes(text: Column) -> Column:
    """`"16384 kB"` -> 16; kB rounds down, MB as is, GB times 1024; null for another unit."""
    amount = F.regexp_extract(text, r"^\s*(\d+)\s+\S+\s*$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+\s+(\S+)\s*$", 1))
    return (
        F.when(unit == "kb", F.call_function("div", amount, F.lit(KB).cast("bigint")))
        .when(unit == "mb", amount)
        .when(unit == "gb", amount * KB)
    )
