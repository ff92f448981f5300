"""Job logs, listings, size reports and history files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.params import literal_array
from trialgrid.functions.text import (
    ANY_WARNING,
    FILESYSTEM_WARNING,
    UNKNOWN_JOB,
    has_no_marker,
    is_listing_line,
    job_id_of_line,
    size_after_tab,
    size_before_tab,
)
from trialgrid.operators.joins import null_safe_join
from trialgrid.session import cut_lineage, fits_broadcast
from trialgrid.sources.lines import read_lines

#: A Python list of up to so many job ids becomes one filter, a longer one a table; the result is the same.
SHORT_ID_LIST = 200


def _first_hit(lines: DataFrame, by: Sequence[str], order: Sequence[str], found: Column, name: str) -> DataFrame:
    """The first non-null `found` of every log, null for logs without one.

    Only the few lines with a hit are sorted and shuffled; the logs themselves come from a scan of their ids.
    """
    hits = lines.select(*by, *order, found.alias(name)).filter(F.col(name).isNotNull())
    first = hits.groupBy(*by).agg(F.min_by(name, F.struct(*order)).alias(name))
    return null_safe_join(lines.select(*by).distinct(), first, by, "left")


def extract_job_id(lines: DataFrame, log: Sequence[str], order: Sequence[str], line: str = "line") -> DataFrame:
    """Job id of the first announcing line of every log, `unknown` for logs without one."""
    first = _first_hit(lines, log, order, job_id_of_line(F.col(line)), "job_id")
    return first.select(*log, F.coalesce("job_id", F.lit(UNKNOWN_JOB)).alias("job_id"))


def listing_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Only directory and file entries of a listing."""
    return lines.filter(is_listing_line(F.col(line)))


def drop_warn_lines(lines: DataFrame, line: str = "line", markers: tuple[str, ...] = FILESYSTEM_WARNING) -> DataFrame:
    """Without the lines in which a marker occurs."""
    return lines.filter(has_no_marker(F.col(line), markers))


def first_parsable_size(
    lines: DataFrame, by: Sequence[str], order: Sequence[str], line: str = "line", old_form: bool = False
) -> DataFrame:
    """Size from the first line of a report that holds one, warnings left out; null if none does."""
    size = (size_after_tab if old_form else size_before_tab)(F.col(line))
    return _first_hit(lines, by, order, F.when(has_no_marker(F.col(line), ANY_WARNING), size), "size")


def job_history_scan(files: DataFrame, name: str, job_ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Files whose name starts with one of the job ids, or with `job_` when none are given or the list is empty.

    A short list is a filter. Of a table, ids that begin with another id are left out first, as the other finds the same
    files; then a name begins with at most one id. Its prefixes, of all lengths that occur, meet the ids in one equality
    join, which needs no shuffle if the ids can be broadcast. No pairs are formed, and the plan is the same for any ids.
    """
    column = F.col(name)
    whole = files.filter(F.startswith(column, F.lit("job_")))
    if job_ids is None:
        return whole
    if not isinstance(job_ids, DataFrame) and len(job_ids) > SHORT_ID_LIST:
        job_ids = files.sparkSession.createDataFrame([(job_id,) for job_id in job_ids], "id string")
    if not isinstance(job_ids, DataFrame):
        if not job_ids:
            return whole
        hit = F.lit(False)
        for job_id in job_ids:
            hit = hit | F.startswith(column, F.lit(job_id))
        return files.filter(hit)
    ids = cut_lineage(job_ids.toDF("__id").filter(F.col("__id").isNotNull()).distinct())
    lengths = sorted(row[0] for row in ids.select(F.length("__id")).distinct().collect())  # lengths of file names
    if not lengths:
        return whole

    def prefixes(text: Column, below: Column) -> Column:
        cut = F.transform(literal_array(lengths), lambda n: F.when(n < below, F.substring(text, F.lit(1), n)))
        return F.explode(F.array_compact(cut)).alias("__prefix")

    nested = ids.select("__id", prefixes(F.col("__id"), F.length("__id"))).join(ids.toDF("__prefix"), "__prefix", "left_semi")
    first = cut_lineage(ids.join(nested.select("__id").distinct(), "__id", "left_anti").toDF("__prefix"))
    begun = files.select("*", prefixes(column, F.length(column) + 1))
    side = F.broadcast(first) if fits_broadcast(first) else first
    return begun.join(side, "__prefix", "left_semi").drop("__prefix")


def copy_history(spark: SparkSession, source: str, dest: str, job_ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Copy matching history files as lines (file, name, order, line) to a table and read it back."""
    lines = read_lines(spark, source)
    named = lines.withColumn("name", F.element_at(F.split("file", "/"), -1))
    job_history_scan(named, "name", job_ids).write.parquet(dest)
    return spark.read.parquet(dest)
