"""Host lists from a file, a comma list or a single name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.params import BLANKS
from trialgrid.operators.ordinal import ordinal
from trialgrid.session import cut_lineage
from trialgrid.sources.lines import LINE_ORDER, read_lines
from trialgrid.sources.runlog import path_exists


def host_list_scan(rows: DataFrame, hosts: str, order: Sequence[str]) -> DataFrame:
    """(pos, host): distinct hosts of comma lists in first-seen order, blanks at the end removed."""
    listed = rows.select(*order, F.posexplode(F.split(hosts, ",")).alias("__at", "__host"))
    trimmed = listed.select(F.rtrim("__host", F.lit(BLANKS)).alias("host"), F.struct(*order, "__at").alias("seen"))
    first = trimmed.groupBy("host").agg(F.min("seen").alias("seen"))
    flat = cut_lineage(first.select("host", "seen.*"))  # written once, numbered in several passes
    return ordinal(flat, [*order, "__at"], name="pos").select("pos", "host")


def read_hosts(spark: SparkSession, spec: str) -> DataFrame:
    """Hosts named by a file with one per line, by a comma list, or by a single name."""
    if "," not in spec and path_exists(spark, spec):
        lines = read_lines(spark, spec).select(*LINE_ORDER, F.rtrim("line", F.lit(BLANKS)).alias("host"))
        first = lines.groupBy("host").agg(F.min(F.struct(*LINE_ORDER)).alias("seen")).select("host", "seen.*")
        return ordinal(cut_lineage(first), LINE_ORDER, name="pos").select("pos", "host")
    return host_list_scan(spark.createDataFrame([(0, spec)], "line_no int, hosts string"), "hosts", ["line_no"])
