"""Run tables: the state of a sweep, run and dataset records, run outputs and their retention."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialgrid.operators.joins import null_safe_join
from trialgrid.session import cut_lineage, fits_broadcast

RUNS = (
    "run_id bigint, comb_key string, job_id string, params map<string,string>, rep int, status string, "
    "attempt int, error string, ts timestamp"
)
DATASETS = "ds_id bigint, ds_class string, props map<string,string>"
STATS = "run_id bigint, job_id string, stage_id int, stage string, tasks int, completed int, failed int"
#: Stands in front of ids that are texts in the names of their folders.
TEXT_MARK = "t"
#: Partitions removed by one statement.
PARTITIONS = 200
LOADS = "dest string, desired_size bigint, files bigint, raw_bytes bigint, final_bytes bigint"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything exists at a path of the session's file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def append_rows(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """Append a few driver-made records to a table."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def read_rows(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A record table, empty if nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_summary(
    params: DataFrame, ident: Sequence[str], names: Sequence[str] | None = None, name: str = "name", value: str = "value"
) -> DataFrame:
    """Long (ident, name, value) records to one wide row per run; one value per run and name.

    Without `names` all that occur become columns, in order. With them, a record of another name is an error, so that none
    is lost. One aggregate with a condition per name does it in a single shuffle.
    """
    if names is None:
        names = sorted(row[0] for row in params.select(name).dropna().distinct().collect())  # the result's columns
    else:
        other = params.filter(~F.col(name).isin(*names)).select(name).limit(1).collect()
        if other:
            raise ValueError(f"{other[0][0]} is not among the names of the summary")
    columns = [F.max(F.when(F.col(name) == one, F.col(value))).alias(one) for one in names]
    return params.groupBy(*ident).agg(*columns)


def run_params(runs: DataFrame, ident: str = "run_id") -> DataFrame:
    """Run records as long (ident, job_id, name, value) rows."""
    return runs.select(ident, "job_id", F.explode("params").alias("name", "value"))


def dataset_summary(datasets: DataFrame) -> DataFrame:
    """Dataset records with their properties as one JSON text, names in order, ready for CSV."""
    entries = F.array_sort(F.map_entries("props"))
    text = F.to_json(F.map_from_entries(entries))
    return datasets.select("ds_id", "ds_class", text.alias("ds_class_properties"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def export_output(outputs: DataFrame, path: str, run: str = "run_id", mode: str = "errorifexists") -> None:
    """Outputs of runs, one folder per run, so that one run is read without touching the others.

    Rows are brought together by run to write few files, and AQE splits the partition of a large run. Ids that are texts
    have a mark in front in the names of folders, which keeps an empty text apart from null.
    """
    outputs = outputs.hint("rebalance", run)
    if dict(outputs.dtypes)[run] == "string":
        outputs = outputs.withColumn(run, _marked(F.col(run)))
    outputs.write.mode(mode).partitionBy(run).parquet(path)


def save_output(outputs: DataFrame, table: str, run: str = "run_id") -> None:
    """Outputs of runs as a table of the warehouse with one partition per run, written as by `export_output`."""
    outputs = outputs.hint("rebalance", run)
    outputs.withColumn(run, _marked(F.col(run).cast("string"))).write.format("parquet").partitionBy(run).saveAsTable(table)


def table_output(spark: SparkSession, table: str, kind: str, run: str = "run_id") -> DataFrame:
    """All outputs of such a table, with run ids of type `kind`."""
    return spark.table(table).withColumn(run, _unmarked(run).cast(kind))


def drop_runs(spark: SparkSession, table: str, dropped: DataFrame, run: str = "run_id") -> None:
    """Remove runs from such a table: partitions of the dropped ids go, nothing else is read or written.

    Null is an id like others, ids without outputs are passed over. The ids come to the driver a few at a time.
    """
    ids = (row[0] for row in dropped.select(F.col(run).cast("string")).distinct().toLocalIterator())
    while batch := list(islice(ids, PARTITIONS)):
        specs = ", ".join(f"PARTITION (`{run}` = {_quoted(one)})" for one in batch)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def _quoted(ident: str | None) -> str:
    """An id as its partition is named in SQL text."""
    if ident is None:
        return "null"
    escaped = ident.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{TEXT_MARK}{escaped}'"


def _marked(ident: Column) -> Column:
    return F.concat(F.lit(TEXT_MARK), ident)


def read_output(spark: SparkSession, path: str, kind: str, run: str = "run_id") -> DataFrame:
    """All outputs, with the run ids as they were written: of type `kind`, not of the type their folders suggest."""
    fields = [f"`{f.name}` {kind if f.name == run else f.dataType.simpleString()}" for f in spark.read.parquet(path).schema]
    found = spark.read.schema(", ".join(fields)).parquet(path)
    return found.withColumn(run, _unmarked(run)) if kind == "string" else found


def _read_marked(spark: SparkSession, path: str, schema: StructType, run: str) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    return found.withColumn(run, _unmarked(run)) if schema[run].dataType.simpleString() == "string" else found


def _unmarked(run: str) -> Column:
    return F.substr(F.col(run), F.lit(len(TEXT_MARK) + 1))


def _listed(outputs: DataFrame, runs: DataFrame, run: str, how: str) -> DataFrame:
    ids = cut_lineage(runs.select(F.col(run).cast(dict(outputs.dtypes)[run])).distinct())
    return null_safe_join(outputs, ids, [run], how, broadcast=fits_broadcast(ids))


def fetch_output(
    spark: SparkSession, path: str, runs: Sequence | DataFrame, run: str = "run_id", kind: str | None = None
) -> DataFrame:
    """Outputs of some runs, given as a list or as a table of ids; null is an id like others.

    Only the folders of listed ids are read; those of a table prune them at run time, if the ids can be broadcast. `kind` is
    the type the ids were written with; a table brings it along, a list of texts means text, and one of numbers `bigint`.
    """
    if isinstance(runs, DataFrame):
        return _listed(read_output(spark, path, kind or dict(runs.dtypes)[run], run), runs, run, "left_semi")
    kind = kind or ("string" if any(isinstance(one, str) for one in runs) else "bigint")
    chosen = F.col(run).isin([one for one in runs if one is not None])  # also prunes folders: the mark is taken off a folder's name
    return read_output(spark, path, kind, run).filter(chosen | F.col(run).isNull() if None in runs else chosen)


def drop_output(spark: SparkSession, path: str, dropped: DataFrame, dest: str, run: str = "run_id") -> DataFrame:
    """Write the outputs without the dropped runs to a fresh path and read them from there.

    Ids are compared as they were written, by the type of `dropped`; null is an id like others.
    """
    every = read_output(spark, path, dict(dropped.dtypes)[run], run)
    export_output(_listed(every, dropped, run, "left_anti"), dest, run)
    return _read_marked(spark, dest, every.schema, run)
