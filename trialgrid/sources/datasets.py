"""Datasets: listing, size caps, slots, loading with hooks, size reports and user-defined classes."""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators.ordinal import capped_prefix, ordinal
from trialgrid.plans.samples import generate_sized_text
from trialgrid.sources.runlog import LOADS, append_rows, path_exists, read_rows


class DatasetError(ValueError):
    """A dataset that cannot be loaded."""


# Files and rows --------------------------------------------------------------


def file_inventory(spark: SparkSession, directory: str | Sequence[str], directories: bool = False) -> DataFrame:
    """(kind, path, length, modified) of all files below a directory; contents are not read.

    With `directories`, the folders that hold files are listed too, as kind `d` without a length.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = reader.load(directory if isinstance(directory, str) else list(directory))
    files = listed.select(
        F.lit("-").alias("kind"), "path", "length", F.col("modificationTime").alias("modified")
    )
    if not directories:
        return files
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    folders = files.select(parent.alias("path")).distinct().select(
        F.lit("d").alias("kind"),
        "path",
        F.lit(None).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modified"),
    )
    return folders.unionByName(files)


def sort_files(files: DataFrame, order: Sequence[str] = ("path",)) -> DataFrame:
    """Files in a fixed order, so that caps and slots are repeatable."""
    return files.orderBy(*order)


def size_capped_subset(rows: DataFrame, order: Sequence[str], size: str, desired_size: int | None) -> DataFrame:
    """The first rows or files until `desired_size` is reached; the one that crosses it is kept.

    Without a desired size, or with 0, all rows are kept; so they are, with a warning, when there are too few.
    """
    return capped_prefix(rows, order, size, desired_size)


def round_robin_assign(rows: DataFrame, order: Sequence[str], slots: int, name: str = "slot") -> DataFrame:
    """Row i in `order` belongs to slot i modulo `slots`; slot sizes differ by at most one."""
    return ordinal(rows, order, name="__i").withColumn(name, F.pmod("__i", F.lit(slots)).cast("int")).drop("__i")


def place_slots(rows: DataFrame, slots: int, slot: str = "slot") -> DataFrame:
    """Rows of slot i in partition i, without a hash in between: one shuffle, and one task per slot.

    For slots whose rows fit a task, as those of `round_robin_assign` with enough slots; `write_slots` splits larger ones.
    """
    return rows.repartitionById(slots, F.col(slot))


def write_slots(rows: DataFrame, path: str, slot: str = "slot") -> None:
    """One folder per slot; a slot without rows has none. Large slots are written by several tasks."""
    rows.hint("rebalance", slot).write.partitionBy(slot).parquet(path)


def load_size_report(rows: DataFrame, raw: Column, final: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows, raw bytes and bytes after decoding, in total or per slot."""
    total = lambda size: F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), total(raw).alias("raw_bytes"), total(final).alias("final_bytes")
    )


# Hooks -----------------------------------------------------------------------


def import_function(dotted: str) -> Callable:
    """The function `package.module.name`."""
    module, _, name = dotted.rpartition(".")
    if not module:
        raise DatasetError(f"{dotted} is not a dotted name")
    return getattr(importlib.import_module(module), name)


def pre_load_hook(df: DataFrame, hook: str | Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Apply a DataFrame function, given as such or by dotted name, before a dataset is loaded."""
    if hook is None:
        return df
    return df.transform(import_function(hook) if isinstance(hook, str) else hook)


def batch_hook(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """Make a hook of a function over pandas batches, which Spark runs in its tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return lambda df: df.mapInPandas(run, schema)


# Loading ---------------------------------------------------------------------


def ingest_files(spark: SparkSession, paths: Sequence[str], dest: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Copy files or folders into a fresh parquet table; every path is checked before any work starts."""
    for path in paths:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"path {path} does not exist")
    spark.read.format(fmt).options(**options).load(list(paths)).write.parquet(dest)
    return spark.read.parquet(dest)


def load_dataset(
    spark: SparkSession,
    source: str,
    dest: str,
    fmt: str = "parquet",
    desired_size: int | None = None,
    hook: str | Callable[[DataFrame], DataFrame] | None = None,
    loads: str | None = None,
    **options: str,
) -> DataFrame:
    """Load the files of a directory, up to a size, into a fresh parquet table and read it back.

    Files are taken in path order by their listing; contents of the others are not read. With `loads`, one record
    (dest, desired size, files, raw bytes, final bytes) is appended there. Without a size and a record nothing is listed here.
    """
    if not path_exists(spark, source):
        raise DatasetError(f"dataset directory {source} does not exist")
    picked = _picked_files(spark, source, desired_size) if desired_size or loads else None
    data = _read_files(spark, source, picked if desired_size else None, fmt, **options)
    pre_load_hook(data, hook).write.parquet(dest)
    if loads:
        total = F.coalesce(F.sum("length"), F.lit(0))
        files, raw = picked.agg(F.count("*"), total).first()
        final = file_inventory(spark, dest).agg(total).first()[0]
        append_rows(spark, [(dest, desired_size, files, raw, final)], LOADS, loads)
    return spark.read.parquet(dest)


def _picked_files(spark: SparkSession, source: str, desired_size: int | None) -> DataFrame:
    """(path, length) of the files Spark reads for a folder, in path order up to the size.

    Those are the files in the folder itself and in its partition folders (`name=value`); names that start with `_` or `.`
    are left out. Files in other folders below belong to no dataset, whether a size is given or not.
    """
    listing = file_inventory(spark, source).select("path", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(source).getName()
    below = F.substring_index(F.col("path"), f"/{root}/", -1)
    inside = F.when(F.endswith("path", F.lit(f"/{root}")), F.lit(root)).otherwise(below)  # the source may be one file
    listing = listing.filter(inside.rlike(r"^([^/=._][^/=]*=[^/]*/)*[^/_.][^/]*$"))
    return size_capped_subset(listing, ["path"], "length", desired_size)


def _read_files(spark: SparkSession, source: str, picked: DataFrame | None, fmt: str, **options: str) -> DataFrame:
    """The folder, or some of its files with the same columns, those of its partition folders included."""
    reader = spark.read.format(fmt).options(**options)
    if picked is None:
        return reader.load(source)
    paths = [row["path"] for row in sort_files(picked).collect()]  # names of the files to read
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory():
        reader = reader.option("basePath", source)
    return reader.load(paths)


def loaded_datasets(spark: SparkSession, loads: str) -> DataFrame:
    """Records of all loads."""
    return read_rows(spark, LOADS, loads)


def clean_datasets(spark: SparkSession, loads: str) -> int:
    """Remove the tables of all recorded loads; warns when there are none. Returns how many were removed."""
    removed = 0
    for row in read_rows(spark, LOADS, loads).select("dest").distinct().collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["dest"])
        removed += int(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    if not removed:
        warnings.warn("no dataset was loaded", stacklevel=2)
    return removed


# Classes ---------------------------------------------------------------------

DatasetClass = Callable[[SparkSession, Mapping[str, str], "int | None"], DataFrame]
_CLASSES: dict[str, DatasetClass] = {}


def register_dataset(name: str) -> Callable[[DatasetClass], DatasetClass]:
    """Make a function (session, properties, desired size) -> DataFrame known under a class name."""

    def add(fn: DatasetClass) -> DatasetClass:
        _CLASSES[name] = fn
        return fn

    return add


def make_dataset(spark: SparkSession, name: str, props: Mapping[str, str], desired_size: int | None = None) -> DataFrame:
    """The dataset of a registered class, or of a function given by its dotted name."""
    return (_CLASSES[name] if name in _CLASSES else import_function(name))(spark, props, desired_size)


@register_dataset("StaticDataset")
def static_dataset(spark: SparkSession, props: Mapping[str, str], desired_size: int | None) -> DataFrame:
    """Files below `local_path` in path order up to the size, read as `format`, through `pre_load_function`."""
    source = props["local_path"]
    if not path_exists(spark, source):
        raise DatasetError(f"dataset directory {source} does not exist")
    picked = _picked_files(spark, source, desired_size) if desired_size else None
    data = _read_files(spark, source, picked, props.get("format", "text"))
    return pre_load_hook(data, props.get("pre_load_function"))


@register_dataset("DynamicDataset")
def dynamic_dataset(spark: SparkSession, props: Mapping[str, str], desired_size: int | None) -> DataFrame:
    """Generated data: the function named by `job`, or text of about the desired size from the given `words`."""
    if "job" in props:
        return import_function(props["job"])(spark, props, desired_size)
    return generate_sized_text(spark, desired_size or 1 << 20, props["words"].split(), seed=int(props.get("seed", 0)))
