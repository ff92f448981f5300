"""Parameter grids: expansion, class parameters, remaining runs, batches by dataset, ids, repetitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.params import literal_array
from trialgrid.operators.joins import null_safe_join
from trialgrid.operators.ordinal import ordinal
from trialgrid.session import cut_lineage, fits_broadcast

#: A list of more values stays a table, whose rows are met by their positions; shorter ones are expanded as constants.
IN_PLACE = 10_000

DONE = "done"
CANCELLED = "cancelled"


class ParameterError(ValueError):
    """A parameter definition that cannot be used."""


def sweep_expand(
    spark: SparkSession,
    lists: Mapping[str, Sequence | DataFrame],
    limit: int | None = None,
) -> DataFrame:
    """Every combination of all value lists, one column per parameter.

    A list is a Python sequence or a one-column DataFrame; duplicates count once. The largest list stays a
    distributed table, and each of its rows is expanded by the other lists: short ones are constants, longer ones
    tables that are joined by position. With `limit`, more combinations are refused before anything is expanded.
    """
    tables, constants, total = {}, {}, 1
    for name, values in lists.items():
        if isinstance(values, DataFrame):
            tables[name] = values.toDF(name).distinct()
        else:
            constants[name] = list(dict.fromkeys(values))
    counts = {name: table.count() for name, table in tables.items()}
    counts |= {name: len(values) for name, values in constants.items()}
    for name, count in counts.items():
        total *= count
    if limit is not None and total > limit:
        raise ParameterError(f"{total} combinations are more than the limit of {limit}")
    spine = max(counts, key=lambda name: (name in tables, counts[name]))
    for name in tables:
        if name != spine and counts[name] <= IN_PLACE:
            constants[name] = [row[0] for row in tables[name].orderBy(F.col(f"`{name}`")).collect()]
    if spine in tables:
        grid = tables[spine]
        types = {name: dict(table.dtypes)[name] for name, table in tables.items()}
    else:
        grid = spark.createDataFrame([(value,) for value in constants.pop(spine)], [spine])
        types = {}
    if total >= 100_000 and counts[spine] < 10_000:
        grid = grid.repartition(F.col(f"`{spine}`"))  # few spine rows, many combinations: use all tasks for the expansion
    for name, values in constants.items():
        column = literal_array(values)
        if name in types:
            column = column.cast(f"array<{types[name]}>")
        grid = grid.withColumn(name, F.explode(column))
    for name in tables:
        if name != spine and counts[name] > IN_PLACE:
            # The product itself is asked for; positions come in blocks, so that no row expands into a very long array.
            numbered = cut_lineage(ordinal(cut_lineage(tables[name].toDF("__value")), ["__value"], name="__at"))
            starts = F.sequence(F.lit(0).cast("bigint"), F.lit(counts[name] - 1).cast("bigint"), F.lit(IN_PLACE).cast("bigint"))
            grid = grid.withColumn("__from", F.explode(starts))
            end = F.least(F.col("__from") + IN_PLACE - 1, F.lit(counts[name] - 1).cast("bigint"))
            grid = grid.withColumn("__at", F.explode(F.sequence("__from", end))).drop("__from")
            grid = grid.join(numbered, "__at").drop("__at").withColumnRenamed("__value", name)
    return grid.select(*[F.col(f"`{name}`") for name in lists])


def align_class_params(
    configs: DataFrame, classes: str, props: str, ident: Sequence[str], on_mismatch: str = "raise"
) -> DataFrame:
    """One row per configuration, class and property value.

    `classes` is an array of class names, `props` a map from property name to an array of values. A list as long
    as the class list belongs to the classes position by position and its empty entries are dropped; a list of
    one value is shared by all. Any other length raises, or is dropped with `on_mismatch="drop"`.
    Classes without any property, or with empty ones only, keep one row with a null name.
    """
    count = F.size("__classes")

    def of_class(entry: Column) -> Column:
        values = entry["value"]
        value = F.when(F.size(values) == count, F.nullif(F.get(values, F.col("idx")), F.lit(""))).when(
            F.size(values) == 1, F.get(values, F.lit(0))
        )
        if on_mismatch == "raise":
            said = F.format_string(f"property %s of {ident} has %d values for %d classes", entry["key"], F.size(values), count)
            value = F.when((F.size(values) != count) & (F.size(values) != 1), F.raise_error(said)).otherwise(value)
        return F.struct(entry["key"].alias("name"), value.alias("value"))

    keyed = configs.select(*ident, F.col(classes).alias("__classes"), F.col(props).alias("__props"))
    spread = keyed.select(*ident, "__classes", "__props", F.posexplode("__classes").alias("idx", "class"))
    given = F.filter(F.transform(F.map_entries("__props"), of_class), lambda entry: entry["value"].isNotNull())
    valued = spread.select(*ident, "idx", "class", F.explode_outer(given).alias("__entry"))
    return valued.select(*ident, "idx", "class", "__entry.name", "__entry.value")


def last_status(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest status per combination; ties in time go to the later attempt."""
    latest = F.max_by("status", F.struct("ts", "attempt"))
    return state.groupBy(*keys).agg(latest.alias("status"))


def remaining_runs(grid: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations whose latest status is not done; cancelled and unseen ones remain."""
    done = last_status(state, keys).filter(F.col("status") == DONE).select(*keys)
    return null_safe_join(grid, done, keys, "left_anti")


def progress_counts(grid: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of combinations per status: done, cancelled (to be tried again) or waiting."""
    seen = null_safe_join(grid.select(*keys), last_status(state, keys), keys, "left")
    return seen.groupBy(F.coalesce("status", F.lit("waiting")).alias("status")).agg(F.count("*").alias("n"))


def same_dataset_batch(grid: DataFrame, dataset_keys: Sequence[str], run_keys: Sequence[str]) -> DataFrame:
    """Number all batches at once: `ds_id` per distinct dataset and `comb_id` over the whole grid, from 1.

    Runs sorted by `comb_id` use one dataset after the other.
    """
    datasets = ordinal(cut_lineage(grid.select(*dataset_keys).distinct()), dataset_keys, name="ds_id")
    datasets = datasets.withColumn("ds_id", F.col("ds_id") + 1)
    numbered = ordinal(grid, [*dataset_keys, *run_keys], name="comb_id")
    numbered = numbered.withColumn("comb_id", F.col("comb_id") + 1)
    placed = null_safe_join(numbered, datasets, dataset_keys, "left", broadcast=fits_broadcast(datasets))
    return placed.select("ds_id", "comb_id", *grid.columns)


def next_in_batch(remaining: DataFrame, current: DataFrame, dataset_keys: Sequence[str]) -> DataFrame:
    """Remaining combinations that use the dataset of `current`."""
    loaded = current.select(*dataset_keys).distinct()
    return null_safe_join(remaining, loaded, dataset_keys, "left_semi")


def next_run(remaining: DataFrame, order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The first remaining combination in `order`, optionally among those that pass a filter."""
    chosen = remaining if where is None else remaining.filter(where)
    return chosen.orderBy(*order).limit(1)


def next_ids(new_rows: DataFrame, order: Sequence[str], existing: DataFrame, ident: str, name: str = "new_id") -> DataFrame:
    """Number new rows from the greatest existing id + 1, or from 1 when there is none.

    Ids that are not whole numbers are ignored.
    """
    top = existing.agg(F.coalesce(F.max(F.col(ident).try_cast("bigint")), F.lit(0)).alias("top")).first()["top"]
    numbered = ordinal(new_rows, order, name=name)
    return numbered.withColumn(name, F.col(name) + F.lit(int(top) + 1).cast("bigint"))


def repeat_runs(grid: DataFrame, repetitions: int, order: Sequence[str], name: str = "comb_id") -> DataFrame:
    """Each combination `repetitions` times, every repetition with its own id from 1."""
    numbered = ordinal(grid, order, name="__run")
    repeated = numbered.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    return repeated.select(
        (F.col("__run") * repetitions + F.col("rep")).cast("bigint").alias(name), "rep", *grid.columns
    )


def param_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names of both sides."""
    return left.union(right).distinct()


def merge_params(dataset: DataFrame, experiment: DataFrame, on_clash: str = "experiment") -> DataFrame:
    """(name, value) of both sections; on equal names the experiment wins, or `on_clash="raise"` refuses."""
    names = experiment.select("name").distinct()
    if on_clash == "raise":
        clash = dataset.join(names, "name", "left_semi").select("name").limit(1).collect()
        if clash:
            raise ParameterError(f"{clash[0][0]} is both a dataset and an experiment parameter")
    return dataset.join(names, "name", "left_anti").unionByName(experiment)


def name_difference(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct requested rows that were not found."""
    return requested.subtract(found)
