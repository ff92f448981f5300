"""An experiment read from its parameter file: options, dataset classes, value lists and macro order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.params import FALSE_WORDS, class_property, is_true, split_trim_list
from trialgrid.operators.grid import ParameterError, align_class_params
from trialgrid.operators.macros import (
    BUILTIN_EDGES,
    BUILTINS,
    dependency_order,
    extract_macros,
    prune_unused,
    require_section_order,
)
from trialgrid.sources.conffiles import config_scan_ini, param_values

# Sections and options of a parameter file.
TEST_SECTION, DATASET_SECTION, RUN_SECTION = "test_parameters", "ds_parameters", "xp_parameters"
CLASS_OPTION, CONFIG_PARAMETER, DEST_PARAMETER = "ds.class", "ds.config", "ds.dest"
DEFAULT_DEST = "${data_dir}"


@dataclass(frozen=True)
class Experiment:
    """Value lists are kept as text; `order` resolves every macro before it is used."""

    options: Mapping[str, str]
    classes: Sequence[tuple[str, Mapping[str, str]]]
    dataset: Mapping[str, Sequence[str]]
    runs: Mapping[str, Sequence[str]]
    order: Sequence[str]
    uses: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def repetitions(self) -> int:
        return int(self.options.get("test.num_repetitions", 1))

    @property
    def output_path(self) -> str | None:
        return self.options.get("test.output_path")

    @property
    def stats_path(self) -> str | None:
        return self.options.get("test.stats_path")

    @property
    def remove_output(self) -> bool:
        """Whether a run keeps no output of its own; a copy in `output_path` stays either way."""
        return self.options.get("test.remove_output", "true").strip().lower() not in FALSE_WORDS


def _order_macros(spark: SparkSession, values: DataFrame) -> tuple[list[str], dict[str, list[str]]]:
    """Check the sections, drop built-ins nothing uses and sort the parameters by dependency."""
    uses = extract_macros(values, "name", "value").distinct()
    sections = values.select("name", F.when(F.col("section") == RUN_SECTION, "xp").otherwise("ds").alias("section"))
    builtin = spark.createDataFrame([(name, "test") for name in BUILTINS], "name string, section string")
    sections = sections.unionByName(builtin).distinct()
    every = uses.unionByName(spark.createDataFrame(list(BUILTIN_EDGES), "src string, dst string"))
    require_section_order(every, sections)
    names = sections.select("name", (F.col("section") == "test").alias("builtin"))
    kept = prune_unused(every, names)
    # Macros that are defined nowhere stay as text and order nothing.
    known = every.join(kept.withColumnRenamed("name", "src"), "src", "left_semi")
    known = known.join(kept.withColumnRenamed("name", "dst"), "dst", "left_semi")
    levels = dependency_order(known, kept).join(sections.filter("section <> 'test'"), "name")
    order = [row["name"] for row in levels.orderBy("section", "level", "name").collect()]
    used: dict[str, list[str]] = {}
    for row in known.select("src", "dst").orderBy("dst", "src").collect():
        used.setdefault(row["dst"], []).append(row["src"])
    return order, used


def plan_experiment(spark: SparkSession, options: DataFrame) -> Experiment:
    """Build an experiment from (section, name, value) options."""
    found = options.select("section", "name", "value").collect()  # the definition of one experiment, not data
    options = spark.createDataFrame(found, "section string, name string, value string")

    tests = options.filter(F.col("section") == TEST_SECTION)
    wrong = tests.filter(F.col("name").isin("test.remove_output") & is_true(F.col("value")).isNull()).collect()
    if wrong:
        raise ParameterError(f"{wrong[0]['name']} is no boolean: {wrong[0]['value']}")
    test_options = {row["name"]: row["value"] for row in tests.collect()}

    in_dataset = F.col("section") == DATASET_SECTION
    is_class = in_dataset & ((F.col("name") == CLASS_OPTION) | class_property(F.col("name")).isNotNull())
    classes = _classes(options.filter(is_class))
    lists = options.filter(~is_class & F.col("section").isin(DATASET_SECTION, RUN_SECTION))
    values = param_values(lists)
    dataset: dict[str, list[str]] = {}
    runs: dict[str, list[str]] = {}
    for row in values.orderBy("section", "name", "ordinal").collect():
        (dataset if row["section"] == DATASET_SECTION else runs).setdefault(row["name"], []).append(row["value"])
    clash = sorted(set(dataset) & set(runs))
    if clash:
        raise ParameterError(f"{clash[0]} is both a dataset and an experiment parameter")
    extra = []
    if DEST_PARAMETER not in dataset:
        dataset[DEST_PARAMETER] = [DEFAULT_DEST]
        extra.append((DATASET_SECTION, DEST_PARAMETER, 0, DEFAULT_DEST))
    dataset[CONFIG_PARAMETER] = [str(i) for i in range(len(classes))]
    extra += [(DATASET_SECTION, CONFIG_PARAMETER, i, str(i)) for i in range(len(classes))]
    if extra:
        more = spark.createDataFrame(extra, "section string, name string, ordinal int, value string")
        values = values.unionByName(more)
    order, uses = _order_macros(spark, values.select("section", "name", "value"))
    return Experiment(test_options, classes, dataset, runs, order, uses)


def _classes(options: DataFrame) -> list[tuple[str, dict[str, str]]]:
    """Dataset classes with their properties, position by position."""
    entries = split_trim_list(F.col("value"))
    prop = F.when(F.col("name") != CLASS_OPTION, F.struct(class_property(F.col("name")).alias("name"), entries.alias("list")))
    config = options.agg(
        F.max(F.when(F.col("name") == CLASS_OPTION, entries)).alias("classes"),
        F.map_from_entries(F.collect_list(prop)).alias("props"),
    )
    config = config.select(F.lit(0).alias("id"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), "props")
    aligned = align_class_params(config, "classes", "props", ["id"])
    result: dict[int, tuple[str, dict[str, str]]] = {}
    for row in aligned.orderBy("idx", "name").collect():
        props = result.setdefault(row["idx"], (row["class"], {}))[1]
        if row["name"] is not None:
            props[row["name"]] = row["value"]
    # A class all of whose properties are empty has no row here.
    names = config.select(F.explode("classes")).collect()
    return [result.get(i, (row[0], {})) for i, row in enumerate(names)]


def read_experiment(spark: SparkSession, path: str) -> Experiment:
    """Build an experiment from a parameter file."""
    return plan_experiment(spark, config_scan_ini(spark, path))
