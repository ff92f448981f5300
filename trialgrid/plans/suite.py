"""A suite of experiments run one by one, with records, repetitions and resume.

Every run is a Spark query of its own under its own settings, so the runs follow each other on the driver; the
data stays in Spark. For a grid of thresholds over one table, `sweep_apply` does the same in one job.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.params import split_job_spec
from trialgrid.functions.text import UNKNOWN_JOB
from trialgrid.operators.grid import CANCELLED, DONE, ParameterError, progress_counts, remaining_runs, same_dataset_batch, sweep_expand
from trialgrid.operators.macros import run_builtins, substitute_macros
from trialgrid.plans.experiment import CONFIG_PARAMETER, Experiment
from trialgrid.sources.datasets import import_function, make_dataset
from trialgrid.sources.runlog import (
    DATASETS,
    RUNS,
    STATS,
    append_rows,
    dataset_summary,
    read_rows,
    run_params,
    run_summary,
    write_csv,
)

# Parameters with a meaning of their own.
JOB_PARAMETER, SIZE_PARAMETER, ENGINE_PREFIX = "xp.job", "ds.size", "xp."
# Default names of the summaries.
SUMMARY, DATASET_SUMMARY = "summary.csv", "ds-summary.csv"

#: A job: (session, loaded dataset, arguments, resolved parameters) -> output.
Job = Callable[[SparkSession, DataFrame, list[str], Mapping[str, str]], DataFrame]


@contextmanager
def engine_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Set runtime settings for a block and put the earlier ones back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def suite_runs(spark: SparkSession, experiment: Experiment) -> DataFrame:
    """The whole grid: comb_key, ds_id, comb_id and one column per parameter, in batches of equal datasets."""
    lists = {**experiment.dataset, **experiment.runs}
    grid = sweep_expand(spark, lists)
    # Parameter names hold dots, so they travel in quoted form.
    short = {name: f"p{i}" for i, name in enumerate(lists)}
    plain = grid.toDF(*[short[name] for name in grid.columns])
    numbered = same_dataset_batch(
        plain, [short[name] for name in experiment.dataset], [short[name] for name in experiment.runs]
    )
    named = numbered.toDF("ds_id", "comb_id", *grid.columns)
    key = F.to_json(F.struct(*[F.col(f"`{name}`") for name in sorted(lists)]))
    return named.select(key.alias("comb_key"), "*")


def resolve_runs(experiment: Experiment, runs: DataFrame) -> DataFrame:
    """One row per repetition with its run id, all macros resolved for it, and its job split into parts."""
    reps = experiment.repetitions
    repeated = runs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    run_id = ((F.col("comb_id") - 1) * reps + F.col("rep")).cast("bigint")
    repeated = repeated.withColumn("run_id", run_id)
    builtins = run_builtins(F.col("ds_id"), F.col("run_id"))
    resolved = substitute_macros(repeated, experiment.order, builtins, experiment.uses)
    return resolved.withColumn("job", split_job_spec(F.col(f"`{JOB_PARAMETER}`")))


def suite_state(records: DataFrame, repetitions: int) -> DataFrame:
    """State per combination and attempt from its run records: done if all repetitions are."""
    complete = F.count_if(F.col("status") == DONE) >= repetitions
    status = F.when(complete, F.lit(DONE)).otherwise(F.lit(CANCELLED))
    return records.groupBy("comb_key", "attempt").agg(status.alias("status"), F.max("ts").alias("ts"))


def run_suite(
    spark: SparkSession,
    experiment: Experiment,
    home: str,
    jobs: Mapping[str, Job] | None = None,
    load: str = "direct",
    max_attempts: int = 3,
) -> DataFrame:
    """Run what remains of an experiment and return its run records.

    `home` holds the tables `runs` and `datasets`, and with `load="table"` the loaded data. Outputs are copied to the
    experiment's `test.output_path`, and stay in `output` below `home` unless `test.remove_output` is set, which is the
    default. The stages of every run, with their tasks, are recorded in the table `test.stats_path`. A failing combination is recorded as cancelled and the suite goes on; a later
    call tries it again until `max_attempts`. With `load="direct"` each run scans the dataset itself, so that it
    reads only the columns it needs; `load="table"` writes the dataset once per batch.
    """
    if JOB_PARAMETER not in experiment.runs:
        raise ParameterError(f"{JOB_PARAMETER} should be specified")
    runs = suite_runs(spark, experiment)
    state = suite_state(read_rows(spark, RUNS, f"{home}/runs"), experiment.repetitions)
    tried = state.groupBy("comb_key").agg(F.max("attempt").alias("attempts"))
    todo = remaining_runs(runs, state, ["comb_key"]).join(tried, "comb_key", "left")
    todo = todo.withColumn("attempts", F.coalesce("attempts", F.lit(0))).filter(F.col("attempts") < max_attempts)
    # Each run is a job of its own, so the driver has to know them; all repetitions are resolved in one job.
    combinations: dict[str, list[Row]] = {}
    for run in resolve_runs(experiment, todo).orderBy("run_id").collect():
        combinations.setdefault(run["comb_key"], []).append(run)
    batch, dataset = None, None
    for key, repetitions in combinations.items():
        first = repetitions[0]
        attempt = first["attempts"] + 1
        records, stats = [], []
        if batch != first["ds_id"]:
            try:
                batch, dataset = None, _load(spark, experiment, first, home, load)
                batch = first["ds_id"]
            except Exception as failure:  # a dataset that cannot be loaded must not end the suite
                records.append((None, key, UNKNOWN_JOB, {}, 0, CANCELLED, attempt, _reason(failure), _now()))
        for run in repetitions if batch is not None else ():
            job_id, error, stages = _run(spark, experiment, run, dataset, jobs or {}, home)
            stats += stages
            params = {name: run[name] for name in [*experiment.dataset, *experiment.runs]}
            status = CANCELLED if error else DONE
            records.append((run["run_id"], key, job_id, params, run["rep"], status, attempt, error, _now()))
            if error:
                break
        append_rows(spark, records, RUNS, f"{home}/runs")
        if experiment.stats_path and stats:
            append_rows(spark, stats, STATS, experiment.stats_path)
    return read_rows(spark, RUNS, f"{home}/runs")


def suite_progress(spark: SparkSession, experiment: Experiment, home: str) -> dict[str, int]:
    """Combinations in all and done so far."""
    state = suite_state(read_rows(spark, RUNS, f"{home}/runs"), experiment.repetitions)
    # Only combinations of the grid count: a done one may have left it since.
    counts = dict(progress_counts(suite_runs(spark, experiment), state, ["comb_key"]).collect())  # a row per status
    total = sum(counts.values())
    return {"total": total, "done": counts.get(DONE, 0), "remaining": total - counts.get(DONE, 0)}


def write_summaries(spark: SparkSession, experiment: Experiment, home: str, dest: str) -> None:
    """Write both summaries as CSV with a header: one wide row per finished run, one row per loaded dataset.

    They go below `dest` under the names of `test.summary_file` and `test.ds_summary_file`.
    """
    done = read_rows(spark, RUNS, f"{home}/runs").filter(F.col("status") == DONE)
    names = [*experiment.dataset, *experiment.runs]
    wide = run_summary(run_params(done.withColumnRenamed("run_id", "comb_id"), "comb_id"), ["comb_id", "job_id"], names)
    loaded = dataset_summary(read_rows(spark, DATASETS, f"{home}/datasets")).distinct()
    for table, option, default in ((wide, "test.summary_file", SUMMARY), (loaded, "test.ds_summary_file", DATASET_SUMMARY)):
        write_csv(table.hint("rebalance"), f"{dest}/{experiment.options.get(option, default)}")


def _reason(failure: Exception) -> str:
    lines = f"{type(failure).__name__}: {failure}".splitlines()
    return lines[0]


def _now() -> datetime.datetime:
    return datetime.datetime.now()


def _load(spark: SparkSession, experiment: Experiment, run: Row, home: str, load: str) -> DataFrame:
    name, props = experiment.classes[int(run[CONFIG_PARAMETER])]
    # Class properties may use dataset parameters and built-ins as macros.
    known = {"ds_id": str(run["ds_id"]), **{n: run[n] for n in experiment.dataset}}
    resolved = {}
    for prop, value in props.items():
        for macro, text in known.items():
            value = value.replace("${" + macro + "}", text)
        resolved[prop] = value
    size = run[SIZE_PARAMETER] if SIZE_PARAMETER in experiment.dataset else None
    dataset = make_dataset(spark, name, resolved, int(size) if size else None)
    if load == "table":
        dest = f"{home}/data/{run['ds_id']}"
        dataset.write.mode("overwrite").parquet(dest)
        dataset = spark.read.schema(dataset.schema).parquet(dest)
    append_rows(spark, [(run["ds_id"], name, resolved)], DATASETS, f"{home}/datasets")
    return dataset


def _run(
    spark: SparkSession, experiment: Experiment, run: Row, dataset: DataFrame, jobs: Mapping[str, Job], home: str
) -> tuple[str, str | None, list[tuple]]:
    """Run one job under its settings -> (job id, error text, its stages)."""
    context = spark.sparkContext
    group = f"run-{run['run_id']}"
    settings = {name: run[name] for name in experiment.runs if not name.startswith(ENGINE_PREFIX)}
    params = {name: run[name] for name in [*experiment.dataset, *experiment.runs]}
    error = None
    context.setJobGroup(group, json.dumps(params))
    # Jobs of an earlier call in the same session belong to the same group.
    before = set(context.statusTracker().getJobIdsForGroup(group))
    try:
        with engine_settings(spark, settings):
            path, arguments = run["job"]["path"], run["job"]["params"]
            job = jobs[path] if path in jobs else import_function(path)
            output = job(spark, dataset, (arguments or "").split(), params)
            _keep(spark, experiment, output, f"run_id={run['run_id']}", home)
    except Exception as failure:  # a failing job must not end the suite
        error = _reason(failure)
    finally:
        started = sorted(set(context.statusTracker().getJobIdsForGroup(group)) - before)
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    job_id = f"{context.applicationId}_{started[0]}" if started else UNKNOWN_JOB
    return job_id, error, _stages(spark, run["run_id"], started) if experiment.stats_path else []


def _keep(spark: SparkSession, experiment: Experiment, output: DataFrame, name: str, home: str) -> None:
    """Compute an output once and write it wherever it is to stay."""
    folders = [experiment.output_path, None if experiment.remove_output else f"{home}/output"]
    paths = [f"{folder}/{name}" for folder in folders if folder]
    if not paths:
        output.write.format("noop").mode("overwrite").save()
    for path in paths:
        output.write.mode("overwrite").parquet(path)
        output = spark.read.schema(output.schema).parquet(path)


def _stages(spark: SparkSession, run_id: int, jobs: list[int]) -> list[tuple]:
    """One record per stage that ran, as far as Spark still remembers it."""
    context = spark.sparkContext
    tracker, found = context.statusTracker(), []
    for job in jobs:
        info = tracker.getJobInfo(job)
        for number in sorted(info.stageIds) if info else ():
            stage = tracker.getStageInfo(number)
            if stage:
                job_id = f"{context.applicationId}_{job}"
                found.append((run_id, job_id, number, stage.name, stage.numTasks, stage.numCompletedTasks, stage.numFailedTasks))
    return found
