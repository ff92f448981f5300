"""Experiments from their parameter file to their run records."""

import os

import pytest
from pyspark.sql import functions as F

from trialgrid.operators.grid import ParameterError
from trialgrid.operators.macros import MacroError
from trialgrid.plans.experiment import read_experiment
from trialgrid.plans.samples import pi_estimate
from trialgrid.plans.suite import engine_settings, run_suite, suite_progress, suite_runs, write_summaries
from trialgrid.session import scratch_path, shared_dir
from trialgrid.sources.runlog import DATASETS, read_rows

FILE = """[test_parameters]
test.num_repetitions = 3
test.output_path = {out}
[ds_parameters]
ds.class = StaticDataset, DynamicDataset
ds.class.local_path = {data},
ds.class.format = parquet,
ds.class.words = , alpha beta
ds.dest = ${{data_dir}}
ds.size = 1000, 2000
[xp_parameters]
xp.job = count || ${{xp.input}} ${{xp.output}} ${{unknown}}
shuffle = 4, 8
spark.sql.shuffle.partitions = ${{shuffle}}
"""


@pytest.fixture(scope="module")
def experiment(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("xp")
    path = folder / "x.ini"
    path.write_text(FILE.format(out=folder / "out", data=f"{sf_dir}/orders.parquet"))
    return read_experiment(spark, str(path))


def test_plan(spark, experiment, sf_dir):
    assert experiment.repetitions == 3
    assert experiment.classes == [
        ("StaticDataset", {"format": "parquet", "local_path": f"{sf_dir}/orders.parquet"}),
        ("DynamicDataset", {"words": "alpha beta"}),
    ]
    assert experiment.dataset == {"ds.dest": ["${data_dir}"], "ds.size": ["1000", "2000"], "ds.config": ["0", "1"]}
    assert experiment.order.index("shuffle") < experiment.order.index("spark.sql.shuffle.partitions")
    runs = suite_runs(spark, experiment)
    assert runs.count() == 8 and runs.select("ds_id").distinct().count() == 4


def test_run_resume_and_attempts(spark, experiment):
    home, calls, broken = scratch_path(spark, "suite"), [], {"on": True}

    def count(session, dataset, args, params):
        calls.append((tuple(args), session.conf.get("spark.sql.shuffle.partitions"), params["ds.dest"]))
        if broken["on"] and args[1].endswith("/out/5"):
            raise ValueError("broken")
        return dataset.agg(F.count("*").alias("n"))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    records = run_suite(spark, experiment, home, {"count": count}, max_attempts=2)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    found = records.orderBy("run_id").collect()
    # Run 5 fails, so run 6 of the same combination is not tried; everything else is done.
    assert [r["run_id"] for r in found] == [i for i in range(1, 25) if i != 6]
    assert [r["run_id"] for r in found if r["status"] != "done"] == [5]
    assert found[4]["error"] == "ValueError: broken" and found[0]["job_id"].startswith(spark.sparkContext.applicationId)
    assert calls[0][0] == ("/tests/data/1", "/tests/out/1", "${unknown}") and calls[0][2] == "/tests/data/1"
    assert {c[1] for c in calls} == {"4", "8"}
    assert suite_progress(spark, experiment, home) == {"total": 8, "done": 7, "remaining": 1}
    assert read_rows(spark, DATASETS, f"{home}/datasets").count() == 4

    calls.clear()
    run_suite(spark, experiment, home, {"count": count}, max_attempts=2)
    assert [c[0][1] for c in calls] == ["/tests/out/4", "/tests/out/5"]
    calls.clear()
    run_suite(spark, experiment, home, {"count": count}, max_attempts=2)
    assert calls == []  # both attempts are used up
    broken["on"] = False
    run_suite(spark, experiment, home, {"count": count}, max_attempts=3)
    assert len(calls) == 3 and suite_progress(spark, experiment, home)["remaining"] == 0
    outputs = spark.read.parquet(experiment.output_path)
    assert outputs.select("run_id").distinct().count() == 24

    write_summaries(spark, experiment, home, home)
    wide = spark.read.option("header", True).csv(f"{home}/summary.csv")
    assert wide.columns == ["comb_id", "job_id", *experiment.dataset, *experiment.runs]
    assert wide.select("comb_id").distinct().count() == 24
    loaded = spark.read.option("header", True).option("escape", "\\").csv(f"{home}/ds-summary.csv")
    assert loaded.count() == 4 and loaded.columns == ["ds_id", "ds_class", "ds_class_properties"]


def test_unknown_dataset_does_not_end_the_suite(spark, tmp_path, sf_dir):
    path = tmp_path / "x.ini"
    path.write_text(
        "[ds_parameters]\nds.class = missing.module.cls, StaticDataset\nds.class.local_path = x, "
        f"{sf_dir}/region.parquet\nds.class.format = parquet\n[xp_parameters]\nxp.job = rows\n"
    )
    home = scratch_path(spark, "suite")
    records = run_suite(spark, read_experiment(spark, str(path)), home, {"rows": lambda s, df, a, p: df}, load="table")
    assert sorted((r["rep"], r["status"]) for r in records.collect()) == [(0, "cancelled"), (1, "done")]
    assert spark.read.parquet(f"{home}/data/2").count() == 5


@pytest.mark.parametrize("remove,kept", [("", False), ("test.remove_output = no\n", True), ("test.remove_output = yes\n", False)])
def test_outputs_and_stats_of_a_suite(spark, tmp_path, sf_dir, remove, kept):
    path, home, out, stats = tmp_path / "x.ini", str(tmp_path / "home"), tmp_path / "out", tmp_path / "stats"
    path.write_text(
        f"[test_parameters]\ntest.output_path = {out}\ntest.stats_path = {stats}\n{remove}[ds_parameters]\nds.class = StaticDataset\n"
        f"ds.class.local_path = {sf_dir}/nation.parquet\nds.class.format = parquet\n[xp_parameters]\nxp.job = rows\nxp.n = 1, 2\n"
    )
    job = lambda s, df, a, p: df.repartition(3).limit(int(p["xp.n"]))
    run_suite(spark, read_experiment(spark, str(path)), home, {"rows": job})
    count = lambda folder: {r["run_id"]: r["count"] for r in spark.read.parquet(str(folder)).groupBy("run_id").count().collect()}
    assert count(out) == {1: 1, 2: 2}
    assert os.path.exists(f"{home}/output") == kept
    if kept:
        assert count(f"{home}/output") == {1: 1, 2: 2}
    found = spark.read.parquet(str(stats))
    assert {r["run_id"] for r in found.collect()} == {1, 2}
    assert found.agg(F.sum("completed")).first()[0] > 0 and found.agg(F.sum("failed")).first()[0] == 0


@pytest.mark.parametrize(
    "text,error",
    [
        ("[ds_parameters]\na = ${xp.b}\n[xp_parameters]\nxp.b = 1\n", MacroError),
        ("[ds_parameters]\na = 1\n[xp_parameters]\nxp.a = ${xp.b}\nxp.b = ${xp.a}\n", MacroError),
        ("[ds_parameters]\na = 1\n[xp_parameters]\na = 2\n", ParameterError),
        ("[test_parameters]\ntest.remove_output = perhaps\n[ds_parameters]\na = 1\n", ParameterError),
    ],
)
def test_wrong_files(spark, tmp_path, text, error):
    path = tmp_path / "x.ini"
    path.write_text(text)
    with pytest.raises(error):
        read_experiment(spark, str(path))


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError):
        with engine_settings(spark, {"spark.sql.shuffle.partitions": "3", "my.own": "1"}):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
            raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("my.own", None) is None


def test_pi(spark):
    assert abs(pi_estimate(spark.range(1, 200_001), "id").first()["pi"] - 3.14159) < 0.001


class Context:
    """The parts of a session that name the shared folder."""

    def __init__(self, master, configured=None):
        self.master, self.folder, self.sparkContext, self.conf = master, None, self, self
        self.configured = configured

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.configured or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    assert shared_dir(Context("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Context("spark://host:7077"))
    alone = Context("local[2]")
    assert shared_dir(alone) == shared_dir(alone) == alone.folder
