"""Cases in which rows or values once were lost."""

import pytest
from pyspark.sql import functions as F

from trialgrid.functions.params import replace_macros_from_map
from trialgrid.session import scratch_path
from trialgrid.sources import datasets, logs, runlog, warehouse


def outputs(spark):
    rows = [("007", 1), ("7", 2), (None, 3), ("a", 4), ("007", 5)]
    path = scratch_path(spark, "outputs")
    runlog.export_output(spark.createDataFrame(rows, "run_id string, v int"), path)
    return path


@pytest.mark.parametrize("runs,want", [(["007"], {1, 5}), (["7"], {2}), ([None, "a"], {3, 4}), (["x"], set())])
def test_fetch_by_text_ids(spark, runs, want):
    path = outputs(spark)
    assert {r["v"] for r in runlog.fetch_output(spark, path, runs, kind="string").collect()} == want
    table = spark.createDataFrame([(r,) for r in runs], "run_id string")
    assert {r["v"] for r in runlog.fetch_output(spark, path, table).collect()} == want


@pytest.mark.parametrize("runs,left", [(["7"], {1, 3, 4, 5}), ([None], {1, 2, 4, 5}), (["007", None], {2, 4}), ([], {1, 2, 3, 4, 5})])
def test_drop_keeps_the_rest(spark, runs, left):
    dropped = spark.createDataFrame([(r,) for r in runs], "run_id string")
    kept = runlog.drop_output(spark, outputs(spark), dropped, scratch_path(spark, "kept"))
    assert {r["v"] for r in kept.collect()} == left and dict(kept.dtypes)["run_id"] == "string"


def test_summary_refuses_or_derives_names(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "run_id int, name string, value string")
    assert runlog.run_summary(rows, ["run_id"]).collect() == [(1, "x", "y")]
    with pytest.raises(ValueError, match="b is not among"):
        runlog.run_summary(rows, ["run_id"], ["a"])


def test_null_macro_values(spark):
    df = spark.createDataFrame([("${a} ${b}", {"a": "1", "b": None}), ("${a}", None)], "t string, m map<string,string>")
    assert [r[0] for r in df.select(replace_macros_from_map(F.col("t"), F.col("m"))).collect()] == ["1 ${b}", "${a}"]


def test_job_lists_of_any_length(spark):
    files = spark.createDataFrame([("job_1_x",), ("job_2",), ("other",)], "name string")
    scan = lambda ids: sorted(r[0] for r in logs.job_history_scan(files, "name", ids).collect())
    assert scan([]) == scan(None) == ["job_1_x", "job_2"]
    assert scan([f"job_{i}_" for i in range(1, 500)]) == ["job_1_x"]


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("held")
    got = warehouse.warehouse_sql(spark, "select count(*) n from held join fresh using (id)", {"held": spark.range(9), "fresh": spark.range(5)})
    assert got.first()["n"] == 5 and spark.table("held").count() == 3
    assert not any(t.name == "fresh" for t in spark.catalog.listTables())


def test_a_size_above_all_data_changes_nothing(spark):
    source = scratch_path(spark, "partitioned")
    spark.range(20).select("id", (F.col("id") % 3).alias("p")).write.partitionBy("p").parquet(source)
    spark.range(5).write.parquet(f"{source}/_other")
    whole = datasets.load_dataset(spark, source, scratch_path(spark, "whole"))
    with pytest.warns(UserWarning, match="does not fill up"):
        capped = datasets.load_dataset(spark, source, scratch_path(spark, "capped"), desired_size=1 << 40)
    assert whole.columns == capped.columns == ["id", "p"]
    assert sorted(whole.collect()) == sorted(capped.collect()) and whole.count() == 20


def test_points_stay_exact_at_large_indices(spark):
    from fractions import Fraction

    from trialgrid.plans import samples

    indices = [0, 1, 10**6, 10**13 + 7, 2**53 + 1, 2**62 + 12345]
    df = spark.createDataFrame([(i,) for i in indices], "i long")
    for i, r in zip(indices, samples.pi_points(df, "i").collect()):
        assert (r["x"], r["y"]) == tuple(float(Fraction(s) * i % 1) for s in (samples.STEP_X, samples.STEP_Y))


def test_a_class_with_empty_properties_stays(spark):
    from trialgrid.operators.grid import align_class_params

    df = spark.createDataFrame([(1, ["A", "B"], {"p": ["x", ""], "q": ["y", ""]})], "id int, c array<string>, p map<string,array<string>>")
    got = {(r["idx"], r["class"], r["name"], r["value"]) for r in align_class_params(df, "c", "p", ["id"]).collect()}
    assert got == {(0, "A", "p", "x"), (0, "A", "q", "y"), (1, "B", None, None)}


def test_the_plan_of_levels_does_not_grow_with_depth(spark):
    from trialgrid.operators.macros import dependency_order

    plans = []
    for depth in (3, 9):
        edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(depth)], "src string, dst string")
        levels = dependency_order(edges)
        assert {r["name"]: r["level"] for r in levels.collect()} == {f"n{i}": i for i in range(depth + 1)}
        plans.append(len(levels._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 50


IDS = ["", None, "007", "7", "t", " a=b/c "]


def test_empty_text_is_no_null(spark):
    path = scratch_path(spark, "outputs")
    runlog.export_output(spark.createDataFrame(list(zip(IDS, range(6))), "run_id string, v int"), path)
    for i, one in enumerate(IDS):
        assert runlog.fetch_output(spark, path, [one], kind="string").collect() == [(i, one)]
        gone = spark.createDataFrame([(one,)], "run_id string")
        left = runlog.drop_output(spark, path, gone, scratch_path(spark, "left"))
        assert {(r["run_id"], r["v"]) for r in left.collect()} == {(x, j) for j, x in enumerate(IDS) if j != i}


def test_prune_plan_does_not_grow_with_depth(spark):
    from trialgrid.operators.macros import prune_unused

    sizes = []
    for depth in (2, 12):
        names = spark.createDataFrame([("n0", False), ("lost", True)] + [(f"n{i}", True) for i in range(1, depth + 1)], "name string, builtin boolean")
        edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(depth)] + [("lost", "nowhere")], "src string, dst string")
        kept = prune_unused(edges, names)
        assert {r["name"] for r in kept.collect()} == {f"n{i}" for i in range(depth + 1)}
        sizes.append(len(kept._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_cap_among_rows_of_one_key_ends(spark, monkeypatch):
    from trialgrid.operators import ordinal

    monkeypatch.setattr(ordinal, "CROSSING_ROWS", 10)
    df = spark.range(100).select(F.lit(1).alias("k"), F.lit(5).cast("bigint").alias("size"))
    assert ordinal.capped_prefix(df, ["k"], "size", 50, ranges=4).count() == 100


def test_ini_values_cross_splits(spark):
    from trialgrid.sources import conffiles

    told = [(0, 0, "[a]"), (0, 1, "x = 1"), (9, 7, "  more"), (18, 2, "  still"), (18, 3, "y = 2"), (27, 0, "[b]"), (27, 1, "z = 3")]
    lines = spark.createDataFrame([(f, *row) for f in ("f", "g") for row in told], "file string, block_start long, row long, line string")
    got = {(r["file"], r["section"], r["name"], r["value"]) for r in conffiles.ini_entries(lines.repartition(5)).collect()}
    want = {("a", "x", "1\nmore\nstill"), ("a", "y", "2"), ("b", "z", "3")}
    assert got == {(f, *one) for f in ("f", "g") for one in want}
