"""Sources that are narrowed by filters, slots as partitions, sketches along axes, and removal of runs in place."""

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialgrid.operators.ordinal import running
from trialgrid.plans import sweep_apply as sweep
from trialgrid.session import scratch_path
from trialgrid.sources import datasets, logs, ranges, runlog, warehouse


@pytest.fixture(scope="module")
def keys(spark):
    def batch(start, end):  # workers cannot import this module
        return pa.record_batch({"key": pa.array(range(start, end), pa.int64())})

    ranges.register_source(spark, "Keys", "key bigint", "key", batch)
    return lambda low=0, high=100, parts=7: ranges.read_source(spark, "Keys", low, high, parts)


@pytest.mark.parametrize("condition,want", [
    ("key >= 90", range(90, 100)), ("key > 90 and key < 93", range(91, 93)), ("key = 5", [5]), ("key > 200", []),
    ("key <= 3 and key % 2 = 1", [1, 3]), ("key in (4, 6)", [4, 6]), ("key is null", []), ("key >= 10 and key < 5", []),
])
def test_filters_reach_a_source(keys, condition, want):
    assert sorted(r[0] for r in keys().filter(condition).collect()) == list(want)


def test_filters_are_pushed_and_ranges_cut(spark, keys):
    made = []
    reader = ranges.RangeReader("key", lambda start, end: made.append((start, end)), 0, 100, 4)
    assert list(reader.pushFilters([ranges.GreaterThan(("key",), 49), ranges.EqualTo(("other",), 1)])) == [ranges.EqualTo(("other",), 1)]
    parts = reader.partitions()
    assert [(p.start, p.end) for p in parts] == [(50, 62), (62, 75), (75, 87), (87, 100)]
    assert ">= 90" not in keys().filter("key >= 90")._jdf.queryExecution().executedPlan().toString()  # left to the source
    assert keys(5, 5).count() == 0 and keys(0, 3, 9).count() == 3


def test_slots_are_partitions(spark):
    rows = spark.range(90).select("id", F.when(F.col("id") < 60, 2).otherwise(F.col("id") % 5).cast("int").alias("slot"))
    placed = datasets.place_slots(rows, 5).select("slot", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted(placed) == [(i, i) for i in range(5)]


ODD_IDS = ["007", "7", "", None, "it's", "a\\b", "a/b=c", "t", "%41", "null", "__HIVE_DEFAULT_PARTITION__"]


@pytest.mark.parametrize("gone", [["7"], [""], [None], ["it's", "a\\b"], ["a/b=c", "%41"], ["null", "missing"], []])
def test_dropped_runs_leave_the_others(spark, gone):
    space = f"tg_{uuid.uuid4().hex[:8]}"
    where = scratch_path(spark, "warehouse")
    warehouse.warehouse_namespace(spark, space, where)
    rows = [(one, i) for i, one in enumerate(ODD_IDS)]
    runlog.save_output(spark.createDataFrame(rows, "run_id string, v int"), f"{space}.outputs")
    before = {r["path"]: r["modified"] for r in datasets.file_inventory(spark, where).collect()}
    runlog.drop_runs(spark, f"{space}.outputs", spark.createDataFrame([(g,) for g in gone], "run_id string"))
    left = runlog.table_output(spark, f"{space}.outputs", "string")
    assert {tuple(r) for r in left.select("run_id", "v").collect()} == {row for row in rows if row[0] not in gone}
    after = {r["path"]: r["modified"] for r in datasets.file_inventory(spark, where).collect()}
    assert after.items() <= before.items() and len(before) - len(after) == sum(g in ODD_IDS for g in gone)


def test_sketches_merge_along_axes(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 10).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 900).alias("k"))
    axes = [sweep.Axis("min_a", "a", ">=", [0, 5, 9, 20]), sweep.Axis("max_b", "b", "<=", [2, 6])]
    want = {(a, b): rows.filter(f"a >= {a} and b <= {b}").select("k").distinct().count() for a in (0, 5, 9, 20) for b in (2, 6)}
    for limit in (sweep.ONE_TASK_GRID, 1):
        monkeypatch.setattr(sweep, "ONE_TASK_GRID", limit)
        found = sweep.sweep_apply(rows, axes, [sweep.Measure("n", "distinct", F.col("k"))]).collect()
        assert len(found) == 8
        for row in found:
            assert abs(row["n"] - want[row["min_a"], row["max_b"]]) <= 4 * sweep.DISTINCT_ERROR * want[row["min_a"], row["max_b"]]


def test_sketches_run_over_ranges(spark):
    rows = spark.range(40).select("id", F.lit("x").alias("g"), (F.col("id") % 25).alias("k"))
    cells = rows.groupBy("g", "id").agg(F.hll_sketch_agg("k", 12).alias("s"))
    found = running(cells, ["id"], {"s": "hll_union_agg"}, by=["g"], ranges=4).select("id", F.hll_sketch_estimate("s").alias("n"))
    assert all(abs(r["n"] - min(r["id"] + 1, 25)) <= 1 for r in found.collect()) and found.count() == 40


def test_id_plan_does_not_grow_with_lengths(spark, monkeypatch):
    files = spark.createDataFrame([("job_1_x",), ("job_12",), ("other",), (None,)], "name string")

    def scan(ids):
        return logs.job_history_scan(files, "name", spark.createDataFrame([(i,) for i in ids], "id string"))

    assert sorted(r[0] for r in scan(["job_1", "job_1_", "job_1_x", "job_1_xy", None]).collect()) == ["job_12", "job_1_x"]
    assert sorted(r[0] for r in scan([""]).collect()) == ["job_12", "job_1_x", "other"]
    lines = [len(scan(["x" * n for n in range(1, most)])._jdf.queryExecution().optimizedPlan().toString().splitlines()) for most in (3, 30)]
    assert lines[0] == lines[1]
