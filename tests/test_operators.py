"""Rules of grids, macros, inventories and configurations."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialgrid import session
from trialgrid.operators import confmerge, grid, inventory, macros
from trialgrid.plans import sweep_apply as sweep

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


# Grids -----------------------------------------------------------------------


def test_expand_counts_and_limit(spark):
    wide = spark.range(50).select(F.col("id").cast("string").alias("x"))
    got = grid.sweep_expand(spark, {"a": ["1", "2", "2"], "b": wide, "c.d": [True, False]})
    assert got.columns == ["a", "b", "c.d"] and got.count() == got.distinct().count() == 200
    with pytest.raises(grid.ParameterError):
        grid.sweep_expand(spark, {"a": range(1000), "b": range(1000)}, limit=10_000)
    assert grid.sweep_expand(spark, {"a": [], "b": [1]} | {"c": [2]}).count() == 0


def test_remaining_follows_the_latest_status(spark):
    runs = spark.createDataFrame([("a", None), ("a", "1"), ("b", "1"), ("c", "1")], "d string, x string")
    state = spark.createDataFrame(
        [("a", None, "done", 1, 5), ("a", "1", "done", 1, 5), ("a", "1", "cancelled", 2, 5), ("b", "1", "cancelled", 1, 1),
         ("b", "1", "done", 2, 2)],
        "d string, x string, status string, attempt int, ts int",
    )
    assert rows(grid.remaining_runs(runs, state, ["d", "x"])) == [("a", "1"), ("c", "1")]
    assert dict(rows(grid.progress_counts(runs, state, ["d", "x"]))) == {"done": 2, "cancelled": 1, "waiting": 1}


@FEW
@given(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30)))
def test_remaining_and_done_make_all(spark, every, done):
    runs = spark.createDataFrame([(i,) for i in every], "k int")
    state = spark.createDataFrame([(i, "done", 1, 1) for i in done], "k int, status string, attempt int, ts int")
    assert {r[0] for r in grid.remaining_runs(runs, state, ["k"]).collect()} == every - done


def test_class_parameters(spark):
    configs = spark.createDataFrame(
        [(1, ["A", "B"], {"path": ["x", ""], "all": ["s"]}), (2, ["C"], {})],
        "id int, classes array<string>, props map<string,array<string>>",
    )
    assert rows(grid.align_class_params(configs, "classes", "props", ["id"])) == [
        (1, 0, "A", "all", "s"),
        (1, 0, "A", "path", "x"),
        (1, 1, "B", "all", "s"),
        (2, 0, "C", None, None),
    ]
    wrong = spark.createDataFrame([(1, ["A", "B"], {"p": ["1", "2", "3"]})], configs.schema)
    with pytest.raises(PySparkException, match="property p of .* has 3 values for 2 classes"):
        grid.align_class_params(wrong, "classes", "props", ["id"]).collect()


def test_ids(spark):
    new = spark.createDataFrame([("b",), ("a",)], "k string")
    none = spark.createDataFrame([], "id string")
    some = spark.createDataFrame([("7",), ("x.hc",), ("12",)], "id string")
    assert rows(grid.next_ids(new, ["k"], none, "id")) == [("a", 1), ("b", 2)]
    assert rows(grid.next_ids(new, ["k"], some, "id")) == [("a", 13), ("b", 14)]
    reps = grid.repeat_runs(new, 3, ["k"])
    assert [r["comb_id"] for r in reps.orderBy("k", "rep").collect()] == [1, 2, 3, 4, 5, 6]


def test_batches_are_contiguous(spark):
    runs = grid.sweep_expand(spark, {"d": ["u", "v", None], "x": list(range(5))})
    numbered = grid.same_dataset_batch(runs, ["d"], ["x"]).orderBy("comb_id").collect()
    assert [r["comb_id"] for r in numbered] == list(range(1, 16))
    assert [r["ds_id"] for r in numbered] == [1] * 5 + [2] * 5 + [3] * 5


def test_experiment_wins_or_clash_raises(spark):
    left = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    right = spark.createDataFrame([("b", "3")], left.schema)
    assert rows(grid.merge_params(left, right)) == [("a", "1"), ("b", "3")]
    with pytest.raises(grid.ParameterError, match="b is both"):
        grid.merge_params(left, right, on_clash="raise")


# Sweep -----------------------------------------------------------------------

OPS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


@pytest.mark.parametrize("ops,many,seed", [((">=", "<"), 3, 1), ((">", "<="), 40, 2), (("==", ">"), 5, 3)])
def test_sweep_equals_every_pair(spark, monkeypatch, ops, many, seed):
    monkeypatch.setattr(sweep, "ONE_TASK_GRID", 100 if seed == 2 else 10_000)
    rng = random.Random(seed)
    data = [(rng.randrange(20) if rng.random() > 0.1 else None, rng.randrange(20) / 2, rng.randrange(9)) for _ in range(200)]
    df = spark.createDataFrame(data, "a int, b double, v long")
    lists = [rng.sample(range(-5, 60), many), [x / 2 for x in rng.sample(range(30), 4)]]
    axes = [sweep.Axis("p", "a", ops[0], lists[0]), sweep.Axis("q", "b", ops[1], lists[1])]
    measures = [sweep.Measure("n", "count"), sweep.Measure("s", "sum", F.col("v")), sweep.Measure("m", "min", F.col("v"))]
    want = []
    for p, q in itertools.product(*lists):
        hit = [v for a, b, v in data if a is not None and OPS[ops[0]](a, p) and OPS[ops[1]](b, q)]
        want.append((p, q, len(hit), sum(hit) if hit else None, min(hit) if hit else None))
    assert rows(sweep.sweep_apply(df, axes, measures)) == sorted(want, key=str)


def test_sweep_pushes_the_loosest_threshold(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    axes = [sweep.Axis("q", "l_quantity", ">=", [10.0, 40.0]), sweep.Axis("f", "l_returnflag", "==", ["A"])]
    got = sweep.sweep_apply(lines, axes, [sweep.Measure("n", "count")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_sweep_limits(spark):
    axes = [sweep.Axis(f"a{i}", "id", ">=", range(100)) for i in range(4)]
    with pytest.raises(grid.ParameterError, match="more than the limit"):
        sweep.sweep_apply(spark.range(3), axes, [sweep.Measure("n", "count")], limit=1_000_000)


def test_sweep_where_returns_every_combination(spark):
    combinations = [{"a": i} for i in range(1000)]
    got = sweep.sweep_apply_where(
        spark.range(10), combinations, lambda c: F.col("id") >= c["a"], [sweep.Measure("n", "count"), sweep.Measure("s", "sum", F.col("id"))]
    )
    want = {i: (max(10 - i, 0), sum(range(i, 10)) if i < 10 else None) for i in range(1000)}
    assert {r["a"]: (r["n"], r["s"]) for r in got.collect()} == want


def test_sweep_where_counts_distinct_values_without_copying_rows(spark):
    data = [(i, (i * 7) % 40 if i % 5 else None, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, v int, w double")
    combinations = [{"a": i} for i in range(0, 330, 3)]  # more than fit one number, and some without rows
    measures = [sweep.Measure("vs", "count_distinct", F.col("v")), sweep.Measure("n", "count"), sweep.Measure("ws", "count_distinct", F.col("w"))]
    got = sweep.sweep_apply_where(df, combinations, lambda c: F.col("id") >= c["a"], measures)
    assert got.columns == ["a", "vs", "n", "ws"]
    want = []
    for a in range(0, 330, 3):
        inside = [row for row in data if row[0] >= a]
        want.append((a, len({v for _, v, _ in inside if v is not None}), len(inside), len({w for *_, w in inside})))
    assert sorted(map(tuple, got.collect())) == want
    some = sweep.sweep_apply_where(df, combinations[:3], lambda c: F.col("id") >= c["a"], measures[:1])
    assert "Expand" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert [r["vs"] for r in some.orderBy("a").collect()] == [row[1] for row in want[:3]]


def test_two_long_lists(spark):
    lists = {"a": spark.range(10_500).select(F.col("id").cast("string")), "b": spark.range(10_001), "c": [1]}
    found = grid.sweep_expand(spark, lists).agg(F.count("*"), F.sum("b"), F.min(F.length("a")), F.max(F.length("a"))).first()
    assert tuple(found) == (10_500 * 10_001, 10_500 * sum(range(10_001)), 1, 5)


# Macros ----------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_levels(spark):
    got = macros.dependency_order(
        edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "b")), spark.createDataFrame([("z",)], "name string")
    )
    assert dict(rows(got)) == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("a", "a")], [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")]])
def test_cycles_raise(spark, pairs):
    with pytest.raises(macros.MacroError):
        macros.dependency_order(edges(spark, *pairs))


def test_pruning_keeps_what_is_used(spark):
    names = spark.createDataFrame([(n, n != "p") for n in (*macros.BUILTINS, "p")], "name string, builtin boolean")
    uses = edges(spark, *macros.BUILTIN_EDGES, ("xp.input", "p"))
    kept = {r[0] for r in macros.prune_unused(uses, names).collect()}
    assert kept == {"p", "xp.input", "data_dir", "data_base_dir", "ds_id"}


def test_section_order(spark):
    sections = spark.createDataFrame([("t", "test"), ("d", "ds"), ("x", "xp")], "name string, section string")
    every = edges(spark, *itertools.product("tdx", repeat=2))
    bad = rows(macros.dependency_check(every, sections).select("src", "dst"))
    assert bad == [("d", "t"), ("x", "d"), ("x", "t")]
    with pytest.raises(macros.MacroError, match="xp -> ds"):
        macros.require_section_order(edges(spark, ("x", "d")), sections)


def test_substitution_is_fresh_per_row(spark):
    runs = spark.createDataFrame([("1", "${x.a}!", "${x.b}${other}"), ("2", "v", "${x.b}")], "`x.a` string, `x.b` string, `x.c` string")
    got = macros.substitute_macros(runs, ["x.a", "x.b", "x.c"])
    assert rows(got) == [("1", "1!", "1!${other}"), ("2", "v", "v")]


# Inventories -----------------------------------------------------------------


def test_groups_and_leaders(spark):
    hosts = [(0, "h0", 4, 16), (1, "h1", 8, 16), (2, "h2", 4, 16), (3, "h3", 8, 16), (4, "h4", 2, 64)]
    df = spark.createDataFrame(hosts, "pos long, host string, cores int, mem int")
    groups = inventory.hardware_groups(df, ["mem", "cores"], "pos")
    assert [(r["cluster"], r["cores"], r["n"]) for r in groups.orderBy("first_pos").collect()] == [
        ("cluster-0", 4, 2),
        ("cluster-1", 8, 2),
        ("cluster-2", 2, 1),
    ]
    total = inventory.fleet_totals(groups, *[F.col(c) for c in ("cluster", "mem", "cores", "n", "first_pos")]).first()
    assert tuple(total) == (5, 128, 26, "cluster-2", "cluster-1", "cluster-0")


def test_rack_default_and_size_check(spark, monkeypatch):
    hosts = spark.createDataFrame([("a",), ("b",), ("b",)], "host string")
    racks = spark.createDataFrame([("a", "/r1"), ("ab", "/r2")], "host string, rack string")
    want = [("a", "/r1"), ("b", "/default-rack"), ("b", "/default-rack")]
    assert rows(inventory.rack_lookup(hosts, racks)) == want
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (1, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = inventory.rack_lookup(hosts, racks)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        assert rows(large) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Configurations --------------------------------------------------------------


def entries(spark, *rows_):
    return spark.createDataFrame(rows_, "file_rank int, pos long, name string, value string")


def test_lookup_rules(spark):
    found = entries(
        spark, (1, 0, "a", "first"), (1, 1, "a", "last"), (0, 0, "a", ""), (0, 1, "a", "late"), (2, 0, "b", None), (3, 0, "b", "x")
    )
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    # One name: only the first entry of a file counts. Many names: the last one does.
    assert rows(confmerge.config_lookup(found, names, "dflt")) == [("a", "first"), ("b", "x"), ("c", "dflt")]
    assert rows(confmerge.config_lookup_many(found, names)) == [("a", "late"), ("b", "x")]


FLAGS = list(itertools.product([True, False], repeat=2))


@pytest.mark.parametrize("create,replace", FLAGS)
def test_upsert_flags(spark, create, replace):
    base = spark.createDataFrame([("there", "1"), ("empty", ""), ("null", None)], "name string, value string")
    names = [(n, "2", create, replace) for n in ("there", "empty", "null", "new")]
    updates = spark.createDataFrame(names, "name string, value string, create_if_absent boolean, replace_if_present boolean")
    got = {r["name"]: (r["value"], r["changed"]) for r in confmerge.config_upsert(base, updates).collect()}
    want = {"there": ("2", True) if replace else ("1", False)}
    want |= {"empty": ("2", True), "null": ("2", True), "new": ("2", True)} if create else {"empty": ("", False), "null": (None, False)}
    assert got == want


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "")], "name string, value string")
    updates = spark.createDataFrame(
        [("a", "2", False, True), ("b", "3", True, False), ("c", "4", True, True)],
        "name string, value string, create_if_absent boolean, replace_if_present boolean",
    )
    once = confmerge.config_upsert(base, updates).drop("changed")
    assert rows(confmerge.config_upsert(once, updates).drop("changed")) == rows(once) == [("a", "2"), ("b", "3"), ("c", "4")]


def test_change_finds_the_file(spark):
    found = entries(spark, (0, 0, "a", ""), (1, 0, "a", "x"), (2, 0, "a", "y"), (2, 1, "a", "dup"))
    params = spark.createDataFrame([("a", "new"), ("b", "made")], "name string, value string")
    got = rows(confmerge.config_change(found, params, default_rank=5))
    assert got == [(0, "a", "", False), (1, "a", "new", True), (2, "a", "y", False), (5, "b", "made", True)]
    aimed = rows(confmerge.config_change(found, params, default_rank=5, target_rank=2).filter("changed"))
    assert aimed == [(2, "a", "new", True), (2, "b", "made", True)]


def test_overlay_and_missing(spark):
    local = spark.createDataFrame([("a", "l")], "name string, value string")
    base = spark.createDataFrame([("a", "b"), ("b", "b")], local.schema)
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert rows(confmerge.config_overlay(local, base, ["name"])) == [("a", "l"), ("b", "b")]
    assert rows(confmerge.missing_mandatory(wanted, local, base, ["name"])) == [("c",)]
