import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.operators import ordinal as o
from trialgrid.session import cut_lineage


def table(spark, n, groups, seed):
    rng = random.Random(seed)
    rows = [(i, "g%d" % min(rng.randrange(groups * 2), groups - 1), rng.randrange(50)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, grp string, size long")


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


@pytest.mark.parametrize("n,ranges,seed", [(0, 4, 1), (1, 3, 2), (37, 5, 3), (500, 16, 4), (500, 1, 5), (9, 64, 6)])
def test_ordinal_and_sum_equal_plain_window(spark, n, ranges, seed):
    df = table(spark, n, 3, seed)
    w = Window.orderBy("id")
    got = o.exclusive_sum(o.ordinal(df, ["id"], ranges=ranges), ["id"], "size", ranges=ranges)
    want = df.withColumn("ordinal", F.row_number().over(w).cast("long") - 1).withColumn(
        "size_before",
        F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
    )
    same(got, want)


def test_grouped_positions_split_a_hot_group(spark):
    df = table(spark, 400, 3, 7)  # the last group holds half of the rows
    w = Window.partitionBy("grp").orderBy("id")
    got = o.ordinal(df, ["id"], by=["grp"], ranges=12)
    same(got, df.withColumn("ordinal", F.row_number().over(w).cast("long") - 1))
    cut = o.cut_ranges(df, ["grp", "id"], 12)
    assert cut.filter("grp = 'g2'").select("__range").distinct().count() > 3


def test_null_and_string_keys(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("é", 4), ("Z", 5)], "k string, v long")
    got = {r["k"]: r["ordinal"] for r in o.ordinal(df, ["k"], ranges=3).collect()}
    assert got == {None: 0, "Z": 1, "a": 2, "b": 3, "é": 4}


def test_carry_forward_crosses_ranges(spark):
    rows = [(f, i, "s%d" % i if i % 40 == 0 and i else None) for f in ("x", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "file string, line long, header string")
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("carried", F.last("header", ignorenulls=True).over(w))
    same(o.carry_forward(df, ["line"], {"carried": "header"}, by=["file"], ranges=20), want)


def test_cap_rules(spark):
    df = spark.createDataFrame([("a", 40), ("b", 40), ("c", 40)], "path string, length long")
    keep = lambda cap: o.capped_prefix(df, ["path"], "length", cap).count()
    assert [keep(c) for c in (80, 81, 0, None, 120, 1)] == [2, 3, 3, 3, 3, 1]
    with pytest.warns(UserWarning, match="real size = 120"):
        assert keep(500) == 3
    with pytest.warns(UserWarning, match="real size = 120"):
        assert o.capped_prefix(df, ["path"], "length", 121, ranges=3).count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_cap_equals_plain_window(spark, seed, monkeypatch):
    monkeypatch.setattr(o, "CROSSING_ROWS", 30)
    monkeypatch.setattr(o, "ONE_TASK_ROWS", 25)
    df = table(spark, 300, 3, seed)
    cap = random.Random(seed).randrange(1, 8000)
    before = F.coalesce(F.sum("size").over(Window.orderBy("grp", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same(o.capped_prefix(df, ["grp", "id"], "size", cap), df.withColumn("b", before).filter(F.col("b") < cap).drop("b"))


def test_no_task_sees_all_rows(spark):
    df = spark.range(5000).withColumn("size", F.lit(1))
    text = o.ordinal(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    # The only single-partition exchange carries one total per range.
    assert text.count("SinglePartition") <= 1
    assert "SinglePartition" not in text.split("BroadcastExchange")[0]
    capped = o.capped_prefix(df, ["id"], "size", 2500)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and capped.count() == 2500


def test_running_aggregates(spark):
    df = table(spark, 200, 3, 9).withColumn("low", F.when(F.col("id") % 7 == 0, F.col("size"))).withColumn("high", F.col("low"))
    w = Window.partitionBy("grp").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", "grp", F.sum("size").over(w), F.min("low").over(w), F.max("high").over(w))
    got = o.running(df, ["id"], {"size": "sum", "low": "min", "high": "max"}, by=["grp"], ranges=9)
    same(got, want)


def test_more_ranges_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(o, "ROWS_PER_RANGE", 100)
    ranged = o.cut_ranges(spark.range(6000), ["id"])
    assert 50 <= ranged.select("__range").distinct().count() <= 60


def test_five_thousand_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"), F.lit(1).alias("size"))
    got = o.ordinal(df, ["id"], ranges=5000).agg(F.sum((F.col("ordinal") != F.col("id")).cast("int")), F.count("*")).first()
    assert tuple(got) == (0, 20_000)


def test_wide_keys(spark):
    df = spark.range(300).select(F.concat(F.repeat(F.lit("x"), 20_000), F.format_string("%05d", "id")).alias("k"), "id")
    got = o.ordinal(df, ["k"], ranges=40).filter(F.col("ordinal") != F.col("id"))
    assert got.count() == 0


@pytest.mark.parametrize("cap", [1, 999, 1000, 7013, 14_000, 20_000, 39_999])
def test_cap_with_microsecond_keys(spark, cap):
    df = cut_lineage(
        spark.range(40_000).select(F.timestamp_micros(1_700_000_000_000_000 + F.col("id") % 5000).alias("ts"), "id", F.lit(1).alias("size"))
    )
    kept = o.capped_prefix(df, ["ts", "id"], "size", cap, ranges=32)
    before = F.row_number().over(Window.orderBy("ts", "id")) - 1
    want = df.withColumn("b", before).filter(F.col("b") < cap).drop("b")
    assert kept.count() == cap and kept.subtract(want).count() == 0


def test_a_hot_null_group_is_split(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.lit("g")).alias("grp"), "id")
    w = Window.partitionBy("grp").orderBy("id")
    same(o.ordinal(df, ["id"], by=["grp"], ranges=10), df.withColumn("ordinal", F.row_number().over(w).cast("long") - 1))
    cut = o.cut_ranges(df, ["grp", "id"], 10)
    assert cut.filter("grp is null").select("__range").distinct().count() > 2


@pytest.mark.parametrize("cap", [1, 60, 199, 200, 201, 350, 599, 600, 700])
def test_cap_with_null_keys(spark, monkeypatch, cap):
    monkeypatch.setattr(o, "CROSSING_ROWS", 20)
    monkeypatch.setattr(o, "ONE_TASK_ROWS", 10)
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.lit("g")).alias("grp"), "id", F.lit(1).alias("size"))
    kept = o.capped_prefix(df, ["grp", "id"], "size", cap)
    assert kept.count() == min(cap, 600)
    assert kept.filter("grp is null").count() == min(cap, 200)


@pytest.mark.parametrize(
    "key",
    [
        "timestamp_micros(id * 333333)",
        "if(id = 7, double('NaN'), if(id = 9, double('-Infinity'), id / 7.0D))",
        "cast(id / 3 as decimal(20,6))",
        "date_add(date'2020-02-27', cast(id as int))",
        "cast(concat('k\"\\\\', chr(cast(id % 90 as int)), id) as binary)",
        "concat('\\n', uuid(), 'é')",
        "if(id % 2 = 0, id, -id)",
    ],
)
def test_key_types(spark, key):
    df = cut_lineage(spark.range(300).select(F.expr(key).alias("k"), "id"))
    want = df.withColumn("ordinal", F.row_number().over(Window.orderBy("k", "id")).cast("long") - 1).select("id", "ordinal")
    same(o.ordinal(df, ["k", "id"], ranges=23).select("id", "ordinal"), want)
    assert o.cut_ranges(df, ["k"], 23).select("__range").distinct().count() > 5
