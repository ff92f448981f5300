"""Grids, run states, batches, macro graphs and the sweep itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import grid, macros
from trialgrid.plans.experiment import Experiment
from trialgrid.plans.samples import pi_estimate as estimate
from trialgrid.plans.suite import run_suite as run
from trialgrid.plans.sweep_apply import DISTINCT_ERROR, Axis, Measure
from trialgrid.plans.sweep_apply import sweep_apply as apply_grid
from trialgrid.plans.sweep_apply import sweep_apply_where as apply_pairs
from trialgrid.queries.tables import table
from trialgrid.sources.datasets import register_dataset
from trialgrid.session import scratch_path

QUANTITIES = (10.0, 20.0, 30.0)
DISCOUNTS = (0.02, 0.05)
FLAGS = ("A", "N", "R")
STATUSES = ("F", "O", "P")

# Prices in whole cents: exact, and cheaper than parsing each double into a decimal.
CENTS = "cast(cast(rint(l_extendedprice * 100) as bigint) as decimal(18,0))"


def sweep_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    axes = [
        Axis("min_qty", "l_quantity", ">=", QUANTITIES),
        Axis("max_disc", "l_discount", "<=", DISCOUNTS),
        Axis("flag", "l_returnflag", "==", FLAGS),
    ]
    measures = [
        Measure("n", "count"),
        Measure("revenue", "sum", F.expr(CENTS)),
        Measure("max_price", "max", F.col("l_extendedprice")),
        Measure("min_tax", "min", F.col("l_tax")),
    ]
    return apply_grid(lines, axes, measures).withColumn("revenue", (F.col("revenue") / 100).cast("double"))


SWEEP_APPLY = """
select g.min_qty, g.max_disc, g.flag, count(l_orderkey) as n,
       sum(cast(l_extendedprice as decimal(18,2)))::double as revenue,
       max(l_extendedprice) as max_price, min(l_tax) as min_tax
from (select * from (values (10.0::double), (20.0::double), (30.0::double)) a(min_qty),
                    (values (0.02::double), (0.05::double)) b(max_disc),
                    (values ('A'), ('N'), ('R')) c(flag)) g
left join lineitem on l_quantity >= min_qty and l_discount <= max_disc and l_returnflag = flag
group by 1, 2, 3
"""


def sweep_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders and parts of every combination: estimates by sketches, held against exact counts."""
    lines = table(spark, sf_dir, "lineitem")
    axes = [Axis("min_qty", "l_quantity", ">=", QUANTITIES), Axis("max_disc", "l_discount", "<=", DISCOUNTS)]
    counted = {"orders": "l_orderkey", "parts": "l_partkey"}
    estimates = apply_grid(lines, axes, [Measure(f"about_{name}", "distinct", F.col(key)) for name, key in counted.items()])

    def inside(combination):
        return (F.col("l_quantity") >= combination["min_qty"]) & (F.col("l_discount") <= combination["max_disc"])

    combinations = [{"min_qty": low, "max_disc": high} for low in QUANTITIES for high in DISCOUNTS]
    exact = apply_pairs(lines, combinations, inside, [Measure(name, "count_distinct", F.col(key)) for name, key in counted.items()])
    near = [
        (F.abs(F.col(f"about_{name}") - F.col(name)) <= 4 * DISTINCT_ERROR * F.col(name)).alias(f"{name}_near") for name in counted
    ]
    return estimates.join(exact, ["min_qty", "max_disc"]).select("min_qty", "max_disc", *counted, *near)


SWEEP_DISTINCT = """
select min_qty, max_disc, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts, true as orders_near, true as parts_near
from (select * from (values (10.0::double), (20.0::double), (30.0::double)) a(min_qty),
                    (values (0.02::double), (0.05::double)) b(max_disc)) g
left join lineitem on l_quantity >= min_qty and l_discount <= max_disc
group by 1, 2
"""


def sweep_apply_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    combinations = [{"low": low, "width": width} for low in (1.0, 15.0, 30.0, 1000.0) for width in (5.0, 20.0)]

    def inside(combination):
        low, width = combination["low"], combination["width"]
        return (F.col("l_quantity") >= low) & (F.col("l_quantity") < low + width * (1 - F.col("l_discount")))

    measures = [Measure("n", "count"), Measure("revenue", "sum", F.expr(CENTS))]
    return apply_pairs(lines, combinations, inside, measures).withColumn("revenue", (F.col("revenue") / 100).cast("double"))


SWEEP_APPLY_WHERE = """
select low, width, count(l_orderkey) as n, sum(cast(l_extendedprice as decimal(18,2)))::double as revenue
from lineitem right join (select * from (values (1.0::double), (15.0::double), (30.0::double), (1000.0::double)) a(low),
                                  (values (5.0::double), (20.0::double)) b(width)) g
  on l_quantity >= low and l_quantity < low + width * (1 - l_discount)
group by 1, 2
"""


def run_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same thresholds run by run: outputs of all runs with the parameters from their run records."""

    @register_dataset("Lines")
    def lines(session, props, size):
        return table(session, props["dir"], "lineitem")

    def revenue(session, lines, args, params):
        low, high = float(args[0]), float(args[1])
        kept = lines.filter((F.col("l_quantity") >= low) & (F.col("l_discount") <= high))
        return kept.agg(F.count("*").alias("n"), (F.sum(F.expr(CENTS)) / 100).cast("double").alias("revenue"))

    home = scratch_path(spark, "suite")
    experiment = Experiment(
        options={"test.num_repetitions": "2", "test.output_path": f"{home}/out"},
        classes=[("Lines", {"dir": sf_dir})],
        dataset={"ds.config": ["0"]},
        runs={"xp.qty": ["10", "30"], "xp.disc": ["0.02", "0.05"], "xp.job": ["revenue || ${xp.qty} ${xp.disc}"]},
        order=["ds.config", "xp.disc", "xp.qty", "xp.job"],
        uses={"xp.job": ["xp.qty", "xp.disc"]},
    )
    records = run(spark, experiment, home, {"revenue": revenue})
    outputs = spark.read.parquet(f"{home}/out").withColumn("run_id", F.col("run_id").cast("bigint"))
    return outputs.join(records, "run_id").select(
        "rep",
        F.col("params")["xp.qty"].cast("double").alias("min_qty"),
        F.col("params")["xp.disc"].cast("double").alias("max_disc"),
        "status",
        "n",
        "revenue",
    )


RUN_SUITE = """
select rep, min_qty, max_disc, 'done' as status, count(l_orderkey) as n,
       sum(cast(l_extendedprice as decimal(18,2)))::double as revenue
from (select * from (values (1), (2)) r(rep), (values (10.0::double), (30.0::double)) a(min_qty),
                    (values (0.02::double), (0.05::double)) b(max_disc)) g
left join lineitem on l_quantity >= min_qty and l_discount <= max_disc
group by 1, 2, 3
"""


def sweep_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {
        "c_custkey": table(spark, sf_dir, "customer").select("c_custkey"),
        "o_orderpriority": table(spark, sf_dir, "orders").select("o_orderpriority"),
        "rep": [1, 2, 3],
    }
    return grid.sweep_expand(spark, lists)


SWEEP_EXPAND = """
select c_custkey, o_orderpriority, rep::int as rep
from (select distinct c_custkey from customer), (select distinct o_orderpriority from orders),
     (select unnest(range(1, 4)) as rep)
"""


def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return grid.repeat_runs(customers, 3, ["c_mktsegment", "c_custkey"])


REPEAT_RUNS = """
select row_number() over (order by c_mktsegment, c_custkey, rep) as comb_id, rep::int as rep, c_mktsegment, c_custkey
from customer, (select unnest(range(1, 4)) as rep)
"""


def same_dataset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    return grid.same_dataset_batch(runs, ["c_mktsegment", "c_nationkey"], ["c_custkey"])


SAME_DATASET_BATCH = """
select dense_rank() over (order by c_mktsegment, c_nationkey) as ds_id,
       row_number() over (order by c_mktsegment, c_nationkey, c_custkey) as comb_id,
       c_mktsegment, c_nationkey, c_custkey
from customer
"""


def _runs_and_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    runs = grid.sweep_expand(spark, {"custkey": customers, "mode": STATUSES})
    state = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("mode"),
        F.when(F.col("o_totalprice") > 150000, grid.DONE).otherwise(grid.CANCELLED).alias("status"),
        F.col("o_orderkey").alias("attempt"),
        F.col("o_orderdate").alias("ts"),
    )
    return runs, state


STATE = """
with runs as (select c_custkey as custkey, mode from customer, (select unnest(['F', 'O', 'P']) as mode)),
latest as (select o_custkey as custkey, o_orderstatus as mode,
                  case when o_totalprice > 150000 then 'done' else 'cancelled' end as status
           from orders qualify row_number() over (partition by o_custkey, o_orderstatus
                                                  order by o_orderdate desc, o_orderkey desc) = 1)
"""


def remaining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, state = _runs_and_state(spark, sf_dir)
    return grid.remaining_runs(runs, state, ["custkey", "mode"])


REMAINING_RUNS = STATE + """
select r.custkey, r.mode from runs r
where not exists (select 1 from latest l where l.custkey = r.custkey and l.mode = r.mode and l.status = 'done')
"""


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, state = _runs_and_state(spark, sf_dir)
    return grid.progress_counts(runs, state, ["custkey", "mode"])


PROGRESS_COUNTS = STATE + """
select coalesce(l.status, 'waiting') as status, count(*) as n
from runs r left join latest l on l.custkey = r.custkey and l.mode = r.mode group by 1
"""


def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, state = _runs_and_state(spark, sf_dir)
    remaining = grid.remaining_runs(runs, state, ["custkey", "mode"])
    return grid.next_run(remaining, ["mode", "custkey"], F.col("mode") > "F")


NEXT_RUN = STATE + """
select r.custkey, r.mode from runs r
where r.mode > 'F'
  and not exists (select 1 from latest l where l.custkey = r.custkey and l.mode = r.mode and l.status = 'done')
order by r.mode, r.custkey limit 1
"""


def next_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, state = _runs_and_state(spark, sf_dir)
    remaining = grid.remaining_runs(runs, state, ["custkey", "mode"])
    return grid.next_in_batch(remaining, grid.next_run(remaining, ["mode", "custkey"]), ["mode"])


NEXT_IN_BATCH = STATE + """
, remaining as (select r.custkey, r.mode from runs r
  where not exists (select 1 from latest l where l.custkey = r.custkey and l.mode = r.mode and l.status = 'done'))
select custkey, mode from remaining where mode = (select min(mode) from remaining)
"""


def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fresh = orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey")
    return grid.next_ids(fresh, ["o_orderkey"], orders, "o_orderkey")


NEXT_IDS = """
select o_orderkey, (select coalesce(max(o_orderkey), 0) from orders) + row_number() over (order by o_orderkey) as new_id
from orders where o_orderstatus = 'O'
"""


def align_class_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array("p_brand", "p_type", "p_name").alias("classes"),
        F.create_map(
            F.lit("path"), F.array(F.col("p_name"), F.lit(""), F.col("p_brand")), F.lit("kind"), F.array("p_type")
        ).alias("props"),
    )
    return grid.align_class_params(configs, "classes", "props", ["p_partkey"])


ALIGN_CLASS_PARAMS = """
with c as (select p_partkey, unnest([p_brand, p_type, p_name]) as class, unnest([0, 1, 2]) as idx,
                  unnest([p_name, '', p_brand]) as path, p_type from part)
select p_partkey, idx::int as idx, class, 'path' as name, path as value from c where path <> ''
union all
select p_partkey, idx::int, class, 'kind', p_type from c
"""


def param_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    return grid.param_union(names, table(spark, sf_dir, "orders").select("o_orderpriority"))


PARAM_UNION = "select c_mktsegment as name from customer union select o_orderpriority from orders"


def merge_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("value")
    )
    doubled = (F.col("o_custkey") * 2).cast("string").alias("name")  # only even names can be in both
    experiment = table(spark, sf_dir, "orders").groupBy(doubled).agg(F.max("o_orderpriority").alias("value"))
    return grid.merge_params(dataset, experiment)


MERGE_PARAMS = """
with e as (select (o_custkey * 2)::varchar as name, max(o_orderpriority) as value from orders group by 1)
select * from e
union all
select c_custkey::varchar, c_mktsegment from customer where c_custkey::varchar not in (select name from e)
"""


def name_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("o_custkey"))
    return grid.name_difference(table(spark, sf_dir, "customer").select("c_custkey"), doubled)


NAME_DIFFERENCE = "select c_custkey from customer except select o_custkey * 2 from orders"


# Macro graphs: every order uses two earlier ones, so the graph grows with the table and its depth with the logarithm.


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    earlier = [F.floor((key - 1) / step).cast("string") for step in (16, 64)]
    return orders.select(F.explode(F.array(*earlier)).alias("src"), key.cast("string").alias("dst"))


USES = """
uses as (select distinct src::varchar as src, dst::varchar as dst from
  (select unnest([floor((o_orderkey - 1) / 16)::bigint, floor((o_orderkey - 1) / 64)::bigint]) as src, o_orderkey as dst from orders))
"""


def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macros.dependency_order(_uses(spark, sf_dir))


DEPENDENCY_ORDER = "with recursive " + USES + """
, names as (select src as name from uses union select dst from uses),
levels as (select name, 0 as level from names where name not in (select dst from uses)
           union select dst, level + 1 from levels join uses on src = name)
select name, max(level)::int as level from levels group by 1
"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "O", "ds").otherwise("xp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), section.alias("section"))


SECTIONS = """
sections as (select o_orderkey::varchar as name,
  case o_orderstatus when 'F' then 'test' when 'O' then 'ds' else 'xp' end as section from orders)
"""


def dependency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macros.dependency_check(_uses(spark, sf_dir), _sections(spark, sf_dir))


DEPENDENCY_CHECK = "with " + USES + ", " + SECTIONS + """
select src, dst, s.section as src_section, d.section as dst_section
from uses join sections s on s.name = src join sections d on d.name = dst
where (s.section = 'ds' and d.section = 'test') or (s.section = 'xp' and d.section in ('test', 'ds'))
"""


def prune_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _sections(spark, sf_dir).select("name", (F.col("section") == "test").alias("builtin"))
    return macros.prune_unused(_uses(spark, sf_dir), names)


PRUNE_UNUSED = "with recursive " + USES + ", " + SECTIONS + """
, kept as (select name from sections where section <> 'test'
           union select src from kept join uses on dst = kept.name join sections s on s.name = src where s.section = 'test')
select name from kept
"""


def pi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return estimate(lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")), "i")


PI_ESTIMATE = """
select count(*) filter (x * x + y * y <= 1) as inside, count(*) as points,
       count(*) filter (x * x + y * y <= 1) * 4.0::double / count(*) as pi
from (select ((i * 6799333552837830) % 9007199254740992)::double / 9007199254740992 as x,
             ((i * 5132665044399055) % 9007199254740992)::double / 9007199254740992 as y
      from (select (l_orderkey * 8 + l_linenumber)::hugeint as i from lineitem))
"""

QUERIES = {
    "sweep_apply": (sweep_apply, SWEEP_APPLY),
    "sweep_apply_where": (sweep_apply_where, SWEEP_APPLY_WHERE),
    "sweep_distinct": (sweep_distinct, SWEEP_DISTINCT),
    "run_suite": (run_suite, RUN_SUITE),
    "sweep_expand": (sweep_expand, SWEEP_EXPAND),
    "repeat_runs": (repeat_runs, REPEAT_RUNS),
    "same_dataset_batch": (same_dataset_batch, SAME_DATASET_BATCH),
    "remaining_runs": (remaining_runs, REMAINING_RUNS),
    "progress_counts": (progress_counts, PROGRESS_COUNTS),
    "next_run": (next_run, NEXT_RUN),
    "next_in_batch": (next_in_batch, NEXT_IN_BATCH),
    "next_ids": (next_ids, NEXT_IDS),
    "align_class_params": (align_class_params, ALIGN_CLASS_PARAMS),
    "param_union": (param_union, PARAM_UNION),
    "merge_params": (merge_params, MERGE_PARAMS),
    "name_difference": (name_difference, NAME_DIFFERENCE),
    "dependency_order": (dependency_order, DEPENDENCY_ORDER),
    "dependency_check": (dependency_check, DEPENDENCY_CHECK),
    "prune_unused": (prune_unused, PRUNE_UNUSED),
    "pi_estimate": (pi_estimate, PI_ESTIMATE),
}
