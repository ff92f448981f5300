"""Columns over parameter values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions import params
from trialgrid.operators import macros
from trialgrid.queries.tables import table


def split_trim_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(" ,\t"), F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return part.select("p_partkey", F.posexplode(params.split_trim_list(F.col("text"))).alias("ordinal", "value"))


SPLIT_TRIM_LIST = """
select p_partkey, unnest([0, 1, 2])::int as ordinal, unnest([p_brand, p_type, p_size::varchar]) as value from part
"""

_SPEC = "case p_size % 3 when 0 then {a} when 1 then {a} || ' || ' || {b} else {a} || '||' || {b} || ' || x.jar y.jar ' end"


def split_job_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.expr(_SPEC.format(a="p_name", b="p_brand"))
    part = table(spark, sf_dir, "part").select("p_partkey", params.split_job_spec(spec).alias("spec"))
    return part.select("p_partkey", "spec.path", "spec.params", F.array_join("spec.libs", ",").alias("libs"))


SPLIT_JOB_SPEC = f"""
select p_partkey, trim(parts[1]) as path, case when len(parts) > 1 then trim(parts[2]) end as params,
       case when len(parts) = 3 then replace(trim(parts[3]), ' ', ',') end as libs
from (select p_partkey, string_split({_SPEC.format(a='p_name', b='p_brand')}, '||') as parts from part)
"""


def extract_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("/d/${"), F.col("o_orderpriority"), F.lit("}/$x/${k}${"))
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), value.alias("value"))
    return macros.extract_macros(values, "name", "value")


EXTRACT_MACROS = """
select unnest(regexp_extract_all('/d/${' || o_orderpriority || '}/$x/${k}${', '\\$\\{([^}]*)\\}', 1)) as src,
       o_orderkey as dst
from orders
"""


def substitute_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("${data_dir}/"), F.col("o_orderpriority")).alias("a"),
        F.concat(F.lit("${a}/${nowhere}/"), F.col("o_orderstatus")).alias("b"),
        F.concat(F.lit("${b}:${xp.output}:${a}:"), F.col("o_custkey").cast("string")).alias("c"),
        F.col("o_custkey").alias("ds_id"),
    )
    builtins = macros.run_builtins(F.col("ds_id"), F.col("o_orderkey"))
    uses = {"a": ["data_dir"], "b": ["a"], "c": ["xp.output", "a", "b"]}
    return macros.substitute_macros(runs, ["a", "b", "c"], builtins, uses).drop("ds_id")


SUBSTITUTE_MACROS = """
with s1 as (select o_orderkey, o_custkey, '/tests/data/' || o_custkey || '/' || o_orderpriority as a,
                   '${a}/${nowhere}/' || o_orderstatus as b, '${b}:${xp.output}:${a}:' || o_custkey as c from orders),
s2 as (select o_orderkey, a, replace(b, '${a}', a) as b, c from s1)
select o_orderkey, a, b, replace(replace(replace(c, '${xp.output}', '/tests/out/' || o_orderkey), '${a}', a), '${b}', b) as c
from s2
"""


def substitute_macros_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nat"), F.col("c_nationkey").cast("string"))
    text = F.concat(F.lit("/d/${seg}/${nat}/${other}/"), F.col("c_name"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), values.alias("values"))
    resolved = params.replace_macros_from_map(F.col("text"), F.col("values"))
    return customers.select("c_custkey", resolved.alias("path"))


SUBSTITUTE_MACROS_LONG = """
select c_custkey, '/d/' || c_mktsegment || '/' || c_nationkey || '/${other}/' || c_name as path from customer
"""


def build_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = macros.run_builtins(F.col("o_custkey"), F.col("o_orderkey"))
    names = {"xp.input": "input", "xp.output": "output", "data_dir": "data_dir", "out_dir": "out_dir"}
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", *[paths[macro].alias(name) for macro, name in names.items()])


BUILD_PATHS = """
select o_orderkey, '/tests/data/' || o_custkey as input, '/tests/out/' || o_orderkey as output,
       '/tests/data/' || o_custkey as data_dir, '/tests/out/' || o_orderkey as out_dir
from orders
"""


def parse_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("p_size") % 2 == 0, F.lit("site.xml")).otherwise(F.concat(F.lit("brand="), F.col("p_brand")))
    second = F.concat(F.lit("type="), F.col("p_type"), F.lit("="), F.col("p_size").cast("string"))
    third = F.concat(F.lit("name="), F.col("p_name"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", params.parse_assignments(F.array(first, F.lit("name=old"), second, third)).alias("parsed")
    )
    return part.select("p_partkey", "parsed.file", F.explode("parsed.params").alias("name", "value"))


PARSE_ASSIGNMENTS = """
with p as (select *, case when p_size % 2 = 0 then 'site.xml' end as file from part)
select p_partkey, file, 'type' as name, p_type || '=' || p_size as value from p
union all select p_partkey, file, 'name', p_name from p
union all select p_partkey, file, 'brand', p_brand from p where file is null
"""


def route_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", F.concat(F.lit("xp."), F.col("event_type"))).otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").select("event_id", params.route_name(name).alias("route"))
    return events.select("event_id", "route.kind", "route.name")


ROUTE_BY_PREFIX = """
select event_id, case event_type when 'click' then 'xp' else 'engine' end as kind, event_type as name from events
"""

QUERIES = {
    "split_trim_list": (split_trim_list, SPLIT_TRIM_LIST),
    "split_job_spec": (split_job_spec, SPLIT_JOB_SPEC),
    "extract_macros": (extract_macros, EXTRACT_MACROS),
    "substitute_macros": (substitute_macros, SUBSTITUTE_MACROS),
    "substitute_macros_long": (substitute_macros_long, SUBSTITUTE_MACROS_LONG),
    "build_paths": (build_paths, BUILD_PATHS),
    "parse_assignments": (parse_assignments, PARSE_ASSIGNMENTS),
    "route_by_prefix": (route_by_prefix, ROUTE_BY_PREFIX),
}
