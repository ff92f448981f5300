"""Configuration files and key/value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import confmerge
from trialgrid.queries.tables import table
from trialgrid.session import scratch_path
from trialgrid.sources import conffiles


def config_scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = table(spark, sf_dir, "part").select(
        F.concat_ws(".", "p_brand", "p_partkey").alias("name"),
        F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.concat_ws(" & ", "p_name", "p_size")).alias("value"),
    )
    path = scratch_path(spark, "xml")
    properties.write.format("xml").option("rootTag", "configuration").option("rowTag", "property").save(path)
    return conffiles.config_scan_xml(spark, path).select("name", "value")


CONFIG_SCAN_XML = """
select p_brand || '.' || p_partkey as name, case when p_size >= 10 then p_name || ' & ' || p_size end as value from part
"""


def config_scan_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), F.col("p_name")))
        .when(F.col("p_size") % 5 == 1, F.lit("  "))
        .otherwise(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit(" \t "), F.col("p_name"), F.lit(" x ")))
    )
    path = scratch_path(spark, "props")
    table(spark, sf_dir, "part").select(line).write.text(path)
    return conffiles.config_scan_props(spark, path).select("name", "value")


CONFIG_SCAN_PROPS = "select 'k' || p_partkey as name, p_name || ' x' as value from part where p_size % 5 > 1"


def config_scan_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section per customer, with shared options, references to others, and an option that is set twice."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("[DEFAULT]\nhome = /data\nempty = none\n[customer "), key, F.lit("]\n; remark\nname = first\nName = "),
        F.col("c_name"), F.lit(" ; note\n\nSegment: "), F.col("c_mktsegment"), F.lit('\nEMPTY = ""\nnation=a=b\n   '),
        F.col("c_nationkey").cast("string"), F.lit("\nlog = %(path)s/100%%\npath = %(home)s/%(NAME)s"),
    )
    path = scratch_path(spark, "ini")
    table(spark, sf_dir, "customer").select(text).write.text(path)
    return conffiles.config_scan_ini(spark, path).select("section", "name", "value")


CONFIG_SCAN_INI = """
with c as (select *, 'customer ' || c_custkey as section from customer)
select section, 'name' as name, c_name as value from c
union all select section, 'segment', c_mktsegment from c
union all select section, 'empty', '' from c
union all select section, 'nation', 'a=b' || chr(10) || c_nationkey from c
union all select section, 'home', '/data' from c
union all select section, 'path', '/data/' || c_name from c
union all select section, 'log', '/data/' || c_name || '/100%' from c
"""


def config_rejects_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer, with lines that belong to nothing; how many depends on the nation."""
    told = [("orphan = 1", 0), ("[s]", 0), ("  indented", 10), ("key = a", 0), ("  more", 0), ("no option", 20), ("; remark", 0)]
    lines = [F.when(F.col("c_nationkey") >= least, F.lit(line)) for line, least in told]
    listed = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("file"), F.lit(0).cast("bigint").alias("block_start"), F.posexplode(F.array(*lines)).alias("row", "line")
    )
    listed = listed.withColumn("row", F.col("row").cast("bigint")).filter("line is not null")
    return conffiles.ini_rejects(listed).select("file", "row", "line", "reason")


CONFIG_REJECTS_INI = """
select c_name as file, 0::bigint as row, 'orphan' as line, 'no section' as reason from customer
union all select c_name, 2, '  indented', 'nothing to continue' from customer where c_nationkey >= 10
union all select c_name, 5, 'no option', 'no option' from customer where c_nationkey >= 20
"""


def param_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("section"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat_ws(" , ", "p_name", "p_brand", "p_size").alias("value"),
    )
    return conffiles.param_values(options)


PARAM_VALUES = """
select p_type as section, 'p' || p_partkey as name, unnest([0, 1, 2])::int as ordinal,
       unnest([p_name, p_brand, p_size::varchar]) as value from part
"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("value") < 8, F.lit("")).when(F.col("value") > 90, F.lit(None)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_type").alias("name"),
        F.length("props").alias("file_rank"),
        F.col("event_id").alias("pos"),
        value.alias("value"),
    )


ENTRIES = """
with entries as (select user_id, event_type as name, length(props) as file_rank, event_id as pos,
                        case when value < 8 then '' when value > 90 then null else props end as value from events)
"""


def config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confmerge.config_lookup(_entries(spark, sf_dir), scope=["user_id"])


CONFIG_LOOKUP = ENTRIES + """
, firsts as (select * from entries qualify row_number() over (partition by user_id, name, file_rank order by pos) = 1)
select user_id, name, value from firsts where value <> ''
qualify row_number() over (partition by user_id, name order by file_rank) = 1
"""


def config_lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confmerge.config_lookup_many(_entries(spark, sf_dir), scope=["user_id"])


CONFIG_LOOKUP_MANY = ENTRIES + """
, lasts as (select * from entries qualify row_number() over (partition by user_id, name, file_rank order by pos desc) = 1)
select user_id, name, value from lasts where value <> ''
qualify row_number() over (partition by user_id, name order by file_rank) = 1
"""


def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    base = customers.select(
        F.col("c_custkey").alias("name"),
        F.when(F.col("c_nationkey") == 3, F.lit("")).otherwise(F.col("c_mktsegment")).alias("value"),
    )
    updates = customers.select(
        (F.col("c_custkey") * 2).alias("name"),  # only even names are in both
        F.col("c_name").alias("value"),
        (F.col("c_custkey") % 5 < 3).alias("create_if_absent"),
        (F.col("c_custkey") % 7 < 4).alias("replace_if_present"),
    )
    return confmerge.config_upsert(base, updates)


CONFIG_UPSERT = """
with base as (select c_custkey as name, case c_nationkey when 3 then '' else c_mktsegment end as value
              from customer),
updates as (select c_custkey * 2 as name, c_name as value, c_custkey % 5 < 3 as cre, c_custkey % 7 < 4 as rep
            from customer),
merged as (select coalesce(b.name, u.name) as name, b.value as old, u.value as new, b.name is not null as in_base,
                  coalesce(u.name is not null and case when coalesce(b.value, '') <> '' then rep else cre end, false) as changed
           from base b full outer join updates u on b.name = u.name)
select name, case when changed then new else old end as value, changed from merged where in_base or changed
"""


def config_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration per user does not matter here: names are user and type, files are property lengths."""
    entries = _entries(spark, sf_dir).withColumn("name", F.concat_ws(".", "name", "user_id")).drop("user_id")
    params = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("click."), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("value")
    )
    return confmerge.config_change(entries, params, default_rank=0)


CONFIG_CHANGE = ENTRIES + """
, base as (select file_rank, name || '.' || user_id as name, arg_min(coalesce(value, ''), pos) as value,
                  arg_min(value is null, pos) as missing
           from entries group by 1, 2),
params as (select 'click.' || c_custkey as name, c_name as value from customer),
home as (select name, min(file_rank) as file_rank from base where value <> '' group by 1),
target as (select p.name, p.value, coalesce(h.file_rank, 0) as file_rank from params p left join home h using (name))
select coalesce(b.file_rank, t.file_rank)::int as file_rank, coalesce(b.name, t.name) as name,
       case when t.name is not null then t.value when b.missing then null else b.value end as value,
       t.name is not null as changed
from base b full outer join target t on b.name = t.name and b.file_rank = t.file_rank
"""


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    local = customers.select((F.col("c_custkey") * 2).alias("name"), F.col("c_name").alias("value"))
    base = customers.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("value"))
    return confmerge.config_overlay(local, base, ["name"])


CONFIG_OVERLAY = """
select c_custkey * 2 as name, c_name as value from customer
union all
select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey * 2 from customer)
"""


def missing_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    local, base = (names.select((F.col("name") * times).alias("name")) for times in (2, 3))
    return confmerge.missing_mandatory(names, local, base, ["name"])


MISSING_MANDATORY = """
select c_custkey as name from customer
where c_custkey not in (select c_custkey * 2 from customer) and c_custkey not in (select c_custkey * 3 from customer)
"""

QUERIES = {
    "config_scan_xml": (config_scan_xml, CONFIG_SCAN_XML),
    "config_scan_props": (config_scan_props, CONFIG_SCAN_PROPS),
    "config_scan_ini": (config_scan_ini, CONFIG_SCAN_INI),
    "config_rejects_ini": (config_rejects_ini, CONFIG_REJECTS_INI),
    "param_values": (param_values, PARAM_VALUES),
    "config_lookup": (config_lookup, CONFIG_LOOKUP),
    "config_lookup_many": (config_lookup_many, CONFIG_LOOKUP_MANY),
    "config_upsert": (config_upsert, CONFIG_UPSERT),
    "config_change": (config_change, CONFIG_CHANGE),
    "config_overlay": (config_overlay, CONFIG_OVERLAY),
    "missing_mandatory": (missing_mandatory, MISSING_MANDATORY),
}
