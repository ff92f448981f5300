"""Machines, racks, sizes, first and latest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.text import human_size as size_text
from trialgrid.functions.text import to_megabytes as megabytes
from trialgrid.operators import inventory
from trialgrid.queries.tables import table
from trialgrid.sources.hosts import host_list_scan as scan_hosts


def _hosts_and_racks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hosts = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("host"))
    nations = table(spark, sf_dir, "nation")
    racks = nations.select((F.col("n_nationkey") + 10).cast(nations.schema["n_nationkey"].dataType).alias("host"), F.concat(F.lit("/"), F.col("n_name")).alias("rack"))
    return hosts, racks


RACKED = """
with racked as (select c_custkey, c_nationkey as host, coalesce('/' || n_name, '/default-rack') as rack
                from customer left join nation on c_nationkey = n_nationkey + 10)
"""


def rack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.rack_lookup(*_hosts_and_racks(spark, sf_dir))


RACK_LOOKUP = RACKED + "select c_custkey, host, rack from racked"


def hosts_per_rack(spark: SparkSession, sf_dir: str) -> DataFrame:
    racked = inventory.rack_lookup(*_hosts_and_racks(spark, sf_dir))
    return inventory.members_in_order(racked.select("rack", "c_custkey"), ["rack"], ["c_custkey"])


HOSTS_PER_RACK = RACKED + """
select rack, c_custkey, row_number() over (partition by rack order by c_custkey) - 1 as member_no from racked
"""


def hardware_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return inventory.hardware_groups(part, ["p_brand", "p_size"], "p_partkey")


HARDWARE_GROUPS = """
select 'cluster-' || (row_number() over (order by first_pos) - 1) as cluster, p_brand, p_size, n, first_pos
from (select p_brand, p_size, count(*) as n, min(p_partkey) as first_pos from part group by 1, 2)
"""


def fleet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("cores", F.length("p_name").cast("bigint"))
    groups = inventory.group_counts(part, ["p_brand", "p_size", "cores"], "p_partkey")
    name = F.concat_ws("/", "p_brand", "p_size", "cores")
    size = F.col("p_size").cast("bigint")
    return inventory.fleet_totals(groups, name, size, F.col("cores"), F.col("n"), F.col("first_pos"))


FLEET_TOTALS = """
with g as (select p_brand, p_size::bigint as mem, length(p_name) as cores, count(*) as n, min(p_partkey) as first_pos,
                  p_brand || '/' || p_size || '/' || length(p_name) as name
           from part group by p_brand, p_size, length(p_name))
select sum(n)::bigint as total_nodes, sum(mem * n)::bigint as total_memory, sum(cores * n)::bigint as total_cores,
       (select name from g order by mem desc, first_pos limit 1) as max_memory_group,
       (select name from g order by cores desc, first_pos limit 1) as max_cores_group,
       (select name from g order by n desc, first_pos limit 1) as max_nodes_group
from g
"""


def group_by_site_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.group_counts(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey")


GROUP_BY_SITE_KEY = "select c_mktsegment, count(*) as n, min(c_custkey) as first_pos from customer group by 1"


def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = inventory.total_size(table(spark, sf_dir, "documents"), "n_chars", ["source"])
    return sizes.withColumn("text", size_text(F.col("bytes")))


TOTAL_SIZE = """
select source, count(*) as files, sum(n_chars)::bigint as bytes,
       case when bytes > 1024 and bytes < 1048576 then printf(' (%.1f KB)', bytes::double / 1024)
            when bytes > 1048576 and bytes < 1073741824 then printf(' (%.1f MB)', bytes::double / 1048576)
            when bytes > 1073741824 then printf(' (%.1f GB)', bytes::double / 1073741824) else '' end as text
from documents group by 1
"""


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit(1), F.lit(128), F.lit(52429), F.lit(67108864)), (F.col("doc_id") % 4 + 1).cast("int"))
    sizes = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * unit).alias("bytes"))
    return sizes.withColumn("text", size_text(F.col("bytes")))


HUMAN_SIZE = """
select doc_id, bytes, case when bytes > 1024 and bytes < 1048576 then printf(' (%.1f KB)', bytes::double / 1024)
            when bytes > 1048576 and bytes < 1073741824 then printf(' (%.1f MB)', bytes::double / 1048576)
            when bytes > 1073741824 then printf(' (%.1f GB)', bytes::double / 1073741824) else '' end as text
from (select doc_id, n_chars * ([1, 128, 52429, 67108864])[doc_id % 4 + 1] as bytes from documents)
"""


def to_megabytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("kB", "MB", "gb", "TB"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.floor(F.col("p_retailprice") * 10).cast("string"), F.lit(" "), unit)
    part = table(spark, sf_dir, "part").select("p_partkey", text.alias("mem"))
    return part.select("p_partkey", "mem", megabytes(F.col("mem")).alias("mb"))


TO_MEGABYTES = """
select p_partkey, n || ' ' || u as mem, case lower(u) when 'kb' then n // 1024 when 'mb' then n when 'gb' then n * 1024 end as mb
from (select p_partkey, floor(p_retailprice * 10)::bigint as n, (['kB', 'MB', 'gb', 'TB'])[p_partkey % 4 + 1] as u from part)
"""


def latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.latest_entry(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")


LATEST_ENTRY = """
select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
"""


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.dedupe_keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


DEDUPE_KEEP_FIRST = "select user_id, event_type, min(event_id) as first_pos from events group by 1, 2"


def host_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.concat(
        F.lit("h"), F.col("o_custkey").cast("string"), F.lit(" \t,n"), F.length("o_orderpriority").cast("string"),
        F.lit(",h"), (F.col("o_custkey") + 1).cast("string"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", hosts.alias("hosts"))
    return scan_hosts(orders, "hosts", ["o_orderkey"])


HOST_LIST_SCAN = """
with listed as (select o_orderkey, unnest([0, 1, 2]) as i,
                       unnest(['h' || o_custkey, 'n' || length(o_orderpriority), 'h' || (o_custkey + 1)]) as host from orders),
firsts as (select host, min(o_orderkey * 3 + i) as seen from listed group by 1)
select row_number() over (order by seen) - 1 as pos, host from firsts
"""

QUERIES = {
    "rack_lookup": (rack_lookup, RACK_LOOKUP),
    "hosts_per_rack": (hosts_per_rack, HOSTS_PER_RACK),
    "hardware_groups": (hardware_groups, HARDWARE_GROUPS),
    "fleet_totals": (fleet_totals, FLEET_TOTALS),
    "group_by_site_key": (group_by_site_key, GROUP_BY_SITE_KEY),
    "total_size": (total_size, TOTAL_SIZE),
    "human_size": (human_size, HUMAN_SIZE),
    "to_megabytes": (to_megabytes, TO_MEGABYTES),
    "latest_entry": (latest_entry, LATEST_ENTRY),
    "dedupe_keep_first": (dedupe_keep_first, DEDUPE_KEEP_FIRST),
    "host_list_scan": (host_list_scan, HOST_LIST_SCAN),
}
