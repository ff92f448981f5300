"""Machine inventories: racks, hardware groups, totals, first and latest records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.ordinal import ordinal
from trialgrid.session import broadcast_if_small, cut_lineage

# Names used by topologies and hardware groups.
DEFAULT_RACK = "/default-rack"
GROUP_PREFIX = "cluster-"


def rack_lookup(hosts: DataFrame, racks: DataFrame, key: str = "host", rack: str = "rack") -> DataFrame:
    """Add the rack of every host by equality; hosts without one get the default rack.

    `racks` has one row per host. It is broadcast when its measured size allows; else both sides are shuffled and
    AQE splits a skewed host.
    """
    side = broadcast_if_small(racks.select(F.col(key).alias("__key"), F.col(rack).alias("__rack")))
    joined = hosts.join(side, F.col(key) == F.col("__key"), "left")
    return joined.select(*hosts.columns, F.coalesce("__rack", F.lit(DEFAULT_RACK)).alias(rack))


def group_counts(hosts: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Hosts per group and the position of the first one."""
    return hosts.groupBy(*keys).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def hardware_groups(hosts: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Groups of equal hardware named `cluster-0`, `cluster-1`, .. in order of first appearance.

    One row per group; `members_in_order` gives the hosts themselves. The groups are written out once, so that
    numbering them does not group the hosts again.
    """
    groups = ordinal(cut_lineage(group_counts(hosts, keys, pos)), ["first_pos"], name="__no")
    name = F.concat(F.lit(GROUP_PREFIX), F.col("__no").cast("string"))
    return groups.select(name.alias("cluster"), *keys, "n", "first_pos")


def members_in_order(hosts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The members of every group as rows with their position in the group.

    Rows instead of a list per group: a group may hold a large part of all hosts, and its ranges are numbered in
    different tasks.
    """
    return ordinal(hosts, order, by=by, name="member_no")


def fleet_totals(groups: DataFrame, name: Column, memory: Column, cores: Column, n: Column, first: Column) -> DataFrame:
    """Total nodes, memory and cores, and the group leading in each; the first group wins a tie."""
    lead = lambda metric: F.max_by(name, F.struct(metric, -first))
    return groups.agg(
        F.sum(n).alias("total_nodes"),
        F.sum(memory * n).alias("total_memory"),
        F.sum(cores * n).alias("total_cores"),
        lead(memory).alias("max_memory_group"),
        lead(cores).alias("max_cores_group"),
        lead(n).alias("max_nodes_group"),
    )


def total_size(files: DataFrame, size: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of files and bytes, in all or per group."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def latest_entry(entries: DataFrame, keys: Sequence[str], time: str, ident: str) -> DataFrame:
    """Id of the entry with the greatest time per key; the greater id wins a tie."""
    return entries.groupBy(*keys).agg(F.max(F.struct(time, ident))[ident].alias(ident))


def dedupe_keep_first(rows: DataFrame, keys: Sequence[str], pos: str, name: str = "first_pos") -> DataFrame:
    """Distinct keys with the position of their first appearance; partial aggregation runs before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(pos).alias(name))
