"""Key/value configurations: lookup with file precedence, updates and overlays.

Entries are rows (file_rank, pos, name, value): `file_rank` is the explicit precedence of a file (smallest first),
`pos` the place of the entry in its file. An empty or null value counts as absent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_value(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _one_per_file(entries: DataFrame, scope: Sequence[str], pick) -> DataFrame:
    """One entry per name and file, then the first file where it has a value."""
    in_file = entries.groupBy(*scope, "name", "file_rank").agg(pick(F.col("value"), F.col("pos")).alias("value"))
    with_value = in_file.filter(has_value(F.col("value")))
    return with_value.groupBy(*scope, "name").agg(F.min_by("value", "file_rank").alias("value"))


def _requested(entries: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return entries
    return entries.join(names.select("name").distinct(), "name", "left_semi")


def config_lookup(
    entries: DataFrame, names: DataFrame | None = None, default: str | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Single-name rule: the first entry of a name in each file, then the first file where it is not empty.

    With `names`, each requested name gets a row, holding `default` if it was not found (without `scope`).
    """
    found = _one_per_file(_requested(entries, names), scope, F.min_by)
    if names is None or scope:
        return found
    asked = names.select("name").distinct()
    return asked.join(found, "name", "left").select("name", F.coalesce("value", F.lit(default)).alias("value"))


def config_lookup_many(entries: DataFrame, names: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Many-name rule: the last entry in a file, then the first file with a value; missing names are left out."""
    return _one_per_file(_requested(entries, names), scope, F.max_by)


def first_entries(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicates of a name collapsed to the entry that a replacement would change, the first one."""
    return entries.groupBy(*keys).agg(F.min_by("value", "pos").alias("value"))


def config_upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Apply (keys, value, create_if_absent, replace_if_present) to (keys, value) -> keys, value, changed.

    Both sides have unique keys, so no key is hot. A present value is replaced only with `replace_if_present`, an
    absent one is set only with `create_if_absent`.
    """
    old = base.select(*keys, F.col("value").alias("__old"), F.lit(True).alias("__in_base"))
    new = updates.select(
        *keys,
        F.col("value").alias("__new"),
        F.col("create_if_absent").alias("__create"),
        F.col("replace_if_present").alias("__replace"),
        F.lit(True).alias("__in_updates"),
    )
    both = old.join(new, list(keys), "full_outer")
    present = F.coalesce(F.col("__old").cast("string"), F.lit("")) != ""
    changed = F.coalesce(F.col("__in_updates") & F.when(present, F.col("__replace")).otherwise(F.col("__create")), F.lit(False))
    rows = both.select(
        *keys,
        F.when(changed, F.col("__new")).otherwise(F.col("__old")).alias("value"),
        changed.alias("changed"),
        "__in_base",
    )
    return rows.filter(F.col("__in_base") | F.col("changed")).drop("__in_base")


def config_change(entries: DataFrame, params: DataFrame, default_rank: int, target_rank: int | None = None) -> DataFrame:
    """Set each (name, value) of `params` in the right file -> file_rank, name, value, changed.

    With a target file it is set there. Otherwise the first file where the name has a value is changed, and a
    name found nowhere is created in the default file.
    """
    base = first_entries(entries, ["file_rank", "name"])
    if target_rank is not None:
        placed = params.select(F.lit(target_rank).alias("file_rank"), "name", "value")
    else:
        home = base.filter(has_value(F.col("value"))).groupBy("name").agg(F.min("file_rank").alias("__home"))
        placed = params.join(home, "name", "left").select(
            F.coalesce("__home", F.lit(default_rank)).alias("file_rank"), "name", "value"
        )
    flagged = placed.select(
        "*", F.lit(True).alias("create_if_absent"), F.lit(True).alias("replace_if_present")
    )
    return config_upsert(base, flagged, ["file_rank", "name"])


def config_overlay(local: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local rows, and those base rows whose key has no local row."""
    own = local.select(*keys).distinct()
    return local.unionByName(base.join(own, list(keys), "left_anti"))


def missing_mandatory(mandatory: DataFrame, local: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mandatory keys found on neither side."""
    have = local.select(*keys).unionByName(base.select(*keys)).distinct()
    return mandatory.select(*keys).distinct().join(have, list(keys), "left_anti")
