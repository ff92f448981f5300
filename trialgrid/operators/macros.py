"""Macros between parameters: extraction, dependency order, pruning, checks and substitution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.params import build_path, macro_names, replace_macros
from trialgrid.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, cut_lineage, scratch_path

# Built-in macros, their start values and which of them uses which.
DATA_BASE_DIR = "/tests/data"
OUT_BASE_DIR = "/tests/out"
BUILTINS = ("data_base_dir", "out_base_dir", "ds_id", "comb_id", "data_dir", "out_dir", "xp.input", "xp.output")
BUILTIN_EDGES = (
    ("data_base_dir", "data_dir"),
    ("ds_id", "data_dir"),
    ("data_dir", "xp.input"),
    ("out_base_dir", "out_dir"),
    ("comb_id", "out_dir"),
    ("out_dir", "xp.output"),
)

# Sections in the order in which their macros are known.
SECTIONS = ("test", "ds", "xp")


class MacroError(ValueError):
    """Macro dependencies that cannot be resolved."""


def extract_macros(values: DataFrame, name: str, value: str) -> DataFrame:
    """Edges (src, dst): the value of parameter `dst` uses macro `src`; one row per use."""
    return values.select(F.explode(macro_names(F.col(value))).alias("src"), F.col(name).alias("dst"))


def dependency_check(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges against the section order: a section may only use macros of itself and of earlier sections.

    -> (src, dst, src_section, dst_section); names without a section are not checked.
    """
    rank = lambda col: F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), col)
    users = sections.select(F.col("name").alias("dst"), F.col("section").alias("dst_section"))
    used = sections.select(F.col("name").alias("src"), F.col("section").alias("src_section"))
    both = edges.select("src", "dst").distinct().join(used, "src").join(users, "dst")
    forbidden = rank(F.col("src_section")) > rank(F.col("dst_section"))
    return both.filter(forbidden).select("src", "dst", "src_section", "dst_section")


def require_section_order(edges: DataFrame, sections: DataFrame) -> None:
    """Raise on the first edge that breaks the section order."""
    bad = dependency_check(edges, sections).orderBy("src", "dst").limit(1).collect()
    if bad:
        raise MacroError(f"not allowed dependency: {bad[0]['src_section']} -> {bad[0]['dst_section']} ({bad[0]['dst']})")


def dependency_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Level of every name: 0 without dependencies, otherwise one more than the deepest name it uses.

    Each round takes the names with no open dependency, and only the edges leaving them are counted off. Both the
    open names and those of the finished level are written out after every round, and the levels are read back
    together, so neither the plan nor the recomputation grows with the depth. A round that finds open names but none
    ready means a cycle, which raises.
    """
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "levels")
    edges = cut_lineage(edges.select("src", "dst").distinct())
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    if nodes is not None:
        names = names.union(nodes.toDF("name"))
    incoming = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("needs"))
    none = F.lit(0).cast("bigint")
    open_names = cut_lineage(
        names.distinct().join(incoming, "name", "left").select("name", F.coalesce("needs", none).alias("needs"))
    )
    level = 0
    is_ready = F.col("needs") == 0
    width = F.octet_length("name") + 16
    while True:
        rows, settled_rows, settled_bytes = open_names.agg(
            F.count("*"), F.count_if(is_ready), F.coalesce(F.sum(F.when(is_ready, width)), none)
        ).first()
        if rows and not settled_rows:
            raise MacroError("macros do not follow an acyclic order")
        ready = open_names.filter(is_ready).select("name", F.lit(level).alias("level"))
        ready.write.mode("append").parquet(path)
        if rows == settled_rows:
            return spark.read.schema("name string, level int").parquet(path)
        sources = ready.select(F.col("name").alias("src"))
        if settled_rows <= BROADCAST_ROWS and settled_bytes <= BROADCAST_BYTES:
            sources = F.broadcast(sources)  # the edges stay where they are
        met = edges.join(sources, "src", "left_semi").groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("met"))
        still_open = open_names.filter(F.col("needs") > 0).join(met, "name", "left")
        open_names = cut_lineage(
            still_open.select("name", (F.col("needs") - F.coalesce("met", none)).alias("needs"))
        )
        level += 1


def prune_unused(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names without the built-ins that nothing uses, directly or through other built-ins.

    `names` has (name, builtin). Starting from the names that stay anyway, each round adds the built-ins they use,
    so every edge is followed once. What is kept lies in one table with the round it was found in, and the edges of found
    names are left out from then on, so the plan does not grow with the rounds.
    """
    names = cut_lineage(names.select("name", "builtin").distinct())
    builtin = names.filter("builtin").select("name")
    uses = edges.select("src", "dst").distinct().join(builtin.withColumnRenamed("name", "src"), "src", "left_semi")
    uses = cut_lineage(uses)
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "kept")
    stored = [names.schema["name"].dataType.simpleString(), "int"]
    fresh, generation = names.filter(~F.col("builtin")).select("name"), 0
    while True:
        fresh.withColumn("generation", F.lit(generation)).write.mode("append").parquet(path)
        kept = spark.read.schema(f"name {stored[0]}, generation int").parquet(path)
        users = kept.filter(F.col("generation") == generation).select(F.col("name").alias("dst"))
        reached = uses.join(broadcast_if_small(users), "dst", "left_semi").select(F.col("src").alias("name")).distinct()
        fresh = cut_lineage(reached.join(kept, "name", "left_anti"))
        if fresh.isEmpty():
            return kept.select("name")
        # What is kept by now is found no further: its edges are done.
        uses = cut_lineage(uses.join(broadcast_if_small(fresh.withColumnRenamed("name", "src")), "src", "left_anti"))
        generation += 1


def substitute_macros(
    runs: DataFrame,
    order: Sequence[str],
    builtins: Mapping[str, Column] | None = None,
    uses: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Resolve `${name}` in the parameter columns, in dependency order, fresh for every row.

    `builtins` are known before the first parameter; each resolved parameter is known to the later ones. With
    `uses` (parameter -> macros occurring in its values) only those replacements become part of the plan.
    """
    known: dict[str, Column] = dict(builtins or {})
    for name in order:
        wanted = known if uses is None else {m: known[m] for m in uses.get(name, ()) if m in known}
        runs = runs.withColumn(name, replace_macros(F.col(f"`{name}`"), wanted))
        known[name] = F.col(f"`{name}`")
    return runs


def run_builtins(
    ds_id: Column, comb_id: Column, data_base: str = DATA_BASE_DIR, out_base: str = OUT_BASE_DIR
) -> dict[str, Column]:
    """Built-in macro values of one run: directories follow the dataset id and the run id."""
    data_dir, out_dir = build_path(data_base, ds_id), build_path(out_base, comb_id)
    return {
        "data_base_dir": F.lit(data_base),
        "out_base_dir": F.lit(out_base),
        "ds_id": ds_id,
        "comb_id": comb_id,
        "data_dir": data_dir,
        "out_dir": out_dir,
        "xp.input": data_dir,
        "xp.output": out_dir,
    }
