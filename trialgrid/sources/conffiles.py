"""Configuration files as entries (file, block_start, row, name, value): XML, name-value lines and INI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.functions.params import BLANKS, split_trim_list, strip
from trialgrid.operators.grid import ParameterError
from trialgrid.operators.ordinal import carry_forward
from trialgrid.session import broadcast_if_small, cut_lineage
from trialgrid.sources.lines import LINE_ORDER, read_lines

# The syntax of INI files.
INI_COMMENT = r"^(\s*$|[#;]|[rR][eE][mM](\s|$))"
INI_HEADER = r"^\[([^\]]+)\]"
INI_OPTION = r"^([^:=\s][^:=]*)[:=]\s*(.*)$"
INI_CONTINUED = r"^\s"
# The section whose options all others have, references to other options, and how deep they may nest.
INI_DEFAULT = "DEFAULT"
INI_REFERENCE = r"%\(([^)]*)\)s"
INI_TOKEN = r"%\([^)]*\)s|%%|[^%]+|%"
INI_SECTION_NAME = "__name__"
INI_DEPTH = 10


def with_position(entries: DataFrame, file_rank: DataFrame) -> DataFrame:
    """Entries with `file_rank` (file, file_rank) and one comparable `pos`, as the lookups want them."""
    ranked = entries.join(file_rank, "file")
    return ranked.withColumn("pos", F.struct(*LINE_ORDER)).drop(*LINE_ORDER)


def config_scan_xml(spark: SparkSession, path: str, row_tag: str = "property") -> DataFrame:
    """All properties of XML configuration files, values as text; an empty value is null."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("recursiveFileLookup", True)
    return reader.schema("name string, value string").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"),
        "name",
        F.nullif("value", F.lit("")).alias("value"),
    )


def props_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds name and value of `name value` lines; comments and blank lines go, the rest of a line is its value."""
    text = F.btrim(F.col(line), F.lit(BLANKS))
    parts = F.split(text, r"\s+", 2)
    kept = lines.filter(~F.startswith(F.col(line), F.lit("#")) & (text != ""))
    return kept.select("*", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("value")).drop(line)


def config_scan_props(spark: SparkSession, path: str) -> DataFrame:
    """All entries of name-value configuration files."""
    return props_entries(read_lines(spark, path))


def _placed(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """INI lines without comments, each with its section, the option it belongs to and its part of the value.

    The section of a line is carried forward over the physical splits of its file, so a large file is handled by many
    tasks; `ranges` cuts the lines into so many ranges instead, where they do not come from splits.
    """
    line = F.col("line")
    # Each pattern is matched once per line; a group of a pattern that does not match is empty.
    matched = lines.filter(~F.rlike(line, F.lit(INI_COMMENT))).select(
        "file",
        *LINE_ORDER,
        "line",
        F.rlike(line, F.lit(INI_CONTINUED)).alias("continued"),
        F.regexp_extract(line, INI_HEADER, 1).alias("header"),
        F.lower(strip(F.regexp_extract(line, INI_OPTION, 1))).alias("option"),
        # A value ends before its first `;` if a blank stands before that.
        strip(F.regexp_replace(F.regexp_extract(line, INI_OPTION, 2), r"^([^;]*\s);.*$", "$1")).alias("value"),
    )
    header = F.when(~F.col("continued"), F.nullif("header", F.lit("")))
    option = F.when(~F.col("continued") & (F.col("header") == ""), F.nullif("option", F.lit("")))
    kinds = matched.select(
        "file", *LINE_ORDER, "line", "continued", header.alias("header"), option.alias("option"), "value"
    )
    place = F.struct(*LINE_ORDER)
    is_option, is_header = F.col("option").isNotNull(), F.col("header").isNotNull()
    marked = kinds.select(
        "file",
        *LINE_ORDER,
        "header",
        # A header starts with no option open, so an indented line right after it belongs to nothing.
        F.when(is_option | is_header, F.struct(place.alias("at"), F.col("option").alias("name"))).alias("start"),
        # Two quotes stand for an empty value.
        F.when(is_option, F.when(F.col("value") == '""', F.lit("")).otherwise(F.col("value")))
        .when(F.col("continued"), strip(line))
        .alias("part"),
        F.when(~is_option & ~is_header, line).alias("other"),
    )
    carried = {"section": "header", "open": "start"}
    if ranges:
        return carry_forward(marked, LINE_ORDER, carried, by=["file"], ranges=ranges)
    return _carried_by_split(marked, carried)


def _carried_by_split(lines: DataFrame, values: dict[str, str]) -> DataFrame:
    """`lines` with the last non-null value up to each line, in one scan per physical split of a file.

    A split (file, block_start) is a range already: its last values are aggregated, carried over the few splits of the file
    and meet its lines again, which are scanned in the order of `row`. Lines are moved once and never sampled or rewritten.
    """
    split = ["file", "block_start"]
    ends = lines.groupBy(*split).agg(*[F.max_by(value, F.when(F.col(value).isNotNull(), F.col("row"))).alias(name) for name, value in values.items()])
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*split, *[F.last(name, ignorenulls=True).over(before).alias(f"__{name}") for name in values])
    inside = Window.partitionBy(*split).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = lines.select("*", *[F.last(value, ignorenulls=True).over(inside).alias(name) for name, value in values.items()])
    joined = scanned.join(carry, split, "left")
    filled = [F.coalesce(name, f"__{name}").alias(name) for name in values]
    return joined.select(*[name for name in scanned.columns if name not in values], *filled)


def _entries(placed: DataFrame) -> DataFrame:
    parts = placed.filter(F.col("open.name").isNotNull() & F.col("section").isNotNull() & F.col("part").isNotNull())
    # All parts of one value make one string.
    listed = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "part")))
    grouped = parts.groupBy("file", "section", F.col("open.at").alias("at"), F.col("open.name").alias("name"))
    text = F.array_join(F.transform(listed, lambda one: one["part"]), "\n")
    values = grouped.agg(text.alias("value"))
    return values.select("file", "section", "name", "value", "at.block_start", "at.row")


def _rejects(placed: DataFrame) -> DataFrame:
    orphan = F.col("section").isNull() & F.col("header").isNull()
    reason = F.when(orphan, "no section").when(F.col("other").isNotNull() & F.col("part").isNull(), "no option")
    reason = reason.when(F.col("other").isNotNull() & F.col("open.name").isNull(), "nothing to continue")
    found = placed.select("file", *LINE_ORDER, F.coalesce("other", "open.name").alias("line"), reason.alias("reason"))
    return found.filter(F.col("reason").isNotNull())


def ini_entries(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(file, section, name, value, block_start, row) of every option of INI lines, as it stands there.

    Names are in lower case. An indented line continues the value above it. Lines that belong to nothing are left to
    `ini_rejects`.
    """
    return _entries(_placed(lines, ranges))


def ini_rejects(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(file, block_start, row, line, reason) of the lines that make a file wrong.

    These are lines before the first section (of an option the name stands for the line), lines that are no option, and
    indented ones with no value above.
    """
    return _rejects(_placed(lines, ranges))


def ini_options(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """(file, section, name, value, block_start, row), one row per option of each of the `sections` (file, section).

    Of repeated options the last one counts. Every section has the options of `[DEFAULT]` that it does not set itself.
    """
    ident = ["file", "section", "name"]
    place = F.struct(*LINE_ORDER)
    last = entries.groupBy(*ident).agg(F.max_by("value", place).alias("value"), F.max(place).alias("at"))
    last = cut_lineage(last)
    default = F.col("section") == INI_DEFAULT
    own = last.filter(~default).withColumn("own", F.lit(True))
    shared = broadcast_if_small(last.filter(default).drop("section"))
    inherited = sections.filter(~default).distinct().join(shared, "file").withColumn("own", F.lit(False))
    both = own.unionByName(inherited)
    chosen = both.groupBy(*ident).agg(F.max_by(F.struct("value", "at"), "own").alias("found"))
    return chosen.select(*ident, "found.value", "found.at.block_start", "found.at.row")


def interpolate_options(options: DataFrame) -> DataFrame:
    """`options` with each `%(name)s` replaced by that option of the same section, level by level.

    In a value with references, `%%` is one `%`. A reference to nothing, or ones nested deeper than INI_DEPTH, are errors.
    Only values with references are joined and written again.
    """
    ident = ["file", "section", "name"]
    refers = F.rlike("value", F.lit(INI_REFERENCE))
    options = cut_lineage(options)
    texts = options.select("file", "section", F.col("name").alias("ref"), F.col("value").alias("text"))
    done, left = options.filter(~refers), options.filter(refers)
    open_ones = left.count()
    for _ in range(INI_DEPTH):
        if not open_ones:
            return done
        names = F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(INI_REFERENCE), F.lit(1)), F.lower))
        found = left.select(*ident, F.explode(names).alias("ref")).join(broadcast_if_small(texts), ["file", "section", "ref"], "left")
        text = F.coalesce("text", F.when(F.col("ref") == INI_SECTION_NAME, F.col("section")))
        known = found.groupBy(*ident).agg(
            F.map_from_entries(F.collect_list(F.struct("ref", text.alias("text")))).alias("known"),
            F.max(F.when(text.isNull(), F.col("ref"))).alias("missing"),
        )
        tokens = F.regexp_extract_all("value", F.lit(INI_TOKEN), F.lit(0))
        parts = F.transform(
            tokens,
            lambda t: F.when(t == "%%", "%")
            .when(F.rlike(t, F.lit(INI_REFERENCE)), F.try_element_at("known", F.lower(F.regexp_extract(t, INI_REFERENCE, 1))))
            .otherwise(t),
        )
        value = F.array_join(parts, "").alias("value")
        left = cut_lineage(left.join(known, ident).select(*ident, value, *LINE_ORDER, "missing"))
        lost = F.max(F.when(F.col("missing").isNotNull(), F.struct("name", "missing")))
        missing, open_ones = left.agg(lost, F.count_if(refers)).first()
        if missing:
            raise ParameterError(f"{missing[0]} refers to {missing[1]}, which its section does not have")
        left = left.drop("missing")
        done, left = done.unionByName(left.filter(~refers)), left.filter(refers)
    if open_ones:
        raise ParameterError(f"the references of {open_ones} options are nested too deep")
    return done


def config_scan_ini(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, name, value, block_start, row): what INI files say for each option, references resolved.

    A line that belongs to nothing is an error.
    """
    placed = cut_lineage(_placed(read_lines(spark, path)))
    wrong = _rejects(placed).orderBy("file", *LINE_ORDER).limit(1).collect()
    if wrong:
        raise ParameterError(f"{wrong[0]['file']}: {wrong[0]['reason']}: {wrong[0]['line']}")
    sections = placed.filter("header is not null").select("file", F.col("header").alias("section"))
    return interpolate_options(ini_options(_entries(placed), sections))


def param_values(options: DataFrame) -> DataFrame:
    """(section, name, value text) -> (section, name, ordinal, value), one row per list entry."""
    listed = options.select("section", "name", F.posexplode(split_trim_list(F.col("value"))).alias("ordinal", "value"))
    return listed.select("section", "name", "ordinal", "value")
