"""Columns over parameter values: lists, job specs, macros, paths, assignments, prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syntax of parameter files.
BLANKS = " \t\r\n\x0b\x0c"
LIST_SEPARATOR = ","
SPEC_SEPARATOR = r"\|\|"
MACRO_PATTERN = r"\$\{([^}]*)\}"
EXPERIMENT_PREFIX = "xp."
CLASS_PREFIX = "ds.class."


def strip(col: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.btrim(col, F.lit(BLANKS))


def split_trim_list(col: Column) -> Column:
    """`"a, b"` -> `["a", "b"]`; an empty string gives one empty entry."""
    return F.transform(F.split(col, LIST_SEPARATOR), strip)


def split_job_spec(col: Column) -> Column:
    """`"path || params || lib1 lib2"` -> struct(path, params, libs).

    `params` is null with one part; `libs` is an array and only present with exactly three parts.
    """
    parts = F.split(col, SPEC_SEPARATOR)
    third = strip(F.try_element_at(parts, F.lit(3)))
    return F.struct(
        strip(F.try_element_at(parts, F.lit(1))).alias("path"),
        F.when(F.size(parts) > 1, strip(F.try_element_at(parts, F.lit(2)))).alias("params"),
        F.when(
            F.size(parts) == 3, F.filter(F.split(third, r"[\s,]+"), lambda lib: lib != "")
        ).alias("libs"),
    )


def macro_names(col: Column) -> Column:
    """All names used as `${name}` in a value, in order of appearance."""
    return F.regexp_extract_all(col, F.lit(MACRO_PATTERN), F.lit(1))


def macro_text(name: str) -> str:
    return "${" + name + "}"


def replace_macros(col: Column, values: Mapping[str, Column]) -> Column:
    """Replace each known macro; unknown macros stay as text, a null value leaves its macro in place."""
    for name, value in values.items():
        token = macro_text(name)
        col = F.replace(col, F.lit(token), F.coalesce(value.cast("string"), F.lit(token)))
    return col


def replace_macros_from_map(col: Column, values: Column) -> Column:
    """Like `replace_macros`, with names and values in a map column; a null map replaces nothing."""
    known = F.filter(F.map_entries(values), lambda entry: entry["value"].isNotNull())
    replaced = F.aggregate(
        known,
        col,
        lambda text, entry: F.replace(text, F.concat(F.lit("${"), entry["key"], F.lit("}")), entry["value"]),
    )
    return F.when(values.isNull(), col).otherwise(replaced)


def build_path(base: Column | str, ident: Column) -> Column:
    """`<base>/<id>`."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat_ws("/", base, ident.cast("string"))


def parse_assignment(col: Column) -> Column:
    """`NAME=VALUE` -> struct(name, value), split at the first `=`; null without one."""
    at = F.instr(col, "=")
    return F.when(
        at > 0,
        F.struct(F.substring(col, F.lit(1), at - 1).alias("name"), F.substring(col, at + 1, F.length(col)).alias("value")),
    )


def parse_assignments(tokens: Column) -> Column:
    """A token list -> struct(file, params).

    A first token without `=` names the target file. The last assignment of a name wins.
    """
    first = F.try_element_at(tokens, F.lit(1))
    has_file = F.instr(first, "=") == 0
    pairs = F.filter(F.transform(tokens, parse_assignment), lambda pair: pair.isNotNull())
    later = lambda pair, pos: F.exists(
        F.slice(pairs, pos + 2, F.size(pairs)), lambda other: other["name"] == pair["name"]
    )
    return F.struct(
        F.when(has_file, first).alias("file"),
        F.map_from_entries(F.filter(pairs, lambda pair, pos: ~later(pair, pos))).alias("params"),
    )


def route_name(col: Column) -> Column:
    """Experiment parameters keep the `xp.` prefix; everything else is an engine setting.

    -> struct(kind, name): kind `xp` or `engine`, and the name without its prefix.
    """
    is_xp = F.startswith(col, F.lit(EXPERIMENT_PREFIX))
    return F.struct(
        F.when(is_xp, F.lit("xp")).otherwise(F.lit("engine")).alias("kind"),
        F.when(is_xp, F.substring(col, F.lit(len(EXPERIMENT_PREFIX) + 1), F.length(col))).otherwise(col).alias("name"),
    )


def class_property(col: Column) -> Column:
    """Name of a dataset class property without `ds.class.`; null for other names."""
    return F.when(
        F.startswith(col, F.lit(CLASS_PREFIX)), F.substring(col, F.lit(len(CLASS_PREFIX) + 1), F.length(col))
    )


#: What stands for false in an option.
FALSE_WORDS = ("0", "no", "false", "off")


def is_true(col: Column) -> Column:
    """Boolean option text; null when it is none of the known words."""
    word = F.lower(strip(col))
    return F.when(word.isin("1", "yes", "true", "on"), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def literal_array(values: Sequence) -> Column:
    """Driver values as one constant array; the caller has checked how many there are."""
    return F.array(*[F.lit(value) for value in values])
