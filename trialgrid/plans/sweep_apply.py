"""A whole parameter grid over one table in one Spark job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.params import literal_array
from trialgrid.operators.grid import ParameterError
from trialgrid.operators.ordinal import running
from trialgrid.session import cut_lineage

#: Combinations whose results one pass over the table collects.
CHUNK = 200
#: Combinations up to which the aggregated cells, at most one per combination, are broadcast and finished in one task.
ONE_TASK_GRID = 10_000
#: Registers of a sketch of distinct values, as a power of two, and the standard error of its estimate.
SKETCH_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: Conditions that share one number, a bit each.
WORD_BITS = 62
#: Values up to which a list is counted through instead of searched.
SHORT_LIST = 16


@dataclass(frozen=True)
class Axis:
    """One parameter of the grid: rows belong to a value if `column op value` holds; op is >=, >, <=, < or ==."""

    name: str
    column: str
    op: str
    values: Sequence


@dataclass(frozen=True)
class Measure:
    """One result per combination: `fn` is count, sum, min, max or distinct of an expression.

    distinct is an estimate: cells keep HyperLogLog sketches, which merge along the axes like sums do, with a standard error
    of DISTINCT_ERROR. `sweep_apply_where` also knows count_distinct, which is exact.
    """

    name: str
    fn: str
    expr: Column | None = None


def _first(measure: Measure) -> Column:
    if measure.fn == "count":
        return F.count("*" if measure.expr is None else measure.expr)
    if measure.fn == "distinct":
        return F.hll_sketch_agg(measure.expr, SKETCH_BITS)
    return {"sum": F.sum, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[measure.fn](measure.expr)


def _ordered(axis: Axis) -> list:
    """Values from the most to the least demanding one, so that a row fits a value and all later ones."""
    return sorted(dict.fromkeys(axis.values), reverse=axis.op in (">=", ">"))


def _fits_any(axis: Axis, values: Sequence) -> Column:
    """Rows that fit at least the least demanding value: a plain comparison, which reaches the scan."""
    column, last = F.col(axis.column), F.lit(values[-1])
    return {
        ">=": lambda: column >= last,
        ">": lambda: column > last,
        "<=": lambda: column <= last,
        "<": lambda: column < last,
        "==": lambda: column.isin(*values),
    }[axis.op]()


def _fails(axis: Axis, value: Column) -> Column:
    column = F.col(axis.column)
    return {
        ">=": lambda: column < value,
        ">": lambda: column <= value,
        "<=": lambda: column > value,
        "<": lambda: column >= value,
    }[axis.op]()


def _first_fit(df: DataFrame, axes: Sequence[Axis], ordered: Sequence[Sequence], cells: Sequence[str]) -> DataFrame:
    """Add the position of the first value each row fits; rows that fit none are gone already.

    Short lists are counted through. Long ones take a binary search over a constant array, so that the work per
    row grows with the logarithm of the list.
    """
    short, long = [], []
    for axis, values, cell in zip(axes, ordered, cells):
        if axis.op == "==":
            short.append((F.array_position(literal_array(values), F.col(axis.column)).cast("int") - 1).alias(cell))
        elif len(values) <= SHORT_LIST:
            short.append(sum((_fails(axis, F.lit(v)).cast("int") for v in values[:-1]), F.lit(0)).alias(cell))
        else:
            long.append((axis, values, cell))
            short.append(F.lit(0).alias(cell))
    df = df.select("*", *short)
    for axis, values, cell in long:
        array, here = literal_array(values), F.col(cell)
        step = 1 << (len(values).bit_length() - 1)
        while step:
            fails = _fails(axis, F.get(array, here + (step - 1)))
            df = df.withColumn(cell, F.when(fails, here + step).otherwise(here))
            step >>= 1
    return df


def sweep_apply(df: DataFrame, axes: Sequence[Axis], measures: Sequence[Measure], limit: int | None = None) -> DataFrame:
    """One result row per combination of the axis values, also for combinations without rows.

    Every row falls into one cell: on each axis, the first value it fits. The table is read once and aggregated
    by cell, with partial aggregates before the shuffle, so rows are never multiplied by combinations. A
    combination is the sum of the cells up to its own on each axis, taken by running sums over the cells.
    """
    ordered = [_ordered(axis) for axis in axes]
    sizes = [len(values) for values in ordered]
    combinations = prod(sizes)
    if limit is not None and combinations > limit:
        raise ParameterError(f"{combinations} combinations are more than the limit of {limit}")
    cells = [f"__cell{i}" for i in range(len(axes))]
    fitting = df.filter(reduce(and_, [_fits_any(axis, values) for axis, values in zip(axes, ordered)]))
    placed = _first_fit(fitting, axes, ordered, cells)
    found = placed.groupBy(*cells).agg(*[_first(m).alias(m.name) for m in measures])

    # All combinations by their digits. A small grid is finished in one task, a large one in as many as it needs.
    spark = df.sparkSession
    grid = spark.range(0, combinations, 1, 1) if combinations <= ONE_TASK_GRID else spark.range(combinations)
    digits, stride = [], 1
    for cell, size in zip(cells, sizes):
        digits.append((F.call_function("div", F.col("id"), F.lit(stride).cast("bigint")) % size).cast("int").alias(cell))
        stride *= size
    one_task = combinations <= ONE_TASK_GRID
    result = grid.select(*digits).join(F.broadcast(found) if one_task else found, cells, "left")
    merges = {m.name: {"count": "sum", "distinct": "hll_union_agg"}.get(m.fn, m.fn) for m in measures}
    for axis, cell in zip(axes, cells):
        if axis.op == "==":
            continue
        others = [other for other in cells if other != cell]
        if one_task:
            upto = Window.partitionBy(*others).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            sums = [F.expr(f"{fn}(`{name}`)").over(upto).alias(name) for name, fn in merges.items()]
            result = result.select(*cells, *sums)
        else:
            # Written out before each axis, since its running sums take several passes.
            result = running(cut_lineage(result), [cell], merges, by=others)
    names = [F.get(literal_array(values), F.col(cell)).alias(axis.name) for axis, cell, values in zip(axes, cells, ordered)]
    shown = {m.name: F.hll_sketch_estimate(m.name) if m.fn == "distinct" else F.col(m.name) for m in measures}
    filled = [
        (F.coalesce(shown[m.name], F.lit(0).cast("bigint")) if m.fn in ("count", "distinct") else shown[m.name]).alias(m.name)
        for m in measures
    ]
    return result.select(*names, *filled)


def sweep_apply_where(
    df: DataFrame, grid: Sequence[Mapping[str, object]], condition, measures: Sequence[Measure]
) -> DataFrame:
    """The same for a condition that is no threshold per parameter: `condition(combination) -> Column`.

    Also combinations without rows are returned. Each one is an aggregate with its condition, so rows are neither paired
    nor multiplied, and a pass over the table yields one short row per task for CHUNK combinations. Exact distinct counts
    take a pass each: every value is one group that keeps, in bits, which combinations it occurs in.
    """
    spark = df.sparkSession
    exact = [measure for measure in measures if measure.fn == "count_distinct"]
    plain = [measure for measure in measures if measure.fn != "count_distinct"]
    parts = []
    for start in range(0, len(grid), CHUNK):
        found, conditions = [], []
        for combination in grid[start : start + CHUNK]:
            values = {name: F.lit(value) for name, value in combination.items()}
            inside = condition(values)
            conditions.append(inside)
            results = [_first(_only(measure, inside)).alias(measure.name) for measure in plain]
            found.append(F.struct(*[value.alias(name) for name, value in values.items()], *results))
        rows = (df if plain or not exact else spark.range(1)).agg(F.array(*found).alias("__found"))
        rows = rows.select(F.posexplode("__found").alias("__at", "__one"))
        for i, measure in enumerate(exact):
            counts = _distinct_counts(df, measure, conditions, f"__at{i}", f"__distinct{i}")
            rows = rows.join(counts, F.col("__at") == F.col(f"__at{i}"))
        counted = {measure.name: F.col(f"__distinct{i}").alias(measure.name) for i, measure in enumerate(exact)}
        names = [*grid[start], *[measure.name for measure in measures]]
        parts.append(rows.select(*[counted[name] if name in counted else F.col("__one")[name].alias(name) for name in names]))
    estimated = {m.name: F.hll_sketch_estimate(m.name) for m in measures if m.fn == "distinct"}
    return reduce(DataFrame.union, parts).withColumns(estimated) if parts else spark.createDataFrame([], "n bigint")


def _distinct_counts(df: DataFrame, measure: Measure, conditions: Sequence[Column], at: str, name: str) -> DataFrame:
    """(at, name): for each condition by its place, how many distinct values the rows inside have; nulls do not count.

    Spark's own distinct counts would copy every row once per condition before the shuffle.
    """
    value = F.lit(1) if measure.expr is None else measure.expr
    words = []
    for start in range(0, len(conditions), WORD_BITS):
        shared = conditions[start : start + WORD_BITS]
        bits = [F.when(inside, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, inside in enumerate(shared)]
        words.append(reduce(Column.bitwiseOR, bits).alias(f"__word{len(words)}"))
    held = df.select(F.when(reduce(or_, conditions), value).alias("__value"), *words).filter(F.col("__value").isNotNull())
    groups = held.groupBy("__value").agg(*[F.bit_or(f"__word{i}").alias(f"__word{i}") for i in range(len(words))])
    counts = []
    for i in range(len(conditions)):
        word, bit = divmod(i, WORD_BITS)
        counts.append(F.count(F.when(F.col(f"__word{word}").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0, 1)))
    return groups.agg(F.array(*counts).alias("__counts")).select(F.posexplode("__counts").alias(at, name))


def _only(measure: Measure, inside: Column) -> Measure:
    """The measure over the rows inside."""
    expr = F.lit(1) if measure.expr is None else measure.expr
    return Measure(measure.name, measure.fn, F.when(inside, expr))
