"""Positions, running sums and carried values along a total order, without one task seeing all rows.

A plain `Window.orderBy(..)` puts every row (or every row of a hot group) in one task. Here Spark range-partitions the
rows by group and order first, and they are written once, each with the number of its partition, to the shared folder.
Each range is numbered on its own, and what earlier ranges contribute comes from one small aggregate per range. Later
reads of the written ranges always see the same cut, also after an executor is lost.

The input is read up to three times (count, sample, write); an expensive one (a join, an aggregate) is best written out
first, see `session.cut_lineage`.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from trialgrid.session import scratch_path

#: Up to this many rows (for instance a list of parameter values) one sorted task is the cheaper plan.
ONE_TASK_ROWS = 500
#: Rows a range should hold, so that its sort fits a task (a larger one spills).
ROWS_PER_RANGE = 5_000_000
#: The range in which a cap is crossed is cut again while it has more rows than this.
CROSSING_ROWS = 1_000_000

RANGE = "__range"


def at_or_after(keys: Sequence[Column], bound: Sequence[Column]) -> Column:
    """Whether a key is at or after a boundary, column by column; null sorts first, as in `orderBy`."""
    key, edge = keys[0], bound[0]
    if len(keys) == 1:
        return F.coalesce(key >= edge, edge.isNull())
    beyond = F.coalesce(key > edge, key.isNotNull() & edge.isNull())
    return beyond | (key.eqNullSafe(edge) & at_or_after(keys[1:], bound[1:]))


def up_to(df: DataFrame, keys: Sequence[str], last: Row) -> Column:
    """Rows with a key up to and including `last`; the condition on the first key can be pushed to the scan."""
    types = dict(df.dtypes)
    columns = [F.col(name) for name in keys]
    parts = [F.lit(value).cast(types[name]) for name, value in zip(keys, last)]
    first = columns[0].isNull()
    if last[0] is not None:
        first = first | (columns[0] <= parts[0])
    if len(keys) == 1:
        return first
    same = reduce(and_, [column.eqNullSafe(part) for column, part in zip(columns, parts)])
    return first & (~at_or_after(columns, parts) | same)


def write_ranges(df: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """`df` cut into key ranges, written once; `__range` numbers them in key order, null keys first.

    Keys should be unique: rows with equal keys share a range.
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_ranges(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame | None:
    """The written ranges of `df`; None when its rows fit one task.

    `ranges` defaults to twice the shuffle partitions of the session, and to more for tables so large that a
    range would hold too many rows. Empty ranges are possible.
    """
    if ranges is None:
        rows = df.count()
        if rows <= ONE_TASK_ROWS:
            return None
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(2 * partitions, rows // ROWS_PER_RANGE)
    return write_ranges(df, keys, max(1, ranges))


def _along(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    inside: Callable[[object], dict[str, Column]],
    total: dict[str, Column],
    carried: Callable[[object], dict[str, Column]],
    combine: Callable[[str, Column, Column], Column],
    ranges: int | None,
) -> DataFrame:
    """Shared shape: cut, aggregate per range, carry over earlier ranges, finish inside each range."""
    ranged = cut_ranges(df, [*by, *order], ranges)
    if ranged is None:
        return df.select("*", *[c.alias(n) for n, c in inside(Window.partitionBy(*by).orderBy(*order)).items()])
    totals = ranged.groupBy(RANGE, *by).agg(*[c.alias(n) for n, c in total.items()])
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    names = list(carried(earlier))
    # A group reaches back only from the first group of a range: at most one row per range, so this is
    # bounded by the number of ranges whatever the number of groups.
    offsets = totals.select(
        F.col(RANGE).alias("__o_range"),
        *[F.col(name).alias(f"__o_{name}") for name in by],
        *[c.alias(f"__c_{n}") for n, c in carried(earlier).items()],
    ).filter(reduce(or_, [F.col(f"__c_{n}").isNotNull() for n in names]))
    local = inside(Window.partitionBy(RANGE, *by).orderBy(*order))
    placed = ranged.select("*", *[c.alias(n) for n, c in local.items()])
    same = placed[RANGE] == offsets["__o_range"]
    for name in by:
        same = same & placed[name].eqNullSafe(offsets[f"__o_{name}"])
    joined = placed.join(F.broadcast(offsets), same, "left")
    return joined.select(
        *[placed[name] for name in df.columns],
        *[combine(n, placed[n], offsets[f"__c_{n}"]).alias(n) for n in names],
    )


def ordinal(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "ordinal", ranges: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row, in all rows or in its `by` group. `by` + `order` must be unique."""
    return _along(
        df,
        by,
        order,
        inside=lambda w: {name: F.row_number().over(w).cast("bigint") - 1},
        total={"__total": F.count("*")},
        carried=lambda w: {name: F.sum("__total").over(w)},
        combine=lambda _, here, before: here + F.coalesce(before, F.lit(0).cast("bigint")),
        ranges=ranges,
    )


def exclusive_sum(
    df: DataFrame,
    order: Sequence[str],
    size: str,
    by: Sequence[str] = (),
    name: str = "size_before",
    ranges: int | None = None,
) -> DataFrame:
    """Add the sum of `size` over all earlier rows (0 for the first). `by` + `order` must be unique."""
    zero = F.lit(0).cast("bigint")
    return _along(
        df,
        by,
        order,
        inside=lambda w: {
            name: F.coalesce(
                F.sum(F.col(size).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero
            )
        },
        total={"__total": F.coalesce(F.sum(F.col(size).cast("bigint")), zero)},
        carried=lambda w: {name: F.sum("__total").over(w)},
        combine=lambda _, here, before: here + F.coalesce(before, zero),
        ranges=ranges,
    )


def running(
    df: DataFrame, order: Sequence[str], fns: Mapping[str, str], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Replace each column of `fns` by its sum, min, max or union of sketches over all rows up to and including each row.

    `by` + `order` must be unique.
    """
    over = {"sum": F.sum, "min": F.min, "max": F.max, "hll_union_agg": F.hll_union_agg}
    merge = {
        "hll_union_agg": lambda here, before: F.coalesce(F.hll_union(here, before), here, before),
        "sum": lambda here, before: F.coalesce(here + before, here, before),
        "min": F.least,
        "max": F.greatest,
    }
    rest = [name for name in df.columns if name not in fns]
    held = df.select(*rest, *[F.col(name).alias(f"__v_{name}") for name in fns])

    def upto(w):
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    result = _along(
        held,
        by,
        order,
        inside=lambda w: {name: over[fn](f"__v_{name}").over(upto(w)) for name, fn in fns.items()},
        total={f"__t_{name}": over[fn](f"__v_{name}") for name, fn in fns.items()},
        carried=lambda w: {name: over[fn](f"__t_{name}").over(w) for name, fn in fns.items()},
        combine=lambda name, here, before: merge[fns[name]](here, before),
        ranges=ranges,
    )
    return result.select(*df.columns)


def carry_forward(
    df: DataFrame,
    order: Sequence[str],
    values: Mapping[str, str],
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """For each new column -> value column, add the last non-null value at or before each row.

    `by` + `order` must be unique.
    """
    position = F.struct(*[F.col(key) for key in order])
    total = {
        f"__t_{name}": F.max_by(F.col(value), F.when(F.col(value).isNotNull(), position)) for name, value in values.items()
    }

    def upto(w):
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    return _along(
        df,
        by,
        order,
        inside=lambda w: {name: F.last(value, ignorenulls=True).over(upto(w)) for name, value in values.items()},
        total=total,
        carried=lambda w: {name: F.last(f"__t_{name}", ignorenulls=True).over(w) for name in values},
        combine=lambda _, here, before: F.coalesce(here, before),
        ranges=ranges,
    )


def capped_prefix(df: DataFrame, order: Sequence[str], size: str, cap: int | None, ranges: int | None = None) -> DataFrame:
    """The first rows in `order` while the total size before a row is below `cap`.

    The row that crosses the cap is kept. No cap, or 0, keeps everything; so does too little data, with a warning.
    Only the key and the size are read to find the crossing row; the result is then a filter on the key, which
    reaches the scan and needs no shuffle. The key must be unique; rows of one key that cannot be told apart are taken in
    any order, and all of them are kept if the cap is crossed among them.
    """
    if not cap:
        return df
    zero = F.lit(0).cast("bigint")
    left = df.select(*order, F.coalesce(F.col(size).cast("bigint"), zero).alias("__size"))
    before, previous = 0, None
    while (ranged := cut_ranges(left, order, ranges)) is not None:
        found = ranged.groupBy(RANGE).agg(F.sum("__size"), F.count("*")).collect()  # a row per range
        for number, total, rows in sorted(found):
            if before + total >= cap:
                break
            before += total
        else:
            return _too_little(df, before)
        left, ranges = ranged.filter(F.col(RANGE) == number).drop(RANGE), None
        if rows <= CROSSING_ROWS or rows == previous:  # rows of one key cannot be cut further
            break
        previous = rows
    running = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = left.withColumn("__before", F.coalesce(running, zero)).filter(F.col("__before") < cap - before)
    last, size_kept = kept.agg(F.max(F.struct(*order)), F.coalesce(F.sum("__size"), zero)).first()
    if before + size_kept < cap:
        return _too_little(df, before + size_kept)
    return df.filter(up_to(df, order, last))


def _too_little(df: DataFrame, real_size: int) -> DataFrame:
    warnings.warn(f"the data does not fill up to the desired size (real size = {real_size})", stacklevel=3)
    return df
