"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, also where Spark merges or moves the projection.

    Without it, an expression used inside a lambda may be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
