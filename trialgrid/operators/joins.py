"""Equality joins in which null keys match each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, broadcast: bool = False) -> DataFrame:
    """Join on all `keys` with null-safe equality; the keys of the right side are dropped from the result."""
    renamed = right.select(
        *[F.col(f"`{key}`").alias(f"__r_{key}") for key in keys],
        *[F.col(f"`{name}`") for name in right.columns if name not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"`{key}`").eqNullSafe(F.col(f"`__r_{key}`"))
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])
