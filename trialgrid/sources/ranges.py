"""Dataset classes as data sources: rows made from ranges of a key, which filters on the key narrow before anything is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Keys of a batch.
BATCH = 1 << 14
#: Lets Spark hand filters to data sources; read when a query is planned.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

Rows = Callable[[int, int], pa.RecordBatch]


@dataclass
class KeyRange(InputPartition):
    """The keys from `start` up to, and without, `end`."""

    start: int
    end: int


class RangeReader(DataSourceReader):
    def __init__(self, key: str, rows: Rows, low: int, high: int, parts: int):
        self.key, self.rows, self.low, self.high, self.parts = key, rows, low, high, max(1, parts)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key with a whole number narrow the range; all others are Spark's."""
        for one in filters:
            known = getattr(one, "attribute", None) == (self.key,) and type(getattr(one, "value", None)) is int
            if known and isinstance(one, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, one.value + isinstance(one, GreaterThan))
            elif known and isinstance(one, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, one.value + isinstance(one, LessThanOrEqual))
            elif known and isinstance(one, EqualTo):
                self.low, self.high = max(self.low, one.value), min(self.high, one.value + 1)
            else:
                yield one

    def partitions(self) -> list[KeyRange]:
        size = max(0, self.high - self.low)
        cuts = [self.low + size * i // self.parts for i in range(self.parts + 1)]
        return [KeyRange(start, end) for start, end in zip(cuts, cuts[1:]) if start < end] or [KeyRange(self.low, self.low)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        for start in range(partition.start, partition.end, BATCH):
            yield self.rows(start, min(start + BATCH, partition.end))


def register_source(spark: SparkSession, name: str, schema: str, key: str, rows: Rows) -> None:
    """Make `rows(start, end)`, the rows of some keys as an Arrow batch, known to `spark.read.format(name)`.

    The options `low`, `high` (exclusive) and `parts` give the keys and the number of tasks; filters on `key` reach the source.
    Rows of a key must not depend on the range they are asked in, so a lost task can be made again.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return RangeReader(key, rows, *(int(self.options.get(o, d)) for o, d in (("low", 0), ("high", 0), ("parts", 1))))

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Source)


def read_source(spark: SparkSession, name: str, low: int, high: int, parts: int) -> DataFrame:
    """The rows of a registered source for the keys from `low` up to, and without, `high`."""
    return spark.read.format(name).options(low=low, high=high, parts=parts).load()
