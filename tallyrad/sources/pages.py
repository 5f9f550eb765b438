"""A remote table read page by page: a partition for each range of keys, tried again where a page fails, and swapped
in only if all rows came."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.snapshots import Change, Snapshot, Warehouse
from ..operators.staging import cut


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class Incomplete(Exception):
    """Fewer or more rows came than the remote table has."""


def paged(
    spark: SparkSession, fetch: Callable[[int, int], list[tuple]], schema: str, low: int, high: int, size: int = 1000, pages_per_task: int = 8,
    tries: int = 4, wait: float = 0.5,
) -> DataFrame:
    """Rows whose key is from `low` to below `high`.

    fetch: rows of a range of keys, from the first to below the second; it runs on the executors and is asked for
    `size` keys at once. Ranges of keys, unlike limits and offsets, neither skip nor repeat a row if others are
    added or go meanwhile. A page that fails is asked for again, `tries` times in all, each time after a longer wait;
    then the task fails, and Spark runs it again. The rows of a page are handed on only once all of them are there.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[Range]:
            step = size * pages_per_task
            return [Range(at, min(at + step, high)) for at in range(low, high, step)]

        def read(self, partition: Range) -> Iterator[tuple]:
            for at in range(partition.low, partition.high, size):
                for k in range(tries):
                    try:
                        rows = list(fetch(at, min(at + size, partition.high)))
                        break
                    except Exception:
                        if k + 1 == tries:
                            raise
                        time.sleep(wait * 2**k)
                yield from rows

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader()

    name = f"pages_{uuid.uuid4().hex}"
    spark.dataSource.register(Pages)
    return spark.read.format(name).load()


def replace_if_whole(warehouse: Warehouse, table: str, rows: DataFrame, expected: int, key: str, **metadata: DataFrame) -> Snapshot:
    """Puts the rows in the place of a table, together with rows of further tables, if there are `expected` of them
    with as many keys; else the table stays as it was and Incomplete is raised."""
    rows = cut(rows)
    n, keys = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if (n, keys) != (expected, expected):
        raise Incomplete(f"{table}: {n} rows and {keys} keys came of {expected}")
    return warehouse.commit({table: Change(rows, None, "all")} | {name: Change(df) for name, df in metadata.items()})
