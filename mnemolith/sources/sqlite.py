"""A table of a SQLite file as a partitioned source: `spark.read.format("sqlite_table")`.

Register once with `register(spark)`. Options: path; table; key, the integer column whose range is split
(default id); partitions (default 8). The file must be readable where the executors run.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_NAME = re.compile(r"[A-Za-z_]\w*\Z")


@dataclass
class Range(InputPartition):
    """Keys from `low` up to, but without, `high`; open ends are None. Rows without a key are in the first range."""

    low: int | None
    high: int | None


def _quoted(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a plain name: {name!r}")
    return f'"{name}"'


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        """Memory stores by default; any other table needs `.schema(...)`."""
        return "id bigint, kind string, payload string, created_at string, source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.key = options["path"], _quoted(options.get("table", "memory")), _quoted(options.get("key", "id"))
        self.count = max(1, int(options.get("partitions", "8")))
        self.columns = ", ".join(_quoted(f.name) for f in schema.fields)

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            low, high = db.execute(f"select min({self.key}), max({self.key}) from {self.table}").fetchone()
        if low is None or self.count == 1:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.count))
        cuts = list(range(low + step, high + 1, step))
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, values = [], []
        if partition.low is not None:
            where.append(f"{self.key} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            where.append(f"{self.key} < ?" if partition.low is not None else f"({self.key} < ? or {self.key} is null)")
            values.append(partition.high)
        query = f"select {self.columns} from {self.table}" + (f" where {' and '.join(where)}" if where else "") + f" order by {self.key}"
        with self._connect() as db:
            yield from db.execute(query, values)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
