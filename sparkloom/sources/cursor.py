"""A table as a stream whose offset is a cursor: the largest key read so far; what is greater is new."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class KeyRange(InputPartition):
    """Keys over low, up to high."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.key = options["path"], options["cursor"]
        self.first, self.parts = int(options.get("after", str(-(1 << 63)))), int(options.get("partitions", "8"))
        self.names = schema.fieldNames()

    def _table(self) -> ds.Dataset:
        return ds.dataset(self.path.removeprefix("file://").removeprefix("file:"), format="parquet", exclude_invalid_files=False)

    def _ends(self) -> tuple[int, int] | None:
        """The least and the greatest key there is, by the statistics of row groups; a group without them is read, its key column only."""
        ends: list[int] = []
        for fragment in self._table().get_fragments():
            for group in fragment.split_by_row_group():
                known = (group.row_groups[0].statistics or {}).get(self.key)
                if known is None or known.get("min") is None:
                    keys = group.to_table(columns=[self.key]).column(0).drop_null()
                    ends += [pa.compute.min(keys).as_py(), pa.compute.max(keys).as_py()] if len(keys) else []
                else:
                    ends += [known["min"], known["max"]]
        return (min(ends), max(ends)) if ends else None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"cursor": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = self._ends()
        return {"cursor": max(self.first, ends[1]) if ends else self.first}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        ends, high = self._ends(), end["cursor"]
        low = max(start["cursor"], ends[0] - 1) if ends else high
        if low >= high:
            return []
        n = min(self.parts, high - low)
        cuts = [low + (high - low) * i // n for i in range(n + 1)]
        return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        key = ds.field(self.key)
        yield from self._table().to_batches(columns=self.names, filter=(key > partition.low) & (key <= partition.high))


class CursorSource(DataSource):
    """format("cursor"): options path, cursor (an integer column), after (the first cursor), partitions (ranges of keys a batch).

    A batch is what is greater than the last one's cursor, by ranges of keys; rows with a null key are
    never new. Files must be readable by every executor under the same path or an object-store URI.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def streamReader(self, schema: StructType) -> CursorReader:  # noqa: N802
        return CursorReader(schema, dict(self.options))


def cursor_stream(spark: SparkSession, path: str, cursor: str, schema: StructType | str, after: int | None = None, partitions: int = 8):
    """The rows of a table of Parquet files over a cursor, as a stream; a query's checkpoint keeps the cursor."""
    spark.dataSource.register(CursorSource)
    reader = spark.readStream.format("cursor").schema(schema).option("path", path).option("cursor", cursor).option("partitions", partitions)
    return (reader if after is None else reader.option("after", after)).load()
