"""A ledger of commits: what a batch leaves and the cursor it moves become visible together, once.

The tables of a commit are folders of its number, written before the commit counts; a
marker file, renamed into place, makes it count. A batch that fails half way leaves
folders without a marker, which nobody reads and its next run replaces; a batch that
runs again after its marker is there does nothing. A stream that writes through a
ledger so has every row once, whatever fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _markers(self) -> dict[int, str]:
        found = self._fs.globStatus(self._path(f"{self.folder}/commits/*.json")) or []
        return {int(s.getPath().getName().removesuffix(".json")): s.getPath().toString() for s in found}

    def _entry(self, path: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(path).collect()))  # one line

    def committed(self) -> list[int]:
        return sorted(self._markers())

    def cursor(self, default: object = None) -> object:
        """The cursor of the last commit."""
        markers = self._markers()
        return self._entry(markers[max(markers)])["cursor"] if markers else default

    def commit(self, number: int, tables: dict[str, DataFrame], cursor: object = None) -> bool:
        """Writes the tables of a batch and its cursor; False, and nothing is read or written, if that batch is committed."""
        if number in self._markers():
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/commit={number}")
        entry, made = json.dumps({"number": number, "tables": sorted(tables), "cursor": cursor}), self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(made)
        try:
            out.write(bytearray(entry.encode()))
        finally:
            out.close()
        if not self._fs.rename(made, self._path(f"{self.folder}/commits/{number}.json")):
            self._fs.delete(made, False)
            raise OSError(f"commit {number} could not be marked")
        return True

    def table(self, name: str, schema: str) -> DataFrame:
        """The rows of all commits, with the number of theirs as column commit; none before the first."""
        folders = [f"{self.folder}/{name}/commit={n}" for n in self.committed()]
        there = [f for f in folders if self._fs.exists(self._path(f))]
        reader = self.spark.read.schema(f"{schema}, commit long").option("basePath", f"{self.folder}/{name}")
        return reader.parquet(*there) if there else self.spark.createDataFrame([], f"{schema}, commit long")

    def writer(self, step: Callable[[DataFrame, object], tuple[dict[str, DataFrame], object]], default: object = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: step(rows, cursor) gives the tables and the new cursor of a batch."""

        def write(rows: DataFrame, number: int) -> None:
            if number not in self._markers():
                tables, cursor = step(rows, self.cursor(default))
                self.commit(number, tables, cursor)

        return write
