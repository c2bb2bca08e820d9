"""Shared places, tables written between steps, and checked broadcasts."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_folder

__all__ = ["appended", "by_place", "documents", "few", "join_counted", "made", "places", "release", "scanned", "session", "shared_folder", "unused", "written"]

#: Python workers give large freed blocks back to the system at once, so that an idle worker holds little.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}
#: Texts go to Python workers in batches of about so many bytes, where the session has not been told otherwise.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 64 << 20
#: Rows of a few narrow columns that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than the larger of HOT_ROWS and all rows over HOT_KEYS is hot.
HOT_ROWS, HOT_KEYS = 256, 10_000


def session(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds their batches; settings that are given stay."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if spark.conf.get(BATCH, str(BATCH_DEFAULT)).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


_made: list[str] = []


def _new_path(spark: SparkSession, name: str) -> str:
    _made.append(new_path(spark, name))
    return _made[-1]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, a folder for each value of the column by: the lineage is cut and a lost executor costs nothing done before."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of frames of one schema as one table, each written before the next is made."""
    path = schema = spark = None
    for part in parts:
        spark, schema, path = part.sparkSession, part.schema, path or _new_path(part.sparkSession, name)
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def made() -> int:
    """How many tables have been written; see release."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written after the first since ones, but for the last keep. Frames that read them end with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in (gone := _made[since : len(_made) - keep]):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _made[:] = [x for x in _made if x not in set(gone)]


def few(df: DataFrame) -> bool:
    """Whether df, a written table of narrow rows, may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def scanned(docs: DataFrame) -> DataFrame:
    """docs as rows of Parquet files: as it is if it is a table that was read and no more, without columns in folder names, else written."""
    plan = docs._jdf.queryExecution().analyzed()
    plain = plan.nodeName().startswith("LogicalRelation") and docs.inputFiles() and plan.relation().partitionSchema().isEmpty()
    return docs if plain else written(docs, "rows")


def places(docs: DataFrame) -> list[Column]:
    """file and row, two numbers that name a row of a scanned table."""
    found = docs.metadataColumn("_metadata")
    return [F.xxhash64(found["file_path"]).alias("file"), found["row_index"].alias("row")]


def by_place(docs: DataFrame, chosen: DataFrame, how: str, value: str | None = None, placed: bool = False) -> DataFrame:
    """The rows of a scanned table that a written table (file, row) names (left_semi) or does not (left_anti); inner adds its column value, placed file and row.

    Up to BROADCAST_ROWS rows of chosen are broadcast. Where they are more, files are
    read in groups, each with its own rows of chosen, so that none of docs is shuffled:
    a group has so many at most, or is one file, whose rows bound them.
    """
    spark, mine = docs.sparkSession, [unused(docs, "file"), unused(docs, "row")]
    extra = [value] if value else []

    def joined(part: DataFrame, some: DataFrame) -> DataFrame:
        some = some.select(F.col("file").alias(mine[0]), F.col("row").alias(mine[1]), *extra)
        named = part.select("*", *(c.alias(m) for c, m in zip(places(part), mine)))
        return named.join(F.broadcast(some), mine, how).select(*docs.columns, *extra, *(mine if placed else ()))

    if few(chosen):
        return joined(docs, chosen)
    files = [r[0] for r in docs.select(docs.metadataColumn("_metadata")["file_path"].alias("f")).distinct().collect()]
    names = {r[1]: r[0] for r in spark.createDataFrame([(f,) for f in files], "f string").select("f", F.xxhash64("f")).collect()}
    counts = {r[0]: r[1] for r in chosen.groupBy("file").count().collect()}  # one row a file
    groups, held = [[]], 0
    for file in sorted(names):
        held += counts.get(file, 0)
        if held > BROADCAST_ROWS and groups[-1]:
            groups.append([])
            held = counts.get(file, 0)
        groups[-1].append(file)
    path = _new_path(spark, "by-place")
    for group in groups:
        part = spark.read.schema(docs.schema).parquet(*(unquote(names[f]) for f in group))
        out = joined(part, chosen.filter(F.col("file").isin(group)))
        out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """left joined with right, a written table that has every key once and under count how many rows of left have it.

    Keys of very many rows are broadcast, at most HOT_KEYS of them, so no task holds such a group.
    """
    total, most = right.agg(F.sum(count), F.max(count)).first()
    heavy = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= heavy:
        return left.join(right, keys)
    hot = F.broadcast(right.filter(F.col(count) > heavy))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(count) <= heavy), keys)
    return left.join(hot, keys).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/documents.parquet")
