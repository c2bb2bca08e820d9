"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named, one of this machine, if that is the whole cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/sparkloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Tables that written made and release has not deleted.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage is cut and a lost executor costs nothing done before."""
    path = new_path(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables there are between steps; see release."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written after the first since ones. Results that read them end with them, so write these first."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _made[since:]:
        make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(make(path), True)
    del _made[since:]
