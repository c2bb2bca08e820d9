"""A training corpus from raw documents: five stages, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, jaccard_join, mixing, packing
from sparkloom.llm import quality as machine
from sparkloom.llm.common import by_place, made, release, scanned, session, unused, written

#: Words of a shingle and least similarity, in per cent, of near duplicates; those of op10 are its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels of other documents are not used; without any label all stay.

    Null and empty texts are scored as the empty text; rows that repeat are scored alike; an empty table stays empty.
    """
    session(spark)
    return machine.accepted(docs, machine.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one: that with the least doc_id, null last, and of those with that id one.

    A row without words, null texts included, stays; repeated rows are linked, ids do not count; an empty table stays empty.
    """
    docs = scanned(session(spark) and docs)
    dropped = written(jaccard_join.copies(docs, NEAR_WORDS, NEAR_PERCENT), "dropped")
    return by_place(docs, dropped, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain an item of the benchmark. Rows without words stay; ids do not count; an empty table stays empty."""
    docs = scanned(session(spark) and docs)
    found = decontamination.contaminated_places(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return by_place(docs, written(found, "contaminated"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice; rows of the same doc_id, or without one, are rows of their own.

    A row without words is taken as its place in its source has it; a null source is a source; an empty table stays empty.
    """
    docs, n = scanned(session(spark) and docs), unused(docs, "copies")
    taken = written(mixing.mix(docs, placed=True).filter("copies > 0").select("file", "row", F.col("copies").alias(n)), "taken")
    both = by_place(docs, taken, "inner", n)
    return both.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids. A null text is an empty document; rows that repeat are packed each; an empty table gives no rows."""
    return packing.pack(session(spark) and docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix), ("token-ID / binary output", pack)]

#: The classifier and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables that a stage wrote for itself are deleted when its result is written, and then its input."""
    began, docs = made(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
        release(spark, began, keep=1)
    return docs
