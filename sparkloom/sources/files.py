"""Tolerant readers of JSON lines, robots files and sitemaps, and writers of snapshots."""

from __future__ import annotations

import gzip
import uuid
from urllib import robotparser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str, defaults: dict | None = None) -> DataFrame:
    """Rows of the schema; missing keys get their default, lines that are no JSON are left out, a path that is not there has no rows."""
    fields = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    kept = StructType.fromDDL(f"{fields}, _bad string") if isinstance(schema, str) else StructType([*schema.fields]).add("_bad", "string")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where):
        return spark.createDataFrame([], StructType([f for f in kept.fields if f.name != "_bad"]))
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull()).drop("_bad").fillna(defaults or {})


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document {key: state} as rows (key, state)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>")).alias("key", "state")).select("key", "state.*")


def robots(text: str, agent: str = "*") -> tuple[robotparser.RobotFileParser, float | None, list[str]]:
    """Rules, crawl delay and sitemaps; an empty file allows everything."""
    rules = robotparser.RobotFileParser()
    rules.parse(text.splitlines())
    delay = rules.crawl_delay(agent)
    return rules, float(delay) if delay else None, rules.site_maps() or []


def sitemap_locations(body: bytes) -> tuple[str, list[str]]:
    """Kind of a sitemap, index or urlset, and its locations in order, whatever the namespace; unreadable ones are empty."""
    try:
        root = ElementTree.fromstring(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    except (ElementTree.ParseError, OSError, EOFError):
        return "urlset", []
    local = lambda e: e.tag.rpartition("}")[2]
    kind = "index" if local(root) == "sitemapindex" else "urlset"
    return kind, [e.text.strip() for e in root.iter() if local(e) == "loc" and e.text]


def _store(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def _rename(fs, at, to) -> bool:
    return bool(fs.rename(at, to))


def recover_state(spark: SparkSession, path: str) -> bool:
    """Puts back the state that a save which was cut off had moved aside; whether there is a state at path."""
    fs, make = _store(spark, path)
    where = make(path.rstrip("/"))
    aside = fs.globStatus(make(f"{path.rstrip('/')}.*.old")) or []
    if fs.exists(where):
        for left in aside:  # the new state was in place, only this was still to go
            fs.delete(left.getPath(), True)
        return True
    newest = max(aside, key=lambda s: s.getModificationTime(), default=None)
    if newest is not None and not _rename(fs, newest.getPath(), where):
        raise OSError(f"could not put back {newest.getPath()}")
    return newest is not None


def save_state(df: DataFrame, path: str) -> None:
    """df as JSON lines at path, all of it or, if the write fails at any step, what was there before.

    A file system without an atomic exchange of folders has an instant in which nothing is
    at path; a save that is cut off there is put right by the next save, or by load_state.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, make = _store(spark, path)
    recover_state(spark, path)
    new = f"{path}.{uuid.uuid4().hex}"
    where, fresh, old = make(path), make(new), make(f"{new}.old")
    df.write.json(new)
    had = fs.exists(where)
    if had and not _rename(fs, where, old):
        fs.delete(fresh, True)
        raise OSError(f"could not move {path} aside")
    if not _rename(fs, fresh, where):
        if had and not _rename(fs, old, where):
            raise OSError(f"could not put {path} back; it is at {old}")
        fs.delete(fresh, True)
        raise OSError(f"could not put the new state at {path}")
    if had:
        fs.delete(old, True)


def load_state(spark: SparkSession, path: str, schema: StructType | str, defaults: dict | None = None) -> DataFrame:
    """What save_state left at path, see json_lines; a save that was cut off counts as not done."""
    recover_state(spark, path)
    return json_lines(spark, path, schema, defaults)


def snapshot(df: DataFrame, folder: str, keep: int = 7) -> str:
    """Writes a new snapshot folder and removes all but the newest `keep`; readers take the greatest name."""
    spark = df.sparkSession
    stamp = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    path = f"{folder.rstrip('/')}/{stamp}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for old in sorted((s.getPath() for s in fs.listStatus(where) if s.isDirectory()), key=lambda p: p.getName(), reverse=True)[keep:]:
        fs.delete(old, True)
    return path
