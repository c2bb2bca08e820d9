"""Structured Streaming forms of the incremental reads, duplicates, windows and keyed states."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A table as a stream of its files; timestamps without a zone are UTC."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    single = spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(f"/{name}")
    rows = stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes))


def drained(stream: DataFrame, mode: str, folder: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the stream over what there is, then reads its result. In update mode later rows follow earlier ones of a key."""
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append" if mode == "append" else "overwrite").parquet(f"{at}/{'out' if mode != 'update' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{at}/out" if mode != "update" else at)
    return shape(out) if shape else out.drop("_batch")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key. The state keeps every key: files come in any order, so no key is ever over."""
    return stream.dropDuplicates(keys)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _in_order(state: GroupState, frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows that the state keeps and the new ones; rows that tie stay as they came."""
    kept = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    return pd.concat([*kept, *(f for f in frames if len(f))], ignore_index=True).sort_values(order, kind="stable")


def tumbling_counts(stream: DataFrame, time: str, width: str, by: str) -> DataFrame:
    return stream.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def session_counts(stream: DataFrame, time: str, gap: str, by: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), by, "n")


def decayed_scores(stream: DataFrame, key: str, order: list[str], gain: str, decay: float = 0.9) -> DataFrame:
    """Keyed score max(0, score * decay + gain) over all rows so far in order. A late row moves all that follow, so the state keeps a key's rows."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, score = _in_order(state, frames, order), 0.0
        for g in rows[gain]:
            score = max(0.0, score * decay + g)
        state.update((_packed(rows[[*order, gain]]),))
        yield pd.DataFrame({key: [k[0]], "score": [score], "passes": [len(rows)]})

    rows = stream.select(key, *dict.fromkeys([*order, gain]))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, score double, passes long", "rows binary", "update", GroupStateTimeout.NoTimeout)


def backoff_states(stream: DataFrame, key: str, order: list[str], at: str, blocked: str, base: float, cap: float, threshold: int, quarantine: float, reprobe: float) -> DataFrame:
    """Keyed failures in a row with the times until which the key rests, is in quarantine and waits for a trial; a success resets all.

    A late success may part the failures, so the state keeps the last success and the failures after it, in order.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = _in_order(state, frames, order), (0, 0.0, 0.0, 0.0)
        good = np.flatnonzero(~rows[blocked].to_numpy(bool))
        rows = rows.iloc[good[-1] if len(good) else 0 :]
        for t, bad in zip(rows[at], rows[blocked]):
            fails = now[0] + 1
            held = 0 < threshold <= fails
            now = (fails, t + min(base * 2 ** (fails - 1), cap), t + quarantine if held else now[2], t + reprobe if held else now[3]) if bad else (0, 0.0, 0.0, 0.0)
        state.update((_packed(rows[kept]),))
        yield pd.DataFrame([(k[0], *now)], columns=[key, "fails", "cooldown_until", "quarantined_until", "next_reprobe_at"])

    kept = list(dict.fromkeys([*order, at, blocked]))
    rows = stream.select(key, *kept)
    made = f"{key} long, fails long, cooldown_until double, quarantined_until double, next_reprobe_at double"
    return rows.groupBy(key).applyInPandasWithState(step, made, "rows binary", "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of update-mode results the last of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "_batch"))), "_batch").alias("x")).select(key, "x.*")
