"""Keyed state in event time that ends.

A key's history is folded by ranges of event time. Rows of a range are kept only
while it is open; when the watermark passes its end a timer folds them into a few
numbers that say what the range does to whatever state came before. Such pieces
compose, so what is left of a key is one piece, however long its history. Ranges of
one key are groups of their own, so a key of very many rows is many groups. Rows
that come after their range was folded are not lost: they are records of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from ..storage import new_path

#: Groups that the keys of one range are dealt into.
SHARDS = 16
#: Groups that the keys are dealt into for what stands of them.
STANDING_SHARDS = 128
#: State partitions for groups as few as these; each costs every batch its start and commit, rows or not.
STATES = 32
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_store(spark: SparkSession, states: int | None = None) -> Iterator[None]:
    """While a query starts, the session names the state store that transformWithState needs, with states partitions at most; then it has its own settings again."""
    named = dict(_STORE)
    if states:
        named["spark.sql.shuffle.partitions"] = str(min(states, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(spark: SparkSession, at: str):
    """The file system of a path, and what makes its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def moved(spark: SparkSession, at: str, to: str) -> bool:
    """Renames a folder of the shared store; False where there is none."""
    fs, path = _files(spark, at)
    if not fs.exists(path(at)):
        return False
    if not fs.rename(path(at), path(to)):
        raise OSError(f"could not move {at} to {to}")
    return True


def in_order(rows: DataFrame, batch: str, batches: int, build: Callable[[DataFrame], DataFrame], mode: str = "append", write: Callable[[DataFrame, int], None] | None = None, states: int | None = None) -> DataFrame | None:
    """What build makes of the rows as a stream, fed batch after batch (column batch, 0 to batches - 1); a column _epoch numbers the writes.

    A write is a folder of its number, so one that runs again replaces itself. With a write of the caller's own there is no result.
    State has as many partitions as the session shuffles into, states at most.
    """
    spark, root = rows.sparkSession, new_path(rows.sparkSession, "stream")
    rows.write.partitionBy(batch).parquet(f"{root}/staged")
    fs, path = _files(spark, root)
    fs.mkdirs(path(f"{root}/feed"))
    made = build(spark.readStream.schema(rows.schema).parquet(f"{root}/feed"))

    def kept(out: DataFrame, epoch: int) -> None:
        out.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    with state_store(spark, states):
        query = made.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write or kept).start()
    try:
        for number in range(batches):
            if moved(spark, f"{root}/staged/{batch}={number}", f"{root}/feed/{batch}={number}"):
                query.processAllAvailable()
    finally:
        query.stop()
    if write:
        return None
    schema = made.withColumn("_epoch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/out")


def with_end(rows: DataFrame, batch: str, batches: int, time: str) -> DataFrame:
    """rows and, after the last batch, one row of nulls at a time far ahead, behind which every window and range closes."""
    end = rows.sparkSession.range(1).select(F.lit(batches).cast(rows.schema[batch].dataType).alias(batch), F.lit("2200-01-01").cast(rows.schema[time].dataType).alias(time))
    return rows.unionByName(end, allowMissingColumns=True)


def in_time(rows: DataFrame, time: str) -> DataFrame:
    """rows with a time that a watermark can stand on; one without a zone is taken in the session's, UTC in this library."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def latest_ms(rows: DataFrame, batch: str, time: str) -> int:
    """How many milliseconds, rounded up, the latest row of a batch is behind the rows of the batches before; 0 if none is."""
    ends = in_time(rows, time).groupBy(batch).agg(F.min(time).alias("least"), F.max(time).alias("most"))
    before = F.max("most").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))  # a row for each batch
    behind = F.unix_micros(before) - F.unix_micros("least")
    return max(0, -(-(ends.select(behind.alias("b")).agg(F.max("b")).first()[0] or 0) // 1000))


# ---- what a run of rows does to a state; lift is of one run, after and result are of numbers or of arrays of them ----
@dataclass(frozen=True)
class Decayed:
    """score -> max(0, score * decay + value) for each row. As a piece: score -> max(low, score * by + more)."""

    decay: float
    results = "score double"

    def lift(self, at: np.ndarray, value: np.ndarray) -> tuple[float, ...]:
        low, by, more = -1e300, 1.0, 0.0
        for g in value.tolist():
            low, by, more = max(0.0, low * self.decay + g), by * self.decay, more * self.decay + g
        return low, by, more

    def after(self, a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
        return np.maximum(b[0], a[0] * b[1] + b[2]), a[1] * b[1], a[2] * b[1] + b[2]

    def result(self, a: tuple[float, ...]) -> tuple:
        return (np.maximum(a[0], a[2]),)


@dataclass(frozen=True)
class Backoff:
    """Failures in a row (value over 0) and the times, in seconds, until which a key rests, is in quarantine and waits for a trial.

    As a piece: whether there was a success, the failures behind it, the last of them, and the last that was held.
    """

    base: float
    cap: float
    threshold: int
    quarantine: float
    reprobe: float
    results = "fails long, cooldown_until double, quarantined_until double, next_reprobe_at double"

    def lift(self, at: np.ndarray, value: np.ndarray) -> tuple[float, ...]:
        good = np.flatnonzero(~(value > 0))
        reset = bool(len(good))
        behind = at[good[-1] + 1 :] if reset else at
        n, last = len(behind), float(behind[-1]) / 1000 if len(behind) else -1.0
        return float(reset), float(n), last, last if reset and 0 < self.threshold <= n else -1.0

    def after(self, a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
        n, more = a[1] + b[1], np.not_equal(b[1], 0)
        last = np.where(more, b[2], a[2])
        held = np.where(more & self._held(n), last, a[3])
        return tuple(np.where(b[0], y, x)[()] for x, y in zip((a[0], n, last, held), b))

    def result(self, a: tuple[float, ...]) -> tuple:
        n, some = np.asarray(a[1]), np.not_equal(a[1], 0)
        # what nothing came before is as if a success had
        held = np.where(self._held(n), a[2], a[3])
        rest = np.where(some, a[2] + np.minimum(self.base * 2.0 ** np.minimum(n - 1, 1000), self.cap), 0.0)
        return n.astype(np.int64)[()], rest[()], *(np.where(some & (held >= 0), held + wait, 0.0)[()] for wait in (self.quarantine, self.reprobe))

    def _held(self, n: np.ndarray) -> np.ndarray:
        return (0 < self.threshold) & np.less_equal(self.threshold, n)


def _packed(rows: pd.DataFrame) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


_RANGE_OUT = "key long, record string, range long, n long, at long, tie long, value double, piece array<double>"


class Ranges(StatefulProcessor):
    """The open rows of the keys of one shard in one range of time; a timer at its end folds them, a row for each key."""

    def __init__(self, fold: Decayed | Backoff, width: int):
        self.fold, self.width = fold, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", StructType().add("some", BinaryType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        end = (int(key[1]) + 1) * self.width
        late = end <= timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[frame["tie"].notna()][["key", "at", "tie", "value"]]
            if not len(frame):
                continue
            if late:
                yield frame.assign(record="late", range=int(key[1]), n=1, piece=None)[["key", "record", "range", "n", "at", "tie", "value", "piece"]]
            else:
                self.rows.appendValue((_packed(frame),))
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat([pa.ipc.open_stream(x[0]).read_pandas() for x in self.rows.get()], ignore_index=True)
        self.rows.clear()
        rows = rows.sort_values(["key", "at", "tie"], kind="stable")
        ids, first = np.unique(rows["key"].to_numpy(), return_index=True)
        at, value = rows["at"].to_numpy(np.int64), rows["value"].to_numpy(float)
        borders = [*first.tolist(), len(rows)]
        pieces = [list(self.fold.lift(at[a:b], value[a:b])) for a, b in zip(borders, borders[1:])]
        yield pd.DataFrame({"key": ids, "record": "folded", "range": int(key[1]), "n": np.diff(borders), "at": None, "tie": None, "value": None, "piece": pieces})

    def close(self) -> None:
        pass


class Standing(StatefulProcessor):
    """The one piece that is left of each key of a shard, the numbers of all pieces side by side; late rows go through.

    A batch costs a shard one reading and one writing of its state, however many of its keys have news.
    """

    def __init__(self, fold: Decayed | Backoff, idle_ms: int | None):
        self.fold, self.idle = fold, idle_ms
        self.names = [x.split(" ")[0] for x in fold.results.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getValueState("keys", StructType().add("some", BinaryType()))  # key, its rows and when it had news, in the order of the pieces
        self.piece = handle.getValueState("piece", StructType().add("piece", ArrayType(BinaryType())).add("n", LongType()))  # a value for each number of a piece; n rows of all keys

    def _known(self, now: int) -> tuple[pd.DataFrame, np.ndarray] | None:
        """The keys and their pieces, without those that were idle."""
        if not self.keys.exists():
            return None
        keys = pa.ipc.open_stream(self.keys.get()[0]).read_pandas()
        pieces = np.array([np.frombuffer(x) for x in self.piece.get()[0]])
        if self.idle:
            there = keys["news"].to_numpy() + self.idle > now
            keys, pieces = keys[there], pieces[:, there]
        return keys, pieces

    def _keep(self, keys: pd.DataFrame, pieces: np.ndarray) -> None:
        if not len(keys):
            self.keys.clear()
            self.piece.clear()
            return
        self.keys.update((_packed(keys),))
        self.piece.update(([x.tobytes() for x in pieces], int(keys["n"].sum())))
        if self.idle:
            self.handle.registerTimer(int(keys["news"].min()) + self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = []
        for frame in rows:
            late = frame["record"] == "late"
            if late.any():
                yield frame.loc[late, ["key", "record", "n", "at", "tie", "value"]].assign(**dict.fromkeys(self.names))
            if not late.all():
                came.append(frame.loc[~late, ["key", "range", "n", "piece"]])
        if not came:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle else 0
        new = pd.concat(came, ignore_index=True)
        keys, pieces = new[["key", "range", "n"]].astype("int64").assign(news=now), np.array(new["piece"].tolist(), float).T
        known = self._known(now)
        if known:
            keys, pieces = pd.concat([known[0].assign(range=np.iinfo(np.int64).min), keys], ignore_index=True), np.concatenate([known[1], pieces], axis=1)
        order = np.lexsort((keys["range"], keys["key"]))
        keys, pieces = keys.iloc[order], pieces[:, order]
        _, first, each = np.unique(keys["key"].to_numpy(), return_index=True, return_counts=True)
        whole = pieces[:, first]
        for i in range(1, each.max()):  # the second pieces of all keys, then the third ones, in the order of time
            some = np.flatnonzero(each > i)
            whole[:, some] = self.fold.after(whole[:, some], pieces[:, first[some] + i])
        kept = keys.groupby("key", as_index=False).agg(n=("n", "sum"), news=("news", "max"))
        self._keep(kept, whole)
        told = kept["key"].isin(new["key"]).to_numpy()
        results = dict(zip(self.names, self.fold.result(whole[:, told])))
        yield kept.loc[told, ["key", "n"]].assign(record="standing", at=None, tie=None, value=None, **results)[["key", "record", "n", "at", "tie", "value", *self.names]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if known := self._known(timerValues.getCurrentProcessingTimeInMs()):
            self._keep(*known)
        return iter(())

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, time: str, tie: str, value: str, fold: Decayed | Backoff, delay: str, width_hours: int = 24, idle_ms: int | None = None) -> DataFrame:
    """(key, record, n, at, tie, value, ...): `standing` rows say what a key's rows so far lead to, `late` rows came after their range was folded.

    Rows count in the order of time and tie. A range is width_hours of event time; its rows are
    kept until the watermark (the latest time so far less delay) passes its end, so a row may
    come delay late whatever its place in the range. A key without news for idle_ms of the
    clock is forgotten. Of the standing rows of a key the one of largest n is the last. A row
    without key, time or tie is none; a null value is 0.
    """
    width = width_hours * 3_600_000
    at, there = F.unix_millis(time), F.col(key).isNotNull() & F.col(time).isNotNull()
    rows = in_time(stream, time).withWatermark(time, delay).select(
        F.col(key).cast("long").alias("key"), at.alias("at"), F.when(there, F.col(tie)).cast("long").alias("tie"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"),
        F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SHARDS)), F.lit(0)).cast("int").alias("shard"), F.coalesce(F.floor(at / width), F.lit(0)).alias("range"),
    )
    pieces = rows.groupBy("shard", "range").transformWithStateInPandas(Ranges(fold, width), _RANGE_OUT, "Append", "EventTime")
    out = f"key long, record string, n long, at long, tie long, value double, {fold.results}"
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(STANDING_SHARDS)).cast("int"))
    return pieces.groupBy("shard").transformWithStateInPandas(Standing(fold, idle_ms), out, "Append", "ProcessingTime" if idle_ms else "None")


def standing(found: DataFrame) -> DataFrame:
    """The last standing row of each key."""
    names = [c for c in found.columns if c not in ("key", "record", "n", "at", "tie", "value", "_epoch")]
    return found.filter("record = 'standing'").groupBy("key").agg(F.max("n").alias("n"), F.max_by(F.struct(*names), "n").alias("x")).select("key", "n", "x.*")


# ---- rows that come again ----
_SEEN_OUT = "record string, key long, first_seen long, last_seen long, n long"


class Seen(StatefulProcessor):
    """When the keys of one shard were first and last seen. A key ends ttl after it was last seen; the timer is at the first such end."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType().add("some", BinaryType()))

    def _known(self) -> pd.DataFrame:
        if not self.seen.exists():
            return pd.DataFrame({"key": np.zeros(0, np.int64), "first_seen": np.zeros(0, np.int64), "last_seen": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        return pa.ipc.open_stream(self.seen.get()[0]).read_pandas()

    def _keep(self, known: pd.DataFrame) -> None:
        if len(known):
            self.seen.update((_packed(known),))
            self.handle.registerTimer(int(known["last_seen"].min()) + self.ttl)
        else:
            self.seen.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w, known, came = timerValues.getCurrentWatermarkInMs(), self._known(), []
        for frame in rows:
            frame = frame[frame["key"].notna() & frame["at"].notna()].astype({"key": "int64", "at": "int64"})
            late = frame["at"] + self.ttl <= w
            if late.any():
                some = frame[late]
                yield pd.DataFrame({"record": "late", "key": some["key"], "first_seen": some["at"], "last_seen": some["at"], "n": 1})
            came.append(frame[~late])
        came = pd.concat(came, ignore_index=True) if came else pd.DataFrame()
        if not len(came):
            return
        new = came.groupby("key")["at"].agg(first_seen="min", last_seen="max", n="count").reset_index()
        yield pd.DataFrame({"record": "first", **{c: new.loc[~new["key"].isin(known["key"]), c] for c in ("key", "first_seen", "last_seen", "n")}})
        both = pd.concat([known, new], ignore_index=True)
        self._keep(both.groupby("key").agg(first_seen=("first_seen", "min"), last_seen=("last_seen", "max"), n=("n", "sum")).reset_index())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, w = self._known(), timerValues.getCurrentWatermarkInMs()
        over = known["last_seen"] + self.ttl <= w
        if over.any():
            yield known[over].assign(record="ended")[["record", "key", "first_seen", "last_seen", "n"]]
            self._keep(known[~over])

    def close(self) -> None:
        pass


def seen(stream: DataFrame, key: str, time: str, delay: str, ttl_hours: int) -> DataFrame:
    """(record, key, first_seen, last_seen, n), times in milliseconds: `first` when a key comes for the first time, `ended` when it was not
    seen for ttl_hours of event time (with all its sightings), and `late` for a row that is too old to know whether its key ended.

    A key that comes again only moves its last_seen. What has ended is forgotten, so state is bounded by the keys of ttl_hours; a key
    that comes after its end is first again. Rows without key or time are none.
    """
    at = F.unix_millis(time)
    shard = F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SHARDS)), F.lit(0)).cast("int")
    rows = in_time(stream, time).withWatermark(time, delay).select(F.col(key).cast("long").alias("key"), at.alias("at"), shard.alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(Seen(ttl_hours * 3_600_000), _SEEN_OUT, "Append", "EventTime")


# ---- windows ----
def sliding_counts(stream: DataFrame, time: str, width: str, step: str, by: str, delay: str) -> DataFrame:
    """(start, by, n) of each window of width that starts every step, written once it is over; rows of windows that are over are dropped."""
    return in_time(stream, time).withWatermark(time, delay).groupBy(F.window(time, width, step), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: str, delay: str) -> DataFrame:
    """(start, finish, by, n) of each session, rows of a key with less than gap between them, written once it is over; finish is gap after its last row."""
    # windows of Spark that touch are one; less by the least unit of time, rows exactly gap apart do not
    found = in_time(stream, time).withWatermark(time, delay).groupBy(F.session_window(time, f"{gap} -1 microseconds"), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("finish"), by, "n")
