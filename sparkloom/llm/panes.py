"""Hourly panes of a click stream, emitted when due and revised by late rows.

Clicks are dealt into batches, written, and fed in order to one streaming query with
keyed state, which starts anew for every batch. A map stage counts the rows of each
pane within its task by bincount and passes rows of closed panes on, so that what
is shuffled is a row for each pane and task, however many clicks a pane has. A
kind's hours are dealt over PARTS shards. The state of a shard keeps for each kind a
ring of hours as NumPy arrays in one Arrow message; hours outside the ring lie
beside it in sparse arrays. Every batch has a tick for every shard, with the event
time up to which all earlier batches have come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructType

from ..storage import new_path
from .common import session

BATCHES, DELAYS, DELAY_FROM = 12, 30, 23
#: Hours after its end at which a pane is due, and closed.
DUE, CLOSED = 2, 72
#: Shards of all kinds, and shards of one kind; a shard has at most one part of a kind, so PARTS <= SHARDS.
SHARDS, PARTS = 32, 8
#: Hours of a part that a ring holds.
RING = 32
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Largest amount that counts; larger ones, infinite ones and NaN are broken and count 0.
MOST_CENTS = 10**15

OUT = "batch long, record string, kind string, hour long, click_id long, n_rows long, cents long"
#: From the map stage to the shards. what: a row of a closed pane, the count of an open one, or a tick (hour is then the last whole hour before W).
_SENT = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("what", pa.string()), ("kind", pa.string()), ("hour", pa.int64()), ("click_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64())])
_SENT_DDL = "shard int, batch long, what string, kind string, hour long, click_id long, n_rows long, cents long"
LATE, PANE, TICK = "late", "pane", "tick"
#: Stands for W before the first batch.
NEVER = -(1 << 62)


def micros(time: str) -> str:
    """SQL for microseconds since 1970 of a time without a zone, whatever the session's zone."""
    days = f"unix_date(cast({time} as date))"
    return f"(((cast({days} as bigint) * 24 + hour({time})) * 60 + minute({time})) * 60000000 + cast(extract(second from {time}) * 1000000 as bigint))"


def dealt(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(click_id, kind, event, cents, batch): each click once, in the batch it comes with. event is in microseconds, folded by whole rounds of batches days."""
    one = F.min(F.struct(*(F.col(c) for c in ("arrived_at", "ts", "kind", "value")))).alias("x")
    rows = clicks.filter("ts is not null").select("click_id", "arrived_at", "ts", "kind", "value").groupBy("click_id").agg(one).select("click_id", "x.*")
    day = "coalesce(cast(unix_date(cast(arrived_at as date)) as bigint), 0)"
    rows = rows.withColumn("day", F.expr(day)).withColumn("turn", F.expr(f"pmod(day, {batches})"))
    late = f"coalesce(greatest(0, crc32(cast(click_id as string)) % {DELAYS} - {DELAY_FROM}), 0)"
    return rows.select(
        "click_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.expr(f"{micros('ts')} - (day - turn) * {DAY}").alias("event"),
        F.expr(f"case when abs(100 * value) < {MOST_CENTS} then cast(floor(100 * value + 0.5) as bigint) else 0L end").alias("cents"),
        F.expr(f"cast(least({batches - 1}, turn + {late}) as int)").alias("batch"),
    )


def clock(rows: DataFrame, batches: int) -> DataFrame:
    """(batch, w): the largest event time of earlier batches, in whole hours; one row a batch."""
    most = rows.groupBy("batch").agg(F.max("event").alias("most"))
    every = rows.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch")).join(most, "batch", "left")
    before = F.max("most").over(Window.partitionBy(F.lit(0)).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn("x", before).select("batch", F.coalesce(F.expr(f"(x - pmod(x, {HOUR})) div {HOUR}"), F.lit(NEVER)).alias("w"))


def sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums of values by place: bincount of the low and of the high bits, each within what a float holds."""
    low = values & 0xFFFFFF
    return np.bincount(at, low, size).astype(np.int64) + (np.bincount(at, (values - low) >> 24, size).astype(np.int64) << 24)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of closed panes, the counts of the other panes of each Arrow batch, and ticks."""
    for b in batches:
        shard = b.column(4)
        ticks = b.filter(shard.is_valid())
        if n := ticks.num_rows:
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([ticks.column(4), ticks.column(5).cast(pa.int64()), pa.array([TICK] * n), pa.nulls(n, pa.string()), ticks.column(6), none, none, none], schema=_SENT)
        rows = b.filter(shard.is_null())
        if not rows.num_rows:
            continue
        hours, cents, numbers = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 5))
        late = hours <= rows.column(6).to_numpy(zero_copy_only=False) - 1 - CLOSED
        if late.any():
            some = rows.filter(pa.array(late))
            n = some.num_rows
            spread = np.abs(some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) % SHARDS
            yield pa.RecordBatch.from_arrays([pa.array(spread.astype(np.int32)), pa.array(numbers[late]), pa.array([LATE] * n), some.column(1), pa.array(hours[late]), some.column(0).cast(pa.int64()), pa.array(np.ones(n, np.int64)), pa.array(cents[late])], schema=_SENT)
        rows, hours, cents, numbers = rows.filter(pa.array(~late)), hours[~late], cents[~late], numbers[~late]
        if not len(hours):
            continue
        kinds = rows.column(1).dictionary_encode()
        code = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        panes, at = np.unique(np.stack([code, hours, numbers]), axis=1, return_inverse=True)
        at = at.reshape(-1)
        names = kinds.dictionary.take(pa.array(panes[0]))
        home = np.array([_home(k) for k in kinds.dictionary.to_pylist()], np.int64)[panes[0]]
        shards = ((home + panes[1] % PARTS) % SHARDS).astype(np.int32)
        size = panes.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(panes[2]), pa.array([PANE] * size), names, pa.array(panes[1]), pa.nulls(size, pa.int64()), pa.array(np.bincount(at, minlength=size)), pa.array(sums(at, cents, size))], schema=_SENT)


def _home(kind: str) -> int:
    """The first shard of a kind."""
    return zlib.crc32(kind.encode()) % SHARDS


class Ring:
    """The open panes of one kind in one shard: local hours base .. base + RING - 1 in a ring, others in sparse arrays beside it.

    n and cents are what earlier batches brought, emitted says whether a pane was written; new_n and new_cents are of this batch.
    """

    FIELDS = ("hours", "n", "cents", "emitted")

    def __init__(self, part: int, base: int):
        self.part, self.base = part, base
        self.n, self.cents, self.emitted = np.zeros(RING, np.int64), np.zeros(RING, np.int64), np.zeros(RING, bool)
        self.new_n, self.new_cents = np.zeros(RING, np.int64), np.zeros(RING, np.int64)
        #: Of the panes outside the ring: local hours in order, and the same five.
        self.far = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def dump(self) -> bytes:
        columns = {"n": self.n, "cents": self.cents, "emitted": self.emitted}
        head = pa.RecordBatch.from_pydict({"part": [self.part], "base": [self.base], **{k: pa.array([v]) for k, v in columns.items()}, **{f"far_{k}": pa.array([v]) for k, v in zip(self.FIELDS, self.far)}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as out:
            out.write_batch(head)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, raw: bytes) -> Ring:
        b = pa.ipc.open_stream(raw).read_next_batch()
        one = lambda name: b.column(name).values.to_numpy(zero_copy_only=False).copy()
        self = cls(b.column("part")[0].as_py(), b.column("base")[0].as_py())
        self.n, self.cents, self.emitted = one("n"), one("cents"), one("emitted").astype(bool)
        far = [one(f"far_{k}") for k in cls.FIELDS]
        zero = np.zeros(len(far[0]), np.int64)
        self.far = [*far[:3], far[3].astype(bool), zero, zero.copy()]
        return self

    def add(self, hours: np.ndarray, n: np.ndarray, cents: np.ndarray) -> None:
        local = hours // PARTS
        near = (local >= self.base) & (local < self.base + RING)
        slot = local[near] % RING
        self.new_n += sums(slot, n[near], RING)
        self.new_cents += sums(slot, cents[near], RING)
        if not near.all():
            hour, n, cents = local[~near], n[~near], cents[~near]
            keys, at = np.unique(np.concatenate([self.far[0], hour]), return_inverse=True)
            old, new = at[: len(self.far[0])], at[len(self.far[0]) :]
            far = [keys, *(np.zeros(len(keys), x.dtype) for x in self.far[1:])]
            for x, was in zip(far[1:], self.far[1:]):
                x[old] = was
            far[4] += sums(new, n, len(keys))
            far[5] += sums(new, cents, len(keys))
            self.far = far

    def advance(self, w: int, last: bool) -> tuple[list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], bool]:
        """Writes due panes and revisions, forgets closed panes; (record, hour, n, cents) of what is written, and whether panes stay."""
        turn = (self.base + np.arange(RING)) % RING  # ring slots in the order of their hours
        local = np.concatenate([self.base + np.arange(RING), self.far[0]])
        n, cents, emitted, new_n, new_cents = (np.concatenate([x[turn], y]) for x, y in zip((self.n, self.cents, self.emitted, self.new_n, self.new_cents), self.far[1:]))
        hour, dirty = local * PARTS + self.part, new_n > 0
        due, closed = hour <= w - 1 - DUE, hour <= w - 1 - CLOSED
        revised = emitted & dirty
        total, money = n + new_n, cents + new_cents
        first = ~emitted & due & (total > 0)
        out = [("emit", hour[first], total[first], money[first]), ("retract", hour[revised], n[revised], cents[revised]), ("replace", hour[revised], total[revised], money[revised])]
        if last:
            rest = ~emitted & ~due & (total > 0)
            out.append(("final", hour[rest], total[rest], money[rest]))
        emitted = emitted | first
        keep = ~closed & (total > 0)
        # the ring moves to the first hour that is still open; what now lies in it comes out of the sparse arrays
        base = max(self.base, (w - CLOSED - self.part + PARTS - 1) // PARTS) if w > NEVER else self.base
        local, total, money, emitted = local[keep], total[keep], money[keep], emitted[keep]
        near = (local >= base) & (local < base + RING)
        fresh = Ring(self.part, base)
        slot = local[near] % RING
        fresh.n[slot], fresh.cents[slot], fresh.emitted[slot] = total[near], money[near], emitted[near]
        order = np.argsort(local[~near])
        zero = np.zeros(len(order), np.int64)
        fresh.far = [local[~near][order], total[~near][order], money[~near][order], emitted[~near][order], zero, zero.copy()]
        self.__dict__ = fresh.__dict__
        return out, bool(len(local))


class Panes(StatefulProcessor):
    """The panes of one shard. last: the number of the last batch, which writes all that is left."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getMapState("rings", StructType().add("kind", StringType()), StructType().add("ring", BinaryType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        w, batch, known = NEVER, 0, {k[0]: Ring.load(v[0]) for k, v in self.rings.iterator()}
        was = set(known)
        for frame in rows:
            late = frame[frame["what"] == LATE]
            if len(late):
                yield pd.DataFrame({"batch": late["batch"], "record": LATE, "kind": late["kind"], "hour": late["hour"], "click_id": late["click_id"], "n_rows": late["n_rows"], "cents": late["cents"]})
            for tick in frame[frame["what"] == TICK].itertuples():
                w, batch = max(w, int(tick.hour)), max(batch, int(tick.batch))
            for kind, part in frame[frame["what"] == PANE].groupby("kind", sort=False):
                hours, n, cents = (part[c].to_numpy(np.int64) for c in ("hour", "n_rows", "cents"))
                if kind not in known:
                    known[kind] = Ring(int(hours[0] % PARTS), int(hours.min() // PARTS))
                known[kind].add(hours, n, cents)
        for kind, ring in sorted(known.items()):
            touched = bool((ring.new_n > 0).any() or len(ring.far[4].nonzero()[0]))
            before = ring.base
            found, stay = ring.advance(w, batch == self.last)
            for record, hour, n, cents in found:
                if len(hour):
                    yield pd.DataFrame({"batch": batch, "record": record, "kind": kind, "hour": hour, "click_id": -1, "n_rows": n, "cents": cents})
            if not stay:
                if kind in was:
                    self.rings.removeKey((kind,))
            elif touched or ring.base != before or any(len(x[1]) for x in found):
                self.rings.updateValue((kind,), (ring.dump(),))

    def close(self) -> None:
        pass


#: Settings of the stream: small stores that take no space ahead and are closed some time after their start of the query is over, one
#: file a commit, and no batch without rows. Closing them at once costs more than it frees, as each look at a store lists its files.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "30s",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _move(spark: SparkSession, at: str, to: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(to).getParent())
    if not fs.rename(path(at), path(to)):
        raise OSError(f"could not move {at} to {to}")


def panes(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, record, kind, hour, click_id, n_rows, cents): what the stream of batches writes, in no order.

    record is `late` for a row of a closed pane (n_rows is 1, cents its own), `emit` for a
    pane that is due, `retract` and `replace` for one that was emitted before and has new
    rows, `final` for what the last batch leaves. Rows without ts go; of different rows
    with one click_id the least by arrived_at, ts, kind and value counts, and a null
    click_id is one click. Null kind is `none`, null arrived_at day 0, a null or broken
    value 0. An empty table gives no rows; other columns are not read.
    """
    spark, root = session(clicks.sparkSession), new_path(clicks.sparkSession, "panes")
    rows = dealt(clicks, batches).select("click_id", "kind", F.expr(f"(event - pmod(event, {HOUR})) div {HOUR}").alias("hour"), "cents", "event", F.lit(None).cast("int").alias("shard"), "batch")
    ticks = spark.range(batches).select(F.col("id").cast("int").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"))
    # a batch is written by its share of the tasks, so that files are as many as tasks, not tasks times batches
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) // batches + 1
    rows = rows.unionByName(ticks, allowMissingColumns=True).repartition("batch", F.pmod(F.xxhash64("click_id", "shard"), F.lit(parts)))
    rows.write.partitionBy("batch").parquet(f"{root}/staged")
    staged = spark.read.schema(rows.schema).parquet(f"{root}/staged")
    clock(staged, batches).coalesce(1).write.parquet(f"{root}/clock")
    times = spark.read.parquet(f"{root}/clock")  # one row a batch
    before = {k: spark.conf.get(k, None) for k in STATE}
    for number in range(batches):
        _move(spark, f"{root}/staged/batch={number}", f"{root}/feed/batch={number}")
        feed = spark.readStream.schema(rows.schema).parquet(f"{root}/feed").join(F.broadcast(times), "batch")
        sent = feed.select("click_id", "kind", "hour", "cents", "shard", "batch", "w").mapInArrow(_counted, _SENT_DDL)
        written = sent.groupBy("shard").transformWithStateInPandas(Panes(batches - 1), OUT, "Update", "None")

        def write(out: DataFrame, epoch: int) -> None:
            out.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")  # noqa: B023  a batch that runs again writes the same folder

        try:
            for k, v in STATE.items():
                spark.conf.set(k, v)
            query = written.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        query.awaitTermination()
    return spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(f"{root}/out")
