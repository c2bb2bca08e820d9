"""Keyed state that ends, rows that come again, commits and cursors as streams, with late rows and failures."""

import datetime as dt
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.sources.cursor import CursorReader, cursor_stream
from sparkloom.streaming import keyed
from sparkloom.streaming.ledger import Ledger

START = dt.datetime(2024, 3, 1)
HOUR = 3_600_000
CLICKS = "k long, ts timestamp_ntz, tie long, value double, batch int"


def ms(time):
    return round((time - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


@pytest.mark.parametrize("fold", [keyed.Decayed(0.5), keyed.Backoff(60, 3600, 2, 86400, 21600), keyed.Backoff(60, 3600, 0, 86400, 21600)])
def test_pieces_compose(fold):
    rnd = np.random.default_rng(7)
    for _ in range(200):
        n = rnd.integers(1, 12)
        at, value = np.sort(rnd.integers(0, 10**7, n)), rnd.choice([1.0, 1.0, 0.0, -0.5], n)
        whole = fold.result(fold.lift(at, value))
        cuts = sorted({0, int(n), *rnd.integers(0, n, 3).tolist()})
        piece = None
        for a, b in zip(cuts, cuts[1:]):
            more = fold.lift(at[a:b], value[a:b])
            piece = more if piece is None else fold.after(piece, more)
        assert fold.result(piece) == pytest.approx(whole)


def arrivals(rnd, n=300):
    """Rows in five batches, most in time, some late, some broken, all out of order."""
    rows = []
    for i in range(n):
        batch = rnd.randrange(5)
        ts = START + dt.timedelta(days=2 * batch, seconds=rnd.randrange(2 * 86400))
        if rnd.random() < 0.1:
            ts -= dt.timedelta(days=rnd.randrange(1, 6))
        rows.append((rnd.choice([1, 1, 1, 2, 3]), ts, i, rnd.choice([1.0, -0.5, None]), batch))
    return rows + [(None, START, 900, 1.0, 0), (1, None, 901, 1.0, 1), (2, START, None, 1.0, 0)]


def test_scores_of_late_and_early_rows(spark):
    rows, width, delay = arrivals(random.Random(1)), 24 * HOUR, 3 * HOUR
    stream = keyed.with_end(spark.createDataFrame(rows, CLICKS), "batch", 5, "ts")
    found = keyed.in_order(stream, "batch", 6, lambda s: keyed.folded(s, "k", "ts", "tie", "value", keyed.Decayed(0.5), "3 hours", 24)).cache()
    mark, late, kept = 0, set(), {}
    for b in range(5):
        now = [r for r in rows if r[4] == b]
        for k, ts, tie, value, _ in now:
            if None not in (k, ts, tie):
                if (ms(ts) // width + 1) * width <= mark:
                    late.add((k, tie))
                else:
                    kept.setdefault(k, []).append((ms(ts), tie, value or 0.0))
        mark = max([mark, *(ms(r[1]) - delay for r in now if r[1])])
    want = {}
    for k, history in kept.items():
        score = 0.0
        for _, _, g in sorted(history):
            score = max(0.0, score * 0.5 + g)
        want[k] = (len(history), round(score, 9))
    assert late and {(r.key, r.tie) for r in found.filter("record = 'late'").collect()} == late
    assert {r.key: (r.n, round(r.score, 9)) for r in keyed.standing(found).collect()} == want


class _Handle:
    """A state store in memory, to look at what a processor keeps."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getListState(self, name, kind):  # noqa: N802
        return _List(self.values.setdefault(name, []))

    def getValueState(self, name, kind, ttl=None):  # noqa: N802
        return _Value(self.values, name)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class _List:
    def __init__(self, held):
        self.held = held

    def appendValue(self, v):  # noqa: N802
        self.held.append(v)

    def get(self):
        return iter(self.held)

    def clear(self):
        self.held.clear()


class _Value:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held

    def get(self):
        return self.held[self.name]

    def update(self, v):
        self.held[self.name] = v

    def clear(self):
        self.held.pop(self.name, None)


class _Clock:
    def __init__(self, w):
        self.w = w

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.w


def test_state_of_a_key_is_bounded():
    """After a hundred days of rows the state of a key is one piece, and no row of a folded range is kept."""
    import pandas as pd

    fold, handle = keyed.Decayed(0.5), _Handle()
    standing = keyed.Standing(fold, None)
    standing.init(handle)
    for day in range(100):
        shard, ranges = _Handle(), keyed.Ranges(fold, 24 * HOUR)
        ranges.init(shard)
        rows = pd.DataFrame({"key": 1, "at": day * 24 * HOUR + np.arange(500), "tie": np.arange(500), "value": 1.0})
        assert list(ranges.handleInputRows((0, day), iter([rows]), _Clock(0))) == [] and shard.timers == {(day + 1) * 24 * HOUR}
        pieces = list(ranges.handleExpiredTimer((0, day), _Clock((day + 1) * 24 * HOUR), None))
        assert shard.values["rows"] == []
        list(standing.handleInputRows((1,), iter(pieces), _Clock(0)))
    (piece, n) = handle.values["piece"]
    assert n == 50_000 and len(piece) == 3


@pytest.mark.parametrize("fold", [keyed.Backoff(60, 3600, 2, 86400, 21600), keyed.Decayed(0.5)])
def test_keys_of_a_shard_are_one_state(fold):
    """Many keys with news in several ranges are one frame, read and written together, and each has its own pieces in order of time."""
    import pandas as pd

    rnd, handle, history = np.random.default_rng(3), _Handle(), {}
    standing = keyed.Standing(fold, None)
    standing.init(handle)
    for batch in range(4):
        pieces, told = [], {}
        for day in (2 * batch, 2 * batch + 1):
            ranges = keyed.Ranges(fold, 24 * HOUR)
            ranges.init(_Handle())
            n = 700
            rows = pd.DataFrame({"key": rnd.integers(0, 300, n), "at": day * 24 * HOUR + np.sort(rnd.integers(0, 24 * HOUR, n)), "tie": np.arange(n), "value": rnd.choice([1.0, 1.0, 0.0, -0.5], n)})
            for k, some in rows.groupby("key"):
                history.setdefault(k, []).append(some)
                told[k] = None
            assert list(ranges.handleInputRows((0, day), iter([rows]), _Clock(0))) == []
            pieces += ranges.handleExpiredTimer((0, day), _Clock((day + 1) * 24 * HOUR), None)
        (found,) = standing.handleInputRows((0,), iter(pieces[::-1]), _Clock(0))
        assert found["key"].tolist() == sorted(told)
        for r in found.itertuples():
            rows = pd.concat(history[r.key])
            want = fold.result(fold.lift(rows["at"].to_numpy(), rows["value"].to_numpy()))
            assert r.n == len(rows) and tuple(getattr(r, x) for x in standing.names) == pytest.approx(want)
    assert handle.values["piece"][1] == 4 * 2 * 700


def test_idle_keys_of_a_shard_are_forgotten():
    import pandas as pd

    class Clock(_Clock):
        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.w

    handle, standing = _Handle(), keyed.Standing(keyed.Decayed(0.5), 100)
    standing.init(handle)
    come = lambda now, *keys: [
        (r.key, r.n) for x in standing.handleInputRows((0,), iter([pd.DataFrame({"key": keys, "record": "folded", "range": now, "n": 5, "piece": [[0.0, 0.5, 1.0]] * len(keys)})]), Clock(now)) for r in x.itertuples()
    ]
    assert come(0, 1, 2) == [(1, 5), (2, 5)] and come(50, 2) == [(2, 10)] and handle.timers == {100}
    assert come(120, 1) == [(1, 5)]  # as if it had not been
    assert list(standing.handleExpiredTimer((0,), Clock(150), None)) == [] and handle.values["piece"][1] == 5 and 220 in handle.timers
    assert list(standing.handleExpiredTimer((0,), Clock(220), None)) == [] and not handle.values.get("piece")


def test_state_partitions_are_bounded_while_a_query_starts(spark):
    name = "spark.sql.shuffle.partitions"
    for states, wanted in ((2, "2"), (100, "4"), (None, "4")):
        with keyed.state_store(spark, states):
            assert spark.conf.get(name) == wanted
        assert spark.conf.get(name) == "4"


def test_rows_that_come_again(spark):
    t = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, t(0), 0), (2, t(1), 0), (1, t(5), 0), (1, t(9), 1), (3, t(40), 1), (1, t(38), 2), (2, t(8), 2), (2, t(41), 2), (None, t(1), 0), (4, None, 0)]
    stream = keyed.with_end(spark.createDataFrame(rows, "k long, ts timestamp_ntz, batch int"), "batch", 3, "ts")
    found = keyed.in_order(stream, "batch", 4, lambda s: keyed.seen(s, "k", "ts", "1 hour", 24))
    at = lambda h: ms(t(h))
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted([
        ("first", 1, at(0), at(5), 2), ("first", 2, at(1), at(1), 1), ("first", 3, at(40), at(40), 1),
        ("ended", 1, at(0), at(9), 3), ("ended", 2, at(1), at(1), 1),  # not seen for a day when the clock stood at 39
        ("late", 2, at(8), at(8), 1), ("first", 1, at(38), at(38), 1), ("first", 2, at(41), at(41), 1),
        ("ended", 1, at(38), at(38), 1), ("ended", 2, at(41), at(41), 1), ("ended", 3, at(40), at(40), 1),
    ])


def test_a_batch_that_fails_half_way(spark):
    """A batch dies after its first table, the stream starts anew on its checkpoint: no row twice, none lost, and the cursor as if nothing had been."""
    root = storage.new_path(spark, "ledger-test")
    ledger, died = Ledger(spark, f"{root}/ledger"), []
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def step(batch, cursor):
        both = {"even": batch.filter("id % 2 = 0"), "odd": batch.filter("id % 2 = 1")}
        if len(ledger.committed()) == 2 and not died:
            died.append(1)
            both["odd"] = both["odd"].select(F.raise_error(F.lit("the task dies")).cast("long").alias("id"))
        return both, (cursor or 0) + batch.count()

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        return stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(ledger.writer(step)).start()

    with pytest.raises(Exception, match="dies|failed|FAILED"):
        start().awaitTermination()
    assert ledger.committed() == [0, 1] and ledger.cursor() == 20 and ledger.table("even", "id long").count() == 10
    start().awaitTermination()
    rows = ledger.table("even", "id long").unionByName(ledger.table("odd", "id long"))
    assert sorted(r.id for r in rows.collect()) == list(range(40)) and ledger.cursor() == 40
    assert not ledger.commit(3, {"even": spark.range(5)}, 99) and ledger.cursor() == 40


def test_a_ledger_without_commits(spark):
    ledger = Ledger(spark, storage.new_path(spark, "ledger-test"))
    assert ledger.committed() == [] and ledger.cursor("none") == "none" and ledger.table("x", "id long").count() == 0


def test_a_cursor_goes_on_where_it_was(spark):
    root = storage.new_path(spark, "cursor-test")
    put = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("k")).repartition(3).write.mode("append").parquet(f"{root}/in")
    put(0, 100)
    lock, got = threading.Lock(), []

    def write(batch, number):
        with lock:
            got.append(sorted(r.k for r in batch.collect()))

    def run():
        stream = cursor_stream(spark, f"{root}/in", "k", "id long, k long", after=10, partitions=4)
        stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    wanted = lambda a, b: [k for k in range(a, b) if k % 7]
    run()
    assert sum(got, []) == wanted(11, 100)
    put(100, 150)
    run()
    run()  # nothing new
    assert sorted(sum(got, [])) == wanted(11, 150)


def test_ranges_of_a_cursor():
    reader = CursorReader.__new__(CursorReader)
    reader.first, reader.parts, reader._ends = 0, 4, lambda: (5, 1000)
    parts = reader.partitions({"cursor": -(1 << 63)}, {"cursor": 1000})
    assert (parts[0].low, parts[-1].high, len(parts)) == (4, 1000, 4) and all(a.high == b.low for a, b in zip(parts, parts[1:]))
    assert reader.partitions({"cursor": 1000}, {"cursor": 1000}) == []


def test_rows_exactly_gap_apart_are_two_sessions(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(0, 1, at(100)), (0, 1, at(106)), (0, 1, at(111)), (1, 1, at(3))], "batch int, k long, ts timestamp").select("ts", "k", "batch")
    assert keyed.latest_ms(rows, "batch", "ts") == 108 * 3_600_000 and keyed.latest_ms(rows.limit(0), "batch", "ts") == 0
    found = keyed.in_order(keyed.with_end(rows, "batch", 2, "ts"), "batch", 3, lambda s: keyed.sessions(s, "ts", "6 hours", "k", f"{108 * 3_600_000} milliseconds"))
    assert sorted((r.start, r.finish, r.n) for r in found.filter("k is not null").collect()) == [(at(3), at(9), 1), (at(100), at(106), 1), (at(106), at(117), 2)]
