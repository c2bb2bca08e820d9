"""Panes of a stream against a walk through the batches, with odd rows."""

import datetime as dt
import random
import zlib
from collections import defaultdict

import numpy as np

from sparkloom.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, batch string"
EPOCH = dt.datetime(1970, 1, 1)
HOUR = dt.timedelta(hours=1)


def walked(rows, batches):
    """The contract, batch by batch."""
    known = {}
    for click, ts, arrived, _, kind, value, *_ in rows:
        if ts is not None:
            known.setdefault(click, (ts, arrived, kind, value))
    fed = defaultdict(list)
    for click, (ts, arrived, kind, value) in known.items():
        day = (arrived - EPOCH).days if arrived else 0
        turn = day % batches
        number = min(batches - 1, turn + (max(0, zlib.crc32(str(click).encode()) % 30 - 23) if click is not None else 0))
        event = ts - dt.timedelta(days=day - turn) - EPOCH
        good = value is not None and np.isfinite(value)
        fed[number].append((click, "none" if kind is None else kind, event, int(np.floor(100 * value + 0.5)) if good else 0))
    w, open_, out = None, {}, []
    for b in range(batches):
        touched = {}
        for click, kind, event, cents in fed[b]:
            pane = (kind, event // HOUR)
            if w is not None and w >= (pane[1] + 1) * HOUR + dt.timedelta(days=3):
                out.append((b, "late", *pane, click, 1, cents))
                continue
            state = open_.setdefault(pane, [0, 0, False])
            touched.setdefault(pane, tuple(state))
            state[0], state[1] = state[0] + 1, state[1] + cents
        for pane, state in list(open_.items()):
            end = (pane[1] + 1) * HOUR
            if state[2] and pane in touched:
                out.append((b, "retract", *pane, -1, touched[pane][0], touched[pane][1]))
                out.append((b, "replace", *pane, -1, state[0], state[1]))
            elif not state[2] and w is not None and w >= end + 2 * HOUR:
                out.append((b, "emit", *pane, -1, state[0], state[1]))
                state[2] = True
            if w is not None and w >= end + dt.timedelta(days=3):
                del open_[pane]
        if fed[b]:
            most = max(e for _, _, e, _ in fed[b])
            w = most if w is None else max(w, most)
    return out + [(batches - 1, "final", *pane, -1, n, c) for pane, (n, c, done) in open_.items() if not done]


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in row)


def test_a_stream_of_batches(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        ts = EPOCH + dt.timedelta(days=rnd.choice([19720, 19722, 19723]), seconds=rnd.randrange(2 * 86400), microseconds=rnd.randrange(10**6))
        arrived = ts + dt.timedelta(seconds=rnd.choice([1, 3600, 86400, 5 * 86400]))
        rows.append((i, ts, arrived, 1, rnd.choice(["view", "view", "view", "click", None, "ж"]), round(rnd.uniform(-50, 300), 2), "{}", "x", "y"))
    ts = EPOCH + dt.timedelta(days=19721)
    rows += rows[:40]  # repeated
    rows += [(1000, None, ts, 1, "view", 1.0, None, "x", "y"), (1001, ts, None, 1, "view", None, None, "x", "y"), (1002, ts, ts, None, None, float("nan"), None, "x", "y"), (1003, ts - dt.timedelta(days=30000), ts, 1, "", float("inf"), None, "x", "y"), (None, ts, ts, 1, "view", 2.005, None, "x", "y")]
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = panes.panes(clicks, batches=5)
    assert found.columns == ["batch", "record", "kind", "hour", "click_id", "n_rows", "cents"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(walked(rows, 5), key=key)


def test_no_clicks(spark):
    assert panes.panes(spark.createDataFrame([], SCHEMA), batches=2).count() == 0


def test_rings_hold_what_a_dictionary_would():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        ring, want, w, done = None, {}, panes.NEVER, set()
        for step in range(6):
            hours = rnd.integers(-40, 200, 12) * panes.PARTS + 3  # one part; some are far outside the ring
            hours = hours[hours > w - 1 - panes.CLOSED] if w > panes.NEVER else hours
            n, cents = rnd.integers(1, 5, len(hours)), rnd.integers(-(10**14), 10**14, len(hours))
            if not len(hours) and ring is None:
                continue
            ring = ring or panes.Ring(3, int(hours.min() // panes.PARTS))
            old = {h: want.get(h) for h in hours.tolist()}
            ring.add(hours, n, cents)
            for h, k, c in zip(hours.tolist(), n.tolist(), cents.tolist()):
                want[h] = tuple(np.add(want.get(h, (0, 0)), (k, c)))
            ring = panes.Ring.load(ring.dump()) if step == 0 and not ring.new_n.any() and not ring.far[4].any() else ring
            found, _ = ring.advance(w, False)
            got = {name: dict(zip(h.tolist(), zip(k.tolist(), c.tolist()))) for name, h, k, c in found}
            due = {h: v for h, v in want.items() if h not in done and w > panes.NEVER and h <= w - 1 - panes.DUE}
            assert got["emit"] == due
            assert got["retract"] == {h: old[h] for h in old if h in done} and got["replace"] == {h: want[h] for h in old if h in done}
            done |= set(due)
            want = {h: v for h, v in want.items() if w == panes.NEVER or h > w - 1 - panes.CLOSED}
            ring = panes.Ring.load(ring.dump())
            w = max(w, int(rnd.integers(0, 1500)))


def test_sums_are_exact():
    values = np.array([2**53 + 1, -(2**53) - 3, 5, -1], np.int64)
    assert panes.sums(np.array([0, 1, 0, 1]), values, 3).tolist() == [2**53 + 6, -(2**53) - 4, 0]
