"""Histories, running values and numbers are the same however a hot key is cut."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cadence, feeds, folds, ordered


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(6)}", rnd.randrange(400), i, rnd.choice(["offer", "error", "own", "none"])) for i in range(1500)] + [("one", 5, 9999, "error"), ("same", 1, 1, "none"), ("same", 1, 2, "offer")]
    return spark.createDataFrame(rows, "k string, at long, id long, kind string").repartition(7)


def walked(events, step, first):
    out = {}
    for r in sorted(events.collect(), key=lambda r: (r.k, r.at, r.id)):
        out[r.k] = step(out.get(r.k, first), r)
    return out


@pytest.mark.parametrize("piece", [4096, 7])
def test_folds_in_pieces(events, monkeypatch, piece):
    monkeypatch.setattr(folds, "PIECE", piece)
    kind = F.col("kind")
    got = folds.domain_state(events, "k", ["at", "id"], (kind == "offer").cast("int"), (kind == "error").cast("int"), kind == "own").collect()

    def step(s, r):
        o, e = r.kind == "offer", r.kind == "error"
        return (max(0.0, s[0] * 0.9 + o - 0.5 * e), s[1] + o, s[2] + e, s[3] + 1, s[4] + (not o), 0 if o else 3, 0 if r.kind == "own" else s[6] + o, s[7] or r.kind == "own")

    want = walked(events, step, (0.0, 0, 0, 0, 0, 0, 0, False))
    assert {r.k: tuple(r[1:]) for r in got} == {k: (pytest.approx(v[0], abs=1e-9), *v[1:]) for k, v in want.items()}

    def turn(s, r):
        page, dry = s
        if r.kind == "offer":
            return (1 if page >= 4 else page + 1), 0
        return (1, 0) if dry + 1 >= 2 or page >= 4 else (page + 1, dry + 1)

    pages = folds.page_cursor(events, "k", ["at", "id"], (kind == "offer").cast("int"), 4).collect()
    assert {r.k: (r.page, r.dry) for r in pages} == walked(events, turn, (1, 0))


def test_back_off_needs_no_history(events):
    def step(s, r):
        if r.kind != "error":
            return (0, 0.0, 0.0, 0.0)
        n, t = s[0] + 1, float(r.at)
        return (n, t + min(10.0 * 2 ** (n - 1), 60.0), t + 500 if n >= 2 else s[2], t + 90 if n >= 2 else s[3])

    got = folds.backoff_state(events, "k", ["at", "id"], F.col("at"), F.col("kind") == "error", 10.0, 60.0, 2, 500.0, 90.0).collect()
    assert {r.k: tuple(r[1:]) for r in got} == walked(events, step, (0, 0.0, 0.0, 0.0))


def test_running_values_of_a_hot_group(events, monkeypatch):
    def both(f):
        out = []
        for most in (1_000_000, 5):
            monkeypatch.setattr(ordered, "GROUP_ROWS", most)
            out.append(sorted(map(tuple, f().collect())))
        assert out[0] == out[1] and out[0]

    order, at = [F.col("at"), F.col("id")], F.col("at")
    both(lambda: feeds.budget_prefix(events, ["k"], order, F.col("kind") == "offer", 20))
    both(lambda: feeds.retain_bytes(events, ["k"], [F.desc("at"), F.desc("id")], at, 9000))
    both(lambda: cadence.request_times(events, "k", order, at, F.when(F.col("kind") == "own", 4), 1))


def test_numbers_along_an_order(events):
    got = ordered.numbered(events, ["k", "at", "id"]).collect()
    assert [(r.k, r.at, r.id) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.k, r.at, r.id) for r in events.collect()) and sorted(r.pos for r in got) == list(range(len(got)))


def test_an_axis_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(feeds, "AXIS_WORDS", 2)
    axis = spark.createDataFrame([(i, f"w{i}") for i in range(3)], "pos long, word string")
    assert feeds.grid(axis, axis.limit(2)).count() == 6
    with pytest.raises(ValueError):
        feeds.grid(axis.limit(2), axis)


def test_feeds_and_cursors_of_hot_groups(spark, monkeypatch):
    """What a hot feed or source gives does not depend on whether it is walked in one piece or by ranges."""
    rows = spark.createDataFrame([(1 if i % 5 else 2 + i % 3, i, "x" if i in (30, 7, 61) else None if i % 11 == 0 else "y") for i in range(200)], "s long, p long, k string").withColumn("cur", F.lit("x")).repartition(6)
    found = []
    for limit in (ordered.GROUP_ROWS, 10):
        monkeypatch.setattr(ordered, "GROUP_ROWS", limit)
        found.append((
            sorted(map(repr, feeds.interleave(rows, "s", [F.desc("p")]).select("s", "p", "round").collect())),
            sorted(map(repr, feeds.newest(rows, ["s"], [F.desc("p")], 7).select("s", "p").collect())),
            sorted(map(repr, cadence.new_items(rows, "s", [F.col("p")], "k", "cur", 25).select("s", "p").collect())),
        ))
    assert found[0] == found[1]
    hot = sorted(i for i in range(200) if i % 5)
    assert sum("s=1," in r for r in found[0][1]) == 7
    assert sum("s=1," in r for r in found[0][2]) == hot.index(7)
