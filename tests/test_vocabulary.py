"""Lists that are kept between passes, by the rules that a plain walk gives."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import cadence, extraction, provenance, vocabulary


def test_service_terms_are_those_of_a_walk(spark):
    rnd = random.Random(3)
    terms = ["Кава", "кава", " кава", "музей", "МУЗЕЙ", "спорт", "", "x", "X ", None]
    for cap in (0, 2, 100):
        entries = [(i, rnd.choice(terms), rnd.choice(["category", "miner", None]), rnd.choice([None, 1.0, 2.5])) for i in range(30)]
        seed = [(i, rnd.choice(terms)) for i in range(4)]
        known, cats, mined = set(), [], []
        for _, term, _, _ in (e for e in entries if e[1] and e[2] == "category"):
            if term.lower() not in known:
                known.add(term.lower())
                cats.append(term)
        known = set()
        for _, term, _, _ in sorted((e for e in entries if e[1] and e[2] != "category"), key=lambda e: (-(e[3] or 0), e[1], e[0])):
            if term.lower() not in known:
                known.add(term.lower())
                mined.append(term)
        want, known = [], set()
        for term in [s for _, s in seed] + cats + (mined[:cap] if cap else mined):
            k = (term or "").strip().lower()
            if k and k not in known:
                known.add(k)
                want.append(term)
        got = vocabulary.service_terms(spark.createDataFrame(seed, "place long, term string"), spark.createDataFrame(entries, "place long, term string, source string, z double"), cap)
        order = {"seed": 0, "category": 1, "mined": 2}
        assert [r.term for r in sorted(got.collect(), key=lambda r: (order[r.part], r.place))] == want


def test_a_stopped_term_keeps_its_score(spark):
    candidates = spark.createDataFrame([("a", 2.0, 1), ("b", None, 2), ("c", 3.0, 3)], "term string, z double, support long")
    stop = spark.createDataFrame([("c", 9.0)], "term string, z double")
    left, after = vocabulary.stopped(spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("new",)], "term string"), candidates, stop)
    assert left.collect() == [] and left.columns == candidates.columns
    assert sorted(map(tuple, after.collect())) == [("a", 2.0), ("b", 0.0), ("c", 9.0), ("new", 0.0)]
    assert sorted(r.term for r in vocabulary.unstopped(spark.createDataFrame([("a",), ("zz",)], "term string"), after).collect()) == ["b", "c", "new"]


def test_hosts_are_added_behind_and_cut_from_the_front(spark):
    store = spark.createDataFrame([(0, "z"), (1, "b")], "place long, host string")
    found = spark.createDataFrame([("c",), ("a",), ("b",), ("",), (None,), ("a",)], "host string")
    in_order = lambda df: [r.host for r in sorted(df.collect(), key=lambda r: r.place)]
    assert in_order(vocabulary.added(store, found, 10)) == ["z", "b", "a", "c"]
    assert in_order(vocabulary.added(store, found, 3)) == ["b", "a", "c"]
    assert in_order(vocabulary.added(store, found, 1)) == ["c"]
    assert in_order(vocabulary.added(store.limit(0), found, 2)) == ["b", "c"]


def test_brands_take_the_first_way_that_leads_somewhere(spark):
    brands = spark.createDataFrame([(1, "Q1"), (2, "Q9"), (3, None), (4, None), (5, "Q2")], "key long, qid string")
    sites = spark.createDataFrame([("Q1", "one.ua"), ("Q2", ""), ("Q3", "three.ua")], "qid string, host string")
    tags = spark.createDataFrame([(1, "Q3", "x.ua", 0), (2, "Q3", "y.ua", 0), (3, "", "b.ua", 0), (3, "Q8", "a.ua", 1), (3, None, "a.ua", 2), (3, "Q3", "b.ua", 3), (5, "", "", 0)], "key long, qid string, host string, pos long")
    got = {r.key: (r.host, r.way) for r in vocabulary.brand_hosts(brands, sites, tags).collect()}
    assert got == {1: ("one.ua", "own"), 2: ("three.ua", "entry"), 3: ("b.ua", "places")}


def test_the_first_item_is_the_next_cursor(spark):
    items = spark.createDataFrame([("s", 3, "c"), ("s", 9, "a"), ("s", 9, "b"), ("t", None, "x")], "source string, at long, key string")
    got = cadence.first_item(items, "source", [-F.col("at"), F.col("key")], "key")
    assert {r.source: r.cursor for r in got.collect()} == {"s": "a", "t": "x"}


def test_older_attribution(spark):
    rows = [(True, "b", "h", 1, True, "https://t.ua/x", False), (False, "b", "h", 5, True, "https://t.ua/x", False), (False, "b", "h", 5, False, "https://t.ua/x", False), (False, "b", "h", 1, False, "https://t.ua/x", True),
            (False, "", "h", 1, True, None, None), (False, "b", None, 2, None, "", None), (None, "b", "h.ua", 0, None, None, None)]
    frame = spark.createDataFrame(rows, "blocked boolean, brand string, host string, blocks long, own boolean, target string, bad boolean")
    c = F.col
    got = frame.select(provenance.plain_attribution(F.lit("x"), c("brand"), c("host"), c("blocks"), c("blocked"), c("own"), c("target"), c("bad")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in got] == [None, ("b", True, "https://h"), ("t.ua", False, "https://t.ua"), ("b", True, "https://h"), None, None, ("b", True, "https://h.ua")]


def test_promo_pages_come_first_in_their_order(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "id long, promo boolean").repartition(4)
    assert [r.id for r in extraction.promo_first(rows, F.col("promo"), "id").collect()] == [0, 3, 6, 9, 1, 2, 4, 5, 7, 8]
