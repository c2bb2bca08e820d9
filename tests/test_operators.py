"""Operators against small tables and, over the driver's smallest data, against SQL."""

import functools
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.operators import cadence, facets, feeds, folds, hosts, places, provenance, replay, resolution, upserts
from sparkloom.sources import files, html
from sparkloom.streaming import streams

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df, sql = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in df.columns]
    assert sorted(repr(plain(tuple(r))) for r in df.collect()) == sorted(repr(plain(tuple(r[i] for i in order))) for r in sql.fetchall())


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_scores", "stream_backoff"])
def test_streams_of_files_out_of_order(spark, tmp_path, monkeypatch, name):
    files_at, con = tmp_path / "events.parquet", duckdb.connect()
    files_at.mkdir()
    for place, part in enumerate([3, 0, 4, 1, 2]):
        rows = f"select * exclude (p) from (select *, ntile(5) over (order by ts, event_id) - 1 as p from read_parquet('{SF}/events.parquet')) where p = {part}"
        con.sql(f"copy ({rows}) to '{files_at}/{part}.parquet' (format parquet)")
        os.utime(files_at / f"{part}.parquet", (1_700_000_000 + 60 * place,) * 2)
    con.sql(f"create view events as select * from read_parquet('{files_at}/*.parquet')")
    monkeypatch.setattr(streams, "table_stream", functools.partial(streams.table_stream, files_per_trigger=1))
    df, sql = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
    order = [sql.columns.index(c) for c in df.columns]
    assert sorted(repr(plain(tuple(r))) for r in df.collect()) == sorted(repr(plain(tuple(r[i] for i in order))) for r in sql.fetchall())


def test_whole_tables_are_counted_and_asked_for(spark):
    docs, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "orders"))
    marked = docs.filter("doc_id % 5 <> 0 and source is not null").count()
    assert catalog.QUERIES["phrase_yield_all"](spark, SF).agg(F.sum("found")).first()[0] == marked
    assert {r.id for r in catalog.QUERIES["bulk_reject_all"](spark, SF).collect()} == {r.o_orderkey for r in orders.collect()}


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        facets.page(spark.range(3), [F.col("id")], 0, 10)
    assert facets.page(spark.range(3), [F.col("id")], 2, 2).collect()[0].id == 2


def test_blocked_hosts_and_expiry(spark):
    rows = spark.createDataFrame([("a.b.ua",), ("b.ua",), ("xb.ua",), ("",)], "host string")
    assert {r.host for r in hosts.not_blocked(rows, "host", spark.createDataFrame([("b.ua",)], "host string")).collect()} == {"xb.ua", ""}
    items = spark.createDataFrame([("published", None), ("published", "2020-01-01")], "status string, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    assert [r.status for r in hosts.expire_stale(items, "status", "seen", F.lit("2024-01-01").cast("timestamp"), 30).collect()] == ["published", "expired"]


def test_hosts_to_review(spark):
    table = lambda *x: spark.createDataFrame([(h,) for h in x], "host string")
    rows = [("a.ua", 1, 0.9, 0.0, False), ("b.ua", 4, 0.9, 0.0, True), ("c.ua", 4, 0.9, 0.0, False), ("d.ua", 4, 0.1, 0.1, False), ("x.nv.ua", 4, 0.9, 0.0, False), ("f.ua", 3, 0.0, 0.5, False), ("e.ua", 3, 0.5, 0.0, None), ("g.ua", 9, 0.6, 0.3, False)]
    scores = spark.createDataFrame(rows, "host string, support long, media_ratio double, aggregator_ratio double, provider_evidence boolean")
    found = lambda **given: [r.host for r in hosts.survivors(scores, "host", table("https://www.C.ua/", "c.ua"), table("nv.ua"), **given).collect()]
    assert found() == ["g.ua", "e.ua", "f.ua"] and found(most=2) == ["g.ua", "e.ua"]


def test_labels_and_anchors(spark):
    items = spark.createDataFrame([(1, "https://www.a.ua/x", True, True), (2, "https://s.b.ua", None, None), (3, None, False, False)], "id int, url string, ok boolean, offer boolean")
    blocked = spark.createDataFrame([("b.ua",)], "host string")
    got = hosts.labelled(items, "url", F.col("ok"), F.col("offer"), F.lit(None).cast("boolean"), blocked).select("id", "label", "host", "neg_anchor", "pos_anchor", "is_article")
    assert {tuple(r) for r in got.collect()} == {(1, "pass", "a.ua", False, True, False), (2, "fail", "s.b.ua", True, False, False), (3, "fail", "", False, False, False)}


def test_best_discount_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "percent", 10.0, 0), (1, "fixed", 500.0, 1), (1, "percent", 10.0, 2), (2, None, 1.0, 0), (2, "fixed", None, 1)], "g int, kind string, value double, pos int")
    assert {tuple(r) for r in resolution.best_discount(["g"], rows, "kind", "value", "pos").collect()} == {(1, "percent", 10.0), (2, "fixed", None)}


def test_leaders_are_not_transitive(spark):
    rows = spark.createDataFrame([(1, "h", ["a", "b", "c"], [1], False), (2, "h", ["a", "b", "c", "d"], [1], False), (3, "h", ["b", "c", "d", "e"], [1], False)], "id long, host string, t array<string>, m array<int>, decided boolean")
    assert {tuple(r) for r in resolution.leader_clusters(rows, "host", "id", "t", "m", "decided").collect()} == {(2, 1)}


def test_score_never_falls_below_zero(spark):
    rows = spark.createDataFrame([("h", i, o, e) for i, (o, e) in enumerate([(0, 5), (2, 0), (0, 1)])], "host string, at int, o int, e int")
    state = folds.domain_state(rows, "host", ["at"], F.col("o"), F.col("e"), F.lit(False)).first()
    assert round(state.score, 6) == 1.3 and (state.passes, state.empty_passes, state.skip_left, state.media_streak) == (3, 2, 3, 1)


def test_second_dry_page_starts_over(spark):
    rows = spark.createDataFrame([("p", i, n) for i, n in enumerate([1, 0, 0, 1])], "k string, at int, n int")
    assert tuple(folds.page_cursor(rows, "k", ["at"], F.col("n"), 10).first())[1:] == (2, 0)


def test_merge_keeps_decided_rows(spark):
    now = spark.createDataFrame([(1, "approved", 1), (2, "pending", 2)], "k int, status string, v int")
    new = spark.createDataFrame([(1, "pending", 9), (2, "pending", 9), (3, "pending", 9)], "k int, status string, v int")
    assert {(r.k, r.v) for r in upserts.merge(now, new, ["k"], F.col("status") == "pending").collect()} == {(1, 1), (2, 9), (3, 9)}


def test_retention_keeps_the_newest_even_if_too_large(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 100)], "id int, size int").withColumn("g", F.lit(0))
    assert [r.id for r in feeds.retain_bytes(rows, ["g"], [F.desc("id")], F.col("size"), 10).collect()] == [3]


def test_page_parsing(spark):
    page = "<html><head><title>T</title><meta property='og:type' content='article'></head><nav><p>" + "menu " * 10 + "</p></nav><article><p>" + "text " * 10 + "<a href='/x'>more</a></p><script>var a = '" + "z" * 50 + "'</script></article>"
    assert html.parsed(page).blocks == [("text " * 10 + "more", ["/x"])]
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "page_id long, html string")
    assert html.blocks(df).count() == 1 and html.links(df).count() == 1
    assert [r.is_article for r in html.metadata(df).orderBy("page_id").collect()] == [True, False, False]


def test_files(spark, tmp_path):
    rules, delay, maps = files.robots("User-agent: *\nDisallow: /a\nCrawl-delay: 3\nSitemap: https://x/s.xml")
    assert not rules.can_fetch("*", "https://x/a") and delay == 3 and maps == ["https://x/s.xml"]
    assert files.sitemap_locations(b"<urlset xmlns='n'><url><loc> a </loc></url></urlset>") == ("urlset", ["a"])
    assert files.sitemap_locations(b"junk") == ("urlset", [])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": "x"}\n')
    assert {tuple(r) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string", {"b": ""}).collect()} == {(1, ""), (2, "x")}


def test_names_longest_first_and_marked(spark):
    forms = [(0, "львів", "Львів", False), (1, "львові", "Львів", False), (2, "суми", "Суми", True), (3, "сумах", "Суми", False), (4, "біла церква", "Біла Церква", False), (5, "церква", "Церква", False), (6, "львів", "Інший", False)]
    forms = spark.createDataFrame(forms, "position long, form string, name string, marked boolean")
    texts = [(1, "Акція у Львові"), (2, "великі суми грошей"), (3, "м. Суми, центр"), (4, "у Сумах та місто Біла Церква, Львів, ЛЬВІВ"), (5, "Церква біла"), (6, None), (7, ""), (8, "’львів’")]
    docs = spark.createDataFrame(texts, "id long, text string")
    found = {r.id: r.names for r in places.find_names(docs, "id", "text", forms).collect()}
    assert found == {1: ["Львів"], 2: [], 3: ["Суми"], 4: ["Суми", "Біла Церква", "Львів"], 5: ["Церква"], 6: [], 7: [], 8: ["Львів"]}
    assert {r.id: r.names for r in places.find_names(docs, "id", "text", forms.limit(0)).collect()} == {i: [] for i, _ in texts}


def _sub(seq, **given):
    return {"seq": seq, "source": 1, "hash": f"x{seq}", "article": None, "target": None, "host": None, "mags": [], "tokens": [], "blocked": False, "status": None} | given


def test_replay_rules():
    rule = lambda *subs: [(r[1], r[2], r[3]) for r in replay.replay(list(subs))]
    page = {"article": "a.example/p", "mags": ["percent:10"]}
    assert rule(_sub(1, hash="h"), _sub(2, hash="h"), _sub(3, hash="h", source=None)) == [("new", 1, "pending"), ("same_content", 1, None), ("new", 3, "pending")]
    assert rule(_sub(1, **page), _sub(2, **page)) == [("new", 1, "pending"), ("pending_page", 1, None)]
    assert rule(_sub(1, **page, status="published"), _sub(2, article=page["article"], mags=["percent:10", "free:"])) == [("given", 1, "published"), ("changed_page", 1, None)]
    changed = {"article": page["article"], "mags": ["percent:20"]}
    assert rule(_sub(1, **page, status="published"), _sub(2, **changed), _sub(3, **changed)) == [("given", 1, "published"), ("changed_page", 2, "pending"), ("changed_page", 2, None)]
    assert rule(_sub(1, **page, status="published"), _sub(2, **changed), _sub(3, hash="x1"))[1:] == [("changed_page", 2, "rejected"), ("same_content", 1, None)]
    revived = rule(_sub(1, hash="old", status="expired"), _sub(2, **page, status="published"), _sub(3, **changed), _sub(4, **changed, hash="old"))
    assert revived == [("given", 1, "pending"), ("given", 2, "published"), ("changed_page", 3, "rejected"), ("changed_page", 1, None)]
    assert rule(_sub(1, source=None, **page), _sub(2, source=None, blocked=True, **page)) == [("new", 1, "pending"), ("sourceless_page", 1, None)]
    promo = {"host": "a.example", "tokens": ["a", "b", "c"]}
    assert rule(_sub(1, **promo, mags=["p", "q"]), _sub(2, **promo, mags=["p"]), _sub(3, **promo, mags=["r"])) == [("new", 1, "pending"), ("same_promo", 1, None), ("new", 3, "pending")]
    front = {"host": "a.example", "mags": ["p"]}
    assert rule(_sub(1, **front, article="x.example"), _sub(2, **front, article="a.example/deep"), _sub(3, **front, article="a.example"))[2] == ("front_page", 2, None)
    links = replay.replay([_sub(1, target="t", status="expired"), _sub(2, target="t", host="b"), _sub(3, target="t", host="b"), _sub(4, target="t", blocked=True)])
    assert [(r[1], r[2]) for r in links] == [("given", 1), ("same_target", 1), ("same_target", 1), ("new", 4)] and links[0][6] == 2 and links[3][3] == "rejected"


def test_replay_by_component_is_replay_of_all(spark):
    r = random.Random(5)
    pick = lambda *x: r.choice([None, *x])
    subs = [
        _sub(i, source=pick(1, 2, 3), hash=pick(*map(str, range(40))), article=pick(*(f"h{j}.example{p}" for j in range(12) for p in ("", "/p", "/q"))), target=pick(*map(str, range(60))), host=pick(*map(str, range(25))),
             mags=r.sample("pqr", r.randint(0, 2)), tokens=r.sample("abcde", r.randint(0, 4)), blocked=r.random() < 0.1, status=r.choice([None] * 6 + ["published", "expired"]))
        for i in r.sample(range(1000), 150)
    ]
    df = spark.createDataFrame([tuple(s.values()) for s in subs], replay.FIELDS)
    assert sorted(map(repr, map(tuple, replay.resolve(df).collect()))) == sorted(map(repr, replay.replay(subs)))
    assert replay.resolve(df.limit(0)).collect() == []
    pairs = [(1, "a"), (2, "a"), (2, "b"), (9, "b"), (5, "c"), (7, "c"), (8, "d")]
    assert sorted(map(tuple, replay.key_components(spark.createDataFrame(pairs, "seq long, key string")).collect())) == [(1, 1), (2, 1), (5, 5), (7, 5), (8, 8), (9, 1)]


def test_walk_goes_around_once(spark):
    rows = spark.range(5).withColumn("due", F.col("id") != 4)
    walk = lambda n: cadence.due_walk(rows, "id", 5, 3, F.col("due"), n)
    assert [r.id for r in walk(3).collect()] == [3, 0, 1]
    assert cadence.walk_end(walk(3), 5, 3, 3).first().cursor == 2
    assert cadence.walk_end(walk(9), 5, 3, 9).first().cursor == 3
    assert cadence.walk_end(walk(0), 5, 3, 0).first().cursor == 3


def test_entries_without_a_mark_are_not_drained(spark):
    cache = spark.createDataFrame([("a", 90.0, False), ("b", 80.0, False), ("c", 95.0, None), ("d", None, False), ("e", 50.0, False)], "k string, at double, harvested boolean")
    assert [r.k for r in cadence.drain(cache, "at", "harvested", F.lit(100), 50, "k").collect()] == ["b", "a"]


def test_a_limiter_lets_requests_through_in_turn(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(60), rng.choice([None, 3, 9])) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, at long, delay int")
    found = {(r.k, r.i): r.start for r in cadence.request_times(df, "k", [F.col("i")], F.col("at"), F.col("delay"), 4).collect()}
    for k in "ab":
        last = None
        for _, i, at, delay in (r for r in rows if r[0] == k):
            last = at if last is None else max(at, last + max(4, delay or 0))
            assert found[k, i] == last


def test_items_stop_at_the_cursor(spark):
    items = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "b"), (1, 2, "c", "b"), (2, 0, "a", None), (2, 1, "b", None)], "s int, p int, k string, cur string")
    assert {(r.s, r.k) for r in cadence.new_items(items, "s", [F.col("p")], "k", "cur", 1).collect()} == {(1, "a"), (2, "a")}
    assert {(r.s, r.k) for r in cadence.new_items(items, "s", [F.col("p")], "k", "cur", 9).collect()} == {(1, "a"), (2, "a"), (2, "b")}


def test_accounts_without_state_or_past_cooldown_are_usable(spark):
    accounts = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("x", "c", 2), ("y", "d", 0), ("z", "e", 0)], "platform string, name string, pos int")
    states = spark.createDataFrame([("a", "banned", None), ("b", "cooldown", 10), ("d", "cooldown", 20), ("e", "cooldown", None)], "name string, state string, until long")
    assert {tuple(r) for r in cadence.acquire(accounts, states, "platform", "name", "pos", F.lit(10)).collect()} == {("x", "b"), ("z", "e")}


def test_notes_without_a_mark_count_for_no_phrase(spark):
    batch = spark.createDataFrame([("p: q",), ("r",)], "phrase string")
    notes = spark.createDataFrame([("n: p: q",), ("r",), (None,), ("n: ",)], "note string")
    assert {tuple(r) for r in cadence.yields(batch, "phrase", notes, "note").collect()} == {("p: q", 1), ("r", 0)}


def test_a_blocked_host_is_nobodys_offer(spark):
    def who(**given):
        empty = {"channel": False, "noise": False, "name": "", "ref": "https://a.ua/x", "brand": "A", "host": "a.ua", "blocks": 5, "outbound": 0, "blocked": False, "article": False, "business": False, "own_words": False, "target": None}
        return spark.range(1).select(provenance.attribution(**{k: F.lit(v) for k, v in (empty | given).items()}).alias("x")).first().x

    shop = "https://www.shop.ua/y"
    assert who(blocked=True, target=shop) is None and who() is None and who(article=True, blocks=1) is None
    assert tuple(who(outbound=3, target=shop, own_words=True)) == ("shop.ua", False, "https://www.shop.ua")
    assert tuple(who(own_words=True, target=shop)) == ("A", True, "https://a.ua") == tuple(who(blocks=1))
    assert tuple(who(channel=True, ref="@c")) == ("@c", True, "@c") and who(channel=True, noise=True) is None


def test_equal_new_offers_link_once(spark):
    offers = spark.createDataFrame([(1, "https://a.ua/x", "h", None), (2, "https://a.ua/y", "h", None), (3, "https://b.ua/x", "h", None), (4, None, "h", None), (5, "https://b.ua/y", "h", "b.ua"), (6, "https://b.ua/z", None, None)], "id long, site string, content string, source_host string")
    sources = offers.filter("source_host is not null").select(F.col("source_host").alias("host"))
    found = provenance.promoted(offers.withColumn("article", F.lit(None).cast("string")), sources, "id", F.lit(True), "site", "article", "content")
    assert {tuple(r) for r in found.collect()} == {(1, "a.ua", True, True), (2, "a.ua", True, False), (3, "b.ua", False, False), (6, "b.ua", False, True)}


def test_term_counts_are_made_once(spark):
    from sparkloom.operators import mining

    rows = spark.createDataFrame([("a b", True, "h"), ("b c", False, "g")], "t string, p boolean, h string")
    counts = mining.term_counts(rows, F.split("t", " "), F.col("p"), F.lit(1), F.col("h"), F.lit(False))
    scores = mining.log_odds(counts)
    assert scores.count() == 3 and "Generate explode" not in scores._jdf.queryExecution().optimizedPlan().toString()


def test_replay_by_class_is_replay_by_tokens():
    rnd = random.Random(3)
    subs = [_sub(i, hash=f"h{i}", article=rnd.choice(["a", "a/1", "a/2", "a/3"]), host="a", source=rnd.choice([None, 1, 2]), mags=[rnd.choice("pq")], tokens=sorted(rnd.sample("abcde", 3)), blocked=rnd.random() < 0.1) for i in range(200)]
    kinds = sorted({(tuple(s["mags"]), tuple(s["tokens"])) for s in subs})
    like = lambda a, b: set(a[0]) <= set(b[0]) and len(set(a[1]) & set(b[1])) >= 0.6 * len(set(a[1]) | set(b[1]))
    named = []
    for s in subs:
        own = (tuple(s["mags"]), tuple(s["tokens"]))
        named.append({k: v for k, v in s.items() if k != "tokens"} | {"class": kinds.index(own), "likes": [i for i, k in enumerate(kinds) if like(own, k)]})
    assert replay.replay(iter(named), ordered=True) == replay.replay(subs)
