"""Offers in texts, pages and their trees, decisions, sitemaps: rules that the registered queries do not reach."""

import pytest
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.functions import display, offers
from sparkloom.functions import urls as U
from sparkloom.operators import extraction, hosts, places, publishing, resolution, walks
from sparkloom.sources import files, html, sites


def values(spark, column, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    long = "слово " * 30
    got = values(spark, offers.headline, "  Знижка 2.5 % сьогодні! Далі\nдруга", "без кінця", "", None, long, "x" * 100, "Ціна 3.5", "Що? Так")
    assert got == ["Знижка 2.5 % сьогодні!", "без кінця", "", "", " ".join(["слово"] * 13), "x" * 80, "Ціна 3.5", "Що?"]


def test_discounts(spark):
    url = F.lit("https://a.ua/x")
    kinds = lambda *texts: [(r.kind, r.value) if r else None for r in values(spark, lambda t: offers.discount(t, url), *texts)]
    assert kinds("знижка 20 % ветеранам", "20% ветеранам", "знижка 100 грн", "ціна від 100 грн до 200 грн, знижка", "безкоштовно", "безкоштовно для ветеранів", "безкоштовна доставка ветеранам", "0 грн для ЗСУ", "10 грн для ЗСУ", "Акціонерам 5%", None) == [
        ("percent", "20"), None, ("fixed", "100"), None, None, ("free", None), None, ("free", None), None, None, None,
    ]


def test_triggers_and_raised_prices(spark):
    assert values(spark, offers.triggered, "Розпродаж!", "Подорожчання, бонус", "Подорожчання, але знижка", "Нічого", "", None) == [True, False, True, False, False, False]
    assert values(spark, lambda t: offers.triggered(t, ("дарма",)), "дарма") == [True]


def test_dates(spark):
    got = values(spark, lambda t: offers.valid_until(t, 2026).cast("string"), "до 1.2", "діє до 31-12-29", "до 3/4/2031", "до 31.02", "1.2.2030", "дo 1.2", None)
    assert got == ["2026-02-01", "2029-12-31", "2031-04-03", None, None, None, None]


def test_stems_begin_words(spark):
    names = lambda t: F.array_join(offers.labels(t, offers.AUDIENCES), ",")
    assert values(spark, names, "ЗСУ", "зсув", "воїнам", "воїнський", "не-ветеран", "екветеран", "вдоволення вдова", None) == ["warrior", "", "warrior", "", "veteran", "", "fallen-family", ""]


def test_locations(spark):
    rows = spark.createDataFrame([("Київ", ["Київ"], ["Львів", "Київ"], ""), (" Село ", [], [], "онлайн"), (None, [], [], "Інтернет-магазин"), ("", [], [], "x")], "l string, c array<string>, f array<string>, t string")
    assert [r.x for r in rows.select(offers.locations(F.col("l"), F.col("c"), F.col("f"), F.col("t")).alias("x")).collect()] == [["Київ", "Львів"], ["Село"], ["Онлайн"], []]


def test_a_page_without_discount_has_no_headline(spark):
    none = "array<struct<label string, kind string, value string>>"
    row = spark.range(1).select(F.lit(1).alias("page"), F.lit(1).alias("p"), F.array().cast(none).alias("discounts"), *(F.array().cast("array<string>").alias(c) for c in ("audiences", "kinds", "locations")), *(F.lit("x").alias(c) for c in ("title", "provider", "site_url", "article_url")), F.lit(None).cast("date").alias("valid_until"), F.lit(None).cast("string").alias("target_url"))
    got = extraction.page_offers(row, "page", "p").first()
    assert (got.kind, got.value, got.target_url, got.discounts) == (None, None, None, [])


def test_what_pages_say_of_themselves():
    page = """<html><head><link rel="icon" href="/i.png"><meta property="og:type" content="Article"><script type="application/ld+json">{bad</script>
    <script type="application/ld+json">[{"@type": "Restaurant", "address": [{}, {"addressLocality": "Lviv"}]}, {"@type": "WebSite", "logo": "javascript:x"}]</script></head><body>
    <header><a class="Brand"><img src="//cdn.ua/b.png" alt="footer-logo"></a><a><img src="/c.png" alt=" Good   Name "></a></header><p class="x site-slogan">We  are<br>good</p><address>Kyiv</address></body>"""
    p = sites.Page(page, "https://a.ua/x/2020/13/y")
    assert p.said() == ("https://a.ua/i.png", "https://cdn.ua/b.png", "Good Name", None, "We are good", "Lviv", False, True, True) and p.contact() == "Kyiv"
    assert sites.Page("<title></title><h1>Head</h1>", None).site_name() == "Head" and sites.Page(None, None).said() == (None, None, None, None, None, None, False, False, False)
    assert [sites.Page("", u).is_article() for u in ("https://a.ua/2020/05/x", "https://a.ua/1234/56", "https://a.ua/x/2020/12")] == [True, False, True]
    assert sites.safe_url("https://a.ua", "data:x") is None and len(sites.safe_url("https://a.ua", "/" + "x" * 5000)) == 1024


def test_blocks_of_broken_pages():
    texts = lambda page: [t for t, _ in sites.Page(page, "").blocks()]
    long = "a text that is long enough to be a block"
    assert texts(f"<p><b>{long} 1<p>{long} 2</div></p>") == [f"{long} 1", f"{long} 2"]
    assert texts(f"<table><tr><td>{long} 1<td>{long} 2<tr><th>{long} 3</table>") == [f"{long} {i}" for i in (1, 2, 3)]
    assert texts(f"<dl><dt>{long} 1<dd>{long} 2</dl><figure>{long} 3<figcaption>{long} 4</figure><nav><p>{long}</nav>") == [f"{long} {i}" for i in (1, 2, 4)]
    assert texts("<div>" * 3000 + long) == [long] and texts("<" * 100) == []


def test_channel_posts(spark):
    pages = spark.createDataFrame([(1, None), (2, "<div class='tgme_widget_message' data-post='c/1'>x</div>")], "source_id long, html string")
    cursors = spark.createDataFrame([(1, "old"), (2, "c/1")], "source_id long, cursor string")
    read = sites.channel_items(pages, cursors)
    assert read.count() == 0 and {(r.source_id, r.cursor) for r in sites.advanced(read, cursors).collect()} == {(1, "old"), (2, "c/1")}


def test_sitemaps_are_read_up_to_a_number(spark):
    body = lambda kind, *found: f"<{kind}>" + "".join(f"<loc>{x}</loc>" for x in found) + f"</{kind}>"
    documents = spark.createDataFrame([("i", body("sitemapindex", "a", "b", "i", "c")), ("a", body("urlset", "1", "2")), ("b", body("urlset", "2", "3")), ("c", body("urlset", "4")), ("e", None)], "url string, body string")
    seeds = spark.createDataFrame([("d", 0, "i"), ("e", 0, "e"), ("f", 0, "lost")], "domain string, pos long, url string")
    got = lambda *more: [r.url for r in sites.sitemap_pages(seeds, documents, "domain", F.col("url") == "none", *more).orderBy("domain", "place").collect()]
    assert got() == ["1", "2", "3", "4"] and got(None, 3) == ["1", "2", "3"] and got(F.col("url") > "1", 50, 1) == ["1", "2"]


def test_robots_of_unknown_domains_allow(spark):
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x"), ("b", None)], "domain string, text string")
    asked = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/y"), ("b", "https://b/x"), ("c", "https://c/x")], "domain string, url string")
    assert sorted(r.allowed for r in sites.robots_rules(robots, asked, "domain").collect()) == [False, True, True, True]


def test_a_missing_key_is_an_error(spark):
    table = spark.createDataFrame([(1, "x")], "id long, v string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert publishing.looked_up(ids.limit(1), table, "id").count() == 1
    with pytest.raises(Exception, match="not found: 2"):
        publishing.looked_up(ids, table, "id").collect()


def test_published_parents_stay_as_they_are_if_undecided(spark):
    rows = spark.createDataFrame([(1, "pending", None, 0), (2, "pending", 1, 0), (3, "published", None, 0), (4, "pending", 3, 0)], "id long, status string, supersedes long, last_seen long")
    got = {r.id: (r.status, r.supersedes, r.last_seen) for r in publishing.published(rows, F.col("id").isin(2, 4), F.lit(9)).collect()}
    assert got == {1: ("pending", None, 0), 2: ("published", None, 9), 3: ("expired", None, 0), 4: ("published", None, 9)}


def test_long_texts_and_wide_names_in_places(spark):
    forms = spark.createDataFrame([(0, "new york", "NY", False), (1, "york", "York", False), (2, "new york city", "NYC", False)], "position long, form string, name string, marked boolean")
    docs = spark.createDataFrame([(1, "in New York city and york, new"), (2, "x " * 20_000 + "new york"), (3, None), (4, "")], "id long, t string")
    assert {r.id: r.names for r in places.find_names(docs, "id", "t", forms).collect()} == {1: ["NYC", "York"], 2: ["NY"], 3: [], 4: []}


def test_many_equal_items_are_one_class(spark):
    rows = spark.range(20_000).select("id", F.lit("h").alias("host"), F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, "abcde"))).otherwise(F.array(*map(F.lit, "abcdef"))).alias("t"), F.array(F.lit("percent:5")).alias("m"))
    got = resolution.promo_duplicates(rows, "host", "id", "t", "m")
    assert got.agg(F.count("*"), F.max("keep_id")).first()[:] == (19_999, 0)


def test_display(spark):
    rows = spark.createDataFrame([("percent", 20.0), ("percent", 12.5), ("free", None), ("fixed", None), (None, 3.0)], "k string, v double")
    assert [r.x for r in rows.select(display.discount_label(F.col("k"), F.col("v")).alias("x")).collect()] == ["−20%", "−12.5%", "безкоштовно", "", ""]
    assert values(spark, display.channel_handle, "@Abc", "https://t.me/Abc/12", "abc?x", None) == ["abc", "abc", "abc", ""]


def test_links_resolve(spark):
    got = values(spark, lambda t: U.resolved(F.lit("https://a.ua/b/c?d#e"), t), "", None, "mailto:x@y", "HTTPS://B.ua", "./x/../y?z=../1", "/../x")
    assert got == ["https://a.ua/b/c?d", "https://a.ua/b/c?d", None, "HTTPS://B.ua", "https://a.ua/b/y?z=../1", "https://a.ua/x"]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    with pytest.raises(RuntimeError):
        storage.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077")))


def test_blocks_and_links_of_one_parser():
    page = html.parsed("<ul><li><a href='/x'>one</a> and more words of this entry here</ul>")
    assert page.blocks == [("one and more words of this entry here", ["/x"])] and page.links == [("/x", "one")]


def test_always_blocked_hosts(spark):
    rows = spark.createDataFrame([("x.gov.ua",), ("gov.ua",), ("xgov.ua",), ("a.b.ua",), ("b.ua",)], "host string")
    assert {r.host for r in hosts.not_blocked(rows, "host", spark.createDataFrame([("b.ua",)], "host string")).collect()} == {"xgov.ua"}


def test_walks_end(spark):
    homes = spark.createDataFrame([("d", "https://d.com/"), ("e", "https://e.com/")], "domain string, url string")
    links = spark.createDataFrame([("https://d.com/", i, f"https://d.com/n{i}", "") for i in range(5)] + [(f"https://d.com/n{i}", 0, f"https://d.com/promo{i}", "") for i in range(5)] + [("https://d.com/n0", 1, "https://d.com/", "")], "page string, pos long, url string, anchor string")
    urls_of = lambda rows: [r.url for r in rows.orderBy("domain", "place").collect()]
    assert urls_of(walks.reached(homes, links, "domain")) == [f"https://d.com/promo{i}" for i in range(5)]
    assert urls_of(walks.reached(homes, links, "domain", 2, 3)) == ["https://d.com/promo0", "https://d.com/promo1"] and urls_of(walks.reached(homes, links, "domain", 1)) == []
    found = spark.createDataFrame([("d", 1, "https://www.d.com/en/promo/"), ("d", 2, "https://d.com/promo"), ("d", 3, "https://d.com/about")], "domain string, place long, url string")
    none = spark.createDataFrame([], "domain string, url string, allowed boolean")
    assert urls_of(walks.plan(homes, found, "domain", none, 9)) == ["https://d.com/", "https://www.d.com/en/promo/", "https://d.com/about", "https://e.com/"]


def test_state_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in (3, 1):
        files.save_state(spark.range(n), path)
    assert files.json_lines(spark, path, "id long, v string", {"v": "x"}).collect() == [(0, "x")] and files.json_lines(spark, path + "none", "id long").count() == 0
    assert [p.name for p in tmp_path.iterdir() if "." in p.name.strip(".")] == []


def test_a_reference_that_was_cut_off_stays(spark):
    page = "<html><head><title>Salt &amp; oil &amp</title></head><body><p>Thirty letters and more of salt &amp; oil &copy</p><p><a href='/x?a=1&copy=2'>link</a></p></body></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.title for r in html.metadata(pages).orderBy("page_id").collect()] == ["Salt & oil &amp", None]
    assert [r.text for r in html.blocks(pages).collect()] == ["Thirty letters and more of salt & oil &copy"]
    assert [r.href for r in html.links(pages).collect()] == ["/x?a=1&copy=2"]


def test_the_first_block_of_a_page_leads_by_its_place(spark, tmp_path):
    """Items over a million move a line's place behind the next one's, in the title as in the SQL."""
    from sparkloom.plans import extraction as plans  # noqa: F401
    from sparkloom.plans.queries import QUERIES

    line = spark.range(1).select(F.lit(1).cast("long").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1_100_000).cast("long").alias("l_partkey"), F.lit(5).cast("long").alias("l_suppkey"), F.lit(3.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.title for r in QUERIES["page_offers"](spark, str(tmp_path)).collect()] == ["T2"]


def test_an_offer_and_its_accounts_are_made_once(spark):
    """Patterns are in the plan once for each time that they are tried on a text."""
    rows = spark.createDataFrame([("@Shop_a t.me/shop_A instagram.com/x.y facebook.com/zz @other1", "https://a.ua/x")], "body string, url string")
    found = rows.select(F.explode_outer(U.handles(F.col("body"))).alias("x")).filter("x is not null")
    assert [(r.x.type, r.x.handle) for r in found.collect()] == [("telegram", "shop_A"), ("telegram", "other1"), ("instagram", "x.y"), ("facebook", "zz")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("facebook\\.com/(") == 1
    none = F.lit(None).cast("string")
    offer = offers.candidate(F.col("body"), F.col("url"), F.lit("Заклад"), none, none, none, F.array().cast("array<string>"), 2030)
    plan = rows.select(F.explode(F.array(offer)).alias("o")).select("o.kind", "o.value", "o.title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(offers.PRICE_RANGE) == 1
