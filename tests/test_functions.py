"""Column functions against small examples."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import urls as U


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("url", "expected"), [
    ("https://WWW.Shop.ua:8080/a/?utm_source=x&b=2&a=1#f", "shop.ua/a?a=1&b=2"),
    ("http://user@shop.ua/p/?page=2&q=%D0%B7+x", "shop.ua/p?q=%D0%B7+x"),
    ("https://shop.ua/?blank=&GCLID=1", "shop.ua"),
    ("ftp://shop.ua/x", None), ("", None), (None, None),
])
def test_canonical_target(spark, url, expected):
    assert one(spark, url, U.canonical_target) == expected


@pytest.mark.parametrize(("value", "foreign", "geo"), [
    ("https://shop.pl/x", True, False), ("https://shop.ua", False, False), ("https://spb.x.com", True, True), ("https://x.com/minsk/a", False, True),
    ("https://x.com/spbank", False, False), ("https://a.io", False, False), ("https://x.ua/spb", False, False), ("", False, False),
])
def test_geography(spark, value, foreign, geo):
    assert bool(one(spark, value, U.is_foreign)) is foreign
    assert bool(one(spark, value, U.is_aggressor_geo)) is geo


def test_hosts(spark):
    assert one(spark, "//u@www.Shop.ua:1/x", U.bare_host) == "shop.ua"
    assert one(spark, "a.b.ua", U.host_suffixes) == ["a.b.ua", "b.ua", "ua"]
    assert one(spark, "https://x.gov.ua/", U.is_low_value) and one(spark, "https://en.wikipedia.org", U.is_low_value)
    assert one(spark, "https://lvivnews.ua", U.is_news) and one(spark, "https://a.media", U.is_news) and not one(spark, "", U.is_news)
    assert one(spark, "HTTP://M.shop.ua/uk/sale/", U.website_key) == "shop.ua/sale"
    assert one(spark, "https://t.me/Shop_UA", U.normalized_ref) == "shop_ua"
    assert one(spark, "https://instagram.com/x", U.candidate_type) == "instagram" and one(spark, "https://instagram.com/p/1", U.candidate_type) is None


def test_text(spark):
    assert sorted(one(spark, "Знижка 10% для ветеранів та the", T.tokens)) == sorted(["знижка", "10", "ветеранів"])
    assert one(spark, "один два три", lambda c: T.bigrams(T.words(c))) == ["один два", "два три"]
    assert one(spark, "", lambda c: T.bigrams(T.words(c))) == []
    assert one(spark, "знижка -15 % до 01.02.25", T.percent_off) == 15
    assert str(one(spark, "до 01.02.25", lambda c: T.until_date(c, 2026))) == "2025-02-01"
    assert one(spark, "до 30.02", lambda c: T.until_date(c, 2026)) is None
    assert one(spark, "субдзнижка знижки", lambda c: T.classify(c, {"a": ("убд",), "b": ("знижк",)})) == ["b"]
    assert one(spark, "Hello there everybody who reads", T.is_not_script) and not one(spark, "short", T.is_not_script)
    assert one(spark, "First line. Second.\nThird", T.title_from) == "First line."
    assert one(spark, "пишіть @Shop_One або a@b.com", T.handles) == ["shop_one"]
    assert one(spark, " A  b\n", T.normalized) == "a b"
