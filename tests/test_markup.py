"""What pages say, where quotes, comments, entities and missing ends are in the way."""

from pyspark.sql import functions as F

from sparkloom.functions import markup

PAGE = """<!DOCTYPE html><HTML class=x Lang='uk-UA'><head><!-- <title>no</title> --><title>
 A &amp;lt; B &quot;c&quot; </title><meta content="x > y &amp; z" property="og:title"/><meta name=description content=short>
<meta property='og:description' content=''><script type="a">if (a < b) { "<a href='no'>" }</script><style>p > a {}</style></head>
<body><p>one<b>two</b>&nbsp;three<br/>four<a href="/a?b=1&amp;c=2">x</a><A HREF='/q"x'>y</A><a name=n>z</a><a href=>w</a><abbr href="no">v</abbr><a title="a>b" href=/u/v>s</a> 1 &lt; 2"""


def one(spark, make, html):
    return spark.createDataFrame([(html,)], "h string").select(make(F.col("h"))).first()[0]


def test_what_a_page_says(spark):
    assert one(spark, markup.title, PAGE) == 'A &lt; B "c"'
    assert one(spark, markup.language, PAGE) == "uk"
    assert one(spark, lambda h: markup.meta(h, "og:title"), PAGE) == "x > y & z"
    assert one(spark, lambda h: markup.meta(h, "description", "name"), PAGE) == "short"
    assert one(spark, lambda h: markup.meta(h, "og:image"), PAGE) is None
    assert one(spark, markup.card, PAGE) == "x > y & z"
    assert one(spark, markup.links, PAGE) == ["/a?b=1&c=2", '/q"x', "/u/v"]
    text = one(spark, markup.visible_text, PAGE)
    assert text.startswith('A &lt; B "c" one two three four x y z w v') and text.endswith("1 < 2") and "no" not in text.split() and "if" not in text.split()


def test_pages_that_say_nothing(spark):
    for html in (None, "", "plain", "<html><head></head>", "<!-- open", "<a"):
        assert one(spark, markup.links, html) == [] and one(spark, markup.card, html) is None and one(spark, markup.title, html) == ""
        assert one(spark, markup.language, html) is None
    assert one(spark, markup.visible_text, None) == "" and one(spark, markup.visible_text, " a\n<b> c") == "a c"
    assert one(spark, markup.language, "<html lang=''>") is None
    assert len(one(spark, markup.visible_text, "<p>word " * 50_000)) == 5 * 50_000 - 1


def test_a_text_in_an_attribute_is_read_as_it_was(spark):
    text = "Salt &amp; \"oil\" <b> it's &"
    row = spark.createDataFrame([(text,)], "t string").select(F.concat(F.lit("<meta content=\""), markup.quoted(F.col("t")), F.lit("\" property='og:title'>")).alias("h"))
    assert row.select(markup.card(F.col("h"))).first()[0] == text
