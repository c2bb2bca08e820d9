"""Queries of what pages say, over their whole HTML; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import is_not_script
from .queries import c, lit, query

_SHOWN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"


def _plain(sql: str) -> str:
    for entity, char in markup.ENTITIES:
        sql = f"replace({sql}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql


_TEXT = rf"trim(regexp_replace({_plain(rf"regexp_replace({_SHOWN}, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g'))"
_TITLE = rf"trim(regexp_replace({_plain(rf"regexp_extract({_SHOWN}, '(?is)<title(?:\s[^>]*)?>([^<]*)', 1)")}, '\s+', ' ', 'g'))"
_LANG = rf"nullif(lower(split_part(regexp_extract({_SHOWN}, '(?i)<html[^>]*\slang=\"([^\"]*)\"', 1), '-', 1)), '')"


@query(f"""select page_id, {_TITLE} as title, {_LANG} as lang, {_TEXT} as text, cast(len(regexp_extract_all({_SHOWN}, '(?i)<a\\s[^>]*href="[^"]')) as bigint) as n_links from pages""")
def page_texts(t, spark, sf):
    """Title, language, visible text and number of links of all pages."""
    return t("pages").select("page_id", markup.title(c("html")).alias("title"), markup.language(c("html")).alias("lang"), markup.visible_text(c("html")).alias("text"), F.size(markup.links(c("html"))).cast("long").alias("n_links"))


@query(rf"""with p as (select page_id, {_TITLE} as title, regexp_extract(html, '<h1>([^<]*)', 1) as h from pages where page_id % 3 > 0),
i as (select page_id, case when page_id % 3 = 1 then trim(title) else trim(title || ' ' || substr(trim(h), 1, 40)) end as text from p)
select page_id, sha1(text) as key, text from i where text <> ''""")
def page_cards(t, spark, sf):
    """The item that a page's metadata makes; of two pages in three the metadata is its own title, and for one its heading too."""
    own = lambda name, value: F.concat(lit(f'<meta content="'), markup.quoted(value), lit(f"\" property='{name}'>"))  # noqa: E731, F541
    head = F.when(c("page_id") % 3 == 1, own("og:title", markup.title(c("html")))).when(c("page_id") % 3 == 2, F.concat(own("og:title", markup.title(c("html"))), own("og:description", F.substring(F.trim(F.regexp_extract("html", "<h1>([^<]*)", 1)), 1, 40)))).otherwise("")
    made = t("pages").select("page_id", markup.card(F.replace("html", lit("<head>"), F.concat(lit("<head>"), head))).alias("text"))
    return made.filter("text is not null").select("page_id", F.sha1("text").alias("key"), "text")


_LATIN, _CYRILLIC = "abvhgdezyklmnoprstuf", "абвгґдезиклмнопрстуф"


@query(rf"""with p as (select page_id, case when page_id % 5 = 0 then 'uk' else {_LANG} end as lang, case when page_id % 2 = 0 then translate({_TEXT}, '{_LATIN}', '{_CYRILLIC}') else {_TEXT} end as text from pages),
n as (select *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(text, '[^\x{{0400}}-\x{{04FF}}]', '', 'g')) as own from p)
select page_id, letters >= 15 and case when letters > 0 then own / letters else 0 end < 0.3 and coalesce(lang not in ('uk', 'ua'), true) as "foreign" from n""")
def page_languages(t, spark, sf):
    """Whether a page is in another script and names no native language; every second one is put into Cyrillic letters by rule."""
    html = F.when(c("page_id") % 5 == 0, F.regexp_replace("html", '<html lang="[^"]*"', "<html lang='UK-UA'")).otherwise(c("html"))
    text = markup.visible_text(c("html"))
    text = F.when(c("page_id") % 2 == 0, F.translate(text, _LATIN, _CYRILLIC)).otherwise(text)
    native = F.coalesce(markup.language(html).isin("uk", "ua"), lit(False))
    return t("pages").select("page_id", (is_not_script(text) & ~native).alias("foreign"))
