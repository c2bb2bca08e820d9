"""Queries of the links that pages have, as a walk sees them, and of notes; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, targets
from ..functions import urls as U
from ..operators import walks
from .queries import c, lit, query


def _any(values: tuple[str, ...]) -> str:
    return "|".join(v.replace("'", "''") for v in values)


def _starts(values: tuple[str, ...]) -> str:
    return rf"(^|[/\-_.+ ])({_any(values)})"


#: l: links of pages, some below a folder or under a text by rule; f: what their addresses say. Of pages with one address the first counts.
_LINKS = rf"""h as (select min(page_id) as page_id, url from pages group by url), p as (select page_id, url, html from pages join h using (page_id, url)),
m as (select page_id, url as page, regexp_extract(url, '^(https?://[^/?#]*)', 1) as root, unnest(range(len(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>')))) as pos, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) as said from p),
l as (select page_id, page, pos, root || case pos % 7 when 1 then '/promo' when 2 then '/about' when 3 then '/blog/promo' when 5 then '/minsk/deals' else '' end || href as url, case when pos % 7 = 4 then 'Знижки ' || said else said end as anchor from m),
d as (select *, lower(regexp_extract(url, '^(?:(?:[^/?#:]*:)?//[^/?#]*)?([^?#]*)', 1)) as way from l),
f as (select *, regexp_matches(way, '{_starts(targets.PROMO)}') as promo, not regexp_matches(way, '{_any(targets.EXCLUDED)}') as allowed, regexp_matches(way, '{_starts(targets.PROMO + targets.PAGE_TYPES)}') as named, regexp_matches(lower(anchor), '{_any(targets.ANCHORS)}') as told,
  not list_has_any(string_split(way, '/'), [{", ".join(f"'{x}'" for x in U.RU_CITIES + U.BY_CITIES)}]) as near from d)"""


def _links(t) -> tuple[DataFrame, DataFrame]:
    """(page_id, url) of pages with an address of their own, and their links (page_id, page, pos, url, anchor)."""
    homes = t("pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    pages = t("pages").join(homes, ["page_id", "url"])
    pattern, pos = '<a href="(/[^"]*)">([^<]*)</a>', c("pos")
    both = F.arrays_zip(F.regexp_extract_all("html", lit(pattern), lit(1)).alias("href"), F.regexp_extract_all("html", lit(pattern), lit(2)).alias("said"))
    each = pages.select("page_id", c("url").alias("page"), F.posexplode(both).alias("pos", "x"))
    folder = F.when(pos % 7 == 1, "/promo").when(pos % 7 == 2, "/about").when(pos % 7 == 3, "/blog/promo").when(pos % 7 == 5, "/minsk/deals").otherwise("")
    link = each.select("page_id", "page", pos.cast("long").alias("pos"), U.resolved(c("page"), F.concat(folder, c("x.href"))).alias("url"), F.when(pos % 7 == 4, F.concat(lit("Знижки "), c("x.said"))).otherwise(c("x.said")).alias("anchor"))
    return homes, link


@query(f"with {_LINKS} select page_id, pos, promo, allowed and (named or told) as target, way in ('', '/') or (allowed and named) as seed from f")
def page_targets(t, spark, sf):
    """Which links of pages lead to promotions, to pages worth reading, and to such as a walk can begin with."""
    return _links(t)[1].select("page_id", "pos", targets.is_promo(c("url")).alias("promo"), targets.is_target(c("url"), c("anchor")).alias("target"), targets.is_seed(c("url")).alias("seed"))


@query(f"""with {_LINKS}, k as (select page_id, url, min(pos) as pos, arg_min(allowed and (named or told), pos) as target from f where allowed and near group by 1, 2)
select 'p' || page_id as domain, row_number() over (partition by page_id order by pos) as place, url from k where target""")
def page_walks(t, spark, sf):
    """Targets that every page reaches by its own links."""
    homes, links = _links(t)
    return walks.reached(homes.select(F.concat(lit("p"), c("page_id").cast("string")).alias("domain"), "url"), links.drop("page_id"), "domain", depth=1)


@query(f"""with {_LINKS}, k as (select page_id, url, min(pos) as pos, arg_min(allowed and (named or told), pos) as target, any_value(promo) as promo from f where allowed and near group by 1, 2),
e as (select page_id, case when promo then 1 else 2 end as part, row_number() over (partition by page_id order by pos) as place, url from k where target
  union all select page_id, 0, 0, root from (select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' as root from h)),
n as (select *, rtrim(regexp_replace(regexp_replace(rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/'), '^m\\.', ''), '^([^/]+)/(?:en|ru|uk|ua)(/|$)', '\\1\\2'), '/') as key from e),
o as (select * from (select *, row_number() over (partition by page_id, key order by part, place, url) as rn from n) where rn = 1)
select domain, place, url from (select 'p' || page_id as domain, row_number() over (partition by page_id order by part, place, url) as place, url from o) where place <= 3""")
def page_plans(t, spark, sf):
    """What is read of the site of every page, the root first, promotions next; three pages at most."""
    homes, links = _links(t)
    named = homes.select(F.concat(lit("p"), c("page_id").cast("string")).alias("domain"), "url")
    found = walks.reached(named, links.drop("page_id"), "domain", depth=1)
    roots = named.select("domain", F.concat(U.origin(c("url")), lit("/")).alias("url"))
    return walks.plan(roots, found, "domain", found.limit(0).select("domain", "url", lit(True).alias("allowed")), 3)


@query(r"""with d as (select doc_id, text || case when doc_id % 2 = 0 then ' see https://a.ua/' || doc_id || ' or HTTP://B.ua' else '' end as note from documents),
s as (select doc_id, regexp_split_to_array(note, '(?i)https?://\S+') as t, regexp_extract_all(note, '(?i)https?://\S+') as u from d),
x as (select doc_id, unnest(range(len(t))) as i, unnest(t) as text, null as url from s union all select doc_id, unnest(range(len(u))), null, unnest(u) from s)
select doc_id, row_number() over (partition by doc_id order by i, text is null) as place, text, url from x where text <> '' or url is not null""")
def note_texts(t, spark, sf):
    """Whole texts as runs of words and links."""
    note = F.concat("text", F.when(c("doc_id") % 2 == 0, F.concat(lit(" see https://a.ua/"), c("doc_id").cast("string"), lit(" or HTTP://B.ua"))).otherwise(""))
    return t("documents").select("doc_id", F.posexplode(display.note_segments(note)).alias("place", "x")).select("doc_id", (c("place") + 1).cast("long").alias("place"), "x.text", "x.url")
