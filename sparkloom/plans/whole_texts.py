"""Queries of links, hosts, accounts, addresses and offers over the texts and pages that the tables have, whole; and their SQL.

What the tables lack, a foreign host or a platform, is put into the row's own URL or
text by rule; the operators read all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import offers, registered
from ..functions import urls as U
from ..operators import hosts
from .queries import _ENC, _HOST, _KV, _PATH, ORACLES, c, lit, query


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _on(column: str, sql: str) -> str:
    """SQL on url, on another column."""
    return sql.replace("url, '", f"{column}, '")


# ---- links of pages ----

_HREFS = """l as (select page_id, url, unnest(range(len(m))) as pos, unnest(m) as href from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as m from pages)),
k as (select page_id, url, pos, case pos % 6 when 0 then href when 1 then ltrim(href, '/') when 2 then '?q=' || ltrim(href, '/') when 3 then '#' || ltrim(href, '/') when 4 then 'https://other.ua' || href else 'mailto:' || ltrim(href, '/') end as link,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) as root, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as here from l),
r as (select page_id, url, pos, substr(case pos % 6 when 0 then root || link when 1 then root || regexp_extract(case when here = '' then '/' else here end, '^(.*/)', 1) || link when 2 then root || here || link
  when 3 then regexp_extract(url, '^([^#]*)', 1) || link when 4 then link end, 1, 1024) as found from k)"""


def _links(t) -> DataFrame:
    found = t("pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", lit('href="([^"]*)"'), lit(1))).alias("pos", "href"))
    bare, kind = F.ltrim(c("href"), lit("/")), c("pos") % 6
    link = F.when(kind == 0, c("href")).when(kind == 1, bare).when(kind == 2, F.concat(lit("?q="), bare)).when(kind == 3, F.concat(lit("#"), bare)).when(kind == 4, F.concat(lit("https://other.ua"), c("href"))).otherwise(F.concat(lit("mailto:"), bare))
    return found.select("page_id", "url", c("pos").cast("long").alias("pos"), U.resolved(c("url"), link).alias("found"))


@query(f"with {_HREFS} select page_id, pos, found, coalesce({_on('found', _HOST)} = {_HOST} or ends_with({_on('found', _HOST)}, '.' || {_HOST}), false) as same from r")
def resolved_page_links(t, spark, sf):
    """Where the links of all pages lead: paths, relative ones, queries, fragments, other sites, other schemes."""
    return _links(t).select("page_id", "pos", "found", F.coalesce(U.same_site(c("found"), c("url")), lit(False)).alias("same"))


_PLATFORM = """case page_id % 6 when 0 then regexp_replace(url, '^https?://[^/?#]*', 'https://t.me') when 1 then regexp_replace(url, '^https?://[^/?#]*', 'https://www.instagram.com') when 2 then regexp_replace(url, '^https?://[^/?#]*', 'https://instagram.com/p')
when 3 then regexp_replace(url, '^https?://[^/?#]*', 'https://fb.com/events') when 4 then regexp_replace(url, '^https?', 'ftp') else url end"""


@query(rf"""with p as (select page_id, {_PLATFORM} as url from pages), q as (select page_id, url, list_filter({_KV}, lambda p: not starts_with(lower(p.k), 'utm_')) as q from p),
r as (select page_id, lower(regexp_extract(url, '^\s*((?i:https?)://[^/?#]+)', 1)) || {_PATH} || case when len(q) > 0 then '?' || array_to_string({_ENC}, '&') else '' end as url from q where regexp_matches(url, '^https?://')),
h as (select page_id, url as ref, {_HOST} as host, case when {_PATH} = '' then '/' else {_PATH} end as way from r)
select page_id, case host when 't.me' then 'telegram' when 'instagram.com' then 'instagram' when 'fb.com' then 'facebook' else 'website' end as type, ref from h
where host is not null and not (host = 'instagram.com' and (way = '/' or starts_with(way, '/p/'))) and not (host = 'fb.com' and (way = '/' or starts_with(way, '/events')))""")
def page_candidates(t, spark, sf):
    """Sources that the addresses of pages name, on platforms by rule."""
    moved = lambda to: F.regexp_replace("url", "^https?://[^/?#]*", to)
    n = c("page_id") % 6
    url = F.when(n == 0, moved("https://t.me")).when(n == 1, moved("https://www.instagram.com")).when(n == 2, moved("https://instagram.com/p")).when(n == 3, moved("https://fb.com/events")).when(n == 4, F.regexp_replace("url", "^https?", "ftp")).otherwise(c("url"))
    return t("pages").select("page_id", U.source_candidate(url).alias("x")).filter("x is not null").select("page_id", "x.type", "x.ref")


# ---- hosts of pages ----

_ABROAD = """case page_id % 6 when 0 then regexp_replace(url, '\\.example\\.[a-z]+', '.ru') when 1 then regexp_replace(url, '^(https?://[^/?#]*)', '\\1/minsk') when 2 then regexp_replace(url, '^(https?://)', '\\1spb.')
when 3 then regexp_replace(url, '\\.example\\.[a-z]+', '.com.ua') when 4 then regexp_replace(url, '\\.example\\.[a-z]+', '.xn--p1ai') else url end"""


@query(rf"""with p as (select page_id, {_ABROAD} as url from pages), h as (select page_id, coalesce({_HOST}, '') as h, string_split(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/') as s from p), l as (select *, string_split(h, '.') as l from h)
select page_id, contains(h, '.') and l[-1] <> 'ua' and (l[-1] in ({_listed(U.RU_BY_TLDS)}) or (len(l) >= 3 and l[1] in ({_listed(U.RU_CITIES + U.BY_CITIES)})) or list_has_any(s, [{_listed(U.RU_CITIES + U.BY_CITIES)}])) as geo from l""")
def page_geo(t, spark, sf):
    """Whether the address of a page is of the two countries, by its ending, its first name or a part of its path."""
    n, swap = c("page_id") % 6, lambda to: F.regexp_replace("url", r"\.example\.[a-z]+", to)
    url = F.when(n == 0, swap(".ru")).when(n == 1, F.regexp_replace("url", "^(https?://[^/?#]*)", "$1/minsk")).when(n == 2, F.regexp_replace("url", "^(https?://)", "$1spb.")).when(n == 3, swap(".com.ua")).when(n == 4, swap(".xn--p1ai")).otherwise(c("url"))
    return t("pages").select("page_id", U.is_aggressor_geo(url).alias("geo"))


_SPELT = "case page_id % 5 when 0 then regexp_replace(url, '^https?:', '') when 1 then regexp_replace(url, '^https?://', '') when 2 then replace(url, '://', '://me@') when 3 then regexp_replace(url, '^https?://([^/?#.]*).*$', '\\1') else regexp_replace(url, '^(https?://[^/?#]*)', '\\1:8080') end"


@query(rf"""with p as (select page_id, url, {_SPELT} as v from pages),
h as (select page_id, url, regexp_replace(regexp_replace(regexp_extract(lower(regexp_extract(v, '^(?:(?:[^/?#]*:)?//)?([^/?#]*)', 1)), '([^@]*)$', 1), ':.*$', ''), '^www\.', '') as h from p)
select page_id, case when contains(h, '.') then h else '' end as host, coalesce(case when contains(h, '.') then h end, {_HOST}) as first from h""")
def page_real_hosts(t, spark, sf):
    """Hosts of addresses of any spelling, and the first real one of two."""
    n = c("page_id") % 5
    value = F.when(n == 0, F.regexp_replace("url", "^https?:", "")).when(n == 1, F.regexp_replace("url", "^https?://", "")).when(n == 2, F.replace("url", lit("://"), lit("://me@"))).when(n == 3, F.regexp_replace("url", "^https?://([^/?#.]*).*$", "$1")).otherwise(F.regexp_replace("url", "^(https?://[^/?#]*)", "$1:8080"))
    return t("pages").select("page_id", U.real_host(value).alias("host"), U.primary_host(value, c("url")).alias("first"))


# ---- accounts and addresses in texts ----


def _named(text: Column) -> Column:
    """The text, and two accounts by rule where its id is even."""
    return F.when(c("doc_id") % 2 == 0, F.concat(text, lit("\n@"), c("source"), lit("_"), c("lang"), lit(" (https://T.me/"), c("lang"), c("doc_id").cast("string"), lit("), instagram.com/"), c("source"))).otherwise(text)


@query(r"""with d as (select doc_id, coalesce(case when doc_id % 2 = 0 then text || chr(10) || '@' || source || '_' || lang || ' (https://T.me/' || lang || doc_id || '), instagram.com/' || source else text end, '') as text from documents),
e as (select doc_id, 0 as place, 'telegram' as type, regexp_extract_all(text, '(?i:(?:https?://)?t\.me/([A-Za-z0-9_]{4,}))', 1) as m from d
  union all select doc_id, 1, 'telegram', regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_/])@([A-Za-z0-9_]{4,})', 1) from d
  union all select doc_id, 2, 'instagram', regexp_extract_all(text, '(?i:(?:https?://)?(?:www\.)?instagram\.com/([A-Za-z0-9_.]{2,}))', 1) from d
  union all select doc_id, 3, 'facebook', regexp_extract_all(text, '(?i:(?:https?://)?(?:www\.)?facebook\.com/([A-Za-z0-9_.]{2,}))', 1) from d),
x as (select doc_id, place, unnest(range(len(m))) as i, type, unnest(m) as handle from e),
f as (select *, row_number() over (partition by doc_id, type, lower(handle) order by place, i) as rn from x)
select doc_id, type, handle from f where rn = 1""")
def text_handles(t, spark, sf):
    """Accounts that whole texts name. Spark asks an array twice more if it is not exploded as outer."""
    return t("documents").select("doc_id", F.explode_outer(U.handles(_named(c("text")))).alias("x")).filter("x is not null").select("doc_id", "x.type", "x.handle")


_BLOCKED = ("mail5.example.com", "example.net")


@query(rf"""with d as (select doc_id, case when doc_id % 5 = 0 then text || ' a@gmail.com, b@shop.de, c@deep.example.net d@own.ua' else coalesce(text, '') end as text from documents),
m as (select distinct doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_.+-]+@([\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+)', 1))), '^www\.', '') as host from d), l as (select *, string_split(host, '.') as l from m)
select doc_id, host from l where host <> '' and host <> 'own.ua' and host not in ({_listed(U.FREEMAIL)})
and not (contains(host, '.') and l[-1] <> 'ua' and ((len(l) >= 3 and l[1] in ({_listed(U.RU_CITIES)})) or case when l[-1] like 'xn--%' then l[-1] <> '{U.UA_IDN_TLD}' else length(l[-1]) = 2 and l[-1] not in ({_listed(U.GENERIC_CCTLDS)}) end))
and not exists (select 1 from (values {', '.join(f"('{b}')" for b in _BLOCKED)}) as b(b) where host = b or ends_with(host, '.' || b))""")
def text_mail_hosts(t, spark, sf):
    """Hosts of the addresses in whole texts that may be sources: not one's own, free mail, foreign or blocked."""
    text = F.when(c("doc_id") % 5 == 0, F.concat("text", lit(" a@gmail.com, b@shop.de, c@deep.example.net d@own.ua"))).otherwise(c("text"))
    found = t("documents").select("doc_id", F.explode(U.mail_hosts(text, lit(None).cast("array<string>"), lit("https://own.ua/x"))).alias("host"))
    return hosts.not_blocked(found, "host", spark.createDataFrame([(b,) for b in _BLOCKED], "host string"))


# ---- offers in texts ----

_PROMISE = """case doc_id % 4 when 0 then 'Знижка ' || (doc_id % 60 + 1) || '% для ветеранів до 31.12.2030. ' when 1 then 'Знижка ' || (doc_id % 900 + 100) || ' грн на ноутбуки військовим. ' when 2 then 'Безкоштовний вхід до музею ветеранам. ' else '' end"""


@query(rf"""with d as (select doc_id, doc_id % 4 as k, rtrim({_PROMISE}) as title, {_PROMISE} || coalesce(regexp_replace(text, '[0-9%]', ' ', 'g'), '') as text from documents)
select doc_id, case k when 0 then 'percent' when 1 then 'fixed' else 'free' end as kind, case k when 0 then cast(doc_id % 60 + 1 as varchar) when 1 then cast(doc_id % 900 + 100 as varchar) end as value, case when k = 0 then date '2030-12-31' end as valid_until,
  case when k = 1 then 'warrior' else 'veteran' end as audiences, title, sha256(trim(regexp_replace(lower(title), '\s+', ' ', 'g')) || ' | заклад | ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as hash from d where k < 3""")
def text_offers(t, spark, sf):
    """Offers in whole texts: a promise by rule, and then the text itself, without figures."""
    none = lit(None).cast("string")
    made = offers.candidate(c("body"), c("url"), lit("Заклад"), none, none, none, F.array().cast("array<string>"), 2030)
    # exploded, so that it is made once, not for each of its columns
    found = _promised(t).select("doc_id", F.explode(F.array(made)).alias("offer")).filter("offer is not null")
    return found.select("doc_id", "offer.kind", "offer.value", "offer.valid_until", F.array_join("offer.audiences", ",").alias("audiences"), "offer.title", c("offer.content_hash").alias("hash"))


def _promised(t) -> DataFrame:
    n = c("doc_id")
    promise = F.when(n % 4 == 0, F.concat(lit("Знижка "), (n % 60 + 1).cast("string"), lit("% для ветеранів до 31.12.2030. "))).when(n % 4 == 1, F.concat(lit("Знижка "), (n % 900 + 100).cast("string"), lit(" грн на ноутбуки військовим. "))).when(n % 4 == 2, "Безкоштовний вхід до музею ветеранам. ").otherwise("")
    return t("documents").select("doc_id", F.concat(promise, F.coalesce(F.regexp_replace("text", "[0-9%]", " "), lit(""))).alias("body"), F.concat(lit("https://a.ua/"), n.cast("string")).alias("url"))


@query(ORACLES["text_offers"])
def sql_offers(t, spark, sf):
    """text_offers as a user of SQL writes it, with the library's functions of SQL. A view of each row's own array needs no join of the texts, as a lateral table function does."""
    registered.register(spark, ["offer_in"])
    found = "select doc_id, o.kind, o.value, o.valid_until, array_join(o.audiences, ',') as audiences, o.title, o.content_hash as hash from (select doc_id, array(offer_in(body, url, 'Заклад', 2030)) as every from {promised}) lateral view outer explode(every) as o where o is not null"
    return spark.sql(found, promised=_promised(t))


@query(ORACLES["text_handles"])
def sql_handles(t, spark, sf):
    """text_handles in SQL."""
    registered.register(spark, ["social_handles"])
    named = t("documents").select("doc_id", _named(c("text")).alias("body"))
    return spark.sql("select doc_id, h.type, h.handle from (select doc_id, social_handles(body) as every from {named}) lateral view outer explode(every) as h where h is not null", named=named)
