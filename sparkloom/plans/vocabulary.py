"""Queries of lists that are kept between passes, of labels and gates; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import cadence, feeds, hosts, provenance, vocabulary
from .queries import _HOST, c, lit, query

# ---- terms ----

#: Approved terms: the types of parts, those of small parts of a category, the others mined, with the size as z; seed are brands.
_ENTRIES = """e as (select p_partkey as place, case when p_partkey % 3 = 0 then upper(p_type) else p_type end as term, case when p_size < 10 then 'category' else 'mined' end as part, cast(p_size as double) as z from part),
l as (select part, term, row_number() over (partition by part order by case when part = 'category' then 0.0 else -z end, case when part = 'category' then '' else term end, place) - 1 as place
  from (select *, row_number() over (partition by part, lower(term) order by case when part = 'category' then 0.0 else -z end, case when part = 'category' then '' else term end, place) as rn from e) where rn = 1)"""


def _entries(t):
    term = F.when(c("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(c("p_type"))
    return t("part").select(c("p_partkey").alias("place"), term.alias("term"), F.when(c("p_size") < 10, "category").alias("source"), c("p_size").cast("double").alias("z"))


@query(f"with {_ENTRIES} select part, place, term from l")
def learned_terms(t, spark, sf):
    return vocabulary.learned(_entries(t))


@query(f"""with {_ENTRIES}, s as (select 0 as n, 'seed' as part, min(p_partkey) as place, ' ' || p_brand as term from part group by p_brand union all select 0, 'seed', 1000000 + min(p_partkey), p_type from part where p_size = 50 group by p_type),
a as (select * from s union all select 1, part, place, term from l where part = 'category' union all select 2, part, place, term from l where part = 'mined' and place < 40)
select part, place, term from (select *, row_number() over (partition by lower(trim(term)) order by n, place) as rn from a) where rn = 1""")
def service_terms(t, spark, sf):
    brands = t("part").groupBy("p_brand").agg(F.min("p_partkey").alias("place")).select("place", F.concat(lit(" "), "p_brand").alias("term"))
    types = t("part").filter("p_size = 50").groupBy("p_type").agg((F.min("p_partkey") + 1000000).alias("place")).select("place", c("p_type").alias("term"))
    return vocabulary.service_terms(brands.unionByName(types), _entries(t), 40)


@query("""with k as (select 'T' || l_partkey as term, max(l_discount) as z from lineitem group by 1), w as (select 'T' || p_partkey as term from part where p_size < 10 union select 'none' || p_partkey from part where p_size = 50),
s as (select 'T' || p_partkey as term, 9.0::double as z from part where p_size in (3, 40))
select 'candidate' as list, term, z from k where term not in (select term from w) union all select 'stopped', term, z from s union all select 'stopped', w.term, coalesce(z, 0) from w left join k using (term) where w.term not in (select term from s)""")
def stopped_terms(t, spark, sf):
    """Terms that are rejected go to the stop list with the z they had."""
    named = lambda name: F.concat(lit(name), c("p_partkey").cast("string")).alias("term")
    scores = t("lineitem").groupBy(F.concat(lit("T"), c("l_partkey").cast("string")).alias("term")).agg(F.max("l_discount").alias("z"))
    wanted = t("part").filter("p_size < 10").select(named("T")).unionByName(t("part").filter("p_size = 50").select(named("none")))
    left, stop = vocabulary.stopped(wanted, scores, t("part").filter("p_size in (3, 40)").select(named("T"), lit(9.0).alias("z")))
    return left.select(lit("candidate").alias("list"), "term", "z").unionByName(stop.select(lit("stopped").alias("list"), "term", "z"))


# ---- hosts ----


@query(f"""with h as (select {_HOST} as host, min(page_id) as first, max(page_id) as last from pages group by 1), s as (select host, row_number() over (order by first) - 1 as place from h where first < 100),
n as (select host, (select count(*) from s) + row_number() over (order by host) - 1 as place from h where last >= 100 and host not in (select host from s))
select place, host from (select * from s union all select * from n) order by place desc limit 40""")
def aggregator_store(t, spark, sf):
    """Hosts of the first pages as the list, those of the later ones are added, the newest 40 stay."""
    pages = t("pages").select("page_id", U.source_host(c("url")).alias("host")).filter("host is not null")
    firsts = pages.filter("page_id < 100").groupBy("host").agg(F.min("page_id").alias("first"))
    from pyspark.sql import Window

    store = firsts.select((F.row_number().over(Window.orderBy("first")) - 1).alias("place"), "host")
    return vocabulary.added(store, pages.filter("page_id >= 100").select("host"), 40)


@query(f"""with h as (select {_HOST} as host, sum(length(html)) as score from pages group by 1), k as (select host from h where score >= 1000 order by score desc, host limit 30)
select 'website' as type, 'https://' || host as ref, 'domain-rating:' || host as note from k where host <> 'example.net' and not ends_with(host, '.example.net')""")
def rated_domains(t, spark, sf):
    """The best rated hosts without those that are blocked meanwhile."""
    rated = t("pages").groupBy(U.source_host(c("url")).alias("host")).agg(F.sum(F.length("html")).alias("score")).filter("host is not null")
    top = feeds.top(rated, c("score") >= 1000, [F.desc("score"), c("host")], 30, rated.limit(0), "host")
    return vocabulary.rated(top, "host", spark.createDataFrame([("example.net",)], "host string"))


@query("""with b as (select c_custkey as key, case when c_custkey % 3 = 0 then 'Q' || c_nationkey end as qid from customer), s as (select 'Q' || n_nationkey as qid, 'site' || n_nationkey || '.ua' as host from nation where n_nationkey % 2 = 0),
o as (select o_custkey as key, o_orderkey as pos, case when o_orderkey % 4 = 0 then 'Q' || o_orderkey % 25 else '' end as qid, case when o_orderkey % 3 > 0 then 'h' || o_orderkey % 5 || '.ua' else '' end as host from orders),
e as (select key, arg_min(qid, pos) as qid from o where qid <> '' group by 1), n as (select key, host, count(*) as n, min(pos) as pos from o where host <> '' group by 1, 2),
m as (select key, arg_min(host, {'n': -n, 'pos': pos}) as host from n group by 1)
select key, coalesce(s.host, t.host, m.host) as host, case when s.host is not null then 'own' when t.host is not null then 'entry' else 'places' end as way
from b left join s on s.qid = b.qid left join e using (key) left join s as t on t.qid = e.qid left join m using (key) where coalesce(s.host, t.host, m.host) is not null""")
def resolved_brands(t, spark, sf):
    """Sites of brands (customers): by their own entry, by the entry that their places (orders) name, by most of their places."""
    brands = t("customer").select(c("c_custkey").alias("key"), F.when(c("c_custkey") % 3 == 0, F.concat(lit("Q"), c("c_nationkey").cast("string"))).alias("qid"))
    sites = t("nation").filter("n_nationkey % 2 = 0").select(F.concat(lit("Q"), c("n_nationkey").cast("string")).alias("qid"), F.concat(lit("site"), c("n_nationkey").cast("string"), lit(".ua")).alias("host"))
    n = c("o_orderkey")
    places = t("orders").select(c("o_custkey").alias("key"), n.alias("pos"), F.when(n % 4 == 0, F.concat(lit("Q"), (n % 25).cast("string"))).otherwise("").alias("qid"), F.when(n % 3 > 0, F.concat(lit("h"), (n % 5).cast("string"), lit(".ua"))).otherwise("").alias("host"))
    return vocabulary.brand_hosts(brands, sites, places)


@query(f"""with h as (select {_HOST} as host, count(*) as n from pages group by 1 having count(*) >= 3), p as (select page_id, {_HOST} as host, html from pages)
select page_id, host, contains(html, 'class="ad"') as passed from p where host in (select host from h)""")
def bootstrap_corpus(t, spark, sf):
    """Pages of hosts with three pages at least, and whether they have what an offer is known by."""
    pages = t("pages").select("page_id", U.source_host(c("url")).alias("host"), "html")
    often = pages.groupBy("host").agg(F.count(lit(1)).alias("n")).filter("n >= 3")
    return vocabulary.corpus(often, pages, "host", c("html").contains('class="ad"')).select("page_id", "host", "passed")


@query(f"""with p as (select page_id, {_HOST} as host, html, url from pages)
select page_id, case when length(html) > 3000 then 'pass' else 'fail' end as label, host, host = 'example.org' or ends_with(host, '.example.org') or host = 'gov.ua' or ends_with(host, '.gov.ua') as neg_anchor, contains(html, '<b>') as pos_anchor, contains(html, '<article>') as is_article from p""")
def labelled_pages(t, spark, sf):
    """Pages with their label and what speaks for and against them."""
    found = hosts.labelled(t("pages"), "url", F.length("html") > 3000, c("html").contains("<b>"), c("html").contains("<article>"), spark.createDataFrame([("example.org",)], "host string"))
    return found.select("page_id", "label", "host", "neg_anchor", "pos_anchor", "is_article")


@query(f"""with p as (select page_id, url, {_HOST} as host, contains(html, '<article>') as art, (len(string_split(html, '<a ')) - 1) as out_ from pages),
r as (select host, count(*) as support, count(*) filter (art) / count(*) as m, count(*) filter (out_ >= 6) / count(*) as a, bool_or(page_id % 40 = 0 and out_ < 6) as own from p group by 1)
select host, support from r where support >= 3 and (m >= 0.5 or a >= 0.5) and not own and host <> 'thther.example.org' and not ends_with(host, '.example.com') order by m + a desc, host limit 50""")
def host_survivors(t, spark, sf):
    """Hosts to review: media or aggregators without own evidence, neither protected nor blocked."""
    n = F.size(F.split("html", "<a ")) - 1
    p = t("pages").select("page_id", U.source_host(c("url")).alias("host"), c("html").contains("<article>").alias("art"), n.alias("out")).groupBy("host").agg(
        F.count(lit(1)).alias("support"), (F.count_if("art") / F.count(lit(1))).alias("media_ratio"), (F.count_if(c("out") >= 6) / F.count(lit(1))).alias("aggregator_ratio"), F.bool_or((c("page_id") % 40 == 0) & (c("out") < 6)).alias("provider_evidence"))
    named = lambda h: spark.createDataFrame([(h,)], "host string")
    return hosts.survivors(p, "host", named("https://thther.example.org/x"), named("example.com")).select("host", "support")


# ---- cursors and attribution ----


@query("select c_nationkey as source, arg_min(c_custkey, {'a': -c_acctbal, 'b': c_custkey}) as cursor from customer group by 1")
def item_cursors(t, spark, sf):
    """The first item of each source, the newest first."""
    return cadence.first_item(t("customer").withColumnRenamed("c_nationkey", "source"), "source", [-c("c_acctbal"), c("c_custkey")], "c_custkey")


@query(f"""with p as (select page_id, {_HOST} as host, nullif(lower(regexp_extract(url, '^\\s*((?i:https?)://[^/?#]+)', 1)), '') as origin, case when page_id % 7 > 0 then 'brand' || page_id % 7 end as brand, regexp_extract(html, '<a href="/([^"/?#: ]+)"', 1) as word from pages),
a as (select *, case when page_id % 11 = 0 then 0 when page_id % 2 = 0 and brand is not null then 3 when word <> '' and page_id % 3 > 0 then 2 when page_id % 8 <= 1 and brand is not null then 3 else 0 end as way from p)
select page_id, case way when 2 then lower(word) || '.ua' when 3 then brand end as provider, case when way > 0 then way = 3 end as first_party, case way when 2 then 'https://' || lower(word) || '.ua' when 3 then coalesce(origin, 'https://' || host) end as ref from a""")
def plain_attributions(t, spark, sf):
    """Providers by the older rules; the outside link is made of a page's first word in its menu."""
    i, word = c("page_id"), F.regexp_extract("html", '<a href="/([^"/?#: ]+)"', 1)
    a = provenance.plain_attribution(
        ref=c("url"), brand=F.when(i % 7 > 0, F.concat(lit("brand"), (i % 7).cast("string"))), host=U.source_host(c("url")), blocks=i % 8, blocked=i % 11 == 0, own_words=i % 2 == 0,
        target=F.when(word != "", F.concat(lit("https://"), word, lit(".ua/x"))), target_blocked=i % 3 == 0,
    )
    return t("pages").select("page_id", a.alias("a")).select("page_id", "a.*")
