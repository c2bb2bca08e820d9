"""One query for each operator over the driver's tables, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions import urls as U
from ..operators import facets, feeds, folds, hosts, mining, places, replay, resolution, upserts
from ..sources import html
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (read, spark) -> DataFrame, read giving a table by name, under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


c, lit = F.col, F.lit

# ---- search ----


@query("""select o_orderkey, o_orderdate, o_orderstatus, o_orderpriority from orders
where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
  and o_custkey in (select c_custkey from customer where c_mktsegment ilike '%build%' or c_name ilike '%build%')
order by o_orderdate desc, o_orderkey desc limit 20 offset 0""")
def facet_search(t, spark, sf):
    people = facets.facet_filter(t("customer"), "c_custkey", text="build", text_columns=("c_mktsegment", "c_name")).select("c_custkey")
    found = facets.facet_filter(t("orders"), "o_orderkey", {"o_orderstatus": "F"}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, [(t("lineitem"), "l_orderkey", "l_returnflag", ["R"])])
    found = found.join(people, found["o_custkey"] == people["c_custkey"], "left_semi")
    return facets.page(found, [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 20).select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")


@query("select count(*) as total from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_returnflag in ('R', 'A'))")
def facet_total(t, spark, sf):
    return facets.facet_filter(t("orders"), "o_orderkey", {"o_orderstatus": "F"}, None, [(t("lineitem"), "l_orderkey", "l_returnflag", ["R", "A"])]).agg(F.count(lit(1)).alias("total"))


@query("select distinct p_type as facet from part join lineitem on p_partkey = l_partkey where l_returnflag = 'R' order by 1")
def facet_list(t, spark, sf):
    sold = t("lineitem").filter("l_returnflag = 'R'").select(c("l_partkey").alias("p_partkey"))
    return t("part").join(sold, "p_partkey", "left_semi").select(c("p_type").alias("facet")).distinct().orderBy("facet")


@query("select count(*) as pending from orders where o_orderstatus = 'P'")
def pending_badge(t, spark, sf):
    return t("orders").filter("o_orderstatus = 'P'").agg(F.count(lit(1)).alias("pending"))


@query("""with p as (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 20)
select o_orderkey, o_orderdate, count(l_orderkey) as n_children, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as children
from p left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def children_page(t, spark, sf):
    page = facets.page(t("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 20)
    rows = facets.with_children(page, "o_orderkey", t("lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag"], "x")
    text = F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",")
    return rows.select("o_orderkey", "o_orderdate", F.coalesce(F.size("x"), lit(0)).cast("long").alias("n_children"), F.coalesce(text, lit("")).alias("children"))


@query("select o_orderkey, o_orderstatus from orders where o_orderdate is null or o_orderdate >= timestamp '1998-06-01'")
def soft_expiry(t, spark, sf):
    return facets.facet_filter(t("orders"), "o_orderkey", valid_until="o_orderdate", as_of=lit("1998-06-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus")


@query("""select a.o_orderkey, a.o_custkey, b.o_orderkey as parent, b.o_orderstatus as parent_status from orders a left join orders b on b.o_orderkey = a.o_orderkey - 1 and b.o_custkey % 7 = a.o_custkey % 7""")
def parent_edges(t, spark, sf):
    a, b = t("orders").select("o_orderkey", "o_custkey"), t("orders").select(c("o_orderkey").alias("parent"), c("o_custkey").alias("k"), c("o_orderstatus").alias("parent_status"))
    return a.join(b, (b["parent"] == a["o_orderkey"] - 1) & (b["k"] % 7 == a["o_custkey"] % 7), "left").drop("k")


# ---- URLs ----

_HOST = r"nullif(regexp_replace(regexp_replace(lower(regexp_extract(regexp_extract(url, '^\s*(?i:https?)://([^/?#]*)', 1), '([^@]*)$', 1)), ':[^:]*$', ''), '^www\.', ''), '')"
_PATH = r"rtrim(regexp_extract(url, '^\s*(?i:https?)://[^/?#]*([^?#]*)', 1), '/')"
_QS = r"list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.+'))"
_KV = f"list_transform({_QS}, lambda p: {{'k': url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}})"
_ENC = "list_transform(q, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+'))"
_DROP = ", ".join(f"'{x}'" for x in U.TRACKING + U.PAGINATION)


@query(rf"""select page_id, {_HOST} as host, nullif(lower(regexp_extract(url, '^\s*((?i:https?)://[^/?#]+)', 1)), '') as origin, coalesce({_HOST}, '') as bare from pages""")
def url_hosts(t, spark, sf):
    return t("pages").select("page_id", U.source_host(c("url")).alias("host"), U.origin(c("url")).alias("origin"), U.bare_host(c("url")).alias("bare"))


@query(f"""with p as (select page_id, url, list_sort(list_filter({_KV}, lambda p: not starts_with(lower(p.k), 'utm_') and lower(p.k) not in ({_DROP}))) as q from pages)
select page_id, {_HOST} || {_PATH} || case when len(q) > 0 then '?' || array_to_string({_ENC}, '&') else '' end as canonical from p""")
def canonical_target(t, spark, sf):
    return t("pages").select("page_id", U.canonical_target(c("url")).alias("canonical"))


@query(rf"""with p as (select page_id, url, list_filter({_KV}, lambda p: not starts_with(lower(p.k), 'utm_')) as q from pages)
select page_id, lower(regexp_extract(url, '^\s*((?i:https?)://[^/?#]+)', 1)) || {_PATH} || case when len(q) > 0 then '?' || array_to_string({_ENC}, '&') else '' end as ref from p""")
def source_ref(t, spark, sf):
    return t("pages").select("page_id", U.source_ref(c("url")).alias("ref"))


_REF = r"rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '^(t\.me/|instagram\.com/|facebook\.com/)', ''), '@'), '/')"


@query(rf"""select page_id, {_REF} as ref, rtrim(regexp_replace(regexp_replace({_REF}, '^m\.', ''), '^([^/]+)/(?:en|ru|uk|ua)(/|$)', '\1\2'), '/') as website from pages""")
def normalized_refs(t, spark, sf):
    return t("pages").select("page_id", U.normalized_ref(c("url")).alias("ref"), U.website_key(c("url")).alias("website"))


_LAB = f"string_split(coalesce({_HOST}, ''), '.')"


@query(rf"""with p as (select page_id, url, coalesce({_HOST}, '') as h, {_LAB} as l from pages)
select page_id, contains(h, '.') and l[-1] <> 'ua' and ((len(l) >= 3 and l[1] in ({', '.join(f"'{x}'" for x in U.RU_CITIES)}))
    or case when starts_with(l[-1], 'xn--') then l[-1] <> 'xn--j1amh' else length(l[-1]) = 2 and l[-1] not in ('co', 'io', 'me', 'tv', 'ai', 'cc') end) as foreign_host,
  h <> '' and (l[-1] = 'media' or regexp_matches(h, 'ther|blog')) as news_host,
  contains(h, '.') and (l[-1] in ('gov', 'edu', 'mil', 'int') or coalesce(l[-2], '') in ('gov', 'edu', 'mil')) as low_value from p""")
def host_flags(t, spark, sf):
    return t("pages").select("page_id", U.is_foreign(c("url")).alias("foreign_host"), U.is_news(c("url"), ("ther", "blog")).alias("news_host"), U.is_low_value(c("url")).alias("low_value"))


@query(rf"""with p as (select page_id, {_HOST} as host from pages), b as (select unnest(['example.org', 'ththre.example.com', 'thin.example.net']) as b)
select page_id, host from p where host is not null and not exists (select 1 from b where host = b or ends_with(host, '.' || b))""")
def blocked_hosts(t, spark, sf):
    rows = t("pages").select("page_id", U.source_host(c("url")).alias("host")).filter("host is not null")
    return hosts.not_blocked(rows, "host", spark.createDataFrame([("example.org",), ("ththre.example.com",), ("thin.example.net",)], "host string"))


@query(r"""select page_id, regexp_matches(lower(regexp_extract(url, '^\s*(?i:https?)://[^/?#]*([^?#]*)', 1)), '(^|[/\-_.+ ])(en|fr)') and not regexp_matches(lower(regexp_extract(url, '^\s*(?i:https?)://[^/?#]*([^?#]*)', 1)), '99|77') as promo from pages""")
def promo_urls(t, spark, sf):
    return t("pages").select("page_id", U.word_start_hit(c("url"), ("en", "fr"), ("99", "77")).alias("promo"))


@query(f"""with p as (select page_id, {_HOST} as host from pages) select host, min(page_id) as keeper, count(*) as pages from p where host is not null group by host""")
def source_dedupe(t, spark, sf):
    rows = t("pages").select("page_id", U.source_host(c("url")).alias("host")).filter("host is not null")
    return rows.groupBy("host").agg(F.min("page_id").alias("keeper"), F.count(lit(1)).alias("pages"))


# ---- text ----

_NORM = r"trim(regexp_replace(lower(coalesce({}, '')), '\s+', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '' and w not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")))"


@query(f"select doc_id, sha256({_NORM.format('lang')} || ' | ' || {_NORM.format('source')} || ' | ' || {_NORM.format('text')}) as hash, sha1(text) as key from documents")
def content_hashes(t, spark, sf):
    return t("documents").select("doc_id", T.content_hash(c("lang"), c("source"), c("text")).alias("hash"), T.item_key(c("text")).alias("key"))


@query(f"""with p as (select conv_id, turn, {_TOK.format('text')} as a, lag({_TOK.format('text')}) over (partition by conv_id order by turn) as b from conversations)
select conv_id, turn, len(a)::bigint as n, case when b is null or len(a) = 0 or len(b) = 0 then 0.0::double else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end as similarity from p""")
def token_similarity(t, spark, sf):
    from pyspark.sql import Window

    rows = t("conversations").withColumn("a", T.tokens(c("text")))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.size("a").cast("long").alias("n"), F.coalesce(T.jaccard(c("a"), c("b")), lit(0.0)).alias("similarity"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: length(w) >= 3)"


@query(f"""with w as (select item_id, {_WORDS} as w from benchmark), b as (select item_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from w)
select bigram, count(*) as n, count(distinct item_id) as items from b group by 1""")
def bigram_counts(t, spark, sf):
    rows = t("benchmark").select("item_id", F.explode(T.bigrams(T.words(c("text")))).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count(lit(1)).alias("n"), F.count_distinct("item_id").alias("items"))


@query(r"""with l as (select doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n, length(regexp_replace(text, '[^a-z]', '', 'g')) as own from documents)
select doc_id, case when n > 0 then own / n else 0.0::double end as ratio from l""")
def letter_ratio(t, spark, sf):
    return t("documents").select("doc_id", T.script_ratio(c("text"), "a-z").alias("ratio"))


@query(r"""with l as (select doc_id, regexp_extract(trim(regexp_extract(text, '^\s*([^\n]*)', 1)), '^([^.!?]*[.!?]?)', 1) as s from documents)
select doc_id, case when length(s) <= 80 then s else regexp_replace(substr(s, 1, 80), '\s+\S*$', '') end as title from l""")
def titles(t, spark, sf):
    return t("documents").select("doc_id", T.title_from(c("text")).alias("title"))


@query(r"""with e as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1), lambda x: lower(x))) as d from documents)
select d.u as domain, count(*) as documents from (select unnest(d) as u from e) as d where d.u <> 'mail1.example.com' group by 1""")
def email_domains(t, spark, sf):
    rows = t("documents").select(F.explode(T.email_domains(c("text"), excluded=("mail1.example.com",))).alias("domain"))
    return rows.groupBy("domain").agg(F.count(lit(1)).alias("documents"))


@query(r"""select doc_id, array_to_string(list_filter([case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(the|and)') then 'english' end, case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(der|und)') then 'german' end,
  case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(clown)') then 'insult' end], lambda x: x is not null), ',') as labels from documents""")
def stem_labels(t, spark, sf):
    return t("documents").select("doc_id", F.array_join(T.classify(c("text"), {"english": ("the", "and"), "german": ("der", "und"), "insult": ("clown",)}), ",").alias("labels"))


# ---- hosts ----


@query("""select source as host, count(*) filter (quality = 1) as published, count(*) filter (quality = 0) as rejected from documents join labels using (doc_id) group by 1""")
def host_reputation(t, spark, sf):
    return hosts.reputation(t("documents").join(t("labels"), "doc_id").withColumn("host", c("source")), "host", c("quality") == 1, c("quality") == 0)


@query(f"""with r as (select {_HOST} as host, count(*) filter (page_id % 3 = 0) as published, count(*) filter (page_id % 3 = 1) as rejected from pages group by 1),
s as (select r.host, sum(b.published)::bigint as published, sum(b.rejected)::bigint as rejected from r join r b on b.host = r.host or ends_with(b.host, '.' || r.host) group by 1)
select page_id, s.published, s.rejected, case when s.published >= 1 and s.rejected = 0 and page_id % 2 = 0 then 'high' when (s.rejected >= 1 and s.published = 0) or page_id % 2 <> 0 then 'low' else 'medium' end as tier,
  array_to_string(list_filter([case when s.published >= 1 and s.rejected = 0 then 'proven_host' when s.rejected >= 1 and s.published = 0 then 'noisy_host' when s.published = 0 and s.rejected = 0 then 'new_host' end,
  case when page_id % 2 <> 0 then 'no_discount' end], lambda x: x is not null), ',') as signals
from (select page_id, {_HOST} as host from pages) p join s using (host)""")
def confidence_tiers(t, spark, sf):
    p = t("pages").select("page_id", U.source_host(c("url")).alias("host"))
    per = hosts.reputation(p, "host", c("page_id") % 3 == 0, c("page_id") % 3 == 1)
    counts = hosts.subdomain_counts(p, per)
    has = c("page_id") % 2 == 0
    rows = p.join(counts, "host")
    return rows.select("page_id", "published", "rejected", hosts.tier(c("published"), c("rejected"), has).alias("tier"), F.array_join(hosts.signals(c("published"), c("rejected"), no_discount=has), ",").alias("signals"))


@query("""with p as (select source || '/' || lang as host, count(*) filter (toxic = 1) as published, count(*) filter (quality = 0) as rejected from documents join labels using (doc_id) group by 1)
select host from p where rejected >= 2 and published = 0 and host <> 'src1/en'""")
def auto_blocked(t, spark, sf):
    labelled = t("documents").join(t("labels"), "doc_id").withColumn("host", F.concat_ws("/", "source", "lang"))
    per = hosts.reputation(labelled, "host", c("toxic") == 1, c("quality") == 0)
    return hosts.auto_block(per, spark.createDataFrame([("src1/en",)], "host string"))


@query(f"""with p as (select page_id, url, {_HOST} as host, regexp_matches(html, '<article>') as art, (len(string_split(html, '<a ')) - 1) as out_, page_id % 4 = 0 as anc from pages),
n as (select *, row_number() over (partition by host order by page_id) - 1 as pos from p)
select host, count(*) as support, count(*) filter (art) / count(*) as media_ratio, count(*) filter (out_ >= 8) / count(*) as aggregator_ratio, bool_or(anc and out_ = 0) as provider_evidence,
  string_agg(url, ' ' order by pos) filter (pos < 3) as samples from n group by host""")
def host_ratios(t, spark, sf):
    from pyspark.sql import Window

    p = t("pages").select("page_id", "url", U.source_host(c("url")).alias("host"), c("html").rlike("<article>").alias("art"), (F.size(F.split("html", "<a ")) - 1).alias("out"))
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1)
    r = hosts.ratios(p, "host", c("art"), c("out"), c("page_id") % 4 == 0, "pos", "url", least_outbound=8)
    return r.withColumn("samples", F.array_join("sample_urls", " ")).drop("sample_urls")


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_custkey % 2 = 0 and o_orderdate < timestamp '1998-01-01' - interval 30 day then 'expired' when o_orderstatus = 'F' then 'published' else o_orderstatus end as status from orders""")
def expire_stale(t, spark, sf):
    o = t("orders").withColumn("status", F.when(c("o_orderstatus") == "F", "published").otherwise(c("o_orderstatus")))
    return hosts.expire_stale(o, "status", "o_orderdate", lit("1998-01-01").cast("timestamp_ntz"), 30, c("o_custkey") % 2 == 0).select("o_orderkey", "status")


# ---- mining ----

_MINED = f"""w as (select doc_id, source, quality, toxic, unnest(list_distinct({_WORDS})) as term from documents join labels using (doc_id)),
k as (select term, coalesce(sum(case when quality = 1 then case when doc_id % 10 = 0 then 3.0 else 1.0 end end), 0)::double as y_pass, coalesce(sum(case when quality = 0 then case when doc_id % 10 = 0 then 3.0 else 1.0 end end), 0)::double as y_fail,
  count(*) filter (quality = 1) as docs, count(distinct case when quality = 1 and source <> '' then source end) as domains, bool_or(toxic = 1) as negative from w group by term),
tot as (select sum(y_pass) + 0.5 * count(*) as np, sum(y_fail) + 0.5 * count(*) as nf from k),
z as (select k.*, (ln((y_pass + 0.5) / (np - (y_pass + 0.5))) - ln((y_fail + 0.5) / (nf - (y_fail + 0.5)))) / sqrt(1 / (y_pass + 0.5) + 1 / (y_fail + 0.5)) as z from k, tot)"""


def _mined(t):
    rows = t("documents").join(t("labels"), "doc_id")
    counts = mining.term_counts(rows, T.words(c("text")), c("quality") == 1, F.when(c("doc_id") % 10 == 0, 3).otherwise(1), c("source"), c("toxic") == 1)
    return mining.log_odds(counts)


@query(f"with {_MINED} select term, y_pass, y_fail, docs, domains, negative, round(z::double, 6) as z from z")
def term_log_odds(t, spark, sf):
    return _mined(t).withColumn("z", F.round("z", 6))


@query(f"with {_MINED} select term, docs, domains from z where not negative and domains >= 3 and z >= 0.2 and docs >= 2 order by round(z::double, 9) desc, term limit 50")
def term_survivors(t, spark, sf):
    return mining.survivors(_mined(t).withColumn("z", F.round("z", 9)), least_z=0.2, least_docs=2).select("term", "docs", "domains")


@query(f"""with {_MINED}, ax as (select distinct unnest({_WORDS}) as word from benchmark)
select term, docs from z where term not in (select word from ax) and docs >= 2 and not (term like 'th%' and z <= 0.5 * 1.5)""")
def term_vetoes(t, spark, sf):
    scores = _mined(t).filter("docs >= 2")
    axis = t("benchmark").select(F.explode(T.words(c("text"))).alias("word")).distinct()
    stopped = scores.filter("term like 'th%'").select("term", lit(0.5).alias("z_reject"))
    return mining.soft_stop(mining.axis_veto(scores, axis), stopped).select("term", "docs")


# ---- duplicates and roll-ups ----


@query("""with d as (select l_orderkey, case l_returnflag when 'A' then 'free' when 'R' then 'percent' else 'fixed' end as kind, l_discount, l_linenumber, l_partkey from lineitem)
select l_orderkey, arg_max(kind, s) as kind, arg_max(l_discount, s) as l_discount from (select *, {'r': case kind when 'free' then 3 when 'percent' then 2 else 1 end, 'v': l_discount, 'p': -l_linenumber, 'q': -l_partkey} as s from d) group by 1""")
def best_discount(t, spark, sf):
    kind = F.when(c("l_returnflag") == "A", "free").when(c("l_returnflag") == "R", "percent").otherwise("fixed")
    return resolution.best_discount(["l_orderkey"], t("lineitem").withColumn("kind", kind), "kind", "l_discount", "l_linenumber")


@query("""with f as (select l_orderkey, l_returnflag, min(l_linenumber * 1000000 + l_partkey) as p from lineitem group by 1, 2)
select l_orderkey, count(*) as kinds, string_agg(l_returnflag, ',' order by p, l_returnflag) as flags from f group by 1""")
def page_rollup(t, spark, sf):
    rows = t("lineitem").groupBy("l_orderkey").agg(resolution.first_distinct(c("l_linenumber") * 1000000 + c("l_partkey"), c("l_returnflag")).alias("f"))
    return rows.select("l_orderkey", F.size("f").cast("long").alias("kinds"), F.array_join("f", ",").alias("flags"))


_ITEMS = f"""i as (select doc_id, source, {_TOK.format('text')} as t, list_distinct([doc_id % 3, n_chars % 2]) as m from documents)"""


def _items(t):
    return t("documents").select("doc_id", "source", T.tokens(c("text")).alias("t"), F.array_distinct(F.array(c("doc_id") % 3, c("n_chars") % 2)).alias("m"))


@query(f"""with {_ITEMS} select b.doc_id as dup_id, min(a.doc_id) as keep_id from i a join i b on a.source = b.source and a.doc_id < b.doc_id
where list_has_all(a.m, b.m) and len(a.t) > 0 and len(b.t) > 0 and len(list_intersect(a.t, b.t)) >= 0.6 * len(list_distinct(list_concat(a.t, b.t))) group by 1""")
def promo_duplicates(t, spark, sf):
    return resolution.promo_duplicates(_items(t), "source", "doc_id", "t", "m")


_FORMS = [("and", "And", False), ("AND", "Other", False), ("der", "Der", False), ("pour", "Pour", False), ("par", "Par", False), ("en", "En", True), ("of", "Of", True)]
_FORM_ROWS = ", ".join(f"({i}, '{form}', '{name}', {str(marked).lower()})" for i, (form, name, marked) in enumerate(_FORMS))
_CHARS = places.TOKEN_CHARS.replace("'", "''")


@query(f"""with d as (select lower(form) as form, arg_min(name, position) as name, arg_min(marked, position) as marked from (values {_FORM_ROWS}) v(position, form, name, marked) group by 1),
w as (select doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^{_CHARS}]+'), lambda x: x <> ''), lambda x: trim(x, '''’')) as t from documents),
x as (select doc_id, t, unnest(range(1, len(t) + 1)) as p from w),
h as (select doc_id, name, min(p) as p from x join d on d.form = t[p] where not marked or (p > 1 and t[p - 1] in ('the', 'la')) group by 1, 2)
select doc_id, coalesce(names, '') as names from documents left join (select doc_id, string_agg(name, ',' order by p) as names from h group by 1) using (doc_id)""")
def place_names(t, spark, sf):
    forms = spark.createDataFrame([(i, *x) for i, x in enumerate(_FORMS)], "position long, form string, name string, marked boolean")
    found = places.find_names(t("documents").select("doc_id", "text"), "doc_id", "text", forms, ("the", "la"))
    return found.select("doc_id", F.array_join("names", ",").alias("names"))


@query()
def submission_replay(t, spark, sf):
    d, n = t("documents"), c("doc_id")
    site = F.concat(lit("h"), (n % 97).cast("string"), lit(".example"))
    page = F.when(n % 5 == 0, site).otherwise(F.concat(site, lit("/"), (n % 13).cast("string")))
    subs = d.select(n.alias("seq"), F.when(n % 4 != 0, n % 7).alias("source"), F.sha2(F.coalesce("text", lit("")), 256).alias("hash"), page.alias("article"), F.concat(lit("t"), (n % 211).cast("string")).alias("target"),
                    site.alias("host"), F.array(F.concat(lit("percent:"), (n % 3 * 10).cast("string"))).alias("mags"), T.tokens(c("text")).alias("tokens"), (n % 17 == 0).alias("blocked"), F.when(n % 19 == 0, "published").alias("status"))
    return replay.resolve(subs)


@query(f"""with recursive {_ITEMS},
p as (select b.doc_id, list(a.doc_id) as near from i a join i b on a.source = b.source and a.doc_id < b.doc_id and list_has_all(a.m, b.m) and len(a.t) > 0 and len(b.t) > 0
  and len(list_intersect(a.t, b.t)) >= 0.6 * len(list_distinct(list_concat(a.t, b.t))) group by 1),
o as (select source, doc_id, coalesce(near, []) as near, doc_id % 4 = 0 as decided, row_number() over (partition by source order by doc_id) as rn from i left join p using (doc_id)),
f as (select source, 0::bigint as rn, []::bigint[] as leaders, null::bigint as dup, null::bigint as keep from (select distinct source from o)
  union all select source, rn, case when match is not null and not decided then leaders else list_append(leaders, doc_id) end, case when match is not null and not decided then doc_id end, match
  from (select o.source, o.rn, f.leaders, o.doc_id, o.decided, list_filter(f.leaders, lambda l: list_contains(o.near, l))[1] as match from f join o on o.source = f.source and o.rn = f.rn + 1))
select dup as dup_id, keep as keep_id from f where dup is not null""")
def leader_clusters(t, spark, sf):
    return resolution.leader_clusters(_items(t).withColumn("decided", c("doc_id") % 4 == 0), "source", "doc_id", "t", "m", "decided")


@query(f"""with p as (select page_id, {_HOST} as host, length(html) as total, page_id % 5 as published from pages)
select host, arg_max(page_id, {{'a': published, 'b': total, 'c': -page_id}}) as keeper, count(*) as size from p group by host""")
def source_keepers(t, spark, sf):
    p = t("pages").select("page_id", U.source_host(c("url")).alias("host"), F.length("html").alias("total"), (c("page_id") % 5).alias("published"))
    return resolution.keepers(p, "host", "page_id", "published", "total")


@query("""select o_orderkey, case when o_orderstatus = 'P' and o_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 'R' else o_orderstatus end as o_orderstatus from orders""")
def reject_repeated(t, spark, sf):
    return resolution.reject_repeated(t("orders"), "o_custkey", "o_orderstatus", "P", "F", "R").select("o_orderkey", "o_orderstatus")


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1")
def first_occurrence(t, spark, sf):
    return resolution.first_by(t("events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_type", "event_id", "ts")


# ---- ordered lists ----


@query("""with a as (select r_regionkey as p0, r_name as w0 from region), b as (select n_nationkey as p1, n_name as w1 from nation), x as (select distinct p_type as w2 from part), d as (select w2, row_number() over (order by w2) as p2 from x),
g as (select p0, p1, p2, w0 || ' ' || w1 || ' ' || w2 as phrase from a, b, d), f as (select *, row_number() over (partition by lower(phrase) order by p0, p1, p2) as rn from g)
select row_number() over (order by p0, p1, p2) - 1 as pos, phrase from f where rn = 1""")
def query_grid(t, spark, sf):
    from pyspark.sql import Window

    types = t("part").select(c("p_type").alias("word")).distinct().select(F.row_number().over(Window.orderBy("word")).alias("pos"), "word")
    g = feeds.grid(t("region").select(c("r_regionkey").alias("pos"), c("r_name").alias("word")), t("nation").select(c("n_nationkey").alias("pos"), c("n_name").alias("word")), types)
    return g.select(c("pos").cast("long").alias("pos"), "phrase")


@query("with n as (select count(*) as n from customer) select c_custkey, (c_custkey - (n - 100) + n) % n as turn from customer, n where (c_custkey - (n - 100) + n) % n < 200")
def rotating_window(t, spark, sf):
    size = t("customer").count()
    return feeds.rotation(t("customer"), "c_custkey", size, size - 100, 200).select("c_custkey", "turn")


@query("select n_nationkey as feed, s_suppkey as item, row_number() over (partition by n_nationkey order by s_acctbal desc, s_suppkey) as round from supplier join nation on s_nationkey = n_nationkey")
def interleaved_feeds(t, spark, sf):
    rows = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return feeds.interleave(rows, "n_nationkey", [F.desc("s_acctbal"), c("s_suppkey")]).select(c("n_nationkey").alias("feed"), c("s_suppkey").alias("item"), c("round").cast("long").alias("round"))


@query("select c_custkey, c_acctbal from customer where c_acctbal >= 1000 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') order by c_acctbal desc, c_custkey limit 50")
def top_domains(t, spark, sf):
    known = t("orders").filter("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return feeds.top(t("customer"), c("c_acctbal") >= 1000, [F.desc("c_acctbal"), c("c_custkey")], 50, known, "c_custkey").select("c_custkey", "c_acctbal")


@query("""select user_id, event_id from (select *, coalesce(sum((event_type = 'view')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as used from events) where used < 3""")
def budget_prefix(t, spark, sf):
    return feeds.budget_prefix(t("events"), ["user_id"], [c("ts"), c("event_id")], c("event_type") == "view", 3).select("user_id", "event_id")


@query("""with k as (select l_partkey, l_suppkey, count(*) as n, min(l_orderkey * 10 + l_linenumber) as f from lineitem group by 1, 2 having count(*) >= 2)
select l_partkey, arg_max(l_suppkey, {'n': n, 'f': -f}) as l_suppkey, max(n) as n from k group by 1""")
def mode_by_brand(t, spark, sf):
    return feeds.mode_by(t("lineitem").withColumn("p", c("l_orderkey") * 10 + c("l_linenumber")), "l_partkey", "l_suppkey", "p", 2)


@query("""select doc_id, source from (select *, sum(strlen(text)) over (partition by source order by doc_id desc rows unbounded preceding) as s, row_number() over (partition by source order by doc_id desc) as rn from documents) where s <= 20000 or rn = 1""")
def retained_bytes(t, spark, sf):
    return feeds.retain_bytes(t("documents"), ["source"], [F.desc("doc_id")], F.octet_length("text"), 20000).select("doc_id", "source")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 7")
def newest_seven(t, spark, sf):
    return feeds.newest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 7).select("event_id", "user_id")


@query(rf"""with k as (select page_id, url, rtrim(regexp_replace(regexp_replace({_REF}, '^m\.', ''), '^([^/]+)/(?:en|ru|uk|ua)(/|$)', '\1\2'), '/') as k from pages)
select page_id from k where url like 'https:%' and k not in (select k from k where url like 'http:%')""")
def unseen_sources(t, spark, sf):
    p = t("pages")
    return feeds.unseen(p.filter("url like 'https:%'"), U.website_key(c("url")), p.filter("url like 'http:%'"), U.website_key(c("url"))).select("page_id")


# ---- state ----

_FOLD = """with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as rn, (event_type = 'purchase')::int::double as o, (event_type = 'error')::int::double as er, event_type = 'signup' as s from events),
f as (select user_id, 0::bigint as rn, 0.0::double as score, 0::bigint as empty_passes, 0::bigint as skip_left, 0::bigint as streak, false as ever, 0::bigint as offers, 0::bigint as errors from (select distinct user_id from events)
  union all select f.user_id, e.rn, greatest(0.0::double, f.score * 0.9::double + e.o * 1.0::double - e.er * 0.5::double), f.empty_passes + (e.o = 0)::int, case when e.o = 0 then 3 else 0 end,
    case when e.s then 0 when e.o > 0 then f.streak + 1 else f.streak end, f.ever or e.s, f.offers + e.o::bigint, f.errors + e.er::bigint from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)"""


@query(_FOLD + """ select user_id, round(score, 6) as score, offers, errors, rn as passes, empty_passes, skip_left, streak as media_streak, ever as provider_ever
from (select *, row_number() over (partition by user_id order by rn desc) as last from f) where last = 1""")
def domain_state(t, spark, sf):
    s = folds.domain_state(t("events"), "user_id", ["ts", "event_id"], (c("event_type") == "purchase").cast("int"), (c("event_type") == "error").cast("int"), c("event_type") == "signup")
    return s.withColumn("score", F.round("score", 6))


@query("""with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as rn, event_type in ('view', 'click') as n from events),
f as (select user_id, 0::bigint as rn, 1::bigint as page, 0::bigint as dry from (select distinct user_id from events)
  union all select f.user_id, e.rn, case when e.n then case when f.page >= 5 then 1 else f.page + 1 end when f.dry + 1 >= 2 or f.page >= 5 then 1 else f.page + 1 end,
    case when e.n or f.dry + 1 >= 2 or f.page >= 5 then 0 else f.dry + 1 end from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, page, dry from (select *, row_number() over (partition by user_id order by rn desc) as last from f) where last = 1""")
def page_cursors(t, spark, sf):
    return folds.page_cursor(t("events"), "user_id", ["ts", "event_id"], c("event_type").isin("view", "click").cast("int"), 5)


_BACKOFF = """with e as (select user_id, event_id, ts, epoch_us(ts) // 1000000 as t, event_type = 'error' as bad from events where event_type in ('error', 'purchase')),
g as (select *, count(*) filter (where not bad) over (partition by user_id order by ts, event_id) as run from e),
f as (select user_id, count(*) filter (where bad) as fails, max(t) filter (where bad) as t from g join (select user_id, max(run) as run from g group by 1) using (user_id, run) group by 1)
select user_id, fails, coalesce(t + least(60.0 * pow(2, fails - 1), 3600.0), 0)::double as cooldown_until,
  (case when fails >= 2 then t + 86400 else 0 end)::double as quarantined_until, (case when fails >= 2 then t + 21600 else 0 end)::double as next_reprobe_at from f"""
_WAITS = {"base": 60.0, "cap": 3600.0, "threshold": 2, "quarantine": 86400.0, "reprobe": 21600.0}


@query(_BACKOFF)
def backoff_state(t, spark, sf):
    tried = t("events").filter("event_type in ('error', 'purchase')")
    return folds.backoff_state(tried, "user_id", ["ts", "event_id"], c("ts").cast("timestamp").cast("long"), c("event_type") == "error", **_WAITS)


# ---- snapshots ----


@query("""with i as (select c_custkey + 100 as k, c_name || '*' as n, c_acctbal + 1 as b from customer)
select coalesce(c_custkey, k) as c_custkey, case when c_custkey is null or (k is not null and c_acctbal < 5000) then n else c_name end as c_name, case when c_custkey is null or (k is not null and c_acctbal < 5000) then b else c_acctbal end as c_acctbal
from customer full join i on c_custkey = k""")
def conditional_upsert(t, spark, sf):
    now = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = now.selectExpr("c_custkey + 100 c_custkey", "c_name || '*' c_name", "c_acctbal + 1 c_acctbal")
    return upserts.merge(now, new, ["c_custkey"], c("c_acctbal") < 5000)


@query(f"""with p as (select page_id, url, {_HOST} as h from pages) select page_id, url from p where url like 'http:%'
union all select page_id, url from (select *, row_number() over (partition by h order by page_id) as rn from p where url like 'https:%' and h not in (select h from p where url like 'http:%')) where rn = 1""")
def get_or_create(t, spark, sf):
    p = t("pages").select("page_id", "url")
    return upserts.insert_missing(p.filter("url like 'http:%'"), p.filter("url like 'https:%'"), U.source_host(c("url")))


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else c_name end as c_name, case when c_custkey % 2 = 0 then 0.0 else c_acctbal end as c_acctbal, c_nationkey from customer""")
def partial_update(t, spark, sf):
    p = t("customer").select("c_custkey", lit(None).cast("string").alias("c_name"), (c("c_custkey") % 3 == 0).alias("set_c_name"), lit(0.0).alias("c_acctbal"), (c("c_custkey") % 2 == 0).alias("set_c_acctbal"))
    return upserts.patch(t("customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), p, "c_custkey", ["c_name", "c_acctbal"])


@query("""select i.range as id, exists (select 1 from orders where o_orderkey = i.range and o_orderstatus = 'P') as known from range(0, 500) i""")
def bulk_reject(t, spark, sf):
    return upserts.split_known(spark.range(500), t("orders").filter("o_orderstatus = 'P'").select(c("o_orderkey").alias("id")), "id")


@query("select o_orderkey as id, exists (select 1 from orders as p where p.o_orderkey = o.o_orderkey and p.o_orderstatus = 'P') as known from orders as o")
def bulk_reject_all(t, spark, sf):
    orders = t("orders").withColumnRenamed("o_orderkey", "id")
    return upserts.split_known(orders.select("id"), orders.filter("o_orderstatus = 'P'").select("id"), "id")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_nationkey = 3) then null else o_custkey end as o_custkey from orders")
def orphaned(t, spark, sf):
    return upserts.orphan(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").filter("c_nationkey = 3"), "c_custkey")


@query("select o_orderkey, case when o_orderstatus in ('P', 'O') and o_custkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders")
def status_transition(t, spark, sf):
    return upserts.transition(t("orders"), "o_orderstatus", ["P", "O"], "X", c("o_custkey") % 2 == 0).select("o_orderkey", "o_orderstatus")


# ---- pages ----


@query()
def page_blocks(t, spark, sf):
    return html.blocks(t("pages"))


_PLAIN = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_CUT = "'</?(?:p|div|h1|article|section|li|ul)(?: [^>]*)?>'"


@query(rf"""with h as (select page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)</nav>(.*?)<footer', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as h from pages),
s as (select page_id, unnest(regexp_split_to_array(h, {_CUT})) as x, generate_subscripts(regexp_split_to_array(h, {_CUT}), 1) as i from h),
t as (select page_id, i, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '<[^>]*>'), lambda y: trim({_PLAIN.format('y')}, E' 
	
')), lambda y: y <> ''), ' ') as text from s),
d as (select page_id, text, min(i) as i from t where length(text) >= 30 group by 1, 2) select page_id, row_number() over (partition by page_id order by i) - 1 as pos, sha1(text) as key, text from d""")
def block_texts(t, spark, sf):
    return html.blocks(t("pages")).drop("links")


@query(rf"""with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as a from pages), u as (select page_id, unnest(h) as href, unnest(a) as anchor, generate_subscripts(h, 1) - 1 as pos from l)
select page_id, pos, {_PLAIN.format('href')} as href, trim(regexp_replace({_PLAIN.format('anchor')}, '\s+', ' ', 'g')) as anchor from u""")
def page_links(t, spark, sf):
    return html.links(t("pages"))


@query(rf"""select page_id, nullif(trim({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}), '') as title, null::varchar as site_name, null::varchar as description, null::varchar as image, false as is_article, false as has_offer from pages""")
def page_metadata(t, spark, sf):
    return html.metadata(t("pages"))


# ---- streams ----


def _folder(spark) -> str:
    return storage.shared_folder(spark)


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(t, spark, sf):
    counts = streams.tumbling_counts(streams.table_stream(spark, f"{sf}/events.parquet"), "ts", "1 day", "event_type")
    out = streams.drained(counts, "complete", _folder(spark))
    return out.withColumn("start", c("start").cast("timestamp_ntz"))


@query("select distinct user_id, event_type, date_trunc('month', ts)::date as month from events")
def stream_dedupe(t, spark, sf):
    s = streams.table_stream(spark, f"{sf}/events.parquet").withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    out = streams.drained(streams.deduplicated(s, ["user_id", "event_type", "month"]), "append", _folder(spark))
    return out.select("user_id", "event_type", "month")


@query(_FOLD.replace("e.o * 1.0::double - e.er * 0.5::double", "(e.o - 0.5::double * e.er)") + " select user_id, round(score, 6) as score, rn as passes from (select *, row_number() over (partition by user_id order by rn desc) as last from f) where last = 1")
def stream_scores(t, spark, sf):
    s = streams.table_stream(spark, f"{sf}/events.parquet").withColumn("gain", (c("event_type") == "purchase").cast("double") - 0.5 * (c("event_type") == "error").cast("double"))
    out = streams.drained(streams.decayed_scores(s, "user_id", ["ts", "event_id"], "gain"), "update", _folder(spark), lambda rows: streams.latest(rows, "user_id"))
    return out.withColumn("score", F.round("score", 6))


@query(_BACKOFF)
def stream_backoff(t, spark, sf):
    s = streams.table_stream(spark, f"{sf}/events.parquet").filter("event_type in ('error', 'purchase')")
    s = s.withColumn("t", F.floor(c("ts").cast("double")).cast("double")).withColumn("bad", c("event_type") == "error")
    return streams.drained(streams.backoff_states(s, "user_id", ["ts", "event_id"], "t", "bad", **_WAITS), "update", _folder(spark), lambda rows: streams.latest(rows, "user_id"))


# ---- beyond the reference: plain relational forms ----


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)""")
def extra_cube(t, spark, sf):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count(lit(1)).alias("n"))
