"""Queries of what is due, whose offers are, and what follows their publication; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import cadence, folds, provenance
from .queries import _FOLD, _HOST, query

c, lit = F.col, F.lit

# ---- what is due ----

_DUE = """with n as (select count(*) as n from customer), d as (select c_custkey, (c_custkey - (n - 100) + n) % n as turn from customer, n where not coalesce(10000 - c_acctbal < 4000, false)),
w as (select * from d order by turn limit 90)"""


def _walked(t):
    size = t("customer").count()
    return cadence.due_walk(t("customer"), "c_custkey", size, size - 100, ~cadence.fresh(c("c_acctbal"), lit(10000), 4000), 90), size


@query(f"{_DUE} select c_custkey, turn from w")
def due_walk(t, spark, sf):
    return _walked(t)[0].select("c_custkey", "turn")


@query(f"{_DUE} select case when count(*) >= 90 then (max(turn) + 1 + any_value(n) - 100) % any_value(n) else any_value(n) - 100 end as cursor from w, n")
def walk_cursor(t, spark, sf):
    walked, size = _walked(t)
    return cadence.walk_end(walked, size, size - 100, 90)


@query("select o_orderkey, epoch(o_orderdate)::bigint as at from orders where o_orderstatus = 'O' and 996624000 - epoch(o_orderdate) < 31536000")
def cache_drain(t, spark, sf):
    cache = t("orders").select("o_orderkey", c("o_orderdate").cast("timestamp").cast("long").alias("at"), (c("o_orderstatus") != "O").alias("harvested"))
    return cadence.drain(cache, "at", "harvested", lit(996624000), 31536000, "o_orderkey").select("o_orderkey", "at")


@query("select l_partkey from lineitem group by 1 having max(l_orderkey * 10 + l_linenumber) < 130000")
def consumed_keys(t, spark, sf):
    return cadence.consumed(t("lineitem").withColumn("p", c("l_orderkey") * 10 + c("l_linenumber")), "l_partkey", "p", 130000)


@query("""with b as (select distinct source from documents), r as (select case when doc_id % 5 = 0 then source else lang || ': ' || source end as note from documents),
f as (select substring(note, strpos(note, ': ') + 2) as source, count(*) as n from r where strpos(note, ': ') > 0 group by 1) select source, coalesce(n, 0) as found from b left join f using (source)""")
def phrase_yield_all(t, spark, sf):
    notes = t("documents").select(F.when(c("doc_id") % 5 == 0, c("source")).otherwise(F.concat_ws(": ", "lang", "source")).alias("note"))
    return cadence.yields(t("documents"), "source", notes, "note")


@query("select 'u' || user_id as host, count(*) as rejected from events where event_type = 'error' and ts > timestamp '2024-01-15' group by 1")
def rejection_counts(t, spark, sf):
    errors = t("events").filter("event_type = 'error'").withColumn("host", F.concat(lit(" u"), c("user_id").cast("string"), lit(" ")))
    return cadence.rejections(cadence.since(errors, "ts", lit("2024-01-15").cast("timestamp_ntz")), "host")


@query("select coalesce(max(ts), timestamp '2024-01-15') as cursor from events where event_type = 'error' and ts > timestamp '2024-01-15'")
def high_water(t, spark, sf):
    cursor = lit("2024-01-15").cast("timestamp_ntz")
    return cadence.high_water(cadence.since(t("events").filter("event_type = 'error'"), "ts", cursor), "ts", cursor)


@query("""with e as (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events),
m as (select user_id, min(rn) as met from e where event_type = 'signup' group by 1) select user_id, event_id from e left join m using (user_id) where rn < coalesce(met, rn + 1) and rn <= 5""")
def new_items(t, spark, sf):
    items = t("events").withColumn("cursor", lit("signup"))
    return cadence.new_items(items, "user_id", [F.desc("ts"), c("event_id")], "event_type", "cursor", 5).select("user_id", "event_id")


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) // 1000000 as t, row_number() over (partition by user_id order by ts, event_id) as rn, greatest(20000, case event_type when 'error' then 90000 else 0 end) as d from events),
f as (select user_id, event_id, rn, t as start from e where rn = 1 union all select e.user_id, e.event_id, e.rn, greatest(e.t, f.start + e.d) from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select event_id, start from f""")
def request_times(t, spark, sf):
    at, delay = c("ts").cast("timestamp").cast("long"), F.when(c("event_type") == "error", 90000)
    return cadence.request_times(t("events"), "user_id", [c("ts"), c("event_id")], at, delay, 20000).select("event_id", "start")


@query("""with e as (select event_id, event_type <> 'error' as up, epoch_us(ts) // 1000000 as t, value, lag(epoch_us(ts) // 1000000) over (partition by user_id order by ts, event_id) as p from events),
d as (select *, coalesce(t - p >= 3600, true) as due, coalesce(t - p >= 3600 * 3, false) as over from e)
select event_id, case when not up then 'degraded' when not over then 'full' else 'none' end as active, case when up then over else due end as passive, case when up then 7200 else least(value, 50) end::double as sleep from d""")
def scheduler_steps(t, spark, sf):
    now = c("ts").cast("timestamp").cast("long")
    ticks = t("events").select("event_id", "event_type", "value", now.alias("t"), F.lag(now).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    return ticks.select("event_id", cadence.next_pass(c("t"), c("p"), 3600, 3, c("event_type") != "error", c("value"), 50.0, 7200.0).alias("x")).select("event_id", "x.*")


@query("""with s as (select o_custkey as c_custkey, arg_max(o_orderstatus, o_orderkey) as s, arg_max(o_totalprice, o_orderkey) as u from orders group by 1)
select c_mktsegment, min(c_custkey) as c_custkey from customer left join s using (c_custkey) where s is null or s = 'O' or (s = 'P' and u <= 100000) group by 1""")
def account_choice(t, spark, sf):
    states = t("orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max_by("o_totalprice", "o_orderkey").alias("until"))
    states = states.withColumn("state", F.when(c("s") == "F", "banned").when(c("s") == "P", "cooldown").otherwise("active"))
    return cadence.acquire(t("customer"), states, "c_mktsegment", "c_custkey", "c_custkey", lit(100000))


_SEEN = "select user_id, count(*) as score, max(epoch_us(ts) // 1000000) as seen from events group by 1"


def _seen(t):
    return t("events").groupBy("user_id").agg(F.count(lit(1)).alias("score"), F.max(c("ts").cast("timestamp").cast("long")).alias("seen"))


@query(f"select user_id, score from ({_SEEN}) where 1706659200 - seen >= 36000")
def revisit_cooldown(t, spark, sf):
    return cadence.outside_cooldown(_seen(t), "seen", lit(1706659200), 36000).select("user_id", "score")


@query(f"select user_id, score from ({_SEEN}) where not (score < 70 and 1706659200 - seen >= 36000)")
def pruned_state(t, spark, sf):
    return cadence.pruned(_seen(t), "score", "seen", lit(1706659200), 70, 36000).select("user_id", "score")


def _folded(t):
    return folds.domain_state(t("events"), "user_id", ["ts", "event_id"], (c("event_type") == "purchase").cast("int"), (c("event_type") == "error").cast("int"), (c("event_type") == "signup") & (c("user_id") % 3 == 0))


_LAST = _FOLD.replace("event_type = 'signup' as s", "event_type = 'signup' and user_id % 3 = 0 as s") + ", l as (select * from (select *, row_number() over (partition by user_id order by rn desc) as last from f) where last = 1)"


@query(_LAST + " select user_id, streak as media_streak from l where streak >= 10 and not ever and user_id % 10 <> 0")
def media_blocks(t, spark, sf):
    return _folded(t).filter(cadence.block_due(c("media_streak"), c("provider_ever"), c("user_id") % 10 == 0, 10)).select("user_id", "media_streak")


@query(_LAST + " select user_id, skip_left > 0 as skipped, greatest(skip_left - 1, 0) as skip_left from l")
def skipped_passes(t, spark, sf):
    return cadence.take_skip(_folded(t)).select("user_id", "skipped", "skip_left")


# ---- whose offer ----


@query("select l_orderkey, bool_or(l_returnflag = 'A') and not bool_or(sold) as editorial from (select *, l_tax > 0.07 as sold from lineitem) group by 1")
def editorial_pages(t, spark, sf):
    return provenance.editorial(t("lineitem"), "l_orderkey", c("l_returnflag") == "A", c("l_tax") > 0.07)


@query(f"""with p as (select page_id, url, {_HOST} as host, nullif(lower(regexp_extract(url, '^\\s*((?i:https?)://[^/?#]+)', 1)), '') as origin, case when page_id % 7 > 0 then 'brand' || page_id % 7 end as brand,
  case when page_id % 3 = 0 then 'https://shop' || page_id % 5 || '.example/x' end as target, 'shop' || page_id % 5 || '.example' as shop from pages),
a as (select *, case when page_id % 6 = 0 then case when page_id % 4 > 0 then 1 end when page_id % 11 = 0 then null when page_id % 5 = 0 then case when target is not null then 2 end
  when page_id % 2 = 0 and brand is not null then 3 when target is not null then 2 when page_id % 8 <= 1 and brand is not null then 3 end as way from p)
select page_id, case way when 1 then url when 2 then shop when 3 then brand end as provider, case when way is not null then way <> 2 end as first_party,
  case way when 1 then url when 2 then 'https://' || shop when 3 then coalesce(origin, 'https://' || host) end as ref from a""")
def attributions(t, spark, sf):
    i, text = c("page_id"), lambda k: (c("page_id") % k).cast("string")
    a = provenance.attribution(
        channel=i % 6 == 0, noise=i % 4 == 0, name=lit(""), ref=c("url"), brand=F.when(i % 7 > 0, F.concat(lit("brand"), text(7))), host=U.source_host(c("url")), blocks=i % 8, outbound=F.when(i % 10 == 0, 3).otherwise(0),
        blocked=i % 11 == 0, article=i % 5 == 0, business=i % 10 == 0, own_words=i % 2 == 0, target=F.when(i % 3 == 0, F.concat(lit("https://shop"), text(5), lit(".example/x"))),
    )
    return t("pages").select("page_id", a.alias("a")).select("page_id", "a.*")


@query("""select o_orderkey, array_to_string(list_filter([case when o_orderkey % 4 = 0 then 'bad_site' end, case when o_orderdate < timestamp '1996-01-01' then 'dates' end,
  case when o_orderstatus <> 'O' and o_orderkey % 3 = 0 then 'value_missing' end, case when o_orderstatus = 'O' and o_orderkey % 3 <> 0 then 'value_unwanted' end], lambda x: x is not null), ',') as errors from orders""")
def offer_errors(t, spark, sf):
    kind = F.when(c("o_orderstatus") == "F", "percent").when(c("o_orderstatus") == "P", "fixed")
    site = F.when(c("o_orderkey") % 4 == 0, "ftp://x").when(c("o_orderkey") % 4 == 1, "https://x").when(c("o_orderkey") % 4 == 2, "")
    e = provenance.errors(lit("1996-01-01").cast("timestamp_ntz"), c("o_orderdate"), kind, F.when(c("o_orderkey") % 3 != 0, c("o_totalprice")), site=site)
    return t("orders").select("o_orderkey", F.array_join(e, ",").alias("errors"))


@query(f"""with p as (select page_id, {_HOST} as host, page_id % 5 as content, page_id % 4 = 0 as sourced from pages),
n as (select * from p where not sourced and page_id % 3 > 0 and host is not null), s as (select distinct host from p where sourced), k as (select distinct host, content from p where sourced),
f as (select host, content, min(page_id) as first from n group by 1, 2)
select page_id, n.host, n.host not in (select host from s where host is not null) as new_source, (n.host, n.content) not in (select (host, content) from k where host is not null) and page_id = first as linked from n join f using (host, content)""")
def promoted_sources(t, spark, sf):
    offers = t("pages").select("page_id", "url", lit(None).cast("string").alias("article"), (c("page_id") % 5).alias("content"), F.when(c("page_id") % 4 == 0, U.source_host(c("url"))).alias("source_host"))
    sources = offers.select(c("source_host").alias("host")).filter("host is not null")
    return provenance.promoted(offers, sources, "page_id", (c("page_id") % 3 > 0) & (c("page_id") % 4 > 0), "url", "article", "content")


@query("""select o_orderkey, case o_orderpriority when '1-URGENT' then 0 when '3-MEDIUM' then 1 when '5-LOW' then 2 else 1 end as tier_rank from (select * from orders order by o_orderdate desc, o_orderkey desc limit 50)""")
def confidence_page(t, spark, sf):
    page = t("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    tier = F.when(c("o_orderpriority") == "1-URGENT", "low").when(c("o_orderpriority") == "3-MEDIUM", "medium").when(c("o_orderpriority") == "5-LOW", "high")
    return provenance.by_confidence(page.withColumn("tier", tier), "tier", "o_orderkey").select("o_orderkey", "tier_rank")
