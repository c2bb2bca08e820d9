"""What decisions on offers and suggestions lead to, edits with their children, and rows for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def published(offers: DataFrame, chosen: Column, now: Column, key: str = "id", status: str = "status", parent: str = "supersedes", seen: str = "last_seen") -> DataFrame:
    """Chosen offers become published, seen now, and supersede nothing any more; published offers that they superseded expire."""
    rows = offers.withColumn("_now", F.coalesce(chosen, F.lit(False)))
    gone = rows.filter(F.col("_now") & F.col(parent).isNotNull()).select(F.col(parent).alias(key)).distinct().withColumn("_gone", F.lit(True))
    both = rows.join(gone, key, "left")
    state = F.when(F.col("_now"), "published").when(F.col("_gone") & (F.col(status) == "published"), "expired").otherwise(F.col(status))
    return both.select(*(state.alias(c) if c == status else F.when(~F.col("_now"), F.col(c)).alias(c) if c == parent else F.when(F.col("_now"), now).otherwise(F.col(c)).alias(c) if c == seen else F.col(c) for c in offers.columns))


def reviewed(suggestions: DataFrame, decisions: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    """(key, outcome, status) of each decision (key, verdict): missing without such a suggestion, conflict if it was decided before, else done."""
    both = decisions.join(suggestions.select(key, status), key, "left")
    pending = F.col(status) == "pending"
    outcome = F.when(F.col(status).isNull(), "missing").when(pending, "done").otherwise("conflict")
    return both.select(key, outcome.alias("outcome"), F.when(pending, F.col("verdict")).otherwise(F.col(status)).alias(status))


def looked_up(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The table's rows of the ids; an id without a row is an error when the result is read."""
    known = table.withColumn("_known", F.lit(True))
    both = ids.join(known, key, "left")
    there = F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("not found: "), F.col(key).cast("string")))
    return both.filter(there.isNull()).drop("_known")


def synced_links(offers: DataFrame, edits: DataFrame, links: DataFrame, key: str, fields: tuple[str, ...] = ("provider", "site_url", "article_url")) -> DataFrame:
    """links (key, pos, fields) after edits (key, and for each field c, c and set_c) of offers (key, fields).

    An edited offer without links gets one; its only link takes the new values; of
    several the first that has the old site and article does.
    """
    given = {c: F.coalesce(F.col(f"set_{c}"), F.lit(False)) for c in fields}
    any_ = F.lit(False)
    for flag in given.values():
        any_ = any_ | flag
    new = edits.filter(any_).select(key, *(F.struct(f"set_{c}", c).alias(f"_{c}") for c in fields))
    edited = offers.join(new, key).select(key, *(F.col(c).alias(f"_old_{c}") for c in fields), *(F.when(F.coalesce(F.col(f"_{c}")[f"set_{c}"], F.lit(False)), F.col(f"_{c}")[c]).otherwise(F.col(c)).alias(f"_new_{c}") for c in fields))
    rows = links.join(edited, key, "left")
    same = F.col("site_url").eqNullSafe(F.col("_old_site_url")) & F.col("article_url").eqNullSafe(F.col("_old_article_url"))
    counts = links.join(edited, key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(same, F.col("pos"))).alias("_first"))
    rows = rows.join(counts, key, "left")
    takes = F.coalesce((F.col("_n") == 1) | (F.col("pos") == F.col("_first")), F.lit(False))
    kept = rows.select(key, "pos", *(F.when(takes, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fields))
    fresh = edited.join(links.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast(links.schema["pos"].dataType).alias("pos"), *(F.col(f"_new_{c}").alias(c) for c in fields))
    return kept.unionByName(fresh)


def blocked_by(offers: DataFrame, blocked: DataFrame, key: str, *sources: str) -> DataFrame:
    """(key, blocked_host): the first real host of site, article and provider that is blocked, is below a blocked host or is always blocked."""
    each = offers.select(key, F.posexplode(F.array(*(urls.real_host(F.col(c)) for c in sources))).alias("at", "host")).filter("host <> ''")
    listed = blocked.select(F.lower("host").alias("_suffix")).filter("_suffix <> ''").distinct()
    every = listed.unionByName(offers.sparkSession.createDataFrame([(x,) for x in urls.ALWAYS_BLOCKED], "_suffix string")).distinct()
    hit = each.withColumn("_suffix", F.explode(urls.host_suffixes(F.col("host")))).join(every, "_suffix", "left_semi")
    return hit.groupBy(key).agg(F.min(F.struct("at", "host"))["host"].alias("blocked_host"))


def block_list(*lists: DataFrame) -> DataFrame:
    """(host): the hosts of several lists, normalised, without empty ones."""
    every = lists[0].select("host")
    for one in lists[1:]:
        every = every.unionByName(one.select("host"))
    return every.select(urls.bare_host(F.col("host")).alias("host")).filter("host <> ''").distinct()


def feed_rows(offers: DataFrame, key: str) -> DataFrame:
    """(key, text, host): title and description on two lines, and the host of the site or else the article."""
    text = F.regexp_replace(F.concat_ws("\n", "title", F.coalesce("description", F.lit(""))), r"^\s+|\s+$", "")
    return offers.select(key, text.alias("text"), F.coalesce(urls.source_host(F.coalesce("site_url", "article_url")), F.lit("")).alias("host"))


def payload(offers: DataFrame, renamed: dict[str, str], dates: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """Rows as an interface wants them: columns renamed, dates as ISO text, nulls of some columns replaced."""
    out = [F.date_format(F.col(c), "yyyy-MM-dd").alias(c) if c in dates else F.col(c).alias(renamed.get(c, c)) for c in offers.columns]
    return offers.select(*out).fillna(defaults or {})


def moved_term(term: str, candidates: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates without the term, and the approved list (term, z) with it, once; doing it again changes nothing."""
    spark = candidates.sparkSession
    wanted = spark.createDataFrame([(term,)], "term string")
    new = wanted.join(approved.select("term"), "term", "left_anti").join(candidates.select("term", "z"), "term", "left")
    return candidates.filter(F.col("term") != term), approved.unionByName(new.select(approved.columns))


def candidate_rows(survivors: DataFrame) -> DataFrame:
    """(term, z, support) of survivors (term, z, domains): z to three places, support the distinct named domains."""
    return survivors.select("term", F.round("z", 3).alias("z"), F.size(F.array_distinct(F.filter("domains", lambda d: d != ""))).cast("long").alias("support"))


def known_or_seed(brands: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """(key, host, from_seed): the resolved host of each brand, else its curated one; brands with neither are left out."""
    both = brands.join(resolved.select(key, F.col("host").alias("_found")), key, "left")
    host = F.coalesce(F.when(F.col("_found") != "", F.col("_found")), F.when(F.col("seed") != "", F.col("seed")))
    return both.select(key, host.alias("host"), F.coalesce(F.col("_found") == "", F.lit(True)).alias("from_seed")).filter("host is not null")


def newly_pinned(pins: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host): normalised hosts not pinned yet, each once."""
    return hosts.select(urls.bare_host(F.col("host")).alias("host")).filter("host <> ''").distinct().join(pins.select("host"), "host", "left_anti")


def uncrawled(sources: DataFrame, key: str, crawled: str, wanted: Column, n: int) -> DataFrame:
    """The first n wanted sources that were never crawled."""
    return sources.filter(wanted & F.col(crawled).isNull()).orderBy(key).limit(n)


def reactivated(current: DataFrame, incoming: DataFrame, key: Column, active: str) -> DataFrame:
    """current with inactive rows active again whose computed key comes in, and rows of new keys inserted, active, the first by column order of each."""
    theirs = incoming.select(key.alias("_k")).distinct().withColumn("_in", F.lit(True))
    ours = current.withColumn("_k", key).join(theirs, "_k", "left").withColumn(active, F.col(active) | F.coalesce("_in", F.lit(False))).select(current.columns)
    new = incoming.withColumn(active, F.lit(True)).select(current.columns).withColumn("_k", key).join(current.select(key.alias("_k")).distinct(), "_k", "left_anti")
    return ours.unionByName(new.groupBy("_k").agg(F.min(F.struct(*current.columns)).alias("x")).select("x.*"))


def suggested(suggestions: DataFrame, sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """(type, url_or_handle, outcome) of each incoming suggestion: known where an active source has the same reference, or for websites the same host; existing where it was made before, else created."""
    refs = sources.filter("is_active").select("type", urls.normalized_ref(F.col("url_or_handle")).alias("_ref")).distinct().withColumn("_same", F.lit(True))
    hosts = sources.filter("is_active and type = 'website'").select(F.lit("website").alias("type"), urls.source_host(F.col("url_or_handle")).alias("_host")).distinct().withColumn("_near", F.lit(True))
    old = suggestions.select("type", "url_or_handle").distinct().withColumn("_old", F.lit(True))
    rows = incoming.select("type", "url_or_handle").distinct().withColumn("_ref", urls.normalized_ref(F.col("url_or_handle"))).withColumn("_host", urls.source_host(F.col("url_or_handle")))
    both = rows.join(refs, ["type", "_ref"], "left").join(hosts, ["type", "_host"], "left").join(old, ["type", "url_or_handle"], "left")
    return both.select("type", "url_or_handle", F.when(F.col("_same") | F.col("_near"), "known").when(F.col("_old"), "existing").otherwise("created").alias("outcome"))


def promoted_blocks(current: DataFrame, hosts: DataFrame) -> DataFrame:
    """current (host, status, sample) after hosts (host, sample) are blocked: approved, a row that is there keeping its sample."""
    theirs = hosts.select(urls.bare_host(F.col("host")).alias("host"), F.col("sample").alias("_new")).filter("host <> ''").groupBy("host").agg(F.min("_new").alias("_new")).withColumn("_in", F.lit(True))
    both = current.withColumn("_old", F.lit(True)).join(theirs, "host", "full")
    return both.select("host", F.when(F.col("_in"), "approved").otherwise(F.col("status")).alias("status"), F.when(F.col("_old"), F.col("sample")).otherwise(F.col("_new")).alias("sample"))


def first_crawl(sources: DataFrame, key: str, crawled: str, wanted: Column, budget: int, failed: Column, now: Column) -> DataFrame:
    """(key, crawled, outcome) of the first wanted sources that were never crawled: all are marked, so one that fails is not tried for ever."""
    return uncrawled(sources, key, crawled, wanted, budget).select(key, now.alias(crawled), F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise("crawled").alias("outcome"))


def penalised(accounts: DataFrame, failures: DataFrame, name: str, as_of: Column, seconds: float) -> DataFrame:
    """accounts (name, state, until) after failures (name, kind): login, challenge and forbidden ban an account, missing, private and absent leave it, all others make it wait."""
    banning, harmless = ("login", "challenge", "forbidden"), ("missing", "private", "absent")
    worst = failures.groupBy(name).agg(F.bool_or(F.col("kind").isin(*banning)).alias("_ban"), F.bool_or(~F.col("kind").isin(*banning, *harmless)).alias("_wait"))
    both = accounts.join(worst, name, "left")
    ban, wait = F.coalesce("_ban", F.lit(False)) | (F.col("state") == "banned"), F.coalesce("_wait", F.lit(False))
    state = F.when(ban, "banned").when(wait, "cooldown").otherwise(F.col("state"))
    return both.select(name, state.alias("state"), F.when(ban, None).when(wait, as_of + seconds).otherwise(F.col("until")).alias("until"))


def dispatched(sources: DataFrame, readers: dict[str, str], kind: str = "type") -> DataFrame:
    """sources with the reader of their type; sources of a type without one are left out."""
    reader = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in readers.items()))
    return sources.withColumn("reader", reader).filter("reader is not null")


def category_outcome(categories: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, slug, outcome) of each edit (id or null for a new one, slug): conflict where another category has the slug, missing without such an id, else done."""
    taken = categories.select("slug", F.col("id").alias("_owner"))
    known = categories.select("id").withColumn("_there", F.lit(True))
    both = edits.select("id", "slug").join(taken, "slug", "left").join(known, "id", "left")
    outcome = F.when(F.col("id").isNotNull() & F.col("_there").isNull(), "missing").when(F.col("_owner").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("id")), "conflict").otherwise("done")
    return both.select("id", "slug", outcome.alias("outcome"))


def promo_text(description: Column, labels: Column) -> Column:
    """What identifies a promotion: its description and the labels of its discounts."""
    return F.concat_ws(" ", F.coalesce(description, F.lit("")), F.filter(labels, lambda x: x != ""))


def host_candidates(*values: Column) -> Column:
    """The distinct real hosts of several values."""
    return F.filter(F.array_distinct(F.array(*map(urls.real_host, values))), lambda h: h != "")


def discount_rows(offers: DataFrame, key: str) -> DataFrame:
    """(key, label, kind, value, sort_order): an offer's discounts, or one made of its own kind, or none."""
    own = F.when(F.col("kind").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("label"), "kind", "value"))).otherwise(F.slice("discounts", 1, 0))
    rows = F.when(F.size("discounts") > 0, F.col("discounts")).otherwise(own)
    return offers.select(key, F.posexplode(rows).alias("sort_order", "_d")).select(key, "_d.label", "_d.kind", "_d.value", "sort_order")


def location_rows(offers: DataFrame, key: str, locations: str) -> DataFrame:
    """(key, pos, name): an offer's locations, trimmed, without empty ones, each once."""
    names = F.array_distinct(F.filter(F.transform(locations, lambda x: F.trim(x)), lambda x: x != ""))
    return offers.select(key, F.posexplode(names).alias("pos", "name"))


def brand_sites(pois: DataFrame, least: int, most: int, blocked: DataFrame) -> DataFrame:
    """(brand, host): each brand's most frequent host, of equals the first seen, with enough places, neither blocked nor foreign; a host goes to its first brand by name, and at most so many brands are kept."""
    from .feeds import mode_by
    from .hosts import not_blocked

    named = pois.select(F.trim("brand").alias("brand"), urls.bare_host(F.col("website")).alias("host"), "pos").filter("brand <> '' and host <> ''")
    best = mode_by(named, "brand", "host", "pos").filter(F.col("n") >= least).filter(~urls.is_foreign(F.col("host")))
    first = not_blocked(best, "host", blocked).groupBy("host").agg(F.min("brand").alias("brand"))
    return first.select("brand", "host").orderBy("brand").limit(most)


def ranked_terms(scores: DataFrame, rejected: DataFrame, most: int) -> DataFrame:
    """Scores (term, z, support, pass_count) without rejected terms, ignoring case, the widest supported first."""
    gone = rejected.select(F.lower(F.trim("term")).alias("_k")).filter("_k <> ''").distinct()
    return scores.withColumn("_k", F.lower("term")).join(gone, "_k", "left_anti").drop("_k").orderBy(F.desc("support"), F.desc("pass_count"), "term").limit(most)


def latched(states: DataFrame, due: Column, confirmed: DataFrame, key: str, flag: str) -> DataFrame:
    """states with the flag set where it was due and the block is confirmed; without a confirmation it is tried again."""
    known = confirmed.select(key).distinct().withColumn("_done", F.lit(True))
    return states.join(known, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | (due & F.coalesce("_done", F.lit(False)))).drop("_done")


def cursor_after(cursors: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """cursors (key, cursor) after runs (key, reached, ok): a run that failed leaves its cursor."""
    return cursors.join(runs, key, "left").select(key, F.when(F.coalesce("ok", F.lit(False)), F.col("reached")).otherwise(F.col("cursor")).alias("cursor"))


def edited(offers: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """offers after edits (key, and for each column c, c and set_c), identities of changed addresses computed anew, with errors, what is wrong with them."""
    from .provenance import errors
    from .upserts import patch

    after = patch(offers, edits, key, columns)
    given = edits.select(key, *(F.col(f"set_{c}").alias(f"_set_{c}") for c in ("target_url", "article_url")))
    both = after.join(given, key, "left")
    anew = lambda c: F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), urls.canonical_target(F.col(c))).otherwise(F.col(f"{c}_canonical")).alias(f"{c}_canonical")
    wrong = errors(F.col("valid_from"), F.col("valid_until"), F.col("kind"), F.col("value"))
    out = [anew(c[: -len("_canonical")]) if c in ("target_url_canonical", "article_url_canonical") else F.col(c) for c in offers.columns]
    return both.select(*out, wrong.alias("errors"))
