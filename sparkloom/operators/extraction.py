"""Offers of pages from offers of blocks, slugs to ids, and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import offers, urls
from .places import find_names
from .resolution import DISCOUNT_RANK


def page_offers(blocks: DataFrame, page: str, position: str) -> DataFrame:
    """One offer a page from its blocks' offers, as columns of offers.candidate and locations.

    The first block leads; discounts, audiences, kinds and locations are united in
    order, the target is the first there is, and the best discount is the headline.
    """
    lists = ("discounts", "audiences", "kinds", "locations")
    single = ("title", "provider", "site_url", "article_url", "valid_until")
    rows = blocks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), *lists, *single, "target_url"))).alias("b"))
    united = lambda name: F.array_distinct(F.flatten(F.transform("b", lambda x: x[name]))).alias(name)
    first = F.try_element_at(F.filter(F.transform("b", lambda x: x["target_url"]), lambda u: u != ""), F.lit(1)).alias("target_url")
    rows = rows.select(page, *(F.col("b")[0][c].alias(c) for c in single), first, *map(united, lists))
    rank = lambda d: F.coalesce(*(F.when(d["kind"] == k, n) for k, n in DISCOUNT_RANK.items()), F.lit(0))
    known = F.filter("discounts", lambda d: d["kind"].isNotNull())
    ranked = F.transform(known, lambda d, i: F.struct(rank(d).alias("r"), F.coalesce(d["value"].cast("double"), F.lit(0.0)).alias("v"), (-i).alias("i"), d["kind"].alias("kind"), d["value"].alias("value")))
    best = F.array_max(ranked)
    return rows.select("*", best["kind"].alias("kind"), best["value"].alias("value"), offers.page_hash(F.col("title"), F.col("provider"), F.col("article_url"), F.col("discounts")).alias("content_hash"))


def slug_ids(matches: DataFrame, categories: DataFrame, position: str) -> DataFrame:
    """(slug, name, id, created) of every matched slug: the id it has, or a new one behind the greatest, in the order of first match."""
    first = matches.groupBy("slug").agg(F.min(F.struct(position, "name")).alias("x")).select("slug", "x.name", F.col(f"x.{position}").alias("at"))
    both = first.join(categories.select("slug", "id"), "slug", "left")
    last = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # new slugs are words of a lexicon: few, whatever the size of matches
    new = both.filter("id is null").withColumn("n", F.row_number().over(Window.orderBy("at", "slug"))).crossJoin(last)
    made = new.select("slug", "name", (F.col("last") + F.col("n")).cast("long").alias("id"), F.lit(True).alias("created"))
    return both.filter("id is not null").select("slug", "name", F.col("id").cast("long").alias("id"), F.lit(False).alias("created")).unionByName(made)


def outbound_hosts(items: DataFrame, page: str, url: str, links: str, blocked: DataFrame | None = None) -> DataFrame:
    """(page, outbound): how many other hosts a page's items link to, without blocked ones and their subdomains if these are given."""
    out = items.select(page, urls.bare_host(F.col(url)).alias("_own"), F.explode_outer(F.transform(F.col(links), urls.bare_host)).alias("host"))
    pairs = out.filter((F.col("host") != "") & (F.col("host") != F.col("_own"))).select(page, "host").distinct()
    if blocked is not None:
        from .hosts import not_blocked

        pairs = not_blocked(pairs, "host", blocked)
    counts = pairs.groupBy(page).agg(F.count(F.lit(1)).alias("outbound"))
    return items.select(page).distinct().join(counts, page, "left").fillna(0, ["outbound"])


def merged_counters(*summaries: DataFrame) -> DataFrame:
    """(key, value): counters of several summaries (key, value) added up by key."""
    every = summaries[0]
    for one in summaries[1:]:
        every = every.unionByName(one)
    return every.groupBy("key").agg(F.sum("value").alias("value"))


def united_lists(*lists: DataFrame) -> DataFrame:
    """(term): terms of several lists (pos, term), list by list, each once ignoring case and outer white space, in its first spelling; with list and pos."""
    every = None
    for i, one in enumerate(lists):
        part = one.select(F.lit(i).alias("list"), "pos", F.trim("term").alias("term")).filter("term <> ''")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(F.lower("term").alias("_k")).agg(F.min(F.struct("list", "pos", "term")).alias("x"))
    return first.select("x.list", "x.pos", "x.term")


def promo_first(rows: DataFrame, is_promo: Column, position: str) -> DataFrame:
    """Rows with rank: promotional ones first, each part in its order."""
    return rows.withColumn("_part", F.when(is_promo, 0).otherwise(1)).orderBy("_part", position).drop("_part")


def page_localities(about: DataFrame, forms: DataFrame) -> DataFrame:
    """(page_id, locality) of sites.about: what the page declares, else the first name of the dictionary in its contact texts, else null."""
    found = find_names(about.select("page_id", "contact"), "page_id", "contact", forms).select("page_id", F.try_element_at("names", F.lit(1)).alias("_first"))
    declared = F.when(F.trim("locality") != "", F.trim("locality"))
    return about.select("page_id", "locality").join(found, "page_id").select("page_id", F.coalesce(declared, F.col("_first")).alias("locality"))


def item_locations(items: DataFrame, key: str, locality: str, text: str, forms: DataFrame) -> DataFrame:
    """(key, locations): cities of an item's locality, or that itself, then those of its text, else whether it is online; key is unique."""
    own = find_names(items, key, locality, forms).withColumnRenamed("names", "_own")
    named = find_names(items, key, text, forms).withColumnRenamed("names", "_in")
    both = items.select(key, locality, text).join(own, key).join(named, key)
    return both.select(key, offers.locations(F.col(locality), F.col("_own"), F.col("_in"), F.col(text)).alias("locations"))
