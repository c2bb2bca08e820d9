"""Whose offer it is, whether it is valid, and what its publication leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Fixed values.
VALUE_TYPES = ("percent", "fixed", "special_price")
TIER_RANK = {"low": 0, "medium": 1, "high": 2}


def editorial(items: DataFrame, page: str, article: Column, commercial: Column) -> DataFrame:
    """(page, editorial): pages that declare an article and nothing commercial."""
    return items.groupBy(page).agg((F.coalesce(F.bool_or(article), F.lit(False)) & ~F.coalesce(F.bool_or(commercial), F.lit(False))).alias("editorial"))


def attribution(channel: Column, noise: Column, name: Column, ref: Column, brand: Column, host: Column, blocks: Column, outbound: Column, blocked: Column, article: Column, business: Column, own_words: Column, target: Column, least_outbound: int = 3) -> Column:
    """(provider, first_party, ref) of an item, null if it has no provider.

    channel: the item is of a messenger channel, noise: of one not wanted; target: the first outside link
    to a host that is not blocked. An article page without a business, or one that links to many hosts,
    speaks for others only.
    """
    out = lambda provider, own, at: F.struct(provider.alias("provider"), F.lit(own).alias("first_party"), at.alias("ref"))
    nonempty = lambda x: F.when(x != "", x)
    yes = lambda x: F.coalesce(x, F.lit(False))
    brand, host, name, target = map(nonempty, (brand, host, name, target))
    own = out(brand, True, F.coalesce(urls.origin(ref), F.concat(F.lit("https://"), host)))
    other = out(F.coalesce(nonempty(urls.bare_host(target)), target), False, urls.origin(target))
    media = yes(article & ~yes(business)) | yes(outbound >= least_outbound)
    website = (
        F.when(yes(blocked), None)
        .when(media, F.when(target.isNotNull(), other))
        .when(yes(own_words) & brand.isNotNull(), own)
        .when(target.isNotNull(), other)
        .when(yes(blocks <= 1) & brand.isNotNull(), own)
    )
    return F.when(yes(channel), F.when(~yes(noise), out(F.coalesce(name, ref), True, ref))).otherwise(website)


def plain_attribution(ref: Column, brand: Column, host: Column, blocks: Column, blocked: Column, own_words: Column, target: Column, target_blocked: Column) -> Column:
    """(provider, first_party, ref) of a website's item by the older, simpler rules, null if it has no provider.

    target is the first outside link, whatever its host; one to a blocked host is no provider. Articles and
    pages of many links are not told apart.
    """
    nonempty = lambda x: F.when(x != "", x)
    yes = lambda x: F.coalesce(x, F.lit(False))
    brand, host, target = map(nonempty, (brand, host, target))
    out = lambda provider, own, at: F.struct(provider.alias("provider"), F.lit(own).alias("first_party"), at.alias("ref"))
    own = out(brand, True, F.coalesce(urls.origin(ref), F.concat(F.lit("https://"), host)))
    other = out(F.coalesce(nonempty(urls.bare_host(target)), target), False, urls.origin(target))
    named = brand.isNotNull()
    return F.when(yes(blocked), None).when(yes(own_words) & named, own).when(target.isNotNull() & ~yes(target_blocked), other).when(yes(blocks <= 1) & named, own)


def errors(valid_from: Column, valid_until: Column, kind: Column, value: Column, **links: Column) -> Column:
    """What is wrong with an offer, in order: bad_<link>, dates, value_missing, value_unwanted."""
    valued = F.coalesce(kind.isin(*VALUE_TYPES), F.lit(False))
    bad = [F.when((link != "") & ~link.rlike("^https?://"), f"bad_{name}") for name, link in links.items()]
    found = F.array(*bad, F.when(valid_until < valid_from, "dates"), F.when(valued & value.isNull(), "value_missing"), F.when(~valued & value.isNotNull(), "value_unwanted"))
    return F.filter(found, lambda x: x.isNotNull())


def promoted(offers: DataFrame, sources: DataFrame, key: str, wanted: Column, site: str, article: str, content: str) -> DataFrame:
    """(key, host, new_source, linked): published offers without a source, their site's host, whether that is new, and whether the offer is linked to it.

    offers has source_host, the host of its source or null; sources has host. An offer stays unlinked where
    its source has the same content already; of equal new ones the least key is linked.
    """
    at = urls.source_host(F.coalesce(urls.origin(F.col(site)), urls.origin(F.col(article))))
    fresh = offers.filter(wanted & F.col("source_host").isNull()).select(key, at.alias("host"), F.col(content).alias("_c")).filter(F.col("host").isNotNull())
    known = sources.select("host").distinct().withColumn("_known", F.lit(True))
    taken = offers.filter(F.col("source_host").isNotNull() & F.col(content).isNotNull()).select(F.col("source_host").alias("host"), F.col(content).alias("_c")).distinct().withColumn("_taken", F.lit(True))
    first = fresh.groupBy("host", "_c").agg(F.min(key).alias("_first"))
    both = fresh.join(known, "host", "left").join(taken, ["host", "_c"], "left").join(first.filter(F.col("_c").isNotNull()), ["host", "_c"], "left")
    linked = F.col("_c").isNull() | (F.col("_taken").isNull() & (F.col(key) == F.col("_first")))
    return both.select(key, "host", F.col("_known").isNull().alias("new_source"), linked.alias("linked"))


def by_confidence(page: DataFrame, tier: str, position: str) -> DataFrame:
    """The rows of a page with their rank among them: doubtful tiers first, unknown ones as medium, else as before."""
    rank = F.coalesce(*(F.when(F.col(tier) == t, n) for t, n in TIER_RANK.items()), F.lit(TIER_RANK["medium"]))
    return page.withColumn("tier_rank", rank).orderBy("tier_rank", position)
