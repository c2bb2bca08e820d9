"""Reputation of hosts and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def reputation(items: DataFrame, host: str, published: Column, rejected: Column) -> DataFrame:
    """(host, published, rejected): decided items of each host."""
    return items.groupBy(host).agg(F.count_if(published).alias("published"), F.count_if(rejected).alias("rejected"))


def subdomain_counts(candidates: DataFrame, per_host: DataFrame, host: str = "host") -> DataFrame:
    """For each candidate host the counts of itself and all its subdomains, by an equality join on suffixes."""
    suffixes = per_host.select(F.explode(urls.host_suffixes(F.col(host))).alias(host), "published", "rejected")
    sums = suffixes.groupBy(host).agg(F.sum("published").alias("published"), F.sum("rejected").alias("rejected"))
    return candidates.select(host).distinct().join(sums, host, "left").fillna(0, ["published", "rejected"])


def tier(published: Column, rejected: Column, has_discount: Column) -> Column:
    return F.when((published >= 1) & (rejected == 0) & has_discount, "high").when(((rejected >= 1) & (published == 0)) | ~has_discount, "low").otherwise("medium")


def signals(published: Column, rejected: Column, **lacking: Column) -> Column:
    """What speaks for or against an item, in order; lacking maps no_x to whether the item has x."""
    host = F.when((published >= 1) & (rejected == 0), "proven_host").when((rejected >= 1) & (published == 0), "noisy_host").when((published == 0) & (rejected == 0), "new_host")
    return F.filter(F.array(host, *(F.when(~has, F.lit(name)) for name, has in lacking.items())), lambda x: x.isNotNull())


def auto_block(per_host: DataFrame, blocked: DataFrame, host: str = "host", least_rejected: int = 2) -> DataFrame:
    """Hosts with enough rejected items, none published and no block yet."""
    return per_host.filter((F.col("rejected") >= least_rejected) & (F.col("published") == 0)).join(blocked.select(host), host, "left_anti").select(host)


def ratios(pages: DataFrame, host: str, is_article: Column, outbound: Column, anchored: Column, position: str, url: str, least_outbound: int = 3, samples: int = 3) -> DataFrame:
    """Per host: support, shares of articles and of pages that link to many hosts, own evidence, and its first URLs."""
    out = F.coalesce(outbound, F.lit(0))
    n = F.count(F.lit(1))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col(position) < samples, F.struct(position, url)))), 1, samples)
    return pages.filter(F.col(host) != "").groupBy(host).agg(n.alias("support"), (F.count_if(is_article) / n).alias("media_ratio"), (F.count_if(out >= least_outbound) / n).alias("aggregator_ratio"), F.bool_or(anchored & (out == 0)).alias("provider_evidence"), first[url].alias("sample_urls"))


def _blocked_hosts(rows: DataFrame, host: str, blocked: DataFrame, blocked_host: str) -> DataFrame:
    """(host): the rows' hosts that are a blocked or always blocked host or a subdomain of one."""
    hosts = rows.select(host).distinct().withColumn("_suffix", F.explode(urls.host_suffixes(F.col(host))))
    always = F.col("_suffix").isin(*urls.ALWAYS_BLOCKED)
    listed = hosts.join(blocked.select(F.col(blocked_host).alias("_suffix")), "_suffix", "left_semi").unionByName(hosts.filter(always).select("_suffix", host))
    return listed.select(host).distinct()


def not_blocked(rows: DataFrame, host: str, blocked: DataFrame, blocked_host: str = "host") -> DataFrame:
    """Rows whose host is no blocked host nor a subdomain of one."""
    return rows.join(_blocked_hosts(rows, host, blocked, blocked_host), host, "left_anti")


def survivors(scores: DataFrame, host: str, protected: DataFrame, blocked: DataFrame, least_support: int = 3, least_media: float = 0.5, least_aggregator: float = 0.5, most: int = 50) -> DataFrame:
    """Of ratios() the hosts to review: supported, like a medium or an aggregator, without own evidence, neither protected nor blocked; the highest ratios first."""
    looks = (F.col("media_ratio") >= least_media) | (F.col("aggregator_ratio") >= least_aggregator)
    kept = scores.filter((F.col("support") >= least_support) & looks & ~F.coalesce(F.col("provider_evidence"), F.lit(False)))
    kept = kept.join(protected.select(urls.bare_host(F.col(host)).alias(host)), host, "left_anti")
    return not_blocked(kept, host, blocked).orderBy(F.desc(F.col("media_ratio") + F.col("aggregator_ratio")), host).limit(most)


def labelled(items: DataFrame, url: str, passed: Column, has_offer: Column, is_article: Column, blocked: DataFrame) -> DataFrame:
    """items with label, host, neg_anchor (host is blocked), pos_anchor (has an offer schema) and is_article."""
    known = lambda x: F.coalesce(x, F.lit(False))
    rows = items.withColumns({"label": F.when(known(passed), "pass").otherwise("fail"), "host": urls.bare_host(F.col(url)), "pos_anchor": known(has_offer), "is_article": known(is_article)})
    bad = _blocked_hosts(rows, "host", blocked, "host").withColumn("neg_anchor", F.lit(True))
    return rows.join(bad, "host", "left").fillna(False, ["neg_anchor"])


def expire_stale(items: DataFrame, status: str, seen: str, as_of: Column, days: int, eligible: Column | None = None) -> DataFrame:
    """Published items not seen for days become expired; a null last-seen never does."""
    stale = (F.col(status) == "published") & (F.col(seen) < as_of - F.make_dt_interval(F.lit(days)))
    stale = F.coalesce(stale & eligible if eligible is not None else stale, F.lit(False))
    return items.withColumn(status, F.when(stale, "expired").otherwise(F.col(status)))
