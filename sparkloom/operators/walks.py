"""Walks over the pages of sites: which links lead to targets, and what is read of a site in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import targets, urls
from ..storage import written


def reached(homes: DataFrame, links: DataFrame, domain: str, depth: int = 2, most_pages: int = 30) -> DataFrame:
    """(domain, place, url): targets that links (page, pos, url, anchor) reach from homes (domain, url), breadth first, each once.

    Excluded pages and those of places that are never read are neither kept nor passed
    through, targets are kept, all others are read one level deeper; at most most_pages
    of a domain are read. place orders a domain's targets.
    """
    step = links.select(F.col("page").alias("_from"), "pos", "url", targets.follows(F.col("url")).alias("_follows"), targets.is_target(F.col("url"), F.col("anchor")).alias("_target")).filter("_follows")
    front = homes.select(domain, "url", F.array().cast("array<long>").alias("way"))
    read, seen = None, None
    for level in range(depth):
        rank = F.row_number().over(Window.partitionBy(domain).orderBy("way"))
        done = F.lit(0) if read is None else F.coalesce("_done", F.lit(0))
        pages = front if read is None else front.join(read.groupBy(domain).agg(F.count(F.lit(1)).alias("_done")), domain, "left")
        pages = written(pages.withColumn("_rn", rank + done).filter(F.col("_rn") <= most_pages).select(domain, "url", "way"), "walk")
        read = pages.select(domain, "url") if read is None else read.unionByName(pages.select(domain, "url"))
        found = pages.select(domain, F.col("url").alias("_from"), "way").join(step, "_from").select(domain, "url", F.concat("way", F.array(F.col("pos").cast("long"))).alias("way"), "_target")
        first = found.groupBy(domain, "url").agg(F.min(F.struct("way", "_target")).alias("x")).select(domain, "url", "x.way", F.col("x._target").alias("target")).withColumn("level", F.lit(level))
        first = written(first if seen is None else first.join(seen.select(domain, "url"), [domain, "url"], "left_anti"), "walk")
        seen = first if seen is None else seen.unionByName(first)
        front = first.filter("not target").select(domain, "url", "way")
    order = Window.partitionBy(domain).orderBy("level", "way")
    return seen.filter("target").select(domain, F.row_number().over(order).cast("long").alias("place"), "url")


def plan(homes: DataFrame, found: DataFrame, domain: str, allowed: DataFrame, most: int) -> DataFrame:
    """(domain, place, url): the pages to read of each domain, the home page (domain, url) first if it is a seed, then promotional ones, then the others of found (domain, place, url).

    allowed (domain, url, allowed) has what robots rules say; what it lacks is allowed.
    Of variants of one page the first counts, and at most so many pages.
    """
    home = homes.filter(targets.is_seed(F.col("url"))).select(domain, F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), "url")
    rest = found.join(homes.select(domain).distinct(), domain, "left_semi").select(domain, F.when(targets.is_promo(F.col("url")), 1).otherwise(2).alias("part"), F.col("place").cast("long").alias("place"), "url")
    every = home.unionByName(rest).filter(~urls.is_aggressor_geo(F.col("url")))
    every = every.join(allowed.filter("not allowed").select(domain, "url").distinct(), [domain, "url"], "left_anti")
    first = every.groupBy(domain, urls.website_key(F.col("url")).alias("_key")).agg(F.min(F.struct("part", "place", "url")).alias("x")).select(domain, "x.*")
    rank = F.row_number().over(Window.partitionBy(domain).orderBy("part", "place", "url"))
    return first.withColumn("_rn", rank).filter(F.col("_rn") <= most).select(domain, F.col("_rn").cast("long").alias("place"), "url")
