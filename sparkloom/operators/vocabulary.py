"""What is kept between passes as lists: terms that are used, stopped or approved, hosts that list others, brands and their sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hosts


def _fold(term: Column) -> Column:
    return F.lower(F.trim(term))


def learned(entries: DataFrame) -> DataFrame:
    """(part, place, term) of approved entries (place, term, source, z): terms of categories in their order, then the mined ones, the
    highest z first. In each part a term that differs by case only counts once, the first; place is then dense from 0."""
    rows = entries.filter("term <> ''").withColumn("part", F.when(F.col("source") == "category", "category").otherwise("mined"))
    rank = F.when(F.col("part") == "category", F.struct(F.lit(0.0).alias("z"), F.lit("").alias("t"), F.col("place").alias("p"))).otherwise(F.struct((-F.coalesce(F.col("z"), F.lit(0.0))).alias("z"), F.col("term").alias("t"), F.col("place").alias("p")))
    first = rows.withColumn("_r", rank).groupBy("part", F.lower("term").alias("_k")).agg(F.min(F.struct("_r", "term")).alias("x"))
    return first.select("part", (F.row_number().over(Window.partitionBy("part").orderBy("x._r")) - 1).cast("long").alias("place"), "x.term")


def service_terms(seed: DataFrame, entries: DataFrame, cap: int) -> DataFrame:
    """(part, place, term): the vocabulary of the grid: seed (place, term) first, then categories, then mined terms, of which at most cap
    count if cap is over 0. Of terms that differ by case and outer spaces only the first counts; it takes its place in the order of part and place."""
    parts = learned(entries)
    mined = parts.filter(F.col("part") == "mined")
    mined = mined.filter(F.col("place") < cap) if cap > 0 else mined
    every = seed.select(F.lit(0).alias("n"), F.lit("seed").alias("part"), F.col("place").cast("long").alias("place"), "term")
    for n, part in ((1, parts.filter("part = 'category'")), (2, mined)):
        every = every.unionByName(part.select(F.lit(n).alias("n"), "part", "place", "term"))
    first = every.filter(_fold(F.col("term")) != "").groupBy(_fold(F.col("term")).alias("_k")).agg(F.min(F.struct("n", "place", "part", "term")).alias("x"))
    return first.select("x.part", "x.place", "x.term")


def stopped(terms: DataFrame, candidates: DataFrame, stoplist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (term, z, ...) without the terms, and the stop list (term, z) with them, each with the z it was rejected at (0 if it was no
    candidate); a term that is stopped already keeps its z."""
    wanted = terms.select("term").distinct()
    scores = candidates.groupBy("term").agg(F.max("z").alias("z"))
    new = wanted.join(stoplist.select("term"), "term", "left_anti").join(scores, "term", "left").select("term", F.coalesce("z", F.lit(0.0)).alias("z"))
    return candidates.join(wanted, "term", "left_anti").select(candidates.columns), stoplist.select("term", "z").unionByName(new)


def unstopped(terms: DataFrame, stoplist: DataFrame) -> DataFrame:
    """The stop list without the terms."""
    return stoplist.join(terms.select("term").distinct(), "term", "left_anti").select(stoplist.columns)


def added(store: DataFrame, found: DataFrame, cap: int) -> DataFrame:
    """(place, host): a list of hosts with the new ones of found behind it, by name, cut from the front to the cap newest.

    Only cap new hosts can be left, so only those are numbered.
    """
    new = found.select("host").filter("host <> ''").distinct().join(store.select("host"), "host", "left_anti").orderBy(F.desc("host")).limit(cap)
    last = store.agg(F.coalesce(F.max("place"), F.lit(-1))).scalar()
    numbered = new.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("host")) + last).cast("long").alias("place"), "host")
    return store.select(F.col("place").cast("long").alias("place"), "host").unionByName(numbered).orderBy(F.desc("place")).limit(cap)


def brand_hosts(brands: DataFrame, sites: DataFrame, tags: DataFrame) -> DataFrame:
    """(key, host, way) of brands (key, qid): the site (qid, host) of the brand's own entry; else that of the entry its places name; else the
    host that most of its places have, of equals the first. tags has key, qid, host and pos, a place each; an empty host is none."""
    known = sites.filter("host <> ''").groupBy("qid").agg(F.min("host").alias("host"))
    own = brands.join(known.withColumnRenamed("host", "own"), "qid", "left").select("key", "own")
    entry = tags.filter("qid <> ''").groupBy("key").agg(F.min_by("qid", "pos").alias("qid")).join(known.withColumnRenamed("host", "entry"), "qid").select("key", "entry")
    each = tags.filter("host <> ''").groupBy("key", "host").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    most = each.groupBy("key").agg(F.min_by("host", F.struct(-F.col("n"), "pos")).alias("most"))
    both = own.join(entry, "key", "left").join(most, "key", "left")
    way = F.when(F.col("own").isNotNull(), "own").when(F.col("entry").isNotNull(), "entry").when(F.col("most").isNotNull(), "places")
    return both.select("key", F.coalesce("own", "entry", "most").alias("host"), way.alias("way")).filter("host is not null")


def rated(top: DataFrame, host: str, blocked: DataFrame) -> DataFrame:
    """(type, ref, note) of the top rated hosts that are not blocked; a blocked one's place is not filled."""
    kept = hosts.not_blocked(top, host, blocked)
    return kept.select(F.lit("website").alias("type"), F.concat(F.lit("https://"), host).alias("ref"), F.concat(F.lit("domain-rating:"), host).alias("note"))


def corpus(candidates: DataFrame, pages: DataFrame, host: str, passed: Column) -> DataFrame:
    """pages of the candidates' hosts with whether an offer was found in them: what the miner starts from before there were passes."""
    return pages.join(candidates.select(host).distinct(), host, "left_semi").withColumn("passed", F.coalesce(passed, F.lit(False)))
