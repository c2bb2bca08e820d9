"""Term mining by log-odds with a Dirichlet prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def term_counts(rows: DataFrame, terms: Column, passed: Column, weight: Column, host: Column, negative: Column) -> DataFrame:
    """(term, y_pass, y_fail, docs, domains, negative); each text counts a term once."""
    each = rows.select(F.explode(F.array_distinct(terms)).alias("term"), passed.alias("p"), weight.cast("double").alias("w"), host.alias("h"), negative.alias("neg"))
    return each.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("p"), F.col("w"))), F.lit(0.0)).alias("y_pass"), F.coalesce(F.sum(F.when(~F.col("p"), F.col("w"))), F.lit(0.0)).alias("y_fail"),
        F.count_if("p").alias("docs"), F.count_distinct(F.when(F.col("p") & (F.col("h") != ""), F.col("h"))).alias("domains"), F.bool_or("neg").alias("negative"),
    )


def log_odds(counts: DataFrame, alpha: float = 0.5, known_stems: tuple[str, ...] = (), stoplist: DataFrame | None = None) -> DataFrame:
    """counts with z; the totals are of all terms, known and stopped ones go afterwards. Fewer than two terms give none."""
    counts = written(counts, "terms")  # read for the totals and for every use of the scores
    totals = counts.agg((F.sum("y_pass") + alpha * F.count(F.lit(1))).alias("n_pass"), (F.sum("y_fail") + alpha * F.count(F.lit(1))).alias("n_fail"), F.count(F.lit(1)).alias("vocabulary"))
    c = counts.join(F.broadcast(totals))  # one row
    p, f = F.col("y_pass") + alpha, F.col("y_fail") + alpha
    z = (F.ln(p / (F.col("n_pass") - p)) - F.ln(f / (F.col("n_fail") - f))) / F.sqrt(1 / p + 1 / f)
    c = c.filter("vocabulary >= 2").withColumn("z", z).drop("n_pass", "n_fail", "vocabulary")
    if known_stems:
        c = c.filter(~F.col("term").rlike("|".join(known_stems)))
    return c if stoplist is None else c.join(stoplist.select("term"), "term", "left_anti")


def survivors(scores: DataFrame, least_domains: int = 3, least_z: float | None = 1.5, most: int = 50, least_docs: int = 0) -> DataFrame:
    """Terms that pass every gate, the best `most` by z and term; most <= 0 keeps all."""
    kept = scores.filter(~F.col("negative") & (F.col("domains") >= least_domains) & (F.col("docs") >= least_docs))
    if least_z is not None:
        kept = kept.filter(F.col("z") >= least_z)
    kept = kept.orderBy(F.desc("z"), "term")
    return kept.limit(most) if most > 0 else kept


def soft_stop(scores: DataFrame, stopped: DataFrame, factor: float = 1.5) -> DataFrame:
    """Scores without terms that were rejected at z_reject, unless z has grown beyond factor times that."""
    s = stopped.select("term", "z_reject")
    return scores.join(s, "term", "left").filter(F.col("z_reject").isNull() | (F.col("z") > F.col("z_reject") * factor)).drop("z_reject")


def axis_veto(terms: DataFrame, axis: DataFrame) -> DataFrame:
    """Terms of which some word is no word of the axis."""
    words = terms.select("term", F.explode(F.split("term", " ")).alias("word"))
    free = words.join(axis.select("word"), "word", "left_anti").select("term").distinct()
    return terms.join(free, "term", "left_semi")
