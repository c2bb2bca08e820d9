"""State that a key's ordered history leaves: decayed scores, streaks, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Entries of a history that are folded as one piece.
PIECE = 4096


def _pieces(rows: DataFrame, key: str, order: list[str], **fields: Column) -> DataFrame:
    """(key, piece, h): histories in order, cut into pieces of about PIECE entries by ranges of the first order column.

    A key of any number of entries is many pieces; only as many entries as have the
    same first order column, beyond that, stay together.
    """
    at = F.col(order[0])
    at = at.cast("timestamp").cast("double") if dict(rows.dtypes)[order[0]].startswith("timestamp") else at.cast("double")
    given = rows.select(key, *order, at.alias("_at"), *(v.alias(k) for k, v in fields.items()))
    ends = given.groupBy(key).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.ceil(F.count(F.lit(1)) / PIECE).alias("_cuts"))
    long = F.broadcast(ends.filter("_cuts > 1 and _last > _first").orderBy(F.desc("_cuts"), key).limit(100_000))
    piece = F.floor((F.col("_at") - F.col("_first")) / (F.col("_last") - F.col("_first")) * F.col("_cuts"))
    cut = given.join(long, key, "left").withColumn("piece", F.coalesce(piece, F.lit(0)))
    return cut.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("h"))


def _along(pieces: DataFrame, key: str, folded: Column) -> DataFrame:
    """(key, p): what each piece was folded to, in order."""
    return pieces.select(key, F.struct("piece", folded.alias("f")).alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("p"))


def domain_state(rows: DataFrame, key: str, order: list[str], offers: Column, errors: Column, structural: Column, decay: float = 0.9, offer_weight: float = 1.0, error_weight: float = 0.5, empty_skip: int = 3) -> DataFrame:
    """(key, score, offers, errors, passes, empty_passes, skip_left, media_streak, provider_ever) after all passes.

    score is max(0, score * decay + offers * offer_weight - errors * error_weight) at each pass.
    """
    # what a run of passes does to the score is score -> max(low, score * by + more), and such maps compose
    first = {"low": 0.0, "by": 1.0, "more": 0.0, "offers": 0.0, "errors": 0.0, "passes": 0, "empty": 0, "skip": 0, "streak": 0, "reset": False, "ever": False}
    zero = F.struct(*((F.lit(v) if k != "low" else F.lit(-1e300)).alias(k) for k, v in first.items()))

    def step(a: Column, x: Column) -> Column:
        gain, none = x["o"] * offer_weight - x["e"] * error_weight, x["o"] == 0
        return F.struct(
            F.greatest(F.lit(0.0), a["low"] * decay + gain).alias("low"), (a["by"] * decay).alias("by"), (a["more"] * decay + gain).alias("more"),
            (a["offers"] + x["o"]).alias("offers"), (a["errors"] + x["e"]).alias("errors"), (a["passes"] + 1).alias("passes"), (a["empty"] + none.cast("int")).alias("empty"),
            F.when(none, empty_skip).otherwise(0).alias("skip"), F.when(x["s"], 0).when(x["o"] > 0, a["streak"] + 1).otherwise(a["streak"]).alias("streak"), (a["reset"] | x["s"]).alias("reset"), (a["ever"] | x["s"]).alias("ever"),
        )

    def after(a: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(b["low"], a["low"] * b["by"] + b["more"]).alias("low"), (a["by"] * b["by"]).alias("by"), (a["more"] * b["by"] + b["more"]).alias("more"),
            (a["offers"] + b["offers"]).alias("offers"), (a["errors"] + b["errors"]).alias("errors"), (a["passes"] + b["passes"]).alias("passes"), (a["empty"] + b["empty"]).alias("empty"),
            b["skip"].alias("skip"), F.when(b["reset"], b["streak"]).otherwise(a["streak"] + b["streak"]).alias("streak"), (a["reset"] | b["reset"]).alias("reset"), (a["ever"] | b["ever"]).alias("ever"),
        )

    pieces = _pieces(rows, key, order, o=offers.cast("double"), e=errors.cast("double"), s=structural)
    folded = _along(pieces, key, F.aggregate("h", zero, step)).withColumn("f", F.aggregate("p", zero, after))
    long = lambda f: F.col(f"f.{f}").cast("long")
    return folded.select(key, F.greatest("f.low", "f.more").alias("score"), long("offers").alias("offers"), long("errors").alias("errors"), long("passes").alias("passes"), long("empty").alias("empty_passes"), long("skip").alias("skip_left"), long("streak").alias("media_streak"), F.col("f.ever").alias("provider_ever"))


def page_cursor(rows: DataFrame, key: str, order: list[str], new: Column, page_cap: int) -> DataFrame:
    """(key, page, dry) after all fetches: on to the next page while pages bring something new; the second empty one in a row, or the cap, starts over."""
    # what a run of fetches does is a map of all states (page, dry), and maps compose
    if page_cap < 1:
        raise ValueError("page_cap is at least 1")
    state = lambda page, dry: F.struct(F.lit(page).alias("page"), F.lit(dry).alias("dry"))
    same = F.array(*(state(p, d) for p in range(1, page_cap + 1) for d in (0, 1)))

    def step(a: Column, x: Column) -> Column:
        capped, over = a["page"] >= page_cap, (a["dry"] + 1 >= 2) | (a["page"] >= page_cap)
        page = F.when(x["n"] > 0, F.when(capped, 1).otherwise(a["page"] + 1)).otherwise(F.when(over, 1).otherwise(a["page"] + 1))
        return F.struct(page.alias("page"), F.when((x["n"] > 0) | over, 0).otherwise(a["dry"] + 1).alias("dry"))

    pieces = _pieces(rows, key, order, n=new)
    short = _along(pieces, key, F.aggregate("h", same, lambda a, x: F.transform(a, lambda s: step(s, x))))
    found = F.aggregate("p", state(1, 0), lambda a, m: F.element_at(m, (2 * a["page"] - 1 + a["dry"]).cast("int")))
    return short.withColumn("f", found).select(key, F.col("f.page").cast("long").alias("page"), F.col("f.dry").cast("long").alias("dry"))


def cooldown(failures: Column, base: float, cap: float, jitter: Column | float = 0.0) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), failures - 1), F.lit(cap)) * (1 + jitter)


def backoff_state(rows: DataFrame, key: str, order: list[str], at: Column, blocked: Column, base: float, cap: float, threshold: int = 0, quarantine: float = 0.0, reprobe: float = 0.0, jitter: Column | float = 0.0) -> DataFrame:
    """(key, fails, cooldown_until, quarantined_until, next_reprobe_at) after all attempts; only a success resets them.

    From threshold failures in a row on (0: never) each failure extends the quarantine and puts off the next trial.
    """
    j = jitter if isinstance(jitter, Column) else F.lit(float(jitter))
    given = rows.select(key, F.struct(*order).alias("_o"), at.cast("double").alias("t"), blocked.alias("b"), j.cast("double").alias("j"))
    # what came before the last success does not matter, and of the failures behind it only their number and the last
    ok = given.groupBy(key).agg(F.max(F.when(~F.col("b"), F.col("_o"))).alias("_ok"))
    behind = given.groupBy(key, "_o", "t", "b", "j").agg(F.count(F.lit(1)).alias("_n")).join(ok, key).filter("b and (_ok is null or _o > _ok)")
    last = behind.groupBy(key).agg(F.sum("_n").alias("fails"), F.max(F.struct("_o", "t", "j")).alias("x"))
    held = (F.col("fails") >= threshold) & F.lit(threshold > 0)
    until = lambda wait: F.coalesce(F.when(held, F.col("x.t") + wait), F.lit(0.0))
    cool = F.coalesce(F.col("x.t") + cooldown(F.col("fails"), base, cap, F.col("x.j")), F.lit(0.0))
    return ok.select(key).join(last, key, "left").select(key, F.coalesce("fails", F.lit(0)).cast("long").alias("fails"), cool.alias("cooldown_until"), until(quarantine).alias("quarantined_until"), until(reprobe).alias("next_reprobe_at"))
