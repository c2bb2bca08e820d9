"""Names of a dictionary in running text: longest match from left to right."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
MARKERS = ("м", "с", "смт", "місто", "селище")
TOKEN_CHARS = "a-zа-яїієґ'’\\-"

#: Forms that may be broadcast, as an automaton; a larger dictionary is joined by a shuffle.
BROADCAST_FORMS = 200_000


def dictionary(forms: DataFrame) -> DataFrame:
    """(form, name, marked, width) from (position, form, name, marked): forms in lower case; of equal forms the first position counts."""
    lowered = forms.select("position", F.lower("form").alias("form"), "name", "marked").filter("form <> ''")
    first = lowered.groupBy("form").agg(F.min_by(F.struct("name", "marked"), F.struct("position", "name")).alias("x"))
    return first.select("form", "x.name", "x.marked", F.size(F.split("form", " ")).alias("width"))


class Names:
    """An Aho-Corasick automaton over the forms, each between spaces, so that it matches whole words only."""

    def __init__(self, forms: tuple[tuple[str, str, bool, int], ...], markers: tuple[str, ...]):
        import ahocorasick

        self.automaton, self.markers = ahocorasick.Automaton(), frozenset(markers)
        for form, name, marked, width in forms:
            self.automaton.add_word(f" {form} ", (len(form) + 1, name, marked, width))
        if forms:
            self.automaton.make_automaton()
        self.cut = re.compile(f"[^{TOKEN_CHARS}]+")

    def __call__(self, text: str) -> list[str]:
        """The distinct names in a lower-case text, in the order of their first match."""
        words = [w.strip("'’") for w in self.cut.split(text) if w]
        if not words or not len(self.automaton):
            return []
        line = f" {' '.join(words)} "
        hits = [(end - size, -width, name, marked) for end, (size, name, marked, width) in self.automaton.iter(line)]
        if not hits:
            return []
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        free, found = 0, {}
        for start, width, name, marked in sorted(hits):
            place = bisect_right(starts, start) - 1
            if place >= free and (not marked or (place and words[place - 1] in self.markers)):
                free = place - width
                found[name] = None
        return list(found)


@lru_cache(maxsize=4)
def _names(forms: tuple[tuple[str, str, bool, int], ...], markers: tuple[str, ...]) -> Names:
    return Names(forms, markers)


def _matched(held, markers: tuple[str, ...]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(held.value, markers)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["key", "names"])

    return match


def find_names(docs: DataFrame, key: str, text: str, forms: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(key, names): the distinct names in each text in the order of their first match; key is unique in docs.

    From each word on the longest form counts, and the words it takes are not matched
    again. A marked form counts only after a marker word. Up to BROADCAST_FORMS forms are an
    automaton that every task has, and nothing is shuffled; of more, words are joined with them and hits shuffled.
    """
    known = dictionary(forms)
    widest, n = known.agg(F.max("width"), F.count(F.lit(1))).first()
    if n <= BROADCAST_FORMS:
        held = docs.sparkSession.sparkContext.broadcast(tuple(tuple(r) for r in known.select("form", "name", "marked", "width").collect()))
        given = docs.select(F.col(key), F.lower(F.col(text).cast("string")))
        kind = docs.schema[key].dataType.simpleString()
        return given.mapInArrow(_matched(held, tuple(markers)), f"key {kind}, names array<string>").select(F.col("key").alias(key), "names")
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[^{TOKEN_CHARS}]+"), lambda w: w != "")
    t = docs.select(F.col(key), F.transform(words, lambda w: F.btrim(w, F.lit("'’"))).alias("_t"))
    # runs are made inside the array, so a row has a few words and never the text
    before = lambda i: F.when(i > 0, F.try_element_at("_t", i))
    run = lambda i, w: F.struct(F.lit(w).alias("w"), F.array_join(F.slice("_t", i + 1, F.lit(w)), " ").alias("form"))
    runs = lambda i: F.filter(F.array(*(F.when(i + w <= F.size("_t"), run(i, w)) for w in range(1, (widest or 1) + 1))), lambda r: r.isNotNull())
    if (widest or 1) == 1:
        grams = t.select(key, F.posexplode(F.transform("_t", lambda w, i: F.struct(before(i).alias("before"), w.alias("form")))).alias("_p", "_r"))
        grams = grams.select(key, "_p", F.col("_r.before").alias("_before"), F.lit(1).alias("w"), "_r.form")
    else:
        grams = t.select(key, F.posexplode(F.transform("_t", lambda _, i: F.struct(before(i).alias("before"), runs(i).alias("runs")))).alias("_p", "_r"))
        grams = grams.select(key, "_p", F.col("_r.before").alias("_before"), F.explode("_r.runs").alias("_r")).select(key, "_p", "_before", "_r.w", "_r.form")
    hits = grams.join(known, "form").filter(~F.col("marked") | F.coalesce(F.col("_before").isin(*markers), F.lit(False)))
    hits = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", (-F.col("w")).alias("w"), "name"))).alias("_h"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("names"))
    step = lambda a, x: F.when(x["_p"] < a["free"], a).otherwise(F.struct((x["_p"] - x["w"]).alias("free"), F.concat(a["names"], F.array(x["name"])).alias("names")))
    found = hits.select(key, F.array_distinct(F.aggregate("_h", start, step)["names"]).alias("names"))
    return docs.select(key).join(found, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
